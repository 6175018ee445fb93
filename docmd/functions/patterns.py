"""Patterns shared by the column functions (Java regular expressions) and their Python twins.

Fixed values: what CommonMark and the output format take for syntax.
"""

# what a line's strip at its end removes, but for the line feed
WS = r"[\t\x0B\f\x1C-\x1F \u1680\u2000-\u2006\u2008-\u200A\u2028\u2029\u205F\u3000]"
# what a strip removes: the same characters, and line ends
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200A\u2028\u2029\u205F\u3000"
RULE_LINE = r"^(\s*)(?:([-=])(?:\s*\2)*|([*_])(?:\s*\3){2,}|\*)\s*$"
BLOCK_MARKER = r"^(\s*)(#|>|```|~~~)"
TAG_START = r"(\\*)<(?=[A-Za-z/!?])"
PIPE = r"(\\*)\|"
SAFE_URL = r"(?i)(https?|mailto):"
LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
EMAIL = rf"[a-zA-Z0-9.!#$%&'*+/=?^_`{{|}}~-]+@{LABEL}(?:\.{LABEL})*"
CONTROL = r"[\x00-\x1F\x7F]"
NOT_IN_AUTOLINK = r"[\s\x00-\x1F\x7F<>]"
LINK_SYNTAX = rf"\]\(<[^<>\n]*>\)|<(?i:https?|mailto):[^\s\x00-\x1F\x7F<>]*>|<{EMAIL}>"
ADDRESS_LIKE = r"/|^www\.|://"
ADDRESS_END = r"[.,;:)]+$"
