"""Office Open XML packages: parts, relations, core properties."""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree import ElementTree as ET

from docmd.functions.text import clean

REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
OLE2 = bytes.fromhex("D0CF11E0")


class Unreadable(Exception):
    """A document that can't be read."""


class Package:
    """A zip package: XML parts by name, with their relations."""

    def __init__(self, data: bytes, kind: str) -> None:
        if data[:4] == OLE2:
            raise Unreadable(f"The {kind} file is password-protected or in the old binary format")
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
            self.names = set(self.zip.namelist())
        except (zipfile.BadZipFile, OSError, ValueError) as e:
            raise Unreadable(f"Cannot read the {kind} file") from e

    def xml(self, name: str) -> ET.Element | None:
        """The root of a part; None where there is none."""
        name = name.lstrip("/")
        try:
            return ET.fromstring(self.zip.read(name)) if name in self.names else None
        except (ET.ParseError, zipfile.BadZipFile, OSError, RuntimeError) as e:
            raise Unreadable(f"Cannot read {name}") from e

    def relations(self, part: str) -> dict[str, tuple[str, str, bool]]:
        """Of a part: id to (kind, target, whether it is outside)."""
        folder, file = posixpath.split(part)
        root = self.xml(f"{folder}/_rels/{file}.rels" if folder else f"_rels/{file}.rels")
        out = {}
        for r in root if root is not None else ():
            outside = r.get("TargetMode") == "External"
            target = r.get("Target", "")
            if not outside:
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[r.get("Id", "")] = (r.get("Type", "").rpartition("/")[2], target, outside)
        return out

    def main(self, fallback: str) -> str:
        """The name of the main part."""
        return next((t for kind, t, _ in self.relations("").values() if kind == "officeDocument"), fallback)

    def properties(self) -> dict[str, str | None]:
        """title, creator and language of the core properties."""
        name = next((t for kind, t, _ in self.relations("").values() if kind == "core-properties"), "docProps/core.xml")
        root = self.xml(name)
        found = {e.tag.rpartition("}")[2]: e.text for e in (root if root is not None else ())}
        return {k: clean(found.get(k)) for k in ("title", "creator", "language")}
