"""Token counts by finite-state transducers, compiled from a byte-level BPE file.

Two deterministic transducers run one after the other.

* The splitter reads character classes and says where a pretoken begins. It has eight states. A text is cut
  into chunks of equal length; all chunks run side by side from every state at once, which gives each chunk's
  state map; a parallel prefix scan composes the maps, and a second run from the now known states emits.
* The counter reads the bytes of a pretoken. Its state is what the future can depend on: the longest suffix
  that begins a token, and for every place in it the last token of the encoding up to there and how many
  tokens fewer that encoding has. A transition's emission is the change of the token count, so the sum over a
  pretoken is its number of tokens. That is well defined because the encoding of a prefix ends in the only
  token whose neighbour before it survives next to it. Equal pretokens of a slice (found by hash, compared by
  their bytes) run once; distinct ones advance side by side, RUN bytes of them at a time. Transitions are compiled when
  first met and kept in a hash table, which starts anew between runs once it has more than MAX_STATES states. A run adds a
  state for each of its bytes at most, so a worker holds MAX_STATES + RUN states, or as many more as the longest pretoken
  has bytes: that changes memory and speed, never a count.

Null and empty texts have no token. The file's special strings inside a text are one token each, as the
library handles them by default. Bytes that are not UTF-8 count as the replacement character.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmd.llm.common import unused
from docmd.llm.textvec import mix, same_spans, slices, tidy, word_hashes

CHUNK = 256
MAX_STATES, RUN = 200_000, 1 << 16

START, LETTER, NUMBER, MARK, SPACE, BLANKS, ONE_MORE, TWO_MORE = range(8)
#: Symbols: letter, number, other, apostrophe before one or two letters of a contraction, a last space before
#: something else, a blank before a blank or the end, another last blank; 8 more: the same, first in a text.
_SYMBOLS = 16


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """next state and whether a pretoken begins, by state * _SYMBOLS + symbol."""
    following, begins = np.zeros((8, _SYMBOLS), np.uint8), np.ones((8, _SYMBOLS), bool)
    for state in range(8):
        for symbol, (target, joins) in enumerate(
            [(LETTER, (LETTER, SPACE)), (NUMBER, (NUMBER, SPACE)), (MARK, (MARK, SPACE)), (ONE_MORE, ()), (TWO_MORE, ()), (SPACE, ()), (BLANKS, (BLANKS,)), (START, ())]
        ):
            if symbol in (3, 4) and state in (MARK, SPACE):
                target, joins = MARK, (MARK, SPACE)
            if symbol == 0 and state in (ONE_MORE, TWO_MORE):
                target, joins = state - 1 if state == TWO_MORE else START, (state,)
            following[state, symbol], begins[state, symbol] = target, state not in joins
    following[:, 8:], begins[:, 8:] = following[START, :8], begins[START, :8]
    return following.ravel(), begins.ravel()


_NEXT, _BEGINS = _splitter()


@cache
def _classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 blank, by code point."""
    kinds = np.full(0x110000, 2, np.uint8)
    for c in range(0x110000):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            kinds[c] = 0
        elif k == "N":
            kinds[c] = 1
        elif k == "Z":
            kinds[c] = 3
    kinds[[*range(0x09, 0x0E), 0x85]] = 3
    return kinds


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The splitter's symbol of each code point; first: the places where a text begins."""
    kinds = _classes()[points]
    n = len(points)
    begin = np.zeros(n + 2, bool)
    begin[first] = True
    begin[n:] = True
    out = kinds.copy()
    after = np.append(points[1:], [0, 0]).astype(np.uint32)
    blank = np.flatnonzero(kinds == 3)
    inner = begin[blank + 1] | (kinds[np.minimum(blank + 1, n - 1)] == 3)
    out[blank] = np.where(inner, 6, np.where(points[blank] == 0x20, 5, 7))
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        one, two = after[quote], after[quote + 1]
        has_one = ~begin[quote + 1]
        has_two = has_one & ~begin[np.minimum(quote + 2, n)]
        short = has_one & np.isin(one, [ord(c) for c in "stmd"])
        long = has_two & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        out[quote] = np.where(short, 3, np.where(long, 4, 2))
    out[first] += 8
    return out


def split(sym: np.ndarray) -> np.ndarray:
    """Whether a pretoken begins at each symbol: chunk state maps, their prefix scan, then the emissions."""
    n = len(sym)
    chunks = -(-n // CHUNK)
    grid = np.zeros(chunks * CHUNK, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    maps = np.tile(np.arange(8, dtype=np.uint8), (chunks, 1))
    for row in grid:
        maps = np.take(_NEXT, maps * np.uint8(_SYMBOLS) + row[:, None])
    step = 1
    while step < chunks:  # maps[i] becomes the map of chunks 0..i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].copy(), axis=1)
        step *= 2
    state = np.append(np.uint8(START), maps[:-1, START])
    begins = np.empty((CHUNK, chunks), bool)
    for k, row in enumerate(grid):
        at = state * np.uint8(_SYMBOLS) + row
        begins[k] = _BEGINS[at]
        state = _NEXT[at]
    return begins.T.ravel()[:n]


def _code(token: int, fewer: int) -> int:
    """A token's number and a difference of counts; 0 is no place where a token ends."""
    return token + 1 << 12 | fewer + 2048


def _state(suffix: bytes, places: list[int]) -> bytes:
    return len(suffix).to_bytes(2, "little") + suffix + array("I", places).tobytes()


def _parts(state: bytes) -> tuple[bytes, array]:
    n = 2 + int.from_bytes(state[:2], "little")
    return state[2:n], array("I", state[n:])


class Counter:
    """The counting transducer: state << 8 | byte leads to next state << 8 | change of the count + 128."""

    def __init__(self, ranks: dict[tuple[bytes, bytes], int], vocabulary: set[bytes]) -> None:
        self.ranks, self.tokens = ranks, [b"", *sorted(vocabulary)]
        self.numbers = {t: i for i, t in enumerate(self.tokens)}  # 0: no token
        if len(self.tokens) >= 1 << 19 or max(map(len, self.tokens)) >= 1 << 11:
            raise ValueError("too many tokens, or too long ones, for the states' format")
        #: What a longer token begins with: a later token can begin that many bytes back.
        self.prefixes = {t[:k] for t in vocabulary for k in range(len(t))}
        self.alone = lru_cache(50_000)(self._alone)
        self.clear()

    def clear(self) -> None:
        #: Each state as bytes: the length of its suffix, the suffix, and a code for each place in it from the end on.
        self.states = [_state(b"", [_code(0, 0)])]
        self.ids = {self.states[0]: 0}
        self.keys, self.entries, self.filled = np.full(1 << 16, -1, np.int64), np.zeros(1 << 16, np.int64), 0

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Where each transition is in the hash table, or the empty place where its search ends."""
        mask = len(self.keys) - 1
        at = (mix(keys.astype(np.uint64)) & np.uint64(mask)).astype(np.int64)
        open_ = np.arange(len(at))
        while len(open_):
            there = self.keys[at[open_]]
            open_ = open_[(there != keys[open_]) & (there >= 0)]
            at[open_] = (at[open_] + 1) & mask
        return at

    def add(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """Puts in transitions that are not there yet."""
        if (self.filled + len(keys)) * 2 > len(self.keys):
            old, were = self.keys, self.entries
            size = 2 * len(old)
            while (self.filled + len(keys)) * 2 > size:
                size *= 2
            self.keys, self.entries, self.filled = np.full(size, -1, np.int64), np.zeros(size, np.int64), 0
            self.add(old[old >= 0], were[old >= 0])
        while len(keys):
            at = self.slot(keys)
            self.keys[at] = keys  # of those that want one place, the last gets it
            won = self.keys[at] == keys
            self.entries[at[won]] = entries[won]
            self.filled += int(won.sum())
            keys, entries = keys[~won], entries[~won]

    def encode(self, word: bytes) -> list[bytes]:
        """Merges by rank: the plain definition."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _alone(self, before: int, token: int) -> bool:
        a, b = self.tokens[before], self.tokens[token]
        return self.encode(a + b) == ([a, b] if before else [b])

    def compile(self, state: int, byte: int) -> int:
        suffix, places = _parts(self.states[state])
        new = suffix + bytes([byte])
        for size in range(len(new), 0, -1):
            if places[size - 1] and (token := self.numbers.get(new[-size:])) and self.alone((places[size - 1] >> 12) - 1, token):
                break
        else:
            raise ValueError(f"no token ends in {new!r}")
        change = (places[size - 1] & 0xFFF) - 2048 + 1
        tail = new
        while tail not in self.prefixes:
            tail = tail[1:]
        old = [p - change if p and new[len(new) - k :] in self.prefixes else 0 for k, p in enumerate(places[: len(tail)], 1)]
        target = _state(tail, [_code(token, 0), *old])
        if (i := self.ids.get(target)) is None:
            i = self.ids[target] = len(self.states)
            self.states.append(target)
        return i << 8 | (change + 128)

    def run(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each pretoken raw[starts[i]:ends[i]]."""
        order = np.argsort(starts - ends, kind="stable")
        sizes = (ends - starts)[order]
        cut, done = np.cumsum(sizes), 0
        out = np.empty(len(order), np.int64)
        while done < len(order):
            upto = max(done + 1, int(np.searchsorted(cut, (cut[done - 1] if done else 0) + RUN, "right")))
            out[order[done:upto]] = self._advance(raw, starts[order[done:upto]], sizes[done:upto])
            done = upto
            if len(self.states) > MAX_STATES:
                self.clear()
        return out

    def _advance(self, raw: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of pretokens, the longest first: all advance by one byte at a time."""
        state, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for k in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -k, "left"))  # those longer than k
            keys = state[:n] << 8 | raw[at[:n] + k]
            slots = self.slot(keys)
            if len(new := np.unique(keys[self.keys[slots] < 0])):
                self.add(new, np.array([self.compile(int(x) >> 8, int(x) & 255) for x in new], np.int64))
                slots = self.slot(keys)
            got = self.entries[slots]
            state[:n] = got >> 8
            total[:n] += (got & 255) - 128
        return total


@cache
def load(path: str) -> tuple[Counter, list[str]]:
    """The counter of a tokenizer file, and its special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the byte alphabet of these files: printable bytes stand for themselves, the others for 256, 257, ...
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    to = lambda s: bytes(byte[c] for c in s)
    special = [t["content"] for t in spec["added_tokens"]]
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    ranks = {(to(a), to(b)): i for i, (a, b) in enumerate(merges)}
    reachable = {a + b for a, b in ranks} | {bytes([b]) for b in range(256)}
    return Counter(ranks, reachable), special


def count(path: str, texts: pa.Array) -> np.ndarray:
    """Tokens of each text."""
    counter, special = load(path)
    found = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(special, key=len, reverse=True)) or rb"(?!)")
    out = []
    for first, end, raw, offsets in slices(texts, 2 << 20):
        total = np.zeros(end - first, np.int64)
        data = raw.tobytes()
        try:
            text = None if data.isascii() else data.decode("utf-8")
        except UnicodeDecodeError:
            fixed = [data[a:e].decode("utf-8", "replace") for a, e in zip(offsets[:-1], offsets[1:], strict=True)]
            out.append(count(path, pa.array(fixed)))
            continue
        spans = [m.span() for m in found.finditer(data)] if special else []
        owner = np.searchsorted(offsets, [a for a, _ in spans], "right") - 1
        # a special string that lies across two texts is none
        spans = [(s, int(o)) for s, o in zip(spans, owner, strict=True) if s[1] <= offsets[o + 1]]
        np.add.at(total, [o for _, o in spans], 1)
        cuts = np.unique(np.concatenate([offsets, np.array([x for s, _ in spans for x in s], np.int64)]))
        skip = np.isin(cuts[:-1], [s[0] for s, _ in spans])
        keep = np.flatnonzero(~skip)  # segments that are ordinary text
        if spans:
            raw = np.concatenate([raw[cuts[i] : cuts[i + 1]] for i in keep]) if len(keep) else raw[:0]
            text = raw.tobytes().decode("utf-8") if text is not None else None
        starts = np.concatenate([[0], np.cumsum(np.diff(cuts)[keep])]).astype(np.int64)
        owners = np.searchsorted(offsets, cuts[:-1][keep], "right") - 1
        if len(raw):
            if text is None:
                begins = split(symbols(raw, starts[:-1]))
                chars = None
            else:
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                chars = np.flatnonzero((raw & 0xC0) != 0x80)
                begins = np.zeros(len(raw), bool)
                begins[chars[split(symbols(points, np.searchsorted(chars, starts[:-1])))]] = True
            at = np.flatnonzero(begins)
            ends = np.append(at[1:], len(raw))
            one, which = same_spans(raw, word_hashes(raw, at, ends), at, ends)
            tokens = counter.run(raw, at[one], ends[one])[which]
            total += np.bincount(owners[np.searchsorted(starts, at, "right") - 1], weights=tokens, minlength=end - first).astype(np.int64)
        out.append(total)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def token_counts(rows: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, n_bytes and n_tokens, which replace kept columns of their names."""
    keep = [c for c in keep if c not in ("n_bytes", "n_tokens")]
    own = unused(keep, "_text")
    slim = rows.select(*keep, F.coalesce(F.octet_length(F.col(text)).cast("long"), F.lit(0).cast("long")).alias("n_bytes"), F.col(text).alias(own))
    schema = slim.drop(own).withColumn("n_tokens", F.lit(0).cast("long")).schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [*keep, "n_bytes"]), pa.array(count(path, batch.column(own)))], [*keep, "n_bytes", "n_tokens"])

    return slim.mapInArrow(run, schema)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(documents, public_tokenizers.path("byte_bpe_50k.json")).withColumn("over_limit", F.col("n_tokens") > 512)
