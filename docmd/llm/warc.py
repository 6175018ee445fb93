"""WARC archives with a two-level capture index.

`write_archives` writes a WARC/1.1 record for every row with Spark's own committing writer: records end with two
line ends, which is the writer's line separator. Of records with equal payloads of at least MIN_REVISIT bytes the
one with the largest id is a response and the others are revisits that refer to it; smaller ones are responses.
`build_index` reads the archives' headers and writes the captures, sorted by reversed-host URL key and id, as
compressed blocks; its directory has one entry a block. Blocks grow with the number of captures, so the directory
never has more than DIRECTORY entries and goes to every worker. `look_up` finds each key's blocks by binary search
in the directory, range-reads them and searches them; `read_records` range-reads the records, in file order.

Ids and URLs may repeat: every row has its record, and a lookup gives all records of its key and id. A null
payload is empty; a null or odd URL is kept as far as a header can hold it (blanks and control characters
percent-encoded); a null id is written as `-`. No rows: an empty archive and index.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docmd.llm.common import lookup, scratch_path, shuffle_partitions, stored
from docmd.llm.files import place, put

MIN_REVISIT = 1000
RECORDS_PER_FILE = 8192
BLOCK, DIRECTORY = 512, 100_000
READ_BYTES = 64 << 20
END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAME = "urn:capture:"


def with_revisits(rows: DataFrame) -> DataFrame:
    """rows (id, url, payload) with digest, size and, for revisits, refers_to."""
    known = rows.withColumns({"digest": F.sha1(F.coalesce("payload", F.lit(""))), "size": F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")})
    large = known.where(F.col("size") >= MIN_REVISIT).select("id", "digest")
    heads = stored(large.groupBy("digest").agg(F.max("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), "warc-heads")
    # the join carries ids and digests; payloads stay where they are
    copies = lookup(large, heads, "digest", large.count(), "n").where("not (id <=> head)").select("id", "digest", "head").distinct()
    copies = stored(copies, "warc-copies").select(F.col("id").alias("copy"), F.col("digest").alias("same"), F.col("head").alias("refers_to"))
    return known.join(copies, F.col("id").eqNullSafe(F.col("copy")) & (F.col("digest") == F.col("same")), "left").drop("copy", "same")


def record(date: str) -> Column:
    """The record of a row (id, url, payload, digest, size, refers_to), without its last two line ends."""
    url = F.coalesce(F.regexp_replace("url", r"[\s\p{Cntrl}]", "%20"), F.lit("-"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.coalesce("payload", F.lit(""))))
    name = lambda c: F.concat(F.lit(f"<{_NAME}"), F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit(">\r\n"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), name("id"),
        F.lit(f"WARC-Date: {date}\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: "), name("refers_to"))).otherwise(F.lit("\r\n")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )


def write_archives(rows: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for every row below path."""
    known = with_revisits(rows.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(payload).alias("payload")))
    known.select(record(date).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def url_key(url: str) -> str:
    """com,example,www)/path?query: the host's labels in reverse, without scheme, user, default port and fragment."""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    tail = parts.path or "/"
    port_text = f":{port}" if port and port != {"http": 80, "https": 443}.get(parts.scheme) else ""
    return ",".join(reversed(host.split("."))) + port_text + ")" + tail + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str, own: str) -> str:
    """The sort key of the index: URL key, then id."""
    return f"{url_key(url)} {own}"


def _headers(f: io.BufferedIOBase) -> dict[str, str] | None:
    """The header of the record that begins here; None at the end."""
    line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record here: {line[:40]!r}")
    out = {}
    while line := f.readline().rstrip(b"\r\n"):
        name, _, value = line.partition(b":")
        out[name.decode().lower()] = value.strip().decode("utf-8", "replace")
    return out


def _name(value: str) -> str:
    return value.strip("<>").removeprefix(_NAME)


def captures(spark: SparkSession, path: str) -> DataFrame:
    """(key, file, offset, length) of every record of the archives below path."""
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("path").to_pylist():
                store, at = place(file)
                out: list[tuple] = []
                with io.BufferedReader(store.open_input_file(at), 1 << 20) as f:
                    begin = 0
                    while (head := _headers(f)) is not None:
                        end = f.seek(int(head["content-length"]) + len(END), 1)
                        out.append((capture_key(head["warc-target-uri"], _name(head["warc-record-id"])), file, begin, end - len(END) - begin))
                        begin = end
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_pylist([dict(zip(_CAPTURE.names, x, strict=True)) for x in out], _CAPTURE)
                            out = []
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(_CAPTURE.names, x, strict=True)) for x in out], _CAPTURE)

    return files.mapInArrow(run, "key string, file string, offset long, length long")


_CAPTURE = pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


@dataclass
class Index:
    """The directory: of each block, in order, its first and last key and where it lies."""

    first: list[str]
    last: list[str]
    blocks: list[tuple[str, int, int]]  # file, offset, length


def build_index(spark: SparkSession, archives: str, path: str) -> Index:
    """Writes the blocks below path; the index of all records of the archives."""
    rows = stored(captures(spark, archives), "warc-captures")
    lines = max(BLOCK, -(-rows.count() // DIRECTORY))
    ordered = rows.repartitionByRange("key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        parts: list[bytes] = []
        found: list[dict] = []
        size = 0

        def block(of: list[tuple]) -> None:
            nonlocal size
            data = zlib.compress("\n".join("\t".join(map(str, x)) for x in of).encode())
            found.append({"first": of[0][0], "last": of[-1][0], "offset": size, "length": len(data)})
            parts.append(data)
            size += len(data)

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in _CAPTURE.names), strict=True)
            while len(held) >= lines:
                block(held[:lines])
                held = held[lines:]
        if held:
            block(held)
        if found:
            file = f"{path}/{hashlib.sha1((found[0]['first'] + str(size)).encode()).hexdigest()}.cdx"
            put(file, parts)
            kind = pa.schema([("first", pa.string()), ("last", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
            yield pa.RecordBatch.from_pylist([x | {"file": file} for x in found], kind)

    directory = ordered.mapInArrow(run, "first string, last string, file string, offset long, length long").collect()  # DIRECTORY rows and one a task at most
    directory.sort(key=lambda r: (r.first.encode(), r.last.encode(), r.file, r.offset))
    return Index([r.first for r in directory], [r.last for r in directory], [(r.file, r.offset, r.length) for r in directory])


@lru_cache(64)
def _block(file: str, offset: int, length: int) -> tuple[list[str], list[tuple[str, int, int]]]:
    """The keys of a block, and their records."""
    store, at = place(file)
    with store.open_input_file(at) as f:
        lines = [x.split("\t") for x in zlib.decompress(f.read_at(length, offset)).decode().split("\n")]
    return [x[0] for x in lines], [(x[1], int(x[2]), int(x[3])) for x in lines]


def look_up(queries: DataFrame, index: Index, url: str = "url", key: str = "page_id") -> DataFrame:
    """(file, offset, length) of every record whose URL key and id some row of queries has."""
    wanted = queries.select(F.coalesce(F.regexp_replace(url, r"[\s\p{Cntrl}]", "%20"), F.lit("-")).alias("u"), F.coalesce(F.col(key).cast("string"), F.lit("-")).alias("i")).distinct()
    first, last = [x.encode() for x in index.first], [x.encode() for x in index.last]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(*x) for x in zip(batch.column("u").to_pylist(), batch.column("i").to_pylist(), strict=True)], pa.string())], ["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, int]] = []
            for k in batch.column("key").to_pylist():
                own = k.encode()
                for b in range(bisect_left(last, own), bisect_right(first, own)):
                    there, records = _block(*index.blocks[b])
                    at = bisect_left(there, own, key=str.encode)
                    while at < len(there) and there[at] == k:
                        out.append(records[at])
                        at += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64())], ["file", "offset", "length"])

    # URLs that differ can have one key (http and https): a record is wanted once
    ordered = wanted.mapInArrow(keys, "key string").distinct().repartitionByRange("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "file string, offset long, length long")


def parse(data: bytes) -> dict:
    """A record's fields: id, type, url, size and digest of the full payload, refers_to, and the payload (none in a revisit)."""
    f = io.BytesIO(data)
    head = _headers(f)
    block = f.read(int(head["content-length"]))
    http, _, payload = block.partition(END.encode())
    kind = head["warc-type"]
    digest, size = head["warc-payload-digest"].removeprefix("sha1:"), len(payload)
    if kind == "revisit":
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        payload = None
    elif (found := hashlib.sha1(payload).hexdigest()) != (digest if len(digest) == 40 else base64.b32decode(digest).hex()):
        raise ValueError(f"the payload of {head['warc-record-id']} has the digest {found}, not {digest}")
    refers = head.get("warc-refers-to")
    return {"id": _name(head["warc-record-id"]), "record_type": kind, "url": head["warc-target-uri"], "payload_bytes": size, "payload_digest": digest, "refers_to": _name(refers) if refers else None, "payload": payload}


def read_records(places: DataFrame) -> DataFrame:
    """The records at (file, offset, length)."""
    known = stored(places, "warc-places")
    # by the bytes that are read: the places themselves are small, and Spark would put them all in one task
    size = known.agg(F.sum("length")).first()[0] or 0
    tasks = max(shuffle_partitions(known.sparkSession), -(-size // READ_BYTES))
    ordered = known.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    kind = pa.schema([("id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file, f = "", None
        for batch in batches:
            out, held = [], 0
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != open_file:
                    store, at = place(file)
                    open_file, f = file, store.open_input_file(at)
                out.append(parse(f.read_at(length, offset)))
                held += length
                if held > 16 << 20:
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)

    return ordered.mapInArrow(run, "id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archives = scratch_path(spark, "warc")
    write_archives(pages, archives)
    index = build_index(spark, archives, f"{archives}-index")
    records = read_records(look_up(pages, index))
    return records.select(F.expr("try_cast(id as long)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM s)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id <> head THEN head END AS refers_to
FROM m
"""
