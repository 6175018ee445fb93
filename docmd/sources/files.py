"""Documents as rows: scans, format dispatch, size guard, charsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DOCUMENT_SIZE = 100 << 20
FORMATS = {"csv": "csv", "docx": "docx", "htm": "html", "html": "html", "pdf": "pdf", "tsv": "csv", "txt": "txt", "xlsx": "xlsx"}
SCHEMA = "path string, name string, source_uri string, length long, content binary"


def scan(spark: SparkSession, path: str, glob: str | None = None, limit: int | None = MAX_DOCUMENT_SIZE) -> DataFrame:
    """The files below a path: (path, name, source_uri, length, content). Unused contents are not read, nor those of files of
    more than limit bytes (null contents): the scan filters by length before it opens a file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    if limit is not None:
        large = found.where(F.col("length") > limit).select("path", "modificationTime", "length").withColumn("content", F.lit(None).cast("binary"))
        found = found.where(F.col("length") <= limit).unionByName(large)
    return found.select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.lit(None).cast("string").alias("source_uri"), "length", "content")


def from_table(rows: DataFrame, content: Column, name: Column, source_uri: Column | None = None) -> DataFrame:
    """Documents that lie in a table: the other columns stay."""
    data = content.cast("binary")
    return rows.withColumns({"name": name, "source_uri": source_uri if source_uri is not None else F.lit(None).cast("string"), "length": F.octet_length(data).cast("long"), "content": data})


def register(extension_: str, format_: str) -> None:
    """From now on files of an extension are read as a format. An extension has one format; another one is an error."""
    own = extension_.lower().removeprefix(".")
    if format_ not in set(FORMATS.values()):
        raise ValueError(f"no reader of the format {format_}")
    if FORMATS.setdefault(own, format_) != format_:
        raise ValueError(f"two formats for .{own}: {FORMATS[own]} and {format_}")


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case; empty without one."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def format_of(name: Column) -> Column:
    """The reader of a name's extension; null for an unknown one."""
    known = F.create_map(*(F.lit(x) for pair in FORMATS.items() for x in pair))
    return known[extension(name)]


def refusal(name: Column, length: Column, limit: int | None = MAX_DOCUMENT_SIZE) -> Column:
    """Why a document is not read, as struct (kind, message); null for one that is."""
    if limit is not None and limit <= 0:
        raise ValueError("the size limit must be positive")
    names = ", ".join(sorted(FORMATS))
    why = lambda kind, *message: F.struct(F.lit(kind).alias("kind"), F.concat(*message).alias("message"))
    unknown = F.when(format_of(name).isNull(), why("unsupported", F.lit("Unsupported file extension: "), name, F.lit(f". Supported: {names}")))
    return unknown if limit is None else unknown.when(length > limit, why("too_large", F.lit("The document "), name, F.lit(f" is larger than {limit} bytes")))


def decode(content: Column) -> Column:
    """Text by its byte order mark, else UTF-8 where it is that, else windows-1252."""
    text = content.cast("string")
    mark3, mark2 = F.substring(content, 1, 3), F.substring(content, 1, 2)
    rest = lambda k: F.substring(content, k, 1 << 30)
    # windows-1252 is Latin-1 but for 0x80 to 0x9F; fixed values, from 0x80 on
    shown = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"
    western = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), shown)
    return (
        F.when(mark3 == F.lit(b"\xef\xbb\xbf"), F.decode(rest(4), "UTF-8"))
        .when(mark2 == F.lit(b"\xff\xfe"), F.decode(rest(3), "UTF-16LE"))
        .when(mark2 == F.lit(b"\xfe\xff"), F.decode(rest(3), "UTF-16BE"))
        .when(F.is_valid_utf8(text), text)
        .otherwise(western)
    )
