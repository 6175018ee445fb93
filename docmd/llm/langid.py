"""Language ID by nearest centroid.

A text is a vector of hashed byte 2- and 3-grams (ASCII lower-cased, everything but letters a space), with
1 + log counts, weighted by inverse document frequency and scaled to length 1. Every language has a few
centroids found by spherical k-means; a text gets the language of the centroid with the largest cosine.
A text that is farther from that centroid than `reject_factor` times the farthest of its training texts'
cosines is rejected.

The model is fitted on at most `per_language` texts of each language, and fewer where there are many languages, so that
they are SAMPLE at most (documented bounds; whole texts, of an id with several the smallest label's); the LANGUAGES most
frequent labels are learnt. The driver holds the sampled texts, and the vectors of one language at a time. Everything else reads all rows. Null and empty texts and texts without a letter are `und`, score 0, rejected.
Without any labelled row there is no language: every text is `und`. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmd.llm.common import released, unused
from docmd.llm.sampling import per_label, remainder
from docmd.llm.textvec import give_back, slices, tidy

BITS = 14
DIM = 1 << BITS
UNDEFINED = "und"
#: Bytes that training texts are cut to for the floors, and the quantile of their cosines.
LENGTHS, QUANTILE = (16, 64, 256, 1024, 4096), 0.01
#: Bounds of the sample: texts in all, and labels.
SAMPLE, LANGUAGES = 3200, 400
#: Texts that are a dense matrix at once.
BLOCK = 128
_NORMAL = np.full(256, 32, np.uint8)
_NORMAL[97:123] = _NORMAL[65:91] = np.arange(97, 123, dtype=np.uint8)
_NORMAL[128:] = np.arange(128, 256, dtype=np.uint8)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one row each, of length 1
    owner: np.ndarray  # the language of each centroid
    floors: np.ndarray  # the smallest cosine that each language accepts, at each of LENGTHS


def counts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """n-gram counts of each text, a dense row each."""
    b = _NORMAL[raw].astype(np.uint32)
    two = np.zeros(len(b), np.uint32)
    three = np.zeros(len(b), np.uint32)
    two[:-1] = (b[:-1] * np.uint32(0x9E3779B1) + b[1:] * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)
    three[:-2] = (b[:-2] * np.uint32(0xC2B2AE3D) + b[1:-1] * np.uint32(0x9E3779B1) + b[2:] * np.uint32(0x165667B1)) >> np.uint32(32 - BITS)
    out = np.zeros((len(offsets) - 1, DIM), np.float32)
    for i, (a, e) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if e - a > 1:
            out[i] = np.bincount(two[a : e - 1], minlength=DIM)
            out[i] += np.bincount(three[a : max(a, e - 2)], minlength=DIM)
    return out


def _counted(texts: list[bytes]) -> np.ndarray:
    return counts(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))


def unit(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, np.where(length > 0, length, 1), out=out)


def weighted(c: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The vectors of texts with n-gram counts c. One matrix beside c is made, as they are large."""
    out = np.maximum(c, np.float32(1))
    np.log(out, out=out)
    out += np.float32(1)
    out *= c > 0
    out *= idf
    return unit(out, out)


def _vectors(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    """A dense row for each of one language's texts."""
    x = np.empty((len(texts), DIM), np.float32)
    for a in range(0, len(texts), BLOCK):
        x[a : a + BLOCK] = weighted(_counted(texts[a : a + BLOCK]), idf)
    return x


def _total(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The sum of the chosen rows, one after another: a copy of them would be as large as x."""
    out = np.zeros(x.shape[1], x.dtype)
    for i in np.flatnonzero(chosen):
        out += x[i]
    return out


def clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Sums of the clusters of spherical k-means; starts with the text nearest to the mean and then far ones.

    A start has a tenth of the texts farther away than itself, and clusters below a fiftieth of the texts are given
    up, so that outliers are no centroids.
    """
    chosen = [int(np.argmax(x @ x.mean(0)))]
    for _ in range(min(k, len(x)) - 1):
        chosen.append(int(np.argsort((x @ x[chosen].T).max(1), kind="stable")[len(x) // 10]))
    sums = x[chosen]
    for _ in range(rounds):
        own = (x @ unit(sums).T).argmax(1)
        sizes = np.bincount(own, minlength=len(sums))
        large = np.flatnonzero(sizes >= max(2, len(x) / 50))
        sums = np.stack([_total(x, own == j) for j in (large if len(large) else [int(sizes.argmax())])])
    return sums


def _floors(texts: list[bytes], x: np.ndarray, sums: np.ndarray, idf: np.ndarray, factor: float) -> np.ndarray:
    """The floor at each of LENGTHS; where fewer than a quarter of the texts are as long, that of the length before."""
    centres, own = unit(sums), (x @ unit(sums).T).argmax(1)
    squares = (sums**2).sum(1)
    both = np.concatenate([(sums[own[a : a + BLOCK]] * x[a : a + BLOCK]).sum(1) for a in range(0, len(x), BLOCK)])
    rest = np.sqrt(np.maximum(squares[own] - 2 * both + 1, 0))
    out = np.zeros(len(LENGTHS))
    for n, length in enumerate(LENGTHS):
        found, long = [], [i for i, t in enumerate(texts) if len(t) >= length or not n]
        if 4 * len(long) < len(texts):
            out[n] = out[n - 1]
            continue
        for a in range(0, len(long), BLOCK):
            rows = np.array(long[a : a + BLOCK])
            p = weighted(_counted([texts[i][:length] for i in rows]), idf)
            sims, at = p @ centres.T, np.arange(len(rows))
            others = (p * (sums[own[rows]] - x[rows])).sum(1)
            sims[at, own[rows]] = np.where(rest[rows] > 1e-3, others / np.maximum(rest[rows], 1e-3), 0)
            found.append(sims.max(1))
        out[n] = factor * np.quantile(np.concatenate(found), QUANTILE)
    return out


def fit(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = 400, centroids: int = 4, reject_factor: float = 0.8) -> Model:
    """A model of at most per_language texts of each non-null label."""
    labelled = rows.select(F.col(key).alias("k"), F.col(label).alias("l"), F.col(text).alias("t")).where("l is not null and t is not null")
    known = [r.l for r in labelled.groupBy("l").count().orderBy(F.desc("count"), "l").limit(LANGUAGES).collect()]
    labelled = labelled.where(F.col("l").isin(known)) if len(known) == LANGUAGES else labelled
    ids = per_label(labelled.select("k", "l"), "l", "k", max(1, min(per_language, SAMPLE // max(len(known), 1))))
    # the chosen ids are at most that many for each language
    sample = labelled.join(F.broadcast(ids.select("k")), "k", "left_semi").groupBy("k").agg(F.min(F.struct("l", "t")).alias("x")).select("x.l", "x.t").toArrow()
    kinds = np.array(sample["l"].to_pylist(), dtype=object)
    texts = [t.encode() for t in sample["t"].to_pylist()]
    del sample
    released(rows.sparkSession)  # what Spark used on the driver goes before the matrices come
    # the driver holds the vectors of one language at a time: those of all are hundreds of MB
    having = np.zeros(DIM, int)
    for a in range(0, len(texts), BLOCK):
        having += np.count_nonzero(_counted(texts[a : a + BLOCK]), axis=0)
    idf = np.log((1 + len(texts)) / (1 + having)).astype(np.float32) + np.float32(1)
    languages = sorted(set(kinds))
    rows_, owner, floors = [], [], []
    for j, language in enumerate(languages):
        own = [texts[i] for i in np.flatnonzero(kinds == language)]
        mine = _vectors(own, idf)
        sums = clusters(mine, centroids)
        rows_ += list(unit(sums))
        owner += [j] * len(sums)
        floors.append(_floors(own, mine, sums, idf, reject_factor))
        del mine
    give_back()
    return Model(languages, idf, np.array(rows_, np.float32).reshape(-1, DIM), np.array(owner, int), np.array(floors).reshape(-1, len(LENGTHS)))


def floor(model: Model, owner: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The smallest accepted cosine of texts of these languages and bytes."""
    at = np.log2(np.clip(sizes, LENGTHS[0], LENGTHS[-1]))
    return np.stack([np.interp(at, np.log2(LENGTHS), f) for f in model.floors])[owner, np.arange(len(at))]


def classify(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and rejected of each text."""
    names, scores, rejected = [], [], []
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ascii_letter = np.zeros(256, bool)
    ascii_letter[[*range(65, 91), *range(97, 123)]] = True
    for first, end, raw, offsets in slices(texts, 1 << 20):
        near = np.concatenate([[0], np.cumsum(ascii_letter[raw])])
        letters = near[offsets[1:]] > near[offsets[:-1]]
        for i in np.flatnonzero(~letters & (offsets[1:] > offsets[:-1])):
            letters[i] = any(map(str.isalpha, texts[first + int(i)].as_py() or ""))
        for a in range(0, end - first, BLOCK):
            n = min(BLOCK, end - first - a)
            sub = offsets[a : a + n + 1]
            if not model.languages:
                best, cos = np.zeros(n, int), np.zeros(n)
            else:
                sims = weighted(counts(raw[sub[0] : sub[-1]], sub - sub[0]), model.idf) @ model.centroids.T
                best = sims.argmax(1)
                cos = np.clip(sims[np.arange(n), best], 0, 1).astype(float)
            ok = letters[a : a + n] & bool(model.languages)
            names += [model.languages[model.owner[b]] if y else UNDEFINED for b, y in zip(best, ok, strict=True)]
            scores.append(np.where(ok, cos, 0.0))
            rejected.append(~ok | (cos < floor(model, model.owner[best], np.diff(sub)) if model.languages else True))
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return names, join(scores, float), join(rejected, bool)


def predict(rows: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, then lang_pred, score (the cosine) and rejected; these replace kept columns of their names."""
    keep = [c for c in keep if c not in ("lang_pred", "score", "rejected")]
    own_text = unused(keep, "_text")
    slim = rows.select(*keep, F.col(text).alias(own_text))
    schema = rows.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(True)}).schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, rejected = classify(model, batch.column(own_text))
            own = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], [*keep, "lang_pred", "score", "rejected"])

    return slim.mapInArrow(run, schema)


def accepted(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text the model does not reject, with all their columns as they are."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~classify(model, batch.column(text))[2]))

    return rows.mapInArrow(run, rows.schema)


def training_rows(documents: DataFrame) -> DataFrame:
    """The rows that may be learnt from: crc32(doc_id) mod 3 is not 1, lang is not null."""
    return documents.where((remainder("doc_id", 3) != 1) & F.col("lang").isNotNull())


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(training_rows(documents))
    return predict(documents, model).select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
