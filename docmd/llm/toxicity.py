"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: words, word pairs and pairs with one word between, ASCII lower-cased and
hashed into 2 ** BITS places. Every weight has its own learning rate, and the L1 term leaves most weights at
exactly zero, so the model that goes to the workers is a short list of places and weights (bounded by
2 ** BITS entries).

The model is fitted on at most `bound` labelled texts of each class (those with the smallest hash of their id;
whole texts), and its bias is then moved from the sample's share of toxic rows to that of all labelled rows;
everything else reads all rows. Rows of one id count as toxic if one of them is; null labels are left out.
Null and empty texts have no feature and get the score of the bias; without labelled rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmd.llm.common import unused
from docmd.llm.sampling import per_label, remainder
from docmd.llm.textvec import ALNUM, LOWER, digest_rows, grams, slices, tidy, word_hashes, word_spans

BITS = 20
_SKIP = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Model:
    places: np.ndarray  # sorted
    weights: np.ndarray
    bias: float


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each slice: places and the text (from the slice's first) of each, with repeats, and the number of texts."""
    shift = np.uint64(64 - BITS)
    for first, end, raw, offsets in slices(texts):
        raw = LOWER[raw]
        starts, ends, words = word_spans(raw, offsets, ALNUM)
        h = word_hashes(raw, starts, ends)
        doc = np.repeat(np.arange(end - first, dtype=np.int32), np.diff(words))
        places, owners = [h >> shift], [doc]
        if len(h) > 1:
            same = doc[1:] == doc[:-1]
            places.append((grams(h, 2, 1) >> shift)[same])
            owners.append(doc[1:][same])
        if len(h) > 2:
            same = doc[2:] == doc[:-2]
            places.append((grams(np.stack([h[:-2], h[2:]], 1).ravel(), 2, int(_SKIP))[::2] >> shift)[same])
            owners.append(doc[2:][same])
        yield np.concatenate(places).astype(np.int64), np.concatenate(owners), end - first


def ftrl(x: list[np.ndarray], y: np.ndarray, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> Model:
    """Weights after `epochs` passes over x (the places of each text, each once) in a fixed mixed order."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(x)):
            f = x[i]
            zi, root = z[f], np.sqrt(n[f])
            w = np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2), 0)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y[i]
            more = np.sqrt(n[f] + g * g)
            z[f] = zi + g - (more - root) / alpha * w
            n[f] += g * g
    w = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0)
    places = np.flatnonzero(w[:-1])
    return Model(places, w[places].astype(np.float32), float(w[-1]))


def fit(rows: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", bound: int = 4000, alpha: float = 1.0, beta: float = 1.0, l1: float = 1.5, l2: float = 1.0, epochs: int = 4) -> Model:
    """A model of at most `bound` ids of each class (0 and 1); of an id with several texts, the smallest."""
    known = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).where("k is not null and y is not null").groupBy("k").agg((F.max("y") > 0).cast("int").alias("y"))
    share = known.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    chosen = per_label(known, "y", "k", bound)
    sample = rows.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k")
    sample = sample.groupBy("k").agg(F.first("y").alias("y"), F.min("t").alias("t")).select("y", "t")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for places, owners, n in features(batch.column("t")):
                both = np.unique(owners.astype(np.int64) << BITS | places)
                sizes.append(np.bincount(both >> BITS, minlength=n))
                found.append((both & ((1 << BITS) - 1)).astype(np.int32))
            if sizes:
                yield pa.RecordBatch.from_arrays([batch.column("y"), digest_rows(np.concatenate(sizes), np.concatenate(found))], ["y", "f"])

    got = sample.mapInArrow(run, "y int, f binary").toArrow()
    bias = np.array([1 << BITS], np.int64)
    x = [np.concatenate([np.frombuffer(f.as_buffer(), np.int32).astype(np.int64), bias]) for chunk in got["f"].chunks for f in chunk]
    y = np.array(got["y"].to_pylist(), float)
    order = sorted(range(len(x)), key=lambda i: (y[i], len(x[i]), x[i].tobytes()))  # rows come in any order: make it one
    model = ftrl([x[i] for i in order], y[order] if len(x) else y, alpha, beta, l1, l2, epochs)
    if 0 < y.sum() < len(y):
        model.bias += float(np.log(share[0] / share[1]) - np.log(y.sum() / (len(y) - y.sum())))
    return model


def scores(model: Model, texts: pa.Array) -> np.ndarray:
    """The probability of each text."""
    dense = np.zeros(1 << BITS, np.float32)
    dense[model.places] = model.weights
    out = []
    for places, owners, n in features(texts):
        hit = np.flatnonzero(dense[places])
        both = np.unique(owners[hit].astype(np.int64) << BITS | places[hit])
        total = np.bincount(both >> BITS, weights=dense[both & ((1 << BITS) - 1)], minlength=n) + model.bias
        out.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
    return np.concatenate(out) if out else np.zeros(0)


def predict(rows: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and score, which replaces a kept column of that name."""
    keep = [c for c in keep if c != "score"]
    own = unused(keep, "_text")
    slim = rows.select(*keep, F.col(text).alias(own))
    schema = rows.select(*keep).withColumn("score", F.lit(0.0)).schema

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores(model, batch.column(own)))], [*keep, "score"])

    return slim.mapInArrow(run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder("doc_id", 4) != 2)
    model = fit(documents, labels)
    return predict(documents, model).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
