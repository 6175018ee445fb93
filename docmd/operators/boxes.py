"""Painted boxes of pages: clipping, clusters of near boxes, grids of rules, captions.

boxes: doc_id, page, seq, left, top, right, bottom (points, from the top left). Pages are independent; a page of more
than MAX_BOXES boxes has no clusters, so a task holds a bounded page at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOXES = "doc_id long, page int, seq int, left double, top double, right double, bottom double"
# Limits of pages and clusters.
MAX_BOXES, NEAR, THIN, MAX_RULES = 10_000, 3.0, 1.5, 1000
FIGURE_CAPTION = r"^\s*(Figure|Fig\.)\s*\d+[.:]"
TABLE_CAPTION = r"^\s*Table\s+\d+[.:]"


def clipped(boxes: DataFrame, clips: DataFrame) -> DataFrame:
    """boxes cut to the visible part of their page (doc_id, page, left, top, right, bottom); those outside go."""
    inner = clips.select("doc_id", "page", *(F.col(c).alias(f"_{c}") for c in ("left", "top", "right", "bottom")))
    cut = boxes.join(inner, ["doc_id", "page"]).withColumns({"left": F.greatest("left", "_left"), "top": F.greatest("top", "_top"), "right": F.least("right", "_right"), "bottom": F.least("bottom", "_bottom")})
    return cut.where("left <= right and top <= bottom").select(*boxes.columns)


def near_groups(boxes: np.ndarray, near: float) -> np.ndarray:
    """The group of each box (left, top, right, bottom): that of the boxes at most near from it, directly or by others,
    as the smallest place in it. A sweep from the left compares a box with those that reach as far."""
    root = np.arange(len(boxes))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    open_ = np.zeros(0, int)
    left, top, right, bottom = boxes.reshape(-1, 4).T
    for i in np.argsort(left, kind="stable"):
        open_ = open_[right[open_] + near >= left[i]]
        for j in open_[(top[open_] - near <= bottom[i]) & (bottom[open_] + near >= top[i])]:
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
        open_ = np.append(open_, i)
    return np.array([find(i) for i in range(len(boxes))], int)


def cluster_groups(boxes: np.ndarray, near: float = NEAR) -> np.ndarray:
    """The cluster of each box, as the smallest place in it: clusters are boxes themselves, and grow until none are near."""
    n, alive = len(boxes), 0
    extents, heads, root = np.empty((n, 4)), np.empty(n, int), np.arange(n)
    for i, box in enumerate(boxes):
        own, head = box.copy(), i
        while len(hits := np.flatnonzero((extents[:alive, :2] - near <= own[2:]).all(1) & (extents[:alive, 2:] + near >= own[:2]).all(1))):
            own = np.concatenate([np.minimum(own[:2], extents[hits, :2].min(0)), np.maximum(own[2:], extents[hits, 2:].max(0))])
            least = min(head, int(heads[hits].min()))
            root[heads[hits]] = root[head] = least
            head = least
            rest = np.delete(np.arange(alive), hits)
            alive = len(rest)
            extents[:alive], heads[:alive] = extents[rest], heads[rest]
        extents[alive], heads[alive] = own, head
        alive += 1
    for i in range(n):  # heads come before their members
        root[i] = root[root[i]]
    return root


def _components(table: pa.Table) -> pa.Table:
    """The cluster of each box of a page, as the smallest seq in it."""
    table = table.sort_by([("seq", "ascending")])
    table = table.slice(0, len(table) if len(table) <= MAX_BOXES else 0)
    boxes = np.column_stack([table[c].to_numpy().astype(float) for c in ("left", "top", "right", "bottom")])
    return table.append_column("cluster", pa.array(table["seq"].to_numpy()[cluster_groups(boxes)], pa.int64()))


def with_clusters(boxes: DataFrame) -> DataFrame:
    """boxes with cluster: boxes of a page that are at most NEAR apart, directly or by others; a cluster is as wide as its parts."""
    own = boxes.select(*(c.split(" ")[0] for c in BOXES.split(", ")))
    return own.groupBy("doc_id", "page").applyInArrow(_components, f"{BOXES}, cluster long")


def clusters(boxes: DataFrame) -> DataFrame:
    """One row for each cluster: its extent, its parts, whether a part is no thin rule (a drawing), and its rules."""
    thin_h, thin_v = F.col("bottom") - F.col("top") < THIN, F.col("right") - F.col("left") < THIN
    return with_clusters(boxes).groupBy("doc_id", "page", "cluster").agg(
        F.min("left").alias("left"), F.min("top").alias("top"), F.max("right").alias("right"), F.max("bottom").alias("bottom"), F.count(F.lit(1)).alias("parts"),
        F.bool_or(~thin_h & ~thin_v).alias("drawing"), F.count_if(thin_h & ~thin_v).alias("horizontal"), F.count_if(thin_v & ~thin_h).alias("vertical"),
    )


def grids(boxes: DataFrame) -> DataFrame:
    """Clusters of rules only that can frame a table: two horizontal ones and a vertical one at least."""
    return clusters(boxes).where(~F.col("drawing") & (F.col("parts") <= MAX_RULES) & (F.col("horizontal") >= 2) & (F.col("vertical") >= 1))


def is_figure_caption(text: Column) -> Column:
    return text.rlike(FIGURE_CAPTION)


def is_table_caption(text: Column) -> Column:
    return text.rlike(TABLE_CAPTION)
