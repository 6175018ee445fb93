"""Clipping, clusters and grids of painted boxes."""

import random

from pyspark.sql import functions as F

from docmd.operators import boxes as B


def test_clusters_and_grids(spark):
    rules = [(1, 1, k, 100.0, 100.0 + 20 * k, 300.0, 100.5 + 20 * k) for k in range(3)] + [(1, 1, 3, 99.0, 100.0, 99.5, 140.0)]
    drawing = [(1, 1, 10, 400.0, 400.0, 450.0, 450.0), (1, 1, 11, 452.0, 400.0, 460.0, 410.0), (1, 1, 12, 464.0, 400.0, 470.0, 410.0), (1, 2, 13, 400.0, 400.0, 450.0, 450.0)]
    df = spark.createDataFrame(rules + drawing, B.BOXES)
    got = {(r.page, r.cluster): (r.parts, r.drawing) for r in B.clusters(df).collect()}
    assert got == {(1, 0): (4, False), (1, 10): (2, True), (1, 12): (1, True), (2, 13): (1, True)}
    assert [(r.page, r.cluster, r.left, r.bottom) for r in B.grids(df).collect()] == [(1, 0, 99.0, 140.5)]
    assert B.clusters(df.where("false")).count() == 0


def test_clusters_equal_all_pairs(spark):
    r = random.Random(6)
    rows = []
    for k in range(150):
        x, y = r.uniform(0, 300), r.uniform(0, 300)
        rows.append((1, 1, k, x, y, x + r.uniform(0, 20), y + r.uniform(0, 20)))
    # every two clusters that are near become one, until none are
    sets = {k: (a[3:], [k]) for k, a in enumerate(rows)}
    again = True
    while again:
        again = False
        for i, j in [(i, j) for i in sorted(sets) for j in sorted(sets) if i < j]:
            if i in sets and j in sets:
                (a, x), (b, y) = sets[i], sets[j]
                if a[0] - 3 <= b[2] and b[0] - 3 <= a[2] and a[1] - 3 <= b[3] and b[1] - 3 <= a[3]:
                    sets[i] = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])), x + y
                    del sets[j]
                    again = True
    got = {x.seq: x.cluster for x in B.with_clusters(spark.createDataFrame(rows, B.BOXES)).collect()}
    assert got == {k: min(parts) for _, parts in sets.values() for k in parts} and 1 < len(sets) < 150


def test_clip_and_captions(spark):
    df = spark.createDataFrame([(1, 1, 0, -10.0, 5.0, 50.0, 20.0), (1, 1, 1, 700.0, 5.0, 750.0, 20.0), (2, 1, 2, 0.0, 0.0, 1.0, 1.0)], B.BOXES)
    clip = spark.createDataFrame([(1, 1, 0.0, 0.0, 612.0, 792.0)], "doc_id long, page int, left double, top double, right double, bottom double")
    assert [tuple(r) for r in B.clipped(df, clip).collect()] == [(1, 1, 0, 0.0, 5.0, 50.0, 20.0)]
    texts = spark.createDataFrame([("Figure 3. X",), ("Fig.  4: y",), ("Fig. 5 shows",), ("Table 2: z",), ("Figures 3",), ("See Table 2:",)], "t string")
    assert [(r.a, r.b) for r in texts.select(B.is_figure_caption(F.col("t")).alias("a"), B.is_table_caption(F.col("t")).alias("b")).collect()] == [(True, False), (True, False), (False, False), (False, True), (False, False), (False, False)]
