"""Every operator on a small corpus of hard cases, against plain definitions."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmd.llm import decontaminate, langid, linedup, media, neardup, ngramlm, piecebpe, tokencount, toxicity, warc
from docmd.llm.common import connected_components, lookup, scratch_path
from docmd.llm.sampling import per_label, remainder
from tests.llm import brute

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_sampling(spark):
    df = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 2).alias("l"))
    taken = per_label(df, "l", "k", 30)
    assert {r.l: r["count"] for r in taken.groupBy("l").count().collect()} == {0: 30, 1: 30}
    assert per_label(df.where("k < 10"), "l", "k", 30).count() == 10
    for r in spark.range(20).select("id", remainder("id", 7).alias("m")).collect():
        assert r.m == zlib.crc32(str(r.id).encode()) % 7


def test_components_and_lookup(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 400)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    linked = {v for e in edges if e[0] != e[1] for v in e}
    assert got == {v: find(v) for v in linked}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    rows = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("c", 2)], "k string, v int")
    values = rows.groupBy("k").agg(F.max("v").alias("m"), F.count("v").alias("n")).where("k <> 'c'")
    assert lookup(rows, values, "k", 52, "n").count() == 51
    assert lookup(rows, values, "k", 52, "n", "left").count() == 52


def test_langid(spark, documents, empty, rows):
    r = random.Random(2)
    german = [(1000 + i, " ".join(r.choice(["ßäu", "über", "schön", "größe", "für", "möchte"]) for _ in range(30)), "de", "s", 1) for i in range(20)]
    both = spark.createDataFrame([x for x in rows if x[1]] + german, documents.select("doc_id", "text", "lang", "source", "n_chars").schema)
    model = langid.fit(both, per_language=50)
    assert model.languages == ["de", "en"]
    got = {x.doc_id: x for x in langid.predict(both, model).collect()}
    assert all(got[g[0]].lang_pred == "de" for g in german) and got[5].lang_pred == "en"
    edge = spark.createDataFrame([(1, None), (2, ""), (3, "123 !? €"), (4, "語 語 語"), (5, "x"), (None, "für schön über möchte")], "doc_id long, text string")
    out = {x.doc_id: x for x in langid.predict(edge, model).collect()}
    assert all((out[i].lang_pred, out[i].score, out[i].rejected) == ("und", 0.0, True) for i in (1, 2, 3))
    assert out[4].lang_pred in model.languages and out[4].rejected and out[None].lang_pred == "de"
    assert langid.accepted(edge, model).columns == edge.columns
    none = langid.fit(empty)
    assert {x.lang_pred for x in langid.predict(documents, none).collect()} == {"und"}
    assert langid.predict(empty, model).count() == 0


def test_toxicity(spark, documents, empty):
    r = random.Random(8)
    mild = ["river", "stone", "cloud", "bread", "green", "paper", "light", "house", "seven", "table"]
    text = lambda bad: " ".join([*(r.choice(mild) for _ in range(60)), *(["vile", "wretch"] if bad else [])])
    rows = [(i, text(i % 5 == 0)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows if i < 300] + [(7, None), (None, 1), (8, 0), (8, 0)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    assert 0 < len(model.places) < 400
    got = {x.doc_id: x.score for x in toxicity.predict(df, model).collect()}
    assert all((got[i] >= 0.3) == (i % 5 == 0) for i in range(300, 400))
    edge = toxicity.predict(documents, model, keep=("doc_id", "score")).collect()
    assert all(0 <= x.score <= 1 for x in edge) and len(edge) == documents.count()
    assert toxicity.scores(toxicity.fit(empty, labels), pa.array(["x", None]))[0] == pytest.approx(0.5)
    assert toxicity.predict(empty, model).count() == 0


def test_warc(spark, tmp_path):
    big = "<p>x\r\n\r\n" * 300
    rows = [(1, "http://a.b.c/x", big), (2, "https://a.b.c/x#f", big), (2, "https://a.b.c/x#f", big), (3, None, None), (None, "http://q", ""), (5, "no url at all", big), (6, "http://[bad", None), (7, "http://é.x/ü y\n", big + "é"), (8, "http://a.b.c/x", "short"), (9, "http://a.b.c/x", "short")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = scratch_path(spark, "test-warc")
    warc.write_archives(df, path)
    index = warc.build_index(spark, path, f"{path}-index")
    got = warc.read_records(warc.look_up(df, index)).collect()
    assert len(got) == len(rows)
    expected = sorted((str(i) if i is not None else "-", "revisit" if h == big and i != 5 else "response", len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "5" if h == big and i != 5 else None) for i, _, h in rows)
    assert sorted((x.id, x.record_type, x.payload_bytes, x.payload_digest, x.refers_to) for x in got) == expected
    assert all(x.payload is None or hashlib.sha1(x.payload).hexdigest() == x.payload_digest for x in got)
    missing = spark.createDataFrame([(99, "http://a.b.c/x")], "page_id long, url string")
    assert warc.look_up(missing, index).count() == 0
    many = spark.range(1500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h.org/"), F.col("id")).alias("url"), F.lit("t").alias("html"))
    warc.write_archives(many, f"{path}-many")
    index = warc.build_index(spark, f"{path}-many", f"{path}-many-index")
    assert len(index.blocks) >= 3 and index.first == sorted(index.first)
    assert warc.read_records(warc.look_up(many.where("page_id % 20 = 0"), index)).select("id").distinct().count() == 75
    warc.write_archives(df.where("false"), f"{path}-none")
    assert warc.look_up(df, warc.build_index(spark, f"{path}-none", f"{path}-none-index")).count() == 0


def test_url_key():
    assert warc.url_key("HTTP://User@Www.Example.COM:80/a?b=1#c") == "com,example,www)/a?b=1"
    assert warc.url_key("https://x.org:8443") == "org,x:8443)/"


def test_line_dedup(spark, documents, empty, rows):
    got = linedup.without_repeats(documents).collect()
    expected = brute.line_dedup(sorted({x[:2] for x in rows if x[0] is not None and x[1] is not None}))
    assert len(got) == len(rows) and set(documents.columns) <= set(got[0].asDict())
    for x in got:
        if x.doc_id is not None and x.text is not None:
            assert x.text == expected[x.doc_id], x.doc_id
        else:
            assert x.n_removed == 0
    assert linedup.without_repeats(empty).count() == 0
    small = spark.createDataFrame([(1, "Hello world one\n\nHello world one\nx"), (4, " hello WORLD one "), (5, "x\ny\n"), (6, "é" * 50 + "\n" + "é" * 51)], "doc_id long, text string")
    assert {x.doc_id: x.text for x in linedup.without_repeats(small).collect()} == {1: "Hello world one\n\nx", 4: "", 5: "y\n", 6: "é" * 50}


def test_token_counts(spark, documents, empty, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(3)
    texts = ["", None, "it's", "''s", " 's", "a's's", "\n's", "we'll  go\n\n  now ", "  ", "'r", "'rex", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endof", "text|>", "x" * 3000, "👍🏽", "\u0085 z", "'S 'Ll", "½ Ⅷ x²"]
    texts += ["".join(r.choice("ab 's'tdmlrev\n\t 1é語<|endoftext|> .,!") for _ in range(r.randint(0, 60))) for _ in range(600)]
    texts += ["".join(chr(r.choice([r.randint(1, 0xD7FF), r.randint(32, 126), r.randint(0xE000, 0x1FFFF)])) for _ in range(30)) for _ in range(300)]
    expected = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert tokencount.count(path, pa.array(texts, pa.string())).tolist() == expected
    got = tokencount.token_counts(documents, path, keep=("doc_id", "score")).collect()
    want = {x[0]: (len((x[1] or "").encode()), len(library.encode(x[1] or "", add_special_tokens=False).ids)) for x in rows}
    assert len(got) == len(rows) and all((x.n_bytes, x.n_tokens) == want[x.doc_id] for x in got)
    assert tokencount.token_counts(empty, path).count() == 0
    counter = tokencount.load(path)[0]
    counter.clear()  # a new table gives the same counts
    assert tokencount.count(path, pa.array(texts[:50], pa.string())).tolist() == expected[:50]


def test_media(documents, empty, rows):
    r = random.Random(1)
    for n in [*range(0, 700, 3), 8191, 8192, 8193, 8192 * 13 + 5]:
        payload = r.randbytes(n)
        stream = media.mux(payload)
        read = media.demux(stream)
        assert len(stream) % media.PACKET == 0 and read.payload == payload and not (read.continuity_errors or read.table_errors or read.damaged) and read.programs == {1: [0x100]}
    stream = media.mux(r.randbytes(50_000))
    lost = media.demux(stream[: 188 * 10] + stream[188 * 11 :])
    assert (lost.continuity_errors, lost.damaged, len(lost.timestamps)) == (1, 1, 6)
    assert media.demux(stream[: 188 * 10] + stream[188 * 9 :]).payload == media.demux(stream).payload
    assert media.demux(b"junk" + stream).payload == media.demux(stream).payload and media.demux(b"").packets == 0
    broken = bytearray(stream)
    broken[20] ^= 1
    assert media.demux(bytes(broken)).table_errors == 1
    got = media.read(media.stored(documents), keep=("doc_id", "n_bytes")).collect()
    want = {x[0]: media.padded((x[1] or "").encode()) for x in rows}
    for x in got:
        p = want[x.doc_id]
        assert (x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert len(got) == len(rows) and media.read(media.stored(empty)).count() == 0


def test_lm_score(documents, empty, rows):
    train = [brute.words(x[1]) + ["</s>"] for x in rows]
    p, counts = brute.kneser_ney(train)
    model = ngramlm.fit(documents)
    assert model.total == sum(counts.values()) and model.size == len(counts)
    texts = {x[0]: brute.words(x[1]) + ["</s>"] for x in rows}
    for x in ngramlm.predict(documents, model, keep=("doc_id", "score")).collect():
        t = texts[x.doc_id]
        assert x.score == pytest.approx(brute.log10_sum(p, t), rel=1e-9) and x.n_tokens == x.n_known == len(t)
        assert x.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (model.total + model.size + 1)) for w in t), rel=1e-9)
    assert sum(p("</s>", w) for w in counts) + p("</s>", "unseen word") == pytest.approx(1)
    none = ngramlm.fit(empty)
    assert {x.score for x in ngramlm.predict(documents, none).collect()} == {0.0}
    assert ngramlm.predict(empty, model).count() == 0


def test_decontaminate(spark, documents, empty):
    docs = [(1, "a b c d e f g h i j k l m n"), (2, None), (3, ""), (4, "A-B! c, the the the cat"), (5, "b c d"), (None, "the cat"), (6, "x the cat y the cat"), (7, "z " + "q " * 30), (8, "q " * 12), (9, "a b " * 20), (10, "Über é-x 9")]
    items = [(1, "c d e f g h i j k l m"), (2, "the cat"), (3, "The Cat!"), (4, ""), (5, None), (6, "q " * 15), (10, "b c d"), (11, "b a " * 8), (12, "über")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute.windows(dict(docs), dict(items))
    # lower-casing is of ASCII only
    assert want[10][2] == []
    for limit in (500_000, 0):
        found, kinds = decontaminate.hits(df, bench, broadcast_rows=limit)
        assert {x.id for x in found.select("id").distinct().collect()} == {k for k, v in want.items() if v[1]}
    assert {x.id: (x.n_words, x.n_hit, list(x["items"])) for x in decontaminate.summary(df, bench).collect()} == want
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    docs, items = {i: text(r.randint(0, 60)) for i in range(40)}, {i: text(r.randint(1, 25)) for i in range(6)}
    df, bench = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {x.id: (x.n_words, x.n_hit, list(x["items"])) for x in decontaminate.summary(df, bench).collect()} == brute.windows(docs, items)
    assert decontaminate.summary(empty, bench).count() == 0
    assert {x.n_hit for x in decontaminate.summary(df, bench.where("false")).collect()} == {0}


def test_near_duplicates(documents, empty, rows):
    got = neardup.near_duplicates(documents).collect()
    sets = {x[0]: brute.shingles(x[1]) for x in rows if x[0] is not None}
    want = brute.components(sets, 75)
    assert len(got) == len(rows) and len(set(want.values())) < len(want) - 3
    for x in got:
        if x.id is not None:
            assert (x.n, x.component) == (len(sets[x.id]), want[x.id]), x.id
        else:
            assert x.component is None
    assert neardup.near_duplicates(empty).count() == 0


def test_estimate():
    r = np.random.default_rng(1)
    from docmd.llm import simjoin

    for share in (0.3, 0.6, 0.9):
        a = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
        b = np.concatenate([a[: int(4000 * share)], r.integers(0, 1 << 63, 4000 - int(4000 * share), dtype=np.uint64)])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        packed = simjoin.pack(np.stack([neardup.minima(a), neardup.minima(b)]))
        assert simjoin.estimate(packed[:1], packed[1:], 240)[0, 0] == pytest.approx(true, abs=0.15)


def test_large_cluster_is_cut_into_tiles(spark, monkeypatch):
    from docmd.llm import simjoin

    monkeypatch.setattr(simjoin, "BLOCK", 8)
    r = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in r.sample(range(120), r.randint(0, 6)):
            w[k] = f"x{r.randrange(10**6)}"
        rows.append((i + 1, " ".join(w)))
    got = {x.id: x.component for x in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.components({i: brute.shingles(t) for i, t in rows}, 75)


def test_sentencepiece(documents, empty, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    texts = ["", " ", "  a  b\n\tc ", "hello world", "日本語 text", "a" * 3000, " " * 300 + "x", "<s> </s> <unk> <0x0A>", "\x00\x01z", "😀😀 é"] + ["".join(r.choice("ab the  \n\té語😀<s>.,x") for _ in range(r.randint(0, 50))) for _ in range(600)]
    pieces = lambda xs, **k: [ids[a:b].tolist() for ids, at in piecebpe.encode(path, pa.array(xs, pa.string()), **k) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert pieces(texts, dropout=0.0) == [library.encode(t) for t in texts]
    varied = pieces(texts)
    assert varied != pieces(texts, dropout=0.0) and varied == pieces(texts) and varied != pieces(texts, seed=3)
    assert all(piecebpe.decode(path, np.array(p, int)) == t for p, t in zip(varied, texts, strict=True))
    marks = ["▁", "x▁y ▁", None, "▁ ▁a"]
    assert [piecebpe.decode(path, np.array(p, int)) for p in pieces(marks)] == [t or "" for t in marks]
    all_skipped = pieces(["hello world"], dropout=1.0)[0]
    assert [piecebpe.load(path).pieces[i] for i in all_skipped] == list("▁hello▁world")
    got = piecebpe.round_trip(documents, path).collect()
    assert len(got) == len(rows) and all(x.lossless for x in got)
    assert [x.pieces for x in got if x.doc_id == [r for r in rows if r[1] is None][0][0]] == [None]
    assert piecebpe.round_trip(empty, path).count() == 0
