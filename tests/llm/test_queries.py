"""The registered queries, and the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

from tests.llm import brute

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tables(spark, documents, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    documents.drop("id", "score").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, rows[2][1]), (2, "one two three four")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, f"http://h{i % 3}.org/{i}", "x" * (i * 200)) for i in range(12)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(i, [i % 7 + 0.5] * 64, 0) for i in range(20)], "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_names():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{n}" for n in range(1, 14)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= names


COLUMNS = {
    "op1_langid": ["doc_id", "held_out", "lang_pred", "score"], "op2_toxicity": ["doc_id", "held_out", "score", "predicted"], "op3_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op4_line_dedup": ["doc_id", "n_lines", "n_removed", "text_sha256"], "op5_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op6_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op7_lm_score": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op8_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op9_near_duplicates": ["doc_id", "n_shingles", "component_id", "kept"], "op10_sentencepiece": ["doc_id", "pieces", "n_pieces", "lossless"],
    "op11_merkle": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"], "op12_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op13_sort_means": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, tables, rows, name):
    import __spark_entry__ as entry

    out = entry.queries()[name](spark, tables)
    assert out.columns[: len(COLUMNS[name])] == COLUMNS[name] or set(COLUMNS[name]) <= set(out.columns)
    assert out.count() == {"op3_warc": 12, "op12_url_filter": 12, "op13_sort_means": 20}.get(name, len(rows))


def test_pipeline(spark, tables, rows):
    import corpus_pipeline
    from docmd.llm import langid

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "line_dedup", "near_duplicates", "decontamination", "sentencepiece"]
    text = {r.doc_id: r.text for r in docs.collect()}
    first = stages["language"](spark, docs, tables).cache()
    rejected = {r.doc_id for r in langid.predict(docs, langid.fit(langid.training_rows(docs))).where("rejected").collect()}
    assert {r.doc_id for r in first.collect()} == set(text) - rejected and {i for i, t in text.items() if not (t or "").strip()} <= rejected
    second = stages["line_dedup"](spark, first, tables).cache()
    kept = brute.line_dedup(sorted((r.doc_id, r.text) for r in first.where("doc_id is not null").distinct().collect()))
    assert {r.doc_id: r.text for r in second.where("doc_id is not null").collect()} == {i: t for i, t in kept.items() if t.strip() or t == text[i]}
    third = stages["near_duplicates"](spark, second, tables).cache()
    groups = brute.components({r.doc_id: brute.shingles(r.text) for r in second.where("doc_id is not null").collect()}, 75)
    assert sorted(r.doc_id for r in third.where("doc_id is not null").collect()) == sorted(set(groups.values()))
    fourth = stages["decontamination"](spark, third, tables).cache()
    items = {r.item_id: r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()}
    hit = brute.windows({r.doc_id: r.text for r in third.collect()}, items)
    assert {r.doc_id for r in fourth.collect()} == {i for i, v in hit.items() if not v[1]} and len(hit) > fourth.count()
    assert all(x.columns == docs.columns for x in (first, second, third, fourth))
    assert second.where(F.length("text") != F.col("n_chars")).where("n_chars <> 1").count() == 0
    last = stages["sentencepiece"](spark, fourth, tables)
    assert last.count() == fourth.count() and last.where("not lossless").count() == 0
    assert corpus_pipeline.run(spark, tables).count() == fourth.count()
    none = docs.where("false")
    for f in stages.values():
        none = f(spark, none, tables)
        assert none.count() == 0
