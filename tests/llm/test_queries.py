"""The registered queries on the smallest tables: columns, SQL, and the pipeline's stages."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from shelfmark.llm import decontam, simhash
from shelfmark.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op2_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op3_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op5_simhash": ["doc_id", "fingerprint", "component_id"],
    "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op8_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op10_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op11_merkle": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op12_hard_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
    "op13_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    assert set(COLUMNS.get(name, [])) <= set(df.columns)
    got = sorted(repr([round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in sorted(df.columns))]) for r in df.collect())
    documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    if name in ORACLE_SQL:
        c = duckdb.connect()
        for t in ("documents", "pages", "labels", "benchmark", "embeddings"):
            c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        rel = c.execute(ORACLE_SQL[name])
        names = [d[0] for d in rel.description]
        want = sorted(repr([round(v, 6) if isinstance(v, float) else v for v in (r[names.index(k)] for k in sorted(names))]) for r in rel.fetchall())
        assert got == want
    elif name != "op9_decontamination":
        assert len(got) == documents


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf).cache()
        seen[name] = docs
        if name != "sharding":
            assert docs.columns == columns
    assert seen["language ID"].count() == before
    odd = spark.createDataFrame([(-1, "zxqv kjwq xzzq vvkq jjxw qqzx", "en", "s", 1), (-2, None, "en", "s", 1)], spark.read.parquet(f"{sf}/documents.parquet").schema)
    assert dict(corpus_pipeline.STAGES)["language ID"](spark, spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd), sf).filter("doc_id < 0").count() == 0
    kept = seen["SimHash near-dedup"]
    assert kept.count() == simhash.near_duplicates(seen["language ID"]).select("component_id").distinct().count()
    assert simhash.near_duplicates(kept).select("component_id").distinct().count() == kept.count()
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontam.contaminated(seen["benchmark decontamination"], benchmark).count() == 0
    assert kept.count() - seen["benchmark decontamination"].count() == decontam.contaminated(kept, benchmark).select("doc_id").distinct().count()
    last = seen["sharding"]
    assert last.count() == seen["mixing"].count() and {"shard", "slot"} <= set(last.columns)
    assert corpus_pipeline.run(spark, sf).count() == last.count()


def test_pipeline_edges(spark, tmp_path, sf):
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (3, "One text, clean enough to keep, in plain words.", None, "s", 1), (3, "One text, clean enough to keep, in plain words.", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [r["doc_id"] for r in got] == [3]
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "empty" / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "empty" / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0


def test_pipeline_with_long_texts_and_clashing_names(spark, tmp_path, sf):
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = " ".join(f"word{k % 9973} of prose" for k in range(40_000))
    rows = [(k, t, "en", "s", 1, "a", 2, "b", "c", 3, "d", 5, "e", "f", "g") for k, t in enumerate([long, "Some plain words of prose to keep.", "Other plain words, about something else.", long])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, host string, n long, fp string, root string, score int, found string, size int, shard string, slot string, text_crc32 string").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} <= {0, 1, 2} and {r["host"] for r in got} == {"a"} and {r["root"] for r in got} == {"c"}
    assert any(r["text"] == long for r in got)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
