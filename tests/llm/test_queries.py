"""The thin queries: columns, folds and thresholds of their results."""

from zlib import crc32

import pytest

from quillgraph.llm import queries

DATA = "/root/testdata/sf0.001"


def remainder(i, mod):
    return crc32(str(i).encode()) % mod


@pytest.mark.parametrize("name,mod,held", [("op2_quality", 4, 2), ("op9_toxicity", 3, 1)])
def test_classifiers(spark, name, mod, held):
    ids = [r[0] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id").collect()]
    got = queries.queries()[name](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(ids)
    assert all(r["held_out"] == (remainder(r["doc_id"], mod) == held) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_language_model(spark):
    got = queries.op10_lm_score(spark, DATA).collect()
    assert {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"} <= set(got[0].asDict())
    assert all(r["held_out"] == (remainder(r["doc_id"], 5) == 1) and 0 <= r["n_known"] <= r["n_tokens"] and r["score"] <= 0 for r in got)
    assert sum(r["n_tokens"] for r in got if not r["held_out"]) == got[0]["train_tokens"]


def test_whole_tables_come_back(spark):
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name in ("op3_simhash", "op4_mixing", "op5_sentencepiece", "op7_pii"):
        rows = queries.queries()[name](spark, DATA).collect()
        assert len(rows) == n and "doc_id" in rows[0].asDict()
    assert sum(r["n_docs"] for r in queries.op6_token_counts(spark, DATA).collect()) == n
