import random

import sentencepiece

from quillgraph.llm.sentencepiece_codec import encoded_lengths, load
from quillgraph.llm import token_counts as t


def test_limits_against_brute_force(spark):
    r = random.Random(2)
    lengths = [r.choice([0, 1, 7, r.randint(0, 5000), r.randint(0, 40_000)]) for _ in range(700)] + [7] * 400
    df = spark.createDataFrame([(n, 1) for n in lengths] + [(None, 1)], "length int, n_docs int")
    limits = t.context_limits(t.histogram(df)).cache()
    got = {x["context_limit"]: x for x in limits.collect()}
    assert set(got) == set(lengths)
    for n, x in got.items():
        assert x["n_docs"] == lengths.count(n) and x["n_tokens"] == n * lengths.count(n)
        assert x["docs_within"] == sum(m <= n for m in lengths) and x["docs_over"] == sum(m > n for m in lengths)
        assert x["tokens_over"] == sum(m for m in lengths if m > n)
        assert x["truncated_total"] == sum(min(m, n) for m in lengths)
    for limit in (0, 3, 100, 4096, 10**6):
        assert t.truncated_total(limits, limit) == sum(min(m, limit) for m in lengths)
    for q in (0.0, 0.5, 0.9, 1.0):
        assert t.quantile(limits, q) == min(n for n in lengths if sum(m <= n for m in lengths) >= q * len(lengths))


def test_empty(spark):
    limits = t.context_limits(t.histogram(spark.createDataFrame([], "length int")))
    assert limits.count() == 0 and t.quantile(limits, 0.5) is None and t.truncated_total(limits, 5) == 0


def test_lengths_of_texts_against_the_library(spark):
    """Null, empty, repeated and very long texts, and a column of a clashing name."""
    path = "/opt/tokenizers/piece_bpe_32k.model"
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [None, "", "one two", "one two", "日本語 😀", "word " * 60_000, "x" * 30_000]
    docs = spark.createDataFrame([(x, 1) for x in texts], "text string, length int")
    got = [r["length"] for r in encoded_lengths(docs, load(path)).collect()]
    assert sorted(got) == sorted(len(library.encode(x or "")) for x in texts)
    limits = {r["context_limit"]: r["n_docs"] for r in t.context_limits(t.histogram(encoded_lengths(docs, load(path)))).collect()}
    assert limits[0] == 2 and sum(limits.values()) == len(texts)
