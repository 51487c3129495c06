import math
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import lm_score
from quillgraph.llm.common import remainder

WORDS = ["the", "cat", "sat", "on", "mat", "Dog"]


def rows():
    out = [(i, " ".join(WORDS[(i * 7 + j * j) % 6] for j in range(3 + i % 9))) for i in range(60)]
    return [*out, (100, None), (101, ""), (102, "never seen words here"), (103, "the CAT\x0bsat " * 3000), (None, "the cat")]


def tokens(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split() + [b"\n"]


def test_base_scores_match_brute_force_and_model_does_better(spark):
    docs = spark.createDataFrame([(*x, 1) for x in rows()], "doc_id long, text string, n long")
    got = {r["doc_id"]: r for r in lm_score.lm_scores(docs, remainder("doc_id", 5) != 1).collect()}
    counts = Counter()
    for i, text in rows():
        if crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            counts.update(tokens(text))
    total, distinct = sum(counts.values()), len(counts)
    assert len(got) == len(rows())
    for i, text in rows():
        t = tokens(text)
        assert got[i]["n_tokens"] == len(t) and got[i]["train_tokens"] == total
        assert got[i]["n_known"] == sum(counts[w] > 0 for w in t)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in t))
        assert got[i]["score"] < 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def whole_chunk(texts, order):
    """One chunk of all texts with the counts of a corpus of just these texts."""
    grams, sizes = Counter(), [len(t) for t in texts]
    index = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    c = lm_score._Chunk({
        "words": np.array([lm_score.xxhash.xxh64_intdigest(w) for w in index], np.uint64).tobytes(), "codes": lm_score._pack(np.array([index[w] for t in texts for w in t])),
        "sizes": sizes, "skips": [0] * len(texts), "learn": [True] * len(texts), "chunk": 0})
    for t in texts:
        grams.update(tuple(t[i:i + k]) for k in range(1, order + 1) for i in range(len(t) - k + 1))
    for k in range(1, order + 1):
        if k > 1:
            c.grow(k)
        c.n[k] = c.counts(k)
    for k in range(1, order):
        c.arcs[k] = c.own(k)
    return c, index, grams


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_every_state_sums_to_one(order):
    c, index, grams = whole_chunk([tokens(x) for _, x in rows()], order)
    total = sum(n for g, n in grams.items() if len(g) == 1)
    norm = total + 0.5 * (len(index) + 1)
    model = lm_score.Automaton(c, order, norm)
    assert len(model.fail) == 1 + sum(n >= 2 for g, n in grams.items() if len(g) < order)
    words = np.arange(len(index))
    for state in model.met.tolist():
        whole = 10 ** model.step(np.full(len(words), state), words)[1]
        rest, s = 0.5 / norm, state
        while s:
            rest *= 10 ** model.back[s]
            s = model.fail[s]
        assert whole.sum() + rest == pytest.approx(1)


def test_traversal_carries_the_longest_context_and_stretches_change_nothing():
    texts = [tokens(x) for _, x in rows()]
    c, index, _ = whole_chunk(texts, 3)
    model = lm_score.Automaton(c, 3, 1000.0)
    whole = model.traverse(c.codes, c.starts, c.sizes, most=1 << 20)
    for most in (1, 2, 3, 7):
        assert model.traverse(c.codes, c.starts, c.sizes, most) == pytest.approx(whole)
    one, states = [], 0
    for start, size in zip(c.starts, c.sizes):
        state = np.zeros(1, np.int64)
        for i in range(start, start + size):
            state, score = model.step(state, c.codes[i:i + 1])
            one.append(score[0])
            states += state[0] > len(index)
    assert one == pytest.approx(whole) and states > 1000  # contexts of two tokens are met


def test_empty_tables_and_no_learning_rows(spark):
    docs = spark.createDataFrame(rows()[:5], "doc_id long, text string")
    assert lm_score.lm_scores(docs.limit(0), F.lit(True)).count() == 0
    assert {r["score"] for r in lm_score.lm_scores(docs, F.lit(False)).collect()} == {0.0}


def test_all_ngrams_that_occur_twice_count_whatever_the_corpus(spark):
    """As by a dictionary model; a passage that is rare in a larger corpus is no row of single words."""
    passage = " ".join(f"rare{i}" for i in range(30))
    filler = [(1000 + i, " ".join(f"w{(i * 31 + j * j * 7) % 997}" for j in range(500))) for i in range(80)]
    docs = spark.createDataFrame([*rows(), *filler, (200, passage), (201, passage), (202, "held out " + passage)], "doc_id long, text string")
    learning = F.coalesce(F.col("doc_id"), F.lit(0)) != 202
    got = {r["doc_id"]: r for r in lm_score.lm_scores(docs, learning).collect()}
    texts = {r["doc_id"]: tokens(r["text"]) for r in docs.collect()}
    want = brute_scores(list(texts.values()), [i != 202 for i in texts], 3)
    for i, p in zip(texts, want):
        assert got[i]["score"] == pytest.approx(p, rel=1e-9)
    assert got[202]["score"] > got[202]["base_score"] + 60


def test_long_texts_are_cut_without_loss(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string")
    coded = lm_score.code_texts(docs, F.lit(True), 3, "doc_id", "text", most=7).collect()
    assert sum(r["learnt"] for r in coded) == sum(len(tokens(t)) for _, t in rows())
    grams = Counter()
    for r in coded:
        c = lm_score._Chunk(r.asDict())
        for k in (1, 2, 3):
            if k > 1:
                c.n[k - 1] = np.full(len(c.hashes[k - 1]), 2)
                c.grow(k)
            grams.update(dict(zip(c.hashes[k].tolist(), c.counts(k).tolist())))
    want = Counter(tuple(t[i:i + k]) for t in (tokens(x) for _, x in rows()) for k in (1, 2, 3) for i in range(len(t) - k + 1))
    assert sorted(n for n in grams.values() if n) == sorted(want.values())


def brute_scores(texts, learn, order, discount=0.75):
    """A dictionary backoff model: log10 of every text's probability."""
    n = Counter(tuple(t[i:i + k]) for t, l in zip(texts, learn) if l for k in range(1, order + 1) for i in range(len(t) - k + 1))
    total, distinct = sum(c for g, c in n.items() if len(g) == 1), sum(len(g) == 1 for g in n)
    kept = Counter()
    for g, c in n.items():
        if len(g) > 1 and c >= 2:
            kept[g[:-1]] += c - discount

    def p(context, w):
        if not context:
            return (n[w,] + 0.5) / (total + 0.5 * (distinct + 1))
        lower = p(context[1:], w)
        if n[context] < 2:
            return lower
        c = n[*context, w]
        return max(c - discount, 0) * (c >= 2) / n[context] + max(1e-12, 1 - kept[context] / n[context]) * lower

    return [sum(math.log10(p(tuple(t[max(0, i - order + 1):i]), w)) for i, w in enumerate(t)) for t in texts]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_a_dictionary_backoff_model(spark, order, monkeypatch):
    """On few tokens a chunk and few keys a bucket too; ids repeat, and the table has columns of the operator's own names."""
    every = [*rows(), (7, "the cat sat on the mat"), (7, "the cat sat on the mat")]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in every], "doc_id long, text string, row long, chunk string, n long").repartition(5)
    learning = F.coalesce(F.col("doc_id"), F.lit(0)) % 4 != 1
    monkeypatch.setattr(lm_score, "_KEYS", 50)
    got = lm_score.lm_scores(docs, learning, order).collect()
    texts = [tokens(t) for _, t in every]
    want = brute_scores(texts, [(i or 0) % 4 != 1 for i, _ in every], order)
    key = lambda x: (-1 if x[0] is None else x[0], x[1])
    for (i, p), (j, q) in zip(sorted(((r["doc_id"], r["score"]) for r in got), key=key), sorted(((i, p) for (i, _), p in zip(every, want)), key=key), strict=True):
        assert i == j and p == pytest.approx(q, rel=1e-9)
