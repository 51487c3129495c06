import math
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import toxicity as t

BAD = ["grok", "flimp", "snarl"]


def rows(n=900):
    r = random.Random(4)
    out = []
    for i in range(n):
        words = ["".join(r.choice("abcdelmnorst") for _ in range(r.randint(1, 6))) for _ in range(r.randint(5, 120))]
        if i % 7 == 0:
            for _ in range(r.randint(1, 3)):
                words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", ".", "***"]))
        out.append((i, " ".join(words).capitalize()))
    return out


def test_features_of_a_text():
    assert len(t.features(b"")) == 0 and len(t.features(b"one")) == 1 and len(t.features(b"one two")) == 3 and len(t.features(b"one two three")) == 6
    assert (t.features(b"one two. *three*") == t.features(b"one two three")).all()
    assert set(t.features(b"a b c d e", skips=False)) < set(t.features(b"a b c d e"))


def test_held_out_recall_and_sparsity(spark):
    data = rows()
    docs = spark.createDataFrame([(*x, 1) for x in [*data, (9000, None), (9001, ""), (None, "grok"), (9002, "calm " * 100_000)]], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i, _ in data] + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = t.train(docs, labels, F.col("doc_id") % 3 != 1)
    assert 0 < len(model.weights) < 400
    got = {x["doc_id"]: x["score"] for x in t.scores(docs, model).collect()}
    held = [i for i, _ in data if i % 3 == 1]
    assert np.mean([got[i] >= 0.7 for i in held if i % 7 == 0]) > 0.9
    assert np.mean([got[i] < 0.7 for i in held if i % 7]) > 0.98
    assert got[9000] == got[9001] < 0.5 and len(got) == len(data) + 4 and all(0 <= s <= 1 for s in got.values())


def test_empty_tables_and_one_label(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {x["score"] for x in t.scores(docs, t.train(docs, none, F.lit(True))).collect()} == {0.5}
    same = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(x["score"] < 0.3 for x in t.scores(docs, t.train(docs, same, F.lit(True))).collect())
    assert t.scores(docs.limit(0), t.fit([], [])).count() == 0


def brute_features(text):
    """The features' coordinates, one word, pair and skip-gram at a time."""
    top, out = 64 - t.SPACE_BITS, set()
    h = [crc32(w.strip(t._EDGE)) for w in text.split()]
    for i, x in enumerate(h):
        out.add((x * 0xFF51AFD7ED558CCD) % 2**64 >> top)
        if i + 1 < len(h):
            out.add(((x * 0x9E3779B97F4A7C15) % 2**64 ^ ((h[i + 1] + 1) * 0x165667B19E3779F9) % 2**64) >> top)
        if i + 2 < len(h):
            out.add(((x * 0xC2B2AE3D27D4EB4F) % 2**64 ^ ((h[i + 2] + 2) * 0x27D4EB2F165667C5) % 2**64) >> top)
    return sorted(out)


def test_features_and_updates_match_a_plain_version():
    """FTRL-proximal coordinate by coordinate in dictionaries, as it is published."""
    data = rows(40)
    found = [t.features(x.lower().encode()) for _, x in data]
    assert [f.tolist() for f in found] == [brute_features(x.lower().encode()) for _, x in data]
    labels, alpha, beta, l1, l2, weight = [int(i % 7 == 0) for i, _ in data], 3.0, 1.0, 0.5, 0.02, 10.0
    model = t.fit(found, labels, epochs=2, l1=l1, least_rows=1)
    z, n, order = defaultdict(float), defaultdict(float), np.random.default_rng(3)

    def weigh(i):
        rate = (beta + n[i] ** 0.5) / alpha + l2
        if i == "bias":
            return -z[i] / rate
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / rate

    for _ in range(2):
        for j in order.permutation(len(labels)):
            at = [*found[j].tolist(), "bias"]
            w = {i: weigh(i) for i in at}
            g = (1 / (1 + math.exp(-sum(w.values()))) - labels[j]) * (weight if labels[j] else 1.0)
            for i in at:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    want = {i: weigh(i) for i in z if i != "bias" and weigh(i)}
    assert dict(zip(model.coords.tolist(), model.weights.tolist())) == pytest.approx(want, rel=1e-4, abs=1e-6)
    assert model.bias == pytest.approx(weigh("bias"), rel=1e-6)
    for f in found:
        assert t.logit(model, f) == pytest.approx(weigh("bias") + sum(want.get(i, 0.0) for i in f.tolist()), rel=1e-4, abs=1e-5)


def test_few_labels_choose_a_smaller_penalty(spark):
    """Within the learning rows; rows that repeat get equal scores."""
    data = rows(160)
    docs = spark.createDataFrame([*data, data[0], data[0]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 7 == 0)) for i, _ in data], "doc_id long, toxic int")
    model = t.train(docs, labels, F.lit(True))
    got = [(x["doc_id"], x["score"]) for x in t.scores(docs, model).collect()]
    assert len(got) == len(data) + 2 and len({s for i, s in got if i == data[0][0]}) == 1
    assert np.mean([s >= 0.7 for i, s in got if i % 7 == 0]) > 0.8 and np.mean([s >= 0.7 for i, s in got if i % 7]) < 0.05
