import random

import numpy as np
from pyspark.sql import functions as F

from quillgraph.llm import quality_cnn as q


def text(r, good):
    words = ["".join(r.choice("aeiou" if i % 2 else "bcdlmnrst") for i in range(r.randint(2, 8))) for _ in range(r.randint(5, 200))]
    return (" ".join(words) if good else " ".join(w + r.choice(["###", "&&&", "$$$"]) for w in words)).capitalize()


def test_chunks_cover_every_byte():
    for n in (0, 1, q.CHUNK, q.CHUNK + 1, 1000, 5000):
        body = bytes(random.Random(n).randrange(256) for _ in range(n))
        got, firsts = q.chunks([body, b"x"])
        seen = bytearray(n)
        for i, chunk in enumerate(got[:firsts[1]]):
            part = chunk[chunk != q.PAD]
            seen[i * q.STRIDE:i * q.STRIDE + len(part)] = part.astype(np.uint8).tobytes()
        assert bytes(seen) == body


def test_gradients_match_finite_differences():
    r = random.Random(1)
    bodies, labels = [text(r, i % 2).encode() for i in range(6)], np.array([i % 2 for i in range(6)], np.float32)
    net = q.start(3)
    loss = lambda: -np.mean(np.log(np.where(labels == 1, q.score(net, bodies), 1 - q.score(net, bodies))))
    for a, g in zip(net.arrays(), q._gradients(net, bodies, labels)):
        assert a.shape == g.shape
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept, step = a[at], 3e-3
        a[at] = kept + step
        up = loss()
        a[at] = kept - step
        down = loss()
        a[at] = kept
        assert abs((up - down) / (2 * step) - g[at]) < 0.05 * abs(g[at]) + 1e-3


def test_held_out_accuracy_and_odd_rows(spark):
    r = random.Random(2)
    rows = [(i, text(r, i % 3 > 0), "x") for i in range(400)]
    docs = spark.createDataFrame([*rows, (1000, None, "x"), (1001, "", "x"), (None, "word", "x"), (5, rows[5][1], "x"), (1002, "w " * 200_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(400)] + [(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    net = q.train(docs, labels, F.col("doc_id") % 4 != 2, epochs=4)
    got = {x["doc_id"]: x["score"] for x in q.scores(docs, net).collect()}
    held = [i for i in range(400) if i % 4 == 2]
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == 404 and q.scores(docs, net).count() == 405
    kept = q.drop_low_quality(docs, net)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == {i for i, s in got.items() if s >= 0.5}


def test_empty_tables_and_one_label(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {x["score"] for x in q.scores(docs, q.train(docs, none, F.lit(True))).collect()} == {0.5}
    same = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(x["score"] > 0.7 for x in q.scores(docs, q.train(docs, same, F.lit(True))).collect())
    assert q.scores(docs.limit(0), q.start()).count() == 0


def naive_score(net, body):
    """The forward pass one window, filter and feature at a time."""
    filters = net.conv.reshape(q.HOP * q.EMBED, q.TAPS, q.FILTERS).astype(float)
    starts = [0]
    while starts[-1] + q.CHUNK < len(body):
        starts.append(starts[-1] + q.STRIDE)
    tops = []
    for a in starts:
        values = list(body[a:a + q.CHUNK]) + [q.PAD] * (q.CHUNK - len(body[a:a + q.CHUNK]))
        best = [-np.inf] * q.FILTERS
        for at in range(0, q.CHUNK - q.HOP * q.TAPS + 1, q.HOP):
            window = net.embed[values[at:at + q.HOP * q.TAPS]].astype(float).reshape(q.TAPS, q.HOP * q.EMBED)
            for f in range(q.FILTERS):
                best[f] = max(best[f], sum(float(window[tap] @ filters[:, tap, f]) for tap in range(q.TAPS)))
        tops.append([max(0.0, b + float(c)) for b, c in zip(best, net.bias)])
    columns = list(zip(*tops))
    features = [max(c) for c in columns] + [sum(c) / len(c) for c in columns] + [min(c) for c in columns] + [min(len(body) / q.CHUNK, 1), np.log1p(len(body)) / 10]
    hidden = np.maximum(np.array(features) @ net.dense + net.dense_bias, 0)
    return 1 / (1 + np.exp(-float(hidden @ net.head + net.head_bias[0])))


def test_forward_pass_matches_a_naive_convolution():
    r = random.Random(6)
    net = q.start(9)
    net.bias += np.linspace(-0.3, 0.3, q.FILTERS).astype(np.float32)
    bodies = [b"", b"x", text(r, True).encode()[:300], "日本 é text".encode() * 40]
    assert np.allclose(q.score(net, bodies), [naive_score(net, b) for b in bodies], atol=1e-4)
