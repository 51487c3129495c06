"""PartEnum groups against all pairs, the signatures' promise, and bounds that may lose no link."""

import random

import numpy as np
import pytest

from quillgraph.llm import partenum as p


def brute_set(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows):
    sets = [brute_set(t) for t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {i: (len(sets[i]), root[i]) for i in range(len(rows))}


def table(seed=3):
    r, out = random.Random(seed), []
    line = " ".join(f"common{i}" for i in range(60))
    for _ in range(60):
        words = [f"w{r.randrange(300)}" for _ in range(r.choice([1, 3, 5, 6, 9, 14, 40, 150, 300]))]
        if r.random() < 0.3:
            words = line.split() + words
        out.append(" ".join(words))
        for _ in range(r.choice([0, 1, 4])):
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = f"x{r.randrange(300)}"
            if r.random() < 0.3:
                words = words[r.randrange(1 + len(words) // 8):]
            out.append(" ".join(words))
    base = [f"b{i}" for i in range(120)]
    for _ in range(60):  # a crowd of near copies
        copy = list(base)
        for _ in range(r.randrange(5)):
            copy[r.randrange(len(copy))] = f"y{r.randrange(1000)}"
        out.append(" ".join(copy))
    return [*out, None, "", " \t", out[0].upper(), "a a a a a", "a a a a a a a", "x" * 50000]


def as_dict(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


@pytest.mark.parametrize("block,leaders", [(128, 4), (3, 1)])
def test_groups_match_brute_force(spark, monkeypatch, block, leaders):
    monkeypatch.setattr(p, "LEADERS", leaders)
    rows = table()
    docs = spark.createDataFrame([(i, t, 1, "r") for i, t in enumerate(rows)], "doc_id long, text string, node int, run string")
    assert as_dict(p.jaccard_groups(docs, block=block)) == brute(rows)


def test_rows_that_share_ids_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(4, text), (4, text), (4, "other words altogether"), (None, text), (None, ""), (2, text + " more"), (9, None)]
    got = p.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(4, 26, 2), (4, 26, 2), (4, 1, 4), (None, 26, 2), (None, 0, None), (2, 27, 2), (9, 0, 9)]))
    assert p.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("sets", [10, 10**5, 10**9])
def test_linked_sets_share_a_signature(sets):
    r, bands = np.random.default_rng(1), p.Bands()
    for n in [1, 2, 4, 5, 8, 9, 13, 40, 200, 900]:
        for _ in range(15):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
            cut, added = r.integers(0, n // 9 + 1), r.integers(0, n // 9 + 1)
            b = np.unique(np.concatenate((a[cut:], r.integers(0, 1 << 63, added).astype(np.uint64))))
            if not p.links(a, b, 4, 5):
                continue
            lower, upper = sorted((bands.of(len(a)), bands.of(len(b))))
            assert upper - lower <= 1
            plan = bands.plan(upper, sets)
            assert (plan.parts - plan.spare) * (plan.left_out + 1) > bands.differences(upper)
            assert set(p.signatures(a, upper, plan).tolist()) & set(p.signatures(b, upper, plan).tolist())
            assert p.apart(p.odd_sketch(a), p.odd_sketch(b)) <= len(np.setxor1d(a, b))


def test_larger_tables_take_choosier_signatures():
    bands = p.Bands()
    plans = [bands.plan(20, n) for n in (10, 10**9, 10**12)]
    share = [(x.cells - x.left_out) / x.cells / x.parts for x in plans]
    assert share == sorted(share) and share[0] < share[-1] and plans[-1].left_out > 0


def test_most_sets_give_no_empty_projections():
    r, bands = np.random.default_rng(2), p.Bands()
    for n in (60, 300, 2000):
        band = bands.of(n)
        plan = bands.plan(band, 1000)
        nothing = set(p.signatures(np.zeros(0, np.uint64), band, plan).tolist())
        assert len(nothing) == plan.signatures()  # a set of nothing has more empty parts than there are spare ones
        given = [len(nothing & set(p.signatures(np.unique(r.integers(0, 1 << 63, n).astype(np.uint64)), band, plan).tolist())) > 0 for _ in range(200)]
        assert sum(given) < 20


def test_shingles_tell_sequences_apart():
    s = p.Shingler(5)
    texts = [b"a b c d e", b"b a c d e", b"a b c d", b"ab c d e", b"a b c d e f"]
    assert len({s(t).tobytes() for t in texts}) == len(texts)
    assert len(s(b"")) == 0 and len(s(b"a b c d e f")) == 2 and s(b"a b c d e")[0] in s(b"z a b c d e")
