import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import simhash as s


def brute_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps, tau=4):
    root = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= tau:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_fingerprint_matches_brute_force_and_sparks_hash(spark):
    for text in ("", " \t\n", "One", "one two Three", "a b c d", "É a B c d e  f\x0bg h", "x " * 500):
        low = text.encode().lower()
        assert s.fingerprint(low, block=7) == brute_fingerprint(text)
    got = spark.range(1).select(F.xxhash64(F.lit("é a"))).first()[0]
    assert got % 2**64 == xxhash.xxh64_intdigest("é a".encode(), 42)


def test_allocation_spends_all_units():
    r = np.random.default_rng(1)
    sample = r.integers(0, 2**63, 500).astype(np.uint64)
    for total in (10, 10**5, 10**8):
        plan = s.allocate(sample, total, 4)
        assert sum(t + 1 for _, t in plan) == 5
        assert len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)


@pytest.mark.parametrize("dense", [1024, 6])
def test_components_of_planted_chains(spark, dense):
    r = random.Random(dense)
    fps = [0, 2**64 - 1]
    for _ in range(25):
        x = r.getrandbits(64)
        fps.append(x)
        for _ in range(r.choice([0, 1, 5, 20])):
            for b in r.sample(range(64), r.randint(0, 5)):
                x ^= 1 << b
            fps.append(x)
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    found = {r_["node"]: r_["root"] for r_ in s.components(s.links(df, 4, dense)).collect()}
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    want = brute_components(fps)
    least = {}
    for x, w in zip(signed, want):
        least[w] = min(x, least.get(w, x))
    assert {x: found.get(x, x) for x in signed} == {x: least[w] for x, w in zip(signed, want)}


def test_groups_of_documents(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (9, base + " tail"), (1, None), (2, ""), (4, " \n"), (8, "alone text"), (None, base), (7, "z" * 200_000)]
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, fp int")
    got = s.near_groups(docs).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["component_id"] == by[2]["component_id"] == by[4]["component_id"] == 1 and by[1]["fingerprint"] == "0" * 16
    assert by[5]["component_id"] == by[3]["component_id"] == by[None]["component_id"] == 3
    assert by[5]["fingerprint"] == f"{brute_fingerprint(base):016x}"
    assert (brute_fingerprint(base) ^ brute_fingerprint(base + " tail")).bit_count() <= 4
    assert by[9]["component_id"] == 3
    left = s.drop_near_copies(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} >= {1, 3, 8, None, 7}
    assert s.near_groups(docs.limit(0)).count() == 0


def test_rows_that_share_an_id_stay_together(spark):
    docs = spark.createDataFrame([(3, "one two three four five", 0), (5, "one two three four five", 1), (5, "six seven", 2), (6, "six seven", 3)], "doc_id long, text string, _gone int")
    assert sorted(r["_gone"] for r in s.drop_near_copies(docs).collect()) == [0, 1, 2]


def test_a_value_that_fifty_thousand_fingerprints_share(spark):
    """The rows dealt grow with the members, and the planted links come back."""
    r = np.random.default_rng(4)
    group = list(range(16))
    fps = np.unique(r.integers(0, 2**63, 50_000).astype(np.uint64) & ~np.uint64(0xFFFF) | np.uint64(0xABCD))
    near = fps[:500] ^ (np.uint64(1) << r.integers(16, 64, 500).astype(np.uint64))
    fps = np.unique(np.concatenate([fps, near]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").cache()
    members = df.selectExpr("0 AS part", f"{0xABCD}L AS key", "fp")
    assert s._split(members, [(group, 0)], 4).count() == 5 * len(fps)
    found = {(x["a"], x["b"]) for x in s._dense_links(members, [(group, 0)], 4, 1024).collect()}
    signed = fps.view(np.int64)
    at = {int(x): i for i, x in enumerate(signed)}
    for x in near.view(np.int64).tolist():  # every copy is linked to some fingerprint at most four bits away, by brute force
        close = np.flatnonzero(np.bitwise_count(fps ^ fps[at[x]]) <= 4)
        assert all((min(x, y), max(x, y)) in found for y in signed[close].tolist() if y != x)
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 4 for a, b in found)
