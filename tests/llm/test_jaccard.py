import random

import corpus_pipeline
from quillgraph.llm import jaccard as j
from tests.llm.test_simhash import brute_components, brute_fingerprint


def brute_set(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))}


def roots(sets, least=0.8):
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for k in range(i):
            if len(sets[i] & sets[k]) >= least * len(sets[i] | sets[k]):
                a, b = root[i], root[k]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def table():
    r, out = random.Random(3), []
    for _ in range(40):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice([3, 40, 150, 300]))]
        out.append(" ".join(words))
        for _ in range(r.choice([0, 1, 4])):
            for _ in range(r.randrange(5)):
                words[r.randrange(len(words))] = f"x{r.randrange(5000)}"
            out.append(" ".join(words))
    return [*out, None, "", " ", out[0].upper()]


def test_components_match_brute_force(spark):
    rows = table()
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = roots([brute_set(t) for t in rows])
    for block in (128, 3):
        got = {r["doc_id"]: r["component_id"] for r in j.similar_groups(docs, block=block).collect()}
        assert [got[i] for i in range(len(rows))] == want
    assert j.similar_groups(docs.limit(0)).count() == 0


def test_the_stage_drops_near_copies_that_four_bits_miss(spark):
    rows = table()
    docs = spark.createDataFrame([*enumerate(rows), (None, rows[3])], "doc_id long, text string")
    sets = [brute_set(t) for t in rows]
    want = roots(sets)
    assert len(set(brute_components([brute_fingerprint(t) for t in rows]))) > len(set(want))
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "").collect()}
    assert {*want, None} <= kept
    kept = sorted(kept - {None})
    assert roots([sets[i] for i in kept]) == list(range(len(kept)))
