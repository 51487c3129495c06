from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import mixing as m

NAMES = ["a", "b", "c"]
WORDS = {"a": "alpha apple arch", "b": "beta bread brick", "c": "gamma grape ghost"}


def table(spark, n=300):
    rows = [(i, " ".join([WORDS[NAMES[i % 7 % 3]]] * (1 + i % 5)), i % 4) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None, 0), (n + 1, "", 0), (None, "beta bread", 0), (n + 2, "apple " * 20_000, 1)], "doc_id long, text string, p int")


def model(spark, docs):
    labelled = spark.createDataFrame([(i, NAMES[i % 7 % 3]) for i in range(0, 300, 2)] + [(5, None), (None, "a"), (7, "zz")], "doc_id long, domain string")
    return m.train(docs, labelled, NAMES)


def test_posteriors_and_expected_totals(spark):
    docs = table(spark)
    fitted = model(spark, docs)
    drawn = m.rates(docs, fitted, {"a": 0.2, "b": 0.5, "c": 0.3}).cache()
    rows = drawn.collect()
    assert len(rows) == docs.count()
    p = {r["doc_id"]: [r[f"p_{n}"] for n in NAMES] for r in rows}
    assert np.mean([int(np.argmax(p[i])) == i % 7 % 3 for i in range(1, 300, 2)]) > 0.95
    got = np.array([sum(r["tokens"] * r[f"p_{n}"] * r["rate"] for r in rows) for n in NAMES])
    assert got / got.sum() == pytest.approx([0.2, 0.5, 0.3], abs=0.01)
    assert all(r["rate"] >= 0 and r["copies"] in (int(r["rate"]), int(r["rate"]) + 1) for r in rows)
    out = m.mixed(docs, fitted, {"a": 0.2, "b": 0.5, "c": 0.3})
    assert out.columns == docs.columns
    want = Counter({r["doc_id"]: r["copies"] for r in rows if r["doc_id"] is not None}) + Counter([None])
    assert Counter(r["doc_id"] for r in out.collect()) == want and max(want.values()) > 1


def test_targets_that_raise_and_clear_domains_are_met(spark):
    docs = table(spark)
    fitted = model(spark, docs)
    for weights in ({"a": 0.05, "b": 0.15, "c": 0.8}, {"a": 0.5, "b": 0.5}, {"b": 1.0}):  # the last two as near as posteriors let them
        rows = m.rates(docs, fitted, weights).collect()
        got = np.array([sum(r["tokens"] * r[f"p_{n}"] * r["rate"] for r in rows) for n in NAMES])
        assert got / got.sum() == pytest.approx([weights.get(n, 0.0) for n in NAMES], abs=0.01)


def members(spark, rows=50, seed=1):
    r = np.random.default_rng(seed)
    p, tokens = r.dirichlet([0.3] * 3, rows), r.integers(1, 90, rows)
    return spark.createDataFrame([(i, int(t), x.tolist()) for i, (t, x) in enumerate(zip(tokens, p))], "id long, tokens long, p array<double>"), p, tokens.astype(float)


def test_rates_against_a_dense_solution(spark):
    """One iteration's sums equal those on the whole matrix; the solution meets the targets and is the nearest to one that does."""
    df, p, tokens = members(spark)
    steps = m.Steps([np.array([0.3, -0.2, 0.9]), np.array([-1.5, 0.1, 0.2])], 1.2)
    rate = np.ones(50)
    for push in steps.pushes:
        wanted = rate - p @ push
        rate = np.minimum(1.2, np.maximum(0, wanted))
    got, gram = m.totals(df, steps, 3)
    free = rate == wanted
    assert got == pytest.approx((tokens * rate) @ p) and gram == pytest.approx((p[free] * tokens[free, None]).T @ p[free])
    shares = (tokens @ p) / tokens.sum() * [1.2, 0.9, 1.0]  # no bound is met: the least change is in the span of p
    shares /= shares.sum()
    budget = tokens.sum()
    rate, _ = m.solve(df, shares, budget, tolerance=1e-9).replay(p)
    lagrange = np.linalg.solve((p * tokens[:, None]).T @ p, shares * budget - tokens @ p)
    assert rate == pytest.approx(1 + p @ lagrange)


@pytest.mark.parametrize("seed", range(6))
def test_random_targets_are_met_under_a_bound(spark, seed):
    df, p, tokens = members(spark, 200, seed)
    shares = np.random.default_rng(seed).dirichlet([2.0] * 3)
    rate, _ = m.solve(df, shares, most=1.0).replay(p)
    got, masses, heavy = (tokens * rate) @ p, tokens @ p, int(shares.argmax())
    targets = shares * got[heavy] / shares[heavy]
    assert rate.min() >= 0 and rate.max() <= 1 and np.abs(got - targets)[masses >= targets].max() <= 1.1e-3 * masses.max()


def nearest(p, tokens, target, most, steps=6000):
    """The least squared error of totals, by accelerated projected gradient with restarts."""
    rate = ahead = np.ones(len(p))
    best, a = np.inf, 1.0
    length = np.linalg.eigvalsh((p * tokens[:, None]).T @ p).max()
    for _ in range(steps):
        then = np.clip(ahead - p @ ((tokens * ahead) @ p - target) / length, 0, most)
        best = min(best, (((tokens * then) @ p - target) ** 2).sum())
        b = (1 + np.sqrt(1 + 4 * a * a)) / 2
        ahead, a = (then, 1.0) if (ahead - then) @ (then - rate) > 0 else (then + (a - 1) / b * (then - rate), b)
        rate = then
    return best


@pytest.mark.parametrize("seed", range(5))
def test_random_problems_end_at_the_least_squares(monkeypatch, seed):
    """Sixty random problems a seed, attainable or not, with and without a bound, their sums taken in memory."""
    r = np.random.default_rng(seed)

    def sums(rows, steps, k):
        p, tokens = rows
        rate, free = steps.replay(p)
        wanted = 1 - sum((p @ push for push in steps.pushes), np.zeros(len(p)))
        return (tokens * rate) @ p, (p[free] * tokens[free, None]).T @ p[free], float(tokens @ (rate * wanted - rate * rate / 2))

    monkeypatch.setattr(m, "_sums", sums)
    for i in range(60):
        n, k = int(r.integers(5, 150)), int(r.integers(2, 5))
        p, tokens, shares = r.dirichlet([r.choice([0.1, 0.3, 1.0])] * k, n), r.integers(1, 900, n).astype(float), r.dirichlet([r.choice([0.5, 2.0])] * k)
        most, budget = [(np.inf, None), (r.choice([1.0, 2.0]), tokens.sum() * r.choice([0.3, 0.8, 1.5]))][i % 2]
        with m.warnings.catch_warnings(record=True) as said:
            m.warnings.simplefilter("always")
            rate, _ = m.solve((p, tokens), shares, budget, most).replay(p)
        got, masses = (tokens * rate) @ p, tokens @ p
        target = shares * (budget or masses[shares.argmax()] / shares.max())
        error, least = ((got - target) ** 2).sum(), nearest(p, tokens, target, most)
        assert error <= 1.01 * least + 1e-10 * tokens.sum() ** 2
        assert bool(said) == bool((np.abs(got - target) > 1e-3 * max(target.max(), masses.max())).any())


def test_rates_name_what_is_off(spark):
    docs = table(spark)
    fitted = model(spark, docs)
    for weights, met in (({"a": 0.2, "b": 0.5, "c": 0.3}, True), ({"b": 1.0}, False)):
        rows = m.rates(docs, fitted, weights).collect()
        whole = sum(r["tokens"] for r in rows)
        off = {n: {r[f"off_{n}"] for r in rows} for n in NAMES}
        assert all(len(x) == 1 for x in off.values()) and (max(abs(x.pop()) for x in off.values()) < 1e-4 * whole) == met


def test_empty_tables(spark):
    docs = table(spark).limit(0)
    fitted = m.train(docs, spark.createDataFrame([], "doc_id long, domain string"), NAMES)
    assert m.rates(docs, fitted, {"a": 1.0}).count() == 0
    assert m.mixed(docs, fitted, {"a": 1.0}).count() == 0
    even = m.rates(table(spark), fitted, {"a": 1.0, "b": 1.0, "c": 1.0})
    assert even.filter(F.abs(F.col("p_a") - 1 / 3) > 1e-6).count() == 0


def test_stage_learns_from_the_whole_table_and_no_rate_is_cut(spark, tmp_path, monkeypatch):
    """No labelled junk is left by the stages before; prose stays and toxic rows are thinned to their share."""
    import corpus_pipeline

    words = {"prose": "river stone field walks", "junk": "### *** %%% @@@", "toxic": "idiot moron stupid fool"}
    kinds = [("prose", "junk", "toxic")[0 if i % 10 < 6 else 1 if i % 10 < 8 else 2] for i in range(400)]
    docs = spark.createDataFrame([(i, " ".join([words[k]] * (2 + i % 3))) for i, k in enumerate(kinds)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(k != "junk"), int(k == "toxic")) for i, k in enumerate(kinds)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = docs.filter(~F.col("doc_id").isin([i for i, k in enumerate(kinds) if k == "junk"]))
    kept = corpus_pipeline.mix(spark, left, str(tmp_path)).collect()
    assert len(kept) == len({r["doc_id"] for r in kept})
    fitted = m.train(docs, spark.createDataFrame([(i, k) for i, k in enumerate(kinds)], "doc_id long, domain string"), list(words))
    drawn = m.rates(left, fitted, corpus_pipeline.WEIGHTS, most=1.0).collect()
    assert all(r["rate"] <= 1 and r["copies"] <= 1 for r in drawn)
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in drawn if r["copies"]}
    got = {n: sum(r["tokens"] * r[f"p_{n}"] * r["rate"] for r in drawn) for n in words}
    assert got["toxic"] / got["prose"] == pytest.approx(0.05 / 0.93, rel=0.02)
    assert sum(kinds[r["doc_id"]] == "prose" for r in kept) >= 0.98 * kinds.count("prose")


def test_unmet_targets_are_reported(spark):
    df = spark.createDataFrame([(1, 10, [1.0, 0.0]), (2, 10, [1.0, 0.0])], "id long, tokens long, p array<double>")
    with pytest.warns(RuntimeWarning, match="not met"):
        m.solve(df, np.array([0.5, 0.5]), 20.0)
