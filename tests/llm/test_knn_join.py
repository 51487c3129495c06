import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm.knn_join import top_k


def brute(rows, k):
    ok = {i: [math.floor(256 * c) for c in v] for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)}
    out = set()
    for q in (i for i in ok if i % 5 == 0):
        scored = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("clustered,pivots,block", [(True, 16, 40), (False, 8, 8192), (True, 1, 7)])
def test_matches_brute_force(spark, clustered, pivots, block):
    r = np.random.default_rng(pivots)
    middles = r.standard_normal((6, 8)) * (5 if clustered else 0)
    rows = [(i, (middles[i % 6] + r.standard_normal(8) * 0.2).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 420)]  # one very common vector: ties
    rows += [(500, None), (505, [1.0, None] + [0.0] * 6), (510, [float("nan")] * 8), (515, [float("inf")] * 8), (None, [1.0] * 8), (520, []), (525, [1.0, 2.0])]
    df = spark.createDataFrame([(*x, "c") for x in rows], "vec_id long, embedding array<double>, cell string")
    told = {}
    got = top_k(df, F.col("vec_id") % 5 == 0, most_pivots=pivots, block=block, queries_per_group=20, told=told)
    assert told["copies"] > 0 and (told["needed"] < 0.5 if clustered and pivots > 1 else told["needed"] <= 1)
    assert {tuple(x) for x in got.select("query_id", "rank", "vec_id", "score").collect()} == brute(rows, 5)


def test_few_rows_and_large_values(spark):
    df = spark.createDataFrame([(0, [1e6, -1e6]), (5, [1e6, 1e6]), (7, [-1e6, 3.0])], "vec_id long, embedding array<double>")
    got = {tuple(x) for x in top_k(df, F.col("vec_id") % 5 == 0).select("query_id", "rank", "vec_id").collect()}
    assert got == {(0, 1, 5), (0, 2, 7), (5, 1, 0), (5, 2, 7)}
    twice = df.unionByName(df)
    assert {tuple(x) for x in top_k(twice, F.col("vec_id") % 5 == 0).select("query_id", "rank", "vec_id").collect()} == got
    assert top_k(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    assert top_k(df.filter("vec_id = 0"), F.col("vec_id") % 5 == 0).count() == 0


def test_zero_queries_and_few_rows(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (5, []), (7, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = {tuple(x) for x in top_k(df, F.col("vec_id") % 5 == 0).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == {(0, 1, 5, 0), (0, 2, 7, 0), (5, 1, 0, 0), (5, 2, 7, 0)}
