"""Positions, running sums and pages over whole tables, hubs included."""

import random

from pyspark.sql import functions as F

from quillgraph.operators import adjacency, context, order


def rows_of(spark, n=5000):
    r = random.Random(1)
    rows = [(r.choice("aab"), r.randrange(50), i, r.randrange(9)) for i in range(n)] + [("z", 1, 1, 1)] * 40 + [(None, None, 7, None)]
    return rows, spark.createDataFrame(rows, "a string, b int, c int, w int")


def key(row):
    return (row[0] is not None, row[0] or "", -(row[1] if row[1] is not None else -1000))


def test_positions_in_a_composite_order(spark):
    rows, df = rows_of(spark)
    got = order.numbered(df, ["a", F.desc("b")], "at").collect()
    assert sorted(r["at"] for r in got) == list(range(len(rows)))
    placed = [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["at"])]
    assert placed == [(x[0], x[1]) for x in sorted(rows, key=key)]
    assert order.numbered(df.limit(0), ["a"]).count() == 0


def test_running_sums(spark):
    rows, df = rows_of(spark)
    got = order.running(df, ["a", F.desc("b"), "c"], "w", "before").collect()
    total, want = 0, []
    for a, b, c, w in sorted(rows, key=lambda x: (*key(x), x[2])):
        want.append((a, b, c, total))
        total += w or 0
    assert sorted([(r["a"], r["b"], r["c"], r["before"]) for r in got], key=str) == sorted(want, key=str)


def test_ranks_within_a_key_that_holds_most_rows(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 50 == 0, F.col("id")).otherwise(-1).alias("k"), (F.col("id") * 7 % 20000).alias("v"))
    got = order.ranked(df, ["k"], ["v"], "rank")
    hot = [r["rank"] for r in got.filter("k = -1").orderBy("v").collect()]
    assert hot == list(range(19600)) and got.filter("k <> -1").agg(F.max("rank")).first()[0] == 0
    assert context.chunks(df, ["v"], 12, within=["k"]).filter("k = -1").agg(F.max("chunk")).first()[0] == 19599 // 12


def test_no_task_numbers_all_rows(spark):
    df = spark.range(100000).select((F.col("id") * 7919 % 100000).alias("v"))
    dealt = order._dealt(df, ["v"], 8)
    sizes = [r["count"] for r in dealt.groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 3 * 100000 / 8


def test_pages_of_a_hub(spark):
    pairs = spark.range(30000).select(F.when(F.col("id") < 29000, "hub").otherwise(F.concat(F.lit("n"), F.col("id") % 10)).alias("dst"), F.format_string("s%05d", "id").alias("src"), F.lit(True).alias("resolved"))
    pairs = pairs.unionByName(pairs.limit(100)).unionByName(spark.createDataFrame([(None, "x", True), ("y", None, True), ("z", "x", False)], "dst string, src string, resolved boolean"))
    found = adjacency.backlink_pages(pairs, 1000).cache()
    hub = found.filter("uid = 'hub'").orderBy("page").collect()
    assert [r["page"] for r in hub] == list(range(29)) and {len(r["sources"]) for r in hub} == {1000} and {r["total"] for r in hub} == {29000}
    assert [s for r in hub for s in r["sources"]] == [f"s{i:05d}" for i in range(29000)]
    assert found.filter("uid <> 'hub'").count() == 10 and adjacency.page_of(found, "uid", "n3", 0)[0] == "s29003" and adjacency.page_of(found, "uid", "n3", 1) == []
