import json

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import context, graph
from quillgraph.plans import pipelines
from quillgraph.sources import news, sinks
from quillgraph.sources import notes as n
from quillgraph.streaming.refresh import refresh
from tests import vault


def test_news_table(spark, tmp_path):
    name = "news_articles_test"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({news.SCHEMA}) USING parquet LOCATION '{tmp_path}/t'")
    rows = spark.createDataFrame([("h1", "text", "aa"), ("h2", "text", "bb"), ("h3", "text", None)], "headline string, article_text string, country_tag string")
    news.insert(rows, name)
    news.insert(rows, name)
    table = spark.table(name)
    assert table.count() == 6 and table.select("id").distinct().count() == 6
    assert news.count_country(table, "aa").first()["n"] == 2
    news.delete_country(spark, "aa", name)
    spark.catalog.refreshTable(name)
    assert {r["country_tag"] for r in spark.table(name).collect()} == {"bb", None} and spark.table(name).count() == 4
    spark.sql(f"DROP TABLE {name}")


def test_delete_by_country_drops_a_partition(spark):
    name = "news_articles_by_country"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    news.create_table(spark, name)
    rows = spark.createDataFrame([("h1", "text", "it's"), ("h2", "text", "bb"), ("h3", "text", None)], "headline string, article_text string, country_tag string")
    news.insert(rows, name)
    news.delete_country(spark, "it's", name)
    news.delete_country(spark, "nowhere", name)
    assert {(r["headline"], r["country_tag"]) for r in spark.table(name).collect()} == {("h2", "bb"), ("h3", None)}
    spark.sql(f"DROP TABLE {name}")


def test_news_over_jdbc(spark):
    where = {"url": "jdbc:derby:memory:news;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(100).select("id", F.concat(F.lit("h"), F.col("id").cast("string")).alias("headline"))
    news.write_jdbc(rows, **where)
    news.write_jdbc(rows.select((F.col("id") + 100).alias("id"), "headline"), **where)
    got = news.read_jdbc(spark, partitions=4, bounds=(0, 200), **where)
    assert got.rdd.getNumPartitions() == 4 and got.select("id").distinct().count() == 200
    assert news.read_jdbc(spark, **where).filter("id = 150").first()["headline"] == "h50"


def test_article_and_json(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("one\r\ntwo é".encode())
    assert n.read_article(spark, str(tmp_path / "a.txt")).first()["article_text"] == "one\ntwo é"
    path = sinks.put_json(spark, str(tmp_path / "sub" / "x.json"), {"é": 1})
    assert json.load(open(path, encoding="utf-8")) == {"é": 1}


def test_opportunity_shapes(spark):
    texts = ['[{"id": "a"}]', '{"results": [{"id": "b"}, {"id": "c"}]}', '{"opportunities": {"x": 1}, "items": [{"id": "d"}]}', '{"opportunity_id": "e"}']
    rows = spark.createDataFrame([(x,) for x in texts], "value string")
    assert sorted(r["id"] or r["opportunity_id"] for r in n.opportunities(rows).collect()) == ["a", "b", "c", "d", "e"]


def test_chunks_of_a_table(spark):
    rows = spark.range(0, 30000, 3).withColumnRenamed("id", "k")
    got = context.numbered_chunks(rows, "k").groupBy("chunk").agg(F.count("*").alias("n"), F.min("k").alias("a")).orderBy("chunk").collect()
    assert [r["a"] for r in got] == [i * 36 for i in range(len(got))] and {r["n"] for r in got[:-1]} == {12}


def test_chunks_of_sparse_keys(spark):
    keys = sorted({i * i * 7919 - 10**9 for i in range(5000)} | set(range(300)))
    rows = spark.createDataFrame([(k,) for k in [*keys, None]], "k long")
    got = context.numbered_chunks(rows, "k", parts=16).collect()
    assert {r["k"]: r["chunk"] for r in got} == {k: i // 12 for i, k in enumerate(keys)}
    assert context.numbered_chunks(rows.filter("false"), "k").count() == 0


def test_backlinks_of_a_hub_are_bounded(spark):
    nodes = spark.createDataFrame([("hub",), ("a",)], "uid string")
    edges = spark.createDataFrame([(f"s{i:03}", "hub", 0, True) for i in range(250)] + [("a", "gone", 0, False)], "src string, dst string, pos int, resolved boolean")
    rows = {r["uid"]: r for r in graph.indexed(nodes, edges).collect()}
    assert rows["hub"]["backlink_count"] == 250 and rows["hub"]["backlink_uids"] == [f"s{i:03}" for i in range(100)]
    assert (rows["a"]["backlink_count"], rows["a"]["backlink_uids"], rows["a"]["outbound_links"]) == (0, [], ["gone"])


def test_timeout_interrupts_jobs(spark):
    slow = lambda: spark.range(10**15).agg(F.max(F.xxhash64("id"))).collect()
    with pytest.raises(TimeoutError):
        pipelines.with_timeout(spark, slow, seconds=2)
    assert pipelines.with_timeout(spark, lambda: spark.range(5).count(), seconds=60) == 5


def test_trace_graph(spark):
    rows = spark.createDataFrame([(0, "A", "X", "r"), (1, "B", "X", "s"), (2, "A", "Y", "t")], "pos int, source_node string, target_concept string, relationship_type string")
    nodes, edges = graph.trace_graph(rows)
    assert nodes.count() == 5 and {(r["from_id"], r["to_id"], r["label"]) for r in edges.collect()} == {
        ("root", "source-0", ""), ("root", "source-1", ""), ("source-0", "target-0", "r"), ("source-1", "target-0", "s"), ("source-0", "target-1", "t")}


def test_notes_as_a_stream(spark, tmp_path):
    root, seen = vault.write(tmp_path / "notes"), []
    merge = lambda nodes, number: seen.extend(r["uid"] for r in nodes.select("uid").collect())
    query = refresh(spark, root, str(tmp_path / "checkpoint"), merge)
    query.awaitTermination(120)
    assert len(seen) == vault.VISIBLE - 1
    (tmp_path / "notes" / "Land" / "New.md").write_text("---\nsummary: new\n---\nx")
    query = refresh(spark, root, str(tmp_path / "checkpoint"), merge)
    query.awaitTermination(120)
    assert seen[-1] == "New" and len(seen) == vault.VISIBLE
