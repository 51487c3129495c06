"""Packing by budget, the tree of reduces, the journal of answers, inserted batches, and top-k by bounds."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import score
from quillgraph.plans import packing, provider
from quillgraph.sources import news


def test_nothing_is_cut_or_reordered(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("abcdef") for _ in range(r.choice([0, 3, 20, 90, 260]))) for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(texts)), "pos long, text string")
    got = packing.packed(rows, 100).orderBy("pos").collect()
    assert max(len(g["text"]) for g in got) <= 100 and "".join(g["text"] for g in got).replace("\n", "") == "".join(texts)
    assert packing.packed(rows.limit(0), 100).count() == 0


def test_levels_of_answers_leave_one_prompt(spark):
    texts = [f"note {i} says {'x' * 60}" for i in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "pos long, text string")
    shorten = lambda system, user: "".join(f"<{w}>" for w in user.split() if w.isdigit()) if "says" in user else user[:40]
    root, levels = packing.reduced(rows, "s", shorten, 400)
    assert levels >= 2 and len(root) <= 400
    assert packing.reduced(rows.limit(2), "s", shorten, 400) == (texts[0] + "\n\n" + texts[1], 0)
    stuck, _ = packing.reduced(rows, "s", lambda s, u: u, 400)
    assert len(stuck) == 400 and stuck.startswith("note 0 says")
    assert packing.reduced(rows.limit(0), "s", shorten, 400) == ("", 0)


def test_answers_survive_a_broken_task(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def counted(system, user):
        with open(calls, "a") as f:
            f.write(f"{user}\n")
        if user == "breaks" and open(calls).read().count("breaks") == 1:
            raise provider.ProviderError(None, "lost")
        return user.upper()

    ask = provider.journaled(counted, str(tmp_path / "journal"))
    rows = spark.createDataFrame([(i, "breaks" if i == 5 else f"q{i}") for i in range(8)], "pos long, text string").coalesce(1)
    with pytest.raises(Exception, match="lost"):
        packing.answered(rows, "s", ask)
    done = open(calls).read().split()
    assert done.count("q0") == 1 and done.count("breaks") == 1
    got = packing.answered(rows, "s", ask).orderBy("pos").collect()
    assert [r["text"] for r in got] == [*(f"Q{i}" for i in range(5)), "BREAKS", "Q6", "Q7"]
    assert sorted(open(calls).read().split()) == sorted(["breaks", "breaks", *(f"q{i}" for i in (0, 1, 2, 3, 4, 6, 7))])
    uri = provider.journaled(lambda s, u: "other", f"file://{tmp_path}/journal")
    assert uri("s", "q0") == "Q0" and uri("s2", "q0") == "other" and uri("s2", "q0") == "other"


@pytest.fixture
def table(spark, tmp_path):
    name = "news_batches"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({news.SCHEMA}) USING parquet LOCATION '{tmp_path}/t'")
    yield name
    spark.sql(f"DROP TABLE {name}")


def rows_of(spark, word, n=30):
    return spark.createDataFrame([(f"{word}{i % 7}", "same text", "aa") for i in range(n)], "headline string, article_text string, country_tag string")


def test_a_batch_is_inserted_once(spark, table, monkeypatch):
    assert news.insert(rows_of(spark, "a"), table, batch="one") == 30
    assert news.insert(rows_of(spark, "a"), table, batch="one") == 0
    end = news.Log.end
    monkeypatch.setattr(news.Log, "end", lambda self, batch: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        news.insert(rows_of(spark, "b"), table, batch="two")
    monkeypatch.setattr(news.Log, "end", end)
    spark.catalog.refreshTable(table)
    assert news.insert(rows_of(spark, "b"), table, batch="two") == 0  # its rows were there, its end was not
    spark.catalog.refreshTable(table)
    got = spark.table(table)
    assert got.count() == 60 and got.select("id").distinct().count() == 60


def test_writers_at_once_share_no_ids(spark, table):
    threads = [threading.Thread(target=news.insert, args=(rows_of(spark, w), table)) for w in "cd"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    spark.catalog.refreshTable(table)
    assert spark.table(table).count() == spark.table(table).select("id").distinct().count() == 60


def test_anchors_by_bounds(spark, tmp_path):
    r = random.Random(2)
    words = ["lithium", "mine", "smelter", "rail", "power", "zinc", "of", "north"]
    rows = [(f"n{i:05d}", " ".join(r.choice(words if i < 40 else words[3:] + ["filler"] * 30) for _ in range(4)), " ".join(r.choice(["x", "y", "rail"]) for _ in range(3))) for i in range(3000)]
    nodes = spark.createDataFrame(rows, "uid string, name string, summary string").select(
        "uid", F.create_map(F.lit("name"), F.array("name")).alias("fm"), F.array().cast("array<string>").alias("aliases"), "summary")
    index = score.anchor_index(nodes, str(tmp_path / "index"), part=50)
    for wanted, k in ((["lithium", "smelter", "rail"], 5), (["rail", "of"], 7), (["nothing"], 5), ([], 5), (["zinc"], 4000)):
        found, skipped = score.indexed_anchors(index, wanted, k)
        want = [tuple(x) for x in score.anchors(nodes, wanted, k).orderBy("rank").collect()]
        assert [tuple(x) for x in found.orderBy("rank").collect()] == want
        assert skipped.read <= skipped.parts == 60
        if "lithium" in wanted:
            assert skipped.read <= 16 and len(want) == 5
