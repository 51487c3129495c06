"""The trigram index against a scan, and what it reads."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import trigrams
from quillgraph.plans import pipelines
from tests import vault


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    words = ["lithium", "Mine", "GOLD", "été", "Straße", "a", "of", "x" * 40, "𝄞clef", "mines"]
    rows = [(f"u{i:04d}", f"slug-{i // 2}", " ".join(r.choice(words) for _ in range(r.randrange(8)))) for i in range(900)]
    return [*rows, ("n1", "s", None), ("n2", "s", "ab"), ("n3", "s", "GOLD" * 20000), ("twin", "t1", "first lithium"), ("twin", "t2", "second gold"), (None, "t3", "lost gold")]


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    rows = spark.createDataFrame(texts, "uid string, slug string, text string")
    return trigrams.TrigramIndex.build(rows, str(tmp_path_factory.mktemp("index")), buckets=16, part=100)


@pytest.mark.parametrize("q", ["lithium", "GOLD", "d m", "ÉTÉ", "straße", "𝄞c", "xxxx", "", "a", "ab", "nothing here", "first lith", "dg", "mines min"])
def test_hits_are_those_of_a_scan(texts, index, q):
    got = sorted((r["uid"], r["slug"]) for r in index.containing(q).collect())
    assert got == sorted((u, s) for u, s, x in texts if u is not None and q.lower() in (x or "").lower())


def test_a_look_up_reads_few_parts(spark, index):
    plan = index.postings(trigrams.codes("lithium"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "PartitionFilters: [_bucket" in plan
    assert "PushedFilters: [In(gram" in plan
    plan = index.containing("first lith")._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan[plan.index("_text"):])[1]
    assert re.search(r"_part#\d+ (IN \(|= )", filters) and len(re.findall(r"\d+", filters.split("IN")[-1])) < index.texts().select("_part").distinct().count()


def test_no_list_is_one_row(spark, tmp_path):
    rows = spark.range(40000).selectExpr("concat('u', id) AS uid", "concat('common ', id) AS text").repartition(8)
    index = trigrams.TrigramIndex.build(rows, str(tmp_path), part=1000)
    lists = index.postings(trigrams.codes("com")).selectExpr("max(n)", "sum(n)", "count(*)").first()
    assert lists[1] == 40000 and lists[2] >= 4 and lists[0] <= 10000
    assert index.containing("common 1234").count() == 11


def test_parts_grow_with_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "PARTS", 8)
    rows = spark.range(1000).selectExpr("concat('u', lpad(id, 4, '0')) AS uid", "concat('text ', id) AS text")
    index = trigrams.TrigramIndex.build(rows, str(tmp_path / "i"), part=10)
    listed = []
    texts = trigrams.TrigramIndex.texts
    monkeypatch.setattr(trigrams.TrigramIndex, "texts", lambda self: listed.append(1) or texts(self))
    found, skipped = trigrams.top_k(index, ["text", "77"], F.when(F.contains("_text", F.lit("77")), 2).otherwise(1), 1, 3, first=1)
    assert len(list((tmp_path / "i" / "texts").glob("_part=*"))) == skipped.parts == 8 and len(listed) == 1
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [("u0077", 2, 0), ("u0177", 2, 1), ("u0277", 2, 2)]
    assert sorted(r["uid"] for r in index.containing("text 77").collect()) == ["u0077", *(f"u{i:04d}" for i in range(770, 780))]


def test_lists_come_back():
    r = np.random.default_rng(1)
    for top in (100, 60000, 10**8, 10**15):
        numbers = np.unique(r.integers(0, top, 50))
        assert (trigrams.unpacked(int(numbers[0]), *trigrams.packed(numbers)) == numbers).all()


def test_an_empty_index(spark, tmp_path):
    index = trigrams.TrigramIndex.build(spark.createDataFrame([], "uid string, slug string, text string"), str(tmp_path))
    assert index.containing("abc").count() == index.containing("").count() == 0


def test_entities_are_found_through_it(spark, tmp_path):
    index = pipelines.build_index(spark, vault.write(tmp_path / "notes"))
    found = pipelines.search_index(index, str(tmp_path / "index"))
    for q in ("lithium", "twin", "é", "", "railway"):
        want = sorted(map(str, pipelines.search_entities(index, q).collect()))
        assert sorted(map(str, pipelines.search_entities(index, q, found).collect())) == want
