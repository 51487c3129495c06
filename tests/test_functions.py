import math
import urllib.parse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import budget, jsons
from quillgraph.functions import text as t


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw", ["a%20b+c", "a%2520b", "%zz", "%C3%A9", "plain", ""])
def test_unquote(spark, raw):
    want = urllib.parse.unquote(raw)
    assert one(spark, t.url_unquote(F.col("s")), s=raw) == want
    while (again := urllib.parse.unquote(want)) != want:
        want = again
    assert one(spark, t.decode_fully(F.col("s")), s=raw) == want


def test_names(spark):
    assert one(spark, t.canonical(F.col("s")), s="Ab-c É9_") == "abc9"
    assert one(spark, t.slug(F.col("s")), s="  Rural%20District--Councils! ") == "rural-district-councils"
    assert one(spark, t.strip(F.col("s")), s=" \n x \t ") == "x"
    assert one(spark, t.tokens(F.col("s")), s="The Zinc-smelter of the A 9 99 zinc") == ["zinc", "smelter", "99"]
    assert one(spark, t.cache_key(F.col("s")), s="") == "00a01a6536012f69"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=30))
def test_estimate(spark, sizes):
    rows = spark.createDataFrame([("x" * n, n) for n in sizes], "s string, n int").select("n", budget.estimate(F.col("s")).alias("e")).collect()
    assert all(r["e"] == (math.floor(r["n"] / 3.2) + 1 if r["n"] else 0) for r in rows)


def test_truncation(spark):
    assert one(spark, budget.truncate(F.col("u"), F.col("s"), 10), u="x" * 50, s="abcd") == "x" * 28 + budget.TRUNCATED
    assert one(spark, budget.truncate(F.col("u"), F.col("s"), 10), u="x" * 5, s="abcd") == "x" * 5
    got = one(spark, budget.truncate_two(F.col("a"), F.col("g"), F.col("s"), 10), a="a" * 30, g="g" * 30, s="")
    assert got["article"] == "a" * 8 + budget.ARTICLE_TRUNCATED and got["graph"] == "g" * 24 + budget.GRAPH_TRUNCATED
    with pytest.raises(Exception, match="token budget"):
        one(spark, budget.truncate_two(F.col("a"), F.col("g"), F.col("s"), 10), a="a", g="g", s="s" * 60)


@pytest.mark.parametrize("raw,want", [('{"k": 1}', "1"), ('```json\n{"k": 2}\n```', "2"), ('so: {"k": 3} ok', "3"), ('{"k": 4,}', "4"), ("none", None), ("", None)])
def test_lenient_json(spark, raw, want):
    assert one(spark, F.try_variant_get(jsons.lenient_json(F.col("s")), "$.k", "string"), s=raw) == want


def test_json_failures(spark):
    with pytest.raises(Exception, match="no JSON from stage map"):
        one(spark, F.to_json(jsons.lenient_json_or_fail(F.col("s"), "map")), s="none")
    assert one(spark, F.to_json(jsons.json_or_empty(F.col("s"))), s="none") == "{}"
    assert one(spark, jsons.strict_object(F.col("s")).isNull(), s="[1]") is True
    assert one(spark, jsons.tag(F.col("s"), "a", F.lit("{}")), s="<a>\n x </a><a>y</a>") == "x"
    assert one(spark, jsons.tag(F.col("s"), "b"), s="whole") == "whole"
