"""Adjacency in pages: the neighbours of a node as rows of bounded size, however many there are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import order

PAGE = 4096  #: neighbours of a page


def pages(pairs: DataFrame, key: str, value: str, size: int = PAGE) -> DataFrame:
    """Rows key, page (from 0), values (at most ``size``, ascending) and total (of the key) of the different pairs.

    Pages are ranges of a key's values: all of a page come before all of the next.  Null keys and values are left out.
    A key with any number of values is spread over tasks: neither a task nor a row holds them all.
    """
    each = pairs.select(F.col(key).alias("_key"), F.col(value).alias("_value")).filter("_key is not null and _value is not null").distinct()
    placed = order.ranked(each, ["_key"], ["_value"], "_rank").withColumn("page", F.floor(F.col("_rank") / size).cast("int"))
    found = placed.groupBy("_key", "page").agg(F.array_sort(F.collect_list("_value")).alias("values"))
    sizes = found.groupBy("_key").agg(F.sum(F.size("values")).cast("long").alias("total"))
    return found.join(sizes, "_key").select(F.col("_key").alias(key), "page", "values", "total")


def backlink_pages(edges: DataFrame, size: int = PAGE) -> DataFrame:
    """uid, page, sources and total for every node that another (or it itself) links to."""
    found = pages(edges.filter("resolved"), "dst", "src", size)
    return found.select(F.col("dst").alias("uid"), "page", F.col("values").alias("sources"), "total")


def canonical_pages(links: DataFrame, size: int = PAGE) -> DataFrame:
    """canonical target text, page, sources and total, unresolved targets too."""
    found = pages(links.select(t.canonical(F.col("raw")).alias("canonical"), "src"), "canonical", "src", size)
    return found.select("canonical", "page", F.col("values").alias("sources"), "total")


def page_of(table: DataFrame, key: str, wanted: str, page: int = 0) -> list[str]:
    """One page of a key's values from a written page table; empty where there is none."""
    row = table.filter((F.col(key) == wanted) & (F.col("page") == page)).select(table.columns[2]).first()
    return list(row[0]) if row else []
