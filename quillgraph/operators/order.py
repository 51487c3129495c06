"""Positions and running sums over any order of a whole table, without a task that sees all rows.

Rows are dealt to ranges of the order whose splitters Spark samples, sorted inside them and written once, so that a row's
range and place in it are facts and not recomputed.  What is before a range is the sum over the ranges before it, one
row each.  Ties go by a hash of the row (without its maps), then follow each other as they come: equal rows are interchangeable.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

_INNER = 33  #: bits of monotonically_increasing_id() that count inside a partition


def _dealt(rows: DataFrame, order: list[Column | str], parts: int | None = None) -> DataFrame:
    """rows in ranges of the order (``parts``, or as many as shuffles have): _range and _inner, written once."""
    plain = [f.name for f in rows.schema if not re.search("map<|variant", f.dataType.simpleString())]  # the others have no hash
    by = [*order, *([F.xxhash64(*plain)] if plain else [])]
    place = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*([parts] if parts else []), *by).sortWithinPartitions(*by)
    return scratch.written(ranged.withColumns({"_range": F.shiftright(place, _INNER), "_inner": place.bitwiseAND((1 << _INNER) - 1)}), "order")


def _before(sums: DataFrame, col: str) -> DataFrame:
    """sums (_range and its amount) with what lies before each range: one row for each range of the table."""
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_range", F.coalesce(F.sum(col).over(earlier), F.lit(0)).cast("long").alias("_before"))


def numbered(rows: DataFrame, order: list[Column | str], position: str = "position", parts: int | None = None) -> DataFrame:
    """rows with their position from 0 in the order."""
    dealt = _dealt(rows, order, parts)
    before = _before(dealt.groupBy("_range").agg(F.count("*").alias("_n")), "_n")
    return dealt.join(F.broadcast(before), "_range").withColumn(position, F.col("_before") + F.col("_inner")).drop("_range", "_inner", "_before")


def running(rows: DataFrame, order: list[Column | str], amount: str, total: str = "running") -> DataFrame:
    """rows with the sum of the whole-number column ``amount`` over all rows before them in the order."""
    dealt = _dealt(rows, order)
    before = _before(dealt.groupBy("_range").agg(F.coalesce(F.sum(amount), F.lit(0)).alias("_n")), "_n")
    inside = Window.partitionBy("_range").orderBy("_inner").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_sum", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return summed.join(F.broadcast(before), "_range").withColumn(total, (F.col("_before") + F.col("_sum")).cast("long")).drop("_range", "_inner", "_sum", "_before")


def ranked(rows: DataFrame, keys: list[str], order: list[Column | str], rank: str = "rank") -> DataFrame:
    """rows with their position from 0 among those of equal keys; a key may hold any share of the rows.

    A row's position in (keys, order) less the first position of its keys, which an aggregate finds.
    """
    placed = scratch.written(numbered(rows, [*keys, *order], "_position"), "ranked")
    firsts = placed.groupBy(*[F.col(k).alias(f"_first_{k}") for k in keys]).agg(F.min("_position").alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_first_{k}")) for k in keys]
    return placed.join(firsts, same).select(*rows.columns, (F.col("_position") - F.col("_first")).alias(rank))
