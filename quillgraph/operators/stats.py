"""Counts over nodes and edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t


def type_breakdown(nodes: DataFrame, type_col: str = "entity_type") -> DataFrame:
    return nodes.groupBy(t.first_filled(F.col(type_col), F.lit("unknown")).alias("entity_type")).agg(F.count("*").alias("n"))


def vault_stats(nodes: DataFrame, edges: DataFrame, subset: DataFrame | None = None) -> DataFrame:
    """One row: total_entities and total_relationships of the subset (or all), and, always of all nodes,
    commodities_tracked, countries_covered and sectors_mapped."""
    part, links = nodes, edges
    if subset is not None:
        part = nodes.join(subset.select("uid"), "uid", "left_semi")
        links = edges.join(subset.select(F.col("uid").alias("src")), "src", "left_semi")
    seen = lambda c: F.count_distinct(F.nullif(F.lower(c), F.lit("")))
    vocabulary = nodes.agg(
        F.count_distinct(F.when(F.col("entity_type") == "commodity", F.lower("uid"))).alias("commodities_tracked"),
        seen("country").alias("countries_covered"), seen("sector").alias("sectors_mapped"))
    each = [part.agg(F.count("*").alias("total_entities")), links.agg(F.count("*").alias("total_relationships")), vocabulary]
    both = each[0].unionByName(each[1], True).unionByName(each[2], True)  # three rows
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def fingerprint(files: DataFrame, time_col: str = "mtime") -> DataFrame:
    """One row: latest and n, which change when files are added, changed or taken away."""
    return files.agg(F.max(time_col).alias("latest"), F.count("*").alias("n"))


def multiset_fingerprint(files: DataFrame, *columns: str) -> DataFrame:
    """One row: n and digest, the sum of a 60-bit hash of every row's columns (as text; null apart from all texts).

    The sum does not depend on the order of rows, and a set that lost one row and gained another has another sum, even
    where neither the number of rows nor the latest time changes.  Sums of parts add up, so a change can be applied to
    a stored digest without reading the rest: see changed_fingerprint().
    """
    shown = F.concat(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) if i == 0 else
                       F.coalesce(F.concat(F.lit("|="), F.col(c).cast("string")), F.lit("|-")) for i, c in enumerate(columns)])
    each = F.conv(F.substring(F.md5(shown.cast("binary")), 1, 15), 16, 10).cast("decimal(20,0)")
    return files.agg(F.count("*").alias("n"), F.coalesce(F.sum(each.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def changed_fingerprint(before: tuple[int, str], gone: tuple[int, str], come: tuple[int, str]) -> tuple[int, str]:
    """The fingerprint of a set after some rows went and others came, from fingerprints alone."""
    return before[0] - gone[0] + come[0], str(int(before[1]) - int(gone[1]) + int(come[1]))
