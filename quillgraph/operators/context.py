"""Context for language models: text blocks, ordered joins of them, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from . import order as orders

# Nodes of a chunk, and the header fields that a source block shows.
CHUNK = 12
SHOWN_FIELDS = ("entity", "sector", "country", "ownership_type", "status", "regulatory_status")


def _na(c: Column) -> Column:
    return t.first_filled(c, F.lit("N/A"))


def candidate_block() -> Column:
    return F.concat(F.lit("NODE_ID: "), "uid", F.lit("\nTYPE: "), "entity_type", F.lit(" | COUNTRY: "), _na(F.col("country")), F.lit(" | SECTOR: "), _na(F.col("sector")),
                    F.lit("\nSUMMARY: "), F.substring("summary", 1, 200), F.lit("\n---"))


def source_block() -> Column:
    fields = [F.nullif(F.concat(F.lit(f"{k}: "), F.get_json_object("fm_json", f"$.{k}")), F.lit(f"{k}: ")) for k in SHOWN_FIELDS]
    return F.concat(
        F.lit("=== SOURCE NODE: "), "uid", F.lit(" ===\nType: "), "entity_type", F.lit("\nCountry: "), _na(F.col("country")), F.lit("\nSector: "), _na(F.col("sector")),
        F.lit("\nFrontmatter: "), _na(F.concat_ws("; ", *fields)), F.lit("\nSummary: "), F.substring("summary", 1, 300),
        F.lit("\nOutbound Links: "), F.array_join(F.slice("outbound_links", 1, 8), ", "), F.lit("\nBacklinks: "), F.array_join(F.slice("backlink_uids", 1, 5), ", "), F.lit("\n"))


def scan_line() -> Column:
    return F.concat("uid", F.lit(" ("), "entity_type", F.lit(", "), _na(F.col("country")), F.lit("): "), F.substring("summary", 1, 150))


def chunk_block() -> Column:
    return F.concat(F.lit("--- NODE: "), "uid", F.lit(" ---\nSummary: "), "summary", F.lit("\nFrontmatter: "), "fm_json", F.lit("\nContent Preview:\n"), F.substring("raw", 1, 1500), F.lit("\n"))


def joined(order: Column, text: Column, sep: str) -> Column:
    """Aggregate: texts joined in order, whatever order the rows arrive in."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), sep)


def chunks(rows: DataFrame, order: list[Column | str], size: int = CHUNK, within: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """rows with chunk (from 0), ``size`` successive rows each, in any order of any table; ties as operators.order has them.

    Bring names and orders alone and join texts afterwards; ``within`` numbers each group by itself.
    """
    placed = orders.ranked(rows, within, order, "_place") if within else orders.numbered(rows, order, "_place", parts)
    return placed.withColumn("chunk", F.floor(F.col("_place") / size).cast("long")).drop("_place")


def numbered_chunks(rows: DataFrame, key: str, size: int = CHUNK, parts: int | None = None) -> DataFrame:
    """rows with chunk (from 0) by ascending key.  Rows with a null key are left out."""
    known = rows.filter(F.col(key).isNotNull())
    numbers = chunks(known.select(key), [key], size, parts=parts).distinct()  # keys alone are dealt to ranges, rows join their chunk
    return known.join(numbers, key)
