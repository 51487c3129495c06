"""Citation checks of what a language model returned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING, NEEDED = "citation_missing", "citation_needed"


def checked_source(source: Column, known: Column) -> Column:
    """The cited source, or the mark of a missing citation where it is none of the known ones."""
    return F.when(F.coalesce(known, F.lit(False)), source).otherwise(F.lit(MISSING))


def checked_sources(cited: Column, sources: Column) -> Column:
    """The cited list as it is where any of it is a source, else the mark of a needed citation."""
    return F.when(F.arrays_overlap(F.coalesce(cited, F.array().cast("array<string>")), sources), cited).otherwise(F.array(F.lit(NEEDED)))
