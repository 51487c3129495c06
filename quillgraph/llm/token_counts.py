"""Token counts for every context limit from one exact length histogram.

Documents are aggregated by encoded length, combined before the shuffle.  The histogram is then closed under suffix
sums, which answer at any context limit L how many documents and tokens exceed it, the truncated total
sum(min(length, L)) and, from the prefix counts, every quantile.  The sums run in blocks of lengths: windows inside
the blocks, and one over the blocks' totals, so no task holds the whole histogram.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCK = 128  #: lengths of a block


def histogram(lengths: DataFrame, length_col: str = "length") -> DataFrame:
    """Columns length and n_docs; rows of null length are left out."""
    return lengths.filter(F.col(length_col).isNotNull()).groupBy(F.col(length_col).cast("long").alias("length")).agg(F.count("*").alias("n_docs"))


def context_limits(hist: DataFrame) -> DataFrame:
    """One row for each length L that occurs, as a context limit.

    Columns: context_limit, n_docs and n_tokens of that length; docs_within (length <= L) and docs_over (length > L);
    tokens_over (the whole lengths of the latter); truncated_total (sum of min(length, L)); share_within.  Between
    two listed limits l < L < m, docs_over and tokens_over are those of l and truncated_total is that of l plus
    (L - l) * docs_over.  A quantile q is the first limit whose share_within is at least q.  An empty histogram
    gives an empty result.
    """
    hist = materialise(hist, "histogram")  # it is read twice below; the texts are encoded once
    h = hist.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each BLOCK lengths
    totals = Window.partitionBy()
    ends = blocks.select(
        "block", F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_after"),
        F.sum("docs").over(totals).alias("all_docs"), F.sum("tokens").over(totals).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    over = h.join(ends, "block").select(
        F.col("length").alias("context_limit"), "n_docs", "n_tokens", "all_docs", "all_tokens",
        (F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("docs_after")).alias("docs_over"),
        (F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)) + F.col("tokens_after")).alias("tokens_over"))
    return over.select(
        "context_limit", "n_docs", "n_tokens", (F.col("all_docs") - F.col("docs_over")).alias("docs_within"), "docs_over", "tokens_over",
        (F.col("all_tokens") - F.col("tokens_over") + F.col("context_limit") * F.col("docs_over")).alias("truncated_total"),
        ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("share_within"))


def quantile(limits: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share q of the documents does not exceed; None for an empty table."""
    return limits.filter(F.col("share_within") >= q).agg(F.min("context_limit")).first()[0]


def truncated_total(limits: DataFrame, limit: int) -> int:
    """sum(min(length, limit)) over all documents, for any limit, listed or not."""
    below = limits.filter(F.col("context_limit") <= limit).agg(F.max_by(F.struct("context_limit", "docs_over", "truncated_total"), "context_limit")).first()[0]
    if below is None:
        return limit * (limits.agg(F.sum("n_docs")).first()[0] or 0)
    return below["truncated_total"] + (limit - below["context_limit"]) * below["docs_over"]
