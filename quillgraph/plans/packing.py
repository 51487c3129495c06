"""Reduce by budget: texts are packed into prompts by running sums of their lengths, and answered level by level in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import context, order
from ..sources import scratch
from .provider import Provider

SEPARATOR = "\n\n"


def packed(rows: DataFrame, room: int) -> DataFrame:
    """Rows pos, text -> rows pos, text: successive texts joined while they fit ``room`` characters, none cut.

    A text beyond half the room goes on in pieces of that size.  A group is what ends in one half of the room of the
    running sum, so it begins at most one piece before it: no group is larger than the room, and all but the last
    hold a fourth of it or more.
    """
    half = max(1, room // 2)
    cut = half - len(SEPARATOR) if half > len(SEPARATOR) else 1
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / cut).cast("int") - 1, F.lit(0)))
    parts = rows.select("pos", "text", F.posexplode(starts).alias("part", "at"))
    parts = parts.select("pos", "part", F.substring("text", F.col("at") * cut + 1, F.lit(cut)).alias("text")).withColumn("size", F.length("text") + len(SEPARATOR))
    placed = order.running(parts, ["pos", "part"], "size", "before")
    group = F.floor((F.col("before") + F.col("size") - 1) / half)
    return placed.groupBy(group.alias("pos")).agg(context.joined(F.struct("before", "part"), F.col("text"), SEPARATOR).alias("text"))


def answered(groups: DataFrame, system: str, provider: Provider) -> DataFrame:
    """The provider's answer to each text, in tasks, written once so that no answer is asked for twice."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"pos": pdf["pos"], "text": [provider(system, x) for x in pdf["text"]]})

    return scratch.written(groups.mapInPandas(run, "pos long, text string"), "answered")


def reduced(rows: DataFrame, system: str, provider: Provider, room: int) -> tuple[str, int]:
    """One prompt's worth of text from rows pos, text, and how many levels of answers it took.

    While more than one group is left the groups are answered and their answers packed again; nothing is cut on the way, and only the last
    group's text comes to the driver.  Answers that do not shrink the number of groups end the levels: then the first ``room`` characters come.
    """
    level, groups = 0, scratch.written(packed(rows, room), "packed")
    n = groups.count()
    while n > 1:
        shorter = scratch.written(packed(answered(groups, system, provider), room), "packed")
        level += 1
        now = shorter.count()
        if now >= n:
            whole = shorter.withColumn("text", F.substring("text", 1, room)).orderBy("pos").limit(8).collect()  # a group has a fourth of the room at least, but for the last
            return SEPARATOR.join(r["text"] for r in whole)[:room], level
        groups, n = shorter, now
    row = groups.first()
    return (row["text"] if row else ""), level
