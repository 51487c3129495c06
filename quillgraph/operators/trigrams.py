"""Search for parts of texts through an index of character trigrams.

A text that holds q holds all trigrams of q, so the texts worth reading are those in all lists of q's trigrams.  The
index is two Parquet tables in a folder:

* ``texts``: uid, what else is shown, the text, and a number; partitioned by ranges of numbers (part);
* ``postings``: for each trigram and range of numbers the numbers of the texts that hold it, as differences of 1, 2, 4 or
  8 bytes (block); partitioned by a hash of the trigram (bucket) and sorted by it.

A list of a frequent trigram is as many rows as ranges were read, so no task and no row ever holds it whole.  A look-up
reads the buckets of its trigrams, and of these the row groups; it counts the lists, intersects the shortest ones and
verifies what is left on the texts, of which only the parts with candidates are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import scratch
from . import order

WIDTH = 21  #: bits of a code point
_MASK = (1 << WIDTH) - 1
_POSTINGS = "_bucket int, gram long, first long, last long, n int, steps binary, width int"
LISTS = 4  #: shortest lists that are intersected
PARTS = 1000  #: most parts of the texts that a look-up names one by one, and most that an index has


def codes(text: str) -> np.ndarray:
    """The trigrams of a text as whole numbers, in order, repeats included."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return points[:-2] << 2 * WIDTH | points[1:-1] << WIDTH | points[2:] if len(points) > 2 else np.zeros(0, np.int64)


def packed(numbers: np.ndarray) -> tuple[bytes, int]:
    """Differences of ascending numbers after the first, and their width in bytes."""
    steps = np.diff(numbers)
    width = next(w for w in (1, 2, 4, 8) if not len(steps) or int(steps.max()) < 1 << 8 * w)
    return steps.astype(f"<u{width}").tobytes(), width


def unpacked(first: int, steps: bytes, width: int) -> np.ndarray:
    return np.concatenate(([first], first + np.cumsum(np.frombuffer(steps, f"<u{width}").astype(np.int64))))


def _bucket(gram: np.ndarray | int, buckets: int) -> np.ndarray:
    """Bucket of a trigram: its points mixed by odd factors."""
    g = np.asarray(gram, np.int64)
    return ((g & _MASK) * 7919 + (g >> WIDTH & _MASK) * 104729 + (g >> 2 * WIDTH) * 1299709) % buckets


@dataclass
class TrigramIndex:
    """An index in a folder; ``keep`` are the columns beside uid that a hit shows."""

    spark: SparkSession
    folder: str
    buckets: int = 64
    part: int = 16_384
    schema: T.StructType | None = None  #: of the texts; read from them where it is not given

    @classmethod
    def build(cls, rows: DataFrame, folder: str, uid: str = "uid", text: str = "text", buckets: int = 64, part: int = 16_384) -> TrigramIndex:
        """Index ``rows`` by the lower-cased column ``text`` (null as empty) under ``uid``; other columns are kept with it.

        Rows of one uid share its number; rows without a uid are left out.  Texts shorter than three characters have no
        lists and are found by no look-up of three characters or more, rightly.  A part is ``part`` numbers, or as many
        more as leave PARTS parts: parts are folders, and whoever reads the texts lists them all.
        """
        low = rows.withColumn("_text", F.lower(F.coalesce(F.col(text), F.lit("")))).drop(text)
        # names are numbered alone and texts join their numbers: whole texts are not sorted through the ranges.
        # As files numbers are small enough for the planner to broadcast them, as rows they are not.
        names = order.numbered(low.select(uid).filter(F.col(uid).isNotNull()).distinct(), [uid], "_number")
        part = max(part, -(-names.count() // PARTS))
        placed = low.join(names.hint("merge"), uid).withColumn("_part", F.floor(F.col("_number") / part).cast("int"))
        index = cls(rows.sparkSession, folder, buckets, part, placed.schema)
        placed.repartitionByRange("_number").sortWithinPartitions("_part", "_number").write.partitionBy("_part").parquet(f"{folder}/texts")
        lists = index.texts().select("_number", "_text").mapInArrow(_lists(buckets), _POSTINGS)
        lists.hint("rebalance", "_bucket").sortWithinPartitions("_bucket", "gram").write.partitionBy("_bucket").parquet(f"{folder}/postings")
        return index

    def texts(self) -> DataFrame:
        read = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return read.parquet(f"{self.folder}/texts")

    def postings(self, grams: np.ndarray) -> DataFrame:
        """The lists of some trigrams: partitions by bucket, then row groups by trigram, are pruned at the scan."""
        buckets = sorted({int(b) for b in _bucket(grams, self.buckets)})
        table = self.spark.read.schema(_POSTINGS).parquet(f"{self.folder}/postings")
        return table.filter(F.col("_bucket").isin(buckets) & F.col("gram").isin([int(g) for g in grams]))

    def candidates(self, q: str) -> DataFrame | None:
        """Column _number of the texts in the shortest lists of q's trigrams; None where q is too short to have any."""
        grams = np.unique(codes(q.lower()))
        if not len(grams):
            return None
        sizes = {r["gram"]: r["n"] for r in self.postings(grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        if len(sizes) < len(grams):  # a trigram that no text holds
            return self.spark.createDataFrame([], "_number long")
        rare = sorted(sizes, key=lambda g: (sizes[g], g))[:LISTS]
        numbers = self.postings(np.array(rare)).mapInArrow(_numbers, "_number long")
        return numbers.groupBy("_number").agg(F.count("*").alias("n")).filter(F.col("n") >= len(rare)).select("_number")

    def containing(self, q: str) -> DataFrame:
        """The indexed rows whose text holds q, case ignored.  An empty q matches all; one or two characters scan the texts."""
        found, texts = self.candidates(q), self.texts()
        if found is not None:
            parts = [r[0] for r in found.select(F.floor(F.col("_number") / self.part).cast("int").alias("p")).distinct().limit(PARTS + 1).collect()]
            if len(parts) <= PARTS:
                texts = texts.filter(F.col("_part").isin(parts))
            texts = texts.join(found, "_number", "left_semi")
        return texts.filter(F.contains("_text", F.lit(q.lower()))).drop("_number", "_part")


@dataclass
class Skipped:
    """How much of an index a top-k look-up left unread."""

    parts: int
    read: int


def top_k(index: TrigramIndex, wanted: Sequence[str], score: Column, most: int, k: int, first: int = 8) -> tuple[DataFrame, Skipped]:
    """The k best indexed rows by ``score`` (a whole number over the texts' columns, ties by uid), without scoring all.

    ``score`` is the sum over the words of ``wanted`` of at most ``most`` each, and zero for a word that the text does
    not hold.  The postings give every part of the texts a bound: ``most`` for each word all of whose trigrams some text
    of the part holds (or that is too short to have any).  Parts are read from the highest bound on, ever more at once, until no part's bound
    reaches the k-th score; equal bounds are read, as ties go by uid.
    """
    long = {w: np.unique(codes(w.lower())) for w in set(wanted)}
    short = most * sum(not len(g) for g in long.values())
    grams = {int(x): 0 for g in long.values() for x in g}
    bounds: DataFrame | None = None
    if grams:
        held = index.postings(np.array(list(grams))).mapInArrow(_gram_parts(index.part), "gram long, part int").distinct()
        of = index.spark.createDataFrame([(w, int(x), len(g)) for w, g in long.items() for x in g], "word string, gram long, size int")
        words = held.join(F.broadcast(of), "gram").groupBy("part", "word").agg(F.count("*").alias("n"), F.first("size").alias("size")).filter("n = size")
        bounds = words.groupBy("part").agg((F.count("*") * most + short).alias("bound"))
    texts = index.texts()  # listed once
    every = texts.select(F.col("_part").alias("part")).distinct()
    known = every.join(bounds, "part", "left") if bounds is not None else every.withColumn("bound", F.lit(None).cast("long"))
    known = scratch.written(known.select("part", F.coalesce("bound", F.lit(short)).alias("bound")), "bounds")
    best, read, size, last = None, 0, first, (None, -1)
    while True:
        left = known.filter("bound > 0")
        if last[0] is not None:
            left = left.filter((F.col("bound") < last[0]) | ((F.col("bound") == last[0]) & (F.col("part") > last[1])))
        rows = best.collect() if best is not None else []
        if len(rows) == k:
            left = left.filter(F.col("bound") >= rows[-1]["score"])
        parts = left.orderBy(F.desc("bound"), "part").limit(size).collect()
        if not parts:
            break
        last, read = (parts[-1]["bound"], parts[-1]["part"]), read + len(parts)
        some = texts.filter(F.col("_part").isin([p["part"] for p in parts])).select("uid", score.alias("score")).filter("score > 0")
        if rows:
            some = some.unionByName(index.spark.createDataFrame([(r["uid"], r["score"]) for r in rows], "uid string, score long"))
        found = some.select("uid", F.col("score").cast("long").alias("score")).orderBy(F.desc("score"), "uid").limit(k).collect()  # k rows
        best = index.spark.createDataFrame([(r["uid"], r["score"], i) for i, r in enumerate(found)], "uid string, score long, rank int")
        size = min(2 * size, PARTS)
    return best if best is not None else index.spark.createDataFrame([], "uid string, score long, rank int"), Skipped(known.count(), read)


def _gram_parts(part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, parts = [], []
            for g, first, steps, width in zip(*[batch.column(c).to_pylist() for c in ("gram", "first", "steps", "width")]):
                some = np.unique(unpacked(first, steps, width) // part)
                gram.append(np.full(len(some), g, np.int64))
                parts.append(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*gram, np.zeros(0, np.int64)])), pa.array(np.concatenate([*parts, np.zeros(0, np.int64)]).astype(np.int32))], names=["gram", "part"])

    return run


def _lists(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, texts = batch.column("_number").to_numpy(), batch.column("_text").to_pylist()
            start, held = 0, 0
            for i, text in enumerate(texts):
                if i > start and held + len(text) > 4 << 20:  # characters at once
                    yield _posted(number[start:i], texts[start:i], buckets)
                    start, held = i, 0
                held += len(text)
            if start < len(texts):
                yield _posted(number[start:], texts[start:], buckets)

    return run


def _posted(number: np.ndarray, texts: list[str], buckets: int) -> pa.RecordBatch:
    grams = [np.unique(codes(x)) for x in texts]
    gram, who = np.concatenate([*grams, np.zeros(0, np.int64)]), np.repeat(number, [len(g) for g in grams])
    at = np.lexsort((who, gram))
    gram, who = gram[at], who[at]
    fresh = np.ones(len(gram), bool)
    fresh[1:] = (gram[1:] != gram[:-1]) | (who[1:] != who[:-1])
    gram, who = gram[fresh], who[fresh]
    starts = np.flatnonzero(np.diff(gram, prepend=-1))
    ends = np.append(starts[1:], len(gram)) if len(gram) else starts
    coded = [packed(who[a:z]) for a, z in zip(starts, ends)]
    return pa.RecordBatch.from_arrays(
        [pa.array(_bucket(gram[starts], buckets).astype(np.int32)), pa.array(gram[starts]), pa.array(who[starts]), pa.array(who[ends - 1]), pa.array((ends - starts).astype(np.int32)),
         pa.array([c[0] for c in coded], pa.binary()), pa.array([c[1] for c in coded], pa.int32())],
        names=["_bucket", "gram", "first", "last", "n", "steps", "width"])


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [unpacked(f, s, w) for f, s, w in zip(*[batch.column(c).to_pylist() for c in ("first", "steps", "width")])]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*lists, np.zeros(0, np.int64)]))], names=["_number"])
