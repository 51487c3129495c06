"""Near copies by exact Jaccard similarity of word shingles.

Candidates share one of 32 bands of four min-hashes (a pair of similarity 0.8 misses all of them with a chance of 5e-8);
every link is verified on the whole sets of shingles.  Rows of one set are one node.  Nodes that share a band are compared
in groups of bounded size, each of which returns a spanning forest, so that no group emits all its pairs and no link
between groups is lost; groups of the same nodes are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowered, materialise, pieces, texts
from .simhash import components

BANDS, ROWS = 32, 4
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted different hashes of a lower-cased text's word shingles; a shorter text is one shingle."""
    words = text.split()
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= size:
        return np.array([digest(joined, 42)], np.uint64)
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - size + 1]
    return np.unique(np.array([digest(joined[a:z], 42) for a, z in zip(starts.tolist(), ends[size - 1:].tolist())], np.uint64))


def bands(found: np.ndarray, block: int = 2048) -> list[int]:
    least = np.full(BANDS * ROWS, ~np.uint64(0), np.uint64)
    for i in range(0, len(found), block):
        x = found[i:i + block, None] * _FACTORS
        least = np.minimum(least, (x ^ x >> np.uint64(29)).min(axis=0))
    return [xxhash.xxh64_intdigest(least[i:i + ROWS].tobytes(), i) - (1 << 63) for i in range(0, BANDS * ROWS, ROWS)]


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return both >= least * (len(a) + len(b) - both)


def forest(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the sets' links, breadth first."""
    left, edges = list(range(len(sets))), []
    while left:
        queue = [left.pop(0)]
        while queue and left:
            i = queue.pop()
            near = [j for j in left if similar(sets[i], sets[j], least)]
            gone = set(near)
            left = [j for j in left if j not in gone]
            edges += [(i, j) for j in near]
            queue += near
    return edges


def _nodes(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Columns id, node (hash of the set) and bands for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                sets = [shingles(t, size) for t in lowered(part.column("body"))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64()), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))],
                    names=["id", "node", "bands"])

    return texts(docs, id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, node long, bands array<long>")


def _sets(bodies: DataFrame, size: int) -> DataFrame:
    """Columns node and found (the set) for every row of ``bodies`` (column body)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                found = [shingles(t, size).tobytes() for t in lowered(part.column("body"))]
                yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh64_intdigest(b) - (1 << 63) for b in found], pa.int64()), pa.array(found, pa.binary())], names=["node", "found"])

    return bodies.mapInArrow(run, "node long, found binary")


def similar_groups(docs: DataFrame, least: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = 128) -> DataFrame:
    """One row for each row of docs: id_col and component_id, the smallest id reachable over links of at least ``least``.

    Null and empty texts, and texts of white space, are one set.  Null ids never name a component unless all its ids are
    null.  An empty table gives an empty result.
    """
    each = materialise(_nodes(docs, size, id_col, text_col), "nodes")
    names = materialise(each.groupBy("node").agg(F.min("id").alias("least"), F.first("bands").alias("bands")), "sets")
    shared = materialise(names.select("node", F.posexplode("bands").alias("band", "value")), "bands")
    sizes = shared.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    dealt = shared.join(sizes, ["band", "value"]).withColumn("x", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).groupBy("band", "value", F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"))
    groups = materialise(dealt.agg(F.array_sort(F.collect_set("node")).alias("nodes")).filter(F.size("nodes") > 1).select("nodes").distinct(), "groups")
    members = groups.withColumn("group", F.xxhash64("nodes")).select("group", F.explode("nodes").alias("node")).distinct()
    members = materialise(members, "members")
    asked = materialise(members.select("node").distinct(), "asked")
    one = materialise(each.join(asked, "node").groupBy(F.col("id").alias("_id")).agg(F.count("*").alias("n")), "holders")
    rows = docs.join(one, docs[id_col].eqNullSafe(one["_id"]), "left_semi")
    found = _sets(rows.select(F.coalesce(F.col(text_col), F.lit("")).alias("body")), size)
    found = materialise(found.join(asked, "node", "left_semi").groupBy("node").agg(F.first("found").alias("found")), "found")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, edges = pdf["node"].tolist(), forest([np.frombuffer(b, np.uint64) for b in pdf["found"]], least)
        return pd.DataFrame({"a": pd.Series([nodes[i] for i, _ in edges], dtype="int64"), "b": pd.Series([nodes[j] for _, j in edges], dtype="int64")})

    edges = members.join(found, "node").groupBy("group").applyInPandas(solve, "a long, b long")
    roots = components(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    named = names.select("node", "least").join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = materialise(named, "named")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return each.join(named, "node").select(F.col("id").alias(id_col), "component_id")


def drop_similar(docs: DataFrame, least: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest id.  Rows of a null id stay.

    Rows that share an id are one document: they stay together where one of them stays.
    """
    mine = similar_groups(docs, least, size, id_col, text_col).filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_gone"))
    gone = mine.agg(F.max(F.col(id_col) == F.col("component_id")).alias("stays")).filter(~F.col("stays")).select("_gone")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
