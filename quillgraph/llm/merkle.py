"""Merkle manifest of a table: leaf hashes, group roots, one root, and a membership proof for every row.

Leaves are numbered without sorting them.  Scan tasks build compressed bitmaps of the ids they read, one for each group and
range of ids; these are merged, counted, and a directory of prefix counts over ranges, ranges of ranges and so on gives
every bitmap the number of leaves before it.  A leaf's coordinate is then that number plus a popcount.  Tree levels are
reduced in slot arrays keyed by (group, coordinate / SLOTS): a task fills an array by slot and reduces it ten levels at
once; the arrays' own nodes are the next round's slots.  Paths come back down the same arrays.

Nulls: a null id is its group's first leaf, a null group is a group of its own (the first one), other nulls enter the leaf
as ``-``.  Repeated ids are leaves of their own in the order of their leaf hashes, and fully repeated rows follow each
other.  Empty texts have length 0.  An empty table has no rows and no root.  Columns beside the five are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

LOW = 10  #: bits of an id inside one bitmap
SLOTS = 10  #: levels that one slot array reduces
FAN = 14  #: bits that one level of the directory takes off a range's number
_BITMAP = 1 << LOW >> 3
_NULL_RANGE = -(1 << 63 - LOW) - 1  #: the range before all others, of null ids
_RUNS = np.dtype([("low", "<u2"), ("more", "<i8")])


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of the fields, each with its UTF-8 length before it, or ``-`` for null."""
    def coded(c: Column) -> Column:
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))

    return F.sha2(F.concat(*[coded(f.cast("string")) for f in fields]), 256)


# --- coordinates: compressed bitmaps and their directory

def pack(low: np.ndarray) -> bytes:
    """Sorted different numbers below 2^LOW as an array of 16-bit numbers, or as a bitmap where that is shorter."""
    if 2 * len(low) < _BITMAP:
        return low.astype("<u2").tobytes()
    bits = np.zeros(1 << LOW, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(packed: bytes) -> np.ndarray:
    if len(packed) < _BITMAP:
        return np.frombuffer(packed, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little"))


def _words(packed: bytes) -> np.ndarray:
    """The bitmap as 64-bit words."""
    if len(packed) < _BITMAP:
        packed = np.packbits(np.bincount(np.frombuffer(packed, "<u2"), minlength=1 << LOW).astype(np.uint8), bitorder="little").tobytes()
    return np.frombuffer(packed, np.uint64)


def _bitmaps(leaves: DataFrame) -> DataFrame:
    """One row for each tree and range of ids: tree, range, bitmap (packed), runs (ids with more than one leaf), n (leaves)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = batch.to_pandas()
            rows = []
            for (tree, at), part in seen.groupby(["tree", "range"], sort=False):
                low, where = np.unique(part["low"].to_numpy(np.int64), return_inverse=True)
                n = np.zeros(len(low), np.int64)
                np.add.at(n, where, part["copies"].to_numpy(np.int64))
                rows.append((tree, at, pack(low), _runs(low, n)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())],
                names=["tree", "range", "bitmap", "runs"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(1 << LOW, np.int64)
        for bitmap, runs in zip(pdf["bitmap"], pdf["runs"]):
            counts[unpack(bitmap)] += 1
            more = np.frombuffer(runs, _RUNS)
            counts[more["low"]] += more["more"]
        low = np.flatnonzero(counts)
        return pd.DataFrame({"tree": pdf["tree"].iloc[:1], "range": pdf["range"].iloc[:1], "bitmap": [pack(low)], "runs": [_runs(low, counts[low])], "n": [int(counts.sum())]})

    parts = leaves.select("tree", "range", "low", "copies").mapInArrow(build, "tree string, range long, bitmap binary, runs binary")
    return parts.groupBy("tree", "range").applyInPandas(merge, "tree string, range long, bitmap binary, runs binary, n long")


def _runs(low: np.ndarray, n: np.ndarray) -> bytes:
    many = n > 1
    out = np.empty(int(many.sum()), _RUNS)
    out["low"], out["more"] = low[many], n[many] - 1
    return out.tobytes()


def _directory(bitmaps: DataFrame) -> DataFrame:
    """bitmaps with base (leaves of the tree before the range) and total (leaves of the tree).

    Counts are summed over ranges, ranges of ranges, and so on; prefix sums are taken among the at most 2^FAN children
    of one parent, so no window holds a whole tree's ranges.
    """
    levels, shift = [bitmaps.select("tree", F.col("range").alias("at"), "n")], 0
    while shift < 64 - LOW - FAN:
        below = levels[-1]
        levels.append(below.groupBy("tree", F.shiftright("at", FAN).alias("at")).agg(F.sum("n").alias("n")))
        shift += FAN
    top = Window.partitionBy("tree")
    before = top.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    base = levels[-1].select("tree", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.sum("n").over(top).alias("total"))
    for level in reversed(levels[:-1]):
        siblings = Window.partitionBy("tree", "parent").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        inner = level.withColumn("parent", F.shiftright("at", FAN)).select("tree", "at", "parent", F.coalesce(F.sum("n").over(siblings), F.lit(0)).alias("inner"))
        base = inner.join(base.withColumnRenamed("at", "parent"), ["tree", "parent"]).select("tree", "at", (F.col("base") + F.col("inner")).alias("base"), "total")
    return bitmaps.join(base.withColumnRenamed("at", "range"), ["tree", "range"]).select("tree", "range", "bitmap", "runs", "base", "total")


def _ranks(leaves: DataFrame, directory: DataFrame) -> DataFrame:
    """leaves with at (coordinate of the id's first leaf), shared (the id has more leaves than this row's copies) and total."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("bitmap").dictionary_encode()
            words = np.stack([_words(b) for b in coded.dictionary.to_pylist()]) if len(coded.dictionary) else np.zeros((0, 16), np.uint64)
            before = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64) - np.bitwise_count(words)
            which, low = coded.indices.to_numpy(), batch.column("low").to_numpy().astype(np.int64)
            word, bit = low >> 6, (low & 63).astype(np.uint64)
            inside = np.bitwise_count(words[which, word] & ((np.uint64(1) << bit) - np.uint64(1)))
            at = batch.column("base").to_numpy() + before[which, word] + inside
            shared, copies = np.zeros(len(at), bool), batch.column("copies").to_numpy()
            runs = batch.column("runs").dictionary_encode()
            tables = [np.frombuffer(r, _RUNS) for r in runs.dictionary.to_pylist()]
            for i, k in enumerate(runs.indices.to_numpy()):
                if len(more := tables[k]):
                    at[i] += int(more["more"][more["low"] < low[i]].sum())
                    shared[i] = int(more["more"][more["low"] == low[i]].sum()) + 1 > copies[i]
            kept = [batch.column(c) for c in ("tree", "id", "leaf", "bad", "copies", "total")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(at.astype(np.int64)), pa.array(shared)], names=["tree", "id", "leaf", "bad", "copies", "total", "at", "shared"])

    joined = leaves.join(directory, ["tree", "range"]).select("tree", "id", "low", "leaf", "bad", "copies", "bitmap", "runs", "base", "total")
    return joined.mapInArrow(rank, "tree string, id long, leaf string, bad string, copies long, total long, at long, shared boolean")


def coordinates(leaves: DataFrame) -> DataFrame:
    """tree, id, leaf, bad, copies, total and at for rows tree, id, leaf, bad, copies that differ in (tree, id, leaf).

    Different leaves of one id are ordered by their hash, in buckets of its first 16 bits.
    """
    leaves = materialise(leaves.withColumn("range", F.coalesce(F.shiftright("id", LOW), F.lit(_NULL_RANGE)))
                         .withColumn("low", F.coalesce(F.col("id").bitwiseAND((1 << LOW) - 1), F.lit(0)).cast("int")), "leaves")
    ranked = materialise(_ranks(leaves, _directory(materialise(_bitmaps(leaves), "bitmaps"))), "ranked")
    ties = ranked.filter("shared").withColumn("bucket", F.substring("leaf", 1, 4))
    earlier = Window.partitionBy("tree", "id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = ties.groupBy("tree", "id", "bucket").agg(F.sum("copies").alias("n"))
    buckets = buckets.select("tree", "id", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("tree", "id", "bucket").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    ties = ties.withColumn("inner", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    same = (ties["tree"] == buckets["tree"]) & ties["id"].eqNullSafe(buckets["id"]) & (ties["bucket"] == buckets["bucket"])
    placed = ties.join(buckets, same).select(ties["tree"], ties["id"], "leaf", "bad", "copies", "total", (F.col("at") + F.col("skip") + F.col("inner")).alias("at"))
    return ranked.filter("not shared").drop("shared").unionByName(placed)


# --- slot arrays: up to the root, and paths down again

def reduce_slots(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the levels above them, each of pairs of the one below; a last single node is hashed alone."""
    out = [nodes]
    for _ in range(levels):
        last = out[-1]
        out.append([digest(last[i:i + 2]) for i in range(0, len(last), 2)])
    return out


def slot_path(levels: list[list[str]], slot: int) -> list[str]:
    """Siblings on the way up, ``<`` before one to the left, ``>`` before one to the right, ``.`` for none."""
    path = []
    for level in levels[:-1]:
        other = slot ^ 1
        path.append("." if other >= len(level) else ("<" if other < slot else ">") + level[other])
        slot >>= 1
    return path


def fold(node: str, path: list[str]) -> str:
    for step in path:
        node = digest([node] if step == "." else [step[1:], node] if step[0] == "<" else [node, step[1:]])
    return node


def _depth(total: int) -> int:
    return (total - 1).bit_length()


_ARRAY = "tree string, total long, block long, slots array<string>, node string"


def _arrays(nodes: DataFrame, done: int) -> DataFrame:
    """Rows tree, total, at, n (so many equal nodes from at on), node -> one row for each array, with its own node.

    ``done`` levels lie below.  Arrays of leaves also carry ids and bad, in slot order.
    """
    leaves = "id" in nodes.columns
    schema = _ARRAY + (", ids array<long>, bads array<string>" if leaves else "")

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, total, block = pdf["tree"].iloc[0], int(pdf["total"].iloc[0]), int(pdf["block"].iloc[0])
        first = block << SLOTS
        slots: list[str] = [""] * min(1 << SLOTS, -(-total >> done) - first)
        ids, bads = [None] * len(slots), [None] * len(slots)
        for row in pdf.itertuples(index=False):
            for slot in range(max(row.at - first, 0), min(row.at + row.n - first, len(slots))):
                slots[slot] = row.node
                if leaves:
                    ids[slot], bads[slot] = None if row.id is None else int(row.id), row.bad
        node = reduce_slots(slots, max(0, min(SLOTS, _depth(total) - done)))[-1][0]
        out = {"tree": [tree], "total": [total], "block": [block], "slots": [slots], "node": [node]}
        return pd.DataFrame(out | ({"ids": pd.Series([ids], dtype=object), "bads": [bads]} if leaves else {}))

    if leaves:
        spans = F.sequence(F.shiftright("at", SLOTS), F.shiftright(F.col("at") + F.col("n") - 1, SLOTS))
        nodes = nodes.withColumn("id", F.col("id").cast("string")).withColumn("block", F.explode(spans))
    else:
        nodes = nodes.withColumn("block", F.shiftright("at", SLOTS))
    return nodes.groupBy("tree", "block").applyInPandas(fill, schema)


def _up(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Tables of slot arrays from the bottom up, and rows tree, node of the trees' roots."""
    tables, done = [], 0
    while True:
        table = materialise(_arrays(nodes, done), name)
        tables.append(table)
        done += SLOTS
        most = table.agg(F.max("total")).first()[0]
        if most is None or _depth(most) <= done:
            return tables, table.select("tree", "node")
        nodes = table.select("tree", "total", F.col("block").alias("at"), F.lit(1).cast("long").alias("n"), "node")


def _steps(table: DataFrame, done: int, paths: DataFrame) -> DataFrame:
    """Paths (tree, at, path, root) of all slots of the arrays, given those of the arrays' own nodes."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = reduce_slots(row["slots"], max(0, min(SLOTS, _depth(row["total"]) - done)))
                n, first = len(row["slots"]), row["block"] << SLOTS
                above = row["path"].split() if row["path"] else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * n, pa.string()), pa.array(range(first, first + n), pa.int64()), pa.array([" ".join(slot_path(levels, i) + above) for i in range(n)], pa.string()), pa.array([row["root"]] * n, pa.string())],
                    names=["tree", "at", "path", "root"])

    joined = table.join(paths.withColumnRenamed("at", "block"), ["tree", "block"]).select("tree", "total", "block", "slots", "path", "root")
    return joined.mapInArrow(spread, "tree string, at long, path string, root string")


def _proofs(table: DataFrame, paths: DataFrame) -> DataFrame:
    """The result's rows from the arrays of leaves and the paths of these arrays' nodes."""
    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = reduce_slots(row["slots"], min(SLOTS, _depth(row["total"])))
                above = row["path"].split() if row["path"] else []
                rest = "".join(s.lstrip("<>.") for s in above)
                sound = fold(levels[-1][0], above)  # what every leaf of the array that is its own folds to
                proofs, folded = [], []
                for slot, bad in enumerate(row["bads"]):
                    path = slot_path(levels, slot)
                    proofs.append(digest(["".join(s.lstrip("<>.") for s in path), rest]))
                    folded.append(sound if bad is None else fold(bad, path + above))
                n = len(proofs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["slots"]), pa.array([row["subroot"]] * n), pa.array([row["root"]] * n), pa.array(proofs), pa.array(folded), pa.array([f == row["root"] for f in folded])],
                    names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    joined = table.join(paths.withColumnRenamed("at", "block"), ["tree", "block"])
    return joined.select("ids", "slots", "bads", "total", "path", "subroot", "root").mapInArrow(prove, schema)


def _numbered(roots: DataFrame) -> DataFrame:
    """Rows tree, node with at and total, by the bytes of tree: positions inside sorted ranges plus the ranges before."""
    place = F.monotonically_increasing_id()
    ranges = materialise(roots.repartitionByRange("tree").sortWithinPartitions("tree").select("tree", "node", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("inner")), "roots")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    parts = ranges.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return ranges.join(parts, "part").select("tree", "node", (F.col("skip") + F.col("inner")).alias("at"), "total")


def manifest(docs: DataFrame, tampered: Column, tampered_fields: dict[str, Column], id_col: str = "doc_id", group_col: str = "lang",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """One row for each row of docs: id_col, leaf, subroot, root, proof_sha256, folded_root and verified.

    Where ``tampered`` holds, ``tampered_fields`` replace fields of the row that is checked; root, proof and leaf stay
    those of the row as it is.  Ids are whole numbers.  See the module for nulls, ties and empty tables.
    """
    bad = F.when(F.coalesce(tampered, F.lit(False)), leaf_hash(*[tampered_fields.get(f, docs[f]) for f in fields]))
    tree = F.coalesce(F.concat(F.lit("="), docs[group_col].cast("string")), F.lit(""))
    leaves = docs.select(tree.alias("tree"), docs[id_col].cast("long").alias("id"), leaf_hash(*[docs[f] for f in fields]).alias("leaf"), bad.alias("bad"))
    leaves = leaves.withColumn("bad", F.when(F.col("bad") != F.col("leaf"), F.col("bad")))
    placed = coordinates(leaves.groupBy("tree", "id", "leaf", "bad").agg(F.count("*").alias("copies")))
    nodes = placed.select("tree", "id", F.col("leaf").alias("node"), "bad", F.col("copies").alias("n"), "at", "total")
    lower, subroots = _up(nodes, "slots")
    numbered = materialise(_numbered(subroots), "numbered")
    upper, root = _up(numbered.select(F.lit("").alias("tree"), "total", "at", F.lit(1).cast("long").alias("n"), "node"), "tops")
    paths = root.select("tree", F.lit(0).cast("long").alias("at"), F.lit("").alias("path"), F.col("node").alias("root"))
    for i in reversed(range(len(upper))):
        paths = _steps(upper[i], i * SLOTS, paths)
    tops = materialise(paths.select("at", "path", "root").join(numbered.drop("total"), "at"), "tops")
    paths = tops.select("tree", F.lit(0).cast("long").alias("at"), "path", "root")
    for i in reversed(range(1, len(lower))):
        paths = materialise(_steps(lower[i], i * SLOTS, paths), "paths")
    paths = paths.join(tops.select("tree", F.col("node").alias("subroot")), "tree")
    return _proofs(lower[0], paths).withColumnRenamed("id", id_col)
