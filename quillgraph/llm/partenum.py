"""Jaccard join of word-shingle sets by PartEnum signatures.

Sets of similar size are put into bands, each in its own and the next, so that every pair that can link meets in the band
of its larger set.  There two sets of similarity s differ in at most k = (1 - s) / (1 + s) * (|a| + |b|) elements.  The
domain of shingles is cut into n1 parts with n1 * (k2 + 1) > k, so one part differs in at most k2 elements; each part is
cut into n2 cells, of which n2 - k2 are then equal.  A signature is the projection of a set on one such choice of cells: similar
sets share one.  There are ``spare`` parts more than that takes, so similar sets share a signature in spare + 1 parts; a
set with at most so many parts where a choice of cells is empty need not give its empty projections, which unlike sets
would share.  Parts and cells are chosen for each band by the estimated cost of signatures and of chance meetings among as
many sets as the band holds, so that projections grow with the table.

Sets that share a signature are candidates, not links.  They are screened by odd sketches (a bit for the parity of every
bucket; two sets differ in at least as many elements as their sketches in bits, so no link is lost) and verified on the
whole sets.  First every set is compared with a few leaders of its runs, in rounds with other leaders each, which joins nearly
all that belongs together; what is left is to compare, inside a run, the sets outside its largest component with all sets
of other components, in blocks.  Equal sets are one node throughout.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowered, materialise, pieces, texts
from .simhash import components

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
PAIR_COST = 0.6  #: of a chance meeting, relative to a signature
OUTLIERS = 0.01  #: share of sets, about, that give their empty projections too
BUCKET_BYTES = 16 << 20  #: of signatures and nodes that one task groups at once
ROUNDS = 1  #: at most, of comparing with leaders; each costs about as many small stages as the whole rest
LEADERS = 2  #: sets of a run that the others are compared with first
CACHE = 1 << 20  #: words whose hashes a task keeps


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes; a word is hashed once, shingles are combined from words' hashes."""

    def __init__(self, size: int) -> None:
        self.size, self.known = size, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHE:
            self.known.clear()
        known, digest = self.known, xxhash.xxh64_intdigest
        for w in set(words):
            if w not in known:
                known[w] = digest(w, 12)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(words))
        out = np.full(len(words) - k + 1, np.uint64(k))
        for i in range(k):
            out = mixed(out * _M1 + hashes[i:i + len(out)])
        return np.unique(out)


# --- bands and their parameters

@dataclass(frozen=True)
class Plan:
    """A band's signatures: first-level parts, cells of each, how many cells a signature leaves out, and spare parts."""

    parts: int
    cells: int
    left_out: int
    spare: int

    def signatures(self) -> int:
        return self.parts * math.comb(self.cells, self.left_out)


class Bands:
    """Ranges of set sizes: a linkable pair is in one band or in two neighbours.

    Band i holds sizes from first[i] to first[i + 1] - 1; the next one begins where a set is too large to link with the
    smallest of this one.
    """

    def __init__(self, least: tuple[int, int] = (4, 5), most: int = 1 << 40) -> None:
        self.num, self.den = least
        self.first = [1]
        while self.first[-1] < most:
            self.first.append(self.first[-1] * self.den // self.num + 1)

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.first, n, side="right")) - 1

    def differences(self, band: int) -> int:
        """Most elements in which two linked sets can differ whose larger one is in the band."""
        return (self.den - self.num) * 2 * (self.first[band + 1] - 1) // (self.den + self.num)

    def plan(self, band: int, sets: int) -> Plan:
        """The plan of least estimated cost for so many sets."""
        k, usual = self.differences(band), self.first[band]
        best: tuple[float, Plan] = (math.inf, Plan(1, 1, 0, 0))
        for k2 in range(min(k, 4) + 1):
            for n2 in range(k2 + 1, 2 * k2 + 4 if k2 else 2):
                plan = self.spared(k, k2, n2, usual)
                givers = OUTLIERS if plan.spare else 1.0
                met = (givers * math.exp(-usual / plan.parts * (n2 - k2) / n2)) ** 2  # both give an empty projection
                cost = plan.signatures() * (sets + PAIR_COST * met * float(sets) ** 2 / 2)
                if cost < best[0]:
                    best = (cost, plan)
        return best[1]

    @staticmethod
    def spared(k: int, k2: int, n2: int, usual: int) -> Plan:
        """The plan with as few spare parts as leave OUTLIERS of sets of the usual size with more parts than those where a
        choice of cells is empty; without spare parts where sets are too small for any."""
        least = k // (k2 + 1) + 1
        for spare in range(least + 3 if k else 0):
            parts = least + spare
            mean = parts * math.comb(n2, k2) * math.exp(-usual / parts * (n2 - k2) / n2)
            term = inside = math.exp(-mean)
            for i in range(1, spare + 1):
                term *= mean / i
                inside += term
            if 1 - inside <= OUTLIERS:
                return Plan(parts, n2, k2, spare)
        return Plan(least, n2, k2, 0)


def _salt(band: int) -> np.uint64:
    return np.uint64((band + 1) * int(_M1) & (1 << 64) - 1)


def signatures(found: np.ndarray, band: int, plan: Plan) -> np.ndarray:
    """The set's signatures in a band: a hash of (band, part, choice of cells, elements in these cells)."""
    n1, n2 = plan.parts, plan.cells
    y = mixed(found ^ _salt(band))
    cell = (y % np.uint64(n1)).astype(np.int64) * n2 + ((y >> np.uint64(40)) % np.uint64(n2)).astype(np.int64)
    sums, held = np.zeros(n1 * n2, np.uint64), np.bincount(cell, minlength=n1 * n2).reshape(n1, n2)
    np.add.at(sums, cell, mixed(y + _M1))
    choices = np.array(list(itertools.combinations(range(n2), n2 - plan.left_out)))
    projected = sums.reshape(n1, n2)[:, choices].sum(axis=2, dtype=np.uint64).ravel()
    out = mixed(projected + np.arange(len(projected), dtype=np.uint64) * _M3 + _salt(band))
    empty = held[:, choices].sum(axis=2) == 0
    return out[~empty.ravel()] if int(empty.any(axis=1).sum()) <= plan.spare else out


def odd_sketch(found: np.ndarray) -> bytes:
    """Parities of the elements' buckets, one bit or more an element, a power of two in all."""
    bits = 1 << max(6, int(len(found) - 1).bit_length())
    odd = np.bincount((mixed(found + _M2) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch at a smaller power of two: parities of joined buckets."""
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


# --- candidates

def _nodes(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Columns id, node (hash of the set; null for none), n (its size) and its odd sketch for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for batch in batches:
            for part in pieces(batch):
                sets = [shingles(t) for t in lowered(part.column("body"))]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([odd_sketch(s) for s in sets], pa.binary())], names=["id", "node", "n", "sketch"])

    return texts(docs, id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, node long, n long, sketch binary")


def node(found: np.ndarray) -> int | None:
    return xxhash.xxh64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None


def _packed(docs: DataFrame, size: int, text_col: str, bands: Bands, plans: dict[int, Plan], buckets: int) -> DataFrame:
    """Rows bucket, sigs and nodes: signatures (their low 32 bits) of many sets and the sets they are of, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, done = Shingler(size), set()
        for batch in batches:
            for part in pieces(batch, 4 << 20):
                sigs, nodes = [], []
                for text in lowered(part.column("body")):
                    found = shingles(text)
                    name = node(found)
                    if name is None or name in done:
                        continue
                    if len(done) < CACHE:  # copies of one task
                        done.add(name)
                    for band in (bands.of(len(found)), bands.of(len(found)) + 1):
                        sigs.append(signatures(found, band, plans[band]))
                        nodes.append(np.full(len(sigs[-1]), name, np.int64))
                if not sigs:
                    continue
                sig, who = np.concatenate(sigs), np.concatenate(nodes)
                bucket = ((sig >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                sig, who, bucket = sig[order].astype(np.uint32), who[order], bucket[order]
                ends = np.flatnonzero(np.diff(bucket, append=-1)) + 1
                starts = np.concatenate(([0], ends[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[starts]), pa.array([sig[a:z].tobytes() for a, z in zip(starts, ends)], pa.binary()), pa.array([who[a:z].tobytes() for a, z in zip(starts, ends)], pa.binary())],
                    names=["bucket", "sigs", "nodes"])

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("body")).mapInArrow(run, "bucket long, sigs binary, nodes binary")


def _runs(packed: DataFrame) -> DataFrame:
    """Rows run and node: signatures that at least two different sets share, and these sets."""

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(pdf["sigs"]), np.uint32)
        who = np.frombuffer(b"".join(pdf["nodes"]), np.int64)
        order = np.lexsort((who, sig))
        sig, who = sig[order], who[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (who[1:] != who[:-1])
        sig, who = sig[new], who[new]
        same = sig[1:] == sig[:-1]
        many = np.zeros(len(sig), bool)
        many[1:] |= same
        many[:-1] |= same
        run = mixed(sig[many].astype(np.uint64) + (np.uint64(key[0]) << np.uint64(32))).view(np.int64)
        return pd.DataFrame({"run": run, "node": who[many]})

    return packed.groupBy("bucket").applyInPandas(group, "run long, node long")


# --- verification

def _sets(docs: DataFrame, holders: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """Columns node and found (the set) of the nodes of ``holders``, which has an id (_holder) for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                sets = [shingles(t) for t in lowered(part.column("body"))]
                yield pa.RecordBatch.from_arrays([pa.array([node(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "found"])

    rows = docs.join(holders, docs[id_col].eqNullSafe(holders["_holder"]), "left_semi").select(F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return rows.mapInArrow(run, "node long, found binary").join(holders.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _screened(pairs: DataFrame, names: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that can link by their sizes and sketches."""

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column("n").to_pylist(), batch.column("m").to_pylist()
            keep = [
                apart(s, t) * (den + num) <= (den - num) * (x + y)
                for x, y, s, t in zip(n, m, batch.column("s").to_pylist(), batch.column("t").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = names.select(F.col("node").alias("a"), "n", F.col("sketch").alias("s"))
    right = names.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("t"))
    near = pairs.join(left, "a").join(right, "b").filter(f"{num} * greatest(n, m) <= {den} * least(n, m)")
    return near.select("a", "b", "n", "m", "s", "t").mapInArrow(screen, "a long, b long")


def _linked(close: DataFrame, names: DataFrame, docs: DataFrame, size: int, id_col: str, text_col: str, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link, by the whole sets; texts are read again for the nodes of these pairs alone."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [links(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), num, den) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    asked = close.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    holders = materialise(names.join(asked, "node", "left_semi").select("node", F.col("least").alias("_holder")), "holders")
    sets = materialise(_sets(docs, holders, size, id_col, text_col), "found")
    whole = close.join(sets.select(F.col("node").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("found").alias("y")), "b")
    return whole.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


def apart(s: bytes, t: bytes) -> int:
    """Bits in which two odd sketches differ, at the smaller one's width: no more than the sets differ in elements."""
    x, y = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())


def links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if den * len(a) < num * len(b):
        return False
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _open(runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows run, node, root of the runs that hold more than one component, runs of equal sets once."""
    named = runs.join(labels, "node", "left").select("run", "node", F.coalesce("root", "node").alias("root"))
    mark = F.struct(F.sum(F.xxhash64("node").cast("decimal(38,0)")), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")), F.count("*"))
    sizes = named.groupBy("run").agg(F.min("root").alias("low"), F.max("root").alias("high"), mark.alias("mark"))
    return named.join(sizes.filter("low <> high").groupBy("mark").agg(F.min("run").alias("run")).select("run"), "run")


def _led(rows: DataFrame, seed: int) -> DataFrame:
    """Pairs of each set of a run (run, node, root) with its leaders of other components: the run's least nodes under a few
    orders, which are the same for all runs."""
    orders = [F.struct(F.xxhash64("node", F.lit(seed + i)).alias("by"), "node", "root") for i in range(LEADERS)]
    leaders = rows.groupBy("run").agg(F.array_distinct(F.array(*[F.min(o) for o in orders])).alias("leaders"))
    each = rows.join(leaders, "run").select("node", "root", F.explode("leaders").alias("leader")).filter("root <> leader.root")
    return each.select(F.least("node", "leader.node").alias("a"), F.greatest("node", "leader.node").alias("b")).distinct()


def _left(rows: DataFrame, names: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Pairs of one run, of different components and close by their sketches.

    Sets outside a run's largest component are dealt to its columns, all its sets to its rows; a row block meets a column
    block in one group, so a run costs its sets times the column blocks, not the square of its size.
    """
    parts = rows.groupBy("run", "root").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("run").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    sizes = sizes.filter("n > 2").select("run", F.col("most.root").alias("main"), blocks(F.col("n")).alias("rows"), blocks(F.col("n") - F.col("most.n")).alias("columns"))
    dealt = rows.join(sizes, "run")
    place = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    upto = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    down = dealt.select("run", place("rows").alias("lo"), upto("columns").alias("hi"), "node", "root", F.lit(False).alias("column"))
    across = dealt.filter("root <> main").select("run", upto("rows").alias("lo"), place("columns").alias("hi"), "node", "root", F.lit(True).alias("column"))
    dealt = down.unionByName(across).join(names.select("node", "n", "sketch"), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            a, b = [], []
            for run, lo, hi, *row in zip(*[batch.column(c).to_pylist() for c in ("run", "lo", "hi", "node", "root", "n", "sketch", "column")]):
                if (run, lo, hi) != last:
                    _near(held, num, den, a, b)
                    held, last = [], (run, lo, hi)
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        a, b = [], []
        _near(held, num, den, a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keys = ["run", "lo", "hi"]  # small groups, many to a task: they are read one after the other as they are sorted
    grouped = dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "node", "root", "n", "sketch", "column")
    return grouped.mapInArrow(compare, "a long, b long").distinct()


def _near(rows: list[list], num: int, den: int, a: list[int], b: list[int]) -> None:
    """Adds the pairs of different roots that can link by their sketches, of a column's and any set (node, root, n, sketch, column)."""
    if len({r[1] for r in rows}) < 2:
        return
    sketches = [np.frombuffer(r[3], np.uint64) for r in rows]
    words = min(map(len, sketches))
    bits = np.stack([folded(s, words) for s in sketches])
    root, n, column = np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[4] for r in rows])
    down = np.flatnonzero(~column)
    for i in np.flatnonzero(column).tolist():
        differ = np.bitwise_count(bits[down] ^ bits[i]).sum(axis=1, dtype=np.int64)
        for j in down[(differ * (den + num) <= (den - num) * (n[down] + n[i])) & (root[down] != root[i])].tolist():
            x, y = rows[i][0], rows[j][0]
            a.append(min(x, y))
            b.append(max(x, y))


def jaccard_groups(docs: DataFrame, least: tuple[int, int] = (4, 5), size: int = 5, id_col: str = "doc_id", text_col: str = "text", block: int = 128) -> DataFrame:
    """One row for each row of docs: id_col, n_shingles (size of its set) and component_id, the smallest id reachable over
    links of similarity ``least`` (numerator, denominator) or more.

    Texts with fewer than ``size`` words are one shingle, their whole sequence.  Null and empty texts, and texts of white
    space, have an empty set, which links with nothing: their component is their own id.  Texts of one set, copies too, are linked.  Rows that share an
    id stay rows of their own.  Null ids never name a component unless all its ids are null.  An empty table gives no rows.
    """
    num, den = least
    bands = Bands(least)
    each = materialise(_nodes(docs, size, id_col, text_col), "nodes")
    known = each.filter("node is not null").groupBy("node").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    names = materialise(known, "sets")
    # a histogram of sizes by powers of 2^(1/8): as many rows whatever the table
    steps = names.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count("*").alias("sets"), F.max("n").alias("n")).collect()
    held: dict[int, int] = {}
    for row in steps:
        for band in (bands.of(row["n"]), bands.of(row["n"]) + 1):
            held[band] = held.get(band, 0) + row["sets"]
    plans = {band: bands.plan(band, held.get(band, 1)) for band in range(bands.of(max((r["n"] for r in steps), default=1)) + 2)}
    total = sum(12 * held[b] * plans[b].signatures() for b in held)
    packed = _packed(docs, size, text_col, bands, plans, max(1, -(-total // BUCKET_BYTES)))
    runs = materialise(_runs(packed), "runs")
    more = (names, docs, size, id_col, text_col, num, den)
    found = docs.sparkSession.createDataFrame([], "a long, b long")
    left = materialise(_open(runs, docs.sparkSession.createDataFrame([], "node long, root long")), "open")
    for turn in range(ROUNDS):
        new = materialise(_linked(materialise(_screened(_led(left, turn * LEADERS), names, num, den), "close"), *more), "links")
        if new.isEmpty():
            break
        found = found.unionByName(new)
        left = materialise(_open(left.select("run", "node"), materialise(components(found), "labels")), "open")
    found = found.unionByName(materialise(_linked(materialise(_left(left, names, num, den, block), "close"), *more), "links"))
    roots = components(found)
    named = names.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = materialise(named, "named")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    return each.join(named, "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
