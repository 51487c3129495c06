"""SimHash near-duplicate groups by the generalised pigeonhole principle.

Fingerprints of 64 bits are cut into partitions of correlated bits.  If two fingerprints differ in at most ``tau``
bits, then for any thresholds t_i >= -1 with sum(t_i + 1) = tau + 1 some partition differs in at most t_i bits
(-1: the partition is not looked at).  The thresholds are unequal: dynamic programming picks, among all allocations
and numbers of partitions, the one with the least estimated work (signature rows and candidate pairs).  Every
different fingerprint is indexed by its partitions' values, probes the values within t_i, and candidates are verified
on all 64 bits.  A value that many fingerprints share is split again by the pigeonhole on their other bits; what is
crowded even then is worked through in pairs of bounded blocks that return only a spanning forest of their links, so no
group emits all its pairs and no link between groups is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered, materialise, pieces, texts

BITS = 64
ROW_COST, PAIR_COST = 1.0, 0.03  #: of a shuffled signature and of a compared pair, relative to each other


def fingerprint(text: bytes, shingle: int = 4, block: int = 1 << 16) -> int:
    """SimHash of lower-cased UTF-8: majority bits of the XXH64 (seed 42) of all word shingles, zero without words."""
    words = text.split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[:len(words) - k + 1], ends[k - 1:]
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(starts), block):
        h = np.array([digest(joined[a:z], 42) for a, z in zip(starts[i:i + block].tolist(), ends[i:i + block].tolist())], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id and fp (the 64 bits as a signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                fps = np.array([fingerprint(t, shingle) for t in lowered(part.column("body"))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fps)], names=["id", "fp"])

    return texts(docs, id_col, text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


# --- the plan: partitions of bits and their thresholds

def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits 0 to 63 in ``parts`` groups of nearly equal width; a group grows by the bit most correlated with it."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(axis=0) if len(bits) else 0
    norm = np.sqrt((bits ** 2).sum(axis=0)) + 1e-9
    alike = np.abs(bits.T @ bits) / norm[:, None] / norm[None, :]
    np.fill_diagonal(alike, 0)
    left, groups = set(range(BITS)), []
    for g in range(parts):
        width = BITS // parts + (g < BITS % parts)
        pool = sorted(left)
        group = [max(pool, key=lambda b: alike[b, pool].max())]
        while len(group) < width:
            pool = [b for b in pool if b not in group]
            group.append(max(pool, key=lambda b: alike[b, group].sum()))
        left -= set(group)
        groups.append(sorted(group))
    return groups


def _within(sample: np.ndarray, group: list[int], most: int) -> np.ndarray:
    """Estimated share of pairs that differ in at most 0, 1, ... most bits of the group.

    Bits are taken as independent; where the sample itself shows enough such pairs, the larger share counts.
    """
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, group]
    p = bits.mean(axis=0) if len(bits) else np.full(len(group), 0.5)
    chance = np.zeros(len(group) + 1)
    chance[0] = 1
    for q in 2 * p * (1 - p):
        chance[1:] = chance[1:] * (1 - q) + chance[:-1] * q
        chance[0] *= 1 - q
    share = np.cumsum(chance)[:most + 1]
    few = sample[:2048]
    if len(few) > 1:
        mask = np.uint64(sum(1 << b for b in group))
        apart = np.bitwise_count((few[:, None] ^ few[None, :]) & mask)[np.triu_indices(len(few), 1)]
        seen = np.array([(apart <= t).sum() for t in range(most + 1)])
        share = np.where(seen >= 10, np.maximum(share, seen / len(apart)), share)
    return share


def _flips(group: list[int], t: int) -> list[tuple[int, int]]:
    """(bits to flip, lowest of them) for every choice of at most t bits of the group."""
    return [(sum(1 << b for b in c), 1 << c[0] if c else 0) for k in range(t + 1) for c in itertools.combinations(group, k)]


def allocate(sample: np.ndarray, total: int, tau: int) -> list[tuple[list[int], int]]:
    """The cheapest (group of bits, threshold) list for ``total`` fingerprints; thresholds are 0 or more.

    cost[i][t] of a partition is its signature rows plus its estimated candidate pairs; the table best[s] holds the
    least cost of the partitions so far that use up s of the tau + 1 units of sum(t_i + 1).
    """
    choice: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    for parts in range(2, tau + 2):
        groups = group_bits(sample, parts)
        best: dict[int, tuple[float, list[tuple[list[int], int]]]] = {0: (0.0, [])}
        for group in groups:
            share, then = _within(sample, group, min(tau, 3)), {}
            for used, (cost, plan) in best.items():
                for t in range(-1, min(tau - used, 3) + 1):
                    if used + t + 1 > tau + 1:
                        break
                    if t < 0:
                        more, plan2 = 0.0, plan
                    else:
                        rows = total * (1 + 1 + (len(_flips(group, t)) - 1) / 2)
                        more, plan2 = ROW_COST * rows + PAIR_COST * total * total / 2 * share[t], [*plan, (group, t)]
                    if used + t + 1 not in then or cost + more < then[used + t + 1][0]:
                        then[used + t + 1] = (cost + more, plan2)
            best = then
        if tau + 1 in best and best[tau + 1][0] < choice[0]:
            choice = best[tau + 1]
    return choice[1]


# --- links and components

def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _probe(part: int, key: Column) -> Callable[[Column], Column]:
    return lambda c: F.struct(F.lit(part).alias("part"), key.bitwiseXOR(c["flip"]).alias("key"))


def _signatures(fps: DataFrame, plan: list[tuple[list[int], int]]) -> tuple[DataFrame, DataFrame]:
    """Index rows (part, key, fp) and probe rows (part, key, fp): a probe's key differs in at most t_i bits.

    Of the two fingerprints of a pair, the one whose lowest differing bit is 0 probes; pairs with equal values in
    the partition meet by the probe that flips nothing.
    """
    index, probe = [], []
    for i, (group, t) in enumerate(plan):
        mask = F.lit(_signed(sum(1 << b for b in group)))
        key, flips = F.col("fp").bitwiseAND(mask), _flips(group, t)
        index.append(F.struct(F.lit(i).alias("part"), key.alias("key")))
        choices = F.array(*[F.struct(F.lit(_signed(a)).alias("flip"), F.lit(_signed(low)).alias("low")) for a, low in flips])
        mine = F.filter(choices, lambda c: F.col("fp").bitwiseAND(c["low"]) == 0) if t else choices
        probe.append(F.transform(mine, _probe(i, key)))
    return (
        fps.select("fp", F.explode(F.array(*index)).alias("s")).select("s.part", "s.key", "fp"),
        fps.select("fp", F.explode(F.flatten(F.array(*probe))).alias("s")).select("s.part", "s.key", F.col("fp").alias("other")),
    )


def forest(fps: np.ndarray, tau: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among fps, found by breadth-first search over rows of distances."""
    left, edges = np.ones(len(fps), bool), []
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            near = np.flatnonzero(left & (np.bitwise_count(fps ^ fps[i]) <= tau))
            left[near] = False
            edges += [(i, int(j)) for j in near]
            queue += near.tolist()
    return edges


def _split(members: DataFrame, plan: list[tuple[list[int], int]], tau: int) -> DataFrame:
    """Members (part, key, fp) of crowded values by the bits outside their partition, in tau + 1 pieces: two members that link
    agree in one of them.  Columns part, key, sub, value and fp, tau + 1 rows a member."""
    rest = [[b for b in range(BITS) if b not in group] for group, _ in plan]
    masks = F.array(*[F.array(*[F.lit(_signed(sum(1 << b for b in bits[i::tau + 1]))) for i in range(tau + 1)]) for bits in rest])
    each = members.select("part", "key", "fp", F.posexplode(F.element_at(masks, F.col("part") + 1)).alias("sub", "mask"))
    return each.select("part", "key", "sub", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "fp")


def _blocked_links(members: DataFrame, sizes: DataFrame, keys: list[str], tau: int, block: int) -> DataFrame:
    """Links within the groups of ``sizes`` (keys, n), each a spanning forest of two blocks of about ``block`` members."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(pdf["fp"].to_numpy(np.int64)).view(np.uint64)
        edges = forest(fps, tau)
        a, b = ([e[k] for e in edges] for k in (0, 1))
        return pd.DataFrame({"a": fps[a].view(np.int64), "b": fps[b].view(np.int64)}) if edges else pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="int64")})

    n = F.ceil(F.col("n") / F.lit(block)).cast("int")
    mine = members.join(sizes, keys).withColumn("blocks", n).withColumn("x", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    dealt = mine.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return (
        dealt.select(*keys, F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi"), "fp")
        .groupBy(*keys, "lo", "hi").applyInPandas(solve, "a long, b long")
    )


def _dense_links(members: DataFrame, plan: list[tuple[list[int], int]], tau: int, dense: int) -> DataFrame:
    """Links of crowded values' members (part, key, fp).

    They are split again by the pigeonhole on their other bits, which adds tau + 1 rows a member; what agrees in a
    further piece is compared in a join, and only what is crowded even there, which is a cluster of fingerprints that
    are nearly all alike, goes through pairs of blocks.
    """
    keys = ["part", "key", "sub", "value"]
    split = materialise(_split(members, plan, tau), "split")
    sizes = materialise(split.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    few = split.join(sizes.filter(F.col("n") <= dense).select(*keys), keys)
    other = few.withColumnRenamed("fp", "other")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    found = few.join(other, keys).filter((F.col("fp") < F.col("other")) & (apart <= tau)).select(F.col("fp").alias("a"), F.col("other").alias("b"))
    return found.unionByName(_blocked_links(split, sizes.filter(F.col("n") > dense), keys, tau, dense))


def links(fps: DataFrame, tau: int = 4, dense: int = 1024, sample_rows: int = 8192) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints at most ``tau`` bits apart.

    ``fps`` has one row for each different fingerprint in column fp.  A value is crowded that more than ``2 * dense``
    index and probe rows share.  All pairs are returned but for those of crowded groups, of which a spanning forest is;
    components are the same.  The plan
    is drawn from at most ``sample_rows`` fingerprints; it changes only the work done.
    """
    total = fps.count()
    sample = np.array([r["fp"] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(sample_rows).collect()], np.int64).view(np.uint64)
    plan = allocate(sample, total, tau)
    index, probe = _signatures(fps, plan)
    members = index.unionByName(probe.withColumnRenamed("other", "fp"))
    sizes = materialise(members.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * dense).select("part", "key"), "dense")
    crowded = not sizes.isEmpty()
    if crowded:
        more = _dense_links(members.join(sizes, ["part", "key"], "left_semi").distinct(), plan, tau, dense)
        index, probe = (x.join(sizes, ["part", "key"], "left_anti") for x in (index, probe))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other")))
    found = index.join(probe, (index["part"] == probe["part"]) & (index["key"] == probe["key"]) & (F.col("fp") != F.col("other")) & (apart <= tau))
    found = found.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b"))
    return (found.unionByName(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))) if crowded else found).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns node and root (the smallest node reachable) for every node of the edges (a, b).

    Alternating large-star and small-star steps; every step is a table, so a lost executor costs one step at most.
    Minima are taken by aggregates that combine before the shuffle, and a node with many edges meets them in a join
    whose large partitions Spark can split.
    """
    def minima(e: DataFrame) -> DataFrame:
        return materialise(e.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "minima")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialise(both.join(minima(both), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = minima(large)
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialise(small.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_groups(docs: DataFrame, tau: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", dense: int = 1024) -> DataFrame:
    """One row for each row of docs: id_col, fingerprint (16 hex digits) and component_id.

    component_id is the smallest id reachable over links of at most ``tau`` differing bits.  Null and empty texts,
    and texts of white space, have fingerprint zero and link like any other.  Equal fingerprints are one node.  Null
    ids never name a component unless all its ids are null.  An empty table gives an empty result.
    """
    each = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    fps = materialise(each.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    roots = components(links(fps.select("fp"), tau, dense))
    named = fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = materialise(named, "named")
    names = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    named = materialise(named.join(names, "root").select("fp", "component_id"), "components")
    return each.join(named, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, tau: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest id.  Rows of a null id stay.

    Rows that share an id are one document: they stay together where one of them stays.
    """
    mine = near_groups(docs, tau, shingle, id_col, text_col).filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_gone"))
    gone = mine.agg(F.max(F.col(id_col) == F.col("component_id")).alias("stays")).filter(~F.col("stays")).select("_gone")
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
