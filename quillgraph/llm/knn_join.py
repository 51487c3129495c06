"""Exact top-k inner products by a Voronoi join.

Data vectors go to the nearest of a bounded number of pivots, queries to the nearest of fewer pivots of their own.
Each data group is summarised by its size, its radius and the distances of its few members nearest to the pivot.
From the summaries alone every query gets a lower bound of its k-th best score, and with

    p.q - |q| d(x, p)  <=  q.x  <=  p.q + |q| d(x, p)

every query group learns which data groups, and which vectors in them, can still matter.  Only those are copied to it,
in blocks of bounded size, solved locally, and the blocks' best merged.  Bounds decide what is copied, never what is
returned.  Groups over the block size (a hot pivot) are split by a hash of the id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

_NONE = -(1 << 62)  #: below every score
_SLACK = 1e-6  #: of bounds computed in floating point, relative


def quantise(vectors: DataFrame, query: Column, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Columns vec_id, v (floor(scale * x) of every component, 64-bit integers), dim, top (largest size) and asks.

    Rows without an id, and vectors that are null or hold null or non-finite components, are left out.  An empty vector
    takes part and scores 0 with every other.
    """
    x = F.col(vector_col).cast("array<double>")
    fine = F.col(vector_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("x")
            if not batch.num_rows:
                continue
            flat, sizes = col.flatten().to_numpy(zero_copy_only=False), np.diff(col.offsets.to_numpy())
            ints = np.floor(flat * scale).astype(np.int64)
            parts = np.split(ints, np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(sizes.astype(np.int32)),
                 pa.array([int(np.abs(p).max(initial=0)) for p in parts], pa.int64()), batch.column("asks")], names=["vec_id", "v", "dim", "top", "asks"])

    rows = vectors.filter(F.col(id_col).isNotNull()).filter(fine)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"), F.coalesce(query, F.lit(False)).alias("asks")).mapInArrow(
        run, "vec_id long, v binary, dim int, top long, asks boolean")


def _matrix(column: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim), np.int64)
    for i, b in enumerate(column):
        row = np.frombuffer(b, np.int64)
        out[i, :len(row)] = row
    return out


def best(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, exact_float: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, data ids, scores) of each query's k best of a block, its own row left out, ties to smaller ids."""
    order = np.argsort(data_ids, kind="stable")
    data, data_ids = data[order], data_ids[order]
    scores = (queries.astype(float) @ data.T.astype(float)).astype(np.int64) if exact_float else queries @ data.T
    scores[query_ids[:, None] == data_ids[None, :]] = _NONE
    top = np.argsort(-scores, axis=1, kind="stable")[:, :k] if scores.shape[1] <= 4 * k else _partial(scores, k)
    got = np.take_along_axis(scores, top, axis=1)
    real = got != _NONE
    return np.repeat(query_ids, real.sum(axis=1)), data_ids[top][real], got[real]


def _partial(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k largest, ties to the left: all above the k-th value, then the first that equal it."""
    kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    out = np.empty((len(scores), k), np.int64)
    for i, t in enumerate(kth):
        at = np.flatnonzero(scores[i] >= t)
        out[i] = at[np.argsort(-scores[i, at], kind="stable")[:k]]
    return out


def _spread(points: np.ndarray, n: int) -> list[int]:
    """n of the points, each the farthest from those before it."""
    chosen, far = [0], np.full(len(points), np.inf)
    while len(chosen) < n:
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(far.argmax()))
    return chosen


def top_k(vectors: DataFrame, query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
          most_pivots: int = 128, queries_per_group: int = 256, block: int = 8192, told: dict | None = None) -> DataFrame:
    """Columns query_id, rank (from 1), vec_id and score: each query row's k best other rows by integer inner product.

    Vectors of fewer components count as filled up with zeros.  Ties go to the smaller vec_id.  Fewer rows come back
    where there are fewer candidates.  Of rows that repeat an id one counts, that of the smallest bytes.  Sums must lie
    within 2**62.  Pivots and summaries are at most ``most_pivots`` rows, which bounds what is collected and broadcast.

    Where the bounds of small query groups prune less than merging the queries into parts of half a block saves, they
    are merged: then the data are copied once for each part.  ``told`` receives needed (the share of group and data pairs
    that the bounds leave) and copies (of data rows, at most).
    """
    spark = vectors.sparkSession
    every = materialise(quantise(vectors, query, scale, id_col, vector_col), "vectors")
    n, asked, dim, top, ids = every.agg(F.count("*"), F.count_if("asks"), F.max("dim"), F.max("top"), F.count_distinct("vec_id")).first()
    if n > ids:
        every = materialise(every.groupBy("vec_id").agg(F.min("v").alias("v"), F.bool_or("asks").alias("asks")), "vectors")
        n, asked = every.agg(F.count("*"), F.count_if("asks")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if not n or not asked:
        return spark.createDataFrame([], empty)
    exact_float = float(top) * float(top) * dim < 2.0 ** 53
    chosen = every.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(min(most_pivots, max(1, round(math.sqrt(n) / 2)))).collect()
    pivots = _matrix([bytes(r["v"]) for r in chosen], dim).astype(float)
    centres = pivots[_spread(pivots, max(1, min(len(pivots), -(-asked // queries_per_group))))]

    def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ to.T + (to * to).sum(axis=1), 0))

    sent = spark.sparkContext.broadcast((pivots, centres))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v").to_pylist(), dim).astype(float)
                far = distances(x, sent.value[0])
                own = distances(x, sent.value[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("v"), batch.column("asks"), pa.array(far.argmin(axis=1).astype(np.int32)), pa.array(far.min(axis=1)),
                     pa.array(own.argmin(axis=1).astype(np.int32)), pa.array(own.min(axis=1))], names=["vec_id", "v", "asks", "cell", "d", "ask_cell", "ask_d"])

    placed = materialise(every.select("vec_id", "v", "asks").mapInArrow(
        assign, "vec_id long, v binary, asks boolean, cell int, d double, ask_cell int, ask_d double"), "placed")

    def summarise(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: dict[int, np.ndarray] = {}
        size: dict[int, int] = {}
        far: dict[int, float] = {}
        for pdf in frames:
            for cell, d in pdf.groupby("cell")["d"]:
                near[cell] = np.sort(np.concatenate([near.get(cell, np.zeros(0)), d.to_numpy()]))[:k + 1]
                size[cell], far[cell] = size.get(cell, 0) + len(d), max(far.get(cell, 0.0), d.max())
        yield pd.DataFrame({"cell": list(near), "n": [size[c] for c in near], "radius": [far[c] for c in near], "near": [near[c].tolist() for c in near]})

    summary = placed.select("cell", "d").mapInPandas(summarise, "cell int, n long, radius double, near array<double>")
    summary = summary.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")).collect()
    cells = sorted(r["cell"] for r in summary)
    by = {r["cell"]: r for r in summary}
    sizes, radius = np.array([by[c]["n"] for c in cells]), np.array([by[c]["radius"] for c in cells])
    near = np.full((len(cells), k + 1), np.inf)
    for i, c in enumerate(cells):
        near[i, :len(by[c]["near"])] = by[c]["near"]
    around = spark.sparkContext.broadcast((pivots[cells], radius, near))

    def bound(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        points, r, close = around.value
        for pdf in frames:
            if not len(pdf):
                continue
            q = _matrix(pdf["v"].tolist(), dim).astype(float)
            dots, length = q @ points.T, np.sqrt((q * q).sum(axis=1))
            slack = _SLACK * (1 + np.abs(dots).max(axis=1) + length * r.max())
            low = np.nan_to_num((dots[:, :, None] - length[:, None, None] * close[None]).reshape(len(q), -1), nan=-np.inf)  # a zero query, a small cell
            kth = -np.sort(-low, axis=1)[:, min(k, low.shape[1] - 1)] if low.shape[1] > k else np.full(len(q), -np.inf)
            need = dots + length[:, None] * r >= (kth - slack)[:, None]
            rows, at = np.nonzero(need)
            yield pd.DataFrame({"ask_cell": pdf["ask_cell"].to_numpy()[rows], "at": at.astype(np.int32), "least": (kth - slack)[rows], "ask_d": pdf["ask_d"].to_numpy()[rows]})

    asks = placed.filter("asks")
    needs = asks.select("v", "ask_cell", "ask_d").mapInPandas(bound, "ask_cell int, at int, least double, ask_d double").groupBy("ask_cell", "at").agg(
        F.min("least").alias("least"), F.max("ask_d").alias("spread")).collect()
    counts = {r["ask_cell"]: r["n"] for r in asks.groupBy("ask_cell").agg(F.count("*").alias("n")).collect()}
    groups = sorted(counts)
    need, least, spread = np.zeros((len(groups), len(cells)), bool), np.full(len(groups), np.inf), np.zeros(len(groups))
    for r in needs:
        g = groups.index(r["ask_cell"])
        need[g, r["at"]], least[g], spread[g] = True, min(least[g], r["least"]), max(spread[g], r["spread"])
    group_of = np.zeros(len(centres), np.int64)
    group_of[groups] = np.arange(len(groups))
    ask_blocks = np.array([max(1, -(-counts[g] // (4 * queries_per_group))) for g in groups])
    copies, merged = int((need @ sizes) @ ask_blocks), max(1, -(-asked // (block // 2))) if block > 1 else asked
    if told is not None:
        told |= {"needed": float((need @ sizes).sum() / (len(groups) * sizes.sum())), "copies": min(copies, int(merged * sizes.sum()))}
    if copies > merged * sizes.sum():
        need, least, spread, ask_blocks, group_of = np.ones((1, len(cells)), bool), np.array([-np.inf]), np.zeros(1), np.array([merged]), group_of * 0
        groups = groups[:1]
    data_blocks = np.maximum(1, -(-(need @ sizes) // block))
    plan = spark.sparkContext.broadcast((np.array(cells), centres[groups], need, least, spread, data_blocks, ask_blocks, group_of))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Copies of each data vector for the query groups that need it, one for each block of their queries."""
        names, middles, wanted, floor, wide, blocks, parts, _ = plan.value
        for pdf in frames:
            for i in range(0, len(pdf), 2048):
                some = pdf.iloc[i:i + 2048]
                x = _matrix(some["v"].tolist(), dim).astype(float)
                length = np.sqrt((x * x).sum(axis=1))
                reach = x @ middles.T + length[:, None] * wide
                reach += _SLACK * (1 + np.abs(reach))
                rows, g = np.nonzero(wanted[:, np.searchsorted(names, some["cell"].to_numpy())].T & (reach >= floor))
                again = parts[g]
                rows, g = np.repeat(rows, again), np.repeat(g, again)
                part = np.concatenate([np.arange(a) for a in again]) if len(again) else np.zeros(0, int)
                ids = some["vec_id"].to_numpy()[rows]
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                yield pd.DataFrame({"g": g.astype(np.int32), "part": part.astype(np.int32), "blk": (mixed % blocks[g]).astype(np.int32), "vec_id": ids, "v": some["v"].to_numpy()[rows]})

    def spread_queries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Copies of each query for the data blocks of its group."""
        *_, blocks, parts, known = plan.value
        for pdf in frames:
            g = known[pdf["ask_cell"].to_numpy()]
            again = blocks[g]
            rows = np.repeat(np.arange(len(pdf)), again)
            ids = pdf["vec_id"].to_numpy()[rows]
            mixed = (ids.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(33)).astype(np.int64)
            blk = np.concatenate([np.arange(a) for a in again]) if len(again) else np.zeros(0, int)
            yield pd.DataFrame({"g": g[rows].astype(np.int32), "part": (mixed % parts[g[rows]]).astype(np.int32), "blk": blk.astype(np.int32), "vec_id": ids, "v": pdf["v"].to_numpy()[rows]})

    def solve(_: tuple, queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(data):
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("query_id", "vec_id", "score")})
        x, x_ids = _matrix(data["v"].tolist(), dim), data["vec_id"].to_numpy()
        got = [best(_matrix(part["v"].tolist(), dim), part["vec_id"].to_numpy(), x, x_ids, k, exact_float) for part in (queries.iloc[i:i + 256] for i in range(0, len(queries), 256))]
        return pd.DataFrame({c: np.concatenate([p[i] for p in got]) for i, c in enumerate(("query_id", "vec_id", "score"))})

    cell = "g int, part int, blk int, vec_id long, v binary"
    left = asks.select("vec_id", "v", "ask_cell").mapInPandas(spread_queries, cell)
    right = placed.select("vec_id", "v", "cell").mapInPandas(deal, cell)
    keys = ("g", "part", "blk")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
