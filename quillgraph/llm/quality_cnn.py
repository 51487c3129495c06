"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  Bytes are embedded, learned filters of
eight bytes slide over every chunk in hops of two, and each filter's largest response in a chunk is kept.  The
document's features are the largest, the mean and the least of these over its chunks, and its length; a small dense
layer combines them into one probability.  The network is fitted on a bounded sample of labelled rows and scores all rows in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, pieces, texts

CHUNK, STRIDE = 256, 192  #: bytes of a chunk, and from one chunk's start to the next
HOP, TAPS = 2, 4  #: a filter sees TAPS patches of HOP bytes
EMBED, FILTERS, HIDDEN = 8, 24, 24
FEATURES = 3 * FILTERS + 2
PAD = 256  #: the value of places after a text's end; its embedding stays zero


@dataclass
class Network:
    """Weights; about 12,000 numbers, whatever the size of the corpus."""

    embed: np.ndarray  # [257, EMBED]
    conv: np.ndarray  # [HOP * EMBED, TAPS * FILTERS]
    bias: np.ndarray  # [FILTERS]
    dense: np.ndarray  # [FEATURES, HIDDEN]
    dense_bias: np.ndarray  # [HIDDEN]
    head: np.ndarray  # [HIDDEN]
    head_bias: np.ndarray  # [1]

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.conv, self.bias, self.dense, self.dense_bias, self.head, self.head_bias]


def start(seed: int = 7) -> Network:
    r = np.random.default_rng(seed)
    draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
    embed = draw(257, EMBED, scale=0.5)
    embed[PAD] = 0
    return Network(
        embed, draw(HOP * EMBED, TAPS * FILTERS, scale=(HOP * EMBED * TAPS) ** -0.5 * 2), np.zeros(FILTERS, np.float32),
        draw(FEATURES, HIDDEN, scale=FEATURES ** -0.5), np.zeros(HIDDEN, np.float32), draw(HIDDEN, scale=HIDDEN ** -0.5), np.zeros(1, np.float32))


def chunks(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(chunks [n, CHUNK] of byte values, first chunk of each text); every byte is in a chunk, an empty text has one."""
    counts = np.array([1 + max(0, -(-(len(b) - CHUNK) // STRIDE)) for b in bodies], np.int64)
    firsts = np.concatenate(([0], np.cumsum(counts)))[:-1]
    out = np.full((int(counts.sum()), CHUNK), PAD, np.uint16)
    for b, first, n in zip(bodies, firsts.tolist(), counts.tolist()):
        flat = np.full((n - 1) * STRIDE + CHUNK, PAD, np.uint16)
        flat[:len(b)] = np.frombuffer(b, np.uint8)
        out[first:first + n] = np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::STRIDE]
    return out, firsts


def pooled(net: Network, block: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """[chunks, FILTERS] largest rectified responses, and where they are, if asked for."""
    patches = net.embed[block].reshape(len(block), CHUNK // HOP, HOP * EMBED)
    responses = patches @ net.conv
    places = CHUNK // HOP - TAPS + 1
    total = responses[:, :places, :FILTERS].copy()
    for tap in range(1, TAPS):
        total += responses[:, tap:tap + places, tap * FILTERS:(tap + 1) * FILTERS]
    if where:
        at = total.argmax(axis=1)
        top = np.take_along_axis(total, at[:, None], axis=1)[:, 0]
    else:
        at, top = None, total.max(axis=1)
    return np.maximum(top + net.bias, 0), at


def document(tops: np.ndarray, firsts: np.ndarray, bodies: list[bytes]) -> np.ndarray:
    """[texts, FEATURES]: the chunks' largest responses pooled three ways, how far the first chunk is filled, and log length."""
    counts, sizes = np.diff(np.append(firsts, len(tops))), np.array([len(b) for b in bodies], np.float32)
    extent = np.stack([np.minimum(sizes / CHUNK, 1), np.log1p(sizes) / 10], axis=1)
    return np.concatenate([np.maximum.reduceat(tops, firsts), np.add.reduceat(tops, firsts) / counts[:, None].astype(np.float32), np.minimum.reduceat(tops, firsts), extent], axis=1).astype(np.float32)


def score(net: Network, bodies: list[bytes], block: int = 128) -> np.ndarray:
    """Probability of label 1 for each text, from all its chunks."""
    if not bodies:
        return np.zeros(0)
    all_chunks, firsts = chunks(bodies)
    tops = np.concatenate([pooled(net, all_chunks[i:i + block])[0] for i in range(0, len(all_chunks), block)])
    features = document(tops, firsts, bodies)
    hidden = np.maximum(features @ net.dense + net.dense_bias, 0)
    return 1 / (1 + np.exp(-np.clip(hidden @ net.head + net.head_bias, -30, 30).astype(float)))


def _gradients(net: Network, bodies: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean log loss over one batch of whole texts.  Max-pooling sends a chunk's error to one window a filter."""
    every, firsts = chunks(bodies)
    ends = np.append(firsts, len(every))
    counts = np.diff(ends)
    parts = [pooled(net, every[i:i + 128], True) for i in range(0, len(every), 128)]
    tops, at = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    features = document(tops, firsts, bodies)
    pre = features @ net.dense + net.dense_bias
    hidden = np.maximum(pre, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ net.head + net.head_bias, -30, 30)))
    d_logit = ((p - labels) / len(labels)).astype(np.float32)
    d_hidden = d_logit[:, None] * net.head * (pre > 0)
    d_features = d_hidden @ net.dense.T
    owner = np.repeat(np.arange(len(bodies)), counts)
    d_tops = d_features[owner, FILTERS:2 * FILTERS] / counts[owner, None]
    for k in (0, 2):  # the largest and the least: the error goes to the chunk that holds it, shared among equals
        there = tops == features[owner, k * FILTERS:(k + 1) * FILTERS]
        d_tops = d_tops + d_features[owner, k * FILTERS:(k + 1) * FILTERS] * there / np.maximum(1, np.add.reduceat(there.astype(np.int32), firsts))[owner]
    d_tops = d_tops * (tops > 0)
    rows, filters = np.nonzero(d_tops)
    errors = d_tops[rows, filters].astype(np.float32)
    windows = every[rows[:, None], at[rows, filters][:, None] * HOP + np.arange(HOP * TAPS)]
    seen = net.embed[windows]  # [k, 8, EMBED]
    by_filter = net.conv.reshape(HOP * EMBED, TAPS, FILTERS).transpose(2, 1, 0).reshape(FILTERS, TAPS * HOP * EMBED)
    d_filter = np.zeros((FILTERS, TAPS * HOP * EMBED), np.float32)
    np.add.at(d_filter, filters, errors[:, None] * seen.reshape(len(rows), -1))
    d_embed = np.zeros_like(net.embed)
    np.add.at(d_embed, windows.ravel(), (errors[:, None] * by_filter[filters]).reshape(-1, EMBED))
    d_embed[PAD] = 0
    return [
        d_embed, d_filter.reshape(FILTERS, TAPS, HOP * EMBED).transpose(2, 1, 0).reshape(HOP * EMBED, TAPS * FILTERS),
        d_tops.sum(axis=0).astype(np.float32), features.T.astype(np.float32) @ d_hidden, d_hidden.sum(axis=0), hidden.T @ d_logit, d_logit.sum(keepdims=True)]


def fit(bodies: list[bytes], labels: list[int], epochs: int = 6, batch: int = 24, rate: float = 4e-3, least_steps: int = 300, seed: int = 7) -> Network | float:
    """A fitted network, or a constant probability where the sample is empty or holds one label only.

    Small samples are gone over more often, until there are ``least_steps`` steps.
    """
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return float((y.sum() + 0.5) / (len(y) + 1))
    net, r = start(seed), np.random.default_rng(seed)
    first = [np.zeros_like(a) for a in net.arrays()]
    second = [np.zeros_like(a) for a in net.arrays()]
    each = -(-len(y) // batch)
    epochs = max(epochs, -(-least_steps // each))
    step, steps = 0, epochs * each
    for _ in range(epochs):
        order = r.permutation(len(y))
        for i in range(0, len(y), batch):
            pick = order[i:i + batch]
            step += 1
            now = rate * (1 - step / (steps + 1))
            for a, g, m, v in zip(net.arrays(), _gradients(net, [bodies[j] for j in pick], y[pick]), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, fold: Column, label_col: str = "quality", rows: int = 4000, text_bytes: int = 1 << 16,
          epochs: int = 6, id_col: str = "doc_id", text_col: str = "text") -> Network | float:
    """Fit on at most ``rows`` labelled rows of the folds where ``fold`` is true, texts of at most ``text_bytes`` bytes.

    These two parameters bound what reaches the driver.  Inputs are the texts' bytes alone.
    """
    sample = labelled_sample(docs, labels, label_col, fold, rows, text_bytes, id_col, text_col)
    got = sorted((r["_id"], r["label"], r["body"].encode()) for r in sample.collect())
    return fit([x[2] for x in got], [x[1] for x in got], epochs)


def scores(docs: DataFrame, net: Network | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (probability of label 1) for every row; null and empty texts are scored as one blank chunk.

    Repeated rows get equal scores, null ids stay null, an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                bodies = part.column("body").cast(pa.binary()).to_pylist()
                p = np.full(len(bodies), sent.value) if isinstance(sent.value, float) else score(sent.value, bodies)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(p, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts(docs, id_col, text_col).mapInArrow(run, f"id {kind}, score double").select(F.col("id").alias(id_col), "score")


def drop_low_quality(docs: DataFrame, net: Network | float, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the rows that score under ``least``; columns as they were."""
    sent, names, at = docs.sparkSession.sparkContext.broadcast(net), docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sized = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(at).cast(pa.binary()).fill_null(b"")], names=["row", "body"])
            for part in pieces(sized, 2 << 20):
                bodies = part.column("body").to_pylist()
                p = np.full(len(bodies), sent.value) if isinstance(sent.value, float) else score(sent.value, bodies)
                whole = batch.slice(part.column("row")[0].as_py(), part.num_rows)
                yield whole.filter(pa.array(p >= least)).rename_columns(names)

    return docs.mapInArrow(run, docs.schema)
