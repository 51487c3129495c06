"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its lower-cased words, pairs of neighbouring words and pairs of words
with one word between them.  FTRL-proximal gives every coordinate its own learning rate and keeps a weight at zero
until its evidence outgrows the L1 penalty, so the fitted model is a short list of (hash, weight), which is what is
broadcast: its length is at most the number of features that the bounded sample holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, lowered, pieces, texts

SPACE_BITS = 22  #: hashed features fall into 2**SPACE_BITS coordinates
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_EDGE = b".,;:!?\"'()[]{}<>*#$%&|-_"  #: marks cut from the ends of words, so that "word.***" is "word"


def features(text: bytes, skips: bool = True) -> np.ndarray:
    """Distinct hashed features of a lower-cased text: words, word pairs and, if asked for, skip-grams of one gap."""
    h = np.array([crc32(w.strip(_EDGE)) for w in text.split()], np.uint64)
    all_hashes = [h * np.uint64(0xFF51AFD7ED558CCD)]
    if len(h) > 1:
        all_hashes.append((h[:-1] * _PAIR) ^ (h[1:] + np.uint64(1)) * np.uint64(0x165667B19E3779F9))
    if skips and len(h) > 2:
        all_hashes.append((h[:-2] * _SKIP) ^ (h[2:] + np.uint64(2)) * np.uint64(0x27D4EB2F165667C5))
    return np.unique((np.concatenate(all_hashes) >> np.uint64(64 - SPACE_BITS)).astype(np.int64))


@dataclass
class Weights:
    """Sorted coordinates, their weights and the intercept."""

    coords: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << SPACE_BITS, np.float32)
        out[self.coords] = self.weights
        return out


#: (l1, least_rows) that select() chooses from, the sparsest first.
CHOICES = ((30.0, 8), (8.0, 4), (2.0, 2))


def fit(rows: list[np.ndarray], labels: list[int], epochs: int = 5, alpha: float = 3.0, beta: float = 1.0, l1: float = 30.0, l2: float = 0.02,
        least_rows: int = 8, weight: float = 10.0, seed: int = 3) -> Weights:
    """FTRL-proximal, one row at a time.  An empty sample gives score 0.5 everywhere, one label alone its share.

    A feature of fewer than ``least_rows`` rows of the sample is left out: it could only learn its rows by heart.
    Rows of label 1 count ``weight`` times, which makes up for their being the fewer.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Weights(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(share / (1 - share))))
    held = np.zeros(1 << SPACE_BITS, np.int32)
    for r in rows:
        held[r] += 1  # a row's features are distinct
    coords = np.flatnonzero(held >= max(1, min(least_rows, len(rows) // 2)))
    rows = [np.intersect1d(r, coords, assume_unique=True) for r in rows]
    places = [np.searchsorted(coords, r) for r in rows]
    z, n = np.zeros(len(coords)), np.zeros(len(coords))
    zb = nb = 0.0
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(y)):
            at = places[i]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            b = -zb / ((beta + nb ** 0.5) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -30, 30))) - y[i]
            g *= weight if y[i] else 1.0
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
            sigma_b = ((nb + g * g) ** 0.5 - nb ** 0.5) / alpha
            zb += g - sigma_b * b
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    keep = w != 0
    return Weights(coords[keep], w[keep].astype(np.float32), float(-zb / ((beta + nb ** 0.5) / alpha + l2)))


def logit(model: Weights, row: np.ndarray) -> float:
    at = np.minimum(np.searchsorted(model.coords, row), max(0, len(model.coords) - 1))
    return model.bias + float(model.weights[at[model.coords[at] == row]].sum(dtype=np.float64)) if len(model.coords) else model.bias


def select(rows: list[np.ndarray], labels: list[int], epochs: int = 5, threshold: float = 0.7, folds: int = 4, enough: int = 1500) -> tuple[float, int]:
    """The (l1, least_rows) of CHOICES that does best on rows of the learning sample that it was not fitted on.

    Best is the recall at ``threshold`` less five times the share of false alarms, the sparser of equals; 0.95 is enough
    to end the search.  Each fold of a sample of fewer than ``enough`` rows is left out in turn, of a larger one the
    first alone.
    """
    y = np.array(labels)
    fold, used = np.arange(len(y)) % folds, folds if len(y) < enough else 1
    cut, best = np.log(threshold / (1 - threshold)), (-np.inf, CHOICES[0])
    if min((y == 1).sum(), (y == 0).sum()) < folds:
        return CHOICES[0]
    for l1, least_rows in CHOICES:
        hit = np.zeros(len(y), bool)
        for f in range(used):
            model = fit([r for r, g in zip(rows, fold) if g != f], y[fold != f].tolist(), epochs, l1=l1, least_rows=least_rows)
            for i in np.flatnonzero(fold == f):
                hit[i] = logit(model, rows[i]) >= cut
        seen = fold < used
        found, false = hit[seen & (y == 1)], hit[seen & (y == 0)]
        worth = (found.mean() if len(found) else 0.0) - 5 * (false.mean() if len(false) else 0.0)
        if worth > best[0] + 1e-9:
            best = (worth, (l1, least_rows))
        if worth >= 0.95:
            break
    return best[1]


def train(docs: DataFrame, labels: DataFrame, fold: Column, label_col: str = "toxic", rows: int = 8000, text_bytes: int = 1 << 13,
          epochs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Fit on at most ``rows`` labelled rows of the folds where ``fold`` is true, texts of at most ``text_bytes`` bytes.

    These two parameters bound what reaches the driver: hashed features, made in tasks, at most 6 bytes for each byte of
    text.  The penalty is chosen within these rows.  Inputs are words alone.
    """
    sample = labelled_sample(docs, labels, label_col, fold, rows, text_bytes, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).astype(np.int32) for t in lowered(batch.column("body"))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("label"), pa.array([f.tobytes() for f in found], pa.binary())], names=["_id", "label", "found"])

    kind = sample.schema["_id"].dataType.simpleString()
    got = sorted((r["_id"], r["label"], bytes(r["found"])) for r in sample.mapInArrow(run, f"_id {kind}, label int, found binary").collect())
    found, marks = [np.frombuffer(x[2], np.int32) for x in got], [x[1] for x in got]  # views of what was collected
    l1, least_rows = select(found, marks, epochs)
    return fit(found, marks, epochs, l1=l1, least_rows=least_rows)


def scores(docs: DataFrame, model: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score (probability of label 1) for every row, from the whole text.

    Null and empty texts have no features and get the intercept's probability.  Repeated rows get equal scores, null
    ids stay null, an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = sent.value.dense(), sent.value.bias
        for batch in batches:
            for part in pieces(batch):
                logits = np.array([bias + float(weights[features(t)].sum(dtype=np.float64)) for t in lowered(part.column("body"))])
                p = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(p, pa.float64())], names=["id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts(docs, id_col, text_col).mapInArrow(run, f"id {kind}, score double").select(F.col("id").alias(id_col), "score")
