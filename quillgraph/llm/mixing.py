"""Mixing to target weights with soft memberships.

A classifier fitted on the labelled table gives every document a posterior over domains.  Each document then gets a
non-negative rate (its expected number of copies) so that the expected tokens of every domain, sum(tokens * p_k *
rate), meet their targets.  The rates solve the least-squares problem

    minimise  sum_k (sum_d tokens_d p_dk rate_d - target_k)^2,      0 <= rate <= most,

and, among its solutions, are the nearest to one (a term RIDGE times smaller than the corpus sees to that).  The solver is a
lazily projected gradient method: gradients, which are combinations of a row's own posterior, add up in one vector of k
numbers, and a row's rate is the projection of one minus that combination, so nothing that grows with the corpus is
collected or carried from step to step.  Steps are scaled by the inverse of the k x k Gram matrix sum(tokens p p') over
the rows that no bound holds, taken if they lower the problem's dual (whose gradient is the residual), and end when the
optimality condition holds.  An iteration is one aggregate over all documents that returns 1 + k + k * k numbers.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered, materialise, pieces, texts

SPACE_BITS = 16
RIDGE = 1e-9  #: weight of staying near to one, as a share of the corpus


def grams(text: bytes, flags: np.ndarray) -> np.ndarray:
    """Distinct hashed byte 4-grams of a lower-cased text (shorter texts are filled up with zeros); flags is scratch space."""
    a = np.frombuffer(text.ljust(4, b"\0"), np.uint8).astype(np.uint32)
    h = ((a[:-3] | a[1:-2] << np.uint32(8) | a[2:-1] << np.uint32(16) | a[3:] << np.uint32(24)) * np.uint32(2654435761)) >> np.uint32(32 - SPACE_BITS)
    flags[h] = True
    at = np.flatnonzero(flags)
    flags[at] = False
    return at


@dataclass
class Domains:
    """Softmax weights over hashed 4-grams; ``names`` in order."""

    names: list[str]
    weights: np.ndarray  # [2**SPACE_BITS, domains]
    bias: np.ndarray

    def posterior(self, at: np.ndarray) -> np.ndarray:
        x = self.weights[at].sum(axis=0) / len(at) ** 0.5 + self.bias
        e = np.exp(x - x.max())
        return e / e.sum()


def fit(bodies: list[bytes], domains: list[str], names: list[str], epochs: int = 5, rate: float = 0.5, seed: int = 5) -> Domains:
    """Softmax regression with a learning rate for each weight (squared-gradient sums).  Without rows all domains are equal."""
    k = len(names)
    model = Domains(names, np.zeros((1 << SPACE_BITS, k), np.float32), np.zeros(k, np.float32))
    flags, r = np.zeros(1 << SPACE_BITS, bool), np.random.default_rng(seed)
    seen, seen_bias = np.full_like(model.weights, 1e-3), np.full(k, 1e-3, np.float32)
    found = [grams(b, flags) for b in bodies]
    for _ in range(epochs):
        for i in r.permutation(len(found)):
            at = found[i]
            g = model.posterior(at)
            g[names.index(domains[i])] -= 1
            each = (g / len(at) ** 0.5).astype(np.float32)
            seen[at] += each * each
            model.weights[at] -= rate * 0.2 * each / np.sqrt(seen[at])
            seen_bias += g * g
            model.bias -= rate * 0.1 * g / np.sqrt(seen_bias)
    return model


def train(docs: DataFrame, labelled: DataFrame, names: list[str], domain_col: str = "domain", rows: int = 4000, text_bytes: int = 1 << 16,
          id_col: str = "doc_id", text_col: str = "text") -> Domains:
    """Fit on at most ``rows`` rows of the labelled table (id_col, domain_col), texts of at most ``text_bytes`` bytes.

    Labels outside ``names``, null labels and null ids are left out; of an id's labels the smallest counts.
    """
    chosen = (
        labelled.filter(F.col(domain_col).isin(*names) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(domain_col).alias("_domain")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    got = (
        docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).join(F.broadcast(chosen), "_id")
        .filter(F.octet_length("body") <= text_bytes).dropDuplicates(["_id"]).collect()
    )
    ordered = sorted((r["_id"], r["_domain"], r["body"]) for r in got)
    low = lowered(pa.chunked_array([pa.array([x[2] for x in ordered], pa.string())]))
    return fit(low, [x[1] for x in ordered], names)


def memberships(docs: DataFrame, model: Domains, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, tokens (words, at least 1) and p (posteriors in the order of model.names) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << SPACE_BITS, bool)
        for batch in batches:
            for part in pieces(batch):
                low = lowered(part.column("body"))
                p = [sent.value.posterior(grams(t, flags)).astype(float).tolist() for t in low]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([max(1, len(t.split())) for t in low], pa.int64()), pa.array(p, pa.list_(pa.float64()))], names=["id", "tokens", "p"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts(docs, id_col, text_col).mapInArrow(run, f"id {kind}, tokens long, p array<double>")


@dataclass
class Steps:
    """Steps of the solver: rate <- clip(rate - p . push, 0, most), from rate 1 on."""

    pushes: list[np.ndarray]
    most: float

    def replay(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates of rows of posteriors, and which of them the last step has moved freely."""
        rate, free = np.ones(len(p)), np.ones(len(p), bool)
        for push in self.pushes:
            wanted = rate - p @ push
            rate = np.clip(wanted, 0, self.most)
            free = wanted == rate
        return rate, free


def _posteriors(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _sums(members: DataFrame, steps: Steps, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected tokens of each domain at these rates, the Gram matrix of the rows that moved freely, and the integral of
    the projection up to each row's unprojected rate, summed.

    The steps travel with the function, not in the plan's text, so every iteration runs the same compiled code.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k + k * k + 1)
        for batch in batches:
            p, tokens = _posteriors(batch.column("p"), k), batch.column("tokens").to_numpy().astype(float)
            rate, free = steps.replay(p)
            wanted = np.ones(len(p)) - sum((p @ push for push in steps.pushes), np.zeros(len(p)))
            sums[:k] += (tokens * rate) @ p
            sums[k:-1] += (p[free] * tokens[free, None]).T.dot(p[free]).ravel()
            sums[-1] += tokens @ (rate * wanted - rate * rate / 2)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array(sums)], names=["at", "x"])

    found = np.zeros(k + k * k + 1)
    for r in members.select("tokens", "p").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        found[r["at"]] = r["x"]
    return found[:k], found[k:-1].reshape(k, k), float(found[-1])


def totals(members: DataFrame, steps: Steps, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Expected tokens of each domain at these rates, and the Gram matrix of the rows that moved freely."""
    return _sums(members, steps, k)[:2]


def least_squares(sums, k: int, ways: np.ndarray, target: np.ndarray, most: float, start: np.ndarray | None = None, iterations: int = 100) -> np.ndarray:
    """The vector x whose rates clip(1 - p . (x @ ways), 0, most) bring ways @ totals nearest to target.

    ``sums(push)`` gives (totals, Gram matrix, integral) at clip(1 - p . push, 0, most).  With e the ridge the optimality
    condition is ways @ totals - target = e x; it is the gradient of a convex function of x, which every accepted step
    lowers.  The ridge falls by steps to RIDGE of the corpus, each solution being the next one's start.
    """
    x = np.zeros(len(target)) if start is None else start
    at, gram, whole = sums(x @ ways)
    mass = max(float(sums(np.zeros(k))[0].sum()), 1.0)
    for share in (1e-2, 1e-4, 1e-6, RIDGE):
        ridge = share * mass
        dual = lambda x, whole: whole + target @ x + ridge / 2 * x @ x
        for _ in range(iterations):
            slope = ways @ at - target - ridge * x
            if np.abs(slope).max() <= 1e-9 * mass + 1e-6 * np.abs(ways @ at - target).max() * (share > RIDGE):
                break
            step = np.linalg.solve(ways @ gram @ ways.T + ridge * np.eye(len(x)), slope)
            scale, fell = 1.0, False
            while scale > 1e-8 and not fell:
                then = sums((x + scale * step) @ ways)
                lower = dual(x + scale * step, then[2]) <= dual(x, whole) - 1e-4 * scale * (slope @ step)
                nearer = np.abs(ways @ then[0] - target - ridge * (x + scale * step)).max() < 0.5 * np.abs(slope).max()
                fell = lower or nearer  # near the end the dual's rounding hides its fall
                if fell:
                    x, (at, gram, whole) = x + scale * step, then
                else:
                    scale /= 4
            if not fell:
                break
    return x


def solve(members: DataFrame, wanted: np.ndarray, budget: float | None = None, most: float = np.inf, iterations: int = 100, tolerance: float = 1e-3) -> Steps:
    """Steps that lead the expected totals to ``wanted`` (shares that sum to one) of ``budget`` tokens.

    Without a budget it is as many tokens as the heaviest domain has for its share.  Under a bound ``most`` it is as
    many as that domain keeps: the least squares are then of each domain's total less its share relative to the heaviest,
    and a domain whose tokens do not suffice is left out.  Where no rates meet the targets the rates are those of the
    least squared error, and a warning names the residuals.
    """
    k, heavy = len(wanted), int(wanted.argmax())

    def sums(push: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        return _sums(members, Steps([push], most), k)

    masses = sums(np.zeros(k))[0]
    if not masses.sum():
        return Steps([], most)
    if budget is not None or not np.isfinite(most):
        ways, target = np.eye(k), wanted * (budget or masses[heavy] / wanted[heavy])
        steps = Steps([least_squares(sums, k, ways, target, most, iterations=iterations)], most)
        got = totals(members, steps, k)[0]
    else:
        share = wanted / wanted[heavy]
        left = {i for i in range(k) if i != heavy and most * masses[i] < share[i] * most * masses[heavy]}
        while True:
            ways = np.array([np.eye(k)[i] - share[i] * np.eye(k)[heavy] for i in range(k) if i != heavy and i not in left]).reshape(-1, k)
            target = np.zeros(len(ways))
            steps = Steps([least_squares(sums, k, ways, target, most, iterations=iterations) @ ways] if len(ways) else [], most)
            got = totals(members, steps, k)[0]
            enough = {i for i in left if most * masses[i] >= share[i] * got[heavy]}
            if not enough:
                break
            left -= enough
    off = ways @ got - target
    if (np.abs(off) > tolerance * np.maximum(np.abs(target).max(initial=0), masses.max())).any():
        warnings.warn(f"mixing: targets not met by any rates; the residuals are {np.round(off).tolist()} of {np.round(got).tolist()} tokens", RuntimeWarning, stacklevel=2)
    return steps


def _draw(id_column: Column, seed: int) -> Column:
    """A number from 0 to 1 by a hash of the id; a null id is hashed as a value of its own."""
    return F.pmod(F.xxhash64(F.coalesce(id_column.cast("string"), F.lit("null")), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def fitted(docs: DataFrame, model: Domains, weights: dict[str, float], budget: float | None = None, most: float | None = None,
           id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Steps]:
    """The memberships of docs, written once, and the steps that mix them to ``weights`` (normalised here)."""
    members = materialise(memberships(docs, model, id_col, text_col), "members")
    wanted = np.array([weights.get(n, 0.0) for n in model.names], float)
    return members, solve(members, wanted / wanted.sum(), budget, np.inf if most is None else most)


def rates(docs: DataFrame, model: Domains, weights: dict[str, float], budget: float | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 11,
          most: float | None = None) -> DataFrame:
    """id_col, tokens, one column p_<domain> each, rate, copies and one column off_<domain> each for every row.

    ``weights`` are the domains' wanted shares of the mix.  ``budget`` is the mix's tokens; by default as many as leave
    the heaviest domain's tokens as they are.  copies is rate rounded up or down at random, by a hash of the id, with
    expectation rate; rows that repeat an id draw the same number.  Null and empty texts count one token.  A null id is
    hashed as a value of its own.  An empty table gives an empty result.

    off_<domain> is what the domain's expected tokens lack or exceed of its share of all, the same in every row; where the
    targets can be met it is next to nothing.

    With ``most`` no rate is above it: a domain whose tokens do not suffice is left out of the targets, and the others
    keep their shares relative to the heaviest.
    """
    members, steps = fitted(docs, model, weights, budget, most, id_col, text_col)
    k = len(model.names)
    got = totals(members, steps, k)[0]
    wanted = np.array([weights.get(n, 0.0) for n in model.names], float)
    off = got - wanted / wanted.sum() * (budget or got[wanted.argmax()] * wanted.sum() / wanted.max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rate, _ = steps.replay(_posteriors(batch.column("p"), k))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate)], names=[*batch.schema.names, "rate"])

    kind = docs.schema[id_col].dataType.simpleString()
    return members.mapInArrow(run, f"id {kind}, tokens long, p array<double>, rate double").select(
        F.col("id").alias(id_col), "tokens", *[F.col("p")[i].alias(f"p_{n}") for i, n in enumerate(model.names)], "rate", F.floor(F.col("rate") + _draw(F.col("id"), seed)).cast("int").alias("copies"),
        *[F.lit(float(x)).alias(f"off_{n}") for n, x in zip(model.names, off)])


def mixed(docs: DataFrame, model: Domains, weights: dict[str, float], budget: float | None = None, most: float | None = None,
          id_col: str = "doc_id", text_col: str = "text", seed: int = 11) -> DataFrame:
    """docs with as many copies of each row as rates() says, in one pass over the texts: no join, no shuffle.

    Rows of a null id stay once.  Columns are as they were.
    """
    _, steps = fitted(docs, model, weights, budget, most, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names, width = docs.columns, len(docs.columns)
    text, key = names.index(text_col), names.index(id_col)
    drawn = docs.select("*", _draw(F.col(id_col), seed).alias("_mixing_draw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << SPACE_BITS, bool)
        for batch in batches:
            sized = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(text).fill_null("")], names=["row", "body"])
            for part in pieces(sized):
                whole = batch.slice(part.column("row")[0].as_py(), part.num_rows)
                p = np.array([sent.value.posterior(grams(t, flags)) for t in lowered(part.column("body"))], float)
                times = np.floor(steps.replay(p)[0] + whole.column(width).to_numpy()).astype(np.int64)
                times[whole.column(key).is_null().to_numpy(zero_copy_only=False)] = 1
                yield pa.RecordBatch.from_arrays(whole.take(pa.array(np.repeat(np.arange(len(times)), times))).columns[:width], schema=pa.schema(list(whole.schema)[:width]))

    return drawn.mapInArrow(run, docs.schema)
