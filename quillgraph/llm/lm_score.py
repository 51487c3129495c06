"""Language-model scoring with a weighted backoff automaton.

Tokens are the words of a lower-cased text and one end token.  All token counts of the learning rows are taken, and
from them the base distribution P0(w) = (c + 1/2) / (N + (V + 1) / 2).  Above it stand smoothed n-grams: a context is
a state, an n-gram an arc, and a context without an arc for the next word follows its failure arc to its longest
known suffix, multiplying its backoff weight in:

    P(w | h) = max(c(h, w) - D, 0) / c(h) [if the arc is kept] + bow(h) * P(w | suffix of h)
    bow(h)   = 1 - sum over h's kept arcs of (c(h, w) - D) / c(h)

so every state's probabilities sum to one.  Scoring is one left-to-right traversal that carries the state.

lm_scores() counts all n-grams of the learning rows and keeps every arc that occurs twice, whatever the corpus.  Nothing
of the model is collected or broadcast.  Texts are coded once into chunks of token hashes.  A chunk asks for its
different words and pairs, dealt by ranges of their hashes to buckets that add up the learning counts and answer every
chunk in its own order.  Longer n-grams are asked for only where both their parts occur twice.  The first chunk that
holds an arc adds its share to the arc's context; these sums are asked for in the next round and give the backoff
weights.  In the last round every chunk builds the part of the automaton that its texts can reach (its states, arcs,
failure arcs and their weights) and traverses it, text by text from left to right.  What is shuffled is one
packed row for each chunk and bucket, never a text or its codes; both grow in number, not in size, with the corpus.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lowered, materialise, pieces, texts

END = b"\n"  #: the end token; no word holds white space
DISCOUNT = 0.75


# --- all n-grams, by questions and answers between chunks and buckets

_KEYS = 2_000_000  #: questions a bucket
_SPARE_BITS = 20  #: a key of two tokens or more collides with any other with a chance of 2**-20 at most; tokens have 64 bits
_CODED = "rows array<long>, ids array<{kind}>, learn array<boolean>, sizes array<int>, skips array<int>, words binary, codes binary, tokens long, learnt long"
_ASKED = "kind int, bucket int, chunk long, keys binary, n binary"
_ANSWERED = "kind int, bucket int, chunk long, n binary, mine binary, words long"


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers by place of their bytes, compressed: the high places are nearly all equal."""
    top = int(x.max(initial=0))
    width = max(1, -(-top.bit_length() // 8))
    planes = np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.compress(planes.tobytes(), 1)


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :b[0]] = planes.T
    return out.view(np.uint64).ravel()


def _joined(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *[_unpack(b) for b in column.to_pylist()]])


def code_texts(docs: DataFrame, learning: Column, order: int, id_col: str, text_col: str, most: int = 2_000_000) -> DataFrame:
    """Chunks of about ``most`` tokens: hashes of the different tokens, a code for each token, and the rows they belong to.

    Codes go by frequency, so that most fit a byte.  A longer text is cut into segments that repeat the order - 1
    tokens before them (skips).  The table is bucketed by chunk: later rounds bring the answers to the chunks, not the
    chunks to the answers.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        index: defaultdict[bytes, int] = defaultdict(count().__next__)
        size, id_type = 0, None

        def flush() -> pa.RecordBatch:
            found = np.concatenate([x[4] for x in held])
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, index), np.uint64, len(index))
            by = np.argsort(-np.bincount(found, minlength=len(index)), kind="stable")
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            index.clear()
            index.default_factory = count().__next__
            column = lambda i, t: pa.array([[x[i] for x in held]], pa.list_(t))
            return pa.RecordBatch.from_arrays(
                [column(0, pa.int64()), column(1, id_type), column(2, pa.bool_()), pa.array([[len(x[4]) for x in held]], pa.list_(pa.int32())), column(3, pa.int32()),
                 pa.array([hashes[by].tobytes()]), pa.array([_pack(rank[found])]), pa.array([len(found)], pa.int64()), pa.array([sum(len(x[4]) - x[3] for x in held if x[2])], pa.int64())],
                names=["rows", "ids", "learn", "sizes", "skips", "words", "codes", "tokens", "learnt"])

        for batch in batches:
            id_type = batch.column("id").type
            for part in pieces(batch, 1 << 20):
                for row, i, learn, text in zip(part.column("row").to_pylist(), part.column("id").to_pylist(), part.column("learn").to_pylist(), lowered(part.column("body"))):
                    words = [*text.split(), END]
                    for a in range(0, len(words), most):
                        skip = min(a, order - 1)
                        some = words[a - skip:a + most]
                        held.append((row, i, learn, skip, np.fromiter(map(index.__getitem__, some), np.int64, len(some))))
                        size += len(some)
                        if size >= most:
                            yield flush()
                            held, size = [], 0
        if held:
            yield flush()

    source = texts(docs, id_col, text_col, F.coalesce(learning, F.lit(False)).alias("learn"), F.monotonically_increasing_id().alias("row"))
    coded = source.mapInArrow(run, _CODED.format(kind=kind)).withColumn("chunk", F.monotonically_increasing_id())
    return materialise(coded, "coded", by="chunk")


def _mix(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


class _Chunk:
    """A chunk's different n-grams, order by order.

    Of order k: at[k][i] is the n-gram that ends at token i (-1: none), hashes[k], its place by hash (rank[k]: the
    order in which it is asked for), context[k] (the n-gram of order k - 1 that it begins with) and n[k], the corpus's
    count once it is known.  From order 3 on only n-grams are kept whose first and last parts occur twice, as no other
    can.
    """

    def __init__(self, row: dict) -> None:
        words, codes = np.frombuffer(row["words"], np.uint64), _unpack(row["codes"]).astype(np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.age = np.arange(len(codes)) - np.repeat(self.starts, self.sizes)
        self.fresh = self.age >= np.repeat(np.array(row["skips"], np.int64), self.sizes)
        self.learnt = self.fresh & np.repeat(np.array(row["learn"], bool), self.sizes)
        self.chunk, self.words, self.codes = row["chunk"], words, codes
        self.at, self.hashes, self.context = {1: codes}, {1: _mix(words)}, {1: np.zeros(len(words), np.int64)}
        self.rank = {1: np.argsort(self.hashes[1])}
        self.n: dict[int, np.ndarray] = {}
        self.mine: dict[int, np.ndarray] = {}
        self.last: dict[int, np.ndarray] = {}
        self.arcs: dict[int, np.ndarray] = {}

    def grow(self, k: int) -> None:
        i = np.flatnonzero(self.age >= k - 1)
        before, now = self.at[k - 1][i - 1], self.at[k - 1][i]
        if k > 2:
            twice = self.n[k - 1] >= 2
            fine = (before >= 0) & (now >= 0)
            fine[fine] = twice[before[fine]] & twice[now[fine]]
            i, before = i[fine], before[fine]
        found, different = pd.factorize(before * len(self.words) + self.codes[i])
        self.at[k] = np.full(len(self.codes), -1, np.int64)
        self.at[k][i] = found
        self.context[k], last = np.divmod(different, max(1, len(self.words)))
        self.last[k] = last
        self.hashes[k] = _mix(self.hashes[k - 1][self.context[k]] * np.uint64(0x9E3779B97F4A7C15) + (self.words[last] ^ np.uint64(k)))
        self.rank[k] = np.argsort(self.hashes[k])

    def counts(self, k: int) -> np.ndarray:
        at = self.at[k]
        return np.bincount(at[self.learnt & (at >= 0)], minlength=len(self.hashes[k]))

    def contexts(self, k: int) -> np.ndarray:
        """The n-grams of order k with a token after them that occur twice, by hash."""
        some = np.zeros(len(self.hashes[k]), bool)
        before = self.at[k][np.flatnonzero(self.age >= k) - 1]
        some[before[before >= 0]] = True
        some &= self.n[k] >= 2
        return self.rank[k][some[self.rank[k]]]

    def suffixes(self, k: int) -> np.ndarray:
        """Of every n-gram of order k the one of order k - 1 that it ends with."""
        out, i = np.zeros(len(self.hashes[k]), np.int64), np.flatnonzero(self.at[k] >= 0)
        out[self.at[k][i]] = self.at[k - 1][i]
        return out

    def shares(self, k: int) -> np.ndarray:
        """4 * (n - DISCOUNT), a whole number, of the arcs of order k + 1 that are this chunk's to report, summed by context."""
        arcs = self.mine[k + 1] & (self.n[k + 1] >= 2)
        return np.bincount(self.context[k + 1][arcs], weights=4 * self.n[k + 1][arcs] - int(4 * DISCOUNT), minlength=len(self.hashes[k])).astype(np.int64)

    def own(self, k: int) -> np.ndarray:
        """n - DISCOUNT of the arcs of order k + 1 that this chunk has met, summed by context."""
        arcs = self.n[k + 1] >= 2
        return np.bincount(self.context[k + 1][arcs], weights=self.n[k + 1][arcs] - DISCOUNT, minlength=len(self.hashes[k]))

    def asked(self, k: int) -> np.ndarray:
        """The contexts whose sum is to be asked for: those with occurrences enough for an arc that this chunk has not met,
        and those that it has shares of to report.  Of all others own() is the whole sum."""
        met = np.bincount(self.context[k + 1], weights=np.maximum(self.n[k + 1], self.counts(k + 1)), minlength=len(self.hashes[k]))
        some = self.contexts(k)
        return some[(self.n[k] - met >= 2)[some] | (self.shares(k)[some] > 0)]


class Automaton:
    """The states that a chunk's texts can reach, from the corpus's counts of their n-grams.

    State 0 is the root.  Every context that occurs twice is a state.  An arc (state, word) carries the log10 of the
    word's smoothed probability and leads to the longest context that is a state; the root's arcs are the words' base
    probabilities.  A state without an arc for a word passes on to its longest suffix by its failure arc, which carries
    the log10 of the backoff weight.
    """

    def __init__(self, c: _Chunk, order: int, norm: float) -> None:
        self.words, self.lead = max(1, len(c.words)), order - 1
        self.base = np.log10((c.n[1] + 0.5) / norm)
        p, number, states = 10 ** self.base, {}, 1
        fail, back, keys, arcs, to = [np.zeros(1, np.int64)], [np.zeros(1)], [], [], []
        self.met = [np.zeros(1, np.int64)]  # states that a token follows in the chunk: only their weights are known
        for k in range(1, order + 1):
            suffix = c.suffixes(k) if k > 1 else None
            twice = np.flatnonzero(c.n[k] >= 2)
            if k < order:
                number[k] = np.zeros(len(c.n[k]), np.int64)
                number[k][twice] = states + np.arange(len(twice))
                states += len(twice)
                fail.append(number[k - 1][suffix[twice]] if k > 1 else np.zeros(len(twice), np.int64))
                met = c.contexts(k)
                self.met.append(number[k][met])
            if k > 1:
                context, word = c.context[k][twice], c.last[k][twice]
                own = np.zeros(len(c.n[k]))
                own[twice] = (c.n[k][twice] - DISCOUNT) / c.n[k - 1][context] + weight[context] * p[suffix[twice]]
                p = own
                keys.append(number[k - 1][context] * self.words + word)
                arcs.append(np.log10(p[twice]))
                to.append(number[k][twice] if k < order else number[k - 1][suffix[twice]])
            if k < order:
                weight = np.ones(len(c.n[k]))
                weight[met] = np.maximum(1e-12, 1 - c.arcs[k][met] / c.n[k][met])
                back.append(np.log10(weight[twice]))
        self.fail, self.back, self.met = np.concatenate(fail), np.concatenate(back), np.concatenate(self.met)
        self.start = number[1] if order > 1 else np.zeros(len(c.words), np.int64)
        keys, arcs, to = (np.concatenate([*x, np.zeros(0, t)]) for x, t in ((keys, np.int64), (arcs, float), (to, np.int64)))
        by = np.argsort(keys)
        self.keys, self.arcs, self.to = np.append(keys[by], -1), np.append(arcs[by], 0.0), np.append(to[by], 0)

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one word each, and the log10 that was accumulated: along failure arcs until an arc fits."""
        score, after, left = np.zeros(len(word)), np.zeros(len(word), np.int64), np.arange(len(word))
        while len(left):
            s, w = state[left], word[left]
            key = s * self.words + w
            at = np.searchsorted(self.keys[:-1], key)
            hit = self.keys[at] == key
            done = left[hit]
            score[done] += self.arcs[at[hit]]
            after[done] = self.to[at[hit]]
            root = ~hit & (s == 0)
            done = left[root]
            score[done] += self.base[w[root]]
            after[done] = self.start[w[root]]
            left, s = left[~hit & ~root], s[~hit & ~root]
            score[left] += self.back[s]
            state = state.copy()
            state[left] = self.fail[s]
        return after, score

    def traverse(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = 256) -> np.ndarray:
        """The log10 of every token of texts from left to right, many texts side by side.

        A long text is taken in stretches of ``most`` tokens; a stretch begins lead tokens early, after which the state
        is what the whole text's traversal carries there, as no context is longer.
        """
        cuts = -(-sizes // most)
        text = np.repeat(np.arange(len(sizes)), cuts)
        begin = (np.arange(len(text)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * most
        lead = np.minimum(begin, self.lead)
        first, length = starts[text] + begin - lead, np.minimum(most, sizes[text] - begin) + lead
        by = np.argsort(-length, kind="stable")
        first, length, lead = first[by], length[by], lead[by]
        out, state = np.zeros(len(codes)), np.zeros(len(by), np.int64)
        for t in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -t, side="left"))  # the stretches longer than t
            at = first[:live] + t
            state[:live], score = self.step(state[:live], codes[at])
            told = lead[:live] <= t
            out[at[told]] = score[told]
        return out


def _questions(c: _Chunk, kind: int, hashes: np.ndarray, n: np.ndarray, bits: int, buckets: int) -> list[dict]:
    """Rows of sorted keys of so many bits, each range of keys for one bucket; keys are sent as steps from one to the next."""
    keys = hashes >> np.uint64(64 - bits)
    to = ((keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(to, prepend=-1)).tolist()
    return [{"kind": kind, "bucket": int(to[a]), "chunk": c.chunk, "keys": _pack(np.diff(keys[a:z], prepend=np.uint64(0))), "n": _pack(n[a:z])} for a, z in zip(cuts, [*cuts[1:], len(keys)])]


_ASKED_ARROW = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("n", pa.binary())])


def _answers(asked: DataFrame, name: str) -> DataFrame:
    """For each question the sums of n over all chunks, whether this chunk is the first with some, and the bucket's different keys with some.

    Counts of n-grams of two tokens and more are 0 where they are 1: such n-grams are no arcs.
    """

    def solve(table: pa.Table) -> pa.Table:
        each = [np.cumsum(_unpack(b)) for b in table["keys"].to_pylist()]
        n = _joined(table["n"])
        cuts = np.cumsum([0, *map(len, each)]).tolist()
        at, different = pd.factorize(np.concatenate(each))
        whole = np.bincount(at, weights=n, minlength=len(different)).astype(np.uint64)  # exact below 2**53
        words = int((whole > 0).sum())
        if table["kind"][0].as_py() % 2 == 0 and table["kind"][0].as_py() > 2:
            whole[whole == 1] = 0
        some = np.flatnonzero((n > 0) & (whole[at] > 0))[::-1]
        first = np.full(len(different), -1, np.int64)
        first[at[some]] = some
        mine = np.zeros(len(n), bool)
        mine[first[first >= 0]] = True
        spans = list(zip(cuts, cuts[1:]))
        return pa.table({
            "kind": table["kind"], "bucket": table["bucket"], "chunk": table["chunk"], "n": pa.array([_pack(whole[at[a:z]]) for a, z in spans], pa.binary()),
            "mine": pa.array([np.packbits(mine[a:z]).tobytes() for a, z in spans], pa.binary()), "words": pa.array([words] + [0] * (len(spans) - 1), pa.int64())})

    return materialise(asked.groupBy("kind", "bucket").applyInArrow(solve, _ANSWERED), name)


def _restored(left: pa.Table, right: pa.Table, order: int) -> _Chunk:
    """The chunk with all that has been answered so far; kind 2 k holds counts of order k, 2 k + 1 the arcs' sums of its contexts."""
    c = _Chunk(left.to_pylist()[0])
    for k in range(1, order + 1):
        rows = right.filter(pc.equal(right["kind"], 2 * k)).sort_by("bucket")
        if k > 1:
            c.grow(k)
        n = _joined(rows["n"])
        if len(n) != len(c.hashes[k]):
            return c  # not asked for yet; sums are read in the last round alone
        c.n[k], c.mine[k] = np.empty(len(n), np.int64), np.zeros(len(n), bool)
        c.n[k][c.rank[k]] = n
        sizes = [len(_unpack(b)) for b in rows["n"].to_pylist()]
        c.mine[k][c.rank[k]] = np.concatenate([np.zeros(0, bool), *[np.unpackbits(np.frombuffer(b, np.uint8), count=s) > 0 for b, s in zip(rows["mine"].to_pylist(), sizes)]])
    for k in range(1, order):
        c.arcs[k] = c.own(k)
        rows = right.filter(pc.equal(right["kind"], 2 * k + 1)).sort_by("bucket")
        if len(rows):
            c.arcs[k][c.asked(k)] = _joined(rows["n"]) / 4
    return c


def lm_scores(docs: DataFrame, learning: Column, order: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, n_known, train_tokens, base_score and score for every row, by all n-grams of the rows for which
    ``learning`` is true that occur twice or more.

    Null and empty texts hold the end token alone.  Scores are log10.  Repeated rows are scored each; null ids stay
    null; an empty table gives an empty result; without learning rows every token has probability one.
    """
    coded = code_texts(docs, learning, order, id_col, text_col)
    total, held = coded.agg(F.coalesce(F.sum("learnt"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    bits = min(62, max(40, int(held * order).bit_length() + _SPARE_BITS))
    buckets = max(8, -(-held // _KEYS))

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = _Chunk(batch.slice(i, 1).to_pylist()[0])
                for k in range(1, min(order, 2) + 1):
                    if k > 1:
                        c.grow(k)
                    wide = 64 if k == 1 else bits  # counts of tokens are exact, whatever the corpus
                    yield pa.RecordBatch.from_pylist(_questions(c, 2 * k, c.hashes[k][c.rank[k]], c.counts(k)[c.rank[k]], wide, buckets), _ASKED_ARROW)

    def later_round(k: int):
        """Asks for the arcs' sums of the contexts of order k and, below the highest order, for the counts of order k + 2."""
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            c = _restored(left, right, k + 1)
            contexts = c.asked(k)
            asked = _questions(c, 2 * k + 1, c.hashes[k][contexts], c.shares(k)[contexts], bits, buckets)
            if k + 2 <= order:
                c.grow(k + 2)
                asked += _questions(c, 2 * k + 4, c.hashes[k + 2][c.rank[k + 2]], c.counts(k + 2)[c.rank[k + 2]], bits, buckets)
            return pa.Table.from_pylist(asked, _ASKED_ARROW)
        return run

    known = _answers(coded.mapInArrow(first_round, _ASKED), "counted")
    distinct = known.filter("kind = 2").agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    norm = total + 0.5 * (distinct + 1)
    known = known.drop("words")
    for k in range(1, order):
        asked = coded.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(later_round(k), _ASKED)
        known = known.unionByName(_answers(asked, f"answered-{k}").drop("words"))
    kind = docs.schema[id_col].dataType.simpleString()

    def last_round(left: pa.Table, right: pa.Table) -> pa.Table:
        c = _restored(left, right, order)
        base = (c.n[1][c.codes] + 0.5) / norm
        score = Automaton(c, order, norm).traverse(c.codes, c.starts, c.sizes)
        add = lambda x: np.add.reduceat(np.where(c.fresh, x, 0), c.starts)
        row = left.select(["rows", "ids"]).to_pylist()[0]
        return pa.table({
            "row": pa.array(row["rows"], pa.int64()), "id": pa.array(row["ids"], left.schema.field("ids").type.value_type), "n_tokens": add(np.ones(len(base), np.int64)),
            "n_known": add((c.n[1][c.codes] > 0).astype(np.int64)), "base_score": add(np.log10(base)), "score": add(score)})

    scored = coded.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(last_round, f"row long, id {kind}, n_tokens long, n_known long, base_score double, score double")
    return scored.groupBy("row").agg(F.first("id").alias(id_col), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")]).select(
        id_col, "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
