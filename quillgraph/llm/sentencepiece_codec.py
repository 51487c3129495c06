"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search goes over the boundaries between characters and keeps, for each boundary, the piece by which the best path
arrives there.  Only a window as long as the longest piece can be looked back on.  A boundary survives while the characters
after it still begin some piece; as soon as the backpointer paths of all surviving boundaries converge on one boundary, the
ids up to there are final and are given out, and what lies before it is dropped.  A text of any length is encoded in memory
bounded by the distance between such meeting points.

From a committed boundary on the search depends on the piece that arrives there (and on that only if some piece holds
the two characters beside the boundary next to each other) and on the characters up to where the paths converge.  So
what it commits is kept as a transition: (committed state, window content) -> (ids, characters, next state).  A window
reaches to the next space or mark, which it holds as its look-ahead; where paths do not converge within it, it grows.

Two kinds of models are read.  In a unigram model a path's weight is the sum of its pieces' scores.  In a BPE model a
path is right if every two neighbouring pieces, merged again from their characters by the model's ranks, come out as
they are; exactly one piece arrives validly at every boundary, and the path is the one that merging would give.

The result is that of the model itself: ids equal those of its reference encoder, unknown characters fall back to
bytes where the model has them, and decoding gives the text back (but for U+2581, which stands for a space).  A byte that
belongs to no valid UTF-8 character, which Spark's strings may hold, is read as U+FFFD, as the reference encoder reads it.
"""

from __future__ import annotations

import codecs
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts

SPACE = "▁"
SHORT = 64  #: characters of a window that is searched at once and whose transition is kept


@dataclass
class Model:
    """A piece vocabulary: the size of the tokenizer, not of the data."""

    names: list[str]
    ids: dict[str, int]  # of pieces that text can hold
    scores: dict[str, float]
    bytes_: list[int]  # ids of the 256 byte pieces, or empty
    unknown: int
    silent: frozenset[int]  # control pieces
    bpe: bool
    dummy_prefix: bool
    longest: int
    _pairs: dict[str, dict[str, bool]] = field(default_factory=dict)  # of each piece: whether it may follow another
    _states: dict[str, list[tuple[float, str, str]]] = field(default_factory=dict)  # at most one a piece or character
    _memory: dict = field(default_factory=dict)  # transitions by window, or by (state, window)
    converged: int = 0  # commits by converging paths so far

    def __post_init__(self) -> None:
        ends: dict[str, set[int]] = {}  # of the last two or three characters: the lengths of pieces that end in them
        for piece in self.scores:
            for tail in {piece[-2:], piece[-3:]}:
                ends.setdefault(tail, {1}).add(len(piece))
        short = {tail: {n for n in found if n <= 2} for tail, found in ends.items()}
        self.ends = {tail: tuple(sorted(found | short.get(tail[-2:], set()) if len(tail) == 3 else short[tail], reverse=True)) for tail, found in ends.items()}
        self._pairs, self._held = {piece: {} for piece in self.scores}, 0
        self.unseen = min(self.scores.values(), default=0.0) - 10  # the score of an unknown character
        self.begun = {piece[:i] for piece in self.scores for i in range(1, len(piece))}  # what a longer piece may go on from
        self.inside = {piece[i:i + 2] for piece in self.scores for i in range(len(piece) - 1)}  # neighbours within a piece
        both = lambda c: (SPACE, " ") if c == SPACE else (c,)
        self.inside_raw = {x + y for a, b in self.inside for x in both(a) for y in both(b)}  # as texts can write them
        self.loose = {x for x, y in self.inside_raw if _AHEAD.match(y)}  # what some look-ahead goes on
        self.shown = [n.replace(SPACE, " ") for n in self.names]
        self.special = np.zeros(max([len(self.names), self.unknown + 1]), bool)  # ids that stand for no text of their own
        self.special[[*self.bytes_, *self.silent, self.unknown]] = True

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_pairs": {piece: {} for piece in self.scores}, "_held": 0, "_states": {}, "_memory": {}, "converged": 0}


def load(path: str) -> Model:
    """Read a .model file on the driver.  Models that rewrite text by a character map are refused."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces or m.trainer_spec.model_type not in (1, 2):
        raise ValueError("only unigram and BPE models that keep the text as it is are supported")
    kind = proto.ModelProto.SentencePiece
    plain = [(p.piece, i, p.score) for i, p in enumerate(m.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)]
    by_byte = {p.piece: i for i, p in enumerate(m.pieces) if p.type == kind.BYTE}
    return Model(
        names=[p.piece for p in m.pieces], ids={p: i for p, i, _ in plain}, scores={p: s for p, _, s in plain},
        bytes_=[by_byte[f"<0x{b:02X}>"] for b in range(256)] if len(by_byte) == 256 else [],
        unknown=next(i for i, p in enumerate(m.pieces) if p.type == kind.UNKNOWN),
        silent=frozenset(i for i, p in enumerate(m.pieces) if p.type == kind.CONTROL),
        bpe=m.trainer_spec.model_type == 2, dummy_prefix=m.normalizer_spec.add_dummy_prefix,
        longest=max(len(p) for p, _, _ in plain))


def _states(model: Model, piece: str) -> list[tuple[float, str, str]]:
    """What merging a piece's characters by rank goes through: (rank of the next merge, first and last part) each time.

    The best-ranked neighbours merge first, the leftmost among equals.  The list is empty for a piece that its own
    characters do not merge to.
    """
    known = model._states.get(piece)
    if known is None:
        parts, known = list(piece), []
        while True:
            rank, at = min(((-model.scores.get(parts[i] + parts[i + 1], -np.inf), i) for i in range(len(parts) - 1)), default=(np.inf, 0))
            known.append((rank, parts[0], parts[-1]))
            if rank == np.inf:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        known = model._states[piece] = known if len(parts) == 1 else []
    return known


def _valid(model: Model, before: str, piece: str) -> bool:
    """Whether two pieces, merged again from their characters, come out as they are.

    Until a merge crosses their boundary each side merges as if alone; the next merge overall is the better of the
    two sides' next, the left one's among equals.  One crosses when it is better than both.
    """
    if model._held >= 400_000:
        for pairs in model._pairs.values():
            pairs.clear()
        model._held = 0
    left, right = _states(model, before) if before else [(np.inf, "", "")], _states(model, piece)
    i = j = 0
    fine = bool(right)
    while fine and before:
        (a, _, x), (b, y, _) = left[i], right[j]
        across = -model.scores.get(x + y, -np.inf)
        if across < a and across <= b:
            fine = False
        elif a == b == np.inf:
            break
        elif a <= b:
            i += 1
        else:
            j += 1
    model._pairs[piece][before] = fine
    model._held += 1
    return fine


def viterbi(model: Model, text: str, before: str = "", final: bool = True, closed: bool = False) -> Iterator[list[str]]:
    """Pieces of an escaped text, given out in lists as soon as they are final.

    ``before`` is the piece that arrives at the text's begin.  Unless the text is ``final`` more may follow, and what is
    not committed at its end is not given out.  After a ``closed`` text comes a character that goes on no piece: the end is
    the only boundary that survives it.
    """
    width, known, bpe, pairs, ends, begun = model.longest, model.scores, model.bpe, model._pairs, model.ends, model.begun
    base = 0  # the committed boundary
    arrive: list[str] = [before]  # pieces arriving at base, base + 1, ...
    weight: list[float] = [0.0]  # of the best paths there (unigram)
    live: list[int] = []  # surviving boundaries before the present one
    short = not final and len(text) <= SHORT  # what survives is asked at the end alone
    for i in range(1, len(text) + 1):
        if bpe:
            for size in (ends.get(text[i - 3:i]) if i > 2 else None) or (ends.get(text[i - 2:i]) if i > 1 else None) or (1,):
                j = i - size
                if j < base:
                    continue
                piece = text[j:i]
                follows = pairs.get(piece)
                if follows is not None:
                    last = arrive[j - base]
                    valid = follows.get(last)
                    if valid or (valid is None and _valid(model, last, piece)):
                        break
            else:
                piece = text[i - 1]  # an unknown character
            arrive.append(piece)
        else:
            best, choice = -np.inf, ""
            for j in range(max(base, i - width), i):
                piece = text[j:i]
                score = known.get(piece, model.unseen if j == i - 1 else None)
                if score is not None and weight[j - base] + score > best:
                    best, choice = weight[j - base] + score, piece
            arrive.append(choice)
            weight.append(best)
        if short:
            continue
        live.append(i - 1)
        oldest = live[0]
        live = [j for j in live if text[j:i] in begun]
        if live and live[0] == oldest and i < len(text):
            continue  # nothing has died that could bring paths together further on
        meet = _meeting(arrive, base, {*live, i})
        if meet > base:
            model.converged += 1
            yield _trace(arrive, meet - base)
            arrive, weight, base = arrive[meet - base:], weight[meet - base:], meet
    if short and closed:
        model.converged += 1
        yield _trace(arrive, len(text))
    elif short and text:
        n = len(text)
        back = width if text[-2:] in model.inside else 1  # else only the last character itself can go on
        meet = _meeting(arrive, 0, {n, *(j for j in range(max(0, n - back), n) if text[j:] in begun)})
        if meet:
            model.converged += 1
            yield _trace(arrive, meet)
    if final and len(arrive) > 1:
        yield _trace(arrive, len(arrive) - 1)


def _whole(model: Model, text: str) -> list[str]:
    """Pieces of an escaped closed text of a BPE model, no piece before it: viterbi() without what it asks of longer ones."""
    known, ends, arrive = model._pairs, model.ends, [""]
    model.converged += 1
    for i in range(1, len(text) + 1):
        for size in (ends.get(text[i - 3:i]) if i > 2 else None) or (ends.get(text[i - 2:i]) if i > 1 else None) or (1,):
            if size > i:
                continue
            piece = text[i - size:i]
            follows = known.get(piece)
            if follows is not None:
                last = arrive[i - size]
                valid = follows.get(last)
                if valid or (valid is None and _valid(model, last, piece)):
                    arrive.append(piece)
                    break
        else:
            arrive.append(text[i - 1])  # an unknown character
    return _trace(arrive, len(text))


def _meeting(arrive: list[str], base: int, paths: set[int]) -> int:
    """The last boundary through which the paths of all these boundaries go."""
    while len(paths) > 1 and (end := max(paths)) > base:
        paths.remove(end)
        paths.add(end - len(arrive[end - base]))
    return paths.pop() if len(paths) == 1 else base


def _trace(arrive: list[str], at: int) -> list[str]:
    out = []
    while at > 0:
        out.append(arrive[at])
        at -= len(arrive[at])
    return out[::-1]


def _ids(model: Model, parts: Iterable[list[str]]) -> array:
    out = array("i")
    for some in parts:
        for piece in some:
            i = model.ids.get(piece)
            if i is not None:
                out.append(i)
            elif model.bytes_:
                out.extend(model.bytes_[b] for b in piece.encode())
            elif not out or out[-1] != model.unknown:
                out.append(model.unknown)
    return out


_AHEAD = re.compile(r"[ !-/:-@\[-`{-~]")  #: where a window ends: a character that seldom goes on a piece, so that paths converge before it
_WINDOWS = re.compile(r"(?s).[^ !-/:-@\[-`{-~]*")
BLOCK = 4096  #: characters that are cut into windows at once


def _transition(model: Model, state: str, window: str, final: bool, closed: bool) -> tuple[array, int, str]:
    """What the search commits of a window from a state on: ids, characters, and the state there.

    A closed window ends in a look-ahead that no piece holds together with the character before it.
    """
    text = window.replace(" ", SPACE)
    if closed and not final and len(text) <= SHORT:
        parts = list(viterbi(model, text[:-1], state, False, True))
    else:
        parts = list(viterbi(model, text, state, final))
    size = sum([sum(map(len, some)) for some in parts])
    after = parts[-1][-1] if 0 < size < len(text) and text[size - 1:size + 1] in model.inside else ""
    return _ids(model, parts), size, after


def stream(model: Model, text: str, window: int = 1 << 15, remember: int = 400_000) -> Iterator[array]:
    """Ids of a text, given out ``window`` or a few more at once.  At most ``remember`` transitions are kept."""
    memory, joins, out, held = model._memory, not model.bytes_, array("i"), -1
    lead, base, state, n, ahead = " " if model.dummy_prefix and text else "", 0, "", len(text), _AHEAD.search
    inside, loose, windows, k, at = model.inside_raw, model.loose, [], 0, 0
    while base < n:
        if not (state or lead or joins):
            # windows whose look-ahead no piece holds together with them commit whole and leave no state: a run of them at once
            while at < base and k < len(windows):
                at += len(windows[k])
                k += 1
            if at <= base and k >= len(windows) - 1:
                windows, k, at = _WINDOWS.findall(text, base, base + BLOCK), 0, base  # the last one's end is not known
            while at == base and k < len(windows) - 1:
                some, then = windows[k], windows[k + 1][0]
                if some[-1] in loose and some[-1] + then in inside:
                    break
                hit = memory.get(some)
                if hit is None:
                    if len(some) >= SHORT:
                        break
                    if len(memory) >= remember:
                        memory.clear()
                    hit = memory[some] = (_ids(model, [_whole(model, some.replace(" ", SPACE))]), len(some), "") if model.bpe else _transition(model, "", some + then, False, True)
                out += hit[0]
                base = at = at + len(some)
                k += 1
            if len(out) >= window:
                yield out
                out = array("i")
        met = ahead(text, base if lead else base + 1)
        end = met.end() if met else n
        while True:
            some = lead + text[base:end] if lead else text[base:end]
            # where no piece holds the look-ahead and the character before it together, any look-ahead does as well
            closed = some[-2:] not in inside and len(some) > 1
            if not closed:
                key = (state, some, True)
            else:
                key = (state, some[:-1]) if state else some[:-1]
            hit = memory.get(key) if end < n else None
            if hit is None:
                hit = _transition(model, state, some, end == n, closed)
                if end < n and len(some) <= SHORT:
                    if len(memory) >= remember:
                        memory.clear()
                    memory[key] = hit
            if hit[1]:
                break
            met = ahead(text, end)  # the paths do not converge within the window
            end = met.end() if met else n
        ids, size, state = hit
        base += size - len(lead)
        lead = ""
        if joins and ids and held == model.unknown == ids[0]:
            ids = ids[1:]  # unknown characters without bytes join
        out += ids
        if joins and out:
            held = out[-1]
        if len(out) >= window:
            yield out
            out = array("i")
    yield out


def encode_ids(model: Model, text: str) -> array:
    out = array("i")
    for some in stream(model, text):
        out += some
    return out


def encode(model: Model, text: str) -> list[int]:
    """Ids of a text."""
    return encode_ids(model, text).tolist()


def decode(model: Model, ids: Sequence[int]) -> str:
    """The text of ids: bytes are joined to UTF-8 (a bad one becomes U+FFFD), control pieces vanish."""
    if not len(ids):
        return ""
    if not model.special[np.asarray(ids)].any():
        text = "".join(map(model.shown.__getitem__, ids))
        return text[1:] if model.dummy_prefix and text[:1] == " " else text
    of_byte = {i: b for b, i in enumerate(model.bytes_)}
    out, held = [], bytearray()
    for i in ids:
        if i in of_byte:
            held.append(of_byte[i])
            continue
        if held:
            out.append(_utf8(held))
            held = bytearray()
        if i == model.unknown:
            out.append(" ⁇ ")
        elif i not in model.silent:
            out.append(model.shown[i])
    if held:
        out.append(_utf8(held))
    text = "".join(out)
    return text[1:] if model.dummy_prefix and text[:1] == " " else text


def _utf8(held: bytearray) -> str:
    return bytes(held).decode("utf-8", errors="replace")


codecs.register_error("quillgraph.each_byte", lambda e: ("\ufffd", e.start + 1))


def characters(column: pa.Array) -> tuple[list[str], list[bool]]:
    """Texts of a column, every byte outside a valid character as U+FFFD; whether each had none of these."""
    try:
        found = column.to_pylist()
        return found, [True] * len(found)
    except UnicodeDecodeError:
        raw = column.cast(pa.binary()).to_pylist()
        found = [b.decode("utf-8", "quillgraph.each_byte") for b in raw]
        return found, [t.encode() == b for t, b in zip(found, raw)]


def encoded(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids (array of int) for every row; null and empty texts have no ids, an empty table no rows."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                found = [encode_ids(sent.value, t) for t in characters(part.column("body"))[0]]
                yield pa.RecordBatch.from_arrays([part.column("id"), _lists(found)], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts(docs, id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").select(F.col("id").alias(id_col), "ids")


def _lists(found: list[array]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *[np.frombuffer(f, np.int32) for f in found if f]])))


def decoded(rows: DataFrame, model: Model, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text for every row of ids; null ids decode to the empty text."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode(sent.value, ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.string())], names=["id", "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").select(F.col("id").alias(id_col), "text")


def round_trip(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_ids, ids and exact (decoding the ids gives the text) for every row; nulls as in encoded().

    A text that is no valid UTF-8 is not exact.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                bodies, valid = characters(part.column("body"))
                found = [encode_ids(sent.value, t) for t in bodies]
                exact = [fine and decode(sent.value, ids) == t for ids, t, fine in zip(found, bodies, valid)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(map(len, found), pa.int64()), _lists(found), pa.array(exact)], names=["id", "n_ids", "ids", "exact"])

    kind = docs.schema[id_col].dataType.simpleString()
    return texts(docs, id_col, text_col).mapInArrow(run, f"id {kind}, n_ids long, ids array<int>, exact boolean").select(F.col("id").alias(id_col), "n_ids", "ids", "exact")


def encoded_lengths(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Column length, the number of ids of each row's text; null and empty texts have length 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2 << 20):
                yield pa.RecordBatch.from_arrays([pa.array([sum(map(len, stream(sent.value, t))) for t in characters(part.column("body"))[0]], pa.int64())], names=["length"])

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("body")).mapInArrow(run, "length long")
