"""Repair of conversations by weighted CYK parsing.

The turns of a conversation are a string of role initials that should be ``(s?(ua)+)?``: perhaps a system turn, then user
and assistant in turn.  The grammar is in Chomsky normal form over the pairs of states (p, q) of that pattern's automaton:
``[p q] -> [p r] [r q]`` for every r, and ``[p q] -> row`` with the cost of an edit that leads from p to q.  Insertions
make no span longer, so every row's cells are closed under insertions on either side once.  A cell holds the least
(cost, audit) with which its span leads from p to q; spans are combined bottom-up by length, over all split points inside
a block of rows.  Blocks are then joined by doubling lengths: the cells of a span are the same for every split point, so
one is enough there, and a conversation of any length needs no cubic work.

Least (cost, audit) pairs may be kept cell by cell: at equal cost one audit is never a proper prefix of another, as
both hold a letter for every row of the span and further insertions would cost more.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  #: costs of the edits, and of leaving a truncated row in
BLOCK = 16  #: rows parsed over all split points
WHITE = " \t\n\v\f\r"
START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
MOVES = {(START, "s"): AFTER_SYSTEM, (START, "u"): AFTER_USER, (AFTER_SYSTEM, "u"): AFTER_USER, (AFTER_USER, "a"): AFTER_ASSISTANT, (AFTER_ASSISTANT, "u"): AFTER_USER}
ENDS = (START, AFTER_ASSISTANT)
SPOKEN = {"u": "user", "a": "assistant"}

Cells = dict[tuple[int, int], tuple[int, str]]


def combined(left: Cells, right: Cells, into: Cells | None = None) -> Cells:
    """The rule [p q] -> [p r] [r q] over two neighbouring spans, into cells of their union."""
    found = {} if into is None else into
    for (p, r), (a, x) in left.items():
        for q in range(4):
            if (r, q) in right:
                b, y = right[r, q]
                if (p, q) not in found or a + b < found[p, q][0] or (a + b == found[p, q][0] and x + y < found[p, q][1]):
                    found[p, q] = (a + b, x + y)
    return found


def _insertions() -> Cells:
    """What insertions alone can do: the closure of one insertion, and of none."""
    one: Cells = {(p, q): (INSERT, "I") for (p, role), q in MOVES.items() if role in SPOKEN}
    closed: Cells = {(p, p): (0, "") for p in range(4)}
    for _ in range(4):
        closed = combined(closed, one, dict(closed))
    return closed


INSERTIONS = _insertions()


def row_cells(initial: str, fault: str) -> Cells:
    """Cells of one row: delete it, keep it, or give it another role; closed under insertions before and after."""
    cells: Cells = {(p, p): (DELETE, "D") for p in range(4)}
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        for (p, role), q in MOVES.items():
            if role == initial:
                cells[p, q] = (KEEP + more, "K")
            elif role in SPOKEN:
                cells[p, q] = (REROLE + more, "R")
    return combined(combined(INSERTIONS, cells), INSERTIONS)


def block_cells(rows: list[Cells]) -> Cells:
    """CYK over a block: the chart's spans by length, each from all its split points."""
    chart = {(i, i + 1): cells for i, cells in enumerate(rows)}
    for length in range(2, len(rows) + 1):
        for i in range(len(rows) - length + 1):
            span: Cells = {}
            for split in range(i + 1, i + length):
                combined(chart[i, split], chart[split, i + length], span)
            chart[i, i + length] = span
    return chart[0, len(rows)]


class Parser:
    """Takes a conversation's rows one by one; holds cells of spans of falling lengths, never a chart of all rows."""

    def __init__(self) -> None:
        self.block: list[Cells] = []
        self.spans: list[tuple[int, Cells]] = []
        self.known: dict[tuple[str, str], Cells] = {}

    def add(self, initial: str, fault: str) -> None:
        if (initial, fault) not in self.known:
            self.known[initial, fault] = row_cells(initial, fault)
        self.block.append(self.known[initial, fault])
        if len(self.block) == BLOCK:
            self._close()

    def _close(self) -> None:
        size, cells = 1, block_cells(self.block)
        self.block = []
        while self.spans and self.spans[-1][0] == size:
            size, cells = size * 2, combined(self.spans.pop()[1], cells)
        self.spans.append((size, cells))

    def result(self) -> tuple[int, str]:
        """The least (cost, audit) from the start to an accepting state."""
        if self.block:
            size, cells = 0, block_cells(self.block)
        elif self.spans:
            size, cells = self.spans.pop()
        else:
            return 0, ""
        while self.spans:
            cells = combined(self.spans.pop()[1], cells)
        return min(cells[START, end] for end in ENDS if (START, end) in cells)


def repaired(audit: Iterator[str] | str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """Role and text of the repaired turns; a rerole or insertion takes the role that the pattern asks for."""
    state = START
    for edit in audit:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit != "K":
            role = SPOKEN["a" if state == AFTER_USER else "u"]
        state = MOVES[state, role[:1]]
        yield role, text


def fault(text: str, again: bool) -> str:
    """A row's first fault: blank, duplicate, truncated, or none."""
    seen = text.rstrip(WHITE)
    if not seen:
        return "blank"
    if again:
        return "duplicate"
    return "" if seen[-1] in ".!?" else "truncated"


class _Conversation:
    """Counts, parse and repaired digest of one conversation, fed in order; texts beyond a size wait in a scratch file of the task."""

    def __init__(self, held: int = 4 << 20) -> None:
        self.parser, self.texts = Parser(), tempfile.SpooledTemporaryFile(max_size=held)
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before: str | None = None

    def add(self, role: str, text: str, again: bool) -> None:
        kind, initial = fault(text, again), role[:1]
        self.blank += kind == "blank"
        self.duplicate += kind == "duplicate"
        self.truncated += kind == "truncated"
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.parser.add(initial, kind)
        for part in (role.encode(), text.encode()):
            self.texts.write(len(part).to_bytes(8, "little") + part)

    def _rows(self) -> Iterator[tuple[str, str]]:
        def part() -> str:
            return self.texts.read(int.from_bytes(self.texts.read(8), "little")).decode()

        while True:
            yield part(), part()

    def result(self) -> tuple[int, int, int, int, int, str, str]:
        cost, audit = self.parser.result()
        self.texts.seek(0)
        digest = hashlib.sha256()
        for i, (role, text) in enumerate(repaired(audit, self._rows())):
            digest.update((f"\n{role}:{text}" if i else f"{role}:{text}").encode())
        self.texts.close()
        return self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.hexdigest()


def damaged(rows: DataFrame, bucket: Column) -> DataFrame:
    """Rows after damage by bucket: 0 drops, 1 empties the text, 2 removes its ends of sentences, 3 repeats the row next to
    it, 4 makes the role user.  Adds copy (0 or 1), the place of a repeated row."""
    out = rows.withColumn("bucket", bucket).filter(F.col("bucket") != 0)
    out = out.withColumn("text", F.when(F.col("bucket") == 1, "").when(F.col("bucket") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("bucket") == 4, "user").otherwise(F.col("role")))
    return out.withColumn("copy", F.explode(F.when(F.col("bucket") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))


_RESULT = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame, key: str = "key") -> DataFrame:
    """One row for each conversation of rows (key, place, role, text; place orders a conversation's rows): key, the counts
    blank, duplicate, truncated and illegal, cost, audit and repaired_sha256.

    A conversation is read in order by one task, as its digest is a chain over its texts; the task holds a letter or so
    for each of its rows, and texts only up to a bound.  Repeats are found in windows over equal rows, which Spark spills.
    """
    kind = rows.schema[key].dataType.simpleString()
    same = Window.partitionBy(key, "role", "text").orderBy("place")
    told = rows.withColumn("again", F.row_number().over(same) > 1)
    told = told.repartition(key).sortWithinPartitions(key, "place").select(key, "role", "text", "again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, done = None, None, []
        schema = pa.schema([(key, batch_type), *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], f.type) for i, f in enumerate(schema)], schema=schema)

        for batch in batches:
            for one, role, text, again in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                if now is None or one != last:
                    if now is not None:
                        done.append((last, *now.result()))
                    last, now = one, _Conversation()
                now.add(role, text, again)
            if len(done) >= 1000:
                yield packed()
                done = []
        if now is not None:
            done.append((last, *now.result()))
        if done:
            yield packed()

    batch_type = pa.string() if kind == "string" else pa.int64()
    return told.mapInArrow(run, f"{key} {kind}, {_RESULT}")


def report(conversations: DataFrame, bucket: Callable[[Column, Column], Column], id_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation of the table, damaged first by ``bucket`` (of id and turn as text): id_col, gaps, the
    counts, cost, audit and repaired_sha256.

    Null ids are one conversation, null roles, texts and, for the bucket, ids and turns count as one space.  Rows are
    ordered by turn, nulls first, then role and a hash of the text as they were; a repeated row follows its copy.
    A role whose initial is none of s, u, a (or that is empty) cannot be kept.  A conversation without rows after damage has zeros, an empty audit
    and the digest of the empty text.  An empty table gives no rows; further columns are not read.
    """
    blank = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    key = F.coalesce(F.concat(F.lit("="), conversations[id_col].cast("string")), F.lit(""))
    rows = conversations.select(key.alias("key"), conversations[turn_col].cast("long").alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"), blank(id_col).alias("_id"), blank(turn_col).alias("_turn"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn", F.col("role").alias("was"), F.xxhash64("text").alias("hash"))
    kept = damaged(rows.withColumn("order", order), bucket(F.col("_id"), F.col("_turn")))
    kept = kept.select("key", "turn", "role", "text", F.struct("order", "copy").alias("place"))
    gaps = F.coalesce(F.max("turn").cast("decimal(20,0)") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long")
    turns = kept.groupBy("key").agg(gaps.alias("gaps"))
    ids = conversations.select(key.alias("key"), conversations[id_col].alias(id_col)).distinct()
    found = ids.join(turns, "key", "left").join(repair(kept.drop("turn")), "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select(id_col, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
