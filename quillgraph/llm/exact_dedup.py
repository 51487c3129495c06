"""Exact deduplication with Patricia tries as owners of (length, content hash) partitions.

Every scan task first inserts its texts into a compressed radix trie of its own, so one row for each different text
leaves a task, however many copies it holds.  Those rows are dealt by length and content hash to owner tasks, whose
tries hold full byte strings: two texts meet in one terminal only if all their bytes are equal.  A terminal keeps the
smallest identifier (under the caller's order) and the number of rows.  A trie over its memory budget writes its
heaviest subtree to the task's temporary folder and works through it later, subtree by subtree.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowered, texts

_NODE_BYTES = 250  #: estimated size of a node without its label


class _Node:
    __slots__ = ("label", "children", "least", "count", "held", "spilled")

    def __init__(self, label: bytes) -> None:
        self.label, self.children = label, {}
        self.least, self.count = None, 0  # of a terminal
        self.held = 0  # bytes in this subtree
        self.spilled = None  # file of (key, least, count) entries in place of the children


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving, so that the comparisons run over whole slices."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


class PatriciaTrie:
    """Compressed radix trie from byte strings to (smallest identifier, count), spilling by subtree.

    ``budget`` bounds the bytes of labels and nodes held; beyond it the heaviest subtree below the first branching
    goes to a file in the task's temporary folder.  Identifiers compare by ``<``; None counts as larger than any.
    """

    def __init__(self, budget: int = 64 << 20, folder: str | None = None) -> None:
        self.budget, self.folder, self.root = budget, folder, _Node(b"")

    def insert(self, key: bytes, least, count: int = 1) -> None:
        node, at, path = self.root, 0, [self.root]
        while True:
            if node.spilled is not None:
                pickle.dump((key, least, count), node.spilled)
                return
            if at == len(key):
                if node.least is None or (least is not None and least < node.least):
                    node.least = least
                node.count += count
                break
            child = node.children.get(key[at])
            if child is None:
                leaf = _Node(key[at:])
                node.children[key[at]] = leaf
                leaf.least, leaf.count = least, count
                self._grow(path + [leaf], len(leaf.label) + _NODE_BYTES)
                break
            n = len(child.label)
            if key[at:at + n] != child.label:
                n = _common(child.label, key[at:])
                middle = _Node(child.label[:n])
                middle.held = child.held
                child.label = child.label[n:]
                middle.children[child.label[0]] = child
                node.children[key[at]] = middle
                child.held -= n
                self._grow([*path, middle], _NODE_BYTES)
                child = middle
            node, at = child, at + n
            path.append(node)
        if self.root.held > self.budget:
            self._spill()

    @staticmethod
    def _grow(path: list[_Node], size: int) -> None:
        for node in path:
            node.held += size

    def _spill(self) -> None:
        above, node, prefix = [self.root], self.root, b""
        while len(live := [c for c in node.children.values() if c.spilled is None]) == 1 and live[0].children and not node.count:
            node = live[0]
            prefix += node.label
            above.append(node)
        if not (live and (len(live) > 1 or node.count or len(node.children) > 1)):
            return  # a single text: nothing to part
        heavy = max(live, key=lambda c: c.held)
        out = tempfile.TemporaryFile(dir=self.folder)
        for key, least, count in _entries(heavy, prefix):
            pickle.dump((key, least, count), out)
        for x in above:
            x.held -= heavy.held
        heavy.children, heavy.held, heavy.least, heavy.count, heavy.spilled = {}, 0, None, 0, out

    def items(self) -> Iterator[tuple[bytes, object, int]]:
        """Every (key, smallest identifier, count), spilled subtrees last, each with a trie of its own."""
        files = []
        yield from _entries(self.root, b"", files)
        self.root = _Node(b"")
        for file in files:
            trie = PatriciaTrie(self.budget, self.folder)
            file.seek(0)
            with file:
                while True:
                    try:
                        trie.insert(*pickle.load(file))
                    except EOFError:
                        break
            yield from trie.items()


def _entries(node: _Node, prefix: bytes, files: list | None = None) -> Iterator[tuple[bytes, object, int]]:
    stack = [(node, prefix)]
    while stack:
        node, prefix = stack.pop()
        if node.spilled is not None and files is not None:
            files.append(node.spilled)
            continue
        if node.spilled is not None:  # a subtree of a subtree that goes to file
            node.spilled.seek(0)
            with node.spilled as file:
                while True:
                    try:
                        yield pickle.load(file)
                    except EOFError:
                        break
            continue
        key = prefix + node.label
        if node.count:
            yield key, node.least, node.count
        stack += [(child, key) for child in node.children.values()]


_LOCAL = pa.schema([("length", pa.int64()), ("digest", pa.binary()), ("content", pa.binary()), ("least", pa.int64()), ("copies", pa.int64())])
_OWNED = pa.schema([("length", pa.int64()), ("digest", pa.binary()), ("least", pa.int64()), ("copies", pa.int64())])


def _out(rows: Iterator[tuple], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[2]) if len(row) == 5 else 0)
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _scan_task(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(budget)
        for batch in batches:
            for key, least in zip(lowered(batch.column("body")), batch.column("ord").to_pylist()):
                trie.insert(key, least)
        yield from _out(((len(k), hashlib.sha256(k).digest(), k, least, n) for k, least, n in trie.items()), _LOCAL)

    return run


def _owner_task(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(budget)
        for batch in batches:
            for key, least, n in zip(*(batch.column(c).to_pylist() for c in ("content", "least", "copies"))):
                trie.insert(key, least, n)
        yield from _out(((len(k), hashlib.sha256(k).digest(), least, n) for k, least, n in trie.items()), _OWNED)

    return run


def _digest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = lowered(batch.column("body"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(map(len, keys), pa.int64()), pa.array([hashlib.sha256(k).digest() for k in keys], pa.binary())],
            names=["id", "length", "digest"])


def owners(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", budget: int = 64 << 20) -> DataFrame:
    """One row for each different text: length, digest (sha-256), keep_id and group_size.

    Two shuffled rows meet only for texts of one length and content hash; what is shuffled is one row for each
    task and text, so a text with any number of copies costs its owner one row a task.
    """
    sign = -1 if keep == "largest" else 1
    local = texts(docs, id_col, text_col).select((F.col("id").cast("long") * sign).alias("ord"), "body").mapInArrow(
        _scan_task(budget), "length long, digest binary, content binary, least long, copies long")
    owned = local.repartition("length", F.xxhash64("content")).mapInArrow(_owner_task(budget), "length long, digest binary, least long, copies long")
    return owned.select("length", "digest", (F.col("least") * sign).alias("keep_id"), F.col("copies").alias("group_size"))


def exact_groups(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", budget: int = 64 << 20) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z only; a null text counts as empty, so null and
    empty texts form one group.  Of equal texts the row with the largest (or smallest) id stays.  Null ids lose to
    all others; a group of null ids alone keeps id null and drops nothing.  Rows that repeat an id and a text are
    the same document and share its decision.  An empty table gives an empty result.
    """
    each = texts(docs, id_col, text_col).mapInArrow(_digest_task, f"id {docs.schema[id_col].dataType.simpleString()}, length long, digest binary")
    joined = each.join(owners(docs, keep, id_col, text_col, budget), ["length", "digest"])
    return joined.select(
        F.col("id").alias(id_col), F.col("keep_id").cast(docs.schema[id_col].dataType).alias("keep_id"), "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text", budget: int = 64 << 20) -> DataFrame:
    """docs without the rows that exact_groups() drops; columns as they were.

    A row is told by its id and its text, so rows that share an id but not a text are decided on one by one.
    """
    gone = exact_groups(docs, keep, id_col, text_col, budget).filter(~F.col("kept")).select(F.col(id_col).alias("_gone"), F.col("text_sha256").alias("_digest")).distinct()
    latin = F.decode(F.coalesce(docs[text_col], F.lit("")).cast("binary"), "ISO-8859-1")  # byte by byte: translate() rewrites bytes that are no UTF-8
    digest = F.sha2(F.encode(F.translate(latin, ascii_uppercase, ascii_lowercase), "ISO-8859-1"), 256)
    return docs.join(gone, docs[id_col].eqNullSafe(gone["_gone"]) & (digest == gone["_digest"]), "left_anti")
