"""The manifest against a plain tree in memory, and its coordinates at the edges of ids."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import merkle as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(nodes):
    """Root and, for each node, its siblings with their side."""
    paths = [[] for _ in nodes]
    where = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(where):
            if at ^ 1 < len(nodes):
                paths[i].append((at & 1, nodes[at ^ 1]))
            else:
                paths[i].append((0, ""))
        nodes = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        where = [at // 2 for at in where]
    return nodes[0], paths


def brute(rows):
    trees = defaultdict(list)
    for row in rows:
        trees[row[2]].append((row[0] is not None, row[0] or 0, leaf(*row[:5]), row))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    roots, below = [], []
    for t in order:
        leaves = sorted(trees[t], key=lambda x: x[:3])
        root, paths = climb([x[2] for x in leaves])
        roots.append(root)
        below.append((leaves, paths))
    top, above = climb(roots) if roots else ("", [])
    out = []
    for (leaves, paths), subroot, rest in zip(below, roots, above):
        for (_, _, own, row), path in zip(leaves, paths):
            path = path + rest
            node = own
            if row[0] is not None and row[4] is not None and crc32(str(row[0]).encode()) % 7 == 0:
                node = leaf(*row[:4], row[4] + 1)
            for left, sibling in path:
                node = h(sibling, node) if left else h(node, sibling)
            out.append((row[0], own, subroot, top, h(*[s for _, s in path]), node, node == top))
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = m.manifest(docs, F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0, {"n_chars": docs["n_chars"].cast("decimal(20,0)") + 1})
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r) for r in got.collect()]


def key(row):
    return tuple((v is not None, str(v)) for v in row)


def odd_rows():
    r = random.Random(5)
    rows = [(i * 7 % 2500, f"text {i}", r.choice(["en", "de", None, "é"]), r.choice(["a", None]), r.choice([None, i])) for i in range(2500)]
    rows += [(None, None, None, None, None), (None, "x", "en", "s", 3), (None, "x", "en", "s", 3), (None, "y", "en", "s", 3)]
    rows += [(-(1 << 63), "low", "en", "s", 1), ((1 << 63) - 1, "high", "en", "s", (1 << 63) - 1), (-1, "", "en", "", 0)]
    rows += [(12, f"tie {i % 5}", "en", "s", 2) for i in range(40)]
    return rows + [(77, "w" * 100000, "lone", "s", 100000)]


def test_manifest_is_the_plain_tree(spark):
    rows = odd_rows()
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1025])
def test_small_tables(spark, n):
    rows = [(i, "t", "en", "s", i) for i in range(n)]
    got = run(spark, rows)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert all(r[6] == (crc32(str(r[0]).encode()) % 7 != 0) for r in got)


def test_one_group_of_copies_fills_many_arrays(spark):
    rows = [(5, "copy", "en", "s", 4)] * 3000 + [(i, "t", "en", "s", 1) for i in range(20)]
    assert sorted(run(spark, rows), key=key) == sorted(brute(rows), key=key)


def test_bitmaps_keep_their_numbers():
    r = np.random.default_rng(1)
    for n in (1, 5, 63, 64, 500, 1024):
        low = np.sort(r.choice(1024, n, replace=False))
        packed = m.pack(low)
        assert len(packed) == min(2 * n, 128) and (m.unpack(packed) == low).all()
        assert int(np.bitwise_count(m._words(packed)).sum()) == n
