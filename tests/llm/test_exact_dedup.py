import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm.exact_dedup import PatriciaTrie, drop_exact_copies, exact_groups


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([300, 1000, 3000, 10**9]))
def test_trie_holds_what_a_dict_holds_at_any_budget(seed, budget):
    r, trie, want = random.Random(seed), PatriciaTrie(budget), {}
    for _ in range(r.randint(0, 120)):
        key = bytes(r.choice(b"ab") for _ in range(r.randint(0, 12))) * r.choice([1, 1, 3])
        least = r.choice([None, r.randint(0, 50)])
        trie.insert(key, least)
        a, n = want.get(key, (None, 0))
        want[key] = (least if a is None else a if least is None else min(a, least), n + 1)
    got = list(trie.items())
    assert len(got) == len(want)
    assert {k: (least, n) for k, least, n in got} == want


ROWS = [(1, "Same Text"), (2, "same text"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 300_000), (8, "X" * 300_000), (9, "same text "), (None, "same text"), (11, "alone")]


def test_groups_against_brute_force(spark):
    docs = spark.createDataFrame([(*x, "k") for x in ROWS], "doc_id long, text string, digest string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_groups(docs, budget=2000).collect()}
    assert got == {1: (2, 3, False), 2: (2, 3, True), None: (2, 3, False), 3: (4, 2, False), 4: (4, 2, True), 5: (5, 1, True), 6: (6, 1, True), 7: (8, 2, False), 8: (8, 2, True), 9: (9, 1, True), 11: (11, 1, True)}


def test_smallest_can_stay_and_columns_are_left_alone(spark):
    docs = spark.createDataFrame([(*x, "k") for x in ROWS], "doc_id long, text string, digest string")
    left = drop_exact_copies(docs, keep="smallest")
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 5, 6, 7, 9, 11]


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(empty).count() == 0
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    assert all(r["kept"] and r["group_size"] == 2 for r in exact_groups(rows).collect())


def test_rows_that_share_an_id_are_told_by_their_texts(spark):
    docs = spark.createDataFrame([(5, "A", 0), (5, "b", 1), (7, "a", 2), (None, "b", 3), (8, None, 4), (9, "", 5)], "doc_id long, text string, _gone int")
    assert sorted(r["_gone"] for r in drop_exact_copies(docs).collect()) == [1, 2, 5]
