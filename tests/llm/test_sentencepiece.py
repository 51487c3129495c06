import random
import tracemalloc

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import sentencepiece_codec as c

PATH = "/opt/tokenizers/piece_bpe_32k.model"
MODEL = c.load(PATH)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abcdeilnorst  \n.", max_size=200), st.text(alphabet="the an=-_/\t▁é0123 ", max_size=120)))
def test_ids_equal_the_models_own_encoder_and_decode_back(text):
    text = text.encode(errors="ignore").decode()
    ids = c.encode(MODEL, text)
    assert ids == LIBRARY.encode(text)
    if "▁" not in text:
        assert c.decode(MODEL, ids) == text


def test_long_runs_commit_within_the_window():
    r = random.Random(3)
    for text in ("a" * 5000, "".join(r.choice("abcdefgh") for _ in range(20_000)), "=" * 999, "ab" * 4000):
        parts = list(c.viterbi(MODEL, c.SPACE + text))
        assert len(parts) > 3
        assert c._ids(MODEL, iter(parts)).tolist() == LIBRARY.encode(text) == c.encode(MODEL, text)


def test_the_search_commits_all_along_real_documents(spark):
    """Over whole documents: by the search alone, and window by window with transitions."""
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in texts[:60]:
        want = LIBRARY.encode(text)
        if text:
            parts = list(c.viterbi(MODEL, c.SPACE + text.replace(" ", c.SPACE)))
            assert c._ids(MODEL, iter(parts)).tolist() == want
            assert len(parts) >= len(text.split()) and max(sum(map(len, p)) for p in parts) < 200
        for size in (1, 40, 1 << 15):
            assert [i for some in c.stream(MODEL, text, size) for i in some] == want


def test_the_query_commits_where_paths_converge(spark):
    """In the query's own function: nearly all that the search gives out is committed by converging paths, and what it
    keeps by state and window gives the same ids again."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()
    model, texts = c.load(PATH), [r["text"] or "" for r in rows]
    first = [c.encode_ids(model, t).tolist() for t in texts]
    found = model.converged
    assert found > 10_000 and len(model._memory) > 10_000
    assert [c.encode_ids(model, t).tolist() for t in texts] == first == [LIBRARY.encode(t) for t in texts]
    assert model.converged - found < 0.1 * found  # windows beyond the kept size and texts' ends alone are searched again
    assert any(isinstance(k, tuple) for k in model._memory) and any(isinstance(k, str) for k in model._memory)


def test_a_transition_does_not_depend_on_what_follows_a_closed_window():
    r = random.Random(9)
    for _ in range(3000):
        text = "".join(r.choice("ab .,-é▁1\n") for _ in range(r.randrange(1, 30)))
        fresh = c.load(PATH) if r.random() < 0.002 else MODEL
        assert c.encode(fresh, text) == LIBRARY.encode(text)


def test_runs_of_windows_give_the_models_ids(monkeypatch):
    """Wherever the blocks are cut, with windows kept from other texts, and without asking where each window ends."""
    r = random.Random(5)
    words = ["the", "mine", "(a)", "--", " ", "...", "été", "▁", "x" * 70, "\n", "0123", "e.g.,", "tionbleer"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(60))) for _ in range(80)]
    for block in (2, 7, 4096):
        monkeypatch.setattr(c, "BLOCK", block)
        model = c.load(PATH)
        assert all(c.encode(model, x) == LIBRARY.encode(x) for x in texts + texts[::-1])


def test_unknown_characters_without_bytes_join_across_windows():
    names = ["▁", "a", "b", "ab", ","]
    model = c.Model(names, {n: i for i, n in enumerate(names)}, {n: -1.0 - i for i, n in enumerate(names)}, [], 99, frozenset(), False, False, 2)
    assert c.encode(model, "xx ab,y,,z") == [99, 0, 3, 4, 99, 4, 4, 99]
    assert c.encode(model, "x" * 500 + "ab") == [99, 3]


def test_memory_follows_the_window():
    """Of a long text no more is held than a window's ids and the transitions."""
    text = "".join(f"word{i % 50_000} " for i in range(1_000_000))
    list(c.stream(MODEL, text[:100_000]))
    tracemalloc.start()
    total = sum(map(len, c.stream(MODEL, text)))
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total > 2_000_000 and held < 40 << 20


def test_unigram_paths_have_the_best_weight():
    r = random.Random(5)
    names = ["a", "b", "c", "ab", "bc", "abc", "cab", "aa", "bb"]
    scores = {n: -r.uniform(1, 4) * len(n) ** 0.5 for n in names}
    model = c.Model(names, {n: i for i, n in enumerate(names)}, scores, [], 99, frozenset(), False, False, 3)

    def brute(text):
        best = [0.0] + [float("-inf")] * len(text)
        for i in range(1, len(text) + 1):
            best[i] = max(best[j] + scores[text[j:i]] for j in range(max(0, i - 3), i) if text[j:i] in scores)
        return best[-1]

    for _ in range(100):
        text = "".join(r.choice("abc") for _ in range(r.randint(1, 200)))
        path = [p for some in c.viterbi(model, text) for p in some]
        assert "".join(path) == text
        assert sum(scores[p] for p in path) == pytest.approx(brute(text))


def test_tables(spark):
    rows = [(1, "Hello  world\n"), (2, None), (3, ""), (4, "日本語 😀 text"), (4, "日本語 😀 text"), (None, "x" * 100_000)]
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, ids int")
    got = c.round_trip(docs, MODEL).collect()
    assert len(got) == 6 and all(r["exact"] and r["n_ids"] == len(r["ids"]) for r in got)
    assert [r["ids"] for r in got if r["doc_id"] == 4] == [LIBRARY.encode(rows[3][1])] * 2
    back = c.decoded(c.encoded(docs, MODEL), MODEL).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    assert c.encoded(docs.limit(0), MODEL).count() == 0


def test_bytes_that_are_no_characters_get_the_models_ids(spark):
    """Spark's strings may hold any bytes: cut and overlong characters, surrogates, bytes that begin nothing."""
    whole, cut = "valid €".encode(), b"\xff cut \xe2\x82 and \xed\xa0\x80, \xc0\xaf and \xf0\x9f\x98 at the end \xc3"
    rows = spark.createDataFrame([(1, bytearray(cut)), (2, bytearray(whole)), (3, None)], "doc_id long, text binary")
    docs = rows.coalesce(1).selectExpr("doc_id", "cast(text AS string) AS text")
    got = {r["doc_id"]: r for r in c.round_trip(docs, MODEL).collect()}
    assert [got[i]["ids"] for i in (1, 2, 3)] == [LIBRARY.encode(cut), LIBRARY.encode(whole), []]
    assert [got[i]["exact"] for i in (1, 2, 3)] == [False, True, True]
    assert {r["doc_id"]: r["ids"] for r in c.encoded(docs, MODEL).collect()} == {i: r["ids"] for i, r in got.items()}
    assert sorted(r["length"] for r in c.encoded_lengths(docs, MODEL).collect()) == sorted(r["n_ids"] for r in got.values())
