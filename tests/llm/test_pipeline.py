import random

import duckdb
import pytest

import corpus_pipeline
from quillgraph.llm import exact_dedup, mixing, quality_cnn, queries, sentencepiece_codec, simhash
from quillgraph.llm.common import materialise, remainder
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.test_catalog import DATA, TABLES, plain


def words(r, n):
    return " ".join("".join(r.choice("aeiou" if i % 2 else "bcdlmnrst") for i in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with junk, toxic words, exact copies and near copies, nulls and an extra column."""
    r, root = random.Random(8), str(tmp_path_factory.mktemp("sf"))
    docs, labels = [], []
    for i in range(240):
        body = words(r, r.randint(40, 160))
        if i % 5 == 0:
            body = " ".join(w + "###" for w in body.split())
        if i % 6 == 1:
            body += " idiot moron " + body[:40]
        docs.append((i, body, "en", "src0", len(body), "extra"))
        labels.append((i, int(i % 5 != 0), int(i % 6 == 1)))
    docs += [(300 + i, docs[i][1].upper() if i % 2 else docs[i][1], "en", "src1", 1, "extra") for i in range(1, 60, 3)]
    docs += [(400 + i, docs[i][1] + " tail", "en", "src1", 1, "extra") for i in range(2, 60, 3)]
    docs += [(500, None, None, None, 0, None), (501, "", "en", "src0", 0, None), (None, words(r, 50), "en", "src0", 1, "extra")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages_against_brute_force(spark, folder):
    docs, low = spark.read.parquet(f"{folder}/documents.parquet"), lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    net = quality_cnn.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), remainder("doc_id", 4) != 2)
    p = dict(zip(rows, quality_cnn.score(net, [(t or "").encode() for t in rows.values()])))
    kept = {i: t for i, t in rows.items() if p[i] >= 0.5}
    one = corpus_pipeline.quality(spark, docs, folder).collect()
    assert {r["doc_id"] for r in one} == set(kept)
    assert sum(i in kept for i in range(240) if i % 5) >= 185 and sum(i in kept for i in range(0, 240, 5)) <= 4
    last = {}
    for i, t in kept.items():
        if i is not None:
            last[low(t)] = max(i, last.get(low(t), i))
    alone = {i: t for i, t in kept.items() if last.get(low(t), i) == i}
    two = corpus_pipeline.exact(spark, docs.filter(docs["doc_id"].isin([i for i in kept if i is not None]) | docs["doc_id"].isNull()), folder)
    assert {r["doc_id"] for r in two.collect()} == set(alone)
    ids = [i for i in alone if i is not None]
    root, least = brute_components([brute_fingerprint(alone[i]) for i in ids]), {}
    for i, c in zip(ids, root):
        least[c] = min(i, least.get(c, i))
    three = {r["doc_id"] for r in corpus_pipeline.near(spark, two, folder).collect()}
    assert three == {least[c] for c in root} | {i for i in alone if i is None}


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    model = sentencepiece_codec.load(queries.TOKENIZER)
    assert 60 < len(out) == len({r["doc_id"] for r in out})
    assert all(r["exact"] and sentencepiece_codec.decode(model, r["ids"]) == (texts[r["doc_id"]] or "") for r in out)
    prints = [brute_fingerprint(texts[r["doc_id"]]) for r in out if r["doc_id"] is not None]
    assert brute_components(prints) == list(range(len(prints)))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "sentencepiece"]


def test_run_over_bytes_that_are_no_characters(spark, tmp_path):
    """Texts that are no valid UTF-8 go through all stages: of equal ones one stays, unequal ones stay, all are encoded."""
    r, good = random.Random(4), {}
    for i in range(0, 60, 3):
        body = words(r, 60).encode()
        good |= {i: b"\xff" + body[:100] + b"\xe2\x82" + body[100:], i + 1: b"\xff" + body[:100].upper() + b"\xe2\x82" + body[100:], i + 2: words(r, 60).encode()}
    docs = spark.createDataFrame([(i, bytearray(b)) for i, b in good.items()], "doc_id long, text binary").selectExpr("doc_id", "cast(text AS string) AS text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")  # all alike: no stage but exact_dedup drops rows
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.exact(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(x["doc_id"] for x in kept.select("doc_id").collect()) == [i for i in range(60) if i % 3]
    out, model = {x["doc_id"]: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}, sentencepiece_codec.load(queries.TOKENIZER)
    assert sorted(out) == [i for i in range(60) if i % 3]
    for i, x in out.items():
        text = sentencepiece_codec.decode(model, x["ids"])
        assert x["exact"] == (i % 3 == 2) and text.replace("\ufffd", "") == good[i].decode(errors="ignore")


def test_domain_shares_of_the_run(spark, folder):
    """run() keeps the rows that the rates draw; their expected tokens have the wanted shares, those kept are as near as chance."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    docs = read("documents")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = materialise(stage(spark, docs, folder), name)
    fitted = mixing.train(read("documents"), queries.domain_labels(read("labels")), queries.DOMAINS)
    drawn = [r for r in mixing.rates(docs, fitted, queries.WEIGHTS, most=1.0).collect() if r["doc_id"] is not None]
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} - {None}
    assert kept == {r["doc_id"] for r in drawn if r["copies"]}
    mass, wanted, got, chance = ({n: sum(f(r, r["tokens"] * r[f"p_{n}"]) for r in drawn) for n in queries.DOMAINS} for f in (
        lambda r, x: x, lambda r, x: x * r["rate"], lambda r, x: x * (r["doc_id"] in kept), lambda r, x: x * x * r["rate"] * (1 - r["rate"])))
    heavy = max(queries.WEIGHTS, key=queries.WEIGHTS.get)
    for n in queries.DOMAINS:
        asked = wanted[heavy] * queries.WEIGHTS[n] / queries.WEIGHTS[heavy]
        assert wanted[n] == pytest.approx(min(asked, mass[n]), rel=0.02) or mass[n] < asked
        assert abs(got[n] - wanted[n]) <= 5 * chance[n] ** 0.5 + 1e-6 * mass[heavy]


def test_stages_on_an_empty_table(spark, folder):
    empty = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
    assert exact_dedup.exact_groups(empty).count() == 0 and simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = queries.queries()[name](spark, DATA).toPandas(), con.execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
