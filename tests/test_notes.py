import json
import os

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import context, graph, parse, score, stats
from quillgraph.plans import pipelines
from quillgraph.plans.provider import FINAL, ProviderError, load_config, with_retries
from quillgraph.sources import notes as n
from tests import vault


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return vault.write(tmp_path_factory.mktemp("notes"))


@pytest.fixture(scope="module")
def index(spark, root):
    return pipelines.build_index(spark, root)


@pytest.fixture(scope="module")
def rows(index):
    return {r["uid"]: r for r in index.nodes.collect()}


def test_scan_and_duplicate_names(index, rows):
    assert index.files.count() == vault.VISIBLE
    assert "bad" not in rows and rows["Twin"]["summary"] == "second"
    assert rows["Ünïcode Näme"]["rel_path"] == "Land/Ünïcode Näme.md"
    first = {r["id"]: r for r in n.load_entities(index.files).collect()}
    assert "first twin" in first["Twin"]["content"] and first["Acme Mine"]["slug"] == "acme-mine"


def test_headers_summaries_and_types(rows):
    assert rows["Acme Mine"]["summary"] == "Digs lithium."
    assert rows["Ministry of Mines"]["summary"] == "Licenses mines."
    assert rows["Lithium"]["summary"] == "A metal." and rows["Lithium"]["country"] == "" and rows["Lithium"]["entity_type"] == "commodity"
    assert rows["Broken"]["fm"] == {} and rows["Broken"]["body"] == "Body of the broken one about a railway." and rows["Broken"]["entity_type"] == "infrastructure_node"
    assert rows["Plain"]["body"].startswith("No header") and rows["Plain"]["entity_type"] == "academic_institution"
    assert rows["Empty Summary"]["summary"].startswith("## Core Information")
    assert rows["Listy"]["summary"] == "late"
    assert rows["Ünïcode Näme"]["summary"] == "ä" * 400
    assert json.loads(rows["Ministry of Mines"]["fm_json"])["last_updated"] == "2026-01-02"
    assert rows["Ministry of Mines"]["sections"] == {"Key Contacts": "Jane"}


def test_links_resolve_and_dangling_ones_stay(index, rows):
    assert rows["Acme Mine"]["outbound_links"] == ["Land", "Ministry of Mines", "Lithium", "Ghost Town", "Acme Mine"]  # the header's links count
    assert rows["Ministry of Mines"]["outbound_links"] == ["Acme Mine"]
    assert rows["Lithium"]["backlink_uids"] == ["Acme Mine", "Plain"]
    assert sorted(rows["Acme Mine"]["backlink_uids"]) == ["Acme Mine", "Lithium", "Ministry of Mines"]
    assert {r["dst"] for r in graph.dangling(index.edges).filter("src = 'Acme Mine'").collect()} == {"Land", "Ghost Town"}


def test_news_profile_keeps_paths(spark, root):
    nodes = parse.nodes(n.read_notes(spark, root), "news").filter("uid = 'Acme Mine'").first()
    assert "x/y/Lithium" in nodes["raw_links"] and nodes["raw_links"].count("Ghost Town") == 1
    assert n.read_notes(spark, root, recursive=False).count() == 0


def test_folders(index, rows):
    found = {r["dir"]: r["n_files"] for r in n.directories(index.files).collect()}
    assert found == {"Land": 5, "Land/Companies": 1, "Land/Government": 1, "Land/Commodities": 1, "Land/A": 1, "Land/B": 1}
    assert rows["Acme Mine"]["folder_type"] == "business" and rows["Plain"]["folder_type"] == "unknown"


def test_search_prefilter_anchors_and_crawl(index):
    assert {r["uid"] for r in score.search(index.nodes, "LITHIUM").collect()} == {"Acme Mine", "Lithium", "Plain"}
    assert score.search(index.nodes, "").count() == index.nodes.count()
    got = score.pre_filter(index.nodes, score.Intent("SPECIFIC_ENTITY", ["Acme"], ["mining"], ["land"])).collect()
    assert got[0]["uid"] == "Acme Mine" and got[0]["score"] >= 18
    a = score.anchors(index.nodes, ["acme", "ministry"], k=1)
    assert [r["uid"] for r in a.collect()] == ["Acme Mine"]
    assert [r["uid"] for r in graph.crawl(index.edges, a).orderBy("ord").collect()] == ["Acme Mine", "Ministry of Mines", "Lithium"]
    assert score.anchors(index.nodes, []).count() == 0
    order = [r["uid"] for r in context.chunks(index.nodes, [F.col("uid")], size=4).filter("chunk = 1").orderBy("uid").collect()]
    assert order == [r["uid"] for r in index.nodes.orderBy("uid").collect()][4:8]


def test_question_end_to_end(spark, index, tmp_path):
    out = pipelines.run_query(spark, index, "Which ministry regulates Acme Mine", output=str(tmp_path))
    assert out["intent"]["entities"] == ["Acme Mine"] and {"Acme Mine", "Ministry of Mines"} <= {r["source_node"] for r in out["structured_intelligence"]}
    assert {e["to"] for e in out["entity_graph"]["edges"]} <= {x["id"] for x in out["entity_graph"]["nodes"]}
    saved = json.loads(open(out["files_written"][0]).read())
    assert saved["stats"]["total_entities"] == out["filter_stats"]["ranked_by_llm"]
    assert pipelines.run_query(spark, index, None)["scan_mode"] == "full_vault_capped"
    bad = pipelines.run_query(spark, index, "x", provider=lambda s, u: "no json" if s.startswith("intent") else '{"ranked_nodes": [{"node_id": "nobody"}]}')
    assert bad["intent"]["kind"] == "OVERVIEW" and bad["source_nodes"] == []


def test_citations():
    sources = [{"uid": "A", "entity_type": "t"}]
    out = pipelines.grounded('```json\n{"structured_intelligence": [{"source_node": "B"}, {"source_node": "A"}], "findings": [{"text": "x", "source_nodes": ["A", "B"]}, {"text": "y", "source_nodes": ["B"]}, "z"], "risks": 3}\n```', sources)
    assert [r["source_node"] for r in out["structured_intelligence"]] == ["citation_missing", "A"]
    assert [f["source_nodes"] for f in out["findings"]] == [["A", "B"], ["citation_needed"], ["citation_needed"]] and out["risks"] == []


def test_article_end_to_end(spark, index, tmp_path):
    table = str(tmp_path / "shadow")
    out = pipelines.run_news(spark, index, "Today in Land, the Acme Mine met Unknown Smelter Works.", shadow_table=table, output=str(tmp_path))
    assert out["pipeline_metadata"]["extracted_entities_count"] >= 2
    assert "Unknown Smelter Works" in {r["name"] for r in spark.read.parquet(table).collect()}
    bundle = pipelines.crawl_bundle(index, "Acme Mine")
    assert "OUTBOUND LINKED CONTEXT: Lithium" in bundle and "[[Ministry of Mines]] [node_type" in bundle


def test_bundles_are_bounded(index):
    whole, small = pipelines.crawl_bundle(index, "Lithium"), pipelines.crawl_bundle(index, "Lithium", room=7)
    assert "[[Acme Mine]]" in whole and "[[Plain]]" in whole and whole.startswith("--- CORE NODE: Lithium ---")
    assert "OUTBOUND LINKED CONTEXT: Acme Mine" in small and "[[Plain]]" in small
    assert "[[Plain]]" not in pipelines.crawl_bundle(index, "Lithium", room=0) and pipelines.crawl_bundle(index, "nobody") == ""


def test_opportunity_end_to_end(spark, index, tmp_path):
    board = json.dumps({"opportunities": [{"opportunity_id": "O1", "title": "Acme lithium", "required_missing_nodes": ["ACME LITHIUM", "Smelter"], "capital_flow": {"beneficiary": "Acme"}}, {"id": "O2", "name": "nothing at all zz"}]})
    out = pipelines.run_execute(spark, index, board, "O1", output=str(tmp_path))
    assert {t["source_node"] for t in out["compiled_lineage_traces"]} >= {"Acme Mine", "Lithium"}
    assert json.load(open(tmp_path / "reasoning_O1.json"))["compiled_lineage_traces"]
    broken = pipelines.run_execute(spark, index, board, "O2", provider=lambda s, u: "plain" if s.startswith("map") else "<ui_thinking_graph>[</ui_thinking_graph>" + u, output=str(tmp_path))
    assert "DEBUG" in "".join(broken["files_written"])
    with pytest.raises(ValueError):
        pipelines.run_execute(spark, index, board, "O3")


def test_entities(index):
    hit = pipelines.get_entity(index, "acme%2520mine")
    assert hit["uid"] == "Acme Mine" and [r["relation_type"] for r in hit["related"]][0] == "outbound"
    assert pipelines.get_entity(index, "nobody") is None
    assert pipelines.search_entities(index, "twin").count() == 1 and pipelines.list_entities(index).count() == index.nodes.count()


def test_stats_and_subset(index):
    subset = index.nodes.filter("uid in ('Acme Mine', 'Lithium')")
    got = stats.vault_stats(index.nodes, index.edges, subset).first()
    assert (got["total_entities"], got["total_relationships"], got["commodities_tracked"]) == (2, 6, 2)  # "Core" holds "ore"


def test_cache_notices_changes(spark, root, index):
    held, calls = pipelines.Cache(), []
    run = lambda: held.run(spark, index, "Acme", provider=lambda s, u: calls.append(s) or "{}")
    run(), run()
    assert len(held.held) == 1 and len(calls) <= 3


def test_retries_fall_back_but_final_answers_do_not():
    waits, seen = [], []

    def failing(status):
        def call(system, user):
            seen.append(status)
            raise ProviderError(status, "no")
        return call

    assert with_retries(failing(500), lambda s, u: "ok", wait=waits.append)("s", "u") == "ok"
    assert waits == [1.0, 2.0] and seen == [500] * 3
    with pytest.raises(ProviderError):
        with_retries(failing(min(FINAL)), lambda s, u: "ok", wait=waits.append)("s", "u")


def test_config_lines(tmp_path):
    (tmp_path / ".env").write_text("# no\nA=1\nB = 'two'\n")
    assert load_config(str(tmp_path), {"A": "9"}) == {"A": "9", "B": "two"}


@pytest.mark.skipif("NOTES_ROOT" not in os.environ, reason="NOTES_ROOT names no collection of 702 notes")
def test_counts_of_a_whole_collection(spark):
    whole = pipelines.build_index(spark, os.environ["NOTES_ROOT"])
    assert (whole.files.count(), whole.nodes.count(), whole.names.count()) == (702, 700, 701)
    links = whole.edges.agg(F.count("*").alias("n"), F.count_if("resolved").alias("there"), F.count_if(F.col("resolved") & (F.col("src") == F.col("dst"))).alias("loops")).first()
    assert tuple(links) == (3267, 1755, 5) and graph.backlinks(whole.edges).count() == 402
    assert [r["degree"] for r in graph.top_degree(whole.nodes, whole.edges, 3).collect()] == [329, 83, 75]
    assert [pipelines.search_entities(whole, q).count() for q in ("lithium", "gold", "ministry of mines")] == [18, 63, 54]
    got = stats.vault_stats(whole.nodes, whole.edges).first()
    assert (got["commodities_tracked"], got["countries_covered"], got["sectors_mapped"]) == (14, 2, 21)
    assert {r["folder_type"]: r["count"] for r in whole.nodes.groupBy("folder_type").count().collect()} == {"unknown": 589, "business": 111}
