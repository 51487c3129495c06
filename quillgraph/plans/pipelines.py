"""Questions, articles and opportunities end to end, and the entity look-ups.

Every stage up to a prompt is a DataFrame; what is collected is a page of results (at most the caps of
operators.score), which is what a prompt can hold.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import budget
from ..functions import text as t
from ..operators import context, graph, parse, score, stats
from ..operators.trigrams import TrigramIndex
from ..sources import notes as n
from ..sources import scratch, sinks
from . import packing
from .provider import Provider, rule_based


@dataclass
class Index:
    """Nodes with their links, and edges; cached, as every stage reads them."""

    nodes: DataFrame
    edges: DataFrame
    names: DataFrame
    files: DataFrame


def build_index(spark: SparkSession, root: str, profile: str = "query") -> Index:
    files = n.read_notes(spark, root, recursive=True)
    base = parse.nodes(files, profile).cache()
    names = graph.resolver(base, with_aliases=profile != "news")
    edges = graph.resolve(graph.raw_links(base), names).cache()
    return Index(graph.indexed(base, edges).cache(), edges, names, files)


def _now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat()


def _fit(system: str, user: str, marker: str = budget.TRUNCATED) -> str:
    tokens = lambda s: int(len(s) / budget.CHARS_PER_TOKEN) + 1 if s else 0
    return user[:max(0, budget.characters() - len(system))] + marker if tokens(system + user) > budget.AVAILABLE else user


def _object(text: str) -> dict:
    """Leniently: as it stands, then its outermost object, else {}."""
    body = re.sub(r"\s*```$", "", re.sub(r"^```(?:json)?\s*", "", text.strip(), flags=re.I)) if text.strip().startswith("```") else text.strip()
    for candidate in (body, *re.findall(r"\{.*\}", body, re.S)[:1]):
        try:
            found = json.loads(candidate)
            return found if isinstance(found, dict) else {}
        except ValueError:
            continue
    return {}


# --- questions

def extract_intent(question: str, provider: Provider = rule_based) -> score.Intent:
    """The provider's intent; OVERVIEW where its answer is no JSON object."""
    try:
        d = json.loads(provider("intent\nReturn the question's intent as one JSON object.", question))
        texts = lambda k: [str(x) for x in d.get(k) or []]
        return score.Intent(
            d.get("intent_type") or "OVERVIEW", texts("target_entities"), texts("target_entity_types"), [x.lower() for x in texts("target_countries")],
            [x.lower() for x in texts("target_sectors")], {k: str(v) for k, v in (d.get("target_attributes") or {}).items() if v}, d.get("relationship_type"), d.get("output_format") or "summary")
    except (ValueError, AttributeError):
        return score.Intent()


def rank(candidates: DataFrame, question: str, provider: Provider = rule_based, limit: int | None = score.RANKED) -> list[dict]:
    """Candidates in the provider's order, unknown ids left out; the best by score where its answer is no JSON object."""
    page = candidates.withColumn("_block", context.candidate_block()).orderBy(F.desc("score"), "uid").collect()
    rows = {r["uid"]: r.asDict() for r in page}
    if not rows:
        return []
    system = "ranking\nRank the notes by how well they answer the question; return ranked_nodes as JSON."
    user = f"## Question\n{question}\n\n## Notes ({len(rows)})\n" + "\n\n".join(r["_block"] for r in rows.values())
    try:
        ranked = json.loads(provider(system, _fit(system, user)))["ranked_nodes"]
        picked = [rows[x["node_id"]] for x in ranked if x.get("node_id") in rows]
    except (ValueError, KeyError, TypeError, AttributeError):
        return list(rows.values())[:score.RANKED]
    return picked if limit is None else picked[:limit]


SECTIONS = ("structured_intelligence", "findings", "opportunities", "risks", "key_entities")


def grounded(answer: str, sources: list[dict]) -> dict:
    """A synthesis with its citations checked against the source nodes; see operators.validate for the same on columns."""
    data, known = _object(answer), {s["uid"] for s in sources}
    out = {k: data[k] if isinstance(data.get(k), list) else [] for k in SECTIONS}
    out["structured_intelligence"] = [r if r.get("source_node") in known else r | {"source_node": "citation_missing"} for r in out["structured_intelligence"] if isinstance(r, dict)]
    for k in ("findings", "opportunities", "risks"):
        items = [i if isinstance(i, dict) else {"text": str(i), "source_nodes": []} for i in out[k]]
        out[k] = [i if known.intersection(i.get("source_nodes") or []) else i | {"source_nodes": ["citation_needed"]} for i in items]
    return {"executive_summary": data.get("executive_summary", "No summary generated."), **out, "source_nodes": [{"id": s["uid"], "type": s["entity_type"]} for s in sources]}


def empty_answer(question: str, intent: score.Intent) -> dict:
    sought = ", ".join(intent.entity_types) or "any entity type", ", ".join(intent.entities) or "no specific entities"
    return {
        "executive_summary": f"No notes matched {question!r} (sought {sought[0]}; {sought[1]}).", "structured_intelligence": [], "findings": [{"text": "No matching entities found.", "source_nodes": []}],
        "opportunities": [], "risks": [{"text": "Incomplete data coverage.", "source_nodes": []}], "key_entities": [], "source_nodes": []}


def run_query(spark: SparkSession, index: Index, question: str | None, provider: Provider = rule_based, output: str | None = None) -> dict:
    """The dashboard of a question; without one, of the best-connected notes."""
    total = index.nodes.count()
    if not question:
        top = index.nodes.withColumn("_d", F.size("outbound_links") + F.col("backlink_count")).orderBy(F.desc("_d"), "uid").limit(score.FULL_SCAN)
        rows = [r.asDict() for r in top.withColumn("_line", context.scan_line()).collect()]
        system = "synthesis\nSummarise the notes as a dashboard in JSON; cite a source node for every claim."
        user = f"## Notes ({len(rows)} of {total})\n" + "\n".join(r["_line"] for r in rows)
        dashboard = grounded(provider(system, _fit(system, user)), rows) | {"scan_mode": "full_vault_capped"}
        ranked, intent, found = rows, score.Intent(), len(rows)
    else:
        intent = extract_intent(question, provider)
        candidates = score.pre_filter(index.nodes, intent).cache()
        found = candidates.count()
        ranked = rank(candidates, question, provider)
        if ranked:
            order = {r["uid"]: i for i, r in enumerate(ranked)}
            blocks = candidates.filter(F.col("uid").isin(*order)).select("uid", context.source_block().alias("b")).collect()
            system = "synthesis\nAnswer from these notes alone, as a dashboard in JSON; cite a source node for every claim."
            user = f"## Question\n{question}\n\n## Notes ({len(ranked)})\n" + "\n\n".join(r["b"] for r in sorted(blocks, key=lambda r: order[r["uid"]]))
            dashboard = grounded(provider(system, _fit(system, user)), ranked)
        else:
            dashboard = empty_answer(question, intent)
        candidates.unpersist()
    uids = [r["uid"] for r in ranked]
    subset = spark.createDataFrame([(u, i) for i, u in enumerate(uids)], "uid string, pos int")
    picked = index.nodes.join(F.broadcast(subset), "uid")
    drawing = {
        "viewBox": "0 0 700 280", "height": 280, "nodes": [r.asDict() for r in graph.graph_nodes(picked, F.col("pos")).orderBy("y", "x").collect()],
        "edges": [{"from": r["src"], "to": r["dst"], **graph.EDGE_STYLE} for r in graph.induced(index.edges, subset).orderBy("src", "pos").collect()]}
    numbers = stats.vault_stats(index.nodes, index.edges, subset).first().asDict()
    numbers["entity_type_breakdown"] = {r["entity_type"]: r["n"] for r in stats.type_breakdown(picked).collect()}
    key = spark.range(1).select(t.cache_key(F.lit(question or ""))).first()[0]
    dashboard = {"query_id": key, "user_question": question, "intent": asdict(intent), "filter_stats": {"vault_total": total, "candidates_after_broad_filter": found, "ranked_by_llm": len(ranked)},
                 "stats": numbers, "entity_graph": drawing, **dashboard, "pipeline_metadata": {"processed_at": _now(), "vault_files_scanned": total}}
    if output:
        dashboard["files_written"] = list(sinks.save_query(spark, output, dashboard, drawing))
    return dashboard


class Cache:
    """Answers by question and state of the notes: an added, changed, renamed, replaced or deleted note makes them stale."""

    def __init__(self) -> None:
        self.held: dict[tuple, dict] = {}

    def run(self, spark: SparkSession, index: Index, question: str | None, **more) -> dict:
        key = (question or "", *stats.multiset_fingerprint(index.files, "rel_path", "mtime", "size_bytes").first())
        if key not in self.held:
            self.held[key] = run_query(spark, index, question, **more)
        return self.held[key]


# --- articles

def crawl_bundle(index: Index, uid: str, room: int | None = None) -> str:
    """A node's text, those of its outbound nodes in order, and a line on each backlink by name.

    What is fetched is bounded by ``room`` characters (a prompt's budget): outbound texts as long as they begin within
    it, and as many backlinks as lines of seven characters fit; a prompt cuts the rest off anyway.
    """
    room = budget.characters() if room is None else room
    core = index.nodes.filter(F.col("uid") == uid).select("raw").first()
    if core is None:
        return ""
    near = graph.related(index.edges, uid)
    before = F.sum(F.length("raw")).over(Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))  # one note's own links
    texts = near.filter("relation_type = 'outbound'").join(index.nodes.select("uid", "raw"), "uid").select("uid", "pos", "raw", F.coalesce(before, F.lit(0)).alias("_before"))
    out = [f"--- CORE NODE: {uid} ---\n{core['raw']}"]
    out += [f"\n--- OUTBOUND LINKED CONTEXT: {r['uid']} ---\n{r['raw']}" for r in texts.filter(F.col("_before") <= room).orderBy("pos").collect()]
    names = index.edges.filter((F.col("dst") == uid) & F.col("resolved")).select(F.col("src").alias("uid")).distinct().orderBy("uid").limit(room // 7 + 1)
    back = names.join(index.nodes.select("uid", parse.header_line(F.col("raw")).alias("h")), "uid").orderBy("uid").collect()
    if back:
        out += ["\n--- INBOUND BACKLINKS ---"] + [f"- [[{r['uid']}]]" + (f" [{r['h']}]" if r["h"] else "") for r in back]
    return "\n".join(out)


def registry(index: Index, handled: DataFrame) -> DataFrame:
    """uid and line of all nodes whose names are not handled yet (canonical)."""
    rest = index.nodes.withColumn("canonical", t.canonical(F.col("uid"))).join(handled.select("canonical"), "canonical", "left_anti")
    return rest.select("uid", parse.registry_line(F.col("uid"), F.col("raw")).alias("line"))


def run_news(spark: SparkSession, index: Index, article: str, provider: Provider = rule_based, output: str | None = None, shadow_table: str | None = None) -> dict:
    """Entities of an article, their notes or placeholders, an analysis and the opportunity dashboard."""
    system = "entities\nReturn the article's entities (name, class) and core_event as JSON."
    found = _object(provider(system, _fit(system, article)))
    rows = [(str(e.get("name") or ""), str(e.get("class") or ""), i) for i, e in enumerate(found.get("entities") or []) if isinstance(e, dict)]
    entities = spark.createDataFrame(rows, "name string, class string, pos int")
    met = graph.reconcile(entities, index.names).cache()
    shadows = graph.shadow_nodes(met)
    known = [r["uid"] for r in met.filter("uid is not null").select("uid").distinct().orderBy("uid").collect()]
    made = shadows.collect()
    parts = [f"=== MATCHED EXISTING NODE: {u} ===\n{crawl_bundle(index, u)}" for u in known] + [f"=== PROVISIONED SHADOW NODE: {r['name']} ===\n{r['raw']}" for r in made]
    room = budget.characters()
    lines = registry(index, met).orderBy("uid").limit(room // 8).collect()  # a line has eight characters at least
    parts.append("=== OTHER NODES ===\n" + ("\n".join(r["line"] for r in lines) or "No additional background nodes detected."))
    if shadow_table and made:
        sinks.append_shadow_nodes(shadows, shadow_table)
    system = "constraints\nFind what binds the article's event in the graph."
    cut = spark.createDataFrame([(article, "\n\n".join(parts), system)], "a string, g string, s string").select(budget.truncate_two(F.col("a"), F.col("g"), F.col("s")).alias("x")).select("x.*").first()
    analysis = provider(system, f"{cut['article']}\n\n{cut['graph']}")
    system = "dashboard\nReturn the opportunities as dashboard JSON."
    dashboard = _object(provider(system, _fit(system, f"{found.get('core_event', '')}\n\n{analysis}", budget.ANALYSIS_TRUNCATED)))
    dashboard["pipeline_metadata"] = {"processed_at": _now(), "extracted_entities_count": len(rows), "core_event": found.get("core_event")}
    if output:
        dashboard["files_written"] = [sinks.save_dashboard(spark, output, dashboard)]
    met.unpersist()
    return dashboard


# --- opportunities

def _tagged(text: str, name: str, default: str) -> str:
    m = re.search(f"<{name}>(.*?)</{name}>", text, re.S)
    return m[1].strip() if m else default


def map_chunks(rows: DataFrame, provider: Provider) -> DataFrame:
    """Columns chunk, summary and traces (JSON text): the provider's answer on each chunk of blocks, in parallel."""
    system = "map\nSummarise the notes for the opportunity in <chunk_summary>, and give <lineage_traces> as a JSON list."

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [provider(system, _fit(system, b, budget.CHUNK_TRUNCATED)) for b in pdf["blocks"]]
            yield pd.DataFrame({"chunk": pdf["chunk"], "summary": [_tagged(g, "chunk_summary", g) for g in got], "traces": [_tagged(g, "lineage_traces", "[]") for g in got]})

    blocks = rows.groupBy("chunk").agg(context.joined(F.col("ord"), context.chunk_block(), "\n").alias("blocks"))
    return blocks.mapInPandas(run, "chunk long, summary string, traces string")


def lineage(mapped: DataFrame) -> DataFrame:
    """chunk, pos and trace (a JSON object) of all traces of mapped chunks; what is no list of objects is left out."""
    each = mapped.select("chunk", F.posexplode(F.from_json("traces", "array<string>")).alias("pos", "trace"))
    return each.filter(F.startswith(F.ltrim("trace"), F.lit("{")))


def run_execute(spark: SparkSession, index: Index, dashboard: str, opportunity_id: str, provider: Provider = rule_based, output: str | None = None,
                listed: int = 10_000) -> dict:
    """The roadmap of one opportunity of a dashboard (JSON text): anchors, one-hop crawl, map over chunks, reduce.

    Summaries are reduced in tasks, level by level; of the lineage traces the first ``listed`` are shown, lineage() has all.
    """
    chosen = n.select_opportunity(n.opportunities(spark.createDataFrame([(dashboard,)], "value string")), opportunity_id)
    terms = score.seed_terms(chosen).first()["terms"]
    wanted = spark.createDataFrame([(x,) for x in terms], "p string").select(F.explode(t.tokens(F.col("p"))).alias("w")).distinct().orderBy("w").collect()
    anchors = score.anchors(index.nodes, [r["w"] for r in wanted])
    numbered = context.chunks(graph.crawl(index.edges, anchors), [F.col("ord")])  # names alone, without their texts
    mapped = scratch.written(map_chunks(numbered.join(index.nodes, "uid"), provider), "mapped")
    told = lineage(mapped)
    traces = [json.loads(r["trace"]) for r in told.orderBy("chunk", "pos").limit(listed).collect()]
    system = "reduce\nWrite the roadmap in <final_roadmap> and the graph in <ui_thinking_graph> as JSON."
    shorten = "map\nSummarise these summaries in <chunk_summary>."
    user, _ = packing.reduced(mapped.select(F.col("chunk").alias("pos"), F.col("summary").alias("text")), shorten, lambda s, u: _tagged(provider(s, u), "chunk_summary", u), budget.characters() - len(system))
    answer = provider(system, _fit(system, user or "NO VAULT NODES DISCOVERED.", budget.FINAL_TRUNCATED))
    roadmap, drawing = _tagged(answer, "final_roadmap", answer), _tagged(answer, "ui_thinking_graph", "{}")
    result = {"final_roadmap": roadmap, "ui_thinking_graph": drawing, "compiled_lineage_traces": traces}
    if output:
        result["files_written"] = sinks.save_roadmap(spark, output, opportunity_id, roadmap, drawing, traces)
    return result


# --- entities

def list_entities(index: Index) -> DataFrame:
    return index.nodes.select(F.col("uid").alias("id"), "slug", F.translate("uid", "_-", "  ").alias("name"), "folder_type", "rel_path", "size_bytes")


def get_entity(index: Index, raw_id: str, page: int = 0, size: int = 100) -> dict | None:
    """The node of this slug or name (URL-decoded as often as needed) with one page of its neighbours and their number, or
    None.  entity_related() has all neighbours, as a DataFrame."""
    wanted = index.nodes.sparkSession.range(1).select(t.decode_fully(F.lit(raw_id)).alias("id"), t.slug(t.decode_fully(F.lit(raw_id))).alias("slug")).first()
    hit = index.nodes.filter((F.col("uid") == wanted["id"]) | (F.col("slug") == wanted["slug"])).orderBy(F.col("uid") != wanted["id"], "uid").limit(1).collect()
    if not hit:
        return None
    uid = hit[0]["uid"]
    shown = [r.asDict() for r in entity_related(index, uid).offset(page * size).limit(size).collect()]
    return hit[0].asDict(recursive=True) | {"related": shown, "related_total": graph.related(index.edges, uid).count(), "page": page}


def entity_related(index: Index, uid: str) -> DataFrame:
    """A node's neighbours with what is shown of them: outbound ones in link order, then backlinks by name."""
    shown = index.nodes.select("uid", "slug", t.first_filled(F.get_json_object("fm_json", "$.title"), F.col("uid")).alias("name"), F.col("folder_type").alias("entity_type"), F.substring("summary", 1, 150).alias("summary"))
    return graph.related(index.edges, uid).join(shown, "uid").orderBy(F.col("relation_type") != "outbound", "pos", "uid")


def search_index(index: Index, folder: str) -> TrigramIndex:
    """A trigram index of all nodes, which search_entities() can look through."""
    shown = index.nodes.select("uid", "slug", "fm_json", "folder_type", "summary", score.search_text().alias("text"))
    return score.searched(shown, folder)


def search_entities(index: Index, q: str, trigrams: TrigramIndex | None = None) -> DataFrame:
    """Nodes that hold q, from a trigram index where one is given, else by a scan."""
    hits = score.indexed_search(trigrams, q) if trigrams else score.search(index.nodes, q)
    return hits.select(
        F.col("uid").alias("id"), "slug", t.first_filled(F.get_json_object("fm_json", "$.title"), F.col("uid")).alias("name"), F.col("folder_type").alias("entity_type"), F.substring("summary", 1, 200).alias("summary"))


def with_timeout(spark: SparkSession, call, seconds: float = 60.0, tag: str = "quillgraph-request"):
    """call() with its Spark jobs tagged; the jobs are cancelled when the time is over, and TimeoutError is raised.

    Each call has a tag of its own, so it cancels no other's jobs.  Jobs that call() starts later are cancelled too;
    Python code between them is not stopped.
    """
    import threading
    import uuid

    over, done, tag, sc = threading.Event(), threading.Event(), f"{tag}-{uuid.uuid4().hex}", spark.sparkContext

    def stop() -> None:
        over.set()
        while not done.is_set():
            sc.cancelJobsWithTag(tag)
            done.wait(0.5)

    timer = threading.Timer(seconds, stop)
    sc.addJobTag(tag)
    timer.start()
    try:
        return call()
    except Exception as error:
        if over.is_set():
            raise TimeoutError(f"no result within {seconds} s") from error
        raise
    finally:
        done.set()
        timer.cancel()
        sc.removeJobTag(tag)
