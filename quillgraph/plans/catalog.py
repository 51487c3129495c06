"""Queries over the driver's tables, one for each operator, and the SQL that answers the same."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import budget, jsons
from ..functions import text as t
from ..operators import adjacency, context, graph, order, parse, score, stats, validate
from ..sources import news, scratch
from ..sources import notes as n
from ..streaming.live import LiveGraph
from . import pipelines
from .table_notes import RELATIONS, table_notes

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.nodes(table_notes(spark, sf_dir))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes without their texts, written once, and edges: names, links and what else is asked read one table."""
    nodes = scratch.written(_nodes(spark, sf_dir).drop("raw", "body", "body_preview", "sections"), "nodes")
    return nodes, graph.resolve(graph.raw_links(nodes), graph.resolver(nodes))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[1]


def _index(spark: SparkSession, sf_dir: str) -> pipelines.Index:
    """Notes and edges without the lists of neighbours."""
    files = table_notes(spark, sf_dir)
    nodes = scratch.written(parse.nodes(files), "nodes")
    names = graph.resolver(nodes)
    return pipelines.Index(nodes, graph.resolve(graph.raw_links(nodes), names), names, files)


# --- parsing

@_query(f"WITH {RELATIONS} SELECT uid, summary, CASE WHEN uid LIKE 'Supplier%' THEN CASE WHEN CAST(substring(uid, 10) AS INTEGER) % 5 = 0 THEN 'private_conglomerate' ELSE '' END ELSE entity_type END AS entity_type, country, sector, folder_type FROM note")
def note_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir).select("uid", "summary", "entity_type", "country", "sector", "folder_type")


@_query(f"WITH {RELATIONS} SELECT src, pos, raw FROM written")
def wikilink_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.raw_links(_nodes(spark, sf_dir))


@_query(f"""WITH {RELATIONS}, spelt AS (SELECT src, CASE WHEN raw IN (SELECT r_name FROM region) AND src LIKE 'Customer%' THEN 'x/y/' || raw ELSE raw END AS raw FROM written)
    SELECT lower(regexp_replace(raw, '[^a-zA-Z0-9]', '', 'g')) AS canonical, count(DISTINCT src) AS n_sources, min(src) AS first_source FROM spelt GROUP BY 1""")
def news_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse.nodes(table_notes(spark, sf_dir), "news")
    found = adjacency.canonical_pages(graph.raw_links(nodes)).filter("page = 0")
    return found.select("canonical", F.col("total").alias("n_sources"), F.col("sources")[0].alias("first_source"))


_LINES = f"""WITH {RELATIONS} SELECT uid, '- **' || uid || '**' || CASE
    WHEN uid LIKE 'Customer%' THEN ' [name: ' || uid || ' | sector: ' || sector || ' | entity_type: company] -> Context: name: ' || uid
    WHEN uid LIKE 'Supplier%' THEN ' [description: ' || summary || ' | location: ' || country || '] -> Context: description: ' || summary
    WHEN uid LIKE 'NATION%' THEN ' [node_type: nation | country: ' || uid || '] -> Context: node_type: nation' ELSE ' -> Context: ' || summary END AS line FROM note"""


@_query(_LINES)
def registry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table_notes(spark, sf_dir).withColumn("uid", t.stem(F.col("file_name")))
    return rows.select("uid", parse.registry_line(F.col("uid"), F.col("raw")).alias("line"))


@_query(f"{_LINES} WHERE uid NOT LIKE 'NATION%'")
def registry_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on the notes that were not handled; the handled ones are known by name in another spelling."""
    handled = _table(spark, sf_dir, "nation").select(t.canonical(F.replace(F.lower("n_name"), F.lit("_"), F.lit(" - "))).alias("canonical"))
    return pipelines.registry(_index(spark, sf_dir), handled)


@_query("SELECT page_id, u.pos - 1 AS pos, hrefs[u.pos] AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS hrefs FROM pages), LATERAL (SELECT unnest(range(1, len(hrefs) + 1)) AS pos) u")
def href_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return _table(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("pos", "href")).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


_GROUPS = " ".join("WHEN " + " OR ".join(f"contains(b, '{w}')" for w in words) + f" THEN '{name}'" for name, words in parse.TYPE_WORDS)


@_query(f"""WITH d AS (SELECT 'document' AS kind, doc_id AS id, 0 AS turn, lower(coalesce(text, '')) AS b FROM documents
    UNION ALL SELECT 'turn', conv_id, turn, lower(coalesce(text, '')) FROM conversations) SELECT kind, id, turn, CASE {_GROUPS} ELSE '' END AS entity_type FROM d""")
def entity_type_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text")
    turns = _table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("long").alias("turn"), "text")
    return docs.unionByName(turns).select("kind", "id", F.col("turn").cast("int").alias("turn"), parse.inferred_type(t.or_empty(F.col("text"))).alias("entity_type"))


@_query("""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'infrastructure' WHEN 'MACHINERY' THEN 'commodity' WHEN 'HOUSEHOLD' THEN 'person' ELSE 'unknown' END AS folder_type FROM customer""")
def folder_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    folder = F.when(segment == "BUILDING", "Infrastructure/people").when(segment == "MACHINERY", "Minerals").when(segment == "HOUSEHOLD", "Contacts").otherwise("My Businesses")
    return _table(spark, sf_dir, "customer").select("c_custkey", n.folder_type(F.concat(F.lit("Root/"), folder, F.lit("/"), F.col("c_name"), F.lit(".md"))).alias("folder_type"))


@_query("SELECT 'Companies' AS dir, count(*) AS n_files FROM customer UNION ALL SELECT 'Agencies', count(*) FROM supplier UNION ALL SELECT 'Places/Nations', count(*) FROM nation UNION ALL SELECT 'Region', count(*) FROM region")
def directories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return n.directories(table_notes(spark, sf_dir))


# --- text functions

@_query("SELECT doc_id, length(c) AS n, md5(c) AS digest FROM (SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9]', '', 'g')) AS c FROM documents)")
def canonical_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = t.canonical(t.or_empty(F.col("text")))
    return _table(spark, sf_dir, "documents").select("doc_id", F.length(c).cast("long").alias("n"), F.md5(c.cast("binary")).alias("digest"))


@_query("SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def slug_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", t.slug(F.col("url")).alias("slug"))


@_query("SELECT page_id, url || '+%zz' AS malformed, url || '+é' AS decoded FROM pages")
def url_unquote(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = F.replace(F.replace(F.concat(F.col("url"), F.lit("+é")), F.lit("/"), F.lit("%252F")), F.lit("é"), F.lit("%25C3%25A9"))
    return _table(spark, sf_dir, "pages").select("page_id", t.url_unquote(F.concat("url", F.lit("+%zz"))).alias("malformed"), t.decode_fully(encoded).alias("decoded"))


_STOP = ", ".join(f"'{w}'" for w in t.STOP_WORDS)


@_query(f"""SELECT doc_id, len(w) AS n, md5(array_to_string(list_sort(w), ' ')) AS digest FROM (SELECT doc_id, list_distinct(list_filter(
    regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), lambda x: length(x) > 1 AND NOT list_contains([{_STOP}], x))) AS w FROM documents)""")
def token_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents").select("doc_id", t.tokens(F.col("text")).alias("w"))
    return rows.select("doc_id", F.size("w").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("w"), " ").cast("binary")).alias("digest"))


@_query("SELECT item_id, CASE WHEN coalesce(text, '') = '' THEN '00a01a6536012f69' ELSE substring(sha256(text), 1, 16) END AS cache_key FROM benchmark UNION ALL SELECT -1, '00a01a6536012f69'")
def query_cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _table(spark, sf_dir, "benchmark").select("item_id", "text").unionByName(spark.createDataFrame([(-1, "")], "item_id long, text string"))
    return asked.select("item_id", t.cache_key(F.col("text")).alias("cache_key"))


# --- graph

@_query(f"WITH {RELATIONS} SELECT src, pos, raw, dst, resolved FROM edge")
def link_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


@_query(f"WITH {RELATIONS} SELECT dst, count(*) AS n_links FROM edge WHERE NOT resolved GROUP BY dst")
def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.dangling(_edges(spark, sf_dir)).groupBy("dst").agg(F.count("*").alias("n_links"))


@_query(f"""WITH {RELATIONS}, p AS (SELECT DISTINCT dst, src FROM edge WHERE resolved), r AS (SELECT *, (row_number() OVER (PARTITION BY dst ORDER BY src) - 1) // 64 AS page, count(*) OVER (PARTITION BY dst) AS total FROM p)
    SELECT dst AS uid, CAST(page AS INTEGER) AS page, total, string_agg(src, ',' ORDER BY src) AS sources FROM r GROUP BY dst, page, total""")
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adjacency.backlink_pages(_edges(spark, sf_dir), 64)
    return found.select("uid", "page", "total", F.array_join("sources", ",").alias("sources"))


@_query("""WITH p AS (SELECT DISTINCT lang, doc_id FROM documents WHERE lang IS NOT NULL), r AS (SELECT *, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 50 AS page, count(*) OVER (PARTITION BY lang) AS total FROM p)
    SELECT lang, CAST(page AS INTEGER) AS page, total, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM r GROUP BY lang, page, total""")
def adjacency_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a language, a few hubs with nearly all rows, in pages."""
    found = adjacency.pages(_table(spark, sf_dir, "documents"), "lang", "doc_id", 50)
    return found.select("lang", "page", "total", F.size("values").cast("long").alias("n"), F.col("values")[0].alias("first_id"), F.element_at("values", -1).alias("last_id"))


@_query(f"""WITH {RELATIONS}, e AS (SELECT src AS uid, 1 AS o, 0 AS i FROM edge UNION ALL SELECT dst, 0, 1 FROM edge WHERE resolved)
    SELECT uid, coalesce(CAST(sum(o) AS BIGINT), 0) AS out_degree, coalesce(CAST(sum(i) AS BIGINT), 0) AS in_degree, coalesce(CAST(sum(o + i) AS BIGINT), 0) AS degree
    FROM note LEFT JOIN e USING (uid) GROUP BY uid ORDER BY degree DESC, uid LIMIT 100""")
def degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.top_degree(*_graph(spark, sf_dir), score.FULL_SCAN)


@_query(f"WITH {RELATIONS} SELECT src FROM edge WHERE resolved AND src = dst")
def self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir).filter("resolved AND src = dst").select("src")


@_query(f"WITH {RELATIONS}, s AS (SELECT uid FROM note WHERE sector = 'BUILDING' OR entity_type = 'nation') SELECT src, dst FROM edge WHERE src IN (SELECT uid FROM s) AND dst IN (SELECT uid FROM s)")
def subgraph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return graph.induced(edges, nodes.filter("sector = 'BUILDING' OR entity_type = 'nation'")).select("src", "dst")


_ANCHORS = ("NATION_3", "Customer#000000050", "ASIA")


@_query(f"""WITH {RELATIONS}, a AS (SELECT unnest({list(_ANCHORS)}) AS anchor, unnest({list(range(len(_ANCHORS)))}) AS rank), r AS (SELECT * FROM edge WHERE resolved),
    c AS (SELECT anchor AS uid, true AS is_anchor, [rank, 0, 0] AS o FROM a UNION ALL SELECT dst, false, [rank, 1, pos] FROM r JOIN a ON src = anchor UNION ALL SELECT src, false, [rank, 2, 0] FROM r JOIN a ON dst = anchor)
    SELECT uid, bool_or(is_anchor) AS is_anchor, min(o)[1] AS rank, min(o)[2] AS k, min(o)[3] AS pos FROM c GROUP BY uid""")
def one_hop_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchors = spark.createDataFrame([(a, i) for i, a in enumerate(_ANCHORS)], "uid string, rank int")
    return graph.crawl(_edges(spark, sf_dir), anchors).select("uid", "is_anchor", "ord.rank", "ord.k", "ord.pos")


@_query(f"""WITH {RELATIONS}, r AS (SELECT * FROM edge WHERE resolved), b AS (SELECT src, dst AS uid, 0 AS k, pos FROM r UNION ALL SELECT dst, src, 1, 0 FROM r)
    SELECT src, uid, CASE min(k) WHEN 0 THEN 'outbound' ELSE 'backlink' END AS relation_type, coalesce(min(pos) FILTER (WHERE k = 0), 0) AS pos FROM b GROUP BY src, uid""")
def related_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.related(_edges(spark, sf_dir), None)


@_query(f"""WITH {RELATIONS}, a AS (SELECT n_name AS anchor, n_nationkey AS rank FROM nation), r AS (SELECT * FROM edge WHERE resolved),
    c AS (SELECT anchor AS uid, [rank, 0, 0] AS o, '' AS w FROM a UNION ALL SELECT dst, [rank, 1, pos], '' FROM r JOIN a ON src = anchor UNION ALL SELECT src, [rank, 2, 0], src FROM r JOIN a ON dst = anchor),
    f AS (SELECT uid, min({{'o': o, 'w': w}}) AS x FROM c GROUP BY uid) SELECT uid, (row_number() OVER (ORDER BY x) - 1) // 12 AS chunk FROM f""")
def crawl_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl around all nations in chunks of twelve, in the crawl's composite order."""
    anchors = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("uid"), F.col("n_nationkey").cast("int").alias("rank"))
    return context.chunks(graph.crawl(_edges(spark, sf_dir), anchors).select("uid", "ord"), ["ord"]).select("uid", "chunk")


@_query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) - 1 AS place,
    CAST(coalesce(sum(o_custkey) OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM orders""")
def composite_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and running sums of all orders by priority, then falling price, then key."""
    by = ["o_orderpriority", F.desc("o_totalprice"), "o_orderkey"]
    rows = order.numbered(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"), by, "place")
    return order.running(rows, by, "o_custkey", "before").select("o_orderkey", "place", "before")


def _live(spark: SparkSession, sf_dir: str) -> LiveGraph:
    """A live graph that was built from earlier notes and then brought to the notes as they are.

    Before, a ninth of the customers were missing and a fourth had other links, a nation had no note, one note has gone
    since that others link to, and one name was claimed by an alias of a later note.
    """
    now = table_notes(spark, sf_dir).withColumn("_k", F.crc32(F.col("file_name").cast("binary")))
    was = now.filter((F.col("_k") % 9 != 0) & (F.col("file_name") != "NATION_7.md"))
    other = F.when(F.col("_k") % 4 == 1, F.concat("raw", F.lit(" [[NATION_99]] [[Supplier Group]] [[" + "NATION_1]]"))).otherwise(F.col("raw"))
    was = was.withColumn("raw", other).withColumn("size_bytes", F.octet_length("raw").cast("long"))
    gone = spark.createDataFrame([("Old/Supplier Group.md", "Supplier Group.md", "A [[NATION_2]]."), ("Old/NATION_3.md", "NATION_3.md", "Overridden."), ("Z/Claim.md", "Claim.md", "---\nname: NATION_5\n---\nx")],
                                 "rel_path string, file_name string, raw string").withColumns({"size_bytes": F.octet_length("raw").cast("long"), "mtime": F.lit("2023-01-01 00:00:00").cast("timestamp")})
    live = LiveGraph(spark, scratch.path(spark, "live"))
    live.update(was.drop("_k").unionByName(gone))
    live.update(now.drop("_k"))
    return live


@_query(f"WITH {RELATIONS} SELECT src, pos, raw, dst, resolved FROM edge")
def live_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).edges()


@_query(f"""WITH {RELATIONS}, e AS (SELECT src AS uid, 1 AS o, 0 AS i FROM edge UNION ALL SELECT dst, 0, 1 FROM edge WHERE resolved)
    SELECT uid, coalesce(CAST(sum(o) AS BIGINT), 0) AS out_degree, coalesce(CAST(sum(i) AS BIGINT), 0) AS in_degree, coalesce(CAST(sum(o + i) AS BIGINT), 0) AS degree FROM note LEFT JOIN e USING (uid) GROUP BY uid""")
def live_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).degrees()


_SLUG = "regexp_replace(regexp_replace(lower(uid), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@_query(f"""WITH {RELATIONS}, r AS (SELECT * FROM edge WHERE resolved), b AS (SELECT dst AS uid, 0 AS k, pos FROM r WHERE src = 'NATION_3' UNION ALL SELECT src, 1, 0 FROM r WHERE dst = 'NATION_3'),
    f AS (SELECT uid, min(k) AS k, coalesce(min(pos) FILTER (WHERE k = 0), 0) AS pos FROM b GROUP BY uid)
    SELECT uid, 'NATION_3' AS src, CASE k WHEN 0 THEN 'outbound' ELSE 'backlink' END AS relation_type, pos, {_SLUG} AS slug, uid AS name, folder_type AS entity_type, substring(summary, 1, 150) AS summary FROM f JOIN note USING (uid)""")
def entity_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.entity_related(_index(spark, sf_dir), "NATION_3")


@_query(f"""WITH {RELATIONS} SELECT uid AS id, {_SLUG} AS slug, replace(replace(uid, '_', ' '), '-', ' ') AS name, folder_type,
    CASE WHEN uid LIKE 'Customer%' THEN 'Companies/' WHEN uid LIKE 'Supplier%' THEN 'Agencies/' WHEN uid LIKE 'NATION%' THEN 'Places/Nations/' ELSE 'Region/' END || uid || '.md' AS rel_path FROM note""")
def entity_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.list_entities(_index(spark, sf_dir)).drop("size_bytes")


@_query(f"""WITH {RELATIONS} SELECT n.name, n.class, uid FROM (SELECT 'nation ' || n_nationkey AS name, '[POLICY_FRAMEWORK]' AS class FROM nation
    UNION ALL SELECT p_brand, '[MINING_REFINERY]' FROM part UNION ALL SELECT p_name, '[GOVERNMENT_AGENCY]' FROM part UNION ALL SELECT p_type, '[COMMODITY]' FROM part) n LEFT JOIN note ON lower(regexp_replace(uid, '[^a-zA-Z0-9]', '', 'g')) = lower(regexp_replace(n.name, '[^a-zA-Z0-9]', '', 'g'))""")
def entity_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reconcile(_entities(spark, sf_dir), graph.resolver(_nodes(spark, sf_dir))).select("name", "class", "uid")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = _table(spark, sf_dir, "nation").select(F.concat(F.lit(" nation "), F.col("n_nationkey").cast("string")).alias("name"), F.lit("[POLICY_FRAMEWORK]").alias("class"))
    kinds = {"p_brand": "[MINING_REFINERY]", "p_name": "[GOVERNMENT_AGENCY]", "p_type": "[COMMODITY]"}
    each = F.explode(F.array(*[F.struct(F.col(c).alias("name"), F.lit(k).alias("class")) for c, k in kinds.items()])).alias("e")
    return places.unionByName(_table(spark, sf_dir, "part").select(each).select("e.name", "e.class"))


@_query("""SELECT DISTINCT p_brand AS name, '[MINING_REFINERY]' AS class, md5('---\nnode_type: PRIVATE_CONGLOMERATE\nsub_type: MINING_REFINERY\nstatus: shadow\n---\n# ' || p_brand ||
    '\n\n- Requires [[Continuous Baseload Power Grid]]\n- Requires [[Industrial Bulk Water Source]]\n- Regulated by [[Environmental Management Agency]]\n') AS digest FROM part
    UNION SELECT p_name, '[GOVERNMENT_AGENCY]', md5('---\nnode_type: GOVERNMENT_AGENCY\nstatus: shadow\n---\n# ' || p_name ||
    '\n\n- Overseen by [[Overseeing Government Ministry]]\n- Established under [[Act of Parliament]]\n') FROM part
    UNION SELECT p_type, '[COMMODITY]', md5('---\nnode_type: COMMODITY\nstatus: shadow\n---\n# ' || p_type || '\n\n- Shadow node for context matching.\n') FROM part""")
def shadow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = graph.reconcile(_entities(spark, sf_dir), graph.resolver(_nodes(spark, sf_dir)))
    return graph.shadow_nodes(met).select("name", "class", F.md5(F.col("raw").cast("binary")).alias("digest"))


@_query("SELECT n_name AS id, 50 + n_nationkey % 8 * 80 AS x, 40 + n_nationkey // 8 * 60 AS y FROM nation")
def grid_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("uid"), F.lit("nation").alias("entity_type"), F.lit("").alias("summary"), "n_nationkey")
    return graph.graph_nodes(rows, F.col("n_nationkey")).select("id", F.col("x").cast("int").alias("x"), F.col("y").cast("long").alias("y"))


@_query("""WITH s AS (SELECT o_orderpriority AS label, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS i FROM orders GROUP BY 1),
    d AS (SELECT o_orderstatus AS label, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS i FROM orders GROUP BY 1)
    SELECT 'source-' || s.i AS from_id, 'target-' || d.i AS to_id, 'supports' AS label, count(*) AS n FROM orders JOIN s ON s.label = o_orderpriority JOIN d ON d.label = o_orderstatus GROUP BY s.i, d.i
    UNION ALL SELECT 'root', 'source-' || i, '', 1 FROM s""")
def trace_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    traces = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("source_node"), F.col("o_orderstatus").alias("target_concept"), F.lit("supports").alias("relationship_type"))
    return graph.trace_graph(traces)[1].groupBy("from_id", "to_id", "label").agg(F.count("*").alias("n"))


# --- counts

@_query("SELECT CASE WHEN coalesce(lang, '') = '' THEN 'unknown' ELSE lang END AS entity_type, count(*) AS n FROM documents GROUP BY 1")
def type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.type_breakdown(_table(spark, sf_dir, "documents"), "lang")


@_query(f"""WITH {RELATIONS} SELECT (SELECT count(*) FROM note WHERE sector = 'BUILDING') AS total_entities,
    (SELECT count(*) FROM edge JOIN note ON src = uid WHERE sector = 'BUILDING') AS total_relationships,
    count(DISTINCT CASE WHEN entity_type = 'commodity' THEN lower(uid) END) AS commodities_tracked, count(DISTINCT nullif(lower(country), '')) AS countries_covered,
    count(DISTINCT nullif(lower(sector), '')) AS sectors_mapped FROM note""")
def vault_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return stats.vault_stats(nodes, edges, nodes.filter("sector = 'BUILDING'"))


@_query("SELECT max(ts) AS latest, count(*) AS n FROM events")
def recency_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.fingerprint(_table(spark, sf_dir, "events"), "ts")


@_query("""SELECT count(*) AS n, CAST(sum(CAST('0x' || substring(md5('=' || event_id || '|=' || coalesce(event_type, '') || '|=' || user_id), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM events""")
def multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.multiset_fingerprint(_table(spark, sf_dir, "events").withColumn("event_type", t.or_empty(F.col("event_type"))), "event_id", "event_type", "user_id")


# --- scoring

_INTENT = score.Intent("FILTERED_LIST", entities=("the of", "ion"), entity_types=("src_1",), countries=("EN", "fr"), sectors=("7",), attributes={"status": "with"})


@_query("""WITH d AS (SELECT doc_id, coalesce(source, '') AS k, lower(coalesce(lang, '')) AS c, 'doc ' || doc_id AS nm, lower('' || ' ' || substring(coalesce(text, ''), 1, 2000)) AS x FROM documents),
    s AS (SELECT 'Doc-' || doc_id AS uid, CASE WHEN contains(lower(k), 'src1') OR contains('src1', lower(k)) THEN 8.0 ELSE 0 END + CASE WHEN contains(c, 'en') THEN 6.0 ELSE 0 END + CASE WHEN contains(c, 'fr') THEN 6.0 ELSE 0 END
        + CASE WHEN contains(k, '7') THEN 5.0 ELSE 0 END + CASE WHEN contains(nm, 'the of') THEN 10.0 WHEN contains(nm, 'the') OR contains(nm, 'of') THEN 4.0 ELSE 0 END + CASE WHEN contains(x, 'the of') THEN 2.0 ELSE 0 END
        + CASE WHEN contains(nm, 'ion') THEN 10.0 ELSE 0 END + CASE WHEN contains(x, 'ion') THEN 2.0 ELSE 0 END + CASE WHEN contains(x, 'with') THEN 3.0 ELSE 0 END AS score FROM d)
    SELECT uid, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, uid LIMIT 80""")
def broad_prefilter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    rows = _table(spark, sf_dir, "documents").select(
        F.concat(F.lit("Doc-"), F.col("doc_id").cast("string")).alias("uid"), F.lit("").alias("summary"), F.substring(t.or_empty(F.col("text")), 1, parse.PREVIEW).alias("body_preview"),
        t.or_empty(F.col("source")).alias("entity_type"), t.or_empty(F.col("lang")).alias("country"), t.or_empty(F.col("source")).alias("sector"), none.alias("outbound_links"), none.alias("backlink_uids"))
    return score.pre_filter(rows, _INTENT).select("uid", "score")


_WANTED = ("widget", "ring", "small", "econ", "brand", "bolt")
_BONUS = " + ".join(f"CASE WHEN contains(b, '{w}') THEN 3 WHEN contains(x, '{w}') THEN 1 ELSE 0 END" for w in _WANTED)


@_query(f"""WITH p AS (SELECT 'part ' || p_partkey AS uid, lower('part ' || p_partkey || ' part ' || p_partkey || ' ' || p_name) AS b, lower('part ' || p_partkey || ' ' || p_name || ' ' || p_brand || ' ' || p_type) AS x FROM part),
    s AS (SELECT uid, {_BONUS} AS score FROM p) SELECT uid, score, row_number() OVER (ORDER BY score DESC, uid) - 1 AS rank FROM s WHERE score >= 1 ORDER BY score DESC, uid LIMIT 5""")
def anchor_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(
        F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("uid"), F.create_map(F.lit("name"), F.array("p_name")).alias("fm"), F.array("p_name").alias("aliases"), F.concat_ws(" ", "p_brand", "p_type").alias("summary"))
    return score.indexed_anchors(score.anchor_index(rows, scratch.path(spark, "anchors")), _WANTED)[0]


@_query("SELECT 'Doc ' || doc_id AS uid, 'doc-' || doc_id AS slug FROM documents WHERE contains(lower('Doc ' || doc_id || '  ' || coalesce(text, '')), 'with')")
def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    uid = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    rows = _table(spark, sf_dir, "documents").select(uid.alias("uid"), t.slug(uid).alias("slug"), F.concat_ws(" ", uid, F.lit(""), t.or_empty(F.col("text"))).alias("text"))
    return score.indexed_search(score.searched(rows, scratch.path(spark, "search")), "With").select("uid", "slug")


@_query("SELECT lower(regexp_replace(p_name, '[^a-zA-Z0-9]', '', 'g')) AS canonical, 'part ' || max(p_partkey) AS uid FROM part GROUP BY 1 UNION ALL SELECT 'part' || p_partkey, 'part ' || p_partkey FROM part")
def alias_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    return graph.resolver(_table(spark, sf_dir, "part").select(F.concat(F.lit("part "), key).alias("uid"), F.lpad(key, 20, "0").alias("rel_path"), F.array("p_name").alias("aliases")))


@_query("SELECT 'C' || o_custkey AS id, 'c' || o_custkey AS slug, min(o_orderkey) AS first_order FROM orders GROUP BY o_custkey")
def stem_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.lit(".md")).alias("file_name"), F.lpad(F.col("o_orderkey").cast("string"), 20, "0").alias("rel_path"), F.lit("").alias("raw"), F.lit(0).alias("size_bytes"))
    return n.load_entities(rows).select("id", "slug", F.col("rel_path").cast("long").alias("first_order"))


@_query("SELECT l.doc_id, l.doc_id AS pos, l.quality, d.source FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def ranked_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("uid"), F.col("doc_id").alias("pos"), "quality")
    return score.by_rank(_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("uid"), "source"), ranked).select(F.col("uid").alias("doc_id"), "pos", "quality", "source")


@_query("""SELECT p_partkey, p_name || '|' || p_brand || '|' || p_type AS terms FROM part""")
def keyword_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "part").select(
        "p_partkey", F.lit("").alias("title"), F.concat(F.lit(" "), "p_name", F.lit("\n")).alias("name"), F.array("p_brand", F.upper("p_name"), F.lit(" ")).alias("required_missing_nodes"),
        F.struct(F.col("p_type").alias("beneficiary"), F.lower("p_brand").alias("likely_funder")).alias("capital_flow"))
    return score.seed_terms(rows, ["p_partkey"]).select("p_partkey", F.array_join("terms", "|").alias("terms"))


# --- context and budgets

@_query("SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 12 AS chunk, doc_id FROM documents")
def chunk_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.numbered_chunks(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("chunk", "doc_id")


@_query("""WITH d AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 12 AS chunk, doc_id, coalesce(text, '') AS x FROM documents)
    SELECT chunk, md5(string_agg('--- NODE: ' || doc_id || ' ---' || chr(10) || x, chr(10) ORDER BY doc_id)) AS digest FROM d GROUP BY chunk""")
def chunk_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.numbered_chunks(_table(spark, sf_dir, "documents").select("doc_id", t.or_empty(F.col("text")).alias("x")), "doc_id")
    block = F.concat(F.lit("--- NODE: "), F.col("doc_id").cast("string"), F.lit(" ---\n"), F.col("x"))
    return rows.groupBy("chunk").agg(F.md5(context.joined(F.col("doc_id"), block, "\n").cast("binary")).alias("digest"))


@_query("""SELECT 'document' AS kind, doc_id AS id, 0 AS turn, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE CAST(trunc(length(text) / 3.2) AS BIGINT) + 1 END AS tokens FROM documents
    UNION ALL SELECT 'turn', conv_id, turn, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE CAST(trunc(length(text) / 3.2) AS BIGINT) + 1 END FROM conversations""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).alias("turn"), budget.estimate(F.col("text")).alias("tokens"))
    return docs.unionByName(_table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.col("turn").cast("int").alias("turn"), budget.estimate(F.col("text")).alias("tokens")))


@_query("""WITH p AS (SELECT d.doc_id, coalesce(d.text, '') AS a, coalesce(b.text, '') AS g FROM documents d LEFT JOIN benchmark b ON d.doc_id % 200 = b.item_id),
    q AS (SELECT *, length(a) + length(g) + 10 AS n, 640 - 10 AS room FROM p), r AS (SELECT *, trunc(n / 3.2) + 1 > 200 AS over_, least(length(a), CAST(trunc(room * 0.25) AS BIGINT)) AS ka FROM q)
    SELECT doc_id, md5(CASE WHEN over_ AND length(a) > ka THEN substring(a, 1, ka) || chr(10) || chr(10) || '[ARTICLE TRUNCATED TO RESPECT TOKEN BUDGET]' ELSE a END) AS article,
    md5(CASE WHEN over_ AND length(g) > room - ka THEN substring(g, 1, room - ka) || chr(10) || chr(10) || '[GRAPH CONTEXT TRUNCATED TO RESPECT TOKEN BUDGET]' ELSE g END) AS graph FROM r""")
def truncate_two_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("g"))
    rows = docs.join(items, docs["doc_id"] % 200 == items["item_id"], "left").select("doc_id", budget.truncate_two(t.or_empty(F.col("text")), t.or_empty(F.col("g")), F.lit("0123456789"), available=200).alias("x"))
    return rows.select("doc_id", F.md5(F.col("x.article").cast("binary")).alias("article"), F.md5(F.col("x.graph").cast("binary")).alias("graph"))


@_query("""SELECT doc_id, CASE WHEN length(t) > 0 AND trunc((length(t) + 10) / 3.2) + 1 > 100 THEN md5(substring(t, 1, 310) || chr(10) || '[TRUNCATED]') ELSE md5(t) END AS digest
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def truncate_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = budget.truncate(t.or_empty(F.col("text")), F.lit("0123456789"), available=100)
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(cut.cast("binary")).alias("digest"))


# --- JSON and citations

def _dressed() -> Column:
    """props as language models may return it: fenced, in prose, with a trailing comma, not at all, and as it is."""
    return F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(
    F.col("event_id") % 5 == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" done"))).when(F.col("event_id") % 5 == 2, F.replace("props", F.lit("}"), F.lit(", }"))).when(
    F.col("event_id") % 5 == 3, F.lit("no json")).otherwise(F.col("props"))


@_query("SELECT event_id, CASE WHEN event_id % 5 = 3 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def json_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.try_variant_get(jsons.lenient_json(_dressed()), "$.k", "bigint").alias("k"))


@_query("SELECT event_id, event_id % 5 IN (2, 3) AS is_empty, CASE WHEN event_id % 5 IN (2, 3) THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def json_two_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = jsons.json_or_empty(_dressed())
    return _table(spark, sf_dir, "events").select("event_id", (F.to_json(v) == "{}").alias("is_empty"), F.try_variant_get(v, "$.k", "bigint").alias("k"))


@_query("SELECT event_id, event_id % 5 = 4 AS is_object FROM events")
def json_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", jsons.strict_object(_dressed()).isNotNull().alias("is_object"))


@_query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE '{}' END AS roadmap, CASE WHEN event_id % 3 = 0 THEN props ELSE event_type END AS traces FROM events")
def tag_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x<r>\n "), "event_type", F.lit(" \n</r><t>"), "props", F.lit("</t><t>2</t>"))).otherwise(F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", jsons.tag(whole, "r", F.lit("{}")).alias("roadmap"), jsons.tag(whole, "t").alias("traces"))


@_query("SELECT event_id, props AS body FROM events")
def fence_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    dressed = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" ```JSON\n"), "props", F.lit("\n```\n"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```"), "props", F.lit("```"))).otherwise(F.concat(F.lit("\t"), "props"))
    return _table(spark, sf_dir, "events").select("event_id", jsons.strip_fence(dressed).alias("body"))


@_query("""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'U' || user_id ELSE 'citation_missing' END AS source_node,
    CASE WHEN user_id % 2 = 0 OR user_id % 3 = 0 THEN 'U' || user_id || ',T' || user_id ELSE 'citation_needed' END AS source_nodes FROM events""")
def citation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id").cast("string")
    cited = F.concat(F.lit("U"), user)
    known = F.array_compact(F.array(F.when(F.col("user_id") % 2 == 0, cited), F.when(F.col("user_id") % 3 == 0, F.concat(F.lit("T"), user))))
    many = F.array(cited, F.concat(F.lit("T"), user))
    return _table(spark, sf_dir, "events").select("event_id", validate.checked_source(cited, F.array_contains(known, cited)).alias("source_node"), F.array_join(validate.checked_sources(many, known), ",").alias("source_nodes"))


@_query("SELECT d.doc_id AS cited, CASE WHEN l.doc_id IS NULL THEN 'citation_missing' ELSE CAST(d.doc_id AS VARCHAR) END AS source_node FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id")
def citation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("known")).distinct()
    rows = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cited")).join(known, F.col("cited") == F.col("known"), "left")
    return rows.select("cited", validate.checked_source(F.col("cited").cast("string"), F.col("known").isNotNull()).alias("source_node"))


@_query("SELECT event_id, 0 AS pos, 'E' || event_id AS id, event_type AS title, value AS urgency_score FROM events UNION ALL SELECT event_id, 1, NULL, 'second', NULL FROM events WHERE event_id % 4 <> 3")
def opportunity_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.to_json(F.struct(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("title"), F.col("value").alias("urgency_score")))
    two = F.concat(F.lit("["), one, F.lit(',{"opportunity_id":"x","title":"second"}]'))
    kind = F.col("event_id") % 4
    value = F.when(kind == 0, two).when(kind == 1, F.concat(F.lit('{"opportunities":'), two, F.lit("}"))).when(kind == 2, F.concat(F.lit('{"data":3,"items":'), two, F.lit("}"))).otherwise(one)
    rows = _table(spark, sf_dir, "events").select("event_id", value.alias("value"))
    return n.opportunities(rows, keep=["event_id"]).select("event_id", "pos", "id", "title", "urgency_score")


@_query("SELECT event_id, 0 AS pos, 'E' || event_id AS id, event_type AS title FROM events WHERE event_id = 40")
def opportunity_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dashboards that list it are found by its text, and of their opportunities the one of this id is taken."""
    one = F.to_json(F.struct(F.concat(F.lit("E"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("title")))
    listed = F.concat(F.lit('{"results":['), one, F.lit(',{"opportunity_id":"x","title":"second"}]}'))
    rows = _table(spark, sf_dir, "events").select("event_id", listed.alias("value"))
    return n.select_opportunity(n.opportunities(rows, keep=["event_id"]), "E40").select("event_id", "pos", "id", "title")


# --- tables

@_query("""SELECT coalesce(lang, '') AS country_tag, count(*) AS n, count(DISTINCT doc_id) AS n_ids, CAST(0 AS BIGINT) AS n_without_time FROM documents WHERE lang IS NULL OR lang NOT IN ('fr', 'de') GROUP BY 1
    UNION ALL SELECT lang, count(*), count(*), 0 FROM labels JOIN documents USING (doc_id) WHERE lang = 'fr' GROUP BY 1""")
def news_delete_insert_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents are inserted, two countries deleted, the labelled rows of one inserted again, and all countries counted.

    The table has a name of its own and is dropped when the driver's Python ends.
    """
    name = f"news_articles_{uuid.uuid4().hex}"
    news.create_table(spark, name)
    atexit.register(_dropped, spark, name)
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select(F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("headline"), t.or_empty(F.col("text")).alias("article_text"), F.col("lang").alias("country_tag"))
    news.insert(rows, name)
    for country in ("fr", "de"):
        news.delete_country(spark, country, name)
    labelled = _table(spark, sf_dir, "labels").select(F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("_headline"))
    news.insert(rows.filter("country_tag = 'fr'").join(labelled, F.col("headline") == F.col("_headline")).drop("_headline"), name)
    counted = spark.table(name).groupBy(t.or_empty(F.col("country_tag")).alias("country_tag"))
    return counted.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.count_if(F.col("created_at").isNull()).alias("n_without_time"))


def _dropped(spark: SparkSession, name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    except Exception:  # the session may be gone already
        return
