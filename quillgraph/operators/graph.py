"""The link graph: resolution, backlinks, degrees, neighbourhoods and shadow nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import order

STYLE = {"shape": "rect", "fill": "#1c1c1e", "stroke": "#333", "text_color": "#fff", "width": 120, "height": 50}  #: of every known type; others take it too
EDGE_STYLE = {"type": "flow", "label": "links to", "stroke": "#262626", "width": 1.2, "dasharray": "3 3"}


def resolver(nodes: DataFrame, with_aliases: bool = True) -> DataFrame:
    """canonical -> uid over names and aliases; of several claims the last by path and position counts.

    Columns canonical, uid.  ``nodes`` needs uid, rel_path and, for aliases, aliases.
    """
    names = F.concat(F.array("uid"), F.col("aliases")) if with_aliases else F.array("uid")
    claims = nodes.select("uid", "rel_path", F.posexplode_outer(names).alias("pos", "name"))
    return claims.groupBy(t.canonical(F.col("name")).alias("canonical")).agg(F.max_by("uid", F.struct("rel_path", "pos")).alias("uid"))


def raw_links(nodes: DataFrame, links_col: str = "raw_links") -> DataFrame:
    """One row for each link as written: src, pos, raw.

    The outer form keeps the planner from testing for empty arrays first, which would take the links apart twice.
    """
    return nodes.select(F.col("uid").alias("src"), F.posexplode_outer(links_col).alias("pos", "raw")).filter(F.col("raw").isNotNull())


def resolve(found: DataFrame, names: DataFrame) -> DataFrame:
    """Edges src, pos, raw, dst, resolved.  A link that no name answers to keeps its text as dst.

    Of links of one source with the same target (the same text, case ignored, where unresolved) the first stays.  The
    join's strategy is left to the planner: names grow with the notes.
    """
    joined = found.withColumn("canonical", t.canonical(F.col("raw"))).join(names.withColumnRenamed("uid", "_uid"), "canonical", "left")
    named = joined.select("src", "pos", "raw", F.coalesce("_uid", "raw").alias("dst"), F.col("_uid").isNotNull().alias("resolved"))
    same = F.when(F.col("resolved"), F.concat(F.lit("="), F.col("dst"))).otherwise(F.concat(F.lit("~"), F.lower("dst")))
    first = Window.partitionBy("src", same).orderBy("pos")
    return named.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


def dangling(edges: DataFrame) -> DataFrame:
    return edges.filter(~F.col("resolved"))


def backlinks(edges: DataFrame) -> DataFrame:
    """uid and its sources in order, for every node that another (or it itself) links to.

    A row holds all sources of a node: for bounded edges only, such as the listed ones of indexed().  Of whole tables
    adjacency.backlink_pages() gives them in pages.
    """
    return edges.filter("resolved").groupBy(F.col("dst").alias("uid")).agg(F.array_sort(F.collect_list("src")).alias("backlink_uids"))


def indexed(nodes: DataFrame, edges: DataFrame, listed: int = 100) -> DataFrame:
    """nodes with outbound_links (in order), backlink_count and backlink_uids, 0 or empty where there are none.

    backlink_uids are the first ``listed`` by name, more than any context shows, so that no row grows with a hub;
    backlinks() and related() have them all.
    """
    none = F.array().cast("array<string>")
    out = edges.groupBy(F.col("src").alias("uid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("outbound_links"))
    real = edges.filter("resolved")
    place = F.row_number().over(Window.partitionBy("dst").orderBy("src"))
    back = backlinks(real.withColumn("_n", place).filter(F.col("_n") <= listed))
    counts = real.groupBy(F.col("dst").alias("uid")).agg(F.count("*").alias("backlink_count"))
    joined = nodes.join(out, "uid", "left").join(back, "uid", "left").join(counts, "uid", "left")
    return joined.withColumns({
        "outbound_links": F.coalesce("outbound_links", none), "backlink_uids": F.coalesce("backlink_uids", none),
        "backlink_count": F.coalesce("backlink_count", F.lit(0))})


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """uid, out_degree (dangling links too), in_degree and degree of every node."""
    ends = edges.select(F.col("src").alias("uid"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.filter("resolved").select(F.col("dst").alias("uid"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("uid").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    return nodes.select("uid").join(sums, "uid", "left").select(
        "uid", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("out_degree", "in_degree")]).withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def top_degree(nodes: DataFrame, edges: DataFrame, n: int = 100) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), "uid").limit(n)


def induced(edges: DataFrame, subset: DataFrame) -> DataFrame:
    """Edges with both ends among subset.uid."""
    ends = subset.select("uid")
    return edges.join(ends, edges["src"] == ends["uid"], "left_semi").join(ends.withColumnRenamed("uid", "_uid"), F.col("dst") == F.col("_uid"), "left_semi")


def graph_nodes(subset: DataFrame, order: Column) -> DataFrame:
    """Node drawings on a grid of eight a row, in ``order``.  The subset is a page of results, so one window holds it."""
    rows = subset.withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1)
    return rows.select(
        F.col("uid").alias("id"), F.col("uid").alias("label"), F.col("entity_type").alias("type"), *[F.lit(v).alias(k) for k, v in STYLE.items()],
        t.grid_x(F.col("_i")).alias("x"), t.grid_y(F.col("_i")).alias("y"), F.substring("summary", 1, 120).alias("summary"))


def crawl(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors (uid, rank) and their neighbours: uid, is_anchor, ord, in the order of a crawl.

    Anchor by anchor: itself, then its outbound nodes in link order, then its backlinks by name.  A node counts where
    it comes up first.  Dangling links lead nowhere.  Whether the anchors are broadcast is left to the planner, which
    knows their size.
    """
    a = anchors.select(F.col("uid").alias("anchor"), "rank")
    real = edges.filter("resolved")
    own = a.select(F.col("anchor").alias("uid"), F.struct("rank", F.lit(0).alias("k"), F.lit(0).alias("pos"), F.lit("").alias("by")).alias("ord"), F.lit(True).alias("is_anchor"))
    out = real.join(a, real["src"] == a["anchor"]).select(F.col("dst").alias("uid"), F.struct("rank", F.lit(1).alias("k"), "pos", F.lit("").alias("by")).alias("ord"), F.lit(False).alias("is_anchor"))
    back = real.join(a, real["dst"] == a["anchor"]).select(F.col("src").alias("uid"), F.struct("rank", F.lit(2).alias("k"), F.lit(0).alias("pos"), F.col("src").alias("by")).alias("ord"), F.lit(False).alias("is_anchor"))
    return own.unionByName(out).unionByName(back).groupBy("uid").agg(F.max("is_anchor").alias("is_anchor"), F.min("ord").alias("ord"))


def related(edges: DataFrame, uid: Column | str) -> DataFrame:
    """Neighbours of one node (or of each src, where uid is None): src, uid, relation_type, pos.

    Outbound neighbours come first and win over backlinks; each neighbour is listed once.
    """
    real = edges.filter("resolved")
    out = real.select("src", F.col("dst").alias("uid"), F.lit("outbound").alias("relation_type"), F.lit(0).alias("k"), "pos")
    back = real.select(F.col("dst").alias("src"), F.col("src").alias("uid"), F.lit("backlink").alias("relation_type"), F.lit(1).alias("k"), F.lit(0).alias("pos"))
    both = out.unionByName(back)
    if uid is not None:
        both = both.filter(F.col("src") == uid)
    best = both.groupBy("src", "uid").agg(F.min(F.struct("k", "pos", "relation_type")).alias("b"))
    return best.select("src", "uid", F.col("b.relation_type").alias("relation_type"), F.col("b.pos").alias("pos"))


def reconcile(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Extracted entities (name, class) with the uid of the node they name, or NULL."""
    filled = entities.select(t.strip(F.col("name")).alias("name"), t.strip(F.col("class")).alias("class")).filter("name <> ''")
    return filled.withColumn("canonical", t.canonical(F.col("name"))).join(names, "canonical", "left")


def shadow_nodes(reconciled: DataFrame) -> DataFrame:
    """name, class and the note text of a placeholder for every entity without a node."""
    missing = reconciled.filter(F.col("uid").isNull()).dropDuplicates(["canonical"])
    kind = F.regexp_replace("class", r"^[\[\]]+|[\[\]]+$", "")
    head = lambda *lines: F.concat(F.lit("---\n"), *lines, F.lit("status: shadow\n---\n# "), F.col("name"), F.lit("\n\n"))
    # The texts of placeholders.
    refinery = F.concat(head(F.lit("node_type: PRIVATE_CONGLOMERATE\nsub_type: MINING_REFINERY\n")), F.lit(
        "- Requires [[Continuous Baseload Power Grid]]\n- Requires [[Industrial Bulk Water Source]]\n- Regulated by [[Environmental Management Agency]]\n"))
    agency = F.concat(head(F.lit("node_type: GOVERNMENT_AGENCY\n")), F.lit("- Overseen by [[Overseeing Government Ministry]]\n- Established under [[Act of Parliament]]\n"))
    other = F.concat(head(F.lit("node_type: "), kind, F.lit("\n")), F.lit("- Shadow node for context matching.\n"))
    return missing.select("name", "class", F.when(F.col("class") == "[MINING_REFINERY]", refinery).when(F.col("class") == "[GOVERNMENT_AGENCY]", agency).otherwise(other).alias("raw"))


def trace_graph(traces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lineage traces (pos, source_node, target_concept, relationship_type) as (nodes, edges) of a flow drawing.

    nodes: id, tier (0 root, 1 source, 2 target), label, index by first occurrence; edges: from_id, to_id, label.
    """
    def distinct(col: str, prefix: str, tier: int) -> DataFrame:
        firsts = traces.groupBy(F.col(col).alias("label")).agg(F.min("pos").alias("first"))
        return order.numbered(firsts, ["first", "label"], "index").select(
            F.concat(F.lit(prefix), F.col("index").cast("string")).alias("id"), F.lit(tier).alias("tier"), "label", F.col("index").cast("int").alias("index"))

    sources, targets = distinct("source_node", "source-", 1), distinct("target_concept", "target-", 2)
    spark = traces.sparkSession
    root = spark.createDataFrame([("root", 0, "root", 0)], "id string, tier int, label string, index int")
    nodes = root.unionByName(sources).unionByName(targets)
    s = sources.select(F.col("id").alias("from_id"), F.col("label").alias("source_node"))
    d = targets.select(F.col("id").alias("to_id"), F.col("label").alias("target_concept"))
    edges = traces.join(s, "source_node").join(d, "target_concept").select("from_id", "to_id", F.col("relationship_type").alias("label"))
    return nodes, sources.select(F.lit("root").alias("from_id"), F.col("id").alias("to_id"), F.lit("").alias("label")).unionByName(edges)
