"""Scored retrieval: pre-filter by intent, anchors by tokens, full-text search, ranked selection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from .trigrams import Skipped, TrigramIndex, top_k

# Weights, caps and the header fields that count for anchors.
WEIGHTS = {"type": 8.0, "country": 6.0, "sector": 5.0, "name": 10.0, "word": 4.0, "content": 2.0, "attribute": 3.0, "degree": 0.3}
CANDIDATES, RANKED, FULL_SCAN, ANCHORS = 80, 20, 100, 5
BONUS_KEYS = ("title", "name", "position", "role", "executive", "job_title", "designation", "organization", "company")
IN_BONUS, IN_TEXT = 3, 1
INTENTS = ("OVERVIEW", "SPECIFIC_ENTITY", "FILTERED_LIST", "RELATIONSHIP", "COMPARISON")


@dataclass
class Intent:
    """What a question asks for.  Its lists are short; they become literals of the plan."""

    kind: str = "OVERVIEW"
    entities: Sequence[str] = ()
    entity_types: Sequence[str] = ()
    countries: Sequence[str] = ()
    sectors: Sequence[str] = ()
    attributes: dict[str, str] = field(default_factory=dict)
    relationship: str | None = None
    output_format: str = "summary"


def _sum(parts: list[Column]) -> Column:
    out = F.lit(0.0)
    for p in parts:
        out = out + p
    return out


def _points(hit: Column, weight: float) -> Column:
    return F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))


def intent_score(intent: Intent, name: Column, summary: Column, preview: Column, kind: Column, country: Column, sector: Column, degree: Column | None = None) -> Column:
    """Sum of the weights of everything in the intent that the node shows; each list element counts by itself.

    A node's empty type is part of every wanted type, as the empty text is part of every text.
    """
    own = F.replace(F.lower(t.or_empty(kind)), F.lit("_"), F.lit(""))
    spoken = t.spoken(t.or_empty(name))
    content = F.lower(F.concat_ws(" ", t.or_empty(summary), t.or_empty(preview)))
    parts = []
    for x in intent.entity_types:
        want = F.lit(x.lower().replace("_", ""))
        parts.append(_points(F.contains(own, want) | F.contains(want, own), WEIGHTS["type"]))
    parts += [_points(F.contains(F.lower(t.or_empty(country)), F.lit(x.lower())), WEIGHTS["country"]) for x in intent.countries]
    parts += [_points(F.contains(F.lower(t.or_empty(sector)), F.lit(x.lower())), WEIGHTS["sector"]) for x in intent.sectors]
    for x in (e.lower() for e in intent.entities):
        parts.append(F.when(F.contains(spoken, F.lit(x)), F.lit(WEIGHTS["name"])).when(t.contains_any(spoken, x.split()), F.lit(WEIGHTS["word"])).otherwise(F.lit(0.0)))
        parts.append(_points(F.contains(content, F.lit(x)), WEIGHTS["content"]))
    parts += [_points(F.contains(content, F.lit(x.lower())), WEIGHTS["attribute"]) for x in intent.attributes.values()]
    if intent.kind == "OVERVIEW" and degree is not None:
        parts.append(degree * F.lit(WEIGHTS["degree"]))
    return _sum(parts)


def pre_filter(nodes: DataFrame, intent: Intent, cap: int = CANDIDATES) -> DataFrame:
    """The ``cap`` best nodes of a score above zero, ties by uid, in column order score desc: a top-k, no full sort."""
    degree = F.size("outbound_links") + F.col("backlink_count")
    score = intent_score(intent, *[F.col(c) for c in ("uid", "summary", "body_preview", "entity_type", "country", "sector")], degree)
    return nodes.withColumn("score", score).filter("score > 0").orderBy(F.desc("score"), "uid").limit(cap)


def overlap_score(wanted: Sequence[str], bonus: Column, block: Column) -> Column:
    """Points for each token: those of the bonus text, else those of the text block."""
    out = F.lit(0)
    for w in sorted(set(wanted)):
        out = out + F.when(F.contains(bonus, F.lit(w)), IN_BONUS).when(F.contains(block, F.lit(w)), IN_TEXT).otherwise(0)
    return out


def seed_terms(opportunity: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Column terms (after those of ``keep``): title or name, missing nodes, beneficiary and funder, stripped, each once (case ignored)."""
    items = F.concat(F.array(t.first_filled(F.col("title"), F.col("name"))), F.coalesce("required_missing_nodes", F.array().cast("array<string>")),
                     F.array(t.or_empty(F.col("capital_flow.beneficiary")), t.or_empty(F.col("capital_flow.likely_funder"))))
    return opportunity.select(*keep, t.distinct_ignoring_case(F.filter(F.transform(items, lambda x: t.strip(t.or_empty(x))), lambda x: x != "")).alias("terms"))


def _anchor_texts() -> tuple[Column, Column]:
    """The bonus text and the text block of a node."""
    extra = F.flatten(F.map_values(F.map_filter("fm", lambda key, _: key.isin(*BONUS_KEYS))))
    return F.lower(F.concat_ws(" ", F.concat(F.array("uid", "uid"), extra))), F.lower(F.concat_ws(" ", "uid", F.array_join("aliases", " "), "summary"))


def anchor_index(nodes: DataFrame, folder: str, part: int = 256) -> TrigramIndex:
    """A trigram index for indexed_anchors(), in parts of ``part`` nodes, or of more where there are many nodes."""
    bonus, block = _anchor_texts()
    rows = nodes.select("uid", bonus.alias("bonus"), block.alias("block"))
    return TrigramIndex.build(rows.withColumn("text", F.concat_ws("\n", "bonus", "block")), folder, part=part)


def indexed_anchors(index: TrigramIndex, wanted: Sequence[str], k: int = ANCHORS) -> tuple[DataFrame, Skipped]:
    """anchors() by an index: the same rows (uid, score, rank), and how many parts were not read."""
    found, skipped = top_k(index, [w.lower() for w in wanted], overlap_score(wanted, F.col("bonus"), F.col("block")), IN_BONUS, k)
    return found.select("uid", F.col("score").cast("int").alias("score"), "rank"), skipped


def anchors(nodes: DataFrame, wanted: Sequence[str], k: int = ANCHORS) -> DataFrame:
    """The k nodes that share most tokens: uid, score, rank from 0.  Ties by uid; no tokens, no anchors."""
    bonus, block = _anchor_texts()
    scored = nodes.select("uid", overlap_score(wanted, bonus, block).alias("score")).filter("score >= 1").orderBy(F.desc("score"), "uid").limit(k)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "uid")) - 1)  # k rows


def search(nodes: DataFrame, q: str) -> DataFrame:
    """Nodes whose name, summary or body holds q (case ignored), one for each slug; an empty q matches all."""
    hits = nodes.filter(F.contains(F.lower(search_text()), F.lit(q.lower())))
    first = hits.groupBy("slug").agg(F.min("uid").alias("uid"))
    return hits.join(first, ["slug", "uid"], "left_semi")


def searched(rows: DataFrame, folder: str, text: str = "text", **more) -> TrigramIndex:
    """A trigram index of rows (uid, slug and what else a hit shows, and the text that is searched) in a folder."""
    return TrigramIndex.build(rows, folder, "uid", text, **more)


def search_text() -> Column:
    """What search() looks through: name, summary and body."""
    return F.concat_ws(" ", "uid", "summary", "body")


def indexed_search(index: TrigramIndex, q: str) -> DataFrame:
    """search() by an index: the same rows, read from the parts that can hold q."""
    hits = index.containing(q).drop("_text")
    first = hits.groupBy("slug").agg(F.min("uid").alias("uid"))
    return hits.join(first, ["slug", "uid"], "left_semi")


def by_rank(candidates: DataFrame, ranked: DataFrame, limit: int | None = None) -> DataFrame:
    """Candidates in the order of ``ranked`` (pos, uid); unknown ids go, repeated ids stay."""
    rows = ranked.join(candidates, "uid").orderBy("pos")
    return rows.limit(limit) if limit is not None else rows
