"""Notes to nodes: front matter, summaries, types, links and aliases."""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..sources.notes import folder_type

# Header keys, headings and the words that tell a note's type.
SUMMARY_KEYS = ("summary", "Summary", "description", "Description", "abstract", "Abstract", "note", "Note")
ALIAS_KEYS = ("aliases", "alias", "title", "name")
HEADINGS = ("Key Contacts", "Decision Makers", "Licenses", "Active Projects")
TYPE_WORDS = (
    ("mining_refinery", ("mine", "refinery", "smelter", "concentrator")),
    ("government_ministry", ("ministry", "department of")),
    ("government_agency", ("agency", "regulatory", "authority", "commission")),
    ("academic_institution", ("university", "institute", "polytechnic")),
    ("infrastructure_node", ("power plant", "dam", "railway", "port", "grid")),
    ("commodity", ("lithium", "cobalt", "copper", "gold", "nickel", "ore")),
    ("policy_framework", ("act", "law", "policy", "framework", "regulation")),
    ("private_conglomerate", ("corporation", "ltd", "inc", "group", "company")),
)
PREVIEW = 2000
SUMMARY_LENGTH = {"query": 400, "execute": 300, "news": 400}  #: characters of the body that stand in for a summary

# The patterns of a header and of a section below a heading.
_HEADER = r"(?s)^---\s*\n(.*?)\n---\s*\n(.*)$"
_SECTION = r"(?im)^#{{1,6}}\s*{name}\s*\n((?s:.*?))(?=\n#{{1,6}}\s|\z)"


def split_header(raw: Column) -> Column:
    """Struct (header, body): the text between the first two rules, and what follows, stripped; NULL and all without one."""
    has = raw.rlike(_HEADER)
    return F.struct(F.when(has, F.regexp_extract(raw, _HEADER, 1)).alias("header"), F.when(has, t.strip(F.regexp_extract(raw, _HEADER, 2))).otherwise(raw).alias("body"))


def _plain(value):
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [_plain(v) for v in value]
    if isinstance(value, datetime.date | datetime.datetime):
        return value.isoformat()
    return value


def parse_header(text: str | None) -> dict:
    """A header as a dict; {} where it is no YAML map.  Without a YAML library, its 'key: value' lines."""
    if not text:
        return {}
    try:
        import yaml
    except ImportError:
        return {m[1]: m[2].strip() for m in re.finditer(r"^([^\s:#][^:\n]*):[ \t]*(.*)$", text, re.M)}
    try:
        found = yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except (yaml.YAMLError, ValueError):
        return {}
    return _plain(found) if isinstance(found, dict) else {}


def _leaves(value) -> list[str]:
    return [value] if isinstance(value, str) else [v for v in value if isinstance(v, str)] if isinstance(value, list) else []


# Header keys, in order, that give a note's type, country and sector.
TYPE_KEYS, COUNTRY_KEYS, SECTOR_KEYS = ("node_type", "type", "entity_type"), ("country", "location"), ("sector", "industry")
_HEADER_TYPE = T.StructType([
    T.StructField("fm", T.MapType(T.StringType(), T.ArrayType(T.StringType()))), T.StructField("fm_json", T.StringType()),
    T.StructField("aliases", T.ArrayType(T.StringType())), *[T.StructField(f"given_{k}", T.StringType()) for k in ("summary", "type", "country", "sector")]])


def _lead(value) -> str:
    """The text itself, or a list's first item where that is text."""
    return value if isinstance(value, str) else value[0] if isinstance(value, list) and value and isinstance(value[0], str) else ""


def _shown(value) -> str:
    return _lead(value) or ("" if value in (None, "", [], {}) else json.dumps(value, ensure_ascii=False))


def _first(found: dict, keys: tuple[str, ...], shown) -> str:
    return next((x for x in (shown(found.get(k)) for k in keys) if x), "")


@F.pandas_udf(_HEADER_TYPE)
def yaml_columns(headers: pd.Series) -> pd.DataFrame:
    """fm: text leaves by key; fm_json: the whole header; other names; and the first filled summary, type, country and sector."""
    rows = [parse_header(h) for h in headers]
    return pd.DataFrame({
        "fm": [{k: _leaves(v) for k, v in d.items()} for d in rows], "fm_json": [json.dumps(d, ensure_ascii=False, default=str) for d in rows],
        "aliases": [[a for k in ALIAS_KEYS for a in _leaves(d.get(k))] for d in rows],
        "given_summary": [_first(d, SUMMARY_KEYS, lambda v: _lead(v).strip()) for d in rows], "given_type": [_first(d, TYPE_KEYS, _lead) for d in rows],
        "given_country": [_first(d, COUNTRY_KEYS, _shown) for d in rows], "given_sector": [_first(d, SECTOR_KEYS, _shown) for d in rows]})


def section(body: Column, name: str) -> Column:
    """The text below a heading up to the next one, stripped.  An empty section runs on into the next heading's."""
    return t.strip(F.regexp_extract(body, _SECTION.format(name=re.escape(name)), 1))


def summary(given: Column, body: Column, length: int) -> Column:
    """The first filled header field, else the Summary section, else the body's first characters."""
    return t.first_filled(given, section(body, "Summary"), t.strip(F.substring(body, 1, length)))


def inferred_type(body: Column) -> Column:
    """The first group of words of which one occurs in the lower-cased body, inside other words too; else the empty text."""
    def first(low: Column) -> Column:
        out = F.lit("")
        for name, words in reversed(TYPE_WORDS):
            out = F.when(t.contains_any(low, words), F.lit(name)).otherwise(out)
        return out

    return F.transform(F.array(F.lower(body)), first)[0]  # lower-cased once


def entity_type(given: Column, body: Column) -> Column:
    return F.when(given.isin("", "unknown"), t.first_filled(inferred_type(body), given)).otherwise(given)


def links(raw: Column, segment: bool = True, dedupe: bool = True) -> Column:
    """Targets of [[...]]: the text before '|', its last path segment if asked for, stripped, none empty."""
    found = F.regexp_extract_all(raw, F.lit(r"\[\[(.*?)\]\]"), F.lit(1))
    named = F.transform(found, lambda x: F.element_at(F.split(x, r"\|", -1), 1))
    cut = F.transform(named, lambda x: t.strip(t.last_segment(x) if segment else x))
    filled = F.filter(cut, lambda x: x != "")
    return t.distinct_ignoring_case(filled) if dedupe else filled


def sections(body: Column) -> Column:
    """Map of the known headings to their text, where there is any."""
    whole = F.create_map(*[x for h in HEADINGS for x in (F.lit(h), section(body, h))])
    return F.map_filter(whole, lambda _, v: v != "")


def header_line(raw: Column) -> Column:
    """The header's text with line ends as ' | ', else the empty text; no YAML is read."""
    return F.replace(t.strip(F.regexp_extract(raw, r"(?s)^---\s*\n(.*?)\n---\s*\n", 1)), F.lit("\n"), F.lit(" | "))


def registry_line(name: Column, raw: Column) -> Column:
    """One line on a note: name, header, and the first 120 characters of its first line that is no rule or heading."""
    lines = F.filter(F.transform(F.split(raw, "\n", -1), t.strip), lambda x: (x != "") & ~F.startswith(x, F.lit("---")) & ~F.startswith(x, F.lit("#")))
    header, first = header_line(raw), F.substring(t.or_empty(F.try_element_at(lines, F.lit(1))), 1, 120)
    return F.concat(F.lit("- **"), name, F.lit("**"), F.when(header != "", F.concat(F.lit(" ["), header, F.lit("]"))).otherwise(""), F.when(first != "", F.concat(F.lit(" -> Context: "), first)).otherwise(""))


def nodes(notes: DataFrame, profile: str = "query") -> DataFrame:
    """One row for each stem (of equal stems the last path): the columns of a node.

    ``profile`` (query, execute or news) sets the length of stand-in summaries and how links are cut.
    """
    return parsed(last_paths(notes), profile)


def parsed(notes: DataFrame, profile: str = "query") -> DataFrame:
    """The columns of a node for every row of ``notes``, which has its uid already."""
    head = notes.select("*", split_header(F.col("raw")).alias("h")).select("*", "h.header", "h.body").drop("h")
    read = head.withColumn("y", yaml_columns("header")).select("*", "y.*").drop("y", "header")
    body = F.col("body")
    return read.select(
        "uid", "rel_path", F.split("rel_path", "/", -1).alias("path_parts"), "raw", "body", F.substring(body, 1, PREVIEW).alias("body_preview"), "fm", "fm_json",
        summary(F.col("given_summary"), body, SUMMARY_LENGTH[profile]).alias("summary"), entity_type(F.col("given_type"), body).alias("entity_type"),
        F.col("given_country").alias("country"), F.col("given_sector").alias("sector"),
        folder_type(F.col("rel_path")).alias("folder_type"), t.slug(F.col("uid")).alias("slug"),
        links(F.col("raw"), segment=profile != "news", dedupe=profile != "news").alias("raw_links"), "aliases", sections(body).alias("sections"), "size_bytes", "mtime")


def last_paths(notes: DataFrame, most: int = 100_000) -> DataFrame:
    """notes with uid (the stem), without those of a stem that has a later path.

    Stems of several paths are found from names alone, before any text is read.  They are counted: none is the usual
    case and costs nothing more, up to ``most`` are sent to the tasks, and more are joined.
    """
    rows = notes.withColumn("uid", t.stem(F.col("file_name")))
    last = rows.groupBy("uid").agg(F.max("rel_path").alias("_last"), F.min("rel_path").alias("_first")).filter("_first < _last").select(F.col("uid").alias("_uid"), "_last")
    found = last.limit(most + 1).count()
    if not found:
        return rows
    return rows.join(F.broadcast(last) if found <= most else last, (F.col("uid") == F.col("_uid")) & (F.col("rel_path") < F.col("_last")), "left_anti")
