"""JSON and tag functions over Columns, lenient towards what language models return."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import or_empty, strip


def strip_fence(c: Column) -> Column:
    """Without a surrounding code fence, where the text begins with one."""
    s = strip(c)
    return F.when(F.startswith(s, F.lit("```")), F.regexp_replace(F.regexp_replace(s, r"^```(?i:json)?\s*", ""), r"\s*```$", "")).otherwise(s)


def outermost_object(c: Column) -> Column:
    """From the first '{' to the last '}', else NULL."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def without_trailing_commas(c: Column) -> Column:
    return F.regexp_replace(c, r",(\s*[\}\]])", "$1")


def lenient_json(c: Column) -> Column:
    """The text of a JSON value as VARIANT, or NULL: as it stands, as its outermost object, without trailing commas."""
    s = strip_fence(c)
    return F.coalesce(F.try_parse_json(s), F.try_parse_json(outermost_object(s)), F.try_parse_json(without_trailing_commas(s)))


def lenient_json_or_fail(c: Column, stage: str) -> Column:
    """lenient_json(), or an error of the query that names the stage."""
    return F.coalesce(lenient_json(c), F.parse_json(F.raise_error(F.lit(f"no JSON from stage {stage}")).cast("string")))


def json_or_empty(c: Column) -> Column:
    """As it stands or as its outermost object, else the empty object."""
    s = strip_fence(c)
    return F.coalesce(F.try_parse_json(s), F.try_parse_json(outermost_object(s)), F.parse_json(F.lit("{}")))


def strict_object(c: Column) -> Column:
    """The JSON object that the text is, or NULL; fences, lists and scalars count as failures."""
    v = F.try_parse_json(c)
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)


def tag(c: Column, name: str, default: Column | None = None) -> Column:
    """What stands between <name> and </name>, stripped; else the default (by default the whole text)."""
    found = F.regexp_extract(or_empty(c), f"(?s)<{name}>(.*?)</{name}>", 1)
    has = or_empty(c).rlike(f"(?s)<{name}>.*?</{name}>")
    return F.when(has, strip(found)).otherwise(c if default is None else default)
