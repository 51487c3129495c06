"""Text functions over Columns: names, slugs, URL decoding, white space, token sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that do not count as search tokens.
STOP_WORDS = (
    "and", "the", "of", "for", "in", "with", "institute", "agency", "a", "an", "to", "is", "on", "at", "by", "from", "as", "or",
    "it", "its", "this", "that", "these", "those", "be", "are",
)


def or_empty(c: Column) -> Column:
    """NULL as the empty text, which is what a missing value is to all scoring."""
    return F.coalesce(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first column that is neither NULL nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def strip(c: Column) -> Column:
    """Without leading and trailing Unicode white space (trim() takes off spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def canonical(c: Column) -> Column:
    """Lower-cased ASCII letters and digits; all else, accented letters too, goes."""
    return F.lower(F.regexp_replace(c, "[^a-zA-Z0-9]", ""))


def url_unquote(c: Column) -> Column:
    """Percent-decoding that leaves '+' alone, and the text as it is where an escape is malformed."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def decode_fully(c: Column) -> Column:
    """Percent-decoding until nothing changes.  A decoding that changes a text shortens it by two characters, which bounds
    the rounds; those after the fixed point do nothing."""
    def again(state: Column, _: Column) -> Column:
        then = url_unquote(state["text"])
        return F.when(state["done"], state).otherwise(F.struct(then.alias("text"), (then == state["text"]).alias("done")))

    start = F.struct(c.alias("text"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(0), F.coalesce(F.floor(F.length(c) / 2), F.lit(0)).cast("int")), start, again, lambda state: state["text"])


def slug(c: Column) -> Column:
    """URL-safe name: decoded, lower-cased, runs of other characters as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(strip(url_unquote(c))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"\.md$", "")


def last_segment(link: Column) -> Column:
    """The part after the last '/'."""
    return F.element_at(F.split(link, "/", -1), -1)


def spoken(name: Column) -> Column:
    """Lower-cased name with '_' and '-' as spaces."""
    return F.translate(F.lower(name), "_-", "  ")


def tokens(phrase: Column) -> Column:
    """Distinct lower-cased alphanumeric words of two characters or more that are no stop words."""
    words = F.regexp_extract_all(F.lower(or_empty(phrase)), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_except(F.filter(words, lambda w: F.length(w) > 1), F.array(*[F.lit(w) for w in STOP_WORDS]))


def distinct_ignoring_case(items: Column) -> Column:
    """The first spelling of each item, in order."""
    pick = lambda out, x: F.when(F.exists(out, lambda y: F.lower(y) == F.lower(x)), out).otherwise(F.concat(out, F.array(x)))
    return F.aggregate(items, F.array().cast("array<string>"), pick)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Whether any word occurs in the text, inside other words too: byte searches, of which the first hit ends all."""
    return reduce(lambda out, w: out | F.contains(text, F.lit(w)), words, F.lit(False))


def cache_key(question: Column) -> Column:
    """First 16 hex digits of the question's sha-256; the name of the full scan for an empty question."""
    return F.substring(F.sha2(F.when(or_empty(question) == "", F.lit("full_scan")).otherwise(question).cast("binary"), 256), 1, 16)


def grid_x(index: Column) -> Column:
    return F.lit(50) + index % 8 * 80


def grid_y(index: Column) -> Column:
    return F.lit(40) + F.floor(index / 8) * 60
