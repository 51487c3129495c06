"""Token budgets: estimates and truncations by characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token model and its limits.
CHARS_PER_TOKEN = 3.2
CEILING, FOR_OUTPUT, FOR_SAFETY = 60_000, 8_000, 1_000
AVAILABLE = CEILING - FOR_OUTPUT - FOR_SAFETY
TRUNCATED = "\n[TRUNCATED]"
CHUNK_TRUNCATED = "\n[CHUNK TRUNCATED]"
FINAL_TRUNCATED = "\n[FINAL PROMPT TRUNCATED]"
ANALYSIS_TRUNCATED = "\n[ANALYSIS TRUNCATED]"
ARTICLE_TRUNCATED = "\n\n[ARTICLE TRUNCATED TO RESPECT TOKEN BUDGET]"
GRAPH_TRUNCATED = "\n\n[GRAPH CONTEXT TRUNCATED TO RESPECT TOKEN BUDGET]"


def estimate(text: Column) -> Column:
    """Tokens of a text: its length over the characters of a token, cut to whole, plus one; 0 for an empty text."""
    n = F.coalesce(F.length(text), F.lit(0))
    return F.when(n == 0, F.lit(0)).otherwise((n / F.lit(CHARS_PER_TOKEN)).cast("int") + 1).cast("long")


def characters(available: int = AVAILABLE) -> int:
    return int(available * CHARS_PER_TOKEN)


def truncate(user: Column, system: Column, available: int = AVAILABLE, marker: str = TRUNCATED) -> Column:
    """The user text, cut and marked where system and user text together are over the budget."""
    room = F.lit(characters(available)) - F.length(system)
    return F.when(estimate(F.concat(system, user)) > available, F.concat(F.substring(user, F.lit(1), F.greatest(room, F.lit(0))), F.lit(marker))).otherwise(user)


def truncate_two(article: Column, graph: Column, system: Column, available: int = AVAILABLE, article_share: float = 0.25) -> Column:
    """Struct (article, graph): over the budget the article keeps at most its share of the room, the graph gets the rest.

    The markers come on top.  A system text that alone exceeds the budget is an error of the query.
    """
    room = F.lit(characters(available)) - F.length(system)
    for_article = F.least(F.length(article), (room * article_share).cast("int"))
    for_graph = room - for_article
    over = estimate(F.concat(system, article, graph)) > available
    cut = lambda text, n, marker: F.when(over & (F.length(text) > n), F.concat(F.substring(text, F.lit(1), n), F.lit(marker))).otherwise(text)
    fine = F.when(over & (room <= 0), F.raise_error(F.lit("the system prompt alone exceeds the token budget")).cast("string"))
    return F.struct(F.coalesce(fine, cut(article, for_article, ARTICLE_TRUNCATED)).alias("article"), cut(graph, for_graph, GRAPH_TRUNCATED).alias("graph"))
