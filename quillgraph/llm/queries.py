"""The thin queries over the synthetic tables, one for each corpus operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    conversation_repair, exact_dedup, knn_join, lm_score, merkle, mixing, partenum, pii, quality_cnn, sentencepiece_codec, simhash,
    token_counts, toxicity)
from .common import remainder

#: Where the vocabulary of the public tokenizer lies; a parameter of the environment, read on the driver only.
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Domains of the labelled table and their wanted shares of the mix.
DOMAINS = ["prose", "junk", "toxic"]
WEIGHTS = {"prose": 0.93, "junk": 0.02, "toxic": 0.05}
#: The mix of op4, for a moderation model: toxic rows are raised, junk is lowered.
MODERATION = {"prose": 0.70, "junk": 0.05, "toxic": 0.25}
#: The Spark setting that holds the key of op7's pseudonyms, and what the query takes where it is unset.
PII_SETTING, PII_EXAMPLE = "spark.quillgraph.pii.key", "an example key; give your own"

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


def _judged(scored: DataFrame, mod: int, held: int) -> DataFrame:
    return scored.select("doc_id", (remainder("doc_id", mod) == held).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    net = quality_cnn.train(docs, _table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return _judged(quality_cnn.scores(docs, net), 4, 2)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"), tau=4, shingle=4)


def domain_labels(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labelled table: toxic rows first, then by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "prose").when(F.col("quality") == 0, "junk")
    return labels.select("doc_id", domain.alias("domain"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = mixing.train(docs, domain_labels(_table(spark, sf_dir, "labels")), DOMAINS)
    return mixing.rates(docs, model, MODERATION)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(_table(spark, sf_dir, "documents"), sentencepiece_codec.load(TOKENIZER))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = sentencepiece_codec.encoded_lengths(_table(spark, sf_dir, "documents"), sentencepiece_codec.load(TOKENIZER))
    return token_counts.context_limits(token_counts.histogram(lengths))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(_table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(PII_SETTING, PII_EXAMPLE))


def op8_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_join.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), remainder("doc_id", 3) != 1)
    return _judged(toxicity.scores(docs, model), 3, 1)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.lm_scores(_table(spark, sf_dir, "documents"), remainder("doc_id", 5) != 1)
    return scored.select("doc_id", (remainder("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    return merkle.manifest(docs, chosen, {"n_chars": docs["n_chars"].cast("decimal(20,0)") + 1})


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_groups(_table(spark, sf_dir, "documents"), least=(4, 5), size=5)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(
        _table(spark, sf_dir, "conversations"), lambda conv, turn: F.crc32(F.concat(conv, F.lit(":"), turn).cast("binary")) % 20)


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_quality": op2_quality,
        "op3_simhash": op3_simhash,
        "op4_mixing": op4_mixing,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_token_counts": op6_token_counts,
        "op7_pii": op7_pii,
        "op8_knn_join": op8_knn_join,
        "op9_toxicity": op9_toxicity,
        "op10_lm_score": op10_lm_score,
        "op11_merkle": op11_merkle,
        "op12_ngram_jaccard": op12_ngram_jaccard,
        "op13_conversation_repair": op13_conversation_repair,
    }


#: A-Z to a-z and nothing else, as translate() states it.
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The fields of a leaf, and CRC-32 of an ASCII text bit by bit.
_FIELDS = " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "{n}", "text"))
_CRC = (
    "xor(list_reduce(flatten(list_transform(string_split({x}, ''), lambda ch: [ascii(ch), 0, 0, 0, 0, 0, 0, 0])), "
    "lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), 4294967295), 4294967295)")


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": f"""
            WITH d AS (SELECT doc_id, {_LOW} AS t FROM documents),
                 g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
            SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
            FROM d JOIN g ON d.t = g.t""",
        "op8_knn_join": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
                 s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
                       FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
                 r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
            SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
        "op11_merkle": f"""
            WITH RECURSIVE
              d AS (SELECT doc_id, lang, sha256({_FIELDS.format(n="n_chars")}) AS leaf,
                           CASE WHEN {_CRC.format(x="CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN sha256({_FIELDS.format(n="n_chars + 1")}) END AS bad FROM documents),
              l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS k FROM d),
              n AS (SELECT lang, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS cnt FROM l UNION ALL
                    SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (cnt + 1) // 2 FROM n WHERE cnt > 1 GROUP BY lang, level, pos // 2, cnt),
              s AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM n WHERE cnt = 1),
              t AS (SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS cnt FROM s UNION ALL
                    SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (cnt + 1) // 2 FROM t WHERE cnt > 1 GROUP BY level, pos // 2, cnt),
              low AS (SELECT l.k, string_agg(n.h, '' ORDER BY n.level) AS p FROM l JOIN n ON l.lang IS NOT DISTINCT FROM n.lang AND n.cnt > 1 AND n.pos = xor(l.pos >> n.level, 1) GROUP BY l.k),
              high AS (SELECT s.pos AS tree, string_agg(t.h, '' ORDER BY t.level) AS p FROM s JOIN t ON t.cnt > 1 AND t.pos = xor(s.pos >> t.level, 1) GROUP BY s.pos),
              c AS (SELECT lang, level, max(cnt) AS cnt FROM n GROUP BY ALL), e AS (SELECT level, max(cnt) AS cnt FROM t GROUP BY ALL),
              a AS (SELECT k, lang, 0 AS level, pos, coalesce(bad, leaf) AS h FROM l UNION ALL
                    SELECT a.k, a.lang, a.level + 1, a.pos // 2, sha256(CASE WHEN a.pos % 2 = 1 THEN n.h || a.h ELSE a.h || coalesce(n.h, '') END)
                    FROM a JOIN c ON a.lang IS NOT DISTINCT FROM c.lang AND a.level = c.level AND c.cnt > 1
                    LEFT JOIN n ON a.lang IS NOT DISTINCT FROM n.lang AND a.level = n.level AND n.pos = xor(a.pos, 1)),
              b AS (SELECT a.k, 0 AS level, s.pos, a.h FROM a JOIN c ON a.lang IS NOT DISTINCT FROM c.lang AND a.level = c.level AND c.cnt = 1 JOIN s ON a.lang IS NOT DISTINCT FROM s.lang UNION ALL
                    SELECT b.k, b.level + 1, b.pos // 2, sha256(CASE WHEN b.pos % 2 = 1 THEN t.h || b.h ELSE b.h || coalesce(t.h, '') END)
                    FROM b JOIN e ON b.level = e.level AND e.cnt > 1 LEFT JOIN t ON b.level = t.level AND t.pos = xor(b.pos, 1))
            SELECT l.doc_id, l.leaf, s.subroot, t.h AS root, sha256(coalesce(low.p, '') || coalesce(high.p, '')) AS proof_sha256, b.h AS folded_root, b.h = t.h AS verified
            FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang JOIN t ON t.cnt = 1 LEFT JOIN low ON l.k = low.k LEFT JOIN high ON s.pos = high.tree
            JOIN b ON b.k = l.k JOIN e ON b.level = e.level AND e.cnt = 1""",
        "op12_ngram_jaccard": f"""
            WITH RECURSIVE
              w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
              s AS (SELECT k, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
              u AS (SELECT k, len(s) AS n, unnest(s) AS x FROM s),
              p AS (SELECT a.k AS a, b.k AS b FROM u a JOIN u b ON a.x = b.x AND a.k <> b.k GROUP BY a.k, b.k, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
              r AS (SELECT k AS a, k AS b FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
            SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id
            FROM s JOIN (SELECT r.a, min(o.doc_id) AS component_id FROM r JOIN s o ON r.b = o.k GROUP BY r.a) c ON s.k = c.a""",
    }
