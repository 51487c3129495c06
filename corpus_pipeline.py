"""A training-data pipeline of five corpus operators over the table documents.

Each stage works on all that its predecessor kept, and its decisions take effect.  All stages but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import exact_dedup, jaccard, mixing, quality_cnn, sentencepiece_codec, simhash
from quillgraph.llm.common import materialise, remainder
from quillgraph.llm.queries import DOMAINS, TOKENIZER, WEIGHTS, domain_labels


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the byte network rejects go.

    It is fitted on labelled rows of docs; without any all rows score one half and stay.  Null texts are scored as empty
    ones, rows of a null id like all others, repeated rows alike.  Further columns stay as they are.
    """
    net = quality_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder("doc_id", 4) != 2)
    return quality_cnn.drop_low_quality(docs, net, least=0.5)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays.

    Null and empty texts are one group.  Null ids lose to all others.  Rows that repeat an id and a text are one document
    and share its decision: they all stay or all go.  Further columns stay as they are.
    """
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of close fingerprints stays; the first half of near_copies().

    It is the one of the smallest id.  Texts without words have fingerprint zero and link like any other.  Rows that share
    an id are one document; rows of a null id stay.  Further columns stay as they are.
    """
    return simhash.drop_near_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: close fingerprints, or Jaccard similarity of five-word shingles of 0.8 or more.

    Nulls, repeated rows and further columns as in near().
    """
    return jaccard.drop_similar(materialise(near(spark, docs, sf_dir), "close"), least=0.8, size=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are kept at rates of at most one that bring the domains to their target weights relative to the heaviest.

    A domain whose tokens do not suffice is left as it is.  The domains are learnt from the labelled rows of the whole
    table, since the stages before drop most of the junk.  Rows that repeat an id share its draw, rows of a null id
    stay, and null and empty texts count one token.
    """
    labels = domain_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = mixing.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels, DOMAINS)
    return mixing.mixed(docs, model, WEIGHTS, most=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids and exact (decoding gives the text back) for every row, repeated rows each.

    Null and empty texts have no ids; null ids stay null; further columns go.
    """
    return sentencepiece_codec.round_trip(docs, sentencepiece_codec.load(TOKENIZER))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near_copies), ("mixing", mix), ("sentencepiece", encode)]

#: Trained models and a subword vocabulary are no SQL; tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
