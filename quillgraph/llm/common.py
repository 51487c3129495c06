"""Pieces that several corpus operators share: scratch tables, folds, bounded samples and Arrow text batches."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}
_tables: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one for a local master (tests).

    A cluster without that setting is an error: its executors would write to disks of their own.
    """
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        there = spark.sparkContext.getCheckpointDir()
    if not there:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        there = f"file://{tempfile.mkdtemp(prefix='quillgraph-')}"
        spark.sparkContext.setCheckpointDir(there)
    return there


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts its lineage.

    With ``by`` the table is bucketed by that column, so that joins and groups by it do not shuffle it again.  A lost
    executor then costs a re-read, never a recomputation.  The write's shuffle files go as soon as it ends, as nothing
    reads them again; the tables go when the driver's Python ends.
    """
    spark = df.sparkSession
    unique = f"{name}-{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/quillgraph/{unique}"
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    with _shuffle_files_removed(spark):
        if by:
            table = unique.replace("-", "_")
            _tables[table] = spark
            df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("path", path).saveAsTable(table)
            return spark.table(table)
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffle_files_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside are removed as each ends, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def _clean() -> None:
    for table, spark in _tables.items():
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # the JVM may be gone already
            break
    for path, spark in _written.items():
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the JVM may be gone already
            return


def remainder(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, fold: Column, rows: int, text_bytes: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``rows`` labelled documents of the learning folds: columns label (0 or 1) and body.

    The sample is chosen by a hash of the id, so it is the same on every run and any cluster.  Texts over
    ``text_bytes`` bytes are not learnt from (they are scored like all others).  The ids joined are at most
    ``rows``, which bounds the broadcast.
    """
    chosen = (
        labels.filter(fold & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
        .orderBy(F.xxhash64("_id"), "_id").limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return (
        texts.join(F.broadcast(chosen), "_id").filter(F.octet_length("body") <= text_bytes)
        .dropDuplicates(["_id"]).select("_id", "label", "body")
    )


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Columns id and body of every row, null texts as empty ones, for an Arrow map."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), *more)


def lowered(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text with A-Z lower-cased and nothing else changed."""
    return pc.ascii_lower(column).cast(pa.binary()).to_pylist()


def pieces(batch: pa.RecordBatch, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch holding about ``limit`` bytes of body each, so that working memory stays bounded."""
    sizes = pc.binary_length(batch.column("body")).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)
