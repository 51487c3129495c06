"""The news table: schema, append, delete by country and count, on Spark tables or over JDBC."""

from __future__ import annotations

import hashlib
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import order
from . import scratch

SCHEMA = ("id BIGINT, headline STRING NOT NULL, source STRING, published_at TIMESTAMP, article_text STRING NOT NULL, summary STRING, "
          "category STRING, country_tag STRING, created_at TIMESTAMP")


def create_table(spark: SparkSession, name: str = "news_articles") -> None:
    """The table, with a partition for each country, so that a delete by country drops one partition."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet PARTITIONED BY (country_tag)")


class Log:
    """What has been inserted: a folder beside the table with a record for each reserved block of ids and each batch.

    A block is the writer's that creates its record first, so writers that run at once never share ids.  A batch's
    blocks are recorded under its key before any row is written and its end afterwards, so a batch that is run again
    takes the same ids and adds only what the table has not got.
    """

    BLOCK = 1 << 20

    def __init__(self, spark: SparkSession, name: str) -> None:
        told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
        self.spark, self.path = spark, spark._jvm.org.apache.hadoop.fs.Path
        self.root = f"{told['Location'].rstrip('/')}_log"
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        there = self.path(f"{self.root}/{kind}")
        return [f.getPath().getName() for f in self.fs.listStatus(there)] if self.fs.exists(there) else []

    def _create(self, name: str) -> bool:
        try:
            return self.fs.createNewFile(self.path(f"{self.root}/{name}"))
        except Py4JJavaError as e:  # another writer's came between the look and the creation
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise

    def blocks(self, batch: str, rows: int, first: int) -> list[int]:
        """The batch's blocks, as many as its rows need; new ones begin at ``first`` at the lowest."""
        mine = sorted(int(n.split(".")[1]) for n in self._names("claims") if n.split(".")[0] == batch)
        at = max([first, *(int(n) + 1 for n in self._names("blocks"))])
        while len(mine) * self.BLOCK < rows:
            if self._create(f"blocks/{at}"):
                self._create(f"claims/{batch}.{at}")
                mine.append(at)
            at += 1
        return mine

    def ended(self, batch: str) -> bool:
        return batch in self._names("batches")

    def end(self, batch: str) -> None:
        self._create(f"batches/{batch}")


def insert(rows: DataFrame, name: str = "news_articles", batch: str | None = None) -> int:
    """Append rows with unique ids; the number of rows that were added.

    ``batch`` is a key of the caller's: a batch that ended is not inserted again, and one that broke off is completed.
    Without a key every call is a batch of its own.  A batch has the same rows each time it is run.
    """
    spark, log = rows.sparkSession, Log(rows.sparkSession, name)
    key = hashlib.sha256(batch.encode()).hexdigest() if batch is not None else uuid.uuid4().hex
    if log.ended(key):
        return 0
    table = spark.table(name)
    placed = order.numbered(rows, ["headline"], "_position")
    again = any(n.startswith(key) for n in log._names("claims"))
    first = (table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] >> 20) + 1 if not log._names("blocks") else 0
    blocks = log.blocks(key, placed.count(), first)
    start = F.element_at(F.array(*[F.lit(b * log.BLOCK) for b in blocks or [0]]), (F.col("_position") / log.BLOCK).cast("int") + 1)
    filled = placed.withColumn("id", start + F.col("_position") % log.BLOCK).withColumn("created_at", F.current_timestamp()).drop("_position")
    if again:
        filled = filled.join(scratch.written(table.select("id"), "ids"), "id", "left_anti")
    columns = table.columns  # a partitioned table has its partition column last
    filled = scratch.written(filled.select([F.col(c) if c in filled.columns else F.lit(None).cast(table.schema[c].dataType).alias(c) for c in columns]), "insert")
    filled.write.insertInto(name)
    log.end(key)
    return filled.count()


def without_country(table: DataFrame, country: str) -> DataFrame:
    """What a delete by country leaves; rows of no country stay."""
    return table.filter(~F.coalesce(F.col("country_tag") == country, F.lit(False)))


def delete_country(spark: SparkSession, country: str, name: str = "news_articles") -> None:
    """Drop the country's partition.  A table without such partitions is rewritten by way of a second table."""
    parts = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    if parts == ["country_tag"]:
        value = country.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION (country_tag = '{value}')")
        return
    left = f"{name}_left"
    without_country(spark.table(name), country).write.mode("overwrite").saveAsTable(left)
    spark.table(left).write.mode("overwrite").insertInto(name)
    spark.sql(f"DROP TABLE {left}")


def count_country(table: DataFrame, country: str) -> DataFrame:
    return table.filter(F.col("country_tag") == country).agg(F.count("*").alias("n"))


def read_jdbc(spark: SparkSession, url: str, table: str = "news_articles", partitions: int = 1, bounds: tuple[int, int] | None = None, **options: str) -> DataFrame:
    """The table from a database, in parallel ranges of ids where ``bounds`` are given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if bounds:
        reader = reader.options(partitionColumn="id", lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions)
    return reader.load()


def write_jdbc(rows: DataFrame, url: str, table: str = "news_articles", **options: str) -> None:
    rows.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()
