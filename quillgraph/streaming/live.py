"""A note graph that follows its notes: a change reaches the resolver, the edges and the degrees without a rebuild.

changed paths -> changed winners of their stems -> changed claims -> canonical names that now mean another note ->
sources that link by such a name -> their edges -> the degrees of both ends.

Every table is a folder of Parquet files that only grows: rows carry the version that wrote them, and a key's rows of the
last committed version count.  Tables are partitioned by a hash of the key they are looked up by, so a look-up of a few
keys reads a few parts.  A version counts once its commit record is written; what a failed attempt left is never read.

    notes     by uid        all parsed notes, overridden ones too, and marks of deleted ones
    claims    by canonical  names and aliases of the winning notes
    names     by canonical  which note a name means, or none
    links     by canonical  which notes link by a name
    edges     by src        edges of a note; a mark where it has none
    degrees                 differences, summed when read
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t
from ..operators import graph, parse
from ..sources import scratch

_KEYS = {"notes": "uid", "claims": "canonical", "names": "canonical", "links": "canonical", "edges": "src", "degrees": "uid"}
_NO_EDGE = -1


@dataclass
class Change:
    """What an update touched: notes read and deleted, names with another meaning, sources with new edges."""

    read: int
    deleted: int
    names: int
    sources: int


class LiveGraph:
    """The tables below ``folder``; update() takes the whole listing of notes, the other methods are views of the last state."""

    def __init__(self, spark: SparkSession, folder: str, profile: str = "query", parts: int = 64) -> None:
        self.spark, self.folder, self.profile, self.parts = spark, folder, profile, parts
        empty = spark.createDataFrame([], "rel_path string, file_name string, raw string, size_bytes long, mtime timestamp, uid string")
        self.node_type = parse.parsed(empty, profile).schema
        self.schemas = {
            "notes": T.StructType([*self.node_type, T.StructField("gone", T.BooleanType())]),
            "claims": T._parse_datatype_string("canonical string, uid string, rel_path string, pos int, gone boolean"),
            "names": T._parse_datatype_string("canonical string, uid string"),
            "links": T._parse_datatype_string("canonical string, src string, gone boolean"),
            "edges": T._parse_datatype_string("src string, pos int, raw string, dst string, resolved boolean"),
            "degrees": T._parse_datatype_string("uid string, out_degree long, in_degree long")}

    # --- tables

    def _commits(self) -> list[int]:
        there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits")
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return []
        return [r[0] for r in self.spark.read.schema("version long").parquet(f"{self.folder}/commits").collect()]

    def _table(self, name: str) -> DataFrame:
        """Rows of all committed versions, with version and part."""
        schema = T.StructType([*self.schemas[name], T.StructField("version", T.LongType()), T.StructField("part", T.IntegerType())])
        versions = self._commits()
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}").filter(F.col("version").isin(versions))

    def _part(self, key: str) -> F.Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def _append(self, name: str, rows: DataFrame, version: int) -> None:
        """Rows go to their parts' tasks first, else every task leaves a file in every part; a large part takes several tasks."""
        rows = rows.select(*self.schemas[name].fieldNames()).withColumn("version", F.lit(version)).withColumn("part", self._part(_KEYS[name]))
        rows.hint("rebalance", "part").write.mode("append").partitionBy("version", "part").parquet(f"{self.folder}/{name}")

    def _kept(self, name: str, rows: DataFrame, version: int) -> DataFrame:
        """Rows appended under a version that has not been committed, read back: later steps need no other copy of them."""
        self._append(name, rows, version)
        there = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/version={version}")
        if not there.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(there):
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(there.toString()).select(*self.schemas[name].fieldNames())  # without part

    def _of(self, name: str, keys: DataFrame) -> DataFrame:
        """Committed rows of some keys (one column named as the table's): the parts they lie in are pruned at the scan."""
        key = _KEYS[name]
        parts = [r[0] for r in keys.select(self._part(key)).distinct().collect()]  # at most self.parts
        return self._table(name).filter(F.col("part").isin(parts)).join(keys, key, "left_semi")

    @staticmethod
    def _latest(rows: DataFrame, *key: str) -> DataFrame:
        """The rows of each key's last version; a key's rows are a note, its edges or a name."""
        last = F.max("version").over(Window.partitionBy(*key))
        return rows.withColumn("_last", last).filter("version = _last").drop("_last")

    def _heads(self, rows: DataFrame) -> DataFrame:
        return self._latest(rows, "rel_path").filter(~F.col("gone"))

    @staticmethod
    def _winners(notes: DataFrame) -> DataFrame:
        """Of notes of one stem the last path."""
        last = Window.partitionBy("uid").orderBy(F.desc("rel_path"))
        return notes.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n")

    # --- views

    def nodes(self) -> DataFrame:
        return self._winners(self._heads(self._table("notes"))).select(*self.node_type.fieldNames())

    def names(self) -> DataFrame:
        return self._latest(self._table("names"), "canonical").filter("uid is not null").select("canonical", "uid")

    def edges(self) -> DataFrame:
        return self._latest(self._table("edges"), "src").filter(F.col("pos") != _NO_EDGE).select(*self.schemas["edges"].fieldNames())

    def degrees(self) -> DataFrame:
        """uid, out_degree, in_degree and degree of every node."""
        sums = self._table("degrees").groupBy("uid").agg(F.sum("out_degree").alias("o"), F.sum("in_degree").alias("i"))
        found = self.nodes().select("uid").join(sums, "uid", "left").select("uid", F.coalesce("o", F.lit(0)).alias("out_degree"), F.coalesce("i", F.lit(0)).alias("in_degree"))
        return found.withColumn("degree", F.col("out_degree") + F.col("in_degree"))

    # --- changes

    def _claimed(self, notes: DataFrame) -> DataFrame:
        names = F.concat(F.array("uid"), F.col("aliases")) if self.profile != "news" else F.array("uid")
        return notes.select("uid", "rel_path", F.posexplode(names).alias("pos", "name")).select(t.canonical(F.col("name")).alias("canonical"), "uid", "rel_path", "pos")

    @staticmethod
    def _linked(notes: DataFrame) -> DataFrame:
        return notes.select(F.col("uid").alias("src"), F.explode("raw_links").alias("raw")).select(t.canonical(F.col("raw")).alias("canonical"), "src").distinct()

    @staticmethod
    def _moved(before: DataFrame, after: DataFrame) -> DataFrame:
        """Rows that went (gone) and rows that came; neither side repeats a row."""
        both = before.withColumn("_n", F.lit(-1)).unionByName(after.withColumn("_n", F.lit(1)))
        return both.groupBy(*before.columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0").withColumn("gone", F.col("_n") < 0).drop("_n")

    def update(self, listing: DataFrame, texts: Callable[[DataFrame], DataFrame] | None = None) -> Change:
        """Bring the tables to the state of ``listing``, the columns of sources.notes.read_notes() for all notes there are.

        Paths are compared by time and size.  With ``texts`` the listing needs no raw (sources.notes.list_notes()): it is
        given the new and changed paths and reads these alone (sources.notes.read_some()).
        """
        version, kept = time.time_ns(), scratch.written
        old = self._heads(self._table("notes").select("rel_path", "uid", "mtime", "size_bytes", "gone", "version"))
        head = listing.select("rel_path", t.stem(F.col("file_name")).alias("uid"), "mtime", "size_bytes")
        both = head.alias("h").join(old.alias("o"), F.col("h.rel_path") == F.col("o.rel_path"), "full_outer")
        same = (F.col("h.mtime") == F.col("o.mtime")) & (F.col("h.size_bytes") == F.col("o.size_bytes"))
        delta = kept(both.filter(~F.coalesce(same, F.lit(False))).select(
            F.coalesce("h.rel_path", "o.rel_path").alias("rel_path"), F.coalesce("h.uid", "o.uid").alias("uid"), F.col("h.rel_path").isNull().alias("gone")), "delta")
        counts = delta.agg(F.count_if(~F.col("gone")), F.count_if("gone")).first()
        if not any(counts):
            return Change(0, 0, 0, 0)
        uids = delta.select("uid").distinct()
        wanted = delta.filter("not gone").select("rel_path")
        fresh = texts(wanted) if texts else listing.join(wanted, "rel_path", "left_semi")
        fresh = fresh.withColumn("uid", t.stem(F.col("file_name")))
        read = parse.parsed(fresh, self.profile).withColumn("gone", F.lit(False))
        marks = delta.filter("gone").select("rel_path", "uid", "gone")
        read = self._kept("notes", read.unionByName(marks, allowMissingColumns=True), version)
        known = self._heads(self._of("notes", uids))
        before = kept(self._winners(known).select("uid", "rel_path", "aliases", "raw_links"), "before")
        staying = known.join(delta.select("rel_path"), "rel_path", "left_anti")
        after = kept(self._winners(staying.select(*self.node_type.fieldNames()).unionByName(read.filter("not gone").drop("gone"))).select("uid", "rel_path", "aliases", "raw_links"), "after")
        # names that mean another note now
        claims = self._kept("claims", self._moved(self._claimed(before), self._claimed(after)), version)
        asked = kept(claims.select("canonical").distinct(), "asked")
        held = self._latest(self._of("claims", asked).drop("part"), "canonical", "rel_path", "pos", "uid")
        held = self._latest(held.unionByName(claims.withColumn("version", F.lit(version))), "canonical", "rel_path", "pos", "uid").filter(~F.col("gone"))
        meant = held.groupBy("canonical").agg(F.max_by("uid", F.struct("rel_path", "pos")).alias("uid"))
        was = self._latest(self._of("names", asked), "canonical").select("canonical", F.col("uid").alias("was"))
        names = asked.join(meant, "canonical", "left").join(was, "canonical", "left").filter(~F.col("uid").eqNullSafe(F.col("was")))
        names = self._kept("names", names.select("canonical", "uid"), version)
        # sources whose edges can differ
        self._append("links", self._moved(self._linked(before), self._linked(after)), version)
        linking = self._of("links", names.select("canonical")).groupBy("canonical", "src").agg(F.max_by("gone", "version").alias("gone"))
        sources = kept(linking.filter("not gone").select("src").unionByName(uids.select(F.col("uid").alias("src"))).distinct(), "sources")
        others = sources.join(uids.select(F.col("uid").alias("src")), "src", "left_anti").select(F.col("src").alias("uid"))
        written = after.select("uid", "raw_links").unionByName(self._winners(self._heads(self._of("notes", others))).select("uid", "raw_links"))
        raw = kept(graph.raw_links(written), "raw")
        by = raw.select(t.canonical(F.col("raw")).alias("canonical")).distinct()
        table = self._latest(self._of("names", by).select("canonical", "uid", "version").unionByName(
            names.join(by, "canonical", "left_semi").withColumn("version", F.lit(version))), "canonical").filter("uid is not null").select("canonical", "uid")
        edges = self._kept("edges", graph.resolve(raw, table), version)
        marked = sources.join(edges.select("src").distinct(), "src", "left_anti").withColumns({
            "pos": F.lit(_NO_EDGE), "raw": F.lit(None).cast("string"), "dst": F.lit(None).cast("string"), "resolved": F.lit(False)})
        past = self._latest(self._of("edges", sources), "src").filter(F.col("pos") != _NO_EDGE)
        ends = [
            side.select(F.col(end).alias("uid"), F.lit(sign * (end == "src")).alias("out_degree"), F.lit(sign * (end == "dst")).alias("in_degree"))
            for rows, sign in ((past, -1), (edges, 1)) for end, side in (("src", rows), ("dst", rows.filter("resolved")))]
        moved = reduce(DataFrame.unionByName, ends).groupBy("uid").agg(F.sum("out_degree").alias("out_degree"), F.sum("in_degree").alias("in_degree"))
        self._append("edges", marked, version)
        self._append("degrees", moved.filter("out_degree <> 0 or in_degree <> 0"), version)
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.folder}/commits")
        return Change(counts[0], counts[1], names.count(), sources.count())
