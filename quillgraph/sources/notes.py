"""Readers of note trees, articles and dashboards."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as t

# Folder names that tell what their notes are about.
FOLDER_TYPES = {
    "businesses": "business", "companies": "business", "commodities": "commodity", "minerals": "commodity", "government": "government",
    "agencies": "government", "infrastructure": "infrastructure", "people": "person", "contacts": "person", "region": "region",
}


def _files(spark: SparkSession, root: str, where: list[str], recursive: bool) -> DataFrame:
    """Columns rel_path, file_name, content, size_bytes and mtime of the .md files at some paths below root."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", str(recursive).lower()).load(where)
    base = root.rstrip("/").removeprefix("file://")
    rel = F.regexp_replace(F.substring_index(t.url_unquote(F.col("path")), base, -1), "^/+", "")
    return files.select(rel.alias("rel_path"), "content", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime")).select(
        "rel_path", t.last_segment(F.col("rel_path")).alias("file_name"), "content", "size_bytes", "mtime")


def _read(files: DataFrame) -> DataFrame:
    raw = F.try_validate_utf8(F.col("content").cast("string"))
    return files.withColumn("raw", raw).filter(F.col("raw").isNotNull()).select(
        "rel_path", "file_name", F.regexp_replace("raw", "\r\n?", "\n").alias("raw"), "size_bytes", "mtime")


def read_notes(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """One row for each .md file under root: rel_path, file_name, raw (line ends as \\n), size_bytes, mtime.

    Files that are no valid UTF-8 are left out, and so is all below folders whose names begin with '.' or '_'.  ``recursive`` false reads the top level only.
    """
    return _read(_files(spark, root, [root], recursive))


def list_notes(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, file_name, size_bytes and mtime of all notes under root; no text is read."""
    return _files(spark, root, [root], True).drop("content")


def read_some(spark: SparkSession, root: str, most: int = 10_000) -> Callable[[DataFrame], DataFrame]:
    """A reader of the notes of a table of paths (rel_path): of up to ``most`` paths these files alone, of more the
    whole tree, joined."""
    def read(wanted: DataFrame) -> DataFrame:
        paths = [r[0] for r in wanted.select("rel_path").limit(most + 1).collect()]
        if len(paths) > most:
            return read_notes(spark, root).join(wanted.select("rel_path"), "rel_path", "left_semi")
        if not paths:
            return read_notes(spark, root).limit(0)
        return _read(_files(spark, root, [f"{root.rstrip('/')}/{p}" for p in paths], False))

    return read


def folder_type(rel_path):
    """Type by folder: the first path component that is one of the known folder names exactly, else 'unknown'."""
    known = F.create_map(*[F.lit(x) for pair in FOLDER_TYPES.items() for x in pair])
    hits = F.filter(F.transform(F.split(F.lower(rel_path), "/", -1), lambda p: F.try_element_at(known, p)), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit("unknown"))


def directories(notes: DataFrame) -> DataFrame:
    """Folders that hold entities, with their number of notes: dir, n_files.

    A first-level folder counts where notes lie directly in it, and every folder of the second level with a note
    anywhere below.  Hidden folders are left out.  Where none is found, every folder with notes counts.
    """
    parts = F.slice(F.split("rel_path", "/", -1), F.lit(1), F.size(F.split("rel_path", "/", -1)) - 1)
    p = notes.select(parts.alias("p")).filter(~F.exists("p", lambda x: F.startswith(x, F.lit(".")))).filter(F.size("p") > 0)
    first = p.filter(F.size("p") == 1).select(F.col("p")[0].alias("dir"))
    second = p.filter(F.size("p") >= 2).select(F.concat_ws("/", F.slice("p", 1, 2)).alias("dir"))
    return first.unionByName(second).groupBy("dir").agg(F.count("*").alias("n_files"))


def load_entities(notes: DataFrame, dirs: DataFrame | None = None) -> DataFrame:
    """One row for each stem, the first by folder and path: id, slug, name, rel_path, content, size_bytes."""
    rows = notes.select(t.stem(F.col("file_name")).alias("id"), "rel_path", F.col("raw").alias("content"), "size_bytes")
    if dirs is not None:
        parts = F.split("rel_path", "/", -1)
        above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))  # all folders of a note
        inside = rows.select("rel_path", F.explode(F.when(F.size(parts) > 1, above)).alias("dir")).join(dirs.select("dir"), "dir", "left_semi").select("rel_path").distinct()
        rows = rows.join(inside, "rel_path", "left_semi")
    order = Window.partitionBy("id").orderBy("rel_path")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(
        "id", t.slug(F.col("id")).alias("slug"), F.translate("id", "_-", "  ").alias("name"), "rel_path", "content", "size_bytes")


def read_article(spark: SparkSession, path: str) -> DataFrame:
    """One row with the whole text in article_text."""
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r\n?", "\n").alias("article_text"))


OPPORTUNITY = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("opportunity_id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("urgency_score", T.DoubleType()), T.StructField("feasibility_score", T.DoubleType()),
    T.StructField("required_missing_nodes", T.ArrayType(T.StringType())),
    T.StructField("capital_flow", T.StructType([T.StructField("beneficiary", T.StringType()), T.StructField("likely_funder", T.StringType())])),
    T.StructField("justification", T.StringType()),
])


def opportunities(dashboards: DataFrame, json_col: str = "value", keep: list[str] | None = None) -> DataFrame:
    """One row for each opportunity of dashboard texts, in order (pos): a list, the first list under opportunities,
    data, results or items, or else the object itself.  Columns named in ``keep`` go along."""
    body = F.col(json_col)
    listed = T.ArrayType(OPPORTUNITY)
    under = [F.when(F.get_json_object(body, f"$.{k}").startswith("["), F.from_json(F.get_json_object(body, f"$.{k}"), listed)) for k in ("opportunities", "data", "results", "items")]
    whole = F.when(F.ltrim(body).startswith("["), F.from_json(body, listed))
    kept = keep or []
    return dashboards.select(*kept, F.posexplode(F.coalesce(whole, *under, F.array(F.from_json(body, OPPORTUNITY)))).alias("pos", "o")).select(*kept, "pos", "o.*")


def select_opportunity(rows: DataFrame, opportunity_id: str) -> DataFrame:
    """The first opportunity of this id or opportunity_id; an error where there is none."""
    got = rows.filter((F.col("id") == opportunity_id) | (F.col("opportunity_id") == opportunity_id)).orderBy("pos").limit(1)
    if got.isEmpty():
        raise ValueError(f"no opportunity {opportunity_id!r}")
    return got
