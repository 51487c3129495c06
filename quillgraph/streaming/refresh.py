"""Notes as a stream: new and changed files are parsed as they arrive and merged into the node table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as t
from ..operators import parse
from ..sources import notes
from .live import Change, LiveGraph

_FILES = "path string, modificationTime timestamp, length long, content binary"


def note_stream(spark: SparkSession, root: str) -> DataFrame:
    """The columns of sources.notes.read_notes() for every .md file that appears below root."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    path = t.url_unquote(F.col("path"))
    rel = F.regexp_replace(F.substring_index(path, root.rstrip("/").removeprefix("file://"), -1), "^/+", "")
    return files.select(rel.alias("rel_path"), t.last_segment(rel).alias("file_name"), F.regexp_replace(F.try_validate_utf8(F.col("content").cast("string")), "\r\n?", "\n").alias("raw"),
                        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime")).filter(F.col("raw").isNotNull())


def refresh(spark: SparkSession, root: str, checkpoint: str, merge: Callable[[DataFrame, int], None], profile: str = "query") -> StreamingQuery:
    """Start a query that hands the parsed nodes of every batch of files to ``merge`` (nodes, batch number), all files
    that are there now, then stops.  The checkpoint makes a restart go on where the last one ended."""
    return note_stream(spark, root).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda batch, number: merge(parse.nodes(batch, profile), number)).start()


def refresh_live(spark: SparkSession, root: str, live: LiveGraph) -> Change:
    """Bring a live graph to the notes below root as they are now: new, changed, moved and deleted ones.  Texts are read
    for new and changed notes alone."""
    return live.update(notes.list_notes(spark, root), notes.read_some(spark, root))


def follow(spark: SparkSession, root: str, checkpoint: str, live: LiveGraph) -> StreamingQuery:
    """A stream that refreshes the live graph with every batch of new files, all that are there now, then stops.

    Deletions alone start no batch; refresh_live() takes them up, and so does the next batch.
    """
    return note_stream(spark, root).select("rel_path").writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda batch, number: refresh_live(spark, root, live) and None).start()
