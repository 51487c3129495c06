"""Writers of results.  A dashboard or roadmap is one small document, written through Spark so that any store works."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def put_text(spark: SparkSession, path: str, text: str) -> str:
    """Write one document to exactly this path of whatever store the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return path


def put_json(spark: SparkSession, path: str, value: object) -> str:
    return put_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False, default=str))


def stamp(spark: SparkSession) -> str:
    return spark.range(1).select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyyMMdd_HHmmss")).first()[0]


def save_dashboard(spark: SparkSession, folder: str, dashboard: dict, prefix: str = "dashboard") -> str:
    return put_json(spark, f"{folder}/{prefix}_{stamp(spark)}.json", dashboard)


def save_query(spark: SparkSession, folder: str, dashboard: dict, graph: dict) -> tuple[str, str]:
    """The dashboard and its graph under one time stamp."""
    at = stamp(spark)
    return put_json(spark, f"{folder}/query_dashboard_{at}.json", dashboard), put_json(spark, f"{folder}/query_graph_{at}.json", graph)


def save_roadmap(spark: SparkSession, folder: str, opportunity_id: str, roadmap: str, graph_text: str, traces: Sequence[dict]) -> list[str]:
    """execution_<id>.md and reasoning_<id>.json; a graph text that is no JSON object goes to a debug file, and the
    JSON then holds the error and the traces."""
    head = f"# Execution Roadmap — {opportunity_id}\n\nOpportunity ID: `{opportunity_id}`\n\n---\n\n"
    paths = [put_text(spark, f"{folder}/execution_{opportunity_id}.md", head + roadmap)]
    try:
        graph = json.loads(graph_text)
        if not isinstance(graph, dict):
            raise ValueError("the graph is no JSON object")
        graph["compiled_lineage_traces"] = list(traces)
    except ValueError as error:
        debug = put_text(spark, f"{folder}/reasoning_{opportunity_id}_DEBUG.log", f"{error}\n\n{graph_text}")
        graph = {"parse_error": str(error), "raw_graph_available_in_debug_log": debug, "compiled_lineage_traces": list(traces), "metrics": {}, "convergence_flow": {}}
        paths.append(debug)
    return [*paths, put_json(spark, f"{folder}/reasoning_{opportunity_id}.json", graph)]


def append_shadow_nodes(shadows: DataFrame, table_path: str) -> None:
    """Add placeholders to a table of their own; the notes themselves are never changed."""
    shadows.write.mode("append").parquet(table_path)
