"""Notes rendered from the driver's tables, so that the whole path from text to graph runs over them.

The notes are parsed back from their text; oracles compute the same answers from the relational columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _note(folder: str, name: Column, raw: Column) -> list[Column]:
    file_name = F.concat(name, F.lit(".md"))
    return [F.concat(F.lit(f"{folder}/"), file_name).alias("rel_path"), file_name.alias("file_name"), raw.alias("raw"),
            F.octet_length(raw).cast("long").alias("size_bytes"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("mtime")]


def table_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note for each region, nation, supplier and customer, in the columns of read_notes().

    A customer links to its nation and region, every tenth to a nation that does not exist, every fiftieth to itself,
    every seventh to its nation once more in another spelling.  A supplier links to its nation, every fifth to a
    group without a note.
    """
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    region, nation = read("region"), read("nation")
    places = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    customer, supplier = read("customer").repartition(spark.sparkContext.defaultParallelism), read("supplier")  # texts are rendered and parsed in as many tasks
    name = F.col("c_name")
    link = lambda c, *more: F.concat(F.lit("[["), c, *more, F.lit("]] "))
    every = lambda key, k, c: F.when(F.col(key) % k == 0, c).otherwise("")
    of_customer = F.concat(
        F.lit("---\nname: "), name, F.lit("\nsector: "), "c_mktsegment", F.lit("\nentity_type: company\n---\n# Summary\nA customer in "), "n_name", F.lit(".\n\n## Links\nIn "),
        link(F.col("n_name"), F.lit("|nation")), link(F.lit("x/y/"), F.col("r_name")), every("c_custkey", 7, link(F.lit("nation-"), F.col("n_nationkey").cast("string"))),
        every("c_custkey", 10, link(F.lit("NATION_99"))), every("c_custkey", 50, link(name)), F.lit("\n"))
    of_supplier = F.concat(F.lit("---\ndescription: Supplies "), "n_name", F.lit("\nlocation: "), "n_name", F.lit("\n---\nA supplier of "), link(F.col("n_name")),
                           every("s_suppkey", 5, link(F.lit("Supplier Group"))), F.lit("\n"))
    of_nation = F.concat(F.lit("---\nnode_type: nation\ncountry: "), "n_name", F.lit("\n---\nPart of "), link(F.col("r_name")))
    of_region = F.concat(F.lit("No header here, only "), "r_name", F.lit(" as a commodity of copper."))
    return (
        customer.join(places, customer["c_nationkey"] == places["n_nationkey"]).select(*_note("Companies", name, of_customer))
        .unionByName(supplier.join(places, supplier["s_nationkey"] == places["n_nationkey"]).select(*_note("Agencies", F.col("s_name"), of_supplier)))
        .unionByName(places.select(*_note("Places/Nations", F.col("n_name"), of_nation))).unionByName(region.select(*_note("Region", F.col("r_name"), of_region))))


#: The same notes as relations, for oracles: place, note (uid, summary, entity_type, ...) and edge.
RELATIONS = """
    place AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
    note AS (
        SELECT c_name AS uid, 'A customer in ' || n_name || '.' AS summary, 'company' AS entity_type, '' AS country, c_mktsegment AS sector, 'business' AS folder_type
        FROM customer JOIN place ON c_nationkey = n_nationkey
        UNION ALL SELECT s_name, 'Supplies ' || n_name, '', n_name, '', 'government' FROM supplier JOIN place ON s_nationkey = n_nationkey
        UNION ALL SELECT n_name, 'Part of [[' || r_name || ']]', 'nation', n_name, '', 'unknown' FROM place
        UNION ALL SELECT r_name, 'No header here, only ' || r_name || ' as a commodity of copper.', 'commodity', '', '', 'region' FROM region),
    written AS (
        SELECT c_name AS src, 0 AS pos, n_name AS raw FROM customer JOIN place ON c_nationkey = n_nationkey
        UNION ALL SELECT c_name, 1, r_name FROM customer JOIN place ON c_nationkey = n_nationkey
        UNION ALL SELECT c_name, 2, 'nation-' || c_nationkey FROM customer WHERE c_custkey % 7 = 0
        UNION ALL SELECT c_name, 2 + CAST(c_custkey % 7 = 0 AS INTEGER), 'NATION_99' FROM customer WHERE c_custkey % 10 = 0
        UNION ALL SELECT c_name, 3 + CAST(c_custkey % 7 = 0 AS INTEGER), c_name FROM customer WHERE c_custkey % 50 = 0
        UNION ALL SELECT s_name, 0, n_name FROM supplier JOIN place ON s_nationkey = n_nationkey
        UNION ALL SELECT s_name, 1, 'Supplier Group' FROM supplier WHERE s_suppkey % 5 = 0
        UNION ALL SELECT n_name, 0, r_name FROM place),
    edge AS (SELECT src, pos, raw, raw AS dst, raw NOT IN ('NATION_99', 'Supplier Group') AS resolved FROM written WHERE raw NOT LIKE 'nation-%')"""
