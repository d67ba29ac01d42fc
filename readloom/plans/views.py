"""Alignment records played by the driver's tables, in Spark and (as common table expressions) in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READ, WINDOW = 32, 128


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt over all cores by ``key``: a file of narrow rows has few splits, and what is made of a row here is many times its size."""
    s = rows.sparkSession
    return rows.repartition(max(int(s.conf.get("spark.sql.shuffle.partitions")), 2 * s.sparkContext.defaultParallelism), key)


def parted(rows: DataFrame, key: str, mb: float = 4) -> DataFrame:
    """Rows dealt by ``key`` into parts of about ``mb`` of their files, so that what a task sorts does not grow with the input."""
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / mb / 2**20)), key)


def dna(key: F.Column) -> F.Column:
    return F.translate(F.md5(key), "0123456789abcdef", "ACGTACGTACGTACGT")


def templates(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("tag"))


def maps(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("tag"), F.col("l_returnflag").alias("seq_name"),
        F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand"), F.col("l_partkey").alias("position"),
        F.col("l_linenumber").alias("event_distance"), F.col("l_quantity").cast("int").alias("phred"),
        F.col("l_suppkey").alias("length"), F.col("l_extendedprice").alias("score"),
    )


def maps_b(spark: SparkSession, d: str) -> DataFrame:
    m = maps(spark, d).where("event_distance <= 5")
    return m.withColumn("position", F.col("position") + F.col("length") % 3)


def end1(spark: SparkSession, d: str) -> DataFrame:
    return maps(spark, d).where("event_distance % 2 = 1")


def end2(spark: SparkSession, d: str) -> DataFrame:
    return maps(spark, d).where("event_distance % 2 = 0")


def reads(spark: SparkSession, d: str) -> DataFrame:
    """(tag, read, qualities): 32-mers of customers."""
    key = F.col("c_custkey").cast("string")
    return spread(load(spark, d, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("tag"), dna(key).alias("read"), F.md5(F.concat(F.lit("q"), key)).alias("qualities"))


def part_text() -> F.Column:
    k = F.col("p_partkey").cast("string")
    return F.concat(*[dna(F.concat(F.lit(f"r{i}_"), k)) for i in range(4)])


def ref(spark: SparkSession, d: str) -> DataFrame:
    """(seq_name, text): 128-mers of parts. The files tell nothing of the size of the texts, so the table is never broadcast by its estimate."""
    rows = spread(load(spark, d, "part").select("p_partkey"), "p_partkey")
    return rows.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("seq_name"), part_text().alias("text")).hint("merge")


def planted_reads(spark: SparkSession, d: str) -> DataFrame:
    """(tag, read): windows of the reference at the suppliers' places, with s_suppkey % 3 substitutions."""
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("tag"))
    at = (F.col("tag") * 7 % 90 + 1).cast("int")
    parts = load(spark, d, "part").select("p_partkey").hint("merge")
    w = spread(s.join(parts, F.col("tag") == F.col("p_partkey")), "tag").withColumn("w", F.substring(part_text(), at, F.lit(READ)))
    flip = lambda c, i: F.concat(F.substring(c, 1, i - 1), F.translate(F.substring(c, i, 1), "ACGT", "CATG"), F.substring(c, i + 1, READ))
    r = F.when(F.col("tag") % 3 > 0, flip(F.col("w"), 5)).otherwise(F.col("w"))
    r = F.when(F.col("tag") % 3 > 1, flip(r, 20)).otherwise(r)
    return w.select("tag", r.alias("read"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "labels")


SQL = {
    "templates": "SELECT o_orderkey AS tag FROM orders",
    "maps": "SELECT l_orderkey AS tag, l_returnflag AS seq_name, CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand, l_partkey AS position,"
    " l_linenumber AS event_distance, CAST(l_quantity AS INT) AS phred, l_suppkey AS length, l_extendedprice AS score FROM lineitem",
    "maps_b": "SELECT tag, seq_name, strand, position + length % 3 AS position, event_distance, phred, length, score FROM maps WHERE event_distance <= 5",
    "end1": "SELECT * FROM maps WHERE event_distance % 2 = 1",
    "end2": "SELECT * FROM maps WHERE event_distance % 2 = 0",
    "reads": "SELECT c_custkey AS tag, translate(md5(c_custkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT') AS read, md5('q' || c_custkey) AS qualities FROM customer",
    "ref": "SELECT 'p' || p_partkey AS seq_name, " + " || ".join(f"translate(md5('r{i}_' || p_partkey), '0123456789abcdef', 'ACGTACGTACGTACGT')" for i in range(4)) + " AS text FROM part",
    "planted": "SELECT s_suppkey AS tag, substr(text, (s_suppkey * 7 % 90 + 1)::INT, 32) AS w FROM supplier JOIN ref ON seq_name = 'p' || s_suppkey",
    "planted5": "SELECT tag, CASE WHEN tag % 3 > 0 THEN substr(w, 1, 4) || translate(substr(w, 5, 1), 'ACGT', 'CATG') || substr(w, 6) ELSE w END AS w FROM planted",
    "planted_reads": "SELECT tag, CASE WHEN tag % 3 > 1 THEN substr(w, 1, 19) || translate(substr(w, 20, 1), 'ACGT', 'CATG') || substr(w, 21) ELSE w END AS read FROM planted5",
}
NEEDS = {"maps_b": ["maps"], "end1": ["maps"], "end2": ["maps"], "planted": ["ref"], "planted5": ["ref", "planted"], "planted_reads": ["ref", "planted", "planted5"]}


def sql(query: str, *views: str) -> str:
    """``query`` with the views that it names as common table expressions."""
    names: list[str] = []
    for v in views:
        names += [n for n in (*NEEDS.get(v, ()), v) if n not in names]
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    if query.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {query[15:]}"
    if query.lstrip().upper().startswith("WITH "):
        return f"WITH {head}, {query.lstrip()[5:]}" if head else query
    return f"WITH {head} {query}" if head else query
