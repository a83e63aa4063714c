"""Domain relations derived from the driver's parquet tables.

Each builder has a SQL twin in ``CTE``; both read whole tables.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells on a jittered lattice 40 wide, one per customer."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("cell_id"),
        ((k % 40) + (k * 7919 % 997) / F.lit(997.0)).alias("x"),
        (F.floor(k / 40) + (k * 104729 % 991) / F.lit(991.0)).alias("y"),
        F.col("c_mktsegment").alias("cell_type"),
        F.concat(F.lit("niche_"), (F.col("c_nationkey") % 5).cast("string")).alias("niche"),
        (F.lit(20.0) + F.abs("c_acctbal") / 100).alias("cell_area"),
        ((k * 31 % 101) / F.lit(100.0)).alias("conf"),
    )


def points(spark: SparkSession, d: str) -> DataFrame:
    """Embedding coordinates 1 and 2 as an irregular point cloud."""
    e = F.col("embedding")
    return table(spark, d, "embeddings").select(
        F.col("vec_id").alias("cell_id"), (e[0].cast("double") * 100).alias("x"),
        (e[1].cast("double") * 100).alias("y"), F.concat(F.lit("type_"), F.col("label").cast("string")).alias("cell_type"))


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, tuple[str, ...]]:
    """Whole embeddings with one column for each dimension, and the names of those columns."""
    e = table(spark, d, "embeddings").where(F.col("embedding").isNotNull())
    n = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    dims = tuple(f"e{i}" for i in range(n))
    return e.select(F.col("vec_id").alias("cell_id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(dims)]), dims


TASK_ROWS = 1_000_000  # line items of one task of a join; without it a task grows with the table


def _counts(spark: SparkSession, d: str, gene) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cell_id"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), gene.alias("gene"))
    n = li.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / TASK_ROWS))
    deal = lambda t, key: t.repartition(tasks, key) if n > TASK_ROWS else t
    return (deal(deal(li, "l_orderkey").join(o, "l_orderkey"), "l_partkey").join(p, "l_partkey").groupBy("cell_id", "gene")
            .agg(F.count(F.lit(1)).cast("double").alias("value")))


def expr(spark: SparkSession, d: str) -> DataFrame:
    """Sparse counts: customers x part brands (25 genes)."""
    return _counts(spark, d, F.col("p_brand"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    """Sparse counts: customers x brand-and-type (150 genes)."""
    return _counts(spark, d, F.concat(F.col("p_brand"), F.lit("-"), F.col("p_type")))


def genes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_brand").alias("gene")).distinct()


def lr(spark: SparkSession, d: str) -> DataFrame:
    """Ligand-receptor pairs: brand b with brand b+1 (cyclic), 5 pathways."""
    b = F.regexp_extract("gene", r"(\d+)", 1).cast("int")
    g = genes(spark, d).select("gene", b.alias("b"))
    return g.select(F.col("gene").alias("ligand"),
                    F.concat(F.lit("Brand#"), (F.col("b") % 25 + 1).cast("string")).alias("receptor"),
                    F.concat(F.lit("PW"), (F.col("b") % 5).cast("string")).alias("pathway_name"),
                    F.when(F.col("b") % 3 == 0, "Secreted Signaling").otherwise("Cell-Cell Contact").alias("signaling_type"))


def transcripts(spark: SparkSession, d: str) -> DataFrame:
    """Transcript points, one per line item."""
    return table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / F.lit(2000.0)).alias("y"),
        F.concat("l_returnflag", "l_linestatus").alias("feature_name"),
        (F.col("l_discount") * F.lit(500.0)).alias("qv"), (F.col("l_linestatus") == "F").alias("is_gene"),
        F.col("l_suppkey").alias("cell_id"), F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"))


# fixed shape of the demonstration outlines: unit hexagon vertices
HEX = [(1.0, 0.0), (0.5, 0.75), (-0.5, 0.75), (-1.0, 0.0), (-0.5, -0.75), (0.5, -0.75)]


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """One hexagon per supplier on a lattice of pitch 5 (10 across); later ids overlap earlier rows."""
    k = F.col("s_suppkey")
    cx = (k % 10) * 5.0 + 2.5
    cy = (F.floor(k / 10) % 10) * 5.0 + 2.5
    r = F.lit(1.5) + (k * 37 % 20) / F.lit(10.0)
    ring = F.array(*[F.struct((cx + F.lit(a) * r).alias("x"), (cy + F.lit(b) * r).alias("y")) for a, b in HEX])
    return table(spark, d, "supplier").select((k + 1).alias("cell_id"), ring.alias("ring"), cx.alias("ox"), cy.alias("oy"), r.alias("r"))


def raster(spark: SparkSession, d: str, dx: int = 0, dy: int = 0, keep: int = 1) -> DataFrame:
    """Label raster (y, x, label): one disc of pixels per supplier on a pitch of 12."""
    k = F.col("s_suppkey")
    s = table(spark, d, "supplier").where(k % keep == 0).select(
        (k + 1).cast("int").alias("label"), ((k % 10) * 12 + 6 + dx).cast("int").alias("cx"),
        (F.floor(k / 10) * 12 + 6 + dy).cast("int").alias("cy"), (k * 7 % 4 + 2).cast("int").alias("r"))
    px = (s.withColumn("i", F.explode(F.sequence(-F.col("r"), F.col("r"))))
          .withColumn("j", F.explode(F.sequence(-F.col("r"), F.col("r"))))
          .where(F.col("i") * F.col("i") + F.col("j") * F.col("j") <= F.col("r") * F.col("r")))
    return px.select((F.col("cy") + F.col("j")).cast("int").alias("y"), (F.col("cx") + F.col("i")).cast("int").alias("x"), "label")


def pvalues(spark: SparkSession, d: str) -> DataFrame:
    """One p-value in (0, 1) per part."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("gene"), ((k * 7919 % 100003 + 1) / F.lit(100003.0) * ((k * 31 % 97 + 1) / F.lit(97.0))).alias("p"))


def bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap distances: boot_id -1 is the observation, gene = user, distance = value."""
    e = table(spark, d, "events")
    return e.select((F.col("event_id") % 20 - 1).alias("boot_id"), F.concat(F.lit("g"), F.col("user_id").cast("string")).alias("gene"),
                    F.col("value").alias("distance"))


def umap(spark: SparkSession, d: str) -> DataFrame:
    """Embedding plane with labels and a confidence for consensus relabelling."""
    return points(spark, d).withColumn("conf", (F.col("cell_id") * 37 % 100) / F.lit(100.0))


CTE = {
    "cells": """cells AS (SELECT c_custkey AS cell_id,
        (c_custkey % 40) + CAST(c_custkey * 7919 % 997 AS DOUBLE) / 997::DOUBLE AS x,
        (c_custkey // 40) + CAST(c_custkey * 104729 % 991 AS DOUBLE) / 991::DOUBLE AS y,
        c_mktsegment AS cell_type, 'niche_' || (c_nationkey % 5) AS niche,
        20::DOUBLE + abs(c_acctbal) / 100::DOUBLE AS cell_area,
        CAST(c_custkey * 31 % 101 AS DOUBLE) / 100::DOUBLE AS conf FROM customer)""",
    "points": """points AS (SELECT vec_id AS cell_id, embedding[1]::DOUBLE * 100::DOUBLE AS x,
        embedding[2]::DOUBLE * 100::DOUBLE AS y, 'type_' || label AS cell_type FROM embeddings)""",
    "umap": """umap AS (SELECT vec_id AS cell_id, embedding[1]::DOUBLE * 100::DOUBLE AS x,
        embedding[2]::DOUBLE * 100::DOUBLE AS y, 'type_' || label AS cell_type,
        CAST(vec_id * 37 % 100 AS DOUBLE) / 100::DOUBLE AS conf FROM embeddings)""",
    "expr": """expr AS (SELECT o_custkey AS cell_id, p_brand AS gene, count(*)::DOUBLE AS value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "panel": """panel AS (SELECT o_custkey AS cell_id, p_brand || '-' || p_type AS gene, count(*)::DOUBLE AS value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "genes": "genes AS (SELECT DISTINCT p_brand AS gene FROM part)",
    "lr": """lr AS (SELECT gene AS ligand, 'Brand#' || (b % 25 + 1) AS receptor, 'PW' || (b % 5) AS pathway_name,
        CASE WHEN b % 3 = 0 THEN 'Secreted Signaling' ELSE 'Cell-Cell Contact' END AS signaling_type
        FROM (SELECT DISTINCT p_brand AS gene, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS b FROM part))""",
    "transcripts": """transcripts AS (SELECT l_quantity AS x, l_extendedprice / 2000::DOUBLE AS y,
        l_returnflag || l_linestatus AS feature_name, l_discount * 500::DOUBLE AS qv, l_linestatus = 'F' AS is_gene,
        l_suppkey AS cell_id, l_orderkey AS order_id, l_linenumber AS line_no FROM lineitem)""",
    "shapes": """shapes AS (SELECT s_suppkey + 1 AS cell_id, (s_suppkey % 10) * 5::DOUBLE + 2.5::DOUBLE AS ox,
        ((s_suppkey // 10) % 10) * 5::DOUBLE + 2.5::DOUBLE AS oy,
        1.5::DOUBLE + CAST(s_suppkey * 37 % 20 AS DOUBLE) / 10::DOUBLE AS r FROM supplier)""",
    "raster": """raster AS (SELECT CAST(cy + j AS INT) AS y, CAST(cx + i AS INT) AS x, label FROM (
        SELECT CAST(s_suppkey + 1 AS INT) AS label, (s_suppkey % 10) * 12 + 6 AS cx, (s_suppkey // 10) * 12 + 6 AS cy,
        s_suppkey * 7 % 4 + 2 AS r FROM supplier) s, range(-5, 6) a(i), range(-5, 6) b(j)
        WHERE i * i + j * j <= r * r)""",
    "seam": """seam AS (SELECT CAST(cy + j AS INT) AS y, CAST(cx + i AS INT) AS x, label FROM (
        SELECT CAST(s_suppkey + 1 AS INT) AS label, (s_suppkey % 10) * 12 + 6 + 1 AS cx, (s_suppkey // 10) * 12 + 6 + 2 AS cy,
        s_suppkey * 7 % 4 + 2 AS r FROM supplier WHERE s_suppkey % 3 = 0) s, range(-5, 6) a(i), range(-5, 6) b(j)
        WHERE i * i + j * j <= r * r)""",
    "pvalues": """pvalues AS (SELECT p_partkey AS gene, CAST(p_partkey * 7919 % 100003 + 1 AS DOUBLE) / 100003::DOUBLE
        * (CAST(p_partkey * 31 % 97 + 1 AS DOUBLE) / 97::DOUBLE) AS p FROM part)""",
    "bootstrap": """bootstrap AS (SELECT event_id % 20 - 1 AS boot_id, 'g' || user_id AS gene, value AS distance FROM events)""",
}


def seam(spark: SparkSession, d: str) -> DataFrame:
    """A second label layer: every third disc, moved by (1, 2) pixels."""
    return raster(spark, d, dx=1, dy=2, keep=3)
