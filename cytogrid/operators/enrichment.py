"""Gene-set over-representation and unit overlap."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cytogrid.functions.special import lgamma


def overlap_counts(hits: DataFrame, sets: DataFrame, universe: DataFrame, gene: str = "gene", term: str = "term") -> DataFrame:
    """(term, k hits in the set, m set size, hits, universe), counted inside the universe."""
    u = universe.select(gene).distinct()
    h = hits.select(gene).distinct().join(u, gene, "left_semi").withColumn("_h", F.lit(1))
    s = sets.select(term, gene).distinct().join(u, gene, "left_semi").join(h, gene, "left")
    one = u.agg(F.count(F.lit(1)).alias("universe")).crossJoin(h.agg(F.count(F.lit(1)).alias("hits")))
    return s.groupBy(term).agg(F.coalesce(F.sum("_h"), F.lit(0)).cast("long").alias("k"), F.count(F.lit(1)).alias("m")).crossJoin(F.broadcast(one))  # one row


def hypergeometric_tail(counts: DataFrame) -> DataFrame:
    """P(X >= k): the terms k..min(m, hits) are exploded and summed in log space."""
    top = F.least("m", "hits")
    lc = lambda a, b: lgamma(a + 1.0) - lgamma(b + 1.0) - lgamma(a - b + 1.0)
    t = (counts.withColumn("_i", F.explode(F.sequence(F.greatest("k", F.col("m") + F.col("hits") - F.col("universe")), top)))
         .withColumn("_lp", lc(F.col("m"), F.col("_i")) + lc(F.col("universe") - F.col("m"), F.col("hits") - F.col("_i")) - lc(F.col("universe"), F.col("hits"))))
    return t.groupBy(*counts.columns).agg(F.least(F.sum(F.exp("_lp")), F.lit(1.0)).alias("p"))


def unit_overlap(members: DataFrame, unit: str = "unit", cell: str = "cell_id") -> DataFrame:
    """(unit_a, unit_b, shared) for every pair of units with shared cells.

    Cells are first counted per distinct membership pattern, so the pair
    expansion works on patterns, not on cells.
    """
    pattern = members.select(cell, unit).distinct().groupBy(cell).agg(F.sort_array(F.collect_list(unit)).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    a = pattern.withColumn("unit_a", F.explode("u")).withColumn("unit_b", F.explode("u")).where(F.col("unit_a") < F.col("unit_b"))
    return a.groupBy("unit_a", "unit_b").agg(F.sum("n").alias("shared"))


def overlap_score(members: DataFrame, n_spots: DataFrame, unit: str = "unit", cell: str = "cell_id") -> DataFrame:
    """Mean shared cells over all unit pairs, per spot; 1 when there is no pair. One row."""
    k = members.agg(F.count_distinct(unit).alias("u"))
    s = unit_overlap(members, unit, cell).agg(F.coalesce(F.sum("shared"), F.lit(0)).alias("s"))
    pairs = F.col("u") * (F.col("u") - 1) / 2
    return s.crossJoin(k).crossJoin(n_spots).select(F.when(pairs > 0, F.col("s") / pairs / F.col("n")).otherwise(1.0).alias("score"))


def overlap_partner(members: DataFrame, target: str, unit: str = "unit", cell: str = "cell_id") -> DataFrame:
    """Unit sharing most and fewest cells with ``target`` (zero counts included, ties to the smaller name). One row."""
    t = members.where(F.col(unit) == target).select(cell).distinct()
    hit = members.where(F.col(unit) != target).join(t.withColumn("_t", F.lit(1)), cell, "left").groupBy(unit).agg(F.coalesce(F.sum("_t"), F.lit(0)).cast("long").alias("n"))
    best = hit.agg(F.max("n").alias("max_shared"), F.min("n").alias("min_shared"), F.min_by(unit, F.struct((-F.col("n")).alias("k"), unit)).alias("max_unit"),
                   F.min_by(unit, F.struct("n", unit)).alias("min_unit"))
    return best


def membership_class(df: DataFrame, a: str, b: str) -> DataFrame:
    """only-1 / only-2 / both / blank from two 0/1 columns, counted."""
    c = (F.when((F.col(a) == 1) & (F.col(b) == 1), "both").when(F.col(a) == 1, "only_1").when(F.col(b) == 1, "only_2").otherwise("blank"))
    return df.groupBy(c.alias("class")).agg(F.count(F.lit(1)).alias("n"))


def require_members(genes: DataFrame, known: DataFrame, gene: str = "gene") -> DataFrame:
    """``genes`` if all are known; otherwise the query fails naming how many are not."""
    flag = genes.join(known.select(gene).distinct().withColumn("_k", F.lit(1)), gene, "left")
    return flag.where(F.when(F.col("_k").isNull(), F.raise_error(F.concat(F.lit("unknown gene: "), F.col(gene).cast("string")))).otherwise(F.lit(True))).drop("_k")
