"""Multiple-testing corrections over tables of any length."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cytogrid.operators.ordering import OrderedBlocks, value_ranks


def adjust(df: DataFrame, method: str, p: str = "p", id_col: str = "gene", out: str = "p_adj",
           clip: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """Adjusted p-values.

    ``bonferroni``, ``holm_step`` ((n - rank0) * p as is), ``holm_sidak``,
    ``bh``, ``by`` (Benjamini-Yekutieli) or ``qvalue`` (pi0 from the tail above 0.89, 1 below 100 tests). The step-up
    methods take a running minimum from the largest p down, Holm-Sidak a
    running maximum from the smallest p up. ``by`` corrects within groups.
    """
    order = [F.asc(p), F.asc(id_col)]
    P = F.col(p)
    if method == "bonferroni":
        b = OrderedBlocks(df, order, by).row_number("_r", "_n")
        res = b.df.withColumn(out, F.col("_n") * P)
    elif method == "holm_step":
        b = OrderedBlocks(df, order, by).row_number("_r", "_n")
        res = b.df.withColumn(out, (F.col("_n") - (F.col("_r") - 1)) * P)
    elif method == "holm_sidak":
        b = OrderedBlocks(df, order, by).row_number("_r", "_n")
        b.running(out, "max", 1 - F.pow(1 - P, (F.col("_n") - F.col("_r") + 1).cast("double")))
        res = b.df
    elif method in ("bh", "by", "qvalue"):
        b = OrderedBlocks(df, [F.desc(p), F.desc(id_col)], by).row_number("_d", "_n")
        rank = F.col("_n") - F.col("_d") + 1
        scaled = F.col("_n") / rank * P
        b.running(out, "min", scaled)
        if method == "by":
            b.with_column("_r", rank)
            harmonic = b.df.groupBy(*by).agg(F.sum(1.0 / F.col("_r")).alias("_h"))
            res = b.df.join(harmonic, list(by)) if by else b.df.crossJoin(F.broadcast(harmonic))  # one row
            res = res.withColumn(out, F.col(out) * F.col("_h"))
        elif method == "qvalue":
            tail = b.df.groupBy(*by).agg(F.when(F.max("_n") < 100, 1.0).otherwise(F.least(
                F.lit(1.0), F.sum((P > 0.89).cast("long")) / (F.max("_n") * F.lit(1 - 0.89)))).alias("_h"))
            res = b.df.join(tail, list(by)) if by else b.df.crossJoin(F.broadcast(tail))  # one row
            res = res.withColumn(out, F.col(out) * F.col("_h"))
        else:
            res = b.df
    else:
        raise ValueError(f"unknown method {method!r}")
    if clip:
        res = res.withColumn(out, F.least(F.col(out), F.lit(1.0)))
    return res.drop("_r", "_d", "_n", "_h")


def rank_sum(df: DataFrame, value: str, in_group: str, sizes: DataFrame, by: tuple[str, ...] = ("gene",)) -> DataFrame:
    """Wilcoxon rank-sum z per group with average ranks, tie correction and the implicit zeros.

    ``df`` holds stored values and a boolean ``in_group``; ``sizes`` has per
    group n_in and n_out counting every cell. Stored values are first counted
    per (group, value), so the ordered table is small and ties are exact.
    """
    stored = (df.where(F.col(value) != 0).groupBy(*by, F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_all"), F.sum(F.col(in_group).cast("long")).alias("_in")))
    seen = stored.groupBy(*by).agg(F.sum("_all").alias("_a"), F.sum("_in").alias("_i"))
    zeros = (sizes.join(seen, list(by), "left")
             .select(*by, F.lit(0.0).alias("_v"),
                     (F.col("n_in") + F.col("n_out") - F.coalesce("_a", F.lit(0))).alias("_all"),
                     (F.col("n_in") - F.coalesce("_i", F.lit(0))).alias("_in")).where(F.col("_all") > 0))
    counts = stored.withColumn("_v", F.col("_v").cast("double")).unionByName(zeros)
    b = OrderedBlocks(counts, ["_v"], by).running("_upto", "sum", "_all")
    avg_rank = F.col("_upto") - F.col("_all") + (F.col("_all") + 1) / F.lit(2.0)
    t = F.col("_all").cast("double")
    agg = b.df.groupBy(*by).agg(F.sum(F.col("_in") * avg_rank).alias("_w"), F.sum(t * t * t - t).alias("_ties"))
    n1, n2 = F.col("n_in").cast("double"), F.col("n_out").cast("double")
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - F.col("_ties") / (n * (n - 1)))
    return agg.join(sizes, list(by)).select(
        *by, F.col("_w").alias("rank_sum"),
        F.when(var > 0, (F.col("_w") - n1 * (n + 1) / 2.0) / F.sqrt(var)).otherwise(0.0).alias("z"))
