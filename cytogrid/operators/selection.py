"""Selecting genes: rank tests of all groups, variable-gene flavours, stabilised residuals, knees of curves, aggregated ranks.

Expression is sparse (cell, gene, value); absent rows are zeros.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import comb

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytogrid.functions.special import two_sided
from cytogrid.operators.expression import gene_moments
from cytogrid.operators.multitest import adjust
from cytogrid.operators.ordering import OrderedBlocks, exact_quantiles, global_rank, value_ranks


def rank_sum_all_groups(expr: DataFrame, cells: DataFrame, cell: str = "cell_id", label: str = "cell_type") -> DataFrame:
    """Every group against the rest in one pass: rank_sum, z, two-sided p and BH-adjusted p per group.

    Average ranks with tie correction over all cells; the zeros of a gene are one
    tie. Stored values are counted by (gene, value) before they are ordered, and
    ranks are summed once per (group, gene). Groups without a rest, and genes of
    one value, have z = 0 and p = 1.
    """
    g = F.col(label).alias("group")
    v = F.col("value").cast("double")
    counts = expr.where(v != 0).join(cells.select(cell, g), cell).groupBy("group", "gene", v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    size = cells.groupBy(g).agg(F.count(F.lit(1)).alias("n_in"))
    total = cells.agg(F.count(F.lit(1)).alias("n_all"))
    stored = counts.groupBy("gene", "v").agg(F.sum("n").alias("n"))
    zeros = (stored.groupBy("gene").agg(F.sum("n").alias("_s")).crossJoin(F.broadcast(total))  # one row
             .select("gene", F.lit(0.0).alias("v"), (F.col("n_all") - F.col("_s")).alias("n")).where("n > 0"))
    ranked = OrderedBlocks(stored.unionByName(zeros), ["v"], ["gene"]).running("upto", "sum", "n").df
    t = F.col("n").cast("double")
    ranked = ranked.select("gene", "v", (F.col("upto") - F.col("n") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"), (t * t * t - t).alias("tie"))
    per_gene = ranked.groupBy("gene").agg(F.sum("tie").alias("ties"), F.coalesce(F.max(F.when(F.col("v") == 0, F.col("rank"))), F.lit(0.0)).alias("zero_rank"))
    sums = counts.join(ranked.select("gene", "v", "rank"), ["gene", "v"]).groupBy("group", "gene").agg(F.sum(F.col("n") * F.col("rank")).alias("w"), F.sum("n").alias("seen"))
    table = size.crossJoin(per_gene).crossJoin(F.broadcast(total))  # groups x genes: the table itself, and one row
    j = table.join(sums, ["group", "gene"], "left").fillna(0, ["w", "seen"])
    n1, n = F.col("n_in").cast("double"), F.col("n_all").cast("double")
    w = F.col("w") + (F.col("n_in") - F.col("seen")) * F.col("zero_rank")
    var = F.coalesce(n1 * (n - n1) / 12.0 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1))), F.lit(0.0))
    z = F.when(var > 1e-9, (w - n1 * (n + 1) / 2.0) / F.sqrt(var)).otherwise(0.0)
    tested = j.select("group", "gene", w.alias("rank_sum"), z.alias("z")).withColumn("p", F.when(F.col("z") == 0, 1.0).otherwise(two_sided(F.col("z"))))
    return adjust(tested, "bh", by=("group",))


def variable_by_mean_sd(expr: DataFrame, cells: DataFrame, n_bins: int = 20, top: int | None = None) -> DataFrame:
    """gene, bin, dispersion, score, rank of log-normalised data: log dispersion, standardised in bins of equal width of log mean.

    Values go back to counts by exp(x) - 1. A bin of one gene gives the score 1; genes without dispersion have a null score and come last.
    """
    raw = expr.withColumn("value", F.expm1(F.col("value").cast("double")))
    m = gene_moments(raw, cells.agg(F.count(F.lit(1)).alias("n"))).select("gene", F.log1p(F.greatest("mean", F.lit(1e-12))).alias("mean"), F.log(F.when(F.col("var_samp") > 0, F.col("var_samp") / F.greatest("mean", F.lit(1e-12)))).alias("dispersion"))
    ends = m.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    share = F.coalesce(F.try_divide(F.col("mean") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))
    b = m.crossJoin(F.broadcast(ends)).withColumn("bin", F.greatest(F.lit(0), F.ceil(F.round(share * n_bins, 9)) - 1).cast("int")).drop("lo", "hi")  # one row
    s = b.groupBy("bin").agg(F.avg("dispersion").alias("_m"), F.stddev_samp("dispersion").alias("_s"), F.count("dispersion").alias("_n"))
    score = F.when(F.col("_n") == 1, F.lit(1.0) + 0 * F.col("dispersion")).otherwise(F.try_divide(F.col("dispersion") - F.col("_m"), F.col("_s")))
    return _ranked(b.join(s, "bin").withColumn("score", score).drop("_m", "_s", "_n"), top)


def variable_by_median_mad(expr: DataFrame, cells: DataFrame, top: int | None = None) -> DataFrame:
    """gene, bin, dispersion, score, rank: dispersion var / mean less the bin's median, over its scaled median absolute deviation.

    Bins end at the 10th, 15th, ... 100th percentile of the means. A bin without spread gives a null score, and such genes come last.
    """
    m = gene_moments(expr, cells.agg(F.count(F.lit(1)).alias("n"))).select("gene", "mean", (F.col("var_samp") / F.col("mean")).alias("dispersion")).where("mean > 0")
    cuts = exact_quantiles(m, "mean", {f"q{p}": p / 100 for p in range(10, 101, 5)})
    below = sum((F.round("mean", 12) > F.round(f"q{p}", 12)).cast("int") for p in range(10, 101, 5))
    b = m.crossJoin(F.broadcast(cuts)).select("gene", "mean", "dispersion", below.alias("bin"))  # one row
    middle = exact_quantiles(b, "dispersion", {"_m": 0.5}, by=("bin",))
    away = b.join(middle, "bin").withColumn("_d", F.abs(F.col("dispersion") - F.col("_m")))
    spread = exact_quantiles(away, "_d", {"_s": 0.5}, by=("bin",))
    # fixed value: the third quartile of the standard normal distribution
    score = F.try_divide((F.col("dispersion") - F.col("_m")) * 0.6744897501960817, F.col("_s"))
    return _ranked(away.join(spread, "bin").withColumn("score", score).drop("_m", "_s", "_d"), top)


def _ranked(rows: DataFrame, top: int | None) -> DataFrame:
    ranked = global_rank(rows.withColumn("_k", F.round("score", 9)), [F.col("_k").desc_nulls_last(), F.asc("gene")], "rank").drop("_k")
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def stabilised_residuals(expr: DataFrame, cell: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """Variance-stabilised counts less their regression on log(total): stored entries (cell, gene, residual), and per gene slope and base.

    The negative-binomial dispersion phi is the least-squares fit of var = mean + phi * mean^2 over genes, the
    stabilised value log(count + 1 / (2 phi)). Regressions are over all cells with counts; a
    zero of a gene has the residual base - slope * log(total), so zeros need no rows.
    """
    v = F.col("value").cast("double")
    tot = expr.groupBy(cell).agg(F.log(F.sum(v)).alias("_x")).where(F.col("_x").isNotNull())
    n = tot.agg(F.count(F.lit(1)).alias("n"), F.sum("_x").alias("sx"), F.sum(F.col("_x") * F.col("_x")).alias("sxx"))
    moments = gene_moments(expr, n.select("n"))
    phi = moments.agg(F.try_divide(F.sum(F.pow("mean", F.lit(2)) * (F.col("var_samp") - F.col("mean"))), F.sum(F.pow("mean", F.lit(4)))).alias("phi"))
    one = n.crossJoin(phi).withColumn("add", 1 / (2 * F.col("phi"))).withColumn("base", F.log("add"))  # one row each
    logs = expr.where(v != 0).join(tot, cell).crossJoin(F.broadcast(one)).withColumn("_y", F.log(v + F.col("add")))
    sums = logs.groupBy("gene").agg(F.sum("_y").alias("sy"), F.sum(F.col("_y") * F.col("_x")).alias("sxy"), F.count(F.lit(1)).alias("k"), F.sum("_x").alias("kx"))
    fit = sums.crossJoin(F.broadcast(one))
    sy = F.col("sy") + (F.col("n") - F.col("k")) * F.col("base")
    sxy = F.col("sxy") + F.col("base") * (F.col("sx") - F.col("kx"))
    slope = F.coalesce(F.try_divide(F.col("n") * sxy - F.col("sx") * sy, F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")), F.lit(0.0))
    genes = fit.select("gene", slope.alias("slope"), "base")
    return logs.drop("base").join(genes, "gene").select(cell, "gene", (F.col("_y") - F.col("slope") * F.col("_x")).alias("residual")), genes


def knee(curve: DataFrame, x: str, y: str, direction: str = "increasing", shape: str = "concave", sensitivity: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """The x of the knee of each curve (null without one), by the normalised difference curve.

    The curve, turned so that it rises and bends down, is scaled to the unit square; its
    height over the diagonal has local maxima. The first maximum after which the height falls below its value
    less ``sensitivity`` mean steps of x, before a local minimum, is the knee. Points of
    equal height are both maxima and minima, which start no search. A curve is one group of
    a window; x must be distinct within a curve.
    """
    part = list(by) or [F.lit(0)]
    whole = W.partitionBy(*part)
    scaled = lambda c: F.coalesce(F.try_divide(c - F.min(c).over(whole), F.max(c).over(whole) - F.min(c).over(whole)), F.lit(0.0))
    p = curve.select(*by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    p = p.withColumn("u", scaled(F.col("x"))).withColumn("w", scaled(F.col("y")))
    back = (direction == "decreasing") == (shape == "concave")  # read from the right
    if back:
        p = p.withColumn("u", 1 - F.col("u"))
    if shape == "convex":
        p = p.withColumn("w", 1 - F.col("w"))
    order = W.partitionBy(*part).orderBy("u")
    p = p.withColumn("d", F.round(F.col("w") - F.col("u"), 12))
    prior, after = F.coalesce(F.lag("d").over(order), F.col("d")), F.coalesce(F.lead("d").over(order), F.col("d"))
    step = 1 / (F.count(F.lit(1)).over(whole) - 1)
    high, low = (F.col("d") >= prior) & (F.col("d") >= after), (F.col("d") <= prior) & (F.col("d") <= after)
    limit = F.when(low, F.struct(F.lit(None).cast("double").alias("t"), F.col("x"))).when(high, F.struct((F.col("d") - sensitivity * step).alias("t"), F.col("x")))
    p = p.withColumn("limit", limit)
    p = p.withColumn("at", F.last("limit", ignorenulls=True).over(order)).withColumn("next", F.lead("d").over(order))
    found = F.min(F.when(F.col("next") < F.col("at.t"), F.struct("u", F.col("at.x").alias("x"))))
    return p.groupBy(*by).agg(found.alias("f")).select(*by, F.col("f.x").alias("knee"))


def aggregated_ranks(rows: DataFrame, keys: Sequence[str], scores: Mapping[str, bool], out: str) -> DataFrame:
    """keys and ``out``: how unlikely a row's ranks in all ``scores`` (True: smaller is better) are to be so good together by chance.

    Ranks (ties averaged) are divided by the number of rows. With m scores, the k-th smallest of a row's ranks r is judged by the probability
    that k or more of m uniform numbers lie below r; the smallest of these times m, at most 1, is the result. Null scores rank last.
    """
    m, table = len(scores), rows.select(*keys, *scores)
    for i, (c, ascending) in enumerate(scores.items()):
        key = F.coalesce(F.round(F.col(c).cast("double"), 12) * (1 if ascending else -1), F.lit(float("inf")))
        table = table.withColumn(f"_v{i}", key)
        ranked = value_ranks(table, f"_v{i}")
        table = table.join(ranked.select(f"_v{i}", ((F.col("n_less") + (F.col("n") + 1) / 2) / F.col("n_total")).alias(f"_r{i}")), f"_v{i}")
    table = table.withColumn("_r", F.array_sort(F.array(*[f"_r{i}" for i in range(m)])))

    def tail(k: int) -> Column:
        r = F.col("_r")[k - 1]
        return sum(comb(m, j) * F.pow(r, F.lit(j)) * F.pow(1 - r, F.lit(m - j)) for j in range(k, m + 1))

    tails = [tail(k) for k in range(1, m + 1)]
    return table.select(*keys, F.least(F.lit(1.0), m * (F.least(*tails) if m > 1 else tails[0])).alias(out))
