"""Tables and summaries: crosstabs, describe, top-k, elbow, set votes, reports."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cytogrid.operators.ordering import OrderedBlocks, exact_quantiles, global_rank


def crosstab(df: DataFrame, row: str, col: str) -> DataFrame:
    """(row, col, n, share of row) with zero cells; NULL keys are dropped."""
    clean = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    c = clean.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    rows = c.groupBy(row).agg(F.sum("n").alias("_t"))
    grid = rows.crossJoin(c.select(col).distinct())  # rows x columns: the table itself
    n = F.coalesce("n", F.lit(0))
    return grid.join(c, [row, col], "left").select(row, col, n.alias("n"), (n / F.col("_t")).alias("share"))


def describe(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """count, mean, std (ddof 1), min, exact quartiles and max per group."""
    keyed = df.where(F.concat_ws("", *by).isNotNull()).dropna(subset=list(by))
    a = keyed.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                               F.min(value).alias("lo"), F.max(value).alias("hi"))
    return a.join(exact_quantiles(keyed, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by), list(by))


def top_k(df: DataFrame, order_by: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order_by).limit(k)


def first_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Drop duplicates keeping the row with the greatest ``order``, by aggregation (no sort)."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_b"))
    return best.select(key, *[F.col(f"_b.{c}").alias(c) for c in rest])


def elbow(curve: DataFrame, index: str, value: str) -> DataFrame:
    """Index farthest from the chord of the curve, which starts at its maximum; one row."""
    peak = curve.agg(F.max_by(index, F.struct(F.col(value), (-F.col(index)).alias("i"))).alias("_i0"), F.max(value).alias("_v0"),
                     F.max(index).alias("_last"), F.max_by(value, index).alias("_v1"))
    t = curve.crossJoin(F.broadcast(peak)).where(F.col(index) >= F.col("_i0"))  # one row
    bx = (F.col("_last") - F.col("_i0") + 1).cast("double")
    by = F.col("_v1") - F.col("_v0")
    px = (F.col(index) - F.col("_i0")).cast("double")
    py = F.col(value) - F.col("_v0")
    s = (px * bx + py * by) / (bx * bx + by * by)
    dist = F.sqrt((px - s * bx) * (px - s * bx) + (py - s * by) * (py - s * by))
    return t.agg(F.max_by(index, F.struct(F.round(F.when(F.col(index) == F.col("_i0"), 0.0).otherwise(dist), 9).alias("d"),
                                          (-F.col(index)).alias("i"))).alias("elbow"))


def histogram(df: DataFrame, value: str, bins: int = 100) -> DataFrame:
    """Equal-width density histogram, empty bins included: (bin, left, n, density)."""
    spark = df.sparkSession
    e = df.agg(F.min(value).alias("_a"), F.max(value).alias("_b"), F.count(value).alias("_n"))
    w = (F.col("_b") - F.col("_a")) / F.lit(float(bins))
    idx = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_a")) / w)).cast("int")
    c = df.crossJoin(F.broadcast(e)).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row
    full = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(c, "bin", "left").crossJoin(F.broadcast(e))
    n = F.coalesce("n", F.lit(0))
    return full.select("bin", (F.col("_a") + F.col("bin") * w).alias("left"), n.alias("n"), (n / (F.col("_n") * w)).alias("density"))


def steepest_rise(hist: DataFrame) -> DataFrame:
    """Left edge of the bin before the largest increase; ties to the first; one row."""
    nxt = hist.select((F.col("bin") - 1).alias("bin"), F.col("density").alias("_next"))
    return hist.join(nxt, "bin").agg(F.max_by("left", F.struct(F.round(F.col("_next") - F.col("density"), 9).alias("d"), (-F.col("bin")).alias("b"))).alias("threshold"))


def above_kth(df: DataFrame, value: str, k: int, id_col: str) -> DataFrame:
    """Rows strictly above the (k+1)-th largest value (ties at the cut drop out)."""
    r = global_rank(df, [F.desc(value), F.asc(id_col)], "_r")
    cut_at = r.where(F.col("_r") == k + 1).select(F.col(value).alias("_cut"))
    return df.join(F.broadcast(cut_at), F.col(value) > F.col("_cut"), "left_semi")  # one row


def set_votes(sets: DataFrame, item: str = "gene", method: str = "method") -> DataFrame:
    """(item, votes, n_methods): votes = distinct methods listing the item."""
    n = sets.agg(F.count_distinct(method).alias("n_methods"))
    return sets.groupBy(item).agg(F.count_distinct(method).alias("votes")).crossJoin(F.broadcast(n))  # one row


def consensus(sets: DataFrame, item: str = "gene", method: str = "method") -> DataFrame:
    """Items listed by every non-empty set."""
    return set_votes(sets, item, method).where(F.col("votes") == F.col("n_methods")).select(item)


def pairwise_overlap(sets: DataFrame, item: str = "gene", method: str = "method") -> DataFrame:
    """Shared items of each pair of sets (bounded by the number of methods per item)."""
    s = sets.select(item, method).distinct()
    b = s.select(item, F.col(method).alias("method_b"))
    return s.join(b, item).where(F.col(method) < F.col("method_b")).groupBy(F.col(method).alias("method_a"), "method_b").agg(F.count(F.lit(1)).alias("shared"))


def reindex(df: DataFrame, order_by: Sequence[Column | str], name: str = "new_id") -> DataFrame:
    """Contiguous ids 1..n in the given total order."""
    return global_rank(df, order_by, name)


def offset_ids(df: DataFrame, patch: str, label: str, out: str = "global_id") -> DataFrame:
    """label + sum of the maxima of all earlier patches."""
    top = df.groupBy(patch).agg(F.max(label).alias("_m"))
    run = OrderedBlocks(top, [patch]).running("_s", "sum", "_m").df.withColumn("_off", F.col("_s") - F.col("_m"))
    return df.join(run.select(patch, "_off"), patch).withColumn(out, F.col(label) + F.col("_off")).drop("_off")


def compare_reports(original: DataFrame, refined: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Two one-row summaries -> (metric, original, refined, diff, pct_change); x/0 is NULL."""
    side = lambda df, n: df.select(F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", n))
    j = side(original, "original").join(side(refined, "refined"), "metric")
    diff = F.col("refined") - F.col("original")
    return j.withColumn("diff", diff).withColumn("pct_change", F.try_divide(F.lit(100.0) * diff, F.col("original")))


def merge_suffixed(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y"), how: str = "inner") -> DataFrame:
    """Join on ``on``; other columns that both sides have get the suffix of their side. Null keys match nothing, repeated keys give every combination."""
    both = (set(left.columns) & set(right.columns)) - set(on)
    named = lambda df, end: df.select(*[F.col(f"`{c}`").alias(c + end if c in both else c) for c in df.columns])
    return named(left, suffixes[0]).join(named(right, suffixes[1]), list(on), how)


def concat_aligned(frames: Mapping[str, DataFrame], on: Sequence[str]) -> DataFrame:
    """Tables side by side, aligned on ``on`` (unique in each): columns ``name_column``, null where a table lacks the key."""
    parts = [df.select(*on, *[F.col(f"`{c}`").alias(f"{name}_{c}") for c in df.columns if c not in on]) for name, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, list(on), "full")
    return out


def central_difference(curve: DataFrame, order: Sequence[str], value: str, h: float = 1.0) -> DataFrame:
    """``slope`` of a curve sampled every ``h`` along ``order``: central differences inside, second-order one-sided ones at both ends.

    Every point hands its share to the points whose slope it is part of, so no
    window runs over the whole curve. Fewer than three points have no slope (null).
    """
    ranked = global_rank(curve, list(order), "_r", "_n")
    at, n, v = F.col("_r"), F.col("_n"), F.col(value).cast("double")
    share = lambda to, weight, when: F.when(when, F.struct(to.cast("long").alias("to"), (weight * v).alias("d")))
    inside = lambda to: (to > 1) & (to < n)
    first = F.when(at == 1, -1.5).when(at == 2, 2.0).when(at == 3, -0.5)
    last = F.when(at == n, 1.5).when(at == n - 1, -2.0).when(at == n - 2, 0.5)
    shares = F.array_compact(F.array(share(at + 1, F.lit(-0.5), inside(at + 1)), share(at - 1, F.lit(0.5), inside(at - 1)), share(F.lit(1), first, at <= 3), share(n, last, at >= n - 2)))
    slopes = (ranked.where(n >= 3).select(F.explode(shares).alias("s")).groupBy(F.col("s.to").alias("_r")).agg((F.sum("s.d") / F.lit(float(h))).alias("slope")))
    return ranked.join(slopes, "_r", "left").select(*curve.columns, "slope")
