"""Global order without a single-task window.

A window without PARTITION BY (or with one huge partition) sorts everything in
one task. ``OrderedBlocks`` range-partitions on the full sort key instead, so a
hot key is split over many blocks, and carries prefix totals from block to
block through a table with one row per (group, block).
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytogrid.session import cut

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


class OrderedBlocks:
    """Rows in global order; add ranks and running aggregates column by column.

    ``order_by`` must be a total order (end it with a unique id).
    """

    def __init__(self, df: DataFrame, order_by: Sequence[Column | str], partition_by: Sequence[str] = ()):
        self.part = list(partition_by)
        self.order = [F.col(c) if isinstance(c, str) else c for c in order_by]
        keys = [F.col(c) for c in self.part] + self.order
        # the block number must not change between uses: range bounds are
        # sampled, hence the durable copy
        self._df = cut(df.repartitionByRange(*keys).withColumn("_block", F.spark_partition_id()))

    @property
    def df(self) -> DataFrame:
        return self._df.drop("_block")

    def _carry(self, aggregates: dict[str, Column], reducers: dict[str, str]) -> DataFrame:
        keys = self.part + ["_block"]
        blocks = self._df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
        before = W.partitionBy(*(self.part or [F.lit(0)])).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
        whole = W.partitionBy(*(self.part or [F.lit(0)]))
        out = [F.col(k).alias(k) for k in keys]
        for name in aggregates:
            fn = _AGG[reducers[name]]
            out.append(fn(name).over(before).alias(f"{name}_before"))
            out.append(fn(name).over(whole).alias(f"{name}_total"))
        return self._df.join(blocks.select(*out), keys)

    def _local(self) -> W:
        return W.partitionBy(*self.part, "_block").orderBy(*self.order)

    def row_number(self, name: str, total: str | None = None) -> "OrderedBlocks":
        joined = self._carry({"_n": F.count(F.lit(1))}, {"_n": "sum"})
        out = joined.withColumn(
            name, F.row_number().over(self._local()).cast("long") + F.coalesce("_n_before", F.lit(0)))
        if total:
            out = out.withColumn(total, F.col("_n_total"))
        self._df = out.drop("_n_before", "_n_total")
        return self

    def running(self, name: str, agg: str, value: Column | str, total: str | None = None) -> "OrderedBlocks":
        """Inclusive running ``sum``/``min``/``max`` of ``value`` in the global order."""
        fn = _AGG[agg]
        self._df = self._df.withColumn("_carried", F.col(value) if isinstance(value, str) else value)
        joined = self._carry({"_a": fn("_carried")}, {"_a": agg})
        here = fn("_carried").over(self._local().rowsBetween(W.unboundedPreceding, W.currentRow))
        if agg == "sum":
            combined = here + F.coalesce(F.col("_a_before"), F.lit(0))
        else:
            pick = F.least if agg == "min" else F.greatest
            combined = pick(here, F.col("_a_before"))  # least/greatest skip NULL
        out = joined.withColumn(name, combined)
        if total:
            out = out.withColumn(total, F.col("_a_total"))
        self._df = out.drop("_a_before", "_a_total", "_carried")
        return self

    def with_column(self, name: str, value: Column) -> "OrderedBlocks":
        self._df = self._df.withColumn(name, value)
        return self


def global_rank(df: DataFrame, order_by: Sequence[Column | str], name: str = "rank",
                total: str | None = None, partition_by: Sequence[str] = ()) -> DataFrame:
    """1..n in a total order (optionally within groups of any size)."""
    return OrderedBlocks(df, order_by, partition_by).row_number(name, total).df


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Distinct values per group with counts and the number of smaller rows.

    Rows are pre-aggregated to (group, value, n) before anything is ordered, so
    tied blocks of any size are one row. Columns: by…, value, n, n_less, n_total.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*by, value).agg(n.cast("long").alias("n"))
    blocks = OrderedBlocks(counts, [value], by).running("_upto", "sum", "n", total="n_total")
    return blocks.df.withColumn("n_less", F.col("_upto") - F.col("n")).drop("_upto")


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (),
                    weight: str | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles by distributed rank selection.

    One row per group with one column per entry of ``probs``. NULL/NaN values
    are skipped as pandas does.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    ranked = value_ranks(clean, value, by, weight)
    picks = []
    for name, q in probs.items():
        pos = F.lit(float(q)) * (F.col("n_total") - 1)
        lo = F.floor(pos)
        hi = F.least(lo + 1, F.col("n_total") - 1)
        holds = lambda r: (F.col("n_less") <= r) & (r < F.col("n_less") + F.col("n"))
        v = F.col(value).cast("double")
        picks.append(F.max(F.when(holds(lo), v)).alias(f"_lo_{name}"))
        picks.append(F.max(F.when(holds(hi), v)).alias(f"_hi_{name}"))
        picks.append(F.max(pos - lo).alias(f"_f_{name}"))
    agg = ranked.groupBy(*by).agg(*picks)
    return agg.select(*by, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
        for n in probs])


def top_per_group(df: DataFrame, by: Sequence[str], order_by: Sequence[Column], k: int,
                  rank: str | None = None) -> DataFrame:
    """First ``k`` rows per group; the rank filter is applied map-side before the shuffle."""
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order_by))).where(F.col(name) <= k)
    return out if rank else out.drop(name)
