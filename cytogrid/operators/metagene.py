"""Meta-gene search: grow a signed sum of genes that separates one domain."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cytogrid.operators.multitest import rank_sum
from cytogrid.session import cut


def find_meta_gene(expr: DataFrame, cells: DataFrame, target: str, start: str, max_iter: int = 5, early_stop: bool = True,
                   cell: str = "cell_id", label: str = "cell_type") -> DataFrame:
    """(cell, meta, name). Each round tests the target's cells against others above its mean score,
    adds the best gene of the target and subtracts the best gene of the rest.

    One rank-sum test and one checkpoint per round; only scalars reach the driver.
    """
    t = cells.select(cell, (F.col(label) == target).alias("_t"))
    of = lambda g, n: expr.where(F.col("gene") == g).select(cell, F.col("value").alias(n))
    meta = cut(t.join(of(start, "meta"), cell, "left").fillna(0.0, ["meta"]))
    name, others, diff = start, cells.count(), 0.0
    for _ in range(max_iter):
        mean = meta.where("_t").agg(F.avg("meta")).first()[0]
        picked = meta.where(F.col("_t") | (F.col("meta") > mean)).select(cell, "_t")
        size = picked.agg(F.sum(F.col("_t").cast("long")).alias("n_in"), F.sum((~F.col("_t")).cast("long")).alias("n_out"))
        n_in, n_out = size.first()
        if min(n_in or 0, n_out or 0) < 5:
            break
        x = expr.join(picked, cell)
        z = rank_sum(x, "value", "_t", x.select("gene").distinct().crossJoin(F.broadcast(size)))  # one row
        best = z.agg(F.max_by("gene", F.struct(F.round("z", 9).alias("z"), "gene")), F.min_by("gene", F.struct(F.round("z", 9).alias("z"), "gene"))).first()
        grown = (meta.join(of(best[0], "_a"), cell, "left").join(of(best[1], "_b"), cell, "left").fillna(0.0, ["_a", "_b"])
                 .withColumn("meta", F.col("meta") + F.col("_a") - F.col("_b")))
        low = grown.agg(F.min("meta")).first()[0]
        grown = cut(grown.select(cell, "_t", (F.col("meta") - F.lit(low)).alias("meta")))
        now = grown.agg(F.avg(F.when(F.col("_t"), F.col("meta"))) - F.avg(F.when(~F.col("_t"), F.col("meta")))).first()[0]
        if early_stop and not (others >= n_out and diff <= now):
            break
        others, diff, meta, name = n_out, now, grown, f"{name}+{best[0]}-{best[1]}"
    return meta.select(cell, "meta", F.lit(name).alias("name"))
