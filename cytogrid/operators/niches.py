"""Neighbourhood labels: consensus relabelling, refinement, neighbouring domains."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytogrid.operators.spatial import count_by_type, knn


def neighbouring_domains(cells: DataFrame, target: str, radius: float, ratio: float = 0.5,
                         id_col: str = "cell_id", label: str = "cell_type") -> DataFrame:
    """Domains seen more than ``ratio`` x their own size around the target's cells.

    Falls back to the single most frequent neighbour when none passes.
    """
    sizes = cells.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    seen = (count_by_type(cells.where(F.col(label) == target), cells, radius, id_col, label)
            .where(F.col(label) != target).groupBy(label).agg(F.sum("n").alias("n")).join(sizes, label)
            .withColumn("_pass", F.col("n") > ratio * F.col("size")))
    top = seen.agg(F.max("_pass").alias("_any"), F.max_by(F.col(label), F.struct("n", label)).alias("_top"))
    return (seen.crossJoin(F.broadcast(top))  # one row
            .where(F.col("_pass") | (~F.col("_any") & (F.col(label) == F.col("_top")))).select(label, "n", "size"))


def mean_neighbours(cells: DataFrame, target: str, radius: float, id_col: str = "cell_id", label: str = "cell_type") -> float:
    """Mean number of cells within ``radius`` of the target's cells, themselves included."""
    per = count_by_type(cells.where(F.col(label) == target), cells, radius, id_col, label).groupBy(id_col).agg(F.sum("n").alias("n"))
    return per.agg(F.avg("n")).first()[0] or 0.0


def search_radius(cells: DataFrame, target: str, start: float, end: float, low: float = 8, high: float = 15,
                  max_run: int = 100, **kw) -> float | None:
    """Bisect for a radius whose mean neighbour count lies in [low, high]; None when out of reach."""
    at = {x: mean_neighbours(cells, target, x, **kw) for x in (start, end)}
    for x in (start, end):
        if low <= at[x] <= high:
            return x
    if at[start] > high or at[end] < low:
        return None
    for _ in range(max_run):
        mid = (start + end) / 2
        got = mean_neighbours(cells, target, mid, **kw)
        if low <= got <= high:
            return mid
        start, end = (mid, end) if got < low else (start, mid)
    return None


def consensus_relabel(cells: DataFrame, threshold: float = 0.5, k: int = 15, share: float = 0.6,
                      id_col: str = "cell_id", label: str = "cell_type", conf: str = "conf",
                      x: str = "x", y: str = "y") -> DataFrame:
    """Relabel low-confidence cells by the confidence-weighted vote of k neighbours.

    All votes read the original labels; weights are max(confidence, 0.1); ties go
    to the type whose first voter is nearest. Adds refined, method, consensus.
    """
    near = knn(cells, k, id_col, x, y, query_if=F.col(conf) < threshold)
    voter = cells.select(F.col(id_col).alias("dst"), F.col(label).alias("_vote"), F.greatest(F.col(conf), F.lit(0.1)).alias("_w"))
    votes = near.join(voter, "dst").groupBy("src", "_vote").agg(F.round(F.sum("_w"), 9).alias("_w"), F.min("rank").alias("_first"))
    win = votes.groupBy("src").agg(F.max_by(F.struct("_vote", "_w"), F.struct(F.col("_w"), -F.col("_first"))).alias("_best"),
                                   F.sum("_w").alias("_all"))
    win = win.select(F.col("src").alias(id_col), F.col("_best._vote").alias("_to"), F.round(F.col("_best._w") / F.col("_all"), 9).alias("_share"))
    moved = F.coalesce((F.col("_share") >= share) & (F.col("_to") != F.col(label)), F.lit(False))
    any_low = (F.col(conf) < threshold)
    return (cells.join(win, id_col, "left")
            .withColumn("refined", F.when(moved, F.col("_to")).otherwise(F.col(label)))
            .withColumn("method", F.when(moved, "neighborhood").otherwise("original"))
            .withColumn("consensus", F.when(any_low, F.col("_share")).otherwise(F.lit(0.0)))
            .withColumn("consensus", F.coalesce("consensus", F.lit(0.0))).drop("_to", "_share"))


def integrate_annotations(cells: DataFrame, model_label: str, model_conf: str, marker_label: str, marker_conf: str,
                          t_model: float, t_marker: float, k: int = 15, share: float = 0.6,
                          id_col: str = "cell_id", x: str = "x", y: str = "y") -> DataFrame:
    """Model label if confident, else marker label if confident, then neighbourhood consensus."""
    override = (F.col(marker_conf) >= t_marker) & (F.col(model_conf) < t_model)
    base = (cells.withColumn("final_cell_type", F.when(override, F.col(marker_label)).otherwise(F.col(model_label)))
            .withColumn("annotation_source", F.when(override, "biomarker").otherwise("celltypist"))
            .withColumn("combined", F.greatest(model_conf, marker_conf)))
    out = consensus_relabel(base, max(t_model, t_marker), k, share, id_col, "final_cell_type", "combined", x, y)
    return (out.withColumn("final_cell_type", F.col("refined"))
            .withColumn("annotation_source", F.when(F.col("method") == "neighborhood", "neighborhood").otherwise(F.col("annotation_source")))
            .drop("refined", "method"))


def refine_labels(cells: DataFrame, shape: str = "hexagon", id_col: str = "cell_id", label: str = "cell_type",
                  x: str = "x", y: str = "y") -> DataFrame:
    """Replace a label held by fewer than half the neighbours when another holds more than half.

    6 (hexagon) or 4 (square) nearest plus the cell itself vote; ties to the smaller label.
    """
    k = {"hexagon": 6, "square": 4}[shape]
    near = knn(cells, k, id_col, x, y).select("src", "dst").unionByName(
        cells.select(F.col(id_col).alias("src"), F.col(id_col).alias("dst")))
    v = near.join(cells.select(F.col(id_col).alias("dst"), F.col(label).alias("_vote")), "dst").groupBy("src", "_vote").agg(F.count(F.lit(1)).alias("_n"))
    own = v.join(cells.select(F.col(id_col).alias("src"), F.col(label).alias("_own")), "src")
    per = own.groupBy("src").agg(
        F.max(F.when(F.col("_vote") == F.col("_own"), F.col("_n"))).alias("_self"), F.max("_n").alias("_top"),
        F.min_by("_vote", F.struct((-F.col("_n")).alias("n"), F.col("_vote"))).alias("_mode"), F.first("_own").alias("_own"))
    swap = (F.col("_self") < k / 2) & (F.col("_top") > k / 2)
    return per.select(F.col("src").alias(id_col), F.when(swap, F.col("_mode")).otherwise(F.col("_own")).alias("refined"))
