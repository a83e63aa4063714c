"""Communities of a weighted graph by modularity: gain-driven moves, then contraction, level by level."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytogrid.operators.graph import both_ways
from cytogrid.operators.ordering import OrderedBlocks
from cytogrid.session import cut

GAIN = 1e-12
GROUP = 100_000


def _upto(moves: DataFrame, side: str, order: list[Column], name: str) -> DataFrame:
    """Adds the strength of the moves that come before each one at its community on ``side``; crowded communities are summed block by block."""
    if moves.groupBy(side).count().where(F.col("count") > GROUP).isEmpty():
        over = W.partitionBy(side).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
        return moves.withColumn(name, F.coalesce(F.sum("k").over(over), F.lit(0.0)))
    return OrderedBlocks(moves, order, [side]).running(name, "sum", "k").df.withColumn(name, F.col(name) - F.col("k"))


def _moves(adj: DataFrame, state: DataFrame, total: float, resolution: float) -> DataFrame:
    """The best move of every node that gains modularity: node, k, source, target, gain."""
    here = state.select("node", "k", F.col("community").alias("source"))
    sums = state.groupBy("community").agg(F.sum("k").alias("sum"))
    links = (adj.join(state.select(F.col("node").alias("nbr"), F.col("community").alias("target")), "nbr")
             .groupBy("node", "target").agg(F.sum("weight").alias("w")))
    own = links.select("node", F.col("target").alias("source"), F.col("w").alias("w_own")).join(here.drop("k"), ["node", "source"]).drop("source")
    asked = links.join(here, "node").where(F.col("source") != F.col("target")).join(own, "node", "left")
    asked = (asked.join(sums.select(F.col("community").alias("target"), F.col("sum").alias("sum_target")), "target")
             .join(sums.select(F.col("community").alias("source"), F.col("sum").alias("sum_source")), "source"))
    gain = (F.col("w") - F.coalesce("w_own", F.lit(0.0))) / total - resolution * F.col("k") * (F.col("sum_target") - F.col("sum_source") + F.col("k")) / (2 * total * total)
    best = (asked.withColumn("gain", gain).where(F.col("gain") > GAIN).groupBy("node", "k", "source")
            .agg(F.max(F.struct("gain", (-F.col("target")).alias("t"))).alias("b")))
    return best.select("node", "k", "source", (-F.col("b.t")).alias("target"), F.col("b.gain").alias("gain"))


def _accepted(moves: DataFrame, total: float, resolution: float) -> DataFrame:
    """Moves (node, target) that together gain modularity.

    A community either sends or receives, as its best move decides, so the best move of all is never held
    back. Moves that share a community take at most resolution * k * k' / (2 total^2) from each
    other; a move goes ahead if its gain exceeds that for all better moves at its two communities.
    """
    rank = F.struct("gain", F.xxhash64("node").alias("h"), "node")
    touch = moves.select(F.explode(F.array(F.struct(F.col("source").alias("community"), rank.alias("r"), F.lit(True).alias("sends")),
                                           F.struct(F.col("target").alias("community"), rank.alias("r"), F.lit(False).alias("sends")))).alias("t")).select("t.*")
    roles = touch.groupBy("community").agg(F.max_by("sends", "r").alias("sends"))
    out = roles.where("sends").select(F.col("community").alias("source"))
    into = roles.where("not sends").select(F.col("community").alias("target"))
    fine = cut(moves.join(out, "source", "left_semi").join(into, "target", "left_semi"))
    order = [F.col("gain").desc(), F.xxhash64("node").desc(), F.col("node").desc()]
    fine = _upto(_upto(fine, "target", order, "k_target"), "source", order, "k_source")
    return fine.where(F.col("gain") > resolution * F.col("k") * (F.col("k_target") + F.col("k_source")) / (2 * total * total)).select("node", "target")


def _settle(adj: DataFrame, state: DataFrame, total: float, resolution: float) -> tuple[DataFrame, bool]:
    """Moves nodes until none gains; each round raises the modularity, so it ends. Also whether any moved."""
    moved = False
    while True:
        moves = cut(_moves(adj, state, total, resolution))
        if moves.isEmpty():
            return state, moved
        state = cut(state.join(_accepted(moves, total, resolution), "node", "left").select("node", "k", F.coalesce("target", "community").alias("community")))
        moved = True


def louvain(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, id_col: str = "cell_id") -> DataFrame:
    """``id_col`` and community (its smallest node) of every node: a partition that no move of a node or of a community improves.

    ``edges`` (src, dst, weight) is undirected, weights are not negative; repeated
    edges add up, loops count twice in a strength. Nodes move to the neighbouring community with the
    largest gain (ties to the smaller one), communities become nodes, and so on
    until no gain is left at any level; then single nodes are tried again.
    """
    raw = edges.select(F.least("src", "dst").cast("long").alias("src"), F.greatest("src", "dst").cast("long").alias("dst"), F.col("weight").cast("double").alias("weight")).where("weight > 0")
    level = cut(raw.groupBy("src", "dst").agg(F.sum("weight").alias("weight")))
    total = level.agg(F.sum("weight")).first()[0]
    ids = cut(nodes.select(F.col(id_col).alias("node")).distinct())
    labels = ids.select("node", F.col("node").cast("long").alias("community"))
    if total:
        base = level
        while True:
            labels, moved = _climb(base, ids, labels, total, resolution)
            if not moved:
                break
    first = labels.groupBy("community").agg(F.min("node").alias("first"))
    return labels.join(first, "community").select(F.col("node").alias(id_col), F.col("first").alias("community"))


def _climb(base: DataFrame, ids: DataFrame, labels: DataFrame, total: float, resolution: float) -> tuple[DataFrame, bool]:
    """One pass from single nodes, in the communities ``labels``, up to where communities no longer merge."""
    level, at, names, any_moved = base, labels, labels.select("node", F.col("node").cast("long").alias("part")), False
    while True:
        weighed = both_ways(level.where("src != dst")).groupBy("node").agg(F.sum("weight").alias("k"))
        loops = level.where("src = dst").select(F.col("src").alias("node"), (2 * F.col("weight")).alias("loop"))
        state = cut(at.join(weighed, "node", "left").join(loops, "node", "left")
                    .select("node", (F.coalesce("k", F.lit(0.0)) + F.coalesce("loop", F.lit(0.0))).alias("k"), "community"))
        state, moved = _settle(cut(both_ways(level.where("src != dst"))), state, total, resolution)
        any_moved |= moved
        names = cut(names.join(state.select(F.col("node").alias("part"), "community"), "part").select("node", F.col("community").alias("part")))
        ends = lambda c: state.select(F.col("node").alias(c), F.col("community").alias(f"c_{c}"))
        merged = level.join(ends("src"), "src").join(ends("dst"), "dst")
        smaller = cut(merged.groupBy(F.least("c_src", "c_dst").alias("src"), F.greatest("c_src", "c_dst").alias("dst")).agg(F.sum("weight").alias("weight")))
        if not moved and level is not base:
            return names.select("node", F.col("part").alias("community")), any_moved
        level = smaller
        at = state.select(F.col("community").alias("node")).distinct().withColumn("community", F.col("node"))
