"""Connected components of a sparse link table by contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cytogrid.llm.common import release, stored


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``links`` (src, dst): nodes share a root exactly if a chain of links joins them.

    Each round every node moves to its neighbour with the smallest hash, links
    are renamed, and loops and repeats go; it ends when no link is left. Hubs are
    only aggregated with min, and the joins are plain equi-joins whose hot keys
    Spark splits.
    """
    mixed = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    links = stored(links.select("src", "dst").where("src != dst").distinct())
    names = stored(links.select(F.col("src").alias("node")).union(links.select(F.col("dst").alias("node"))).distinct().select("node", F.col("node").alias("root")))
    while not links.isEmpty():
        both = links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        moves = stored(both.groupBy("src").agg(F.min(mixed("dst")).alias("m")).select(F.col("src").alias("was"), F.least("m", mixed("src"))["id"].alias("now")))
        named = stored(names.join(moves, names.root == moves.was, "left").select("node", F.coalesce("now", "root").alias("root")))
        one = links.join(moves, links.src == moves.was).select(F.col("now").alias("src"), "dst")
        two = one.join(moves, one.dst == moves.was).select("src", F.col("now").alias("dst"))
        shorter = stored(two.where("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
        release(links, names, moves)
        links, names = shorter, named
    release(links)
    return names
