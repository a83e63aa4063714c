"""Half-open crops, tile grids with halo, and tile ownership."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def crop(df: DataFrame, x0: float, x1: float, y0: float, y1: float, x: str = "x", y: str = "y") -> DataFrame:
    """x0 <= x < x1 and y0 <= y < y1, as plain predicates that reach the scan."""
    return df.where((F.col(x) >= x0) & (F.col(x) < x1) & (F.col(y) >= y0) & (F.col(y) < y1))


def tile_grid(spark: SparkSession, width: int, height: int, core: int, halo: int) -> DataFrame:
    """One row per tile: half-open core box and halo box clamped to the slide."""
    nc, nr = -(-width // core), -(-height // core)
    t = (spark.range(nr * nc).select((F.col("id") / nc).cast("int").alias("tile_row"), (F.col("id") % nc).cast("int").alias("tile_col")))
    lo = lambda i: (F.col(i) * core)
    hi = lambda i, m: F.least((F.col(i) + 1) * core, F.lit(m))
    return t.select("tile_row", "tile_col", lo("tile_col").alias("x0"), hi("tile_col", width).alias("x1"), lo("tile_row").alias("y0"), hi("tile_row", height).alias("y1"),
                    F.greatest(lo("tile_col") - halo, F.lit(0)).alias("hx0"), F.least(hi("tile_col", width) + halo, F.lit(width)).alias("hx1"),
                    F.greatest(lo("tile_row") - halo, F.lit(0)).alias("hy0"), F.least(hi("tile_row", height) + halo, F.lit(height)).alias("hy1"))


def _span(c: Column, core: float, halo: float, count: int) -> Column:
    lo = F.greatest(F.floor((c - halo) / core), F.lit(0))
    # tile i covers [i*core - halo, (i+1)*core + halo)
    hi = F.least(F.floor((c + halo) / core), F.lit(count - 1))
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def replicate_to_tiles(points: DataFrame, core: float, halo: float, n_cols: int, n_rows: int, x: str = "x", y: str = "y") -> DataFrame:
    """Each point once per tile whose core + halo contains it, with an ``owned`` flag.

    A row-local explode (no join): at most 4 copies while halo < core / 2.
    Points off the grid belong to a tile only as far as its halo reaches; beyond
    that they are dropped.
    """
    own = (F.floor(F.col(x) / core) == F.col("tile_col")) & (F.floor(F.col(y) / core) == F.col("tile_row"))
    inside = ((F.col(x) >= F.col("tile_col") * core - halo) & (F.col(x) < (F.col("tile_col") + 1) * core + halo)
              & (F.col(y) >= F.col("tile_row") * core - halo) & (F.col(y) < (F.col("tile_row") + 1) * core + halo))
    return (points.withColumn("tile_col", F.explode(_span(F.col(x), core, halo, n_cols)))
            .withColumn("tile_row", F.explode(_span(F.col(y), core, halo, n_rows))).where(inside).withColumn("owned", own))


def owned(shapes: DataFrame, core: float, cx: str = "cx", cy: str = "cy") -> DataFrame:
    """Keep a tile's shape only when its centroid lies in that tile's core."""
    return shapes.where((F.floor(F.col(cx) / core) == F.col("tile_col")) & (F.floor(F.col(cy) / core) == F.col("tile_row")))


def seam_strips(spark: SparkSession, width: int, height: int, n_cols: int, n_rows: int, margin: int) -> DataFrame:
    """Strips of ± margin around every inner patch border of an n_rows x n_cols lattice."""
    pw, ph = width / n_cols, height / n_rows
    name = lambda k: F.concat(F.lit(f"seam_{k}_"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("seam")

    def around(border: Column, m: int) -> list[Column]:
        return [F.greatest(F.lit(0.0), border - margin), F.least(F.lit(float(m)), border + margin)]

    def span(i: Column, step: float, m: int) -> list[Column]:
        return [F.greatest(F.lit(0.0), i * step - margin), F.least(F.lit(float(m)), (i + 1) * step + margin)]

    row, col = F.floor(F.col("id") / n_cols), F.col("id") % n_cols
    h = spark.range((n_rows - 1) * n_cols).select(name("H"), *[c.alias(n) for c, n in zip(around((row + 1) * ph, height) + span(col, pw, width), ("y0", "y1", "x0", "x1"))])
    row, col = F.floor(F.col("id") / (n_cols - 1)), F.col("id") % (n_cols - 1)
    v = spark.range(n_rows * (n_cols - 1)).select(name("V"), *[c.alias(n) for c, n in zip(span(row, ph, height) + around((col + 1) * pw, width), ("y0", "y1", "x0", "x1"))])
    return h.unionByName(v)
