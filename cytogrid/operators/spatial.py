"""Spatial joins as grid-bin equi-joins: radius, box, k-nearest, point-in-polygon."""
from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cytogrid.session import cut

BIN_ROWS = 20_000  # rows of one bin joined by one task; fuller bins are split
ASK_ROWS = 20_000  # points of one task that look for their nearest neighbours


def _bin(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size)))


def _split_hot_bins(probe: DataFrame, build: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, DataFrame]:
    """Split bins holding more than ``rows`` build rows into sub-bins ``_s``.

    Build rows go to one sub-bin each, probe rows to every sub-bin of their bin,
    so each matching pair still meets exactly once.
    """
    hot = (build.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > rows)
           .select(*keys, F.ceil(F.col("_n") / F.lit(rows)).cast("int").alias("_split")))
    split = F.coalesce(F.col("_split"), F.lit(1))
    # hashed before the join: the input partition tells identical copies apart
    b = (build.withColumn("_h", F.xxhash64(*[c for c in build.columns if c not in keys]) + F.spark_partition_id())
         .join(hot, keys, "left").withColumn("_s", F.pmod("_h", split).cast("int")).drop("_split", "_h"))
    p = (probe.join(hot, keys, "left")
         .withColumn("_s", F.explode(F.sequence(F.lit(0), split - 1))).drop("_split"))
    return p, b


def radius_pairs(points: DataFrame, radius: float, id_col: str = "cell_id",
                 x: str = "x", y: str = "y", bin_rows: int = BIN_ROWS, carry: Sequence[str] = ()) -> DataFrame:
    """Unordered pairs at distance <= radius: (src < dst, dist, src_/dst_ of ``carry``).

    Bins of side ``radius``; each point probes its own bin and four forward
    neighbours, so a pair is generated once instead of twice.
    """
    p = points.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"),
                      *[F.col(c).alias(f"p_{c}") for c in carry])
    binned = p.withColumn("gx", _bin(F.col("px"), radius)).withColumn("gy", _bin(F.col("py"), radius))
    steps = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"))
                      for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    probe = (binned.withColumn("st", F.explode(steps))
             .select(F.col("id").alias("a"), F.col("px").alias("ax"), F.col("py").alias("ay"), *[F.col(f"p_{c}").alias(f"a_{c}") for c in carry],
                     (F.col("gx") + F.col("st.i")).alias("gx"), (F.col("gy") + F.col("st.j")).alias("gy"),
                     ((F.col("st.i") == 0) & (F.col("st.j") == 0)).alias("own")))
    probe, build = _split_hot_bins(probe, binned, ["gx", "gy"], bin_rows)
    # a fixed partition count: points are few bytes, but each meets many others
    probe = probe.repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), "gx", "gy", "_s")
    d2 = (F.col("px") - F.col("ax")) * (F.col("px") - F.col("ax")) + (F.col("py") - F.col("ay")) * (F.col("py") - F.col("ay"))
    # merged, not broadcast: searches that form the pairs again and again would send the points through the driver each time
    pairs = (probe.join(build.hint("merge"), ["gx", "gy", "_s"])
             .where((~F.col("own") | (F.col("a") < F.col("id"))) & (d2 <= F.lit(float(radius) * float(radius)))))
    first = F.col("a") < F.col("id")
    along = [(F.when(first, F.col(f"{u}_{c}")).otherwise(F.col(f"{v}_{c}"))).alias(f"{end}_{c}") for c in carry for end, u, v in (("src", "a", "p"), ("dst", "p", "a"))]
    return pairs.select(F.least("a", "id").alias("src"), F.greatest("a", "id").alias("dst"), F.sqrt(d2).alias("dist"), *along)


def window_join(queries: DataFrame, points: DataFrame, radius: float, shape: str = "disc",
                x: str = "x", y: str = "y", bin_rows: int = BIN_ROWS) -> DataFrame:
    """Queries x points within ``radius`` (self included).

    ``shape``: ``disc`` is d <= r, ``box`` the open box |dx| < r and |dy| < r.
    Query columns get the prefix ``q_``, point columns ``p_``; ``d2`` is added.
    """
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    p = points.select(*[F.col(c).alias(f"p_{c}") for c in points.columns])
    qx, qy, px, py = (F.col(c) for c in (f"q_{x}", f"q_{y}", f"p_{x}", f"p_{y}"))
    build = p.withColumn("gx", _bin(px, radius)).withColumn("gy", _bin(py, radius))
    ring = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    probe = (q.withColumn("_i", F.explode(ring)).withColumn("_j", F.explode(ring))
             .withColumn("gx", _bin(qx, radius) + F.col("_i")).withColumn("gy", _bin(qy, radius) + F.col("_j"))
             .drop("_i", "_j"))
    probe, build = _split_hot_bins(probe, build, ["gx", "gy"], bin_rows)
    dx, dy = px - qx, py - qy
    d2 = dx * dx + dy * dy
    r = float(radius)
    hit = d2 <= F.lit(r * r) if shape == "disc" else (F.abs(dx) < r) & (F.abs(dy) < r)
    return probe.join(build, ["gx", "gy", "_s"]).where(hit).withColumn("d2", d2).drop("gx", "gy", "_s")


TILE_ROWS = 10_000  # points of one tile of ``with_margin``
TASK_CELLS = 25_000  # points of one task that works on such tiles


def with_margin(points: DataFrame, margin: float, id_col: str = "cell_id", x: str = "x", y: str = "y", rows: int = TILE_ROWS, carry: Sequence[str] = ()) -> DataFrame | None:
    """(gx, gy, id, x, y, own, ``carry``): points of square tiles, each with all others up to ``margin`` beside it.

    Tiles are as large as ``rows`` own points allow, but no smaller than the
    margin; None if even those are too full.
    """
    p = points.select(F.col(id_col), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), *carry)
    side = 32 * margin
    while True:
        most = p.groupBy(_bin(F.col("x"), side), _bin(F.col("y"), side)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= rows:
            break
        if side <= margin:
            return None
        side = max(margin, side / 2)
    steps = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("st")
    reach = margin * (1 + 1e-9)
    near = lambda c, g: (F.col(c) >= F.col(g) * side - reach) & (F.col(c) <= (F.col(g) + 1) * side + reach)
    moved = (p.withColumn("_x", _bin(F.col("x"), side)).withColumn("_y", _bin(F.col("y"), side)).select("*", steps)
             .withColumn("gx", F.col("_x") + F.col("st.i")).withColumn("gy", F.col("_y") + F.col("st.j"))
             .withColumn("own", (F.col("st.i") == 0) & (F.col("st.j") == 0)))
    return moved.where(F.col("own") | (near("x", "gx") & near("y", "gy"))).select("gx", "gy", id_col, "x", "y", "own", *carry)


def near_pairs(x: np.ndarray, y: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i <> j, of points at most ``radius`` apart, both ways, block by block. For points of one tile."""
    col, row = np.floor(x / radius).astype(np.int64), np.floor(y / radius).astype(np.int64)
    row -= row.min(initial=0) - 1
    wide = int(row.max(initial=0)) + 2
    key = (col - col.min(initial=0)) * wide + row
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    for c in (-1, 0, 1):  # three bins of one column lie side by side
        low, high = np.searchsorted(sorted_key, key + c * wide - 1), np.searchsorted(sorted_key, key + c * wide + 1, side="right")
        many = high - low
        ends = np.cumsum(many)
        at = 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 5_000_000, side="right")))
            n = many[at:to]
            i = np.repeat(np.arange(at, to), n)
            j = order[np.repeat(low[at:to] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            hit = ((x[j] - x[i]) * (x[j] - x[i]) + (y[j] - y[i]) * (y[j] - y[i]) <= radius * radius) & (i != j)
            yield i[hit], j[hit]
            at = to


def count_by_type(queries: DataFrame, points: DataFrame, radius: float, id_col: str = "cell_id",
                  type_col: str = "cell_type", shape: str = "disc", x: str = "x", y: str = "y") -> DataFrame:
    """(query id, type, n) neighbours per type, self included.

    Points at one place with one type are counted before the join, so stacked
    points cost one candidate.
    """
    places = points.groupBy(x, y, type_col).agg(F.count(F.lit(1)).alias("n"))
    hits = window_join(queries.select(id_col, x, y), places, radius, shape, x, y)
    return (hits.groupBy(F.col(f"q_{id_col}").alias(id_col), F.col(f"p_{type_col}").alias(type_col))
            .agg(F.sum("p_n").alias("n")))


def _occupancy(points: DataFrame, k: int, min_x: float, min_y: float, side: float, n: int) -> tuple[int, DataFrame, bool]:
    """Finest quadtree depth, its occupied cells (fx, fy, n, ask) and whether crowded cells remain.

    Cells are counted map-side. Only when a cell is crowded its distinct places
    are looked at: many places ask for a deeper tree, stacked copies do not.
    """
    limit = 16 * (k + 1)
    depth = max(0, min(24, math.ceil(math.log(max(n, 1) / (k + 1), 4)) + 2))
    while True:
        located = points.select("*", *_cell(depth, min_x, min_y, side))
        occupied = cut(located.groupBy("fx", "fy").agg(F.count(F.lit(1)).alias("n"), F.max("ask").alias("ask")))
        crowded = (occupied.agg(F.max("n")).first()[0] or 0) > limit
        if not crowded or depth >= 24:
            return depth, occupied, crowded
        places = located.select("fx", "fy", "px", "py").distinct().groupBy("fx", "fy").count().agg(F.max("count")).first()[0]
        if places <= limit:
            return depth, occupied, True
        depth = min(24, depth + max(1, math.ceil(math.log(places / limit, 4))))


def _cell(depth: int, min_x: float, min_y: float, side: float) -> list[Column]:
    top = F.lit((1 << depth) - 1).cast("long")
    scale = float(1 << depth) / side
    return [F.least(top, F.floor((F.col("px") - F.lit(min_x)) * F.lit(scale))).alias("fx"),
            F.least(top, F.floor((F.col("py") - F.lit(min_y)) * F.lit(scale))).alias("fy")]


def knn(points: DataFrame, k: int, id_col: str = "cell_id", x: str = "x", y: str = "y",
        include_self: bool = False, query_if: Column | None = None) -> DataFrame:
    """Exact k nearest neighbours in the plane: (src, dst, dist, rank).

    Ties are broken by the smaller id. Each point searches at the finest
    quadtree level whose own cell holds k+1 points: the k-th neighbour is then
    within that cell's diagonal, i.e. inside the surrounding 5x5 cells. Dense
    and empty regions so use different cell sizes, one pass, no all-pairs.
    ``query_if`` restricts which points ask; all points can be neighbours.
    """
    p = points.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"),
                      (query_if if query_if is not None else F.lit(True)).alias("ask"))
    box = p.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py"), F.count(F.lit(1))).first()
    n = box[4]
    min_x, min_y = box[0] or 0.0, box[2] or 0.0
    side = max((box[1] or 0.0) - min_x, (box[3] or 0.0) - min_y, 1e-9) * (1 + 1e-9)
    depth, occupied, crowded = _occupancy(p, k, min_x, min_y, side, n)
    p = p.select("*", *_cell(depth, min_x, min_y, side))

    levels = F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("lv")
    up = lambda c: F.expr(f"shiftright({c}, {depth} - lv)")
    pyramid = occupied.select("*", levels).select("*", up("fx").alias("cx"), up("fy").alias("cy"))
    enough = (pyramid.groupBy("lv", "cx", "cy").agg(F.sum("n").alias("n"))
              .where((F.col("n") >= k + 1) | (F.col("lv") == 0)).drop("n"))
    chosen = cut(pyramid.where("ask").join(enough, ["lv", "cx", "cy"]).groupBy("fx", "fy").agg(F.max("lv").alias("lv")))
    in_use = sorted(row[0] for row in chosen.select("lv").distinct().collect())  # at most 25 numbers

    ring = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j"))
                               for i in range(-2, 3) for j in range(-2, 3) if abs(i) + abs(j) < 4])).alias("st")
    served = p
    if crowded:  # of points on one place only the k+1 smallest ids can be neighbours
        places = W.partitionBy("px", "py").orderBy("id")
        served = p.withColumn("_r", F.row_number().over(places)).where(F.col("_r") <= k + 1)
    candidates = (served.select("id", "px", "py", "fx", "fy", F.explode(F.array(*[F.lit(v) for v in in_use] or [F.lit(0)])).alias("lv"))
                  .select("lv", up("fx").alias("cx"), up("fy").alias("cy"), F.col("id").alias("dst"), F.col("px").alias("bx"), F.col("py").alias("by")))
    size = F.lit(side) / F.pow(F.lit(2.0), F.col("lv"))
    # the k-th neighbour is no farther than the farthest corner of the own cell
    far = lambda c, g, m: F.greatest(F.col(c) - F.lit(m) - F.col(g) * F.col("s"), F.lit(m) + (F.col(g) + 1) * F.col("s") - F.col(c))
    fx, fy = far("px", "cx0", min_x), far("py", "cy0", min_y)
    # dealt out by number before they meet their candidates: a small file is one partition, whose task would form and order all pairs
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / ASK_ROWS))
    asks = (p.where("ask").join(chosen, ["fx", "fy"]).repartition(tasks, "id")
            .select("id", "px", "py", "lv", up("fx").alias("cx0"), up("fy").alias("cy0")).withColumn("s", size)
            .withColumn("r2", F.lit(1.000001) * (fx * fx + fy * fy)).select("*", ring)
            .withColumn("cx", F.col("cx0") + F.col("st.i")).withColumn("cy", F.col("cy0") + F.col("st.j")))
    gap = lambda c, g, m: F.greatest(
        F.lit(m) + g * F.col("s") - F.col(c), F.col(c) - F.lit(m) - (g + 1) * F.col("s"), F.lit(0.0))
    gx, gy = gap("px", F.col("cx"), min_x), gap("py", F.col("cy"), min_y)
    asks = asks.where(gx * gx + gy * gy <= F.col("r2"))
    d2 = (F.col("bx") - F.col("px")) * (F.col("bx") - F.col("px")) + (F.col("by") - F.col("py")) * (F.col("by") - F.col("py"))
    met = (asks.select("id", "px", "py", "lv", "cx", "cy", "r2").join(candidates, ["lv", "cx", "cy"])
           .where((d2 <= F.col("r2")) | (F.col("lv") == 0)).select(F.col("id").alias("src"), "dst", d2.alias("d2")))
    if not include_self:
        met = met.where(F.col("src") != F.col("dst"))
    best = W.partitionBy("src").orderBy("d2", "dst")
    return (met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("src", "dst", F.sqrt("d2").alias("dist"), "rank"))


# ---------------------------------------------------------------- polygons

def bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda v: v["x"]), F.transform(ring, lambda v: v["y"])
    return {"minx": F.array_min(xs), "miny": F.array_min(ys), "maxx": F.array_max(xs), "maxy": F.array_max(ys)}


def _edges(ring: Column) -> Column:
    """Array of (a, b) consecutive vertices, closing the ring."""
    nxt = F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1))
    return F.arrays_zip(ring.alias("a"), nxt.alias("b"))


def inside(px: Column, py: Column, ring: Column) -> Column:
    """Strict containment (points on the outline are outside), even-odd rule."""
    def step(acc: Column, e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        side = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
        on = ((side == 0) & (px >= F.least(ax, bx)) & (px <= F.greatest(ax, bx))
              & (py >= F.least(ay, by)) & (py <= F.greatest(ay, by)))
        crosses = ((ay > py) != (by > py)) & ((side > 0) == (by > ay))
        return F.when(on, F.lit(-1_000_000)).otherwise(acc + crosses.cast("int"))

    hits = F.aggregate(_edges(ring), F.lit(0), step)
    return (hits > 0) & (hits % 2 == 1)


def roi_filter(points: DataFrame, ring: Sequence[tuple[float, float]], x: str = "x", y: str = "y") -> DataFrame:
    """Keep points strictly inside one region of interest.

    The bounding box is a plain predicate that reaches the scan; the outline is
    unrolled into a codegen expression.
    """
    px, py = F.col(x), F.col(y)
    xs, ys = [v[0] for v in ring], [v[1] for v in ring]
    boxed = points.where((px > min(xs)) & (px < max(xs)) & (py > min(ys)) & (py < max(ys)))
    if len(ring) > 64:
        lit_ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ring])
        return boxed.where(inside(px, py, lit_ring))
    crossings, on_edge = F.lit(0), F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, list(ring[1:]) + [ring[0]]):
        if (ax, ay) == (bx, by):
            continue
        side = F.lit(bx - ax) * (py - ay) - F.lit(by - ay) * (px - ax)
        on_edge = on_edge | ((side == 0) & px.between(min(ax, bx), max(ax, bx)) & py.between(min(ay, by), max(ay, by)))
        if ay != by:
            crossings = crossings + F.when(
                ((F.lit(ay) > py) != (F.lit(by) > py)) & ((side > 0) == F.lit(by > ay)), 1).otherwise(0)
    return boxed.where(~on_edge & (crossings % 2 == 1))


def _polygon_hits(points: DataFrame, shapes: DataFrame, bin_size: float, shape_id: str, ring: str, x: str, y: str) -> DataFrame:
    """Points left-joined to the polygon sides their ray to +x meets: (points…, shape_id, _hit).

    Sides, not rings, are joined: each polygon's sides go to the grid bins of
    the polygon's box whose rows the side spans, and only sides that straddle
    the point's height survive. All tests are plain generated code. A side
    through the point weighs a large negative number.
    """
    r = F.col(ring)
    s = (shapes.select(F.col(shape_id).alias("shape_id"), *[c.alias(f"_{n}") for n, c in bounds(r).items()], F.explode(_edges(r)).alias("_e"))
         .select("shape_id", "_minx", "_miny", "_maxx", "_maxy", F.col("_e.a.x").alias("_ax"), F.col("_e.a.y").alias("_ay"), F.col("_e.b.x").alias("_bx"), F.col("_e.b.y").alias("_by")))
    # a side is needed from the polygon's left border up to the side's right end
    cols = F.sequence(_bin(F.col("_minx"), bin_size), _bin(F.greatest("_ax", "_bx"), bin_size))
    rows = F.sequence(_bin(F.least("_ay", "_by"), bin_size), _bin(F.greatest("_ay", "_by"), bin_size))
    s = s.withColumn("gx", F.explode(cols)).withColumn("gy", F.explode(rows)).drop("_maxx", "_maxy", "_miny")
    p = points.withColumn("gx", _bin(F.col(x), bin_size)).withColumn("gy", _bin(F.col(y), bin_size))
    s, p = _split_hot_bins(s, p, ["gx", "gy"], 50 * BIN_ROWS)
    px, py = F.col(x), F.col(y)
    side = (F.col("_bx") - F.col("_ax")) * (py - F.col("_ay")) - (F.col("_by") - F.col("_ay")) * (px - F.col("_ax"))
    level = (F.least("_ay", "_by") <= py) & (F.greatest("_ay", "_by") >= py) & (F.greatest("_ax", "_bx") >= px) & (px >= F.col("_minx"))
    # a point on the side is seldom at zero exactly: the allowance is a few roundings of the coordinates
    reach = F.abs(F.col("_bx") - F.col("_ax")) + F.abs(F.col("_by") - F.col("_ay"))
    largest = F.greatest(*[F.abs(c) for c in (F.col("_ax"), F.col("_ay"), F.col("_bx"), F.col("_by"), px, py)])
    on = (F.abs(side) <= F.lit(1e-14) * reach * largest) & (px >= F.least("_ax", "_bx"))
    crosses = ((F.col("_ay") > py) != (F.col("_by") > py)) & ((side > 0) == (F.col("_by") > F.col("_ay")))
    cond = ((p["gx"] == s["gx"]) & (p["gy"] == s["gy"]) & (p["_s"] == s["_s"]) & level & (on | crosses))
    return p.join(s, cond, "left").select(*[p[c] for c in points.columns], "shape_id", F.when(on, -1_000_000).otherwise(1).alias("_hit"))


def points_in_polygons(points: DataFrame, shapes: DataFrame, bin_size: float, keys: Sequence[str], shape_id: str = "cell_id",
                       ring: str = "ring", x: str = "x", y: str = "y") -> DataFrame:
    """(keys…, shape_id): every polygon strictly containing a point. Rows with the same keys and place are one point."""
    at = list(dict.fromkeys([*keys, x, y]))
    h = _polygon_hits(points.select(*at).distinct(), shapes, bin_size, shape_id, ring, x, y).where(F.col("shape_id").isNotNull())
    g = h.groupBy(*at, "shape_id").agg(F.sum("_hit").alias("_h"))
    inside = g.where((F.col("_h") > 0) & (F.col("_h") % 2 == 1)).select(*keys, "shape_id")
    return inside if {x, y} <= set(keys) else inside.distinct()


def assign_first(points: DataFrame, shapes: DataFrame, bin_size: float, keys: Sequence[str], shape_id: str = "cell_id",
                 ring: str = "ring", x: str = "x", y: str = "y") -> DataFrame:
    """One polygon per key: the smallest id of those containing it, NULL if none. Rows with the same keys and place are one point.

    Polygons with the same outline are one polygon with the smallest of their ids, so copies of a shape cost nothing.
    """
    at = list(dict.fromkeys([*keys, x, y]))
    shapes = shapes.groupBy(ring).agg(F.min(shape_id).alias(shape_id))
    h = _polygon_hits(points.select(*at).distinct(), shapes, bin_size, shape_id, ring, x, y)
    g = h.groupBy(*at, "shape_id").agg(F.sum("_hit").alias("_h"))
    odd = (F.col("_h") > 0) & (F.col("_h") % 2 == 1)
    return g.groupBy(*keys).agg(F.min(F.when(odd, F.col("shape_id"))).alias("shape_id"))


def polygon_metrics(shapes: DataFrame, ring: str = "ring") -> DataFrame:
    """Area, centroid, bounds, perimeter and box aspect of each ring."""
    r = F.col(ring)
    e = _edges(r)
    cross = lambda v: v["a"]["x"] * v["b"]["y"] - v["b"]["x"] * v["a"]["y"]
    total = lambda f: F.aggregate(e, F.lit(0.0), lambda acc, v: acc + f(v))
    a2 = total(cross)
    out = shapes.withColumn("_a2", a2)
    out = (out.withColumn("area", F.abs(F.col("_a2")) / 2)
           .withColumn("cx", total(lambda v: (v["a"]["x"] + v["b"]["x"]) * cross(v)) / (3 * F.col("_a2")))
           .withColumn("cy", total(lambda v: (v["a"]["y"] + v["b"]["y"]) * cross(v)) / (3 * F.col("_a2")))
           .withColumn("perimeter", total(lambda v: F.sqrt(
               (v["a"]["x"] - v["b"]["x"]) * (v["a"]["x"] - v["b"]["x"])
               + (v["a"]["y"] - v["b"]["y"]) * (v["a"]["y"] - v["b"]["y"])))))
    for name, c in bounds(r).items():
        out = out.withColumn(name, c)
    w, h = F.col("maxx") - F.col("minx"), F.col("maxy") - F.col("miny")
    return out.withColumn("aspect", F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(0.1))).drop("_a2")


def affine(df: DataFrame, a: float, b: float, c: float, d: float, tx: float, ty: float,
           x: str = "x", y: str = "y") -> DataFrame:
    """(x, y) -> (a x + b y + tx, c x + d y + ty)."""
    nx = F.lit(a) * F.col(x) + F.lit(b) * F.col(y) + F.lit(tx)
    ny = F.lit(c) * F.col(x) + F.lit(d) * F.col(y) + F.lit(ty)
    return df.withColumns({x: nx, y: ny})


def transform_ring(ring: Column, sx: float = 1.0, sy: float = 1.0, tx: float = 0.0, ty: float = 0.0) -> Column:
    return F.transform(ring, lambda v: F.struct((v["x"] * F.lit(sx) + F.lit(tx)).alias("x"),
                                                (v["y"] * F.lit(sy) + F.lit(ty)).alias("y")))
