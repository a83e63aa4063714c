"""Delaunay graph from Voronoi cells of nearest neighbours."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cytogrid.operators.graph import inverse_distance
from cytogrid.operators.spatial import _cell, knn
from cytogrid.session import cut

SMALL = 1000  # unfinished points that may all meet each other
TILE_ROWS = 2000  # points of one tile whose cells are clipped together
CROWDED = 16 * TILE_ROWS  # points in and around a tile up to which its margin is brought along
MARGIN = 0.25  # in sides of the tile
FAR = 1e5  # clip box of unbounded cells, in units of the data extent


def _voronoi(dx: np.ndarray, dy: np.ndarray, ids: np.ndarray, box: float) -> tuple[list[int], float]:
    """Neighbours whose bisectors bound the cell of the origin, and the cell's reach.

    Clips a box by the bisector of each candidate, nearest first.
    """
    poly = [(-box, -box), (box, -box), (box, box), (-box, box)]
    owner = [-1, -1, -1, -1]  # owner[i]: candidate behind the side from vertex i to i+1
    reach2 = 2 * box * box
    for a, b, n in zip(dx, dy, range(len(ids))):
        d2 = a * a + b * b
        if d2 == 0.0:
            continue
        if d2 > 4 * reach2:
            break
        side = [x * a + y * b - d2 / 2 for x, y in poly]
        if max(side) <= 0:
            continue
        new, own = [], []
        m = len(poly)
        for i in range(m):
            j = (i + 1) % m
            if side[i] <= 0:
                new.append(poly[i])
                own.append(owner[i])
            if (side[i] <= 0) != (side[j] <= 0):
                t = side[i] / (side[i] - side[j])
                new.append((poly[i][0] + t * (poly[j][0] - poly[i][0]), poly[i][1] + t * (poly[j][1] - poly[i][1])))
                own.append(n if side[i] <= 0 else owner[i])
        poly, owner = new, own
        reach2 = max(x * x + y * y for x, y in poly)
    return sorted({int(ids[o]) for o in owner if o >= 0}), math.sqrt(reach2)


def _cells(box: float):
    def run(batches):
        for pdf in batches:
            out = []
            for src, x, y, ids, nx, ny, horizon in zip(pdf["id"], pdf["px"], pdf["py"], pdf["nid"], pdf["nx"], pdf["ny"], pdf["horizon"]):
                dx, dy = nx - x, ny - y
                order = np.lexsort((ids, dx * dx + dy * dy))
                found, reach = _voronoi(dx[order], dy[order], ids[order], box)
                out.append((src, found, bool(horizon >= 2 * reach)))
            yield pd.DataFrame(out, columns=["id", "found", "done"])
    return run


def _tile_cells(box: float, bounds: tuple, side: float, k: int):
    """Cells of the own points of one tile from the points in it and in its margin; see ``_by_tile``."""
    min_x, max_x, min_y, max_y = bounds
    inf = math.inf

    def run(key, rows):
        lv, cx, cy = (int(v) for v in key)
        s = side / 2.0 ** lv
        own, x, y, ids = rows["own"].to_numpy(), rows["px"].to_numpy(), rows["py"].to_numpy(), rows["id"].to_numpy()
        mine, m = np.flatnonzero(own), len(rows)
        out = []
        if len(mine) <= CROWDED:
            width = s * MARGIN * (1 - 1e-6) if rows["wide"].iloc[0] else -1e-6 * s
            x0, x1, y0, y1 = min_x + cx * s - width, min_x + (cx + 1) * s + width, min_y + cy * s - width, min_y + (cy + 1) * s + width
            # beyond the outermost point there is nothing to miss
            x0, x1, y0, y1 = (-inf if x0 <= min_x else x0), (inf if x1 >= max_x else x1), (-inf if y0 <= min_y else y0), (inf if y1 >= max_y else y1)
            step = max(1, 2_000_000 // max(m, 1))
            for part in (mine[i:i + step] for i in range(0, len(mine), step)):
                dx, dy = x[None, :] - x[part, None], y[None, :] - y[part, None]
                d2 = dx * dx + dy * dy
                near = np.argpartition(d2, k, axis=1)[:, :k + 1] if m > k + 1 else None
                for row, i in enumerate(part.tolist()):
                    limit = max(min(x[i] - x0, x1 - x[i], y[i] - y0, y1 - y[i]), 0.0)
                    pick, size = (near[row] if near is not None else np.arange(m)), k
                    while True:
                        d = d2[row, pick]
                        horizon = min(limit, math.sqrt(d.max())) if len(pick) < m else limit
                        order = pick[np.lexsort((ids[pick], d))]
                        found, reach = _voronoi(dx[row, order], dy[row, order], ids[order], box)
                        if horizon >= 2 * reach or horizon == limit:
                            break
                        size *= 4
                        pick = np.argpartition(d2[row], size)[:size + 1] if m > size + 1 else np.arange(m)
                    out.append((ids[i], x[i], y[i], found, bool(horizon >= 2 * reach)))
        else:  # too many points at a spot that the tiles do not divide
            out = [(ids[i], x[i], y[i], [], False) for i in mine.tolist()]
        return pd.DataFrame(out, columns=["id", "px", "py", "found", "done"])
    return run


def _by_tile(p: DataFrame, bounds: tuple, box: float, k: int) -> DataFrame:
    """(id, px, py, found, done): cells as far as the points of one tile and its margin tell them.

    Tiles are the largest quadtree cells of at most TILE_ROWS points. A point goes to
    its own tile and to those whose margin it lies in, so what is shuffled is a few
    rows for each point, and candidates are compared inside a tile only. Tiles beside
    a crowd go without their margin. A point is done if all that could touch its cell
    was there.
    """
    min_x, max_x, min_y, max_y = bounds
    side = max(max_x - min_x, max_y - min_y, 1e-9) * (1 + 1e-9)
    depth = 0
    while True:
        occupied = cut(p.select(*_cell(depth, min_x, min_y, side)).groupBy("fx", "fy").agg(F.count(F.lit(1)).alias("n")))
        most = occupied.agg(F.max("n")).first()[0] or 0
        if most <= TILE_ROWS or depth >= 24:
            break
        depth = min(24, depth + max(1, math.ceil(math.log(most / TILE_ROWS, 4))))
    up = lambda c: F.expr(f"shiftright({c}, {depth} - lv)")
    pyramid = (occupied.select("*", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("lv")).select("*", up("fx").alias("cx"), up("fy").alias("cy")))
    sums = cut(pyramid.groupBy("lv", "cx", "cy").agg(F.sum("n").alias("n")))
    chosen = pyramid.drop("n").join(sums.where((F.col("n") <= TILE_ROWS) | (F.col("lv") == depth)).select("lv", "cx", "cy"), ["lv", "cx", "cy"]).groupBy("fx", "fy").agg(F.min("lv").alias("lv"))
    tiles = chosen.select("lv", up("fx").alias("cx"), up("fy").alias("cy")).distinct()
    steps = lambda far: F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in far for j in far])).alias("st")
    at = lambda c, d: (F.col(c) + F.col(f"st.{d}")).alias(c)
    around = sums.select("lv", "cx", "cy", "n", steps((-1, 0, 1))).select("lv", at("cx", "i"), at("cy", "j"), "n").groupBy("lv", "cx", "cy").agg((F.sum("n") <= CROWDED).alias("wide"))
    tiles = cut(tiles.join(around, ["lv", "cx", "cy"]))
    in_use = sorted(row[0] for row in tiles.select("lv").distinct().collect())  # at most 25 numbers

    size = F.lit(side) / F.pow(F.lit(2.0), F.col("lv"))
    part = lambda c, cell, low: (F.col(c) - F.lit(min_x if low else min_y)) / size - F.col(cell)
    moved = (p.select("id", "px", "py", *_cell(depth, min_x, min_y, side), F.explode(F.array(*[F.lit(v) for v in in_use] or [F.lit(0)])).alias("lv"))
             .select("id", "px", "py", "lv", up("fx").alias("cx"), up("fy").alias("cy")).select("*", part("px", "cx", True).alias("u"), part("py", "cy", False).alias("v"), steps((-1, 0, 1))))
    reaches = lambda frac, d: (F.col(f"st.{d}") == 0) | ((F.col(f"st.{d}") < 0) & (F.col(frac) <= MARGIN)) | ((F.col(f"st.{d}") > 0) & (F.col(frac) >= 1 - MARGIN))
    dealt = (moved.where(reaches("u", "i") & reaches("v", "j"))
             .select("id", "px", "py", "lv", at("cx", "i"), at("cy", "j"), ((F.col("st.i") == 0) & (F.col("st.j") == 0)).alias("own"))
             .join(tiles, ["lv", "cx", "cy"]).where(F.col("own") | F.col("wide")))
    # a fixed partition count: rows are few bytes but cost Python time
    tasks = max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), p.count() // 50_000)
    return dealt.repartition(tasks, "lv", "cx", "cy").groupBy("lv", "cx", "cy").applyInPandas(_tile_cells(box, bounds, side, k), "id long, px double, py double, found array<long>, done boolean")


def _chain(x: np.ndarray, y: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Positions of the convex hull's points in turn, points on its sides included."""
    order = np.lexsort((ids, y, x)).tolist()
    xs, ys = x.tolist(), y.tolist()

    def half(run):
        out = []
        for i in run:
            while len(out) > 1 and (xs[out[-1]] - xs[out[-2]]) * (ys[i] - ys[out[-2]]) - (ys[out[-1]] - ys[out[-2]]) * (xs[i] - xs[out[-2]]) < 0:
                out.pop()
            out.append(i)
        return out
    low, high = half(order), half(order[::-1])
    return np.array(low[:-1] + high[:-1] if len(order) > 1 else order, dtype=np.int64)


def hull_edges(points: DataFrame) -> DataFrame:
    """Sides of the convex hull of (id, px, py): they are edges of every triangulation, however flat the rim is.

    Hulls of partitions are merged in ever fewer partitions, so that the last
    task sees hull points only.
    """
    def prune(batches):
        rows = pd.concat(list(batches) or [pd.DataFrame({"id": [], "px": [], "py": []})])
        keep = rows.iloc[np.unique(_chain(rows.px.to_numpy(float), rows.py.to_numpy(float), rows.id.to_numpy()))] if len(rows) else rows
        yield keep.astype({"id": "int64"})

    def sides(batches):
        rows = pd.concat(list(batches) or [pd.DataFrame({"id": [], "px": [], "py": []})])
        ids = rows.id.to_numpy()[_chain(rows.px.to_numpy(float), rows.py.to_numpy(float), rows.id.to_numpy())] if len(rows) else rows.id.to_numpy()
        pairs = {(min(a, b), max(a, b)) for a, b in zip(ids.tolist(), np.roll(ids, -1).tolist()) if a != b}
        yield pd.DataFrame({"src": [int(a) for a, _ in pairs], "dst": [int(b) for _, b in pairs]}, dtype="int64")

    rows = points.select(F.col("id").cast("long").alias("id"), "px", "py").mapInPandas(prune, "id long, px double, py double")
    for n in (64, 8):
        rows = rows.repartition(n).mapInPandas(prune, "id long, px double, py double")
    return rows.repartition(1).mapInPandas(sides, "src long, dst long")


def delaunay_graph(points: DataFrame, k: int = 32, id_col: str = "cell_id", x: str = "x", y: str = "y", max_rounds: int = 30) -> DataFrame:
    """Exact Delaunay edges (src < dst, dist, weight = 1/dist) of distinct points.

    A point's cell is final once its k-th neighbour is farther than twice the
    cell's reach. The first round takes neighbours from quadtree tiles with a
    margin. Points not final (near the rim or beside a crowd) meet again among
    themselves together with the edges already found towards them: their
    remaining neighbours can only be other unfinished points. Groups of these
    rounds are k + known edges, never a tile. Ids are integers.
    """
    p = points.groupBy(F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).agg(F.min(id_col).alias("id"))
    p = cut(p.select("id", "px", "py"))
    bounds = tuple(p.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first())
    e = [bounds[i + 1] - bounds[i] if bounds[i] is not None else None for i in (0, 2)]
    box = FAR * max(e[0] or 1.0, e[1] or 1.0, 1e-9)
    edges, todo = None, p
    if None not in bounds:
        got = cut(_by_tile(p, bounds, box, k))
        edges = got.where("done").select(F.col("id").alias("src"), F.explode("found").alias("dst"))
        todo = cut(got.where("not done").select("id", "px", "py"))
    for _ in range(max_rounds):
        n = todo.count()
        if n == 0:
            break
        if n <= SMALL:  # a bounded rest is settled at once
            k = max(k, n)
        near = knn(todo, k, "id", "px", "py")
        # with at most k others every candidate is known: the horizon is infinite
        horizon = F.lit(math.inf) if n <= k + 1 else F.max("dist")
        cand = near.select(F.col("src").alias("id"), F.col("dst").alias("nid"), "dist")
        reach = cand.groupBy("id").agg(horizon.alias("horizon"))
        if edges is not None:  # edges found by finished neighbours
            known = edges.select(F.col("dst").alias("id"), F.col("src").alias("nid")).join(todo.select("id"), "id", "left_semi")
            cand = cand.select("id", "nid").unionByName(known).distinct()
        packed = (cand.join(p.select(F.col("id").alias("nid"), F.col("px").alias("nx"), F.col("py").alias("ny")), "nid")
                  .groupBy("id").agg(F.collect_list(F.struct("nid", "nx", "ny")).alias("_q"))
                  .select("id", *[F.col(f"_q.{c}").alias(c) for c in ("nid", "nx", "ny")]))
        tasks = max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 50_000)
        # a fixed partition count: rows are few bytes but cost Python time
        work = todo.join(packed, "id").join(reach, "id", "left").withColumn("horizon", F.coalesce("horizon", F.lit(math.inf))).repartition(tasks, "id")
        got = cut(work.mapInPandas(_cells(box), "id long, found array<long>, done boolean"))
        final = got.where("done").select(F.col("id").alias("src"), F.explode("found").alias("dst"))
        edges = final if edges is None else edges.unionByName(final)
        left = cut(todo.join(got.where("not done").select("id"), "id", "left_semi"))
        if left.count() > n // 2:
            k *= 4
        todo = left
    else:
        raise RuntimeError("Delaunay cells did not settle")
    edges = hull_edges(p) if edges is None else edges.unionByName(hull_edges(p))
    und = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    at = lambda end: p.select(F.col("id").alias(end), F.col("px").alias(f"x_{end}"), F.col("py").alias(f"y_{end}"))
    d = F.sqrt((F.col("x_src") - F.col("x_dst")) ** 2 + (F.col("y_src") - F.col("y_dst")) ** 2)
    return und.join(at("src"), "src").join(at("dst"), "dst").select("src", "dst", d.alias("dist")).withColumn("weight", inverse_distance(F.col("dist")))
