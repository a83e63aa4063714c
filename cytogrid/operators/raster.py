"""Label rasters as sparse pixels (y, x, label); background pixels have no row."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from cytogrid.operators.ordering import exact_quantiles, global_rank

# fixed values: neighbour codes of the perimeter estimate and their weights
PERIMETER_WEIGHTS = {5: 1.0, 7: 1.0, 15: 1.0, 17: 1.0, 25: 1.0, 27: 1.0, 21: math.sqrt(2), 33: math.sqrt(2),
                     13: (1 + math.sqrt(2)) / 2, 23: (1 + math.sqrt(2)) / 2}


def region_table(px: DataFrame) -> DataFrame:
    """Area, centroid, box, extent, eccentricity per label, one aggregation."""
    g = px.groupBy("label").agg(
        F.count(F.lit(1)).alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.min("x").alias("x0"), F.max("x").alias("x1"), F.var_pop("y").alias("_a"), F.var_pop("x").alias("_b"), F.covar_pop("y", "x").alias("_c"))
    half = (F.col("_a") + F.col("_b")) / 2
    root = F.sqrt(4 * F.col("_c") * F.col("_c") + (F.col("_a") - F.col("_b")) * (F.col("_a") - F.col("_b"))) / 2
    ecc = F.when(half + root > 0, F.sqrt(F.greatest(1 - (half - root) / (half + root), F.lit(0.0)))).otherwise(0.0)
    box = (F.col("y1") - F.col("y0") + 1) * (F.col("x1") - F.col("x0") + 1)
    return g.withColumn("eccentricity", ecc).withColumn("extent", F.col("area") / box).drop("_a", "_b", "_c")


def _shifted(px: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(i).alias("dy"), F.lit(j).alias("dx")) for i, j in steps])
    return px.withColumn("_st", F.explode(arr)).select((F.col("y") + F.col("_st.dy")).alias("y"), (F.col("x") + F.col("_st.dx")).alias("x"),
                                                       F.col("label").alias("_from"), F.col("_st.dy").alias("_dy"), F.col("_st.dx").alias("_dx"))


def boundary(px: DataFrame) -> DataFrame:
    """Inner boundary: pixels with a 4-neighbour of another label or background.

    Same-label neighbours are counted by aggregation on shifted copies; a pixel
    with four of them is interior. No self-join.
    """
    ones = px.select("y", "x", "label", F.lit(1).alias("_own")).unionByName(
        _shifted(px, [(-1, 0), (1, 0), (0, -1), (0, 1)]).select("y", "x", F.col("_from").alias("label"), F.lit(0).alias("_own")))
    return (ones.groupBy("y", "x", "label").agg(F.sum("_own").alias("_o"), F.count(F.lit(1)).alias("_n"))
            .where((F.col("_o") == 1) & (F.col("_n") < 5)).select("y", "x", "label"))


def perimeter(px: DataFrame) -> DataFrame:
    """(label, perimeter): border pixels weighted by the pattern of their border neighbours."""
    b = boundary(px)
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]
    spread = _shifted(b, near).select("y", "x", F.col("_from").alias("label"), F.when(F.col("_dy") * F.col("_dx") == 0, 2).otherwise(10).alias("_w"))
    code = (spread.unionByName(b.select("y", "x", "label", F.lit(1).alias("_w"))).groupBy("y", "x", "label").agg(F.sum("_w").alias("_c"))
            .where(F.col("_c") % 2 == 1))  # only border pixels carry the odd own weight
    w = F.lit(0.0)
    for k, v in PERIMETER_WEIGHTS.items():
        w = F.when(F.col("_c") == k, F.lit(v)).otherwise(w)
    return code.groupBy("label").agg(F.sum(w).alias("perimeter"))


@F.pandas_udf(DoubleType())
def _hull_area(points: pd.Series) -> pd.Series:
    """Area of the convex hull of each list of (x, y) points, monotone chain."""
    def one(pts) -> float:
        p = sorted({(float(q["x"]), float(q["y"])) for q in pts})
        if len(p) < 3:
            return 0.0
        hull: list[tuple[float, float]] = []
        for seq in (p, p[::-1]):
            start = len(hull)
            for q in seq:
                while len(hull) - start >= 2 and ((hull[-1][0] - hull[-2][0]) * (q[1] - hull[-2][1]) - (hull[-1][1] - hull[-2][1]) * (q[0] - hull[-2][0])) <= 0:
                    hull.pop()
                hull.append(q)
            hull.pop()
        a = np.array(hull)
        return float(abs(np.dot(a[:, 0], np.roll(a[:, 1], -1)) - np.dot(a[:, 1], np.roll(a[:, 0], -1))) / 2)
    return points.map(one)


def hull_area(ring: Column) -> Column:
    return _hull_area(ring)


def solidity(px: DataFrame) -> DataFrame:
    """(label, hull_area, solidity) with the hull over pixel corners.

    Each label sends only the two extreme pixels of its rows to the hull, at
    most 4 corners per raster row.
    """
    rows = px.groupBy("label", "y").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count(F.lit(1)).alias("n"))
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    corners = F.array(pt(F.col("a"), F.col("y")), pt(F.col("a"), F.col("y") + 1), pt(F.col("b") + 1, F.col("y")), pt(F.col("b") + 1, F.col("y") + 1))
    g = rows.groupBy("label").agg(F.flatten(F.collect_list(corners)).alias("_pts"), F.sum("n").alias("_area"))
    h = g.select("label", "_area", hull_area(F.col("_pts")).alias("hull_area"))
    return h.select("label", "hull_area", (F.col("_area") / F.col("hull_area")).alias("solidity"))


def region_properties(px: DataFrame, with_hull: bool = True) -> DataFrame:
    """region_table + perimeter, compactness, perimeter ratio and (optionally) solidity."""
    t = region_table(px).join(perimeter(px), "label", "left").fillna(0.0, ["perimeter"])
    a = F.col("area").cast("double")
    t = (t.withColumn("compactness", 4 * math.pi * a / (F.col("perimeter") * F.col("perimeter") + 1e-10))
         .withColumn("perimeter_ratio", F.col("perimeter") / (F.sqrt(a) + 1e-10)))
    if with_hull:
        t = t.join(solidity(px), "label").withColumn("convexity_deficit", 1 - F.col("solidity"))
    return t


def rejection_reasons(props: DataFrame, min_absolute_area: float = 0, min_area: str | float | None = None, max_area: float | None = None,
                      area_std: float | None = None, max_eccentricity: float | None = None, min_solidity: float | None = None,
                      max_solidity: float | None = None, min_extent: float | None = None, max_extent: float | None = None,
                      min_compactness: float | None = None, max_convexity_deficit: float | None = None,
                      max_perimeter_ratio: float | None = None) -> DataFrame:
    """First failing criterion per region in column ``reason`` (NULL = kept).

    ``min_area``: 'median', 'median_div2', a percentile 0-100, or above 100 an absolute area.
    """
    relative = min_area in ("median", "median_div2") or (isinstance(min_area, (int, float)) and 0 <= min_area <= 100)
    one = props.agg(F.avg("area").alias("_m"), F.stddev_pop("area").alias("_s"))
    if relative:
        q = 0.5 if isinstance(min_area, str) else min_area / 100.0
        one = one.crossJoin(exact_quantiles(props, "area", {"_q": q}))
    limit = F.lit(float(min_area)) if isinstance(min_area, (int, float)) and not relative else (
        F.col("_q") / 2 if min_area == "median_div2" else F.col("_q") if relative else F.lit(0.0))
    c = F.col
    rules: list[tuple[str, Column]] = [("tiny_artifacts", c("area") < min_absolute_area), ("too_small", c("area") < limit)]
    if max_area is not None:
        rules.append(("too_large", c("area") > max_area))
    if area_std is not None:
        rules.append(("area_outliers", (c("area") < c("_m") - area_std * c("_s")) | (c("area") > c("_m") + area_std * c("_s"))))
    for name, col, low, high in (("too_eccentric", "eccentricity", None, max_eccentricity), ("too_convex", "solidity", None, max_solidity),
                                 ("too_concave", "solidity", min_solidity, None), ("too_sparse", "extent", min_extent, None),
                                 ("too_rectangular", "extent", None, max_extent), ("low_compactness", "compactness", min_compactness, None),
                                 ("high_convexity_deficit", "convexity_deficit", None, max_convexity_deficit),
                                 ("irregular_perimeter", "perimeter_ratio", None, max_perimeter_ratio)):
        if low is not None:
            rules.append((name, c(col) < low))
        if high is not None:
            rules.append((name, c(col) > high))
    reason = F.lit(None).cast("string")
    for name, test in reversed(rules):
        reason = F.when(test, name).otherwise(reason)
    return props.crossJoin(F.broadcast(one)).withColumn("reason", reason).select(*props.columns, "reason")  # one row


def keep_labels(px: DataFrame, labels: DataFrame, relabel: bool = True) -> DataFrame:
    """Pixels of the listed labels, optionally renumbered 1..n by label."""
    if not relabel:
        return px.join(labels.select("label"), "label", "left_semi").select("y", "x", "label")
    lut = global_rank(labels.select("label").distinct(), ["label"], "_new")
    return px.join(lut, "label").select("y", "x", F.col("_new").cast("int").alias("label"))


def remove_large(px: DataFrame, max_area: int) -> DataFrame:
    big = px.groupBy("label").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_area)
    return px.join(big, "label", "left_anti").select("y", "x", "label")


def tissue_labels(regions: DataFrame, intensity: DataFrame, pct: float = 2.0, reach: int = 20) -> DataFrame:
    """Labels whose centroid pixel lies in the dilated tissue mask.

    Tissue = intensity above the ``pct`` percentile of non-zero pixels; ``reach``
    steps of 4-neighbour dilation = city-block distance at most ``reach``.
    Existence test per centroid (semi join on bins), no dilated raster.
    """
    nz = intensity.where(F.col("v") > 0)
    thr = exact_quantiles(nz, "v", {"_t": pct / 100.0})
    b = max(reach, 1)
    tissue = (nz.crossJoin(F.broadcast(thr)).where(F.col("v") > F.col("_t"))  # one row
              .select(F.col("y").alias("ty"), F.col("x").alias("tx"), F.floor(F.col("y") / b).alias("gy"), F.floor(F.col("x") / b).alias("gx")))
    ring = F.sequence(F.lit(-1), F.lit(1))
    c = (regions.select("label", F.col("cy").cast("int").alias("py"), F.col("cx").cast("int").alias("px")).withColumn("i", F.explode(ring)).withColumn("j", F.explode(ring))
         .withColumn("gy", F.floor(F.col("py") / b) + F.col("i")).withColumn("gx", F.floor(F.col("px") / b) + F.col("j")))
    near = F.abs(F.col("py") - F.col("ty")) + F.abs(F.col("px") - F.col("tx")) <= reach
    hit = c.alias("c").join(tissue.alias("t"), (F.col("c.gy") == F.col("t.gy")) & (F.col("c.gx") == F.col("t.gx")) & near, "left_semi")
    return hit.select("label").distinct()


def lookup_points(points: DataFrame, px: DataFrame, scale: float, x0: int = 0, y0: int = 0, width: int | None = None,
                  height: int | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Label under each point: pixel = int(coord / scale - origin), clipped; 0 = unassigned."""
    col = (F.col(x) / F.lit(scale) - x0).cast("int")
    row = (F.col(y) / F.lit(scale) - y0).cast("int")
    clip = lambda c, m: F.greatest(F.lit(0), c if m is None else F.least(c, F.lit(m - 1)))
    p = points.withColumn("_px", clip(col, width)).withColumn("_py", clip(row, height))
    r = px.select(F.col("y").alias("_py"), F.col("x").alias("_px"), F.col("label"))
    return p.join(r, ["_py", "_px"], "left").withColumn("label", F.coalesce("label", F.lit(0))).drop("_px", "_py")


def overlap_iou(a: DataFrame, b: DataFrame, min_iou: float = 0.3) -> DataFrame:
    """(label_a, label_b, inter, iou) of overlapping label pairs of two layers."""
    area = lambda d, n: d.groupBy(F.col("label").alias(f"label_{n}")).agg(F.count(F.lit(1)).alias(f"area_{n}"))
    j = (a.select("y", "x", F.col("label").alias("label_a")).join(b.select("y", "x", F.col("label").alias("label_b")), ["y", "x"])
         .groupBy("label_a", "label_b").agg(F.count(F.lit(1)).alias("inter")))
    iou = F.col("inter") / (F.col("area_a") + F.col("area_b") - F.col("inter"))
    return j.join(area(a, "a"), "label_a").join(area(b, "b"), "label_b").withColumn("iou", iou).where(F.col("iou") >= min_iou)


def seam_dedup(pairs: DataFrame, patch_dist: DataFrame, seam_dist: DataFrame) -> DataFrame:
    """Which layer loses each overlapping pair: the cell nearer its own border is suppressed.

    ``patch_dist``/``seam_dist``: (label, dist). Order-free: all pairs are judged
    on the original rasters. Returns (layer, label) to suppress.
    """
    j = (pairs.join(patch_dist.select(F.col("label").alias("label_a"), F.col("dist").alias("da")), "label_a")
         .join(seam_dist.select(F.col("label").alias("label_b"), F.col("dist").alias("db")), "label_b"))
    win = F.col("da") >= F.col("db")
    return j.select(F.when(win, "seam").otherwise("patch").alias("layer"), F.when(win, F.col("label_b")).otherwise(F.col("label_a")).alias("label")).distinct()


def merge_layers(patch: DataFrame, seam: DataFrame) -> DataFrame:
    """Patch pixels win; free pixels take the seam label shifted past the patch maximum; renumbered 1..n."""
    top = patch.agg(F.coalesce(F.max("label"), F.lit(0)).alias("_top"))
    fill = seam.join(patch, ["y", "x"], "left_anti").crossJoin(F.broadcast(top)).select("y", "x", (F.col("label") + F.col("_top")).alias("label"))  # one row
    both = patch.select("y", "x", "label").unionByName(fill)
    return keep_labels(both, both)


def upscale(px: DataFrame, factor: int) -> DataFrame:
    """Nearest-neighbour enlargement: each pixel becomes factor x factor pixels."""
    step = F.sequence(F.lit(0), F.lit(factor - 1))
    return (px.withColumn("_i", F.explode(step)).withColumn("_j", F.explode(step))
            .select((F.col("y") * factor + F.col("_i")).alias("y"), (F.col("x") * factor + F.col("_j")).alias("x"), "label"))


def place_patches(px: DataFrame, offsets: DataFrame, boxes_clear: bool = True, height: int | None = None, width: int | None = None,
                  bin_size: int = 512) -> DataFrame:
    """Patches on one canvas, ids made global, later patches overwriting earlier ones.

    ``px``: (patch, y, x, label) in patch coordinates; ``offsets``: (patch, oy, ox, h, w).
    With ``boxes_clear`` a later patch's box also erases what lies under its background.
    """
    from cytogrid.operators.summaries import offset_ids
    g = offset_ids(px, "patch", "label").join(offsets, "patch")
    y, x = F.col("y") + F.col("oy"), F.col("x") + F.col("ox")
    g = g.select("patch", y.alias("y"), x.alias("x"), F.col("global_id").alias("label"))
    if height is not None:
        g = g.where((F.col("y") < height) & (F.col("x") < width))
    best = g.groupBy("y", "x").agg(F.max_by("label", "patch").alias("label"), F.max("patch").alias("patch"))
    if boxes_clear:
        o = offsets.select(F.col("patch").alias("_p"), *[F.col(c).alias(f"_{c}") for c in ("oy", "ox", "h", "w")])
        o = o.withColumn("_by", F.explode(F.expr(f"sequence(floor(_oy / {bin_size}), floor((_oy + _h - 1) / {bin_size}))"))).withColumn("_bx", F.explode(F.expr(f"sequence(floor(_ox / {bin_size}), floor((_ox + _w - 1) / {bin_size}))")))
        # a later box over the pixel wipes it; boxes meet pixels by the bins they cover
        later = ((F.floor(F.col("y") / bin_size) == F.col("_by")) & (F.floor(F.col("x") / bin_size) == F.col("_bx"))
                 & (F.col("_p") > F.col("patch")) & (F.col("y") >= F.col("_oy")) & (F.col("y") < F.col("_oy") + F.col("_h"))
                 & (F.col("x") >= F.col("_ox")) & (F.col("x") < F.col("_ox") + F.col("_w")))
        best = best.join(o, later, "left_anti")
    return best.select("y", "x", "label")


def blend_tiles(values: DataFrame, uncovered: float = -10.0, grid: DataFrame | None = None) -> DataFrame:
    """Weighted mean of overlapping tiles: weight = distance to the tile edge / its maximum.

    ``values``: (tile, h, w, i, j, y, x, v), i/j the pixel inside the tile.
    With ``grid`` (y, x) uncovered pixels get ``uncovered``.
    """
    edge = F.least(F.col("i") + 1, F.col("h") - F.col("i"), F.col("j") + 1, F.col("w") - F.col("j"))
    peak = F.least(F.floor((F.col("h") + 1) / 2), F.floor((F.col("w") + 1) / 2))
    wt = edge / peak
    out = values.groupBy("y", "x").agg((F.sum(wt * F.col("v")) / F.sum(wt)).alias("v"))
    if grid is None:
        return out
    return grid.join(out, ["y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(float(uncovered))))


def rasterize_polygons(shapes: DataFrame, shape_id: str = "cell_id", ring: str = "ring") -> DataFrame:
    """Pixels (y, x, label) whose centre (x + 0.5, y + 0.5) lies in a polygon, by the even-odd rule.

    Every side is cut by the pixel rows it spans; between a row's sorted cuts lie
    its spans, closed on the left and open on the right, so polygons that share
    a side share no pixel. Where polygons overlap the largest id wins. A null or
    empty ring has no pixels; a ring may repeat its first vertex at the end.
    """
    from cytogrid.operators.spatial import _edges
    e = shapes.where(F.size(ring) > 2).select(F.col(shape_id).alias("label"), F.explode(_edges(F.col(ring))).alias("e"))
    e = e.select("label", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))
    pixels = lambda lo, hi: F.sequence(F.ceil(lo - 0.5), F.ceil(hi - 0.5) - 1)
    cut_by = e.where(F.ceil(F.least("ay", "by") - 0.5) < F.ceil(F.greatest("ay", "by") - 0.5)).withColumn("y", F.explode(pixels(F.least("ay", "by"), F.greatest("ay", "by"))))
    at = F.col("ax") + (F.col("y") + 0.5 - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    rows = cut_by.groupBy("label", "y").agg(F.sort_array(F.collect_list(at)).alias("c"))  # cuts of one polygon in one row
    spans = rows.select("label", "y", F.explode(F.expr("transform(sequence(0, size(c) - 2, 2), i -> struct(c[i] as lo, c[i + 1] as hi))")).alias("s"))
    filled = spans.where(F.ceil(F.col("s.lo") - 0.5) < F.ceil(F.col("s.hi") - 0.5)).select("label", "y", F.explode(pixels(F.col("s.lo"), F.col("s.hi"))).alias("x"))
    return filled.groupBy(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x")).agg(F.max("label").alias("label"))


def outlines(px: DataFrame, max_area: int | None = None) -> DataFrame:
    """Outline of the largest part of each label as (label, ring, n_vertices).

    Labels of any size are traced; ``max_area`` removes larger ones first, where
    that is wanted. One group holds the boundary sides of one label.
    """
    kept = px if max_area is None else remove_large(px, max_area)
    inner = boundary(kept)
    # directed unit sides of boundary pixels whose outer neighbour differs, interior on the left
    sides = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(ax).alias("ax"), F.lit(ay).alias("ay"), F.lit(bx).alias("bx"), F.lit(by).alias("by"))
                      for dy, dx, ax, ay, bx, by in ((-1, 0, 1, 0, 0, 0), (0, -1, 0, 0, 0, 1), (1, 0, 0, 1, 1, 1), (0, 1, 1, 1, 1, 0))])
    cand = inner.withColumn("s", F.explode(sides)).select("label", "y", "x", "s", (F.col("y") + F.col("s.dy")).alias("ny"), (F.col("x") + F.col("s.dx")).alias("nx"))
    nbr = kept.select(F.col("y").alias("ny"), F.col("x").alias("nx"), "label")
    seg = cand.join(nbr, ["ny", "nx", "label"], "left_anti").select(
        "label", (F.col("x") + F.col("s.ax")).alias("ax"), (F.col("y") + F.col("s.ay")).alias("ay"), (F.col("x") + F.col("s.bx")).alias("bx"), (F.col("y") + F.col("s.by")).alias("by"))
    return seg.groupBy("label").applyInPandas(_stitch, "label int, ring array<struct<x:double,y:double>>, n_vertices int")


def _stitch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Chain directed unit sides into loops and keep the one with the largest area."""
    nxt: dict = {}
    for a, b in zip(zip(pdf.ax, pdf.ay), zip(pdf.bx, pdf.by)):
        nxt.setdefault(a, []).append(b)
    best: list = []
    best_area = -1.0
    while nxt:
        start = at = min(nxt)
        prev, ring = None, []
        while True:
            ring.append(at)
            out = nxt[at]
            k = 0
            if len(out) > 1 and prev is not None:  # touching corners: turn right, staying on one 4-connected part
                d = (at[0] - prev[0], at[1] - prev[1])
                k = min(range(len(out)), key=lambda i: d[0] * (out[i][1] - at[1]) - d[1] * (out[i][0] - at[0]))
            prev, to = at, out.pop(k)
            if not out:
                del nxt[at]
            at = to
            if at == start:
                break
        p = np.array(ring, float)
        area = abs(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1))) / 2
        if area > best_area:
            best, best_area = ring, area
    p = np.array(best, float)
    turn = np.cross(p - np.roll(p, 1, 0), np.roll(p, -1, 0) - p) != 0
    corners = p[turn]
    ring = [{"x": float(a), "y": float(b)} for a, b in np.vstack([corners, corners[:1]])]
    return pd.DataFrame({"label": [int(pdf.label.iloc[0])], "ring": [ring], "n_vertices": [len(ring) - 1]})


def components(px: DataFrame) -> DataFrame:
    """4-connected components of the foreground: (y, x, label = component number by first pixel)."""
    from cytogrid.operators.graph import components as graph_components
    w = px.agg((F.max("x") - F.min("x") + 1).cast("long").alias("_w"), F.min("x").alias("_x0"))
    p = px.crossJoin(F.broadcast(w)).select("y", "x", "_w", (F.col("y") * F.col("_w") + F.col("x") - F.col("_x0")).alias("cell_id"))  # one row
    right = p.select((F.col("x") + 1).alias("x"), "y", F.col("cell_id").alias("src")).join(p.select("x", "y", F.col("cell_id").alias("dst")), ["x", "y"])
    down = p.select("x", (F.col("y") + 1).alias("y"), F.col("cell_id").alias("src")).join(p.select("x", "y", F.col("cell_id").alias("dst")), ["x", "y"])
    comp = graph_components(right.select("src", "dst").unionByName(down.select("src", "dst")), p)
    lut = global_rank(comp.select("component").distinct(), ["component"], "label")
    return p.join(comp, "cell_id").join(lut, "component").select("y", "x", F.col("label").cast("int").alias("label"))


def percentile_stretch(px: DataFrame, value: str = "v", low: float = 0.02, high: float = 0.98) -> DataFrame:
    """8-bit intensity between two exact percentiles."""
    q = exact_quantiles(px, value, {"_lo": low, "_hi": high})
    s = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return px.crossJoin(F.broadcast(q)).withColumn("v8", (F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)) * 255).cast("int")).drop("_lo", "_hi")  # one row


def colour_feature(spots: DataFrame, image: DataFrame, beta: int = 49, alpha: float = 1.0) -> DataFrame:
    """(cell_id, z): third coordinate from the mean colour around each spot.

    Window of +-round(beta/2) pixels; channels weighted by their variance, then
    z-scaled to the larger coordinate spread. Spots meet pixels through bins.
    """
    half = round(beta / 2)
    size = 2 * half + 1
    ring = F.sequence(F.lit(0), F.lit(1))
    # the window spans at most two bins per axis
    s = (spots.withColumn("_i", F.explode(ring)).withColumn("_j", F.explode(ring))
         .withColumn("gy", F.floor((F.col("py") - half) / size) + F.col("_i")).withColumn("gx", F.floor((F.col("px") - half) / size) + F.col("_j")))
    im = image.withColumn("gy", F.floor(F.col("y") / size)).withColumn("gx", F.floor(F.col("x") / size))
    near = (F.abs(F.col("y") - F.col("py")) <= half) & (F.abs(F.col("x") - F.col("px")) <= half)
    g = s.join(im, ["gy", "gx"]).where(near).groupBy("cell_id").agg(F.first("px").alias("sx"), F.first("py").alias("sy"), *[F.avg(c).alias(c) for c in ("c0", "c1", "c2")])
    v = g.agg(*[F.var_pop(c).alias(f"v{c}") for c in ("c0", "c1", "c2")], F.greatest(F.stddev_pop("sx"), F.stddev_pop("sy")).alias("sc"))
    w = sum((F.col(f"v{c}") for c in ("c0", "c1", "c2")), F.lit(0.0))
    m = g.crossJoin(F.broadcast(v)).select("cell_id", "sc", (sum((F.col(c) * F.col(f"v{c}") for c in ("c0", "c1", "c2")), F.lit(0.0)) / w).alias("c"))  # one row
    one = m.agg(F.avg("c").alias("m"), F.stddev_pop("c").alias("s"))
    return m.crossJoin(F.broadcast(one)).select("cell_id", ((F.col("c") - F.col("m")) / F.col("s") * F.col("sc") * alpha).alias("z"))  # one row
