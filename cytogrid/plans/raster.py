"""Label rasters, polygons, tiles and transcript assignment."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from cytogrid.operators import raster as R, spatial as S, summaries as U, tiles as T
from cytogrid.plans.registry import query, r
from cytogrid.session import cut
from cytogrid.sources import driver_tables as D

REGION = """reg AS (SELECT label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1,
 var_pop(y) AS a, var_pop(x) AS b, covar_pop(y, x) AS c FROM raster GROUP BY 1)"""
BORDER = """bnd AS (SELECT y, x, label FROM raster r WHERE (SELECT count(*) FROM raster q WHERE q.label = r.label AND abs(q.y - r.y) + abs(q.x - r.x) = 1) < 4)"""
PERIM = BORDER + """, code AS (SELECT a.label, a.y, a.x, 1 + coalesce(sum(CASE WHEN b.y = a.y OR b.x = a.x THEN 2 ELSE 10 END), 0) AS c FROM bnd a LEFT JOIN bnd b ON b.label = a.label
 AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1 AND NOT (a.y = b.y AND a.x = b.x) GROUP BY 1, 2, 3),
per AS (SELECT label, sum(CASE WHEN c IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN c IN (21, 33) THEN sqrt(2) WHEN c IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS p FROM code GROUP BY 1)"""


@query("region_table", "A13 F19", f"""WITH {REGION} SELECT label, area, round(cy, 6) AS cy, round(cx, 6) AS cx, round(area * 4, 6)::DOUBLE AS area_full, round(area::DOUBLE / ((y1 - y0 + 1) * (x1 - x0 + 1)), 6) AS extent,
round(CASE WHEN a + b > 0 THEN sqrt(greatest(1 - ((a + b) / 2 - sqrt(4 * c * c + (a - b) * (a - b)) / 2) / ((a + b) / 2 + sqrt(4 * c * c + (a - b) * (a - b)) / 2), 0)) ELSE 0 END, 4) AS eccentricity FROM reg""", "raster")
def region_table(spark, d):
    t = R.region_table(D.raster(spark, d))
    return t.select("label", "area", r("cy").alias("cy"), r("cx").alias("cx"), r(F.col("area") * 4).alias("area_full"), r("extent").alias("extent"), r("eccentricity", 4).alias("eccentricity"))


@query("boundary_pixels", "G25", f"WITH {BORDER} SELECT * FROM bnd", "raster")
def boundary_pixels(spark, d):
    return R.boundary(D.raster(spark, d))


@query("region_perimeter", "F8 P12", f"""WITH {REGION}, {PERIM} SELECT label, round(p, 6) AS perimeter, round(4 * pi() * area / (p * p + 1e-10), 6) AS compactness, round(p / (sqrt(area) + 1e-10), 6) AS perimeter_ratio FROM per JOIN reg USING (label)""", "raster")
def region_perimeter(spark, d):
    t = R.region_properties(D.raster(spark, d), with_hull=False)
    return t.select("label", *[r(c).alias(c) for c in ("perimeter", "compactness", "perimeter_ratio")])


@query("region_rejections", "P12 A38", f"""WITH {REGION}, {PERIM}, q AS (SELECT quantile_cont(area, 0.3) AS q, avg(area) AS m, stddev_pop(area) AS s FROM reg),
t AS (SELECT CASE WHEN area < 20 THEN 'tiny_artifacts' WHEN area < q THEN 'too_small' WHEN area < m - 1.2 * s OR area > m + 1.2 * s THEN 'area_outliers'
 WHEN area::DOUBLE / ((y1 - y0 + 1) * (x1 - x0 + 1)) > 0.65 THEN 'too_rectangular' ELSE 'kept' END AS reason FROM reg JOIN per USING (label), q)
SELECT reason, count(*) AS n FROM t GROUP BY 1""", "raster")
def region_rejections(spark, d):
    p = cut(R.region_properties(D.raster(spark, d), with_hull=False))
    t = R.rejection_reasons(p, min_absolute_area=20, min_area=30, area_std=1.2, max_extent=0.65)
    return t.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("region_filter_relabel", "P12 W8 P13", """WITH a AS (SELECT label, count(*) AS n FROM raster GROUP BY 1 HAVING count(*) <= 60), l AS (SELECT label, row_number() OVER (ORDER BY label) AS new FROM a)
SELECT CAST(new AS INT) AS label, count(*) AS area, min(y) AS y0 FROM raster JOIN l USING (label) GROUP BY 1""", "raster")
def region_filter_relabel(spark, d):
    px = R.remove_large(D.raster(spark, d), 60)
    return R.keep_labels(px, px).groupBy("label").agg(F.count(F.lit(1)).alias("area"), F.min("y").alias("y0"))


@query("region_solidity", "P12 G22")
def region_solidity(spark, d):
    return R.solidity(D.raster(spark, d)).select("label", r("hull_area").alias("hull_area"), r("solidity").alias("solidity"))


@query("region_components", "G14", """WITH f AS (SELECT label, count(*) AS area, min(y * (SELECT max(x) - min(x) + 1 FROM raster) + x - (SELECT min(x) FROM raster)) AS first FROM raster GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY first) AS INT) AS label, area FROM f""", "raster")
def region_components(spark, d):
    return R.components(D.raster(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("area"))


@query("mask_outlines", "G24", """SELECT label, round(count(*), 6)::DOUBLE AS area, round(avg(x) + 0.5, 6) AS cx, round(avg(y) + 0.5, 6) AS cy FROM raster GROUP BY 1""", "raster")
def mask_outlines(spark, d):
    o = R.outlines(D.raster(spark, d))
    m = S.polygon_metrics(o)
    return m.select("label", r("area").alias("area"), r("cx").alias("cx"), r("cy").alias("cy"))


@query("tissue_filter", "P14", """WITH i AS (SELECT y, x, label % 7 AS v FROM raster), t AS (SELECT quantile_cont(v, 0.2) AS t FROM i WHERE v > 0), on_ AS (SELECT y, x FROM i, t WHERE v > t),
c AS (SELECT label, CAST(floor(avg(y)) AS INT) AS cy, CAST(floor(avg(x)) AS INT) AS cx FROM raster GROUP BY 1)
SELECT DISTINCT label FROM c JOIN on_ ON abs(cy - y) + abs(cx - x) <= 8""", "raster")
def tissue_filter(spark, d):
    px = D.raster(spark, d)
    return R.tissue_labels(R.region_table(px), px.withColumn("v", F.col("label") % 7), pct=20.0, reach=8)


@query("raster_lookup", "J14 J3", """WITH t AS (SELECT CAST(trunc(x / 0.5) AS INT) AS px, CAST(trunc(y / 0.5) AS INT) AS py FROM transcripts)
SELECT coalesce(label, 0) AS label, count(*) AS n FROM t LEFT JOIN raster r ON r.y = least(py, 119) AND r.x = least(px, 119) GROUP BY 1""", "transcripts raster")
def raster_lookup(spark, d):
    j = R.lookup_points(D.transcripts(spark, d), D.raster(spark, d), 0.5, width=120, height=120)
    return j.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


IOU = """ov AS (SELECT a.label AS label_a, b.label AS label_b, count(*) AS inter FROM raster a JOIN seam b USING (y, x) GROUP BY 1, 2),
aa AS (SELECT label AS label_a, count(*) AS na FROM raster GROUP BY 1), ab AS (SELECT label AS label_b, count(*) AS nb FROM seam GROUP BY 1),
iou AS (SELECT label_a, label_b, inter, inter / (na + nb - inter)::DOUBLE AS iou FROM ov JOIN aa USING (label_a) JOIN ab USING (label_b) WHERE inter / (na + nb - inter)::DOUBLE >= 0.3)"""


@query("layer_iou", "J15 A14", f"WITH {IOU} SELECT label_a, label_b, inter, round(iou, 6) AS iou FROM iou", "raster seam")
def layer_iou(spark, d):
    return R.overlap_iou(D.raster(spark, d), D.seam(spark, d)).select("label_a", "label_b", "inter", r("iou").alias("iou"))


@query("seam_dedup", "G29", f"""WITH {IOU}, pd AS (SELECT label, least(abs(avg(y) - 60), abs(avg(x) - 60)) AS d FROM raster GROUP BY 1), sd AS (SELECT label, least(abs(avg(y) - 45), abs(avg(y) - 75)) AS d FROM seam GROUP BY 1)
SELECT DISTINCT CASE WHEN p.d >= s.d THEN 'seam' ELSE 'patch' END AS layer, CASE WHEN p.d >= s.d THEN label_b ELSE label_a END AS label FROM iou JOIN pd p ON p.label = label_a JOIN sd s ON s.label = label_b""", "raster seam")
def seam_dedup(spark, d):
    a, b = D.raster(spark, d), D.seam(spark, d)
    near = lambda c, v: F.abs(F.col(c) - v)
    pd_ = R.region_table(a).select("label", F.least(near("cy", 60), near("cx", 60)).alias("dist"))
    sd_ = R.region_table(b).select("label", F.least(near("cy", 45), near("cy", 75)).alias("dist"))
    return R.seam_dedup(R.overlap_iou(a, b), pd_, sd_)


@query("merge_layers", "U5 W8", """WITH u AS (SELECT y, x, label FROM raster UNION ALL SELECT y, x, label + (SELECT max(label) FROM raster) FROM seam ANTI JOIN raster USING (y, x)),
l AS (SELECT label, row_number() OVER (ORDER BY label) AS new FROM (SELECT DISTINCT label FROM u)) SELECT CAST(new AS INT) AS label, count(*) AS area FROM u JOIN l USING (label) GROUP BY 1""", "raster seam")
def merge_layers(spark, d):
    return R.merge_layers(D.raster(spark, d), D.seam(spark, d)).groupBy("label").agg(F.count(F.lit(1)).alias("area"))


@query("upscale_labels", "R5", """SELECT y * 2 + i AS y, x * 2 + j AS x, label FROM raster, range(2) a(i), range(2) b(j)""", "raster")
def upscale_labels(spark, d):
    return R.upscale(D.raster(spark, d), 2).select(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), "label")


PATCH = """p AS (SELECT label % 3 AS patch, y % 40 AS y, x % 50 AS x, label AS label FROM raster), o AS (SELECT i AS patch, i * 30 AS oy, i * 20 AS ox, 40 AS h, 50 AS w FROM range(3) t(i)),
mx AS (SELECT patch, max(label) AS m FROM p GROUP BY 1), off AS (SELECT patch, coalesce(sum(m) OVER (ORDER BY patch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM mx)"""


@query("patch_offsets", "W9", f"WITH {PATCH} SELECT DISTINCT patch, label, CAST(label + off AS BIGINT) AS global_id FROM p JOIN off USING (patch)", "raster")
def patch_offsets(spark, d):
    p = D.raster(spark, d).select((F.col("label") % 3).alias("patch"), "label").distinct()
    return U.offset_ids(p, "patch", "label").withColumn("global_id", F.col("global_id").cast("long"))


@query("place_patches", "R6", f"""WITH {PATCH}, g AS (SELECT p.patch, y + oy AS y, x + ox AS x, max(label + off) AS label FROM p JOIN off USING (patch) JOIN o USING (patch) GROUP BY 1, 2, 3),
b AS (SELECT y, x, arg_max(label, patch) AS label, max(patch) AS patch FROM g GROUP BY 1, 2)
SELECT y, x, CAST(label AS BIGINT) AS label FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.patch > b.patch AND b.y >= oy AND b.y < oy + h AND b.x >= ox AND b.x < ox + w)""", "raster")
def place_patches(spark, d):
    p = (D.raster(spark, d).select((F.col("label") % 3).alias("patch"), (F.col("y") % 40).alias("y"), (F.col("x") % 50).alias("x"), "label")
         .groupBy("patch", "y", "x").agg(F.max("label").alias("label")))
    o = spark.range(3).select(F.col("id").cast("int").alias("patch"), (F.col("id") * 30).alias("oy"), (F.col("id") * 20).alias("ox"), F.lit(40).alias("h"), F.lit(50).alias("w"))
    return R.place_patches(p, o).select("y", "x", F.col("label").cast("long").alias("label"))


BLEND = """v AS (SELECT tc, tr, y, x, y - (tr * 30 - 6) AS i, x - (tc * 30 - 6) AS j, (label % 11) + tc * 0.5 + tr * 0.25 AS v FROM raster CROSS JOIN range(0, 5) a(tc) CROSS JOIN range(0, 500) b(tr)
 WHERE y >= tr * 30 - 6 AND y < tr * 30 + 36 AND x >= tc * 30 - 6 AND x < tc * 30 + 36)"""


@query("blend_tiles", "G30", f"""WITH {BLEND}, w AS (SELECT *, least(i + 1, 42 - i, j + 1, 42 - j) / 21::DOUBLE AS w FROM v) SELECT y, x, round(sum(w * v) / sum(w), 6) AS v FROM w GROUP BY 1, 2""", "raster")
def blend_tiles(spark, d):
    px = T.replicate_to_tiles(D.raster(spark, d), 30.0, 6.0, 5, 500).drop("owned")
    v = px.select(F.lit(42).alias("h"), F.lit(42).alias("w"), (F.col("y") - (F.col("tile_row") * 30 - 6)).alias("i"), (F.col("x") - (F.col("tile_col") * 30 - 6)).alias("j"), "y", "x",
                  ((F.col("label") % 11) + F.col("tile_col") * 0.5 + F.col("tile_row") * 0.25).alias("v"))
    return R.blend_tiles(v).withColumn("v", r("v"))


@query("percentile_stretch", "R2", """WITH i AS (SELECT y * x % 251 AS v FROM raster), q AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM i)
SELECT CAST(trunc(greatest(0, least(1, (v - lo) / (hi - lo))) * 255) AS INT) AS v8, count(*) AS n FROM i, q GROUP BY 1""", "raster")
def percentile_stretch(spark, d):
    px = D.raster(spark, d).select((F.col("y") * F.col("x") % 251).alias("v"))
    return R.percentile_stretch(px).groupBy("v8").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------- tiles and halos

@query("tile_grid", "G26 F6", """WITH t AS (SELECT r, c FROM range(13) a(r), range(9) b(c)), g AS (SELECT r, c, c * 3000 AS x0, least((c + 1) * 3000, 25633) AS x1, r * 3000 AS y0, least((r + 1) * 3000, 37473) AS y1 FROM t)
SELECT CAST(r AS INT) AS tile_row, CAST(c AS INT) AS tile_col, x0, x1, y0, y1, greatest(x0 - 300, 0) AS hx0, least(x1 + 300, 25633) AS hx1, greatest(y0 - 300, 0) AS hy0, least(y1 + 300, 37473) AS hy1, n
FROM g LEFT JOIN (SELECT CAST(l_partkey * 13 % 37473 AS BIGINT) // 3000 AS r, CAST(l_suppkey * 257 % 25633 AS BIGINT) // 3000 AS c, count(*) AS n FROM lineitem GROUP BY 1, 2) USING (r, c)""")
def tile_grid(spark, d):
    g = T.tile_grid(spark, 25633, 37473, 3000, 300)
    n = (D.table(spark, d, "lineitem").groupBy(F.floor(F.col("l_partkey") * 13 % 37473 / 3000).cast("int").alias("tile_row"), F.floor(F.col("l_suppkey") * 257 % 25633 / 3000).cast("int").alias("tile_col"))
         .agg(F.count(F.lit(1)).alias("n")))
    out = g.join(n, ["tile_row", "tile_col"], "left")
    return out.select("tile_row", "tile_col", *[F.col(c).cast("long").alias(c) for c in ("x0", "x1", "y0", "y1", "hx0", "hx1", "hy0", "hy1")], "n")


@query("halo_ownership", "G26 G27", """WITH t AS (SELECT x, y, tc, tr FROM transcripts, range(0, 6) a(tc), range(0, 6) b(tr) WHERE x >= tc * 10 - 2 AND x < tc * 10 + 12 AND y >= tr * 10 - 2 AND y < tr * 10 + 12)
SELECT CAST(tr AS BIGINT) AS tile_row, CAST(tc AS BIGINT) AS tile_col, count(*) AS n, CAST(sum(CASE WHEN floor(x / 10) = tc AND floor(y / 10) = tr THEN 1 ELSE 0 END) AS BIGINT) AS n_owned FROM t GROUP BY 1, 2""", "transcripts")
def halo_ownership(spark, d):
    t = T.replicate_to_tiles(D.transcripts(spark, d), 10.0, 2.0, 6, 6)
    return t.groupBy("tile_row", "tile_col").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("owned").cast("long")).alias("n_owned"))


@query("seam_geometry", "G28", """WITH h AS (SELECT 'seam_H_' || lpad(CAST(i AS VARCHAR), 2, '0') AS seam, greatest(0, ((i // 4 + 1) * 9368.125 - 1500)) AS y0, least(74945, ((i // 4 + 1) * 9368.125 + 1500)) AS y1, greatest(0, (i % 4) * 12816.25 - 1500) AS x0, least(51265, (i % 4 + 1) * 12816.25 + 1500) AS x1 FROM range(28) t(i)),
v AS (SELECT 'seam_V_' || lpad(CAST(i AS VARCHAR), 2, '0') AS seam, greatest(0, (i // 3) * 9368.125 - 1500) AS y0, least(74945, (i // 3 + 1) * 9368.125 + 1500) AS y1, greatest(0, (i % 3 + 1) * 12816.25 - 1500) AS x0, least(51265, (i % 3 + 1) * 12816.25 + 1500) AS x1 FROM range(24) t(i)),
a AS (SELECT * FROM h UNION ALL SELECT * FROM v), pts AS (SELECT c_custkey * 733 % 51265 AS px, c_custkey * 1237 % 74945 AS py FROM customer)
SELECT seam, y0::DOUBLE AS y0, y1::DOUBLE AS y1, x0::DOUBLE AS x0, x1::DOUBLE AS x1, (SELECT count(*) FROM pts WHERE px >= x0 AND px < x1 AND py >= y0 AND py < y1) AS n FROM a""")
def seam_geometry(spark, d):
    from cytogrid.operators.tiles import seam_strips
    s = seam_strips(spark, 51265, 74945, 4, 8, 1500)
    p = D.table(spark, d, "customer").select((F.col("c_custkey") * 733 % 51265).alias("px"), (F.col("c_custkey") * 1237 % 74945).alias("py"))
    # the strip table has a fixed 52 rows
    hit = p.join(F.broadcast(s), (F.col("px") >= F.col("x0")) & (F.col("px") < F.col("x1")) & (F.col("py") >= F.col("y0")) & (F.col("py") < F.col("y1")))
    n = hit.groupBy("seam").agg(F.count(F.lit(1)).alias("n"))
    return s.join(n, "seam", "left").select("seam", "y0", "y1", "x0", "x1", F.coalesce("n", F.lit(0)).alias("n"))


# ------------------------------------------------- polygons and assignment

HEXIN = """inside AS (SELECT t.rowid AS pid, s.cell_id FROM tt t JOIN shapes s ON t.x > ox - r AND t.x < ox + r AND t.y > oy - 0.75 * r AND t.y < oy + 0.75 * r
 AND abs(t.x - ox) < r - abs(t.y - oy) * (0.5 * r) / (0.75 * r))"""


@query("transcripts_in_polygons", "J1 J2 J3 A30", f"""WITH tt AS (SELECT x, y, feature_name, row_number() OVER () AS rowid FROM transcripts), {HEXIN},
f AS (SELECT pid, min(cell_id) AS cell_id FROM inside GROUP BY 1) SELECT coalesce(cell_id, 0) AS cell_id, feature_name, count(*) AS n FROM tt LEFT JOIN f ON pid = rowid GROUP BY 1, 2""", "transcripts shapes")
def transcripts_in_polygons(spark, d):
    t = D.transcripts(spark, d).groupBy("x", "y", "feature_name").agg(F.count(F.lit(1)).alias("k"))
    a = S.assign_first(t, D.shapes(spark, d), 5.0, ["x", "y", "feature_name", "k"])
    return a.groupBy(F.coalesce("shape_id", F.lit(0)).alias("cell_id"), "feature_name").agg(F.sum("k").alias("n"))


@query("assignment_rate", "A30 P11", f"""WITH tt AS (SELECT x, y, row_number() OVER () AS rowid FROM transcripts), {HEXIN}
SELECT count(*) AS n, round((SELECT count(DISTINCT pid) FROM inside)::DOUBLE / count(*), 6) AS rate FROM tt""", "transcripts shapes")
def assignment_rate(spark, d):
    t = D.transcripts(spark, d).groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"))
    a = S.assign_first(t, D.shapes(spark, d), 5.0, ["x", "y", "k"])
    return a.agg(F.sum("k").alias("n"), r(F.sum(F.when(F.col("shape_id").isNotNull(), F.col("k")).otherwise(0)) / F.sum("k")).alias("rate"))


@query("polygon_metrics", "G22 P10 D4", """SELECT cell_id, round(r * r * 2.25, 6) AS area, round(ox, 6) AS cx, round(oy, 6) AS cy, round(r * (2 + 4 * sqrt(0.8125)), 6) AS perimeter, round(2 * r / greatest(1.5 * r, 0.1), 6) AS aspect
FROM shapes WHERE r * r * 2.25 BETWEEN 6 AND 5000""", "shapes")
def polygon_metrics(spark, d):
    m = S.polygon_metrics(D.shapes(spark, d)).where(F.round("area", 9).between(6, 5000) & (F.col("aspect") <= 10))
    return m.select("cell_id", *[r(c).alias(c) for c in ("area", "cx", "cy", "perimeter", "aspect")])


@query("polygon_convexity", "P10 G22", "SELECT cell_id, 1::DOUBLE AS convexity FROM shapes", "shapes")
def polygon_convexity(spark, d):
    m = S.polygon_metrics(D.shapes(spark, d)).withColumn("hull", R.hull_area(F.col("ring")))
    return m.select("cell_id", r(F.col("area") / F.col("hull")).alias("convexity")).where("convexity >= 0.85")


@query("rasterize_polygons", "G24", """SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(max(cell_id) AS BIGINT) AS label FROM (SELECT *, x + 0.5 - ox AS dx, abs(y + 0.5 - oy) AS dy FROM shapes, range(0, 50) a(x), range(0, 50) b(y))
WHERE dy < 0.75 * r AND dx >= 2 * dy / 3 - r AND dx < r - 2 * dy / 3 GROUP BY 1, 2""", "shapes")
def rasterize_polygons(spark, d):
    return R.rasterize_polygons(D.shapes(spark, d)).select("y", "x", F.col("label").cast("long").alias("label"))


@query("outline_round_trip", "G24", "SELECT y, x, label FROM raster", "raster")
def outline_round_trip(spark, d):
    """Mask to outlines and back."""
    return R.rasterize_polygons(R.outlines(D.raster(spark, d)), "label").select("y", "x", "label")


@query("tile_stats", "A29", """SELECT count(*) AS n, round(avg(r * r * 2.25), 6) AS mean_area, round(quantile_cont(r * r * 2.25, 0.5), 6) AS median_area FROM shapes""", "shapes")
def tile_stats(spark, d):
    from cytogrid.operators.ordering import exact_quantiles
    m = S.polygon_metrics(D.shapes(spark, d)).select("area")
    a = m.agg(F.count(F.lit(1)).alias("n"), r(F.avg("area")).alias("mean_area"))
    return a.crossJoin(exact_quantiles(m, "area", {"median_area": 0.5}).select(r("median_area").alias("median_area")))


@query("affine_points", "G23 F6", """SELECT cell_id, round(0.2125 * x * 2, 6) AS x, round(100 - 0.2125 * y * 2, 6) AS y FROM cells""", "cells")
def affine_points(spark, d):
    t = S.affine(D.cells(spark, d).select("cell_id", "x", "y"), 0.425, 0.0, 0.0, -0.425, 0.0, 100.0)
    return t.select("cell_id", r("x").alias("x"), r("y").alias("y"))


@query("transform_rings", "G23", """SELECT cell_id, round(r * r * 2.25 * 4, 6) AS area, round(ox * 2 + 3, 6) AS cx, round(60 - oy * 2, 6) AS cy FROM shapes""", "shapes")
def transform_rings(spark, d):
    s = D.shapes(spark, d).withColumn("ring", S.transform_ring(F.col("ring"), 2.0, -2.0, 3.0, 60.0))
    return S.polygon_metrics(s).select("cell_id", *[r(c).alias(c) for c in ("area", "cx", "cy")])


@query("equivalent_radius", "F7", """SELECT round(sqrt(avg(cell_area) / pi()), 6) AS radius FROM cells""", "cells")
def equivalent_radius(spark, d):
    return D.cells(spark, d).agg(r(F.sqrt(F.avg("cell_area") / F.lit(math.pi))).alias("radius"))


@query("segmentation_comparison", "A28", """WITH o AS (SELECT count(*)::DOUBLE AS n_cells, avg(a)::DOUBLE AS mean_area, sum(a)::DOUBLE AS total FROM (SELECT count(*) AS a FROM raster GROUP BY label)),
f AS (SELECT count(*)::DOUBLE AS n_cells, avg(a)::DOUBLE AS mean_area, sum(a)::DOUBLE AS total FROM (SELECT count(*) AS a FROM seam GROUP BY label)),
u AS (SELECT 'n_cells' AS metric, o.n_cells AS a, f.n_cells AS b FROM o, f UNION ALL SELECT 'mean_area', o.mean_area, f.mean_area FROM o, f UNION ALL SELECT 'total', o.total, f.total FROM o, f)
SELECT metric, round(a, 6) AS original, round(b, 6) AS refined, round(b - a, 6) AS diff, round(100 * (b - a) / nullif(a, 0), 6) AS pct_change FROM u""", "raster seam")
def segmentation_comparison(spark, d):
    one = lambda px: R.region_table(px).agg(F.count(F.lit(1)).alias("n_cells"), F.avg("area").alias("mean_area"), F.sum("area").alias("total"))
    t = U.compare_reports(one(D.raster(spark, d)), one(D.seam(spark, d)), ["n_cells", "mean_area", "total"])
    return t.select("metric", *[r(c).alias(c) for c in ("original", "refined", "diff", "pct_change")])


@query("merge_containers", "R7 R9", """SELECT region, count(*) AS n, CAST(sum(area) AS BIGINT) AS area FROM (SELECT 'original' AS region, label, count(*) AS area FROM raster GROUP BY label UNION ALL SELECT 'refined', label, count(*) FROM seam GROUP BY label) GROUP BY 1""", "raster seam")
def merge_containers(spark, d):
    tag = lambda px, n: R.region_table(px).select(F.lit(n).alias("region"), F.coalesce(F.col("label").cast("string"), F.lit("0")).alias("instance"), "area")
    u = tag(D.raster(spark, d), "original").unionByName(tag(D.seam(spark, d), "refined"))
    return u.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))


@query("colour_feature", "M16", """WITH px AS (SELECT y, x, (label * 17 % 256)::DOUBLE AS c0, (label * 31 % 256)::DOUBLE AS c1, (label * 7 % 256)::DOUBLE AS c2 FROM raster), spot AS (SELECT label AS cell_id, CAST(floor(avg(y)) AS INT) AS py, CAST(floor(avg(x)) AS INT) AS px FROM raster GROUP BY 1),
g AS (SELECT cell_id, any_value(spot.px) AS sx, any_value(spot.py) AS sy, avg(c0) AS c0, avg(c1) AS c1, avg(c2) AS c2 FROM spot JOIN px ON abs(px.y - spot.py) <= 8 AND abs(px.x - spot.px) <= 8 GROUP BY 1),
v AS (SELECT var_pop(c0) AS v0, var_pop(c1) AS v1, var_pop(c2) AS v2, greatest(stddev_pop(sx), stddev_pop(sy)) AS sc FROM g), c3 AS (SELECT cell_id, (c0 * v0 + c1 * v1 + c2 * v2) / (v0 + v1 + v2) AS c, sc FROM g, v)
SELECT cell_id, round((c - avg(c) OVER ()) / stddev_pop(c) OVER () * sc, 4) + 0::DOUBLE AS z FROM c3""", "raster")
def colour_feature(spark, d):
    px = D.raster(spark, d)
    img = px.select("y", "x", *[(F.col("label") * k % 256).cast("double").alias(c) for c, k in (("c0", 17), ("c1", 31), ("c2", 7))])
    spots = R.region_table(px).select(F.col("label").alias("cell_id"), F.col("cy").cast("int").alias("py"), F.col("cx").cast("int").alias("px"))
    return R.colour_feature(spots, img, beta=16).select("cell_id", r("z", 4).alias("z"))
