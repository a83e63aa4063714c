import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytogrid.operators import raster as R, spatial as S, tiles as T
from cytogrid.operators.delaunay import delaunay_graph

SQUARE = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]


def frame(spark, xy):
    return spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(len(xy)), "x": xy[:, 0].astype(float), "y": xy[:, 1].astype(float)}))


def skewed(seed=0, n=300):
    """A third of the points in one tiny spot, some stacked exactly, the rest spread."""
    g = np.random.default_rng(seed)
    a = g.normal(0, 0.01, (n // 3, 2)) + 50
    b = np.repeat(g.uniform(0, 100, (5, 2)), n // 15, axis=0)
    c = g.uniform(0, 100, (n - len(a) - len(b), 2))
    return np.vstack([a, b, c])


def brute_pairs(xy, r):
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    i, j = np.where(np.triu(d2 <= r * r, 1))
    return set(zip(i.tolist(), j.tolist()))


@pytest.mark.parametrize("bin_rows", [20_000, 30])
def test_radius_pairs_with_hot_bins(spark, bin_rows):
    xy = skewed()
    got = S.radius_pairs(frame(spark, xy), 5.0, bin_rows=bin_rows).collect()
    assert {(r.src, r.dst) for r in got} == brute_pairs(xy, 5.0)
    assert len(got) == len(brute_pairs(xy, 5.0))


def test_radius_line(spark):
    got = S.radius_pairs(frame(spark, np.array([[0, 0], [1, 0], [2, 0], [4, 0]])), 1.0).collect()
    assert {(r.src, r.dst, r.dist) for r in got} == {(0, 1, 1.0), (1, 2, 1.0)}


@pytest.mark.parametrize("k,self_", [(1, False), (5, False), (40, False), (4, True)])
def test_knn_exact_on_skew(spark, k, self_):
    xy = skewed(3)
    got = S.knn(frame(spark, xy), k, include_self=self_).toPandas().sort_values(["src", "rank"])
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    for i in range(len(xy)):
        order = np.lexsort((np.arange(len(xy)), d2[i]))
        want = [j for j in order if self_ or j != i][:k]
        assert got[got.src == i].dst.tolist() == want


def test_knn_fewer_points_than_k_and_subset(spark):
    xy = np.array([[0, 0], [1, 0], [5, 5]])
    assert S.knn(frame(spark, xy), 10).count() == 6
    assert {r.src for r in S.knn(frame(spark, xy), 1, query_if=F.col("cell_id") == 2).collect()} == {2}


def test_window_join_box_is_open(spark):
    xy = np.array([[0, 0], [3, 0], [2.9, 2.9], [-3, -3]])
    p = frame(spark, xy)
    got = S.window_join(p.where("cell_id = 0"), p, 3.0, "box").collect()
    assert {r.p_cell_id for r in got} == {0, 2}


def test_count_by_type_stacked(spark):
    p = frame(spark, np.array([[0, 0]] * 50 + [[1, 0]])).withColumn("cell_type", F.when(F.col("cell_id") < 30, "a").otherwise("b"))
    got = {(r.cell_id, r.cell_type): r.n for r in S.count_by_type(p, p, 1.0).collect()}
    assert got[(0, "a")] == 30 and got[(50, "b")] == 21


def test_roi_square_excludes_outline(spark):
    xy = np.array([[5, 5], [0, 5], [11, 5], [10, 10], [3, 10], [9.99, 0.01]])
    got = {r.cell_id for r in S.roi_filter(frame(spark, xy), SQUARE).collect()}
    assert got == {0, 5}
    many = [(10 * np.cos(t), 10 * np.sin(t)) for t in np.linspace(0, 2 * np.pi, 100, endpoint=False)]
    inside = S.roi_filter(frame(spark, np.array([[0, 0], [9.9, 0], [10, 0], [8, 8]])), many)
    assert {r.cell_id for r in inside.collect()} == {0, 1}


def even_odd(px, py, ring):
    c, n = False, len(ring)
    for i in range(n):
        (ax, ay), (bx, by) = ring[i], ring[(i + 1) % n]
        if (ay > py) != (by > py) and px < (bx - ax) * (py - ay) / (by - ay) + ax:
            c = not c
    return c


def test_points_in_polygons_matches_even_odd(spark):
    g = np.random.default_rng(1)
    rings = {}
    for i in range(25):
        c, n = g.uniform(0, 40, 2), g.integers(3, 12)
        t = np.sort(g.uniform(0, 2 * np.pi, n))
        rad = g.uniform(1, 9, n)
        rings[i] = [(float(c[0] + q * np.cos(a)), float(c[1] + q * np.sin(a))) for a, q in zip(t, rad)]
    rings[99] = [(0.0, 0.0), (20.0, 0.0), (20.0, 20.0), (10.0, 5.0), (0.0, 20.0)]
    shapes = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in v]) for k, v in rings.items()], "cell_id int, ring array<struct<x:double,y:double>>")
    xy = g.uniform(-5, 45, (400, 2))
    p = frame(spark, xy).withColumnRenamed("cell_id", "pid")
    got = {(r.pid, r.shape_id) for r in S.points_in_polygons(p, shapes, 4.0, ["pid"]).collect()}
    want = {(i, k) for i, (x, y) in enumerate(xy) for k, v in rings.items() if even_odd(x, y, v)}
    assert got == want
    first = {r.pid: r.shape_id for r in S.assign_first(p, shapes, 7.0, ["pid"]).collect()}
    assert len(first) == 400
    for i in range(400):
        assert first[i] == min([k for q, k in want if q == i], default=None)


def test_point_on_outline_is_unassigned(spark):
    shapes = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in SQUARE])], "cell_id int, ring array<struct<x:double,y:double>>")
    p = frame(spark, np.array([[0, 5], [5, 0], [10, 3], [4, 10], [5, 5], [0, 0]])).withColumnRenamed("cell_id", "pid")
    got = {r.pid: r.shape_id for r in S.assign_first(p, shapes, 3.0, ["pid"]).collect()}
    assert got == {0: None, 1: None, 2: None, 3: None, 4: 1, 5: None}


def brute_delaunay(xy):
    out = set()
    n = len(xy)
    for a in range(n):
        for b in range(a + 1, n):
            d = xy[b] - xy[a]
            u = np.delete(xy, [a, b], 0) - (xy[a] + xy[b]) / 2
            h, un = (u ** 2).sum(1) - (d ** 2).sum() / 4, u @ np.array([-d[1], d[0]])
            lo = (h[un < 0] / (2 * un[un < 0])).max(initial=-np.inf)
            hi = (h[un > 0] / (2 * un[un > 0])).min(initial=np.inf)
            if lo <= hi:
                out.add((a, b))
    return out


@pytest.mark.parametrize("k", [8, 32])
def test_delaunay_matches_empty_circles(spark, k, monkeypatch):
    from cytogrid.operators import delaunay
    monkeypatch.setattr(delaunay, "SMALL", 0)
    g = np.random.default_rng(7)
    xy = np.vstack([g.uniform(0, 10, (60, 2)), g.normal(5, 0.05, (30, 2))])
    got = {(r.src, r.dst) for r in delaunay_graph(frame(spark, xy), k=k).collect()}
    assert got == brute_delaunay(xy)


@pytest.mark.parametrize("crowded", [0, 30, 10_000])
def test_delaunay_by_tiles(spark, crowded, monkeypatch):
    from cytogrid.operators import delaunay
    monkeypatch.setattr(delaunay, "TILE_ROWS", 8)
    monkeypatch.setattr(delaunay, "CROWDED", crowded)
    g = np.random.default_rng(11)
    xy = np.vstack([g.uniform(0, 10, (60, 2)), g.normal(5, 0.05, (40, 2)), [[-300.0, 4.0]]])
    got = {(r.src, r.dst) for r in delaunay_graph(frame(spark, xy), k=8).collect()}
    assert got == brute_delaunay(xy)


def test_delaunay_asks_for_nearest_points_of_the_rim_only(spark, monkeypatch):
    from cytogrid.operators import delaunay
    asked, knn = [], delaunay.knn
    monkeypatch.setattr(delaunay, "knn", lambda points, *a: (asked.append(points.count()), knn(points, *a))[1])
    xy = np.random.default_rng(3).uniform(0, 80, (6400, 2))
    got = {(r.src, r.dst) for r in delaunay_graph(frame(spark, xy)).collect()}
    assert sum(asked) < 3000
    hull = len(delaunay._chain(xy[:, 0], xy[:, 1], np.arange(len(xy))))
    assert len(got) == 3 * len(xy) - 3 - hull  # edges of every triangulation


def test_delaunay_merges_stacked_points(spark):
    xy = np.array([[0, 0], [0, 0], [4, 0], [0, 3], [4.5, 3.5]])
    got = {(r.src, r.dst) for r in delaunay_graph(frame(spark, xy)).collect()}
    assert got == {(0, 2), (0, 3), (2, 3), (2, 4), (3, 4)}


# ------------------------------------------------------------------ raster

def pixels(spark, img):
    y, x = np.nonzero(img)
    return spark.createDataFrame(pd.DataFrame({"y": y.astype("int32"), "x": x.astype("int32"), "label": img[y, x].astype("int32")}))


def test_iou_pair_kept(spark):
    a, b = np.zeros((4, 4), int), np.zeros((4, 4), int)
    a[:2, :2], b[:2, 1:3] = 1, 7
    got = R.overlap_iou(pixels(spark, a), pixels(spark, b)).first()
    assert (got.label_a, got.label_b, got.inter) == (1, 7, 2) and abs(got.iou - 1 / 3) < 1e-12


def test_square_region_properties(spark):
    img = np.zeros((12, 12), int)
    img[1:6, 1:6], img[7:9, 3:11] = 1, 2
    got = {r.label: r for r in R.region_properties(pixels(spark, img)).collect()}
    assert got[1].area == 25 and abs(got[1].perimeter - 16) < 1e-9 and abs(got[1].solidity - 1) < 1e-12
    assert abs(got[1].eccentricity) < 1e-9 and got[1].extent == 1.0
    assert got[2].eccentricity > 0.9 and abs(got[2].hull_area - 16) < 1e-9


def test_outlines_have_pixel_area_and_keep_largest_part(spark):
    img = np.zeros((12, 12), int)
    img[1:6, 1:6] = 1
    img[3, 3] = 0       # a hole does not change the outer ring
    img[8:11, 8:11] = 2
    img[11, 11] = 2     # touches only at a corner
    got = {r.label: r for r in S.polygon_metrics(R.outlines(pixels(spark, img))).collect()}
    assert got[1].area == 25 and got[1].n_vertices == 4
    assert got[2].area == 9


def test_rejection_order(spark):
    rows = [(1, 5, 0.1), (2, 30, 0.99), (3, 40, 0.99), (4, 50, 0.2), (5, 900, 0.2)]
    p = spark.createDataFrame(rows, "label int, area long, eccentricity double")
    got = {r.label: r.reason for r in R.rejection_reasons(p, min_absolute_area=10, min_area="median", max_area=500, max_eccentricity=0.95).collect()}
    assert got == {1: "tiny_artifacts", 2: "too_small", 3: "too_eccentric", 4: None, 5: "too_large"}


@pytest.mark.parametrize("core,halo", [(3, 1), (5, 2)])
def test_halo_invariance(spark, core, halo):
    g = np.random.default_rng(2)
    p = frame(spark, g.uniform(0, 15, (200, 2)))
    t = T.replicate_to_tiles(p, core, halo, -(-15 // core), -(-15 // core))
    assert sorted(r.cell_id for r in t.where("owned").collect()) == list(range(200))


def test_components_on_raster(spark):
    img = np.array([[1, 1, 0, 1], [0, 1, 0, 1], [1, 0, 0, 1]])
    assert sorted(r["count"] for r in R.components(pixels(spark, img)).groupBy("label").count().collect()) == [1, 3, 3]


def test_points_of_one_partition_look_for_neighbours_in_many_tasks(spark, tmp_path):
    path = f"{tmp_path}/cells"
    spark.range(3000).selectExpr("id as cell_id", "cast(id % 40 as double) as x", "cast(floor(id / 40) as double) as y").coalesce(1).write.parquet(path)
    near = S.knn(spark.read.parquet(path), 4)
    sizes = near.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.countDistinct("src").alias("n")).collect()
    assert len(sizes) > 1 and max(r.n for r in sizes) < 1500
    assert near.count() == 12000
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_radius_pairs_send_no_points_through_the_driver(spark):
    p = spark.range(200).selectExpr("id as cell_id", "cast(id % 20 as double) as x", "cast(floor(id / 20) as double) as y")
    pairs = S.radius_pairs(p, 1.0)
    pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "SortMergeJoin [gx" in plan
