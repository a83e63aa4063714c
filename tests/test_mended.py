"""Inputs on which earlier versions gave wrong answers without an error."""
import pytest

from cytogrid.operators import autocorrelation as A, delaunay, expression as X, graph as G, raster as R, spatial as S, tiles
from cytogrid.session import shared_dir


def test_large_label_keeps_its_outline(spark):
    px = spark.range(6400).selectExpr("cast(id / 80 as int) as y", "cast(id % 80 as int) as x", "1 as label")
    assert [r.n_vertices for r in R.outlines(px).collect()] == [4]
    assert R.outlines(px, max_area=5000).count() == 0


def test_flat_hull_side_is_an_edge(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 1e-7), (2, 2.0, 0.0), (3, 1.0, 5.0)], "cell_id long, x double, y double")
    got = {(r.src, r.dst) for r in delaunay.delaunay_graph(pts).collect()}
    assert got == {(0, 1), (1, 2), (0, 2), (0, 3), (1, 3), (2, 3)}


def test_hull_of_many_partitions(spark):
    rows = [(i, float(i % 40), float(i // 40)) for i in range(1600)]
    got = {(r.src, r.dst) for r in delaunay.hull_edges(spark.createDataFrame(rows, "id long, px double, py double").repartition(17)).collect()}
    assert len(got) == 4 * 39 and all(b - a in (1, 40) for a, b in got)


def test_points_off_the_grid(spark):
    pts = spark.createDataFrame([(1, -70.0, 10.0), (2, 10.0, 20000.0), (3, 10.0, 10.0), (4, -2.0, 10.0)], "id long, x double, y double")
    got = {(r.id, r.tile_col, r.tile_row, r.owned) for r in tiles.replicate_to_tiles(pts, 30.0, 5.0, 4, 4).collect()}
    assert got == {(3, 0, 0, True), (4, 0, 0, False)}


def test_unfinished_results_raise(spark):
    path = spark.range(40).selectExpr("id as src", "id + 1 as dst", "1.0 as dist")
    nodes = spark.range(41).withColumnRenamed("id", "cell_id")
    with pytest.raises(RuntimeError):
        G.components(path, nodes, max_rounds=2)
    with pytest.raises(RuntimeError):
        G.bfs_levels(path, nodes.limit(1), max_rounds=5)
    assert G.components(path, nodes).select("component").distinct().count() == 1


def test_repeated_points_stay_inside(spark):
    shapes = spark.sql("select 7 as cell_id, array(struct(0d as x, 0d as y), struct(10d as x, 0d as y), struct(10d as x, 10d as y), struct(0d as x, 10d as y), struct(0d as x, 0d as y)) as ring")
    pts = spark.createDataFrame([(1, 5.0, 5.0), (1, 5.0, 5.0), (2, 50.0, 5.0)], "pid long, x double, y double")
    assert {(r.pid, r.shape_id) for r in S.assign_first(pts, shapes, 4.0, ["pid"]).collect()} == {(1, 7), (2, None)}
    assert [tuple(r) for r in S.points_in_polygons(pts, shapes, 4.0, ["pid"]).collect()] == [(1, 7)]


@pytest.fixture(scope="module")
def small(spark):
    cells = spark.createDataFrame([(i, float(i), 0.0, "AB"[i % 2] if i < 5 else "C") for i in range(6)], "cell_id long, x double, y double, cell_type string")
    expr = spark.createDataFrame([(0, "g1", 2.0), (1, "g1", 1.0), (0, "g2", 0.0), (2, "g3", 4.0)], "cell_id long, gene string, value double")
    return cells, expr


def test_every_cell_has_a_set_score(spark, small):
    cells, expr = small
    rows = X.gene_set_score(expr, cells, spark.createDataFrame([("A", "g1")], "cell_type string, gene string"), 1).collect()
    assert len(rows) == 6 and {r.cell_id: r.score for r in rows}[5] == 0.0


def test_markers_without_reads_have_zeros(spark, small):
    cells, expr = small
    rows = X.marker_stats(expr, cells, spark.createDataFrame([("A", "g1"), ("A", "g2"), ("none", "g1")], "cell_type string, gene string")).collect()
    got = {(r.cell_type, r.gene): (r.n_cells, r.pct_in, r.mean_in) for r in rows}
    assert len(got) == 3 and got["A", "g2"] == (3, 0.0, 0.0) and got["none", "g1"][0] == 0


def test_zero_rows_of_type_tables(spark, small):
    cells, _ = small
    edges = spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, dist double")
    assert {(r.type_a, r.type_b): r.n for r in A.interaction_matrix(edges, cells).collect()} == {(a, b): int({a, b} == {"A", "B"}) for a in "ABC" for b in "ABC"}
    assert A.co_occurrence(cells, 1.0, 2).count() == 18
    ripley = {(r.cell_type, r.r): r.l for r in A.ripley_l(cells, 1.0, 3, 100.0).collect()}
    assert len(ripley) == 9 and ripley["A", 1.0] == 0.0 and ripley["A", 2.0] > 0 and ripley["C", 3.0] is None


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_normal_tail_far_out(spark):
    """Tails against the asymptotic series 1 - 1/z^2 + 3/z^4 - 15/z^6 + 105/z^8."""
    import math

    from pyspark.sql import functions as F

    from cytogrid.functions import special as SP
    for z in (10.0, 20.0, 37.0, 60.0):
        want = -z * z / 2 - math.log(z * math.sqrt(2 * math.pi)) + math.log(1 - z**-2 + 3 * z**-4 - 15 * z**-6 + 105 * z**-8)
        got = spark.range(1).select(SP.normal_log_sf(F.lit(z)), SP.normal_sf(F.lit(z))).first()
        assert abs(got[0] - want) < 1e-4 * 10 ** (-z / 40)
        assert z > 37 or abs(got[1] / math.exp(want) - 1) < 1e-4


def test_rasterised_polygons_and_binned_patches(spark):
    from cytogrid.operators import raster as R
    shapes = spark.createDataFrame(
        [(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]),                              # a square
         (2, [(4.0, 0.0), (7.0, 0.0), (7.0, 4.0), (4.0, 4.0), (4.0, 0.0)]),                  # shares a side, closed
         (3, [(2.0, 2.0), (3.0, 2.0), (3.0, 3.0), (2.0, 3.0)]),                              # lies on the first
         (4, [(10.0, 0.0), (16.0, 0.0), (16.0, 6.0), (13.0, 1.0), (10.0, 6.0)]),             # two spans in a row
         (5, [(0.2, 9.0), (0.4, 9.0), (0.3, 9.4)]), (6, []), (7, None)],                     # between centres, empty, null
        "cell_id long, ring array<struct<x:double,y:double>>")
    got = {(r.y, r.x): r.label for r in R.rasterize_polygons(shapes).collect()}
    want = {(y, x): 1 for y in range(4) for x in range(4)} | {(y, x): 2 for y in range(4) for x in range(4, 7)} | {(2, 2): 3}
    assert {k: v for k, v in got.items() if v != 4} == want
    assert sorted(x for y, x in got if y == 4 and x > 6) == [10, 15] and not any(y == 5 for y, x in got) and sorted(x for y, x in got if y == 0 and x > 6) == list(range(10, 16))

    px = spark.createDataFrame([(p, y, x, 1) for p in range(3) for y in range(4) for x in range(4) if (x + y + p) % 2], "patch int, y int, x int, label int")
    offsets = spark.createDataFrame([(0, 0, 0, 4, 4), (1, 2, 2, 4, 4), (2, 1, 3, 4, 4)], "patch int, oy int, ox int, h int, w int")
    rows = lambda size: sorted(map(tuple, R.place_patches(px, offsets, bin_size=size).collect()))
    assert rows(2) == rows(512) and len(rows(2)) < px.count()


def test_pivots_estimate_and_cover(spark):
    from cytogrid.operators import graph as G
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "src long, dst long, weight double")
    nodes = spark.range(7).withColumnRenamed("id", "cell_id")
    every = {r.cell_id: r.betweenness for r in G.betweenness(edges, nodes).collect()}
    assert [round(every[i] * 30) for i in range(7)] == [2 * i * (6 - i) for i in range(7)]
    assert G.pivots(nodes, 3).count() == 3 and len(G.betweenness(edges, nodes, most=3).collect()) == 7


def test_suffix_merge_and_aligned_concat(spark):
    from cytogrid.operators import summaries as U
    a = spark.createDataFrame([(1, 10), (2, 20), (2, 21), (None, 30)], "k int, v int")
    b = spark.createDataFrame([(2, 5, "x"), (3, 6, "y"), (None, 7, "z")], "k int, v int, w string")
    m = U.merge_suffixed(a, b, ["k"], ("_l", "_r"))
    assert m.columns == ["k", "v_l", "v_r", "w"] and sorted(map(tuple, m.collect())) == [(2, 20, 5, "x"), (2, 21, 5, "x")]
    c = U.concat_aligned({"a": a.where("v in (10, 20)"), "b": b.where("k > 1")}, ["k"])
    assert sorted(map(tuple, c.select("k", "a_v", "b_v", "b_w").collect())) == [(1, 10, None, None), (2, 20, 5, "x"), (3, None, 6, "y")]


def test_central_difference_is_exact_on_a_parabola(spark):
    from cytogrid.operators import summaries as U
    c = spark.range(40).selectExpr("id as x", "cast(id * id as double) as v").repartition(7)
    assert {(r.x, r.slope) for r in U.central_difference(c, ["x"], "v", 0.5).collect()} == {(i, 4.0 * i) for i in range(40)}
    assert [r.slope for r in U.central_difference(c.where("x < 2"), ["x"], "v").collect()] == [None, None]
    assert U.central_difference(c.where("x < 0"), ["x"], "v").collect() == []


def test_copies_of_an_outline_are_joined_once(spark, monkeypatch):
    ring = "array(struct(0d as x, 0d as y), struct(10d as x, 0d as y), struct(10d as x, 10d as y), struct(0d as x, 10d as y))"
    shapes = spark.sql(f"select id + 7 as cell_id, {ring} as ring from range(300)")
    pts = spark.createDataFrame([(1, 5.0, 5.0), (2, 50.0, 5.0)], "pid long, x double, y double")
    seen, hits = [], S._polygon_hits
    monkeypatch.setattr(S, "_polygon_hits", lambda p, s, *a: seen.append(s.count()) or hits(p, s, *a))
    assert {(r.pid, r.shape_id) for r in S.assign_first(pts, shapes, 4.0, ["pid"]).collect()} == {(1, 7), (2, None)}
    assert seen == [1]


def test_rounded_points_on_an_outline_are_outside(spark):
    from cytogrid.sources.driver_tables import HEX
    ring = "array(" + ", ".join(f"struct({37.5 + a * 2.4!r}d as x, {27.5 + b * 2.4!r}d as y)" for a, b in HEX) + ")"
    shapes = spark.sql(f"select 7 as cell_id, {ring} as ring")
    pts = spark.createDataFrame([(1, 36.0, 26.15), (2, 36.0, 26.16), (3, 36.0, 26.14)], "pid long, x double, y double")
    assert {(r.pid, r.shape_id) for r in S.assign_first(pts, shapes, 5.0, ["pid"]).collect()} == {(1, None), (2, 7), (3, None)}


def test_fold_of_a_zero_distance_or_mean_as_in_sql(spark, tmp_path):
    import duckdb
    from cytogrid.plans.catalog import ORACLE, QUERIES
    # user, observed (event 0 of 20), two bootstraps
    rows = [(1, 0.0, 2.0, 3.0), (2, 0.0, 0.0, 0.0), (3, 5.0, 0.0, 0.0), (4, 5.0, 2.0, 3.0), (5, 0.0, None, None), (6, None, 2.0, 3.0), (7, -5.0, 0.0, 0.0), (8, -5.0, 2.0, 4.0)]
    events = [(20 * u + k, u, v) for u, *values in rows for k, v in enumerate(values)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(ORACLE["bootstrap_scores"]).fetchall()
    got = [tuple(r) for r in QUERIES["bootstrap_scores"](spark, str(tmp_path)).collect()]
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, want))


def test_count_table_is_dealt_by_rows(spark, monkeypatch):
    from cytogrid.sources import driver_tables as D
    d = "/root/testdata/sf0.001"
    want = {tuple(r) for r in D.expr(spark, d).collect()}
    monkeypatch.setattr(D, "TASK_ROWS", 500)
    got = D.expr(spark, d)
    assert {tuple(r) for r in got.collect()} == want
    assert got._jdf.queryExecution().toString().count("RepartitionByExpression") >= 2
