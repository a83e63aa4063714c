import json

from pyspark.sql import functions as F

from cytogrid.operators import metagene, tiles as T
from cytogrid.sources import files as FS


def test_tiles_are_idempotent_and_resumable(spark, tmp_path):
    grid = T.tile_grid(spark, 20, 20, 10, 2)
    path = str(tmp_path / "tiles")
    assert FS.missing_tiles(grid, path).count() == 4
    t = spark.range(100).select("id", (F.col("id") % 2).cast("int").alias("tile_row"), F.lit(0).alias("tile_col"))
    FS.write_tiles(t, path, rows_per_file=10)
    FS.write_tiles(t.where("tile_row = 1"), path, rows_per_file=10)  # rerun of one tile
    assert spark.read.parquet(path).count() == 100
    assert {(r.tile_row, r.tile_col) for r in FS.missing_tiles(grid, path).collect()} == {(0, 1), (1, 1)}


def test_identical_rows_are_spread_over_writers(spark, tmp_path):
    t = spark.range(0, 1000, 1, 10).select(F.lit(7).alias("v"), F.lit(0).alias("tile_row"), F.lit(0).alias("tile_col"))
    path = str(tmp_path / "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        FS.write_tiles(t, path, rows_per_file=100)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = spark.read.parquet(path)
    assert got.count() == 1000 and len(got.inputFiles()) > 2


def test_csv_sniffs_delimiter_and_skips_comments(spark, tmp_path):
    p = tmp_path / "genes.csv"
    p.write_text("# exported\ngene;gene_id\nA;E1\nB;E2\n")
    got = FS.read_csv(spark, str(p), "gene string, gene_id string")
    assert [(r.gene, r.gene_id) for r in got.orderBy("gene").collect()] == [("A", "E1"), ("B", "E2")]
    assert FS.resolve_path("https://x/y.csv", {"https://x/y.csv": "/tmp/y.csv"}) == "/tmp/y.csv"


def test_geojson_ring(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [4, 0], [4, 3]]]}, "properties": {}}]}
    p = tmp_path / "roi.geojson"
    p.write_text(json.dumps(doc, indent=1))
    got = [(r.pos, r.x, r.y) for r in FS.read_geojson_ring(spark, str(p)).orderBy("pos").collect()]
    assert got == [(0, 0.0, 0.0), (1, 4.0, 0.0), (2, 4.0, 3.0)]


def test_json_rows_hide_non_finite(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5)], "k int, v double")
    assert [json.loads(r.json) for r in FS.to_json_rows(df).collect()] == [{"k": 1, "v": None}, {"k": 2, "v": 0.5}]


def test_meta_gene_adds_the_separating_gene(spark):
    cells = spark.range(60).select(F.col("id").alias("cell_id"), F.when(F.col("id") < 20, "t").otherwise("o").alias("cell_type"))
    rows = [(i, "s", 1.0 + (i % 3)) for i in range(60)] + [(i, "good", 5.0) for i in range(20)] + [(i, "bad", 5.0) for i in range(20, 60)]
    expr = spark.createDataFrame(rows, "cell_id long, gene string, value double")
    out = metagene.find_meta_gene(expr, cells, "t", "s", max_iter=1)
    assert out.first().name == "s+good-bad"
    m = {r.cell_type: r.m for r in out.join(cells, "cell_id").groupBy("cell_type").agg(F.avg("meta").alias("m")).collect()}
    assert m["t"] - m["o"] > 9
