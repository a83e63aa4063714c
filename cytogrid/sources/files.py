"""Readers and writers for the pipeline's tables: parquet elements, CSV, GeoJSON, tiles."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

GEOJSON = ("type string, features array<struct<type:string,geometry:struct<type:string,coordinates:array<array<array<double>>>>,"
           "properties:map<string,string>>>")


def read_elements(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """Named elements (cells, expr, genes, transcripts, shapes, labels) of one converted container."""
    return {n: spark.read.parquet(f"{root}/{n}") for n in names}


def write_elements(elements: Mapping[str, DataFrame], root: str) -> None:
    for name, df in elements.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def read_csv(spark: SparkSession, path: str, schema: str, sep: str | None = None, comment: str | None = "#") -> DataFrame:
    """Headered CSV with a fixed schema; ``sep=None`` picks the most frequent of , ; tab | in the header line."""
    if sep is None:
        rows = spark.read.text(path)
        if comment:
            rows = rows.where(~F.startswith(F.col("value"), F.lit(comment)))
        line = rows.first()
        head = line[0] if line else ""
        sep = max(",;\t|", key=head.count)
    reader = spark.read.option("header", True).option("sep", sep).option("mode", "FAILFAST").schema(schema)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def resolve_path(path: str, local: Mapping[str, str]) -> str:
    """Map known URLs to local copies."""
    return local.get(path, path)


def read_geojson_ring(spark: SparkSession, path: str) -> DataFrame:
    """Outer ring of every feature: (feature, pos, x, y)."""
    doc = spark.read.schema(GEOJSON).option("multiLine", True).json(path)
    f = doc.select(F.posexplode("features").alias("feature", "f"))
    return (f.select("feature", F.posexplode(F.col("f.geometry.coordinates")[0]).alias("pos", "v"))
            .select("feature", "pos", F.col("v")[0].alias("x"), F.col("v")[1].alias("y")))


def geojson_features(shapes: DataFrame, shape_id: str = "cell_id", ring: str = "ring") -> DataFrame:
    """One GeoJSON Feature text per polygon."""
    coords = F.array(F.transform(F.col(ring), lambda v: F.array(v["x"], v["y"])))
    return shapes.select(F.col(shape_id), F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry"),
        F.struct(F.col(shape_id).cast("string").alias("cell_id")).alias("properties"))).alias("feature"))


def write_geojson_lines(shapes: DataFrame, path: str, **kw) -> None:
    """Newline-delimited features, written in parallel."""
    geojson_features(shapes, **kw).select("feature").write.mode("overwrite").text(path)


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    s = "type string, geometry struct<type:string,coordinates:array<array<array<double>>>>, properties map<string,string>"
    t = spark.read.text(path).select(F.from_json("value", s).alias("f"))
    return t.select(F.col("f.properties")["cell_id"].alias("cell_id"), F.transform(
        F.col("f.geometry.coordinates")[0], lambda v: F.struct(v[0].alias("x"), v[1].alias("y"))).alias("ring"))


def write_tiles(df: DataFrame, path: str, rows_per_file: int = 2_000_000) -> None:
    """One directory per tile; only the tiles present in ``df`` are replaced.

    A tile is spread over as many writers as its row count asks for, so a
    crowded one is no bottleneck; rerunning a tile is idempotent.
    """
    tile = ["tile_row", "tile_col"]
    split = df.groupBy(*tile).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file)).alias("_n"))
    # hashed before any shuffle: the input partition tells identical rows apart
    salted = df.withColumn("_h", F.xxhash64(*df.columns) + F.spark_partition_id())
    (salted.join(split, tile).withColumn("_p", F.pmod("_h", "_n")).repartition(*tile, "_p").select(*df.columns)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*tile).parquet(path))


def missing_tiles(grid: DataFrame, path: str) -> DataFrame:
    """Tiles of ``grid`` with no output yet (all of them when nothing was written)."""
    spark = grid.sparkSession
    try:
        done = spark.read.parquet(path).select("tile_row", "tile_col").distinct()
    except Exception as e:  # nothing written so far
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return grid
    return grid.join(done, ["tile_row", "tile_col"], "left_anti")


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, non-finite numbers as null."""
    cols = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))
