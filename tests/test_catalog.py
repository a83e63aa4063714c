"""Catalogue queries against DuckDB on the smallest tables; CYTOGRID_ALL=1 runs every one."""
import os

import duckdb
import pytest

from cytogrid.plans.catalog import COVERS, ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["roi_filter", "spatial_network_summary", "knn_graph", "disparity_directed", "strongest_edges", "count_matrix", "marker_summary", "rank_sum_test",
         "morans_i_gearys_c", "benjamini_hochberg", "transcripts_in_polygons", "raster_lookup", "merge_layers", "lr_pathway_totals", "consensus_relabel",
         "csv_round_trip", "geojson_round_trip", "tile_round_trip", "container_round_trip", "rasterize_polygons", "set_difference", "betweenness"]
NAMES = sorted(ORACLE) if os.environ.get("CYTOGRID_ALL") else QUICK

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=str)
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == cols
    want = sorted(con.sql("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({ORACLE[name]})").fetchall(), key=str)
    assert got == want


def test_every_query_is_mapped():
    assert set(COVERS) == set(QUERIES) and all(COVERS.values())
    assert set(ORACLE) <= set(QUERIES)
