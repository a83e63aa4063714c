"""Headline queries, timed once each; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cytogrid.plans.catalog import QUERIES  # noqa: E402
from cytogrid.session import get_session  # noqa: E402

HEADLINE = [
    "spatial_network_summary", "roi_filter", "radius_graph", "radius_pairs_cells", "knn_join_cells", "disparity_backbone",
    "graph_clustering", "delaunay_degree_cells", "neighbour_counts_by_type", "count_matrix", "cell_qc", "normalize_log",
    "align_to_panel", "spatial_bins", "grid_composition", "marker_stats", "welch_t_test", "rank_sum_test", "variable_genes",
    "consensus_relabel", "refine_labels", "morans_i_gearys_c", "neighbour_entropy", "spatial_coexpression", "neighbourhood_enrichment",
    "benjamini_hochberg", "exact_quantiles_by_group", "lr_pair_totals", "cci_matrix", "bivariate_moran", "type_pair_means",
    "transcripts_in_polygons", "raster_lookup", "region_perimeter", "layer_iou", "merge_layers", "halo_ownership", "bootstrap_scores",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
                                                      "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
