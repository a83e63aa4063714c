"""Scalar functions, rankings, set votes, and file round trips."""
from __future__ import annotations

import uuid

from pyspark.sql import Window as W, functions as F

from cytogrid.functions import special as SP
from cytogrid.operators import summaries as U, tiles as T, spatial as S
from cytogrid.operators.ordering import exact_quantiles, global_rank, top_per_group
from cytogrid.plans.registry import query, r
from cytogrid.session import shared_dir
from cytogrid.sources import driver_tables as D, files as FS


# ----------------------------------------------------------------- scalars

@query("parse_overlap", "F1", """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 0 WHEN p_partkey % 7 = 0 THEN 0 ELSE round(p_size::DOUBLE / (p_partkey % 7), 6) END AS ratio FROM part""")
def parse_overlap(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.concat(F.lit("x"), F.col("p_size").cast("string"))).otherwise(F.concat_ws("/", F.col("p_size").cast("string"), (k % 7).cast("string")))
    return D.table(spark, d, "part").select("p_partkey", r(SP.parse_overlap(text)).alias("ratio"))


@query("math_functions", "F2 F3 F4", """SELECT gene, round(-log10(p), 6) AS nlp, round(log2(p * 8), 6) AS l2, round(ln(1 + p), 6) AS l1, round(exp(p), 6) AS ex, round(sqrt(p), 6) AS sq, round(CASE WHEN gene % 10 = 0 THEN 0 ELSE 1::DOUBLE / (gene % 10) END, 6) AS inv FROM pvalues""", "pvalues")
def math_functions(spark, d):
    from cytogrid.operators.graph import inverse_distance
    p = F.col("p")
    return D.pvalues(spark, d).select("gene", r(SP.minus_log10(p)).alias("nlp"), r(F.log2(p * 8)).alias("l2"), r(F.log1p(p)).alias("l1"), r(F.exp(p)).alias("ex"),
                                      r(F.sqrt(p)).alias("sq"), r(SP.finite_or_zero(inverse_distance((F.col("gene") % 10).cast("double")))).alias("inv"))


ERF = """(CASE WHEN z >= 0 THEN 1 ELSE -1 END) AS sg, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2)) AS t"""


@query("normal_tail", "F2 W7", f"""WITH z AS (SELECT event_id, (value - 50) / 40 AS z FROM events), q AS (SELECT event_id, z, {ERF} FROM z),
e AS (SELECT event_id, z, t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-z * z / 2) AS tail FROM q)
SELECT event_id, round(0.5 * CASE WHEN z >= 0 THEN tail ELSE 2 - tail END, 7) + 0::DOUBLE AS p FROM e""")
def normal_tail(spark, d):
    return D.table(spark, d, "events").select("event_id", r(SP.normal_sf((F.col("value") - 50) / 40), 7).alias("p"))


@query("negative_binomial_nll", "F23", """SELECT gene, round(avg(-(lgamma(value + 2) - lgamma(2) - lgamma(value + 1) + 2 * (ln(2 + 1e-8) - ln(2 + 1.5 + 1e-8)) + value * (ln(1.5 + 1e-8) - ln(2 + 1.5 + 1e-8)))), 6) AS nll FROM panel GROUP BY 1""", "panel")
def negative_binomial_nll(spark, d):
    n = SP.negative_binomial_nll(F.col("value"), F.lit(1.5), F.lit(2.0))
    # counts repeat: the likelihood is evaluated once per (gene, value)
    c = D.panel(spark, d).groupBy("gene", "value").agg(F.count(F.lit(1)).alias("k")).withColumn("nll", n)
    return c.groupBy("gene").agg(r(F.sum(F.col("nll") * F.col("k")) / F.sum("k")).alias("nll"))


@query("string_functions", "F5", """SELECT upper(trim('  ' || p_name || ' ')) AS name, split_part(p_name, ' ', 1) AS head, CAST(contains(p_name, 'ring') AS INT) AS has_ring, CAST(starts_with(p_brand, 'Brand#1') AS INT) AS b1, regexp_replace(p_brand, '[^0-9]', '', 'g') AS num, count(*) AS n FROM part GROUP BY ALL""")
def string_functions(spark, d):
    p = D.table(spark, d, "part").select(
        F.upper(F.trim(F.concat(F.lit("  "), "p_name", F.lit(" ")))).alias("name"), F.split("p_name", " ", 2)[0].alias("head"), F.contains("p_name", F.lit("ring")).cast("int").alias("has_ring"),
        F.startswith("p_brand", F.lit("Brand#1")).cast("int").alias("b1"), F.regexp_replace("p_brand", "[^0-9]", "").alias("num"))
    return p.groupBy(*p.columns).agg(F.count(F.lit(1)).alias("n"))


@query("split_pairs", "F5 J16", """SELECT split_part(pair, '-', 1) AS ligand, split_part(pair, '-', 2) AS receptor FROM (SELECT ligand || '-' || receptor AS pair FROM lr)""", "lr")
def split_pairs(spark, d):
    p = D.lr(spark, d).select(F.concat_ws("-", "ligand", "receptor").alias("pair"))
    return p.select(*[c.alias(n) for n, c in SP.split_pair(F.col("pair")).items()])


@query("json_access", "F14 S9", """SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS BIGINT) AS k FROM events GROUP BY 1""")
def json_access(spark, d):
    e = D.table(spark, d, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))


@query("array_functions", "F15", """SELECT vec_id, round(least(embedding[1]::DOUBLE, 0.1), 6) AS head, round(list_sum(list_transform(embedding[1:8], lambda v: v::DOUBLE)), 6) AS s8, CAST(list_position(embedding, list_max(embedding)) AS INT) AS argmax FROM embeddings""")
def array_functions(spark, d):
    e = F.col("embedding")
    dbl = F.transform(F.slice(e, 1, 8), lambda v: v.cast("double"))
    return D.table(spark, d, "embeddings").select("vec_id", r(F.least(e[0].cast("double"), F.lit(0.1))).alias("head"), r(F.aggregate(dbl, F.lit(0.0), lambda a, v: a + v)).alias("s8"),
                                                  F.array_position(e, F.array_max(e)).cast("int").alias("argmax"))


@query("one_hot", "F9", """SELECT niche, CAST(sum(CASE WHEN cell_type = 'AUTOMOBILE' THEN 1 ELSE 0 END) AS BIGINT) AS is_automobile, CAST(sum(CASE WHEN cell_type = 'BUILDING' THEN 1 ELSE 0 END) AS BIGINT) AS is_building,
CAST(sum(CASE WHEN cell_type = 'FURNITURE' THEN 1 ELSE 0 END) AS BIGINT) AS is_furniture, CAST(sum(CASE WHEN cell_type = 'HOUSEHOLD' THEN 1 ELSE 0 END) AS BIGINT) AS is_household,
CAST(sum(CASE WHEN cell_type = 'MACHINERY' THEN 1 ELSE 0 END) AS BIGINT) AS is_machinery FROM cells GROUP BY 1""", "cells")
def one_hot(spark, d):
    cells = D.cells(spark, d)
    types = [t.cell_type for t in cells.select("cell_type").distinct().orderBy("cell_type").collect()]  # one output column each
    return cells.groupBy("niche").agg(*[F.sum((F.col("cell_type") == t).cast("long")).alias(f"is_{t.lower()}") for t in types])


@query("category_codes", "W8", """SELECT niche, CAST(dense_rank() OVER (ORDER BY niche) - 1 AS BIGINT) AS code FROM (SELECT DISTINCT niche FROM cells)""", "cells")
def category_codes(spark, d):
    return global_rank(D.cells(spark, d).select("niche").distinct(), ["niche"], "code").withColumn("code", F.col("code") - 1)


# ---------------------------------------------------------------- rankings

@query("ranked_scores", "W1 W13", """SELECT gene, row_number() OVER (ORDER BY p, gene) AS svg_rank, 'gene_' || row_number() OVER (ORDER BY p, gene) AS name FROM pvalues""", "pvalues")
def ranked_scores(spark, d):
    return global_rank(D.pvalues(spark, d), ["p", "gene"], "svg_rank").select("gene", "svg_rank", F.concat(F.lit("gene_"), F.col("svg_rank").cast("string")).alias("name"))


@query("min_max_scale", "W10", """SELECT cell_id, round((cell_area - min(cell_area) OVER (PARTITION BY cell_type)) / (max(cell_area) OVER (PARTITION BY cell_type) - min(cell_area) OVER (PARTITION BY cell_type)), 6) AS scaled FROM cells""", "cells")
def min_max_scale(spark, d):
    c = D.cells(spark, d)
    m = c.groupBy("cell_type").agg(F.min("cell_area").alias("a"), F.max("cell_area").alias("b"))
    return c.join(m, "cell_type").select("cell_id", r((F.col("cell_area") - F.col("a")) / (F.col("b") - F.col("a"))).alias("scaled"))


@query("discrete_difference", "W12", """SELECT k, n, coalesce(n - lag(n) OVER (ORDER BY k), 0) AS rise FROM (SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1)""")
def discrete_difference(spark, d):
    c = D.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    ranked = global_rank(c, ["k"], "_r")
    prev = ranked.select((F.col("_r") + 1).alias("_r"), F.col("n").alias("_p"))
    return ranked.join(prev, "_r", "left").select("k", "n", F.coalesce(F.col("n") - F.col("_p"), F.lit(0)).alias("rise"))


@query("central_difference", "W12", """WITH c AS (SELECT l_suppkey AS k, count(*)::DOUBLE AS n FROM lineitem GROUP BY 1),
w AS (SELECT k, n, lag(n) OVER o AS p1, lag(n, 2) OVER o AS p2, lead(n) OVER o AS q1, lead(n, 2) OVER o AS q2 FROM c WINDOW o AS (ORDER BY k))
SELECT k, round(CASE WHEN p1 IS NULL THEN -1.5 * n + 2 * q1 - 0.5 * q2 WHEN q1 IS NULL THEN 1.5 * n - 2 * p1 + 0.5 * p2 ELSE (q1 - p1) / 2 END, 6) AS slope FROM w""")
def central_difference(spark, d):
    c = D.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return U.central_difference(c, ["k"], "n").select("k", r("slope").alias("slope"))


@query("density_histogram", "A25", """WITH e AS (SELECT min(value) AS a, max(value) AS b, count(*) AS n FROM events), c AS (SELECT CAST(least(99, floor((value - a) / ((b - a) / 100))) AS INT) AS bin, count(*) AS k FROM events, e GROUP BY 1)
SELECT CAST(i AS INT) AS bin, coalesce(k, 0) AS n, round(a + i * ((b - a) / 100), 6) AS "left", round(coalesce(k, 0) / (n * ((b - a) / 100)), 6) AS density FROM range(100) t(i) CROSS JOIN e LEFT JOIN c ON bin = i""")
def density_histogram(spark, d):
    h = U.histogram(D.table(spark, d, "events").select("value"), "value", 100)
    return h.select("bin", "n", r("left").alias("left"), r("density").alias("density"))


@query("steepest_rise", "A25", """WITH e AS (SELECT min(value) AS a, max(value) AS b FROM events), c AS (SELECT CAST(least(99, floor((value - a) / ((b - a) / 100))) AS INT) AS bin, count(*) AS k FROM events, e GROUP BY 1),
h AS (SELECT i, coalesce(k, 0) AS k FROM range(100) t(i) LEFT JOIN c ON bin = i), d AS (SELECT i, lead(k) OVER (ORDER BY i) - k AS rise FROM h)
SELECT round(a + arg_max(i, (rise, -i)) * ((b - a) / 100), 6) AS threshold FROM d, e WHERE rise IS NOT NULL GROUP BY a, b""")
def steepest_rise(spark, d):
    return U.steepest_rise(U.histogram(D.table(spark, d, "events").select("value"), "value", 100)).select(r("threshold").alias("threshold"))


@query("elbow_index", "T9", """WITH c AS (SELECT p_size AS k, count(*) * (51 - p_size) * 1.0::DOUBLE AS v FROM part GROUP BY 1), pk AS (SELECT arg_max(k, (v, -k)) AS i0, max(v) AS v0, max(k) AS last, arg_max(v, k) AS v1 FROM c),
p AS (SELECT k, (k - i0)::DOUBLE AS px, v - v0 AS py, (last - i0 + 1)::DOUBLE AS bx, v1 - v0 AS by_, i0 FROM c, pk WHERE k >= i0),
s AS (SELECT *, (px * bx + py * by_) / (bx * bx + by_ * by_) AS s FROM p)
SELECT arg_max(k, (CASE WHEN k = i0 THEN 0 ELSE round(sqrt((px - s * bx) * (px - s * bx) + (py - s * by_) * (py - s * by_)), 9) END, -k)) AS elbow FROM s""")
def elbow_index(spark, d):
    c = D.table(spark, d, "part").groupBy(F.col("p_size").alias("k")).agg((F.count(F.lit(1)) * (51 - F.col("p_size")) * 1.0).alias("v"))
    return U.elbow(c, "k", "v")


@query("top_terms", "T1 F1", """SELECT p_name AS term, count(*) AS n, round(avg(p_retailprice), 4) AS score FROM part GROUP BY 1 ORDER BY score DESC, term LIMIT 20""")
def top_terms(spark, d):
    t = D.table(spark, d, "part").groupBy(F.col("p_name").alias("term")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("p_retailprice"), 4).alias("score"))
    return U.top_k(t, [F.desc("score"), F.asc("term")], 20)


@query("first_per_key", "T3", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1""")
def first_per_key(spark, d):
    o = D.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return U.first_per_key(o, "o_custkey", F.struct("o_totalprice", "o_orderkey"))


@query("above_kth_value", "T5", """SELECT l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > (SELECT qty FROM (SELECT sum(l_quantity) AS qty FROM lineitem GROUP BY l_partkey ORDER BY qty DESC LIMIT 1 OFFSET 50))""")
def above_kth_value(spark, d):
    t = D.table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("qty"))
    return U.above_kth(t, "qty", 50, "l_partkey")


@query("ordered_unique", "T7 T10", """SELECT p_type AS name, min(p_partkey) AS first_at FROM part GROUP BY 1 ORDER BY first_at LIMIT 6""")
def ordered_unique(spark, d):
    return D.table(spark, d, "part").groupBy(F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("first_at")).orderBy("first_at").limit(6)


@query("exact_quantiles_by_group", "A7 W11", """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS q05, round(quantile_cont(l_extendedprice, 0.95), 4) AS q95 FROM lineitem GROUP BY 1""")
def exact_quantiles_by_group(spark, d):
    q = exact_quantiles(D.table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), "l_extendedprice", {"q05": 0.05, "q95": 0.95}, ["l_returnflag"])
    return q.select("l_returnflag", r("q05", 4).alias("q05"), r("q95", 4).alias("q95"))


# -------------------------------------------------------------------- sets

SETS = "s AS (SELECT DISTINCT 'm' || (l_linenumber % 4) AS method, l_orderkey AS gene FROM lineitem)"


def _sets(spark, d):
    return D.table(spark, d, "lineitem").select(F.concat(F.lit("m"), (F.col("l_linenumber") % 4).cast("string")).alias("method"), F.col("l_orderkey").alias("gene")).distinct()


@query("consensus_genes", "U1", f"WITH {SETS} SELECT gene FROM s GROUP BY 1 HAVING count(DISTINCT method) = (SELECT count(DISTINCT method) FROM s)")
def consensus_genes(spark, d):
    return U.consensus(_sets(spark, d))


@query("method_agreement", "U2", f"""WITH {SETS}, v AS (SELECT gene, count(*) AS votes FROM s GROUP BY 1) SELECT votes, count(*) AS n FROM v GROUP BY 1""")
def method_agreement(spark, d):
    return U.set_votes(_sets(spark, d)).groupBy("votes").agg(F.count(F.lit(1)).alias("n"))


@query("pairwise_set_overlap", "U2", f"WITH {SETS} SELECT a.method AS method_a, b.method AS method_b, count(*) AS shared FROM s a JOIN s b USING (gene) WHERE a.method < b.method GROUP BY 1, 2")
def pairwise_set_overlap(spark, d):
    return U.pairwise_overlap(_sets(spark, d))


@query("set_difference", "U3 U6", f"WITH {SETS} SELECT gene FROM s WHERE method = 'm1' EXCEPT SELECT gene FROM s WHERE method = 'm2'")
def set_difference(spark, d):
    s = _sets(spark, d)
    return s.where("method = 'm1'").select("gene").join(s.where("method = 'm2'").select("gene"), "gene", "left_anti")


# ------------------------------------------------------------ round trips

def _scratch(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("csv_round_trip", "S7 K2", "SELECT p_partkey, p_name, p_retailprice FROM part")
def csv_round_trip(spark, d):
    path = _scratch(spark, "genes-csv")
    FS.write_csv(D.table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), path)
    return FS.read_csv(spark, path, "p_partkey bigint, p_name string, p_retailprice double")


@query("geojson_round_trip", "K4 S9 S5", "SELECT CAST(cell_id AS VARCHAR) AS cell_id, round(r * r * 2.25, 6) AS area FROM shapes", "shapes")
def geojson_round_trip(spark, d):
    path = _scratch(spark, "shapes-geojson")
    FS.write_geojson_lines(D.shapes(spark, d), path)
    return S.polygon_metrics(FS.read_geojson_lines(spark, path)).select("cell_id", r("area").alias("area"))


@query("tile_round_trip", "K3 R8 S6", """SELECT CAST(floor(y / 10) AS INT) AS tile_row, CAST(floor(x / 10) AS INT) AS tile_col, count(*) AS n FROM transcripts GROUP BY 1, 2""", "transcripts")
def tile_round_trip(spark, d):
    path = _scratch(spark, "tiles")
    t = D.transcripts(spark, d).select("x", "y", "feature_name", F.floor(F.col("y") / 10).cast("int").alias("tile_row"), F.floor(F.col("x") / 10).cast("int").alias("tile_col"))
    FS.write_tiles(t, path)
    return spark.read.parquet(path).groupBy("tile_row", "tile_col").agg(F.count(F.lit(1)).alias("n"))


@query("json_metrics", "K5", """SELECT '{"cell_type":"' || cell_type || '","n":' || count(*) || '}' AS json FROM cells GROUP BY cell_type""", "cells")
def json_metrics(spark, d):
    return FS.to_json_rows(D.cells(spark, d).groupBy("cell_type").agg(F.count(F.lit(1)).alias("n")))


@query("container_round_trip", "S1 S2 K1", """SELECT cell_type, count(*) AS n, sum(value) AS total FROM expr JOIN cells USING (cell_id) GROUP BY 1""", "cells expr")
def container_round_trip(spark, d):
    path = _scratch(spark, "container")
    FS.write_elements({"cells": D.cells(spark, d), "expr": D.expr(spark, d)}, path)
    e = FS.read_elements(spark, path, ["cells", "expr"])
    return e["expr"].join(e["cells"].select("cell_id", "cell_type"), "cell_id").groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
