"""Filters, quality control, normalisation, markers and per-gene tests."""
from __future__ import annotations

from pyspark.sql import functions as F

from cytogrid.operators import expression as X, multitest as MT
from cytogrid.operators.ordering import exact_quantiles, global_rank, top_per_group
from cytogrid.plans.registry import query, r
from cytogrid.sources import driver_tables as D


# ---------------------------------------------------------------- filters

@query("transcript_scan", "S4 P3", """SELECT feature_name, count(*) AS n, round(avg(x), 6) AS mean_x FROM transcripts
WHERE is_gene AND qv >= 20 GROUP BY 1""", "transcripts")
def transcript_scan(spark, d):
    t = D.transcripts(spark, d).where(F.col("is_gene") & (F.col("qv") >= 20))
    return t.groupBy("feature_name").agg(F.count(F.lit(1)).alias("n"), r(F.avg("x")).alias("mean_x"))


@query("point_layers_union", "S6 U4", """SELECT layer, count(*) AS n FROM (SELECT 'a' AS layer, x FROM transcripts WHERE is_gene
UNION ALL SELECT 'b', x FROM transcripts WHERE NOT is_gene UNION ALL SELECT 'c', x FROM cells) GROUP BY 1""", "transcripts cells")
def point_layers_union(spark, d):
    t = D.transcripts(spark, d)
    tag = lambda df, l: df.select(F.lit(l).alias("layer"), "x")
    a = tag(t.where("is_gene"), "a").unionByName(tag(t.where(~F.col("is_gene")), "b")).unionByName(tag(D.cells(spark, d), "c"))
    return a.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


@query("crop_half_open", "P2 S17", """SELECT feature_name, count(*) AS n FROM transcripts WHERE x >= 10 AND x < 30 AND y >= 5 AND y < 25 GROUP BY 1""", "transcripts")
def crop_half_open(spark, d):
    from cytogrid.operators.tiles import crop
    return crop(D.transcripts(spark, d), 10, 30, 5, 25).groupBy("feature_name").agg(F.count(F.lit(1)).alias("n"))


@query("filter_cells", "P5", """SELECT cell_id, sum(value) AS total, count(*) AS n_genes FROM panel GROUP BY 1
HAVING sum(value) >= 30 AND sum(value) <= 60 AND count(*) >= 20""", "panel")
def filter_cells(spark, d):
    e = X.filter_cells(D.panel(spark, d), min_counts=30, max_counts=60, min_genes=20)
    return e.groupBy("cell_id").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_genes"))


@query("filter_genes", "P6", """SELECT gene, sum(value) AS total, count(*) AS n_cells FROM panel GROUP BY 1
HAVING count(*) >= (SELECT 0.22 * count(*) FROM customer)""", "panel")
def filter_genes(spark, d):
    n = D.cells(spark, d).count()
    e = X.filter_genes(D.panel(spark, d), min_cells=-(-22 * n // 100))
    return e.groupBy("gene").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n_cells"))


@query("filter_special_genes", "P7 P8 F5", """WITH f AS (SELECT CASE p_partkey % 9 WHEN 0 THEN 'ERCC-' WHEN 1 THEN 'MT-' WHEN 2 THEN 'NegControlProbe_'
WHEN 3 THEN 'Intergenic_Region_' WHEN 4 THEN 'xDeprecatedCodeword' ELSE '' END || p_name AS feature FROM part)
SELECT CASE WHEN feature LIKE 'ERCC%' OR feature LIKE 'MT-%' THEN 'special' WHEN contains(feature, 'NegControlProbe') OR contains(feature, 'Intergenic_Region')
 OR contains(feature, 'NegControlCodeword') OR contains(feature, 'UnassignedCodeword') OR contains(feature, 'DeprecatedCodeword') THEN 'control' ELSE 'gene' END AS class,
 count(*) AS n FROM f GROUP BY 1""")
def filter_special_genes(spark, d):
    m = F.col("p_partkey") % 9
    pre = (F.when(m == 0, "ERCC-").when(m == 1, "MT-").when(m == 2, "NegControlProbe_").when(m == 3, "Intergenic_Region_")
           .when(m == 4, "xDeprecatedCodeword").otherwise(""))
    f = D.table(spark, d, "part").select(F.concat(pre, "p_name").alias("feature"))
    c = F.when(X.is_special(F.col("feature")), "special").when(X.is_control(F.col("feature")), "control").otherwise("gene")
    return f.groupBy(c.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("align_to_panel", "P9 J18 U3", """WITH want AS (SELECT gene, row_number() OVER (ORDER BY gene) AS pos FROM (SELECT DISTINCT gene FROM expr UNION SELECT 'Missing#1' UNION SELECT 'Missing#2'))
SELECT gene, pos, count(*) AS n_cells, sum(coalesce(value, 0)) AS total, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_zero
FROM cells CROSS JOIN want LEFT JOIN expr USING (cell_id, gene) GROUP BY 1, 2""", "cells expr")
def align_to_panel(spark, d):
    e = D.expr(spark, d)
    extra = D.genes(spark, d).unionByName(spark.createDataFrame([("Missing#1",), ("Missing#2",)], "gene string"))
    want = global_rank(extra, ["gene"], "pos")
    a = X.align_to_panel(e, D.cells(spark, d), want)
    return a.groupBy("gene", "pos").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("value").alias("total"),
                                        F.sum((F.col("value") == 0).cast("long")).alias("n_zero"))


@query("min_transcripts", "P11 P19", """SELECT cell_id, coalesce(n, 0) AS n FROM cells LEFT JOIN
(SELECT o_custkey AS cell_id, count(*) AS n FROM orders GROUP BY 1) USING (cell_id) WHERE coalesce(n, 0) >= 10""", "cells")
def min_transcripts(spark, d):
    o = D.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cell_id")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return D.cells(spark, d).select("cell_id").join(o, "cell_id", "left").where(n >= 10).select("cell_id", n.alias("n"))


@query("positive_scores", "P15 F13", """SELECT event_type, count(*) AS n, round(max(greatest(value - 100, 0)), 6) AS top FROM events WHERE value - 100 > 0 GROUP BY 1""")
def positive_scores(spark, d):
    e = D.table(spark, d, "events").withColumn("s", F.col("value") - 100).where(F.col("s") > 0)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), r(F.max(F.greatest("s", F.lit(0.0)))).alias("top"))


@query("marker_table_filter", "P16 P21", """SELECT p_type AS cell_type, p_brand AS gene FROM part JOIN (SELECT DISTINCT gene FROM expr) ON gene = p_brand
WHERE p_size % 3 = 0 GROUP BY 1, 2""", "expr")
def marker_table_filter(spark, d):
    p = D.table(spark, d, "part").withColumn("recommendation", F.when(F.col("p_size") % 3 == 0, "USE THIS GENE").otherwise("REVIEW"))
    m = p.where(F.col("recommendation") == "USE THIS GENE").select(F.col("p_type").alias("cell_type"), F.col("p_brand").alias("gene")).distinct()
    return m.join(D.expr(spark, d).select("gene").distinct(), "gene", "left_semi")


@query("rename_derive", "P17", """SELECT upper(replace(replace(p_name, ' ', '_'), '_', '-')) AS gene, regexp_replace('s-' || p_brand, '^[sr]-', '') AS pair, count(*) AS n FROM part GROUP BY 1, 2""")
def rename_derive(spark, d):
    p = D.table(spark, d, "part").select(
        F.upper(F.translate(F.translate("p_name", " ", "_"), "_", "-")).alias("gene"),
        F.regexp_replace(F.concat(F.lit("s-"), "p_brand"), "^[sr]-", "").alias("pair"))
    return p.groupBy("gene", "pair").agg(F.count(F.lit(1)).alias("n"))


@query("lr_table_filter", "P18 J17", """SELECT pathway_name, signaling_type, count(*) AS n FROM lr
WHERE signaling_type = 'Secreted Signaling' AND ligand IN (SELECT gene FROM expr) AND receptor IN (SELECT gene FROM expr) GROUP BY 1, 2""", "lr expr")
def lr_table_filter(spark, d):
    g = D.expr(spark, d).select("gene").distinct()
    l = D.lr(spark, d).where(F.col("signaling_type") == "Secreted Signaling")
    l = l.join(g.select(F.col("gene").alias("ligand")), "ligand", "left_semi").join(g.select(F.col("gene").alias("receptor")), "receptor", "left_semi")
    return l.groupBy("pathway_name", "signaling_type").agg(F.count(F.lit(1)).alias("n"))


@query("subsample_cells", "P20", """SELECT cell_type, count(*) AS n FROM cells WHERE ('0x' || substr(md5(cell_id::VARCHAR || ':42'), 1, 8))::BIGINT < 0.2 * 4294967296 GROUP BY 1""", "cells")
def subsample_cells(spark, d):
    """Seeded fraction of the cells by a hash of their id, whatever the partitioning; sampling is the feature."""
    h = F.conv(F.substring(F.md5(F.concat(F.col("cell_id").cast("string"), F.lit(":42"))), 1, 8), 16, 10).cast("long")
    return D.cells(spark, d).where(h < 0.2 * 2 ** 32).groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------- equi joins, ids

@query("join_on_coordinates", "J4", """SELECT count(*) AS n, round(sum(b.qv), 4) AS qv FROM transcripts a LEFT JOIN
(SELECT x, y, order_id, max(qv) AS qv FROM transcripts WHERE is_gene GROUP BY 1, 2, 3) b ON a.x = b.x AND a.y = b.y AND a.order_id = b.order_id""", "transcripts")
def join_on_coordinates(spark, d):
    t = D.transcripts(spark, d)
    b = t.where("is_gene").groupBy("x", "y", "order_id").agg(F.max("qv").alias("qb"))
    return t.join(b, ["x", "y", "order_id"], "left").agg(F.count(F.lit(1)).alias("n"), r(F.sum("qb"), 4).alias("qv"))


@query("merge_with_suffix", "J5", """SELECT gene, a.total AS total_full, b.total AS total_null, round(a.total - coalesce(b.total, 0), 6) AS llr FROM
(SELECT gene, sum(value) AS total FROM panel GROUP BY 1) a LEFT JOIN (SELECT gene, sum(value) AS total FROM panel WHERE value > 1 GROUP BY 1) b USING (gene)""", "panel")
def merge_with_suffix(spark, d):
    from cytogrid.operators.summaries import merge_suffixed
    e = D.panel(spark, d)
    total = lambda x: x.groupBy("gene").agg(F.sum("value").alias("total"))
    a = merge_suffixed(total(e), total(e.where(F.col("value") > 1)), ["gene"], ("_full", "_null"), "left")
    return a.withColumn("llr", r(F.col("total_full") - F.coalesce("total_null", F.lit(0.0))))


@query("concat_aligned", "J7", """SELECT gene, low_n, low_total, high_n, high_total FROM
(SELECT gene, count(*) AS low_n, sum(value) AS low_total FROM panel WHERE value <= 1 GROUP BY 1) FULL JOIN (SELECT gene, count(*) AS high_n, sum(value) AS high_total FROM panel WHERE value > 1 GROUP BY 1) USING (gene)""", "panel")
def concat_aligned(spark, d):
    from cytogrid.operators.summaries import concat_aligned as op
    e = D.panel(spark, d)
    part = lambda x: x.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return op({"low": part(e.where("value <= 1")), "high": part(e.where("value > 1"))}, ["gene"])


@query("map_ids_with_fallback", "J6 S15 F16", """WITH m AS (SELECT p_brand AS k, arg_max(p_name, p_partkey) AS v FROM part WHERE p_size > 45 AND p_partkey % 2 = 0 GROUP BY 1)
SELECT coalesce(v, gene) AS mapped, sum(value) AS total FROM expr LEFT JOIN m ON k = gene GROUP BY 1""", "expr")
def map_ids_with_fallback(spark, d):
    m = D.table(spark, d, "part").where((F.col("p_size") > 45) & (F.col("p_partkey") % 2 == 0)).select("p_brand", "p_name", "p_partkey")
    j = X.map_with_fallback(D.expr(spark, d), "gene", m, "p_brand", "p_name", "p_partkey")
    return j.groupBy("mapped").agg(F.sum("value").alias("total"))


@query("id_overlap", "J8", """SELECT (SELECT count(*) FROM cells WHERE cell_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)) AS both,
(SELECT count(*) FROM cells WHERE cell_id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)) AS cells_only""", "cells")
def id_overlap(spark, d):
    c = D.cells(spark, d).select("cell_id")
    o = D.table(spark, d, "orders").where(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("cell_id")).distinct().withColumn("hit", F.lit(1))
    return c.join(o, "cell_id", "left").agg(F.count("hit").alias("both"), F.sum(F.isnull("hit").cast("long")).alias("cells_only"))


@query("concat_inner", "J19", """WITH a AS (SELECT * FROM panel WHERE cell_id % 2 = 0), b AS (SELECT * FROM panel WHERE cell_id % 2 = 1 AND value > 1)
SELECT batch, count(*) AS n, sum(value) AS total FROM (SELECT '0' AS batch, * FROM a UNION ALL SELECT '1', * FROM b)
WHERE gene IN (SELECT gene FROM a INTERSECT SELECT gene FROM b) GROUP BY 1""", "panel")
def concat_inner(spark, d):
    e = D.panel(spark, d)
    a, b = e.where(F.col("cell_id") % 2 == 0), e.where((F.col("cell_id") % 2 == 1) & (F.col("value") > 1))
    shared = a.select("gene").intersect(b.select("gene"))
    u = a.withColumn("batch", F.lit("0")).unionByName(b.withColumn("batch", F.lit("1"))).join(shared, "gene", "left_semi")
    return u.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("unique_names", "W13 K9", """SELECT CASE WHEN k > 1 THEN p_name || '-' || (k - 1) ELSE p_name END AS p_name, p_partkey FROM
(SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k FROM part)""")
def unique_names(spark, d):
    return X.unique_names(D.table(spark, d, "part").select("p_name", "p_partkey"), "p_name", "p_partkey")


@query("sanitise", "K9", """SELECT coalesce(CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) END, 'NA') AS size, count(*) AS n FROM part GROUP BY 1""")
def sanitise(spark, d):
    p = D.table(spark, d, "part").select(F.when(F.col("p_size") > 10, F.col("p_size")).alias("size"))
    return X.sanitise(p, {"size": "string"}).groupBy("size").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------- counting

@query("count_matrix", "A1 A2", """SELECT cell_id, feature_name, count(*) AS n FROM transcripts GROUP BY 1, 2""", "transcripts")
def count_matrix(spark, d):
    return X.count_matrix(D.transcripts(spark, d))


@query("count_matrix_wide", "A1 C11", """SELECT cell_id, CAST(count(*) FILTER (feature_name = 'AF') AS BIGINT) AS AF, CAST(count(*) FILTER (feature_name = 'AO') AS BIGINT) AS AO,
CAST(count(*) FILTER (feature_name = 'NF') AS BIGINT) AS NF, CAST(count(*) FILTER (feature_name = 'NO') AS BIGINT) AS NO,
CAST(count(*) FILTER (feature_name = 'RF') AS BIGINT) AS RF, CAST(count(*) FILTER (feature_name = 'RO') AS BIGINT) AS RO FROM transcripts GROUP BY 1""", "transcripts")
def count_matrix_wide(spark, d):
    m = X.count_matrix(D.transcripts(spark, d))
    return m.groupBy("cell_id").pivot("feature_name", ["AF", "AO", "NF", "NO", "RF", "RO"]).sum("n").fillna(0)


@query("value_counts", "A3 A4", """SELECT cell_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM cells GROUP BY 1""", "cells")
def value_counts(spark, d):
    c = D.cells(spark, d).groupBy("cell_type").agg(F.count(F.lit(1)).alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("t")))).select("cell_type", "n", r(100.0 * F.col("n") / F.col("t")).alias("pct"))


@query("crosstab_row_share", "A5 A6", """WITH g AS (SELECT * FROM (SELECT DISTINCT niche FROM cells), (SELECT DISTINCT cell_type FROM cells)),
c AS (SELECT niche, cell_type, count(*) AS n FROM cells GROUP BY 1, 2)
SELECT niche, cell_type, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY niche), 6) AS share FROM g LEFT JOIN c USING (niche, cell_type)""", "cells")
def crosstab_row_share(spark, d):
    from cytogrid.operators.summaries import crosstab
    return crosstab(D.cells(spark, d), "niche", "cell_type").withColumn("share", r("share"))


@query("describe_by_type", "A7", """SELECT cell_type, count(*) AS n, round(avg(cell_area), 6) AS mean, round(stddev_samp(cell_area), 6) AS std, min(cell_area) AS lo,
round(quantile_cont(cell_area, 0.25), 6) AS q25, round(quantile_cont(cell_area, 0.5), 6) AS q50, round(quantile_cont(cell_area, 0.75), 6) AS q75, max(cell_area) AS hi FROM cells GROUP BY 1""", "cells")
def describe_by_type(spark, d):
    from cytogrid.operators.summaries import describe
    out = describe(D.cells(spark, d), "cell_area", ["cell_type"])
    return out.select("cell_type", "n", *[r(c).alias(c) for c in ("mean", "std", "q25", "q50", "q75")], "lo", "hi")


@query("group_mean_metrics", "A8 A32", """SELECT niche, round(avg(conf), 6) AS conf, round(avg(cell_area), 6) AS area FROM cells GROUP BY 1""", "cells")
def group_mean_metrics(spark, d):
    return D.cells(spark, d).groupBy("niche").agg(r(F.avg("conf")).alias("conf"), r(F.avg("cell_area")).alias("area"))


@query("spatial_bins", "A9", """SELECT CAST(floor(x / 5) AS BIGINT) || '_' || CAST(floor(y / 5) AS BIGINT) AS bin_id, gene, sum(value) AS value
FROM expr JOIN cells USING (cell_id) GROUP BY 1, 2""", "cells expr")
def spatial_bins(spark, d):
    return X.spatial_bins(D.expr(spark, d), D.cells(spark, d), 5.0).select("bin_id", "gene", "value")


GRID_SQL = """WITH e AS (SELECT min(x) AS x0, (max(x) - min(x)) / {a}::DOUBLE AS sx, min(y) AS y0, (max(y) - min(y)) / {b}::DOUBLE AS sy FROM cells),
g AS (SELECT cell_id, cell_type, CAST(floor((x - x0) / sx) AS INT) AS gi, CAST(floor((y - y0) / sy) AS INT) AS gj FROM cells, e)"""


@query("grid_with_empty_bins", "A10", GRID_SQL.format(a=19, b=59) + """, t AS (SELECT gi, gj, sum(v) AS total, count(*) AS n FROM g LEFT JOIN
(SELECT cell_id, sum(value) AS v FROM expr GROUP BY 1) USING (cell_id) GROUP BY 1, 2)
SELECT 'pseudo_' || i || '_' || j AS spot, coalesce(total, 0) AS total, coalesce(n, 0) AS n_cells FROM range(20) a(i), range(60) b(j) LEFT JOIN t ON gi = i AND gj = j""", "cells expr")
def grid_with_empty_bins(spark, d):
    return X.grid_sums(D.expr(spark, d), D.cells(spark, d), 20, 60).select("spot", "total", "n_cells")


@query("grid_composition", "A11", GRID_SQL.format(a=9, b=9) + """, c AS (SELECT gi, gj, cell_type, count(*) AS n FROM g GROUP BY 1, 2, 3),
t AS (SELECT gi, gj, sum(n) AS m, arg_min(cell_type, (-n, cell_type)) AS dominant FROM c GROUP BY 1, 2)
SELECT gi, gj, cell_type, dominant, round(n / m, 6) AS proportion FROM c JOIN t USING (gi, gj)""", "cells")
def grid_composition(spark, d):
    return X.grid_composition(D.cells(spark, d), 10, 10).select("gi", "gj", "cell_type", "dominant", r("proportion").alias("proportion"))


@query("cell_qc", "A12", """SELECT cell_id, count(*) AS transcript_counts, CAST(sum(CASE WHEN f NOT LIKE '%NegControlProbe%' AND f NOT LIKE '%DeprecatedCodeword%' THEN 1 ELSE 0 END) AS BIGINT) AS total_counts,
count(DISTINCT CASE WHEN f NOT LIKE '%NegControlProbe%' AND f NOT LIKE '%DeprecatedCodeword%' THEN f END) AS n_genes_by_counts,
CAST(sum(CASE WHEN f LIKE '%NegControlProbe%' THEN 1 ELSE 0 END) AS BIGINT) AS neg_probe, CAST(sum(CASE WHEN f LIKE '%DeprecatedCodeword%' THEN 1 ELSE 0 END) AS BIGINT) AS deprecated
FROM (SELECT cell_id, CASE WHEN line_no = 6 THEN 'NegControlProbe_' WHEN line_no = 7 THEN 'DeprecatedCodeword_' ELSE '' END || feature_name AS f FROM transcripts) GROUP BY 1""", "transcripts")
def cell_qc(spark, d):
    t = D.transcripts(spark, d).withColumn("feature_name", F.concat(
        F.when(F.col("line_no") == 6, "NegControlProbe_").when(F.col("line_no") == 7, "DeprecatedCodeword_").otherwise(""), "feature_name"))
    q = X.cell_qc(t)
    return q.select("cell_id", "transcript_counts", "total_counts", "n_genes_by_counts",
                    F.col("n_NegControlProbe").alias("neg_probe"), F.col("n_DeprecatedCodeword").alias("deprecated"))


# ---------------------------------------------------------- normalisation

@query("normalize_log", "F20", """SELECT cell_id, gene, round(ln(1 + value * 10000 / sum(value) OVER (PARTITION BY cell_id)), 6) AS value FROM expr""", "expr")
def normalize_log(spark, d):
    return X.normalize_log(D.expr(spark, d)).select("cell_id", "gene", r("value").alias("value"))


@query("normalize_median_int", "F20 F22", """WITH t AS (SELECT cell_id, sum(value) AS t FROM expr GROUP BY 1), m AS (SELECT quantile_cont(t, 0.5) AS m FROM t)
SELECT v AS level, count(*) AS n FROM (SELECT CAST(trunc(ln(1 + value * m / t) + 1e-9) AS INT) AS v FROM expr JOIN t USING (cell_id), m) GROUP BY 1""", "expr")
def normalize_median_int(spark, d):
    e = X.normalize_log(D.expr(spark, d), target=None)
    return e.groupBy((F.col("value") + 1e-9).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n"))


MOMENTS_SQL = """WITH n AS (SELECT count(*) AS n FROM cells), m AS (SELECT gene, n, sum(value) / n AS mean,
(sum(value * value) - sum(value) * sum(value) / n) / (n - 1) AS var FROM {rel}, n GROUP BY gene, n)"""


@query("z_scale", "F21", MOMENTS_SQL.format(rel="expr") + """ SELECT cell_id, gene, round(least((value - mean) / sqrt(var), 10), 5) AS z,
round(-mean / sqrt(var), 5) AS z0 FROM expr JOIN m USING (gene)""", "cells expr")
def z_scale(spark, d):
    return X.z_scale(D.expr(spark, d), D.cells(spark, d)).select("cell_id", "gene", r("z", 5).alias("z"), r("z0", 5).alias("z0"))


@query("variable_genes", "M35", MOMENTS_SQL.format(rel="panel") + """, b AS (SELECT gene, mean, var / mean AS dispersion,
CAST(floor((row_number() OVER (ORDER BY mean, gene) - 1) * 20 / count(*) OVER ()) AS INT) AS bin FROM m WHERE mean > 0),
z AS (SELECT gene, bin, dispersion, coalesce((dispersion - avg(dispersion) OVER (PARTITION BY bin)) / nullif(stddev_samp(dispersion) OVER (PARTITION BY bin), 0), 0) AS score FROM b)
SELECT gene, bin, round(dispersion, 5) AS dispersion, round(score, 5) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, gene) AS rank FROM z""", "cells panel")
def variable_genes(spark, d):
    v = X.variable_genes(D.panel(spark, d), D.cells(spark, d))
    return v.select("gene", "bin", r("dispersion", 5).alias("dispersion"), r("score", 5).alias("score"), "rank")


@query("regress_out_total", "M25", """WITH t AS (SELECT cell_id, ln(sum(value)) AS lx FROM expr GROUP BY 1), g AS (SELECT DISTINCT gene FROM expr),
f AS (SELECT t.cell_id, g.gene, lx, coalesce(value, 0) AS y FROM t CROSS JOIN g LEFT JOIN expr e ON e.cell_id = t.cell_id AND e.gene = g.gene)
SELECT gene, round(regr_slope(y, lx), 5) AS slope, round(regr_intercept(y, lx), 5) AS intercept FROM f GROUP BY 1""", "expr")
def regress_out_total(spark, d):
    m = X.regress_out_log_total(D.expr(spark, d), D.cells(spark, d))
    return m.select("gene", r("slope", 5).alias("slope"), r("intercept", 5).alias("intercept"))


@query("group_correlation", "M38", """WITH s AS (SELECT cell_type, count(*) AS n FROM cells GROUP BY 1),
m AS (SELECT s.cell_type AS g, a.gene, coalesce(v, 0) / n AS mean FROM s CROSS JOIN (SELECT DISTINCT gene FROM expr) a LEFT JOIN
 (SELECT cell_type, gene, sum(value) AS v FROM expr JOIN cells USING (cell_id) GROUP BY 1, 2) e ON e.cell_type = s.cell_type AND e.gene = a.gene)
SELECT a.g AS group_a, b.g AS group_b, round(corr(a.mean, b.mean), 5) AS corr FROM m a JOIN m b USING (gene) GROUP BY 1, 2""", "cells expr")
def group_correlation(spark, d):
    return X.group_correlation(X.group_means(D.expr(spark, d), D.cells(spark, d))).withColumn("corr", r("corr", 5))


@query("percentile_clip", "W11 M3 W10", """WITH q AS (SELECT quantile_cont(value, 0.95) AS hi FROM events WHERE value > 0), e AS (SELECT min(value) AS a, max(value) AS b FROM events)
SELECT event_type, round(avg(least(value, hi)), 6) AS clipped, round(avg((value - a) / (b - a)), 6) AS scaled, round(hi, 6) AS hi FROM events, q, e GROUP BY event_type, hi""")
def percentile_clip(spark, d):
    e = D.table(spark, d, "events").select("event_type", "value")
    one = exact_quantiles(e.where(F.col("value") > 0), "value", {"hi": 0.95}).crossJoin(e.agg(F.min("value").alias("a"), F.max("value").alias("b")))
    return e.crossJoin(F.broadcast(one)).groupBy("event_type").agg(  # one row
        r(F.avg(F.least("value", "hi"))).alias("clipped"), r(F.avg((F.col("value") - F.col("a")) / (F.col("b") - F.col("a")))).alias("scaled"), r(F.max("hi")).alias("hi"))


@query("confidence_threshold", "M3", """SELECT round(quantile_cont(conf, 0.25), 6) AS p25, round(quantile_cont(conf, 0.5), 6) AS p50, round(quantile_cont(cell_area, 0.5), 6) AS area FROM cells""", "cells")
def confidence_threshold(spark, d):
    c = D.cells(spark, d)
    a = exact_quantiles(c, "conf", {"p25": 0.25, "p50": 0.5}).crossJoin(exact_quantiles(c, "cell_area", {"area": 0.5}))
    return a.select(*[r(x).alias(x) for x in a.columns])


# ------------------------------------------------------- markers and tests

def _markers(spark, d):
    """Each brand marks the type that its number falls to."""
    number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return D.table(spark, d, "part").select(F.element_at(F.array(*[F.lit(x) for x in SEGMENTS]), number % 5 + 1).alias("cell_type"), F.col("p_brand").alias("gene")).distinct()


# fixed values: the five customer segments
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
MARKERS_SQL = """markers AS (SELECT DISTINCT ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) % 5 + 1] AS cell_type, p_brand AS gene FROM part)"""
STATS_SQL = f"""WITH {MARKERS_SQL}, f AS (SELECT m.cell_type, m.gene, c.cell_type = m.cell_type AS inn, coalesce(value, 0) AS v
 FROM markers m CROSS JOIN cells c LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = m.gene),
s AS (SELECT cell_type, gene, avg(v) FILTER (inn) AS mean_in, avg(v) FILTER (NOT inn) AS mean_out, avg(v) FILTER (inn AND v > 0) AS pos_in, avg(v) FILTER (NOT inn AND v > 0) AS pos_out,
 100.0 * avg(CASE WHEN v > 0 THEN 1 ELSE 0 END) FILTER (inn) AS pct_in, 100.0 * avg(CASE WHEN v > 0 THEN 1 ELSE 0 END) FILTER (NOT inn) AS pct_out, count(*) FILTER (inn) AS n_cells FROM f GROUP BY 1, 2),
k AS (SELECT *, mean_in / (mean_out + 1e-10) AS fold, pct_in / (pct_out + 1e-10) AS spec, pos_in / (pos_out + 1e-10) AS pos_fold FROM s)"""


@query("marker_stats", "A16 D10", STATS_SQL + """ SELECT cell_type, gene, n_cells, round(mean_in, 6) AS mean_in, round(mean_out, 6) AS mean_out, round(pos_in, 6) AS pos_mean_in,
round(pos_out, 6) AS pos_mean_out, round(pct_in, 6) AS pct_in, round(pct_out, 6) AS pct_out, round(fold, 6) AS fold, round(spec, 6) AS specificity FROM k""", "cells expr")
def marker_stats(spark, d):
    m = X.marker_stats(D.expr(spark, d), D.cells(spark, d), _markers(spark, d))
    return m.select("cell_type", "gene", "n_cells", *[r(c).alias(c) for c in (
        "mean_in", "mean_out", "pos_mean_in", "pos_mean_out", "pct_in", "pct_out", "fold", "specificity")])


@query("marker_summary", "A17 F11", STATS_SQL + """ SELECT cell_type, count(*) AS n_markers, round(avg(pos_fold), 2) AS fold, round(avg(spec), 2) AS specificity, round(avg(pct_in), 2) AS pct,
CASE WHEN avg(pos_fold) >= 2 AND avg(pct_in) >= 30 THEN 'Excellent' WHEN avg(pos_fold) >= 1.5 OR avg(pct_in) >= 20 THEN 'Good' ELSE 'Poor' END AS quality FROM k GROUP BY 1""", "cells expr")
def marker_summary(spark, d):
    m = X.marker_stats(D.expr(spark, d), D.cells(spark, d), _markers(spark, d))
    g = m.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_markers"), F.avg("pos_fold").alias("f"), F.avg("specificity").alias("s"), F.avg("pct_in").alias("p"))
    return g.select("cell_type", "n_markers", r("f", 2).alias("fold"), r("s", 2).alias("specificity"), r("p", 2).alias("pct"), X.marker_quality(F.col("f"), F.col("p")).alias("quality"))


@query("marker_availability", "M4 U3", f"""WITH {MARKERS_SQL}, a AS (SELECT cell_type, gene FROM markers UNION ALL SELECT DISTINCT cell_type, 'Gone#1' FROM markers WHERE cell_type < 'F')
SELECT cell_type, count(*) AS n_markers, CAST(sum(CASE WHEN gene IN (SELECT gene FROM expr) THEN 1 ELSE 0 END) AS BIGINT) AS available,
CAST(sum(CASE WHEN gene IN (SELECT gene FROM expr) THEN 0 ELSE 1 END) AS BIGINT) AS missing, bool_and(gene IN (SELECT gene FROM expr)) AS complete FROM a GROUP BY 1""", "expr")
def marker_availability(spark, d):
    m = _markers(spark, d)
    extra = m.where(F.col("cell_type") < "F").select("cell_type").distinct().withColumn("gene", F.lit("Gone#1"))
    return X.marker_availability(m.unionByName(extra), D.expr(spark, d))


@query("markers_from_matrix", "M4 D10", """SELECT DISTINCT p_type AS cell_type, p_brand AS gene FROM part WHERE p_size > 40""")
def markers_from_matrix(spark, d):
    p = D.table(spark, d, "part").withColumn("w", (F.col("p_size") > 40).cast("int"))
    wide = p.groupBy(F.col("p_brand").alias("gene")).pivot("p_type").sum("w")
    return X.markers_from_matrix(wide, [c for c in wide.columns if c != "gene"])


@query("gene_set_score", "M5", f"""WITH {MARKERS_SQL}, n AS (SELECT count(*) AS n FROM cells), g AS (SELECT gene, sum(value) / n AS mean FROM expr, n GROUP BY gene, n),
b AS (SELECT gene, CAST(floor((row_number() OVER (ORDER BY mean, gene) - 1) * 5 / count(*) OVER ()) AS INT) AS bin FROM g),
s AS (SELECT cell_type AS set, gene, bin FROM markers JOIN b USING (gene)),
c AS (SELECT DISTINCT s.set, b.gene FROM s JOIN b USING (bin) WHERE (s.set, b.gene) NOT IN (SELECT (set, gene) FROM s)),
w AS (SELECT set, gene, 1.0 / count(*) OVER (PARTITION BY set) AS w FROM s UNION ALL SELECT set, gene, -1.0 / count(*) OVER (PARTITION BY set) FROM c),
x AS (SELECT cell_id, set, sum(value * w) AS score FROM expr JOIN w USING (gene) GROUP BY 1, 2)
SELECT c.cell_id, k.set, round(coalesce(x.score, 0), 5) + 0::DOUBLE AS score FROM cells c CROSS JOIN (SELECT DISTINCT set FROM s) k LEFT JOIN x ON x.cell_id = c.cell_id AND x.set = k.set""", "cells expr")
def gene_set_score(spark, d):
    s = X.gene_set_score(D.expr(spark, d), D.cells(spark, d), _markers(spark, d), n_bins=5)
    return s.select("cell_id", "set", r("score", 5).alias("score"))


@query("welch_t_test", "M8", """WITH f AS (SELECT g.gene, c.cell_type = 'BUILDING' AS inn, coalesce(value, 0) AS v FROM cells c CROSS JOIN (SELECT DISTINCT gene FROM expr) g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene),
s AS (SELECT gene, avg(v) FILTER (inn) AS m1, avg(v) FILTER (NOT inn) AS m0, var_samp(v) FILTER (inn) / count(*) FILTER (inn) AS v1, var_samp(v) FILTER (NOT inn) / count(*) FILTER (NOT inn) AS v0,
 count(*) FILTER (inn) AS n1, count(*) FILTER (NOT inn) AS n0, avg(CASE WHEN v > 0 THEN 1 ELSE 0 END) FILTER (inn) AS f1, avg(CASE WHEN v > 0 THEN 1 ELSE 0 END) FILTER (NOT inn) AS f0 FROM f GROUP BY 1)
SELECT gene, round(m1, 6) AS mean_in, round(m0, 6) AS mean_out, round(f1, 6) AS frac_in, round(f0, 6) AS frac_out, round(m1 / (m0 + 1e-9), 6) AS fold, round((m1 - m0) / sqrt(v1 + v0), 5) AS t,
round((v1 + v0) * (v1 + v0) / (v1 * v1 / (n1 - 1) + v0 * v0 / (n0 - 1)), 3) AS dof FROM s""", "cells expr")
def welch_t_test(spark, d):
    w = X.welch_t(D.expr(spark, d), D.cells(spark, d), F.col("cell_type") == "BUILDING")
    return w.select("gene", *[r(c).alias(c) for c in ("mean_in", "mean_out", "frac_in", "frac_out", "fold")], r("t", 5).alias("t"), r("dof", 3).alias("dof"))


@query("rank_sum_test", "M8 M29", """WITH f AS (SELECT g.gene, c.cell_type = 'BUILDING' AS inn, coalesce(value, 0) AS v FROM cells c CROSS JOIN (SELECT DISTINCT gene FROM panel) g LEFT JOIN panel e ON e.cell_id = c.cell_id AND e.gene = g.gene),
q AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY gene, v) AS t FROM f),
s AS (SELECT gene, sum(rk) FILTER (inn) AS w, sum(CAST(t AS DOUBLE) * t - 1) AS ties, count(*) FILTER (inn)::DOUBLE AS n1, count(*) FILTER (NOT inn)::DOUBLE AS n2 FROM q GROUP BY 1)
SELECT gene, round(w::DOUBLE, 1) AS rank_sum, round((w - n1 * (n1 + n2 + 1) / 2) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 5) AS z FROM s""", "cells panel")
def rank_sum_test(spark, d):
    flag = D.cells(spark, d).select("cell_id", (F.col("cell_type") == "BUILDING").alias("inn"))
    e = D.panel(spark, d).join(flag, "cell_id")
    sizes = e.select("gene").distinct().crossJoin(F.broadcast(X.group_sizes(flag, F.col("inn"))))  # one row
    return MT.rank_sum(e, "value", "inn", sizes).select("gene", r("rank_sum", 1).alias("rank_sum"), r("z", 5).alias("z"))


@query("top_markers_per_group", "T8 T4", """WITH m AS (SELECT cell_type, gene, avg(value) AS pos_mean FROM expr JOIN cells USING (cell_id) WHERE value > 0 GROUP BY 1, 2)
SELECT cell_type, gene, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cell_type ORDER BY round(pos_mean, 9) DESC, gene) AS rank FROM m) WHERE rank <= 5""", "cells expr")
def top_markers_per_group(spark, d):
    m = (D.expr(spark, d).where(F.col("value") > 0).join(D.cells(spark, d).select("cell_id", "cell_type"), "cell_id")
         .groupBy("cell_type", "gene").agg(F.round(F.avg("value"), 9).alias("m")))
    return top_per_group(m, ["cell_type"], [F.desc("m"), F.asc("gene")], 5, rank="rank").select("cell_type", "gene", "rank")


@query("de_all_groups", "M8 A15", """WITH f AS (SELECT t.cell_type AS grp, g.gene, c.cell_type = t.cell_type AS inn, coalesce(value, 0) AS v
 FROM cells c CROSS JOIN (SELECT DISTINCT gene FROM expr) g CROSS JOIN (SELECT DISTINCT cell_type FROM cells) t LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene),
s AS (SELECT grp, gene, avg(v) FILTER (inn) AS m1, avg(v) FILTER (NOT inn) AS m0, var_samp(v) FILTER (inn) / count(*) FILTER (inn) AS v1, var_samp(v) FILTER (NOT inn) / count(*) FILTER (NOT inn) AS v0,
 count(*) FILTER (inn) AS n1, count(*) FILTER (NOT inn) AS n0, avg(CASE WHEN v > 0 THEN 1 ELSE 0 END) FILTER (inn) AS f1, avg(CASE WHEN v > 0 THEN 1 ELSE 0 END) FILTER (NOT inn) AS f0 FROM f GROUP BY 1, 2),
w AS (SELECT *, (m1 - m0) / sqrt(v1 + v0) AS t, (v1 + v0) * (v1 + v0) / (v1 * v1 / (n1 - 1) + v0 * v0 / (n0 - 1)) AS dof FROM s),
a AS (SELECT *, atan(abs(t) / sqrt(dof)) / 2000 AS h, exp(lgamma((dof + 1) / 2) - lgamma(dof / 2)) / sqrt(pi()) AS c FROM w),
p AS (SELECT grp, gene, greatest(0, 1 - 2 * any_value(c * h) / 3 * sum((CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(cos(i * h), dof - 1))) AS p FROM a CROSS JOIN range(0, 2001) r(i) GROUP BY 1, 2),
q AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, gene) AS k, count(*) OVER (PARTITION BY grp) AS n FROM p),
b AS (SELECT grp, gene, p, least(1, min(n * p / k) OVER (PARTITION BY grp ORDER BY p DESC, gene DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM q)
SELECT grp AS "group", gene, round(m1, 6) AS mean_in, round(m0, 6) AS mean_out, round(f1, 6) AS frac_in, round(f0, 6) AS frac_out, round(m1 / (m0 + 1e-9), 6) AS fold, round(t, 5) AS t, round(dof, 3) AS dof,
 round(p, 6) AS p, round(p_adj, 5) AS p_adj FROM w JOIN b USING (grp, gene)""", "cells expr")
def de_all_groups(spark, d):
    w = X.de_all_groups(D.expr(spark, d), D.cells(spark, d))
    return w.select("group", "gene", *[r(c).alias(c) for c in ("mean_in", "mean_out", "frac_in", "frac_out", "fold")], r("t", 5).alias("t"), r("dof", 3).alias("dof"), r("p").alias("p"), r("p_adj", 5).alias("p_adj"))


ALL_MARKERS = """markers AS (SELECT ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][p_partkey % 5 + 1] AS cell_type, p_brand AS gene, min(p_partkey) AS place FROM part GROUP BY 1, 2)"""


def _all_markers(spark, d):
    types = F.array(*[F.lit(t) for t in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    return (D.table(spark, d, "part").select(F.element_at(types, (F.col("p_partkey") % 5 + 1).cast("int")).alias("cell_type"), F.col("p_brand").alias("gene"), "p_partkey")
            .groupBy("cell_type", "gene").agg(F.min("p_partkey").alias("place")))


@query("marker_validation_by_type", "A15", f"""WITH {ALL_MARKERS}, f AS (SELECT m.cell_type, m.gene, c.cell_id, c.cell_type = m.cell_type AS inn, coalesce(value, 0) AS v
 FROM markers m CROSS JOIN cells c LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = m.gene WHERE m.gene IN (SELECT gene FROM expr)),
s AS (SELECT cell_type, count(DISTINCT cell_id) FILTER (inn) AS n_cells, count(DISTINCT gene) AS n_markers, avg(v) FILTER (inn) AS m1, avg(v) FILTER (NOT inn) AS m0 FROM f GROUP BY 1)
SELECT cell_type, n_cells, n_markers, round(m1, 6) AS mean_in, round(m0, 6) AS mean_out, round(m1 / (m0 + 1e-10), 6) AS fold FROM s""", "cells expr")
def marker_validation_by_type(spark, d):
    m = X.marker_validation(D.expr(spark, d), D.cells(spark, d), _all_markers(spark, d).select("cell_type", "gene"))
    return m.select("cell_type", "n_cells", "n_markers", *[r(c).alias(c) for c in ("mean_in", "mean_out", "fold")])


@query("top_listed_markers", "T4", f"""WITH {ALL_MARKERS}, l AS (SELECT cell_type, gene FROM markers QUALIFY row_number() OVER (PARTITION BY cell_type ORDER BY place, gene) <= 10),
m AS (SELECT cell_type, gene, round(avg(value), 9) AS pos_mean FROM expr JOIN cells USING (cell_id) JOIN l USING (cell_type, gene) WHERE value > 0 GROUP BY 1, 2)
SELECT cell_type, gene, CAST(row_number() OVER (PARTITION BY cell_type ORDER BY pos_mean DESC, gene) AS INT) AS rank FROM m QUALIFY rank <= 5""", "cells expr")
def top_listed_markers(spark, d):
    return X.top_listed_markers(D.expr(spark, d), D.cells(spark, d), _all_markers(spark, d), 5).select("cell_type", "gene", "rank")
