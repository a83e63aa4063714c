"""Rank tests, variable genes, residuals, knees and consensus ranks."""
from __future__ import annotations

from pyspark.sql import functions as F

from cytogrid.operators import communication as C, selection as S
from cytogrid.plans.communication import TYPE_PAIRS, _x
from cytogrid.plans.expression import MOMENTS_SQL
from cytogrid.plans.registry import query, r
from cytogrid.sources import driver_tables as D

# tail of the normal distribution beyond |z| by Simpson's rule
TAIL = "greatest(0, 1 - sqrt(2 / pi()) * any_value(h) / 3 * sum((CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-i * h * i * h / 2)))"


@query("rank_sum_all_groups", "M8", f"""WITH g AS (SELECT DISTINCT gene FROM panel),
f AS (SELECT c.cell_type AS grp, g.gene, coalesce(value, 0) AS v FROM cells c CROSS JOIN g LEFT JOIN panel e ON e.cell_id = c.cell_id AND e.gene = g.gene),
q AS (SELECT *, rank() OVER (PARTITION BY gene ORDER BY v) + (count(*) OVER (PARTITION BY gene, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY gene, v) AS t FROM f),
tie AS (SELECT gene, sum(CAST(t AS DOUBLE) * t - 1) AS ties, count(*)::DOUBLE AS n FROM q GROUP BY 1),
s AS (SELECT grp, gene, sum(rk)::DOUBLE AS w, count(*)::DOUBLE AS n1 FROM q GROUP BY 1, 2),
z AS (SELECT grp, gene, w, (w - n1 * (n + 1) / 2) / sqrt(n1 * (n - n1) / 12 * ((n + 1) - ties / (n * (n - 1)))) AS z FROM s JOIN tie USING (gene)),
a AS (SELECT *, abs(z) / 1000 AS h FROM z),
p AS (SELECT grp, gene, any_value(w) AS w, any_value(z) AS z, {TAIL} AS p FROM a CROSS JOIN range(0, 1001) r(i) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p, gene) AS k, count(*) OVER (PARTITION BY grp) AS n FROM p),
b AS (SELECT *, least(1, min(n * p / k) OVER (PARTITION BY grp ORDER BY p DESC, gene DESC ROWS UNBOUNDED PRECEDING)) AS p_adj FROM k)
SELECT grp AS "group", gene, round(w, 1) AS rank_sum, round(z, 5) AS z, round(p, 4) AS p, round(p_adj, 3) AS p_adj FROM b""", "cells panel")
def rank_sum_all_groups(spark, d):
    t = S.rank_sum_all_groups(D.panel(spark, d), D.cells(spark, d))
    return t.select("group", "gene", r("rank_sum", 1).alias("rank_sum"), r("z", 5).alias("z"), r("p", 4).alias("p"), r("p_adj", 3).alias("p_adj"))


@query("variable_genes_mean_sd", "M35", MOMENTS_SQL.format(rel="panel") + """, l AS (SELECT gene, ln(1 + mean) AS mean, ln(var / mean) AS dispersion FROM m WHERE mean > 0),
e AS (SELECT min(mean) AS lo, max(mean) AS hi FROM l), b AS (SELECT gene, dispersion, greatest(0, ceil(round((mean - lo) / (hi - lo) * 20, 9)) - 1)::INT AS bin FROM l, e),
z AS (SELECT gene, bin, dispersion, CASE WHEN count(*) OVER w = 1 THEN 1 ELSE (dispersion - avg(dispersion) OVER w) / nullif(stddev_samp(dispersion) OVER w, 0) END AS score FROM b WINDOW w AS (PARTITION BY bin))
SELECT gene, bin, round(dispersion, 5) AS dispersion, round(score, 5) AS score, row_number() OVER (ORDER BY round(score, 9) DESC NULLS LAST, gene) AS rank FROM z""", "cells panel")
def variable_genes_mean_sd(spark, d):
    logs = D.panel(spark, d).withColumn("value", F.log1p(F.col("value").cast("double")))
    v = S.variable_by_mean_sd(logs, D.cells(spark, d))
    return v.select("gene", "bin", r("dispersion", 5).alias("dispersion"), r("score", 5).alias("score"), "rank")


@query("variable_genes_median_mad", "M35", MOMENTS_SQL.format(rel="panel") + """, l AS (SELECT gene, mean, var / mean AS dispersion FROM m WHERE mean > 0),
cutlist AS (SELECT quantile_cont(mean, [0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]) AS q FROM l),
b AS (SELECT gene, dispersion, len(list_filter(q, lambda x: round(mean, 12) > round(x, 12)))::INT AS bin FROM l, cutlist),
d AS (SELECT *, median(dispersion) OVER (PARTITION BY bin) AS mid FROM b), s AS (SELECT *, median(abs(dispersion - mid)) OVER (PARTITION BY bin) AS spread FROM d),
z AS (SELECT gene, bin, dispersion, (dispersion - mid) * 0.6744897501960817 / nullif(spread, 0) AS score FROM s)
SELECT gene, bin, round(dispersion, 5) AS dispersion, round(score, 5) AS score, row_number() OVER (ORDER BY round(score, 9) DESC NULLS LAST, gene) AS rank FROM z""", "cells panel")
def variable_genes_median_mad(spark, d):
    v = S.variable_by_median_mad(D.panel(spark, d), D.cells(spark, d))
    return v.select("gene", "bin", r("dispersion", 5).alias("dispersion"), r("score", 5).alias("score"), "rank")


@query("stabilised_residuals", "M25", """WITH t AS (SELECT cell_id, ln(sum(value)) AS x FROM expr GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM t),
m AS (SELECT gene, sum(value) / n AS mu, (sum(value * value) - sum(value) * sum(value) / n) / (n - 1) AS v FROM expr, n GROUP BY gene, n),
phi AS (SELECT 1 / (2 * sum(mu * mu * (v - mu)) / sum(mu * mu * mu * mu)) AS extra FROM m),
f AS (SELECT t.cell_id, g.gene, x, value, ln(coalesce(value, 0) + extra) AS y FROM t CROSS JOIN m g CROSS JOIN phi LEFT JOIN expr e ON e.cell_id = t.cell_id AND e.gene = g.gene),
b AS (SELECT gene, regr_slope(y, x) AS slope FROM f GROUP BY 1)
SELECT cell_id, gene, round(y - slope * x, 5) AS residual FROM f JOIN b USING (gene) WHERE value <> 0""", "expr")
def stabilised_residuals(spark, d):
    rows, _ = S.stabilised_residuals(D.expr(spark, d))
    return rows.select("cell_id", "gene", r("residual", 5).alias("residual"))


@query("knee_location", "T9", """WITH c AS (SELECT p_brand AS grp, p_size AS x, sum(p_retailprice) * (51 - p_size) AS y FROM part GROUP BY 1, 2),
s AS (SELECT grp, x, (x - min(x) OVER w)::DOUBLE / (max(x) OVER w - min(x) OVER w) AS u, 1 - (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) AS w, count(*) OVER w AS n FROM c WINDOW w AS (PARTITION BY grp)),
d AS (SELECT grp, x, n, round(w - u, 12) AS d, row_number() OVER (PARTITION BY grp ORDER BY x) AS i FROM s),
e AS (SELECT *, d >= coalesce(lag(d) OVER w, d) AND d >= coalesce(lead(d) OVER w, d) AS hi, d <= coalesce(lag(d) OVER w, d) AND d <= coalesce(lead(d) OVER w, d) AS lo FROM d WINDOW w AS (PARTITION BY grp ORDER BY i)),
v AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY grp ORDER BY i), 1000000000) AS upto FROM e WHERE hi OR lo),
k AS (SELECT v.grp, v.x, v.i FROM v JOIN d ON d.grp = v.grp AND d.i > v.i AND d.i <= v.upto WHERE v.hi AND NOT v.lo AND d.d < v.d - 1.0 / (v.n - 1))
SELECT g.grp AS brand, (SELECT arg_min(x, i) FROM k WHERE k.grp = g.grp)::DOUBLE AS knee FROM (SELECT DISTINCT grp FROM c) g""")
def knee_location(spark, d):
    c = D.table(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), "p_size").agg((F.sum("p_retailprice") * (51 - F.col("p_size"))).alias("y"))
    return S.knee(c, "p_size", "y", "decreasing", "convex", 1.0, ["brand"])


@query("consensus_ranks", "C8", TYPE_PAIRS + f""", t AS (SELECT ligand, receptor, src_type, dst_type, score, coalesce((score - e) / nullif(sqrt(var), 0), 0) AS z, var FROM j),
mm AS (SELECT cell_type, gene, mean FROM m WHERE prop >= 0.1),
w AS (SELECT t.*, a.mean * b.mean AS product, a.mean * b.mean / (sl.s * sr.s) AS weight, abs(z) / 1000 AS h FROM t JOIN mm a ON a.gene = ligand AND a.cell_type = src_type JOIN mm b ON b.gene = receptor AND b.cell_type = dst_type
 JOIN (SELECT ligand, sum(mean) AS s FROM (SELECT DISTINCT ligand, src_type FROM t) JOIN mm ON gene = ligand AND cell_type = src_type GROUP BY 1) sl USING (ligand)
 JOIN (SELECT receptor, sum(mean) AS s FROM (SELECT DISTINCT receptor, dst_type FROM t) JOIN mm ON gene = receptor AND cell_type = dst_type GROUP BY 1) sr USING (receptor)),
p AS (SELECT ligand, receptor, src_type, dst_type, any_value(z) AS z, {TAIL} AS two FROM w CROSS JOIN range(0, 1001) r(i) GROUP BY 1, 2, 3, 4),
o AS (SELECT w.*, round(CASE WHEN p.z > 0 THEN two / 2 ELSE 1 - two / 2 END, 9) AS p, count(*) OVER () AS n FROM w JOIN p USING (ligand, receptor, src_type, dst_type)),
kk AS (SELECT *, (rank() OVER (ORDER BY round(score, 12) DESC) + (count(*) OVER (PARTITION BY round(score, 12)) - 1) / 2.0::DOUBLE) / n AS a1,
 (rank() OVER (ORDER BY round(product, 12) DESC) + (count(*) OVER (PARTITION BY round(product, 12)) - 1) / 2.0::DOUBLE) / n AS a2,
 (rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE) / n AS b1,
 (rank() OVER (ORDER BY round(weight, 12) DESC) + (count(*) OVER (PARTITION BY round(weight, 12)) - 1) / 2.0::DOUBLE) / n AS b2 FROM o)
SELECT ligand, receptor, src_type, dst_type, round(p, 4) AS p, round(least(1, 2 * least(1 - (1 - least(a1, a2)) ** 2, greatest(a1, a2) ** 2)), 5) AS magnitude_rank,
 round(least(1, 2 * least(1 - (1 - least(b1, b2)) ** 2, greatest(b1, b2) ** 2)), 5) AS specificity_rank FROM kk""", "cells expr lr")
def consensus_ranks(spark, d):
    t = C.consensus_ranks(_x(spark, d), D.lr(spark, d), D.cells(spark, d))
    return t.select("ligand", "receptor", "src_type", "dst_type", r("p", 4).alias("p"), r("magnitude_rank", 5).alias("magnitude_rank"), r("specificity_rank", 5).alias("specificity_rank"))
