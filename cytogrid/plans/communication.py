"""Ligand-receptor communication over neighbour graphs."""
from __future__ import annotations

from pyspark.sql import functions as F

from cytogrid.operators import communication as C, summaries as U
from cytogrid.operators.ordering import top_per_group
from cytogrid.plans.registry import query, r
from cytogrid.plans.statistics import EDGE15
from cytogrid.session import cut
from cytogrid.sources import driver_tables as D
from cytogrid.operators.spatial import radius_pairs

EDGES = f"WITH {EDGE15}, w AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"
FLOW = EDGES + """, s AS (SELECT src, dst, ligand, receptor, l.value * q.value AS v FROM w JOIN expr l ON l.cell_id = src JOIN lr ON ligand = l.gene JOIN expr q ON q.cell_id = dst AND q.gene = receptor)"""


def _x(spark, d):
    """The count table, materialised: it is derived from three tables and read several times."""
    return cut(D.expr(spark, d))


def _w(spark, d):
    return cut(C.directed(radius_pairs(D.cells(spark, d), 1.5).withColumn("weight", F.lit(1.0))))


def _sig(spark, d):
    return C.signals(_x(spark, d), D.lr(spark, d), _w(spark, d))


@query("lr_pair_totals", "A18 C1 T1", FLOW + " SELECT ligand || '-' || receptor AS pair, sum(v) AS total FROM s GROUP BY 1 ORDER BY total DESC, pair LIMIT 10", "cells expr lr")
def lr_pair_totals(spark, d):
    return U.top_k(C.pair_totals(_x(spark, d), D.lr(spark, d), _w(spark, d)).select("pair", "total"), [F.desc("total"), F.asc("pair")], 10)


@query("lr_pathway_totals", "A19 J16", FLOW + " SELECT pathway_name, sum(v) AS total FROM s JOIN lr USING (ligand, receptor) GROUP BY 1", "cells expr lr")
def lr_pathway_totals(spark, d):
    return C.pathway_totals(C.pair_totals(_x(spark, d), D.lr(spark, d), _w(spark, d)), D.lr(spark, d))


@query("lr_cell_totals", "A20 C1", FLOW + """ SELECT c.cell_id, cell_type, coalesce(a.t, 0) AS sent, coalesce(b.t, 0) AS received FROM cells c LEFT JOIN (SELECT src, sum(v) AS t FROM s GROUP BY 1) a ON a.src = c.cell_id
LEFT JOIN (SELECT dst, sum(v) AS t FROM s GROUP BY 1) b ON b.dst = c.cell_id""", "cells expr lr")
def lr_cell_totals(spark, d):
    return C.cell_totals(_sig(spark, d), D.cells(spark, d))


@query("cci_by_pair", "C5 A22", FLOW + """ SELECT ligand, receptor, a.cell_type AS src_type, b.cell_type AS dst_type, sum(v) AS value FROM s JOIN cells a ON a.cell_id = src JOIN cells b ON b.cell_id = dst GROUP BY 1, 2, 3, 4 HAVING sum(v) >= 40""", "cells expr lr")
def cci_by_pair(spark, d):
    return C.radius_type_flow(_x(spark, d), D.lr(spark, d), D.cells(spark, d), 1.5, min_ints=40)


@query("cci_matrix", "A21", FLOW + """, f AS (SELECT ligand, receptor, a.cell_type AS src_type, b.cell_type AS dst_type, sum(v) AS value FROM s JOIN cells a ON a.cell_id = src JOIN cells b ON b.cell_id = dst GROUP BY 1, 2, 3, 4 HAVING sum(v) >= 40)
SELECT src_type, dst_type, sum(value) AS value, count(*) AS n_pairs FROM f GROUP BY 1, 2""", "cells expr lr")
def cci_matrix(spark, d):
    return C.type_matrix(C.radius_type_flow(_x(spark, d), D.lr(spark, d), D.cells(spark, d), 1.5, min_ints=40))


@query("cci_abundance_normalised", "A37 C10", FLOW + """, k AS (SELECT cell_type, count(*) AS k FROM cells GROUP BY 1)
SELECT k.cell_type, round(coalesce((SELECT sum(v) FROM s JOIN cells a ON a.cell_id = src WHERE a.cell_type = k.cell_type), 0) / k, 6) AS sent,
round(coalesce((SELECT sum(v) FROM s JOIN cells a ON a.cell_id = dst WHERE a.cell_type = k.cell_type), 0) / k, 6) AS received FROM k""", "cells expr lr")
def cci_abundance_normalised(spark, d):
    m = C.type_matrix(C.radius_type_flow(_x(spark, d), D.lr(spark, d), D.cells(spark, d), 1.5, min_ints=0))
    return C.abundance_normalised(m, D.cells(spark, d)).select("cell_type", r("sent").alias("sent"), r("received").alias("received"))


KERNEL = """WITH k AS (SELECT a.cell_id AS src, b.cell_id AS dst, exp(-((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) / 2) AS w FROM cells a JOIN cells b ON a.cell_id <> b.cell_id AND abs(a.y - b.y) < 2
 WHERE exp(-((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) / 2) >= 0.2), genes AS (SELECT DISTINCT gene FROM expr),
dense AS (SELECT c.cell_id, g.gene, coalesce(value, 0) AS v FROM cells c CROSS JOIN genes g LEFT JOIN expr e ON e.cell_id = c.cell_id AND e.gene = g.gene),
z AS (SELECT cell_id, gene, v - avg(v) OVER (PARTITION BY gene) AS z, stddev_pop(v) OVER (PARTITION BY gene) AS sd FROM dense)"""


@query("bivariate_moran", "C2 C3", KERNEL + """, n AS (SELECT ligand, receptor, sum(w * a.z * b.z) AS s FROM lr JOIN z a ON a.gene = ligand JOIN k ON src = a.cell_id JOIN z b ON b.cell_id = dst AND b.gene = receptor GROUP BY 1, 2),
ss AS (SELECT gene, sum(z * z) AS ss FROM z GROUP BY 1), o AS (SELECT sum(w) AS w, sum(w * w) AS w2, (SELECT count(*)::DOUBLE FROM cells) AS m FROM k)
SELECT ligand, receptor, round(s / sqrt(p.ss * q.ss), 5) AS r, round(s / sqrt(p.ss * q.ss) / sqrt((w2 - w * w / (m * m)) / (m * m)), 3) AS z FROM n JOIN ss p ON p.gene = ligand JOIN ss q ON q.gene = receptor, o""", "cells expr lr")
def bivariate_moran(spark, d):
    c = D.cells(spark, d)
    b = C.bivariate_moran(_x(spark, d), D.lr(spark, d), cut(C.kernel_weights(c, 1.0)), c)
    return b.select("ligand", "receptor", r("r", 5).alias("r"), r("z", 3).alias("z"))


@query("bivariate_moran_local", "C2 C3", KERNEL + """, lz AS (SELECT src, gene, sum(w * z) / any_value(sd) AS lz FROM k JOIN z ON z.cell_id = dst GROUP BY 1, 2)
SELECT cell_id, ligand, receptor, round(z / sd * coalesce(lz, 0), 4) + 0::DOUBLE AS local_r FROM lr JOIN z ON z.gene = ligand LEFT JOIN lz ON lz.src = cell_id AND lz.gene = receptor""", "cells expr lr")
def bivariate_moran_local(spark, d):
    c = D.cells(spark, d)
    b = C.local_bivariate(_x(spark, d), D.lr(spark, d), cut(C.kernel_weights(c, 1.0)), c)
    return b.select("cell_id", "ligand", "receptor", r("local_r", 4).alias("local_r"))


@query("selected_spots", "C3 P15", KERNEL + """, lz AS (SELECT src, gene, sum(w * z) / any_value(sd) AS lz FROM k JOIN z ON z.cell_id = dst GROUP BY 1, 2)
SELECT ligand, receptor, count(*) AS n_spots FROM lr JOIN z ON z.gene = ligand JOIN lz ON lz.src = cell_id AND lz.gene = receptor WHERE round(z / sd * lz, 6) > 5 GROUP BY 1, 2 HAVING count(*) > 2""", "cells expr lr")
def selected_spots(spark, d):
    c = D.cells(spark, d)
    b = C.local_bivariate(_x(spark, d), D.lr(spark, d), cut(C.kernel_weights(c, 1.0)), c)
    return b.where(F.round("local_r", 6) > 5).groupBy("ligand", "receptor").agg(F.count(F.lit(1)).alias("n_spots")).where("n_spots > 2")


@query("best_pair_per_ligand", "T3", KERNEL + """, n AS (SELECT ligand, receptor, round(sum(w * a.z * b.z), 4) AS s FROM lr JOIN z a ON a.gene = ligand JOIN k ON src = a.cell_id JOIN z b ON b.cell_id = dst AND b.gene = receptor GROUP BY 1, 2)
SELECT ligand, receptor FROM n QUALIFY row_number() OVER (PARTITION BY ligand ORDER BY s DESC, receptor) = 1 ORDER BY s DESC, ligand LIMIT 6""", "cells expr lr")
def best_pair_per_ligand(spark, d):
    c = D.cells(spark, d)
    x = _x(spark, d)
    b = C.bivariate_moran(x, D.lr(spark, d), cut(C.kernel_weights(c, 1.0)), c)
    from cytogrid.operators.expression import gene_moments
    ss = gene_moments(x, c.agg(F.count(F.lit(1)).alias("n"))).select("gene", (F.col("var_pop") * F.col("n")).alias("ss"))
    s = (b.join(ss.select(F.col("gene").alias("ligand"), F.col("ss").alias("a")), "ligand").join(ss.select(F.col("gene").alias("receptor"), F.col("ss").alias("b")), "receptor")
         .withColumn("s", F.round(F.col("r") * F.sqrt(F.col("a") * F.col("b")), 4)))
    best = U.first_per_key(s.select("ligand", "receptor", "s"), "ligand", F.struct("s", "receptor"))
    return U.top_k(best, [F.desc("s"), F.asc("ligand")], 6).select("ligand", "receptor")


@query("spot_lr_scores", "C4", EDGES + """, deg AS (SELECT src, count(*) AS k FROM w GROUP BY 1), lag AS (SELECT src, gene, sum(value) AS v FROM w JOIN expr ON cell_id = dst GROUP BY 1, 2),
s AS (SELECT d.src AS cell_id, ligand, receptor, (coalesce(l.value, 0) * coalesce(rl.v, 0) + coalesce(q.value, 0) * coalesce(ll.v, 0)) / (2 * k) AS score FROM deg d CROSS JOIN lr
 LEFT JOIN expr l ON l.cell_id = d.src AND l.gene = ligand LEFT JOIN expr q ON q.cell_id = d.src AND q.gene = receptor
 LEFT JOIN lag ll ON ll.src = d.src AND ll.gene = ligand LEFT JOIN lag rl ON rl.src = d.src AND rl.gene = receptor)
SELECT ligand, receptor, count(*) AS n_spots, round(sum(score), 4) AS total FROM s WHERE score > 0 GROUP BY 1, 2 HAVING count(*) >= 5""", "cells expr lr")
def spot_lr_scores(spark, d):
    s = C.spot_scores(_x(spark, d), D.lr(spark, d), _w(spark, d))
    return s.groupBy("ligand", "receptor").agg(F.count(F.lit(1)).alias("n_spots"), r(F.sum("score"), 4).alias("total"))


TYPE_PAIRS = """WITH n AS (SELECT count(*)::DOUBLE AS n FROM cells), k AS (SELECT cell_type, count(*)::DOUBLE AS k FROM cells GROUP BY 1), genes AS (SELECT DISTINCT gene FROM expr),
dense AS (SELECT cell_id, cell_type, g.gene, coalesce(value, 0) AS v FROM cells CROSS JOIN genes g LEFT JOIN expr e USING (cell_id, gene)),
mu AS (SELECT gene, avg(v) AS mu, var_pop(v) AS vr FROM dense GROUP BY 1),
m AS (SELECT cell_type, gene, avg(v) AS mean, avg(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS prop, count(*)::DOUBLE AS k FROM dense GROUP BY 1, 2),
cv AS (SELECT ligand, receptor, avg(a.v * b.v) - avg(a.v) * avg(b.v) AS c FROM lr JOIN dense a ON a.gene = ligand JOIN dense b ON b.cell_id = a.cell_id AND b.gene = receptor GROUP BY 1, 2),
j AS (SELECT ligand, receptor, a.cell_type AS src_type, b.cell_type AS dst_type, (a.mean + b.mean) / 2 AS score, (p.mu + q.mu) / 2 AS e,
 (p.vr * (n - a.k) / (a.k * (n - 1)) + q.vr * (n - b.k) / (b.k * (n - 1)) + 2 * CASE WHEN a.cell_type = b.cell_type THEN c * (n - a.k) / (a.k * (n - 1)) ELSE -c / (n - 1) END) / 4 AS var
 FROM lr JOIN cv USING (ligand, receptor) JOIN m a ON a.gene = ligand AND a.prop >= 0.1 JOIN m b ON b.gene = receptor AND b.prop >= 0.1 JOIN mu p ON p.gene = ligand JOIN mu q ON q.gene = receptor, n)
"""


@query("type_pair_means", "C7 C8 C9", TYPE_PAIRS + """SELECT ligand, receptor, src_type, dst_type, round(score, 6) AS score, round((score - e) / sqrt(var), 4) AS z FROM j""", "cells expr lr")
def type_pair_means(spark, d):
    t = C.type_pair_means(_x(spark, d), D.lr(spark, d), D.cells(spark, d))
    return t.select("ligand", "receptor", "src_type", "dst_type", r("score").alias("score"), r("z", 4).alias("z"))


LT = EDGES + """, pr AS (SELECT ligand, receptor AS target FROM lr), near AS (SELECT cell_id, gene, sum(v) AS v FROM (SELECT src AS cell_id, gene, value AS v FROM w JOIN expr ON cell_id = dst UNION ALL SELECT cell_id, gene, value FROM expr) GROUP BY 1, 2),
s AS (SELECT t.cell_id, ligand, target, t.value * n.v AS score FROM expr t JOIN pr ON target = t.gene JOIN near n ON n.cell_id = t.cell_id AND n.gene = ligand)"""


def _lt(spark, d):
    pairs = D.lr(spark, d).select("ligand", F.col("receptor").alias("target"))
    return C.ligand_target_scores(_x(spark, d), pairs, _w(spark, d))


@query("ligand_target_scores", "C6 A36", LT + """ SELECT ligand, target, count(*) AS n, round(sum(score) / (SELECT count(*) FROM cells), 6) AS mean_score FROM s GROUP BY 1, 2""", "cells expr lr")
def ligand_target_scores(spark, d):
    n = D.cells(spark, d).agg(F.count(F.lit(1)).alias("m"))
    s = _lt(spark, d).groupBy("ligand", "target").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    return s.crossJoin(F.broadcast(n)).select("ligand", "target", "n", r(F.col("s") / F.col("m")).alias("mean_score"))


@query("ligand_target_by_niche", "C6 T8", LT + """, g AS (SELECT niche, cell_type, ligand, target, sum(score) AS total FROM s JOIN cells USING (cell_id) GROUP BY 1, 2, 3, 4)
SELECT niche, cell_type, ligand, target, total FROM g QUALIFY row_number() OVER (PARTITION BY niche ORDER BY total DESC, cell_type, ligand, target) <= 5""", "cells expr lr")
def ligand_target_by_niche(spark, d):
    c = D.cells(spark, d).select("cell_id", "niche", "cell_type")
    g = _lt(spark, d).join(c, "cell_id").groupBy("niche", "cell_type", "ligand", "target").agg(F.sum("score").alias("total"))
    return top_per_group(g, ["niche"], [F.desc("total"), F.asc("cell_type"), F.asc("ligand"), F.asc("target")], 5)


@query("ligand_target_candidates", "J17", """WITH lt AS (SELECT p_brand AS ligand, p_name AS target, round(avg(p_retailprice) - 950, 6) AS score FROM part GROUP BY 1, 2)
SELECT DISTINCT ligand, target FROM (SELECT *, row_number() OVER (PARTITION BY ligand ORDER BY score DESC, target) AS k FROM lt WHERE score > 0 AND ligand IN (SELECT ligand FROM lr) AND target NOT LIKE 'red%') WHERE k <= 25""", "lr")
def ligand_target_candidates(spark, d):
    lt = D.table(spark, d, "part").groupBy(F.col("p_brand").alias("ligand"), F.col("p_name").alias("target")).agg(F.round(F.avg("p_retailprice") - 950, 6).alias("score"))
    lt = lt.where((F.col("score") > 0) & ~F.col("target").startswith("red")).join(D.lr(spark, d).select("ligand").distinct(), "ligand", "left_semi")
    return top_per_group(lt, ["ligand"], [F.desc("score"), F.asc("target")], 25).select("ligand", "target").distinct()


@query("neighbourhood_frequency", "A35 C10", EDGES + """, a AS (SELECT src, dst FROM w UNION ALL SELECT cell_id, cell_id FROM cells)
SELECT cell_type, round(count(*)::DOUBLE / (SELECT count(*) FROM cells), 6) AS mean FROM a JOIN cells ON cell_id = dst GROUP BY 1""", "cells")
def neighbourhood_frequency(spark, d):
    e = radius_pairs(D.cells(spark, d), 1.5)
    return C.neighbourhood_frequency(e, D.cells(spark, d)).withColumn("mean", r("mean"))


@query("expression_by_type", "F10 F9", """WITH k AS (SELECT niche, cell_type, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY niche) AS p FROM cells GROUP BY 1, 2)
SELECT gene, k.cell_type, round(sum(value * p), 4) AS value FROM expr JOIN cells USING (cell_id) JOIN k USING (niche) GROUP BY 1, 2""", "cells expr")
def expression_by_type(spark, d):
    c = D.cells(spark, d)
    k = U.crosstab(c, "niche", "cell_type").where("n > 0").select("niche", "cell_type", F.col("share").alias("proportion"))
    comp = c.select("cell_id", "niche").join(k, "niche").drop("niche")
    return C.expression_by_type(_x(spark, d), comp).groupBy("gene", "cell_type").agg(r(F.sum("value"), 4).alias("value"))


@query("composition_entropy", "A34", """WITH k AS (SELECT niche, cell_type, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY niche) AS p FROM cells GROUP BY 1, 2) SELECT niche, round(-sum(p * ln(p + 1e-10)), 6) AS entropy FROM k GROUP BY 1""", "cells")
def composition_entropy(spark, d):
    return U.crosstab(D.cells(spark, d), "niche", "cell_type").where("n > 0").groupBy("niche").agg(r(C.entropy(F.col("share"))).alias("entropy"))


@query("significant_pairs", "C3", KERNEL + """, n AS (SELECT ligand, receptor, sum(w * a.z * b.z) AS s FROM (SELECT DISTINCT ligand, receptor FROM lr) JOIN z a ON a.gene = ligand JOIN k ON src = a.cell_id JOIN z b ON b.cell_id = dst AND b.gene = receptor GROUP BY 1, 2),
ss AS (SELECT gene, sum(z * z) AS ss FROM z GROUP BY 1), o AS (SELECT sum(w) AS w, sum(w * w) AS w2, (SELECT count(*)::DOUBLE FROM cells) AS m FROM k),
t AS (SELECT ligand, receptor, s / sqrt(p.ss * q.ss) / sqrt((w2 - w * w / (m * m)) / (m * m)) AS z FROM n JOIN ss p ON p.gene = ligand JOIN ss q ON q.gene = receptor, o),
e AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(z) / sqrt(2)) AS t FROM t),
f AS (SELECT *, t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-z * z / 2) AS tail FROM e),
p AS (SELECT ligand, receptor, z, 0.5 * CASE WHEN z >= 0 THEN tail ELSE 2 - tail END AS p FROM f),
q AS (SELECT *, row_number() OVER (ORDER BY p, ligand || '~' || receptor) AS i, count(*) OVER () AS n FROM p)
SELECT ligand, receptor, round(z, 3) AS z, round(p, 5) AS p, round(least(1, min(n * p / i) OVER (ORDER BY p DESC, ligand || '~' || receptor DESC ROWS UNBOUNDED PRECEDING)), 5) AS p_adj FROM q""", "cells expr lr")
def significant_pairs(spark, d):
    c = D.cells(spark, d)
    b = C.significant_pairs(_x(spark, d), D.lr(spark, d), cut(C.kernel_weights(c, 1.0)), c)
    return b.select("ligand", "receptor", r("z", 3).alias("z"), r("p", 5).alias("p"), r("p_adj", 5).alias("p_adj"))
