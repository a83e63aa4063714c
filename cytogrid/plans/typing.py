"""Cell typing, niches, label validation and clustering."""
from __future__ import annotations

from pyspark.sql import functions as F

from cytogrid.operators import autocorrelation as A, enrichment as E, niches as N, summaries as U, validation as V
from cytogrid.operators.multitest import adjust
from cytogrid.plans.registry import query, r
from cytogrid.session import cut
from cytogrid.sources import driver_tables as D

VOTE = """near AS (SELECT * FROM (SELECT a.cell_id AS src, b.cell_id AS dst, row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.cell_id) AS rank
 FROM {rel} a JOIN {rel} b ON a.cell_id <> b.cell_id WHERE a.{conf} < {t}) WHERE rank <= 15),
votes AS (SELECT src, {label} AS vote, round(sum(greatest({conf}, 0.1)), 9) AS w, min(rank) AS f FROM near JOIN {rel} ON cell_id = dst GROUP BY 1, 2),
win AS (SELECT src, arg_max(vote, (w, -f)) AS vote, round(max(w) / sum(w), 9) AS share FROM votes GROUP BY 1)"""


@query("consensus_relabel", "M1", "WITH " + VOTE.format(rel="umap", conf="conf", label="cell_type", t=0.5) + """
SELECT cell_id, CASE WHEN share >= 0.4 AND vote <> cell_type THEN vote ELSE cell_type END AS refined, CASE WHEN share >= 0.4 AND vote <> cell_type THEN 'neighborhood' ELSE 'original' END AS method,
round(coalesce(share, 0), 6) AS consensus FROM umap LEFT JOIN win ON src = cell_id""", "umap")
def consensus_relabel(spark, d):
    c = N.consensus_relabel(D.umap(spark, d), 0.5, 15, 0.4)
    return c.select("cell_id", "refined", "method", r("consensus").alias("consensus"))


INTEGRATE = """m AS (SELECT *, CAST(cell_id * 53 % 100 AS DOUBLE) / 100::DOUBLE AS mconf FROM umap),
base AS (SELECT *, CASE WHEN mconf >= 0.5 AND conf < 0.5 THEN 'biomarker' ELSE 'celltypist' END AS source, greatest(conf, mconf) AS comb FROM m), """


@query("integrate_annotations", "M2 F12 F13 A32", "WITH " + INTEGRATE + VOTE.format(rel="base", conf="comb", label="cell_type", t=0.5) + """, f AS (SELECT CASE WHEN share >= 0.35 AND vote <> cell_type THEN vote ELSE cell_type END AS final, CASE WHEN share >= 0.35 AND vote <> cell_type THEN 'neighborhood' ELSE source END AS source, conf, mconf
 FROM base LEFT JOIN win ON src = cell_id) SELECT source AS annotation_source, final AS final_cell_type, count(*) AS n, round(avg(conf), 6) AS celltypist_confidence, round(avg(mconf), 6) AS biomarker_confidence FROM f GROUP BY 1, 2""", "umap")
def integrate_annotations(spark, d):
    c = D.umap(spark, d).withColumn("mconf", (F.col("cell_id") * 53 % 100) / F.lit(100.0))
    f = N.integrate_annotations(c, "cell_type", "conf", "cell_type", "mconf", 0.5, 0.5, 15, 0.35)
    return f.groupBy("annotation_source", "final_cell_type").agg(F.count(F.lit(1)).alias("n"), r(F.avg("conf")).alias("celltypist_confidence"), r(F.avg("mconf")).alias("biomarker_confidence"))


@query("refine_labels", "M12", """WITH n AS (SELECT src, dst FROM (SELECT a.cell_id AS src, b.cell_id AS dst, row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.cell_id) AS k
 FROM cells a JOIN cells b ON a.cell_id <> b.cell_id AND abs(a.y - b.y) < 7 AND abs(a.x - b.x) < 7) WHERE k <= 6 UNION ALL SELECT cell_id, cell_id FROM cells),
v AS (SELECT src, cell_type AS vote, count(*) AS c FROM n JOIN cells ON cell_id = dst GROUP BY 1, 2),
s AS (SELECT src, max(c) AS top, arg_min(vote, (-c, vote)) AS mode, max(CASE WHEN vote = cell_type THEN c END) AS self, any_value(cell_type) AS own FROM v JOIN cells ON cell_id = src GROUP BY 1)
SELECT src AS cell_id, CASE WHEN self < 3 AND top > 3 THEN mode ELSE own END AS refined FROM s""", "cells")
def refine_labels(spark, d):
    return N.refine_labels(D.cells(spark, d), "hexagon")


@query("label_agreement", "A31", """SELECT round(avg(CASE WHEN cell_type = other THEN 1 ELSE 0 END), 6) AS agreement FROM (SELECT *, CASE WHEN conf < 0.3 THEN 'BUILDING' ELSE cell_type END AS other FROM cells)""", "cells")
def label_agreement(spark, d):
    c = D.cells(spark, d).withColumn("other", F.when(F.col("conf") < 0.3, "BUILDING").otherwise(F.col("cell_type")))
    return V.agreement(c, "cell_type", "other").select(r("agreement").alias("agreement"))


@query("label_transitions", "A31 T2", """SELECT cell_type AS "from", niche AS "to", count(*) AS n FROM cells WHERE cell_type <> niche GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10""", "cells")
def label_transitions(spark, d):
    return V.transitions(D.cells(spark, d), "cell_type", "niche", 10)


@query("silhouette", "M7", """WITH d AS (SELECT a.cell_id, a.cell_type AS la, b.cell_type AS lb, avg((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS m, count(*) AS n FROM points a JOIN points b ON TRUE GROUP BY 1, 2, 3),
s AS (SELECT cell_id, max(CASE WHEN la = lb THEN m * n / (n - 1) END) AS a, min(CASE WHEN la <> lb THEN m END) AS b FROM d GROUP BY 1)
SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS n FROM s""", "points")
def silhouette(spark, d):
    return V.silhouette(D.points(spark, d)).agg(r(F.avg("s")).alias("silhouette"), F.count(F.lit(1)).alias("n"))


@query("majority_voting", "M6", """SELECT niche, arg_min(cell_type, (-n, cell_type)) AS majority FROM (SELECT niche, cell_type, count(*) AS n FROM cells GROUP BY 1, 2) GROUP BY 1""", "cells")
def majority_voting(spark, d):
    return V.majority_label(D.cells(spark, d), "niche", "cell_type")


@query("kmeans_clusters", "M20 M31")
def kmeans_clusters(spark, d):
    v, dims = D.vectors(spark, d)
    k = V.kmeans(v, 5, dims)
    return k.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), r(F.avg("d2"), 4).alias("mean_d2"))


@query("cluster_number_elbow", "M20 T9")
def cluster_number_elbow(spark, d):
    v, dims = D.vectors(spark, d)
    curve = cut(V.cluster_curve(v, range(2, 7), dims))
    return U.elbow(curve, "k", "score")


@query("expression_pca", "M31 M36")
def expression_pca(spark, d):
    genes = [g.gene for g in D.genes(spark, d).orderBy("gene").collect()]  # one dimension each
    read = D.expr(spark, d).groupBy("cell_id").pivot("gene", genes).sum("value")
    wide = D.cells(spark, d).select("cell_id").join(read, "cell_id", "left").fillna(0.0, genes)
    p = V.principal_components(wide, [f"`{g}`" if "." in g else g for g in genes], 3)
    return p.select("cell_id", *[r(F.abs(F.col("pc")[i]), 4).alias(f"pc{i + 1}") for i in range(3)])


# ------------------------------------------------------------- enrichment

SETS = """sets AS (SELECT DISTINCT p_type AS term, p_name AS gene FROM part), hits AS (SELECT DISTINCT p_name AS gene FROM part WHERE p_size >= 49)"""


def _sets(spark, d):
    p = D.table(spark, d, "part")
    return p.select(F.col("p_type").alias("term"), F.col("p_name").alias("gene")), p.where("p_size >= 49").select(F.col("p_name").alias("gene"))


@query("enrichment_counts", "M37", f"""WITH {SETS} SELECT term, CAST(count(h.gene) AS BIGINT) AS k, count(*) AS m, (SELECT count(*) FROM hits) AS hits, (SELECT count(DISTINCT gene) FROM sets) AS universe FROM sets LEFT JOIN hits h USING (gene) GROUP BY 1""")
def enrichment_counts(spark, d):
    s, h = _sets(spark, d)
    return E.overlap_counts(h, s, s.select("gene"))


@query("enrichment_test", "M37 C3", f"""WITH {SETS}, c AS (SELECT term, count(h.gene) AS k, count(*) AS m, (SELECT count(*) FROM hits) AS n, (SELECT count(DISTINCT gene) FROM sets) AS u FROM sets LEFT JOIN hits h USING (gene) GROUP BY 1),
t AS (SELECT term, k, m, n, u, unnest(range(greatest(k, m + n - u), least(m, n) + 1)) AS i FROM c),
p AS (SELECT term, k, m, least(sum(exp(lgamma(m+1) - lgamma(i+1) - lgamma(m-i+1) + lgamma(u-m+1) - lgamma(n-i+1) - lgamma(u-m-n+i+1) - lgamma(u+1) + lgamma(n+1) + lgamma(u-n+1))), 1) AS p FROM t GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (ORDER BY p, term) AS r, count(*) OVER () AS q FROM p)
SELECT term, CAST(k AS BIGINT) AS k, m, round(p, 6) AS p, round(least(min(q * p / r) OVER (ORDER BY p DESC, term DESC ROWS UNBOUNDED PRECEDING), 1), 6) AS p_adj FROM r""")
def enrichment_test(spark, d):
    s, h = _sets(spark, d)
    t = adjust(E.hypergeometric_tail(E.overlap_counts(h, s, s.select("gene"))), "bh", id_col="term")
    return t.select("term", "k", "m", r("p", 6).alias("p"), r("p_adj", 6).alias("p_adj"))


UNITS = "mem AS (SELECT DISTINCT l_orderkey AS cell_id, 'u' || (l_suppkey % 6) AS unit FROM lineitem)"


def _units(spark, d):
    return D.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell_id"), F.concat(F.lit("u"), (F.col("l_suppkey") % 6).cast("string")).alias("unit")).distinct()


@query("unit_overlap", "M28 M39", f"WITH {UNITS} SELECT a.unit AS unit_a, b.unit AS unit_b, count(*) AS shared FROM mem a JOIN mem b USING (cell_id) WHERE a.unit < b.unit GROUP BY 1, 2")
def unit_overlap(spark, d):
    return E.unit_overlap(_units(spark, d))


@query("unit_overlap_score", "M28", f"""WITH {UNITS}, p AS (SELECT count(*) AS s FROM mem a JOIN mem b USING (cell_id) WHERE a.unit < b.unit), k AS (SELECT count(DISTINCT unit) AS u FROM mem)
SELECT round(s / (u * (u - 1) / 2.0) / (SELECT count(*) FROM orders), 6) AS score FROM p, k""")
def unit_overlap_score(spark, d):
    n = D.table(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"))
    return E.overlap_score(_units(spark, d), n).select(r("score").alias("score"))


@query("overlap_partner", "M39", f"""WITH {UNITS}, c AS (SELECT unit, CAST(sum(CASE WHEN cell_id IN (SELECT cell_id FROM mem WHERE unit = 'u1') THEN 1 ELSE 0 END) AS BIGINT) AS n FROM mem WHERE unit <> 'u1' GROUP BY 1)
SELECT max(n) AS max_shared, min(n) AS min_shared, arg_min(unit, (-n, unit)) AS max_unit, arg_min(unit, (n, unit)) AS min_unit FROM c""")
def overlap_partner(spark, d):
    return E.overlap_partner(_units(spark, d), "u1")


@query("top_cell_types", "M40", """WITH k AS (SELECT niche, cell_type, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY niche) AS p FROM cells GROUP BY 1, 2)
SELECT cell_type, round(sum(p), 6) AS total FROM k GROUP BY 1 ORDER BY total DESC, cell_type LIMIT 10""", "cells")
def top_cell_types(spark, d):
    t = U.crosstab(D.cells(spark, d), "niche", "cell_type").groupBy("cell_type").agg(r(F.sum("share")).alias("total"))
    return U.top_k(t, [F.desc("total"), F.asc("cell_type")], 10)


@query("membership_class", "M41", """SELECT CASE WHEN a = 1 AND b = 1 THEN 'both' WHEN a = 1 THEN 'only_1' WHEN b = 1 THEN 'only_2' ELSE 'blank' END AS class, count(*) AS n
FROM (SELECT CASE WHEN conf > 0.5 THEN 1 ELSE 0 END AS a, CASE WHEN cell_area > 60 THEN 1 ELSE 0 END AS b FROM cells) GROUP BY 1""", "cells")
def membership_class(spark, d):
    c = D.cells(spark, d).select((F.col("conf") > 0.5).cast("int").alias("a"), (F.col("cell_area") > 60).cast("int").alias("b"))
    return E.membership_class(c, "a", "b")


@query("validated_gene_list", "M42", "SELECT DISTINCT ligand AS gene FROM lr", "lr")
def validated_gene_list(spark, d):
    return E.require_members(D.lr(spark, d).select(F.col("ligand").alias("gene")).distinct(), D.genes(spark, d))


@query("score_selection", "M30 A36", """WITH g AS (SELECT gene, var_pop(value) AS v, avg(value) AS m FROM panel GROUP BY 1), s AS (SELECT avg(v) AS mu, stddev_pop(v) AS sd FROM g)
SELECT gene, round(v, 6) AS score, CASE WHEN v > mu + sd THEN 1 ELSE 0 END AS spatially_variable FROM g, s""", "panel")
def score_selection(spark, d):
    g = D.panel(spark, d).groupBy("gene").agg(F.var_pop("value").alias("v"))
    s = g.agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))
    return g.crossJoin(F.broadcast(s)).select("gene", r("v").alias("score"), (F.col("v") > F.col("mu") + F.col("sd")).cast("int").alias("spatially_variable"))  # one row


# ----------------------------------------------------- cluster assignment

@query("soft_assignment", "M15", """WITH c AS (SELECT cell_type, avg(x) AS mx, avg(y) AS my FROM points GROUP BY 1),
u AS (SELECT cell_id, c.cell_type AS cluster, 1 / (1 + (x - mx) * (x - mx) + (y - my) * (y - my)) AS u FROM points, c), q AS (SELECT cell_id, cluster, u / sum(u) OVER (PARTITION BY cell_id) AS q FROM u),
f AS (SELECT cell_id, cluster, q, q * q / sum(q) OVER (PARTITION BY cluster) AS f FROM q)
SELECT cell_id, cluster, round(q, 6) AS q, round(f / sum(f) OVER (PARTITION BY cell_id), 6) AS p FROM f""", "points")
def soft_assignment(spark, d):
    p = D.points(spark, d)
    c = p.groupBy(F.col("cell_type").alias("cluster")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return V.soft_assignment(p, c).select("cell_id", "cluster", r("q").alias("q"), r("p").alias("p"))


@query("meta_gene", "M14")
def meta_gene(spark, d):
    from cytogrid.operators.metagene import find_meta_gene
    m = find_meta_gene(D.expr(spark, d), D.cells(spark, d), "BUILDING", "Brand#1")
    return m.groupBy("name").agg(F.count(F.lit(1)).alias("n_cells"), r(F.avg("meta"), 4).alias("mean"))
