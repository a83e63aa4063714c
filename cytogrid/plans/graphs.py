"""Regions of interest, neighbour joins, graph construction and graph metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from cytogrid.operators import graph as G, spatial as S
from cytogrid.plans.registry import query, r
from cytogrid.session import cut
from cytogrid.sources import driver_tables as D

# fixed region outline on the embedding plane (the dense centre)
ROI = [(-25.0, -20.0), (20.0, -25.0), (28.0, 5.0), (10.0, 26.0), (-22.0, 22.0)]
_n = len(ROI)
ROI_SQL = "ring AS (SELECT * FROM (VALUES " + ", ".join(
    f"({ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)"
    for (ax, ay), (bx, by) in zip(ROI, ROI[1:] + ROI[:1])) + """) t(x1, y1, x2, y2)),
roi AS (SELECT cell_id, x, y, cell_type FROM points JOIN ring ON TRUE GROUP BY ALL
  HAVING sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1)"""
GRAPH_SQL = """edges AS (SELECT a.cell_id AS src, b.cell_id AS dst, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS dist
  FROM {n} a JOIN {n} b ON a.cell_id < b.cell_id AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 16::DOUBLE),
wedges AS (SELECT src, dst, CASE WHEN dist <> 0 THEN 1/dist ELSE 0 END AS weight FROM edges),
sym AS (SELECT src AS node, dst AS nbr, weight FROM wedges UNION ALL SELECT dst, src, weight FROM wedges),
deg AS (SELECT node, count(*) AS k, sum(abs(weight)) AS s FROM sym GROUP BY 1),
scored AS (SELECT e.src, e.dst, e.weight, coalesce(
   CASE WHEN b.k > 1 THEN round(pow(greatest(1 - abs(weight)/b.s, 0), b.k - 1), 4) END,
   CASE WHEN a.k > 1 THEN round(pow(greatest(1 - abs(weight)/a.s, 0), a.k - 1), 4) END) AS alpha
   FROM wedges e JOIN deg a ON a.node = e.src JOIN deg b ON b.node = e.dst)"""
EDGES_SQL = GRAPH_SQL.format(n="points")


def _roi(spark, d):
    return S.roi_filter(D.points(spark, d), ROI)


def _edges(spark, d, nodes=None, reach=4.0):
    return G.radius_graph(D.points(spark, d) if nodes is None else nodes, reach)  # formed anew by every reader: storing them would take more than forming them


def _kept(spark, d):
    return G.alpha_cut(G.radius_disparity(D.points(spark, d), 4.0).select("src", "dst", "weight", "alpha"), 0.3)


def _backbone(spark, d, nodes=None):
    return G.radius_backbone(D.points(spark, d) if nodes is None else nodes, 4.0, 0.3)


def _stored(spark, d):
    return cut(_kept(spark, d))  # read several times by every caller


@query("roi_filter", "P1 S9 D13", f"WITH {ROI_SQL} SELECT cell_id, cell_type, round(x,6) AS x, round(y,6) AS y FROM roi", "points")
def roi_filter(spark, d):
    return _roi(spark, d).select("cell_id", "cell_type", r("x").alias("x"), r("y").alias("y"))


@query("roi_filter_cells", "P1", """SELECT cell_id, cell_type FROM cells
  WHERE abs(x - 20) / 15 + abs(y - 18) / 16 < 1""", "cells")
def roi_filter_cells(spark, d):
    diamond = [(5.0, 18.0), (20.0, 2.0), (35.0, 18.0), (20.0, 34.0)]
    return S.roi_filter(D.cells(spark, d), diamond).select("cell_id", "cell_type")


@query("radius_graph", "J9 G3 F4", f"WITH {EDGES_SQL} SELECT src, dst, round(weight, 6) AS weight FROM wedges", "points")
def radius_graph(spark, d):
    return _edges(spark, d).select("src", "dst", r("weight").alias("weight"))


@query("radius_pairs_cells", "J9 J10", """SELECT a.cell_type AS type_a, b.cell_type AS type_b, count(*) AS n,
  round(avg(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))), 6) AS mean_dist
  FROM cells a JOIN cells b ON a.cell_id < b.cell_id AND abs(a.y-b.y) <= 1.5 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 2.25
  GROUP BY 1, 2""", "cells")
def radius_pairs_cells(spark, d):
    e = S.radius_pairs(D.cells(spark, d), 1.5, carry=["cell_type"])
    return e.groupBy(F.col("src_cell_type").alias("type_a"), F.col("dst_cell_type").alias("type_b")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("dist")).alias("mean_dist"))


@query("disparity_scores", "G5", f"WITH {EDGES_SQL} SELECT src, dst, alpha::DOUBLE AS alpha FROM scored WHERE alpha IS NOT NULL", "points")
def disparity_scores(spark, d):
    return G.radius_disparity(D.points(spark, d), 4.0).select("src", "dst", r("alpha", 4).alias("alpha"))


@query("disparity_backbone", "G7 G8", f"WITH {EDGES_SQL} SELECT src, dst, round(weight, 6) AS weight FROM scored WHERE alpha < 0.3", "points")
def disparity_backbone(spark, d):
    return _kept(spark, d).select("src", "dst", r("weight").alias("weight"))


SUMMARY_SQL = """, kept AS (SELECT src, dst FROM scored WHERE alpha < 0.3),
ksym AS (SELECT src AS node, dst AS nbr FROM kept UNION ALL SELECT dst, src FROM kept),
kd AS (SELECT node, count(*) AS deg FROM ksym GROUP BY 1),
tri AS (SELECT p.node, count(*) / 2 AS t FROM ksym p JOIN ksym q ON p.nbr = q.node JOIN ksym s ON q.nbr = s.node AND s.nbr = p.node GROUP BY 1),
local AS (SELECT cell_id, coalesce(deg, 0) AS deg, coalesce(t, 0) AS t,
  CASE WHEN coalesce(deg, 0) < 2 THEN 0 ELSE 2.0 * coalesce(t, 0) / (deg * (deg - 1)) END AS c
  FROM {n} LEFT JOIN kd ON kd.node = cell_id LEFT JOIN tri ON tri.node = cell_id)"""


@query("spatial_network_summary", "P1 J9 G8 G10 A33", f"""WITH {ROI_SQL}, {(GRAPH_SQL + SUMMARY_SQL).format(n="roi")}
SELECT count(*) AS nodes, CAST(sum(deg) / 2 AS BIGINT) AS edges, round(avg(deg), 4) AS avg_degree, round(avg(c), 6) AS avg_clustering FROM local""", "points")
def spatial_network_summary(spark, d):
    roi = _roi(spark, d)
    local = G.clustering(_backbone(spark, d, roi), roi)
    return local.agg(F.count(F.lit(1)).alias("nodes"), F.expr("cast(sum(degree) / 2 as bigint)").alias("edges"),
                     r(F.avg("degree"), 4).alias("avg_degree"), r(F.avg("clustering")).alias("avg_clustering"))


@query("graph_clustering", "G9 G10", f"""WITH {EDGES_SQL}{SUMMARY_SQL.format(n="points")}
SELECT cell_id, CAST(deg AS BIGINT) AS degree, CAST(t AS BIGINT) AS triangles, round(c, 6) AS clustering,
  round(deg / (SELECT count(*) - 1 FROM points), 6) AS centrality FROM local""", "points")
def graph_clustering(spark, d):
    e, n = _backbone(spark, d), D.points(spark, d)
    return (G.clustering(e, n).join(G.degree_centrality(e, n).drop("degree"), "cell_id")
            .select("cell_id", "degree", "triangles", r("clustering").alias("clustering"), r("centrality").alias("centrality")))


@query("degree_sequence", "G9 A3", f"""WITH {EDGES_SQL} SELECT k AS degree, count(*) AS n FROM deg GROUP BY 1""", "points")
def degree_sequence(spark, d):
    return G.degrees(_edges(spark, d)).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


DIRECTED_SQL = """WITH e AS (SELECT DISTINCT o_custkey AS src, l_suppkey AS dst, count(*) OVER (PARTITION BY o_custkey, l_suppkey) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
o AS (SELECT src, count(*) AS k, sum(w) AS s FROM e GROUP BY 1), i AS (SELECT dst, count(*) AS k, sum(w) AS s FROM e GROUP BY 1),
s AS (SELECT e.src, e.dst, w,
  CASE WHEN o.k = 1 AND i.k = 1 THEN 0 WHEN o.k > 1 THEN round(pow(1 - w / o.s, o.k - 1), 4) END AS ao,
  CASE WHEN o.k = 1 AND i.k = 1 THEN 0 WHEN i.k > 1 THEN round(pow(1 - w / i.s, i.k - 1), 4) END AS ai
  FROM e JOIN o ON o.src = e.src JOIN i ON i.dst = e.dst)"""


def _directed(spark, d):
    o = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
    return (D.table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("dst")).join(o, "l_orderkey")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight")))


@query("disparity_directed", "G6", DIRECTED_SQL + """
SELECT src, dst, ao::DOUBLE AS alpha_out, ai::DOUBLE AS alpha_in FROM s""")
def disparity_directed(spark, d):
    return G.disparity_directed(_directed(spark, d)).select("src", "dst", r("alpha_out", 4).alias("alpha_out"), r("alpha_in", 4).alias("alpha_in"))


@query("alpha_cut_directed", "G7", DIRECTED_SQL + """, c AS (SELECT coalesce(ao, 1) < 0.3 AS a, coalesce(ai, 1) < 0.3 AS b FROM s)
SELECT 'or' AS rule, count(*) AS n FROM c WHERE a OR b UNION ALL SELECT 'and', count(*) FROM c WHERE a AND b""")
def alpha_cut_directed(spark, d):
    s = G.disparity_directed(_directed(spark, d))
    n = lambda rule: G.alpha_cut(s, 0.3, rule).agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
    return n("or").unionByName(n("and"))


@query("strongest_edges", "G4 T6", f"""WITH {EDGES_SQL} SELECT src, dst FROM (SELECT src, dst,
  row_number() OVER (ORDER BY round(weight, 9) DESC, src, dst) AS rn FROM wedges)
  WHERE rn <= (SELECT CAST(floor(1.5 * count(*)) AS BIGINT) FROM points)""", "points")
def strongest_edges(spark, d):
    p = D.points(spark, d)
    e = _edges(spark, d, p, G.strongest_reach(p, 4.0)).select("src", "dst", F.round("weight", 9).alias("weight"))  # longer edges cannot be among the strongest
    return G.strongest_edges(e, p).select("src", "dst")


KNN_SQL = """WITH knn AS (SELECT * FROM (SELECT a.cell_id AS src, b.cell_id AS dst, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2,
  row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.cell_id) AS rank
  FROM {rel} a JOIN {rel} b ON a.cell_id <> b.cell_id) WHERE rank <= {k})"""


@query("knn_join", "J13 W3", KNN_SQL.format(rel="points", k=6) + " SELECT src, dst, CAST(rank AS INT) AS rank, round(sqrt(d2), 6) AS dist FROM knn", "points")
def knn_join(spark, d):
    return S.knn(D.points(spark, d), 6).select("src", "dst", "rank", r("dist").alias("dist"))


@query("knn_join_cells", "J13", KNN_SQL.format(rel="cells", k=15) + """ SELECT src, count(*) AS n, CAST(sum(dst) AS BIGINT) AS nbr_sum,
  round(max(sqrt(d2)), 6) AS reach FROM knn GROUP BY 1""", "cells")
def knn_join_cells(spark, d):
    return S.knn(D.cells(spark, d), 15).groupBy("src").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dst").alias("nbr_sum"), r(F.max("dist")).alias("reach"))


@query("knn_graph", "G1", KNN_SQL.format(rel="points", k=3) + " SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst, 1::DOUBLE AS weight FROM knn", "points")
def knn_graph(spark, d):
    return G.knn_graph(D.points(spark, d), 3)


@query("neighbour_counts_by_type", "J11 A35", """SELECT q.cell_id, p.cell_type, count(*) AS n FROM cells q JOIN cells p
  ON abs(q.y - p.y) <= 2 AND (q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y) <= 4 WHERE q.cell_type = 'BUILDING' GROUP BY 1, 2""", "cells")
def neighbour_counts_by_type(spark, d):
    c = D.cells(spark, d)
    return S.count_by_type(c.where(F.col("cell_type") == "BUILDING"), c, 2.0)


@query("box_window_composition", "J12 M13", """SELECT q.cell_id, p.cell_type, count(*) - CASE WHEN p.cell_type = 'BUILDING' THEN 1 ELSE 0 END AS n
  FROM cells q JOIN cells p ON p.x < q.x + 3 AND p.x > q.x - 3 AND p.y < q.y + 3 AND p.y > q.y - 3
  WHERE q.cell_type = 'BUILDING' GROUP BY 1, 2""", "cells")
def box_window_composition(spark, d):
    c = D.cells(spark, d)
    n = S.count_by_type(c.where(F.col("cell_type") == "BUILDING"), c, 3.0, shape="box")
    return n.withColumn("n", F.col("n") - (F.col("cell_type") == "BUILDING").cast("int"))


@query("neighbouring_domains", "M9", """WITH size AS (SELECT cell_type, count(*) AS size FROM cells GROUP BY 1),
nbr AS (SELECT p.cell_type, count(*) AS n FROM cells q JOIN cells p
  ON abs(q.y - p.y) <= 2 AND (q.x-p.x)*(q.x-p.x)+(q.y-p.y)*(q.y-p.y) <= 4 WHERE q.cell_type = 'BUILDING' AND p.cell_type <> 'BUILDING' GROUP BY 1)
SELECT cell_type, n, size FROM nbr JOIN size USING (cell_type) WHERE n > 0.5 * size""", "cells")
def neighbouring_domains(spark, d):
    from cytogrid.operators.niches import neighbouring_domains as op
    return op(D.cells(spark, d), "BUILDING", 2.0, 0.5)


@query("modularity", "G16", f"""WITH {EDGES_SQL}, j AS (SELECT a.cell_type AS la, b.cell_type AS lb FROM sym JOIN points a ON a.cell_id = node JOIN points b ON b.cell_id = nbr),
c AS (SELECT la, count(*) AS k, sum(CASE WHEN la = lb THEN 1 ELSE 0 END) AS i FROM j GROUP BY 1)
SELECT round(sum(i / m - (k / m) * (k / m)), 6) AS modularity FROM c, (SELECT sum(k)::DOUBLE AS m FROM c)""", "points")
def modularity(spark, d):
    return G.modularity(_edges(spark, d), D.points(spark, d), label="cell_type").select(r("modularity").alias("modularity"))


@query("laplacian", "G17 D8", f"""WITH {EDGES_SQL} SELECT node AS i, nbr AS j, round(-weight, 6) AS v FROM sym
UNION ALL SELECT node, node, round(s, 6) FROM deg""", "points")
def laplacian(spark, d):
    return G.laplacian(_edges(spark, d), D.points(spark, d)).select("i", "j", r("v").alias("v"))


@query("laplacian_normalised", "G17", f"""WITH {EDGES_SQL} SELECT node AS i, nbr AS j, round(-weight / sqrt(a.s * b.s), 6) AS v
FROM sym JOIN deg a USING (node) JOIN deg b ON b.node = nbr UNION ALL SELECT cell_id, cell_id, 1::DOUBLE FROM points""", "points")
def laplacian_normalised(spark, d):
    return G.radius_laplacian(D.points(spark, d), 4.0).select("i", "j", r("v").alias("v"))


@query("symmetrise_max", "C12", """SELECT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst, max(l_quantity) AS weight
FROM lineitem GROUP BY 1, 2""")
def symmetrise_max(spark, d):
    return G.symmetrise_max(D.table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight")))


@query("connected_components", "G14", f"""WITH RECURSIVE {EDGES_SQL},
reach AS (SELECT cell_id AS root, cell_id AS node FROM points UNION SELECT root, nbr FROM reach JOIN
  (SELECT src AS node, dst AS nbr FROM scored WHERE alpha < 0.3 UNION ALL SELECT dst, src FROM scored WHERE alpha < 0.3) USING (node))
SELECT node AS cell_id, min(root) AS component FROM reach GROUP BY 1""", "points")
def connected_components(spark, d):
    return G.components(_kept(spark, d), D.points(spark, d))


@query("closeness", "G11", f"""WITH RECURSIVE {EDGES_SQL},
adj AS (SELECT src AS node, dst AS nbr FROM scored WHERE alpha < 0.3 UNION ALL SELECT dst, src FROM scored WHERE alpha < 0.3),
best(root, node, depth) USING KEY (root, node) AS (SELECT cell_id, cell_id, 0 FROM points UNION
  SELECT w.root, a.nbr, min(w.depth) + 1 FROM best w JOIN adj a ON a.node = w.node LEFT JOIN recurring.best k ON k.root = w.root AND k.node = a.nbr WHERE k.root IS NULL GROUP BY 1, 2),
g AS (SELECT root, count(*) AS r, sum(depth) AS total FROM best GROUP BY 1)
SELECT root AS cell_id, round(CASE WHEN total > 0 THEN (r - 1) * (r - 1) / (total * ((SELECT count(*) FROM points) - 1.0)) ELSE 0 END, 6) AS closeness FROM g""", "points")
def closeness(spark, d):
    return G.closeness(_backbone(spark, d), D.points(spark, d)).select("cell_id", r("closeness").alias("closeness"))


@query("betweenness", "G12", f"""WITH RECURSIVE {EDGES_SQL},
adj AS (SELECT src AS node, dst AS nbr FROM scored WHERE alpha < 0.3 UNION ALL SELECT dst, src FROM scored WHERE alpha < 0.3),
best(root, node, depth, sigma) USING KEY (root, node) AS (SELECT cell_id, cell_id, 0, 1::DOUBLE FROM points UNION
  SELECT w.root, a.nbr, min(w.depth) + 1, sum(w.sigma) FROM best w JOIN adj a ON a.node = w.node LEFT JOIN recurring.best k ON k.root = w.root AND k.node = a.nbr WHERE k.root IS NULL GROUP BY 1, 2),
b AS (SELECT v.node, sum(v.sigma * w.sigma / t.sigma) AS b FROM best v JOIN best w ON w.root = v.node AND w.node <> v.node JOIN best t ON t.root = v.root AND t.node = w.node
  WHERE v.root <> v.node AND t.depth = v.depth + w.depth GROUP BY 1), n AS (SELECT count(*)::DOUBLE AS n FROM points)
SELECT cell_id, round(coalesce(b, 0) / ((n - 1) * (n - 2)), 6) AS betweenness FROM points CROSS JOIN n LEFT JOIN b ON b.node = cell_id""", "points")
def betweenness(spark, d):
    return G.betweenness(_backbone(spark, d), D.points(spark, d), D.points(spark, d)).select("cell_id", r("betweenness").alias("betweenness"))


@query("global_efficiency", "G11", f"""WITH RECURSIVE {EDGES_SQL},
adj AS (SELECT src AS node, dst AS nbr FROM scored WHERE alpha < 0.3 UNION ALL SELECT dst, src FROM scored WHERE alpha < 0.3),
best(root, node, depth) USING KEY (root, node) AS (SELECT cell_id, cell_id, 0 FROM points UNION
  SELECT w.root, a.nbr, min(w.depth) + 1 FROM best w JOIN adj a ON a.node = w.node LEFT JOIN recurring.best k ON k.root = w.root AND k.node = a.nbr WHERE k.root IS NULL GROUP BY 1, 2), n AS (SELECT count(*)::DOUBLE AS n FROM points)
SELECT round(coalesce((SELECT sum(1.0::DOUBLE / depth) FROM best WHERE depth > 0), 0) / (n * (n - 1)), 6) AS efficiency FROM n""", "points")
def global_efficiency(spark, d):
    return G.global_efficiency(_backbone(spark, d), D.points(spark, d)).select(r("efficiency").alias("efficiency"))


@query("eigenvector_centrality", "G13", f"""WITH RECURSIVE {EDGES_SQL},
adj AS (SELECT src AS node, dst AS nbr FROM scored WHERE alpha < 0.3 UNION ALL SELECT dst, src FROM scored WHERE alpha < 0.3 UNION ALL SELECT cell_id, cell_id FROM points),
pw(k, node, v) AS (SELECT 0, cell_id, 1::DOUBLE FROM points UNION ALL SELECT min(k) + 1, a.node, sum(v) FROM pw JOIN adj a ON a.nbr = pw.node WHERE k < 100 GROUP BY 2)
SELECT node AS cell_id, round(v / sqrt(sum(v * v) OVER ()), 4) AS centrality FROM pw WHERE k = 100""", "points")
def eigenvector_centrality(spark, d):
    # all rounds, so that the SQL twin knows their number
    return G.eigenvector_centrality(_stored(spark, d), D.points(spark, d), rounds=100, tol=0.0).select("cell_id", r("centrality", 4).alias("centrality"))


@query("communities", "G15")
def communities(spark, d):
    return G.radius_label_propagation(D.points(spark, d), 4.0, 0.3)


@query("delaunay_graph", "G2", """WITH p AS (SELECT a.cell_id AS src, b.cell_id AS dst, (a.x + b.x) / 2 AS mx, (a.y + b.y) / 2 AS my, b.x - a.x AS dx, b.y - a.y AS dy FROM points a JOIN points b ON a.cell_id < b.cell_id),
t AS (SELECT src, dst, dx * dx + dy * dy AS d2, (c.x - mx) * (c.x - mx) + (c.y - my) * (c.y - my) - (dx * dx + dy * dy) / 4 AS h, (c.y - my) * dx - (c.x - mx) * dy AS un FROM p JOIN points c ON c.cell_id <> src AND c.cell_id <> dst)
SELECT src, dst, round(1 / sqrt(any_value(d2)), 6) AS weight FROM t GROUP BY 1, 2
HAVING coalesce(max(CASE WHEN un < 0 THEN h / (2 * un) END), -1e300) <= coalesce(min(CASE WHEN un > 0 THEN h / (2 * un) END), 1e300)""", "points")
def delaunay_graph(spark, d):
    from cytogrid.operators.delaunay import delaunay_graph as op
    return op(D.points(spark, d)).select("src", "dst", r("weight").alias("weight"))


@query("delaunay_degree_cells", "G2 A33")
def delaunay_degree_cells(spark, d):
    from cytogrid.operators.delaunay import delaunay_graph as op
    return G.degrees(op(D.cells(spark, d))).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
