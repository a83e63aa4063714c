"""Checks of a labelling: agreement, transitions, silhouette, clustering by k-means."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cytogrid.operators.ordering import top_per_group

MAX_CLUSTERS = 10_000  # cluster summaries carried by every row


def _bounded(table: DataFrame, array: str) -> DataFrame:
    """Fail instead of copying an unbounded cluster table to every task."""
    ok = F.when(F.size(array) > MAX_CLUSTERS, F.raise_error(F.lit("too many clusters"))).otherwise(F.lit(True))
    return table.where(ok)


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.avg((F.col(a) == F.col(b)).cast("double")).alias("agreement"))


def transitions(df: DataFrame, a: str, b: str, k: int = 10) -> DataFrame:
    """Most frequent changes a -> b (ties by name)."""
    t = df.where(F.col(a) != F.col(b)).groupBy(F.col(a).alias("from"), F.col(b).alias("to")).agg(F.count(F.lit(1)).alias("n"))
    return t.orderBy(F.desc("n"), "from", "to").limit(k)


def silhouette(points: DataFrame, label: str = "cell_type", dims: tuple[str, ...] = ("x", "y"), id_col: str = "cell_id") -> DataFrame:
    """(id, s) silhouette with squared Euclidean distance, in closed form.

    mean |p - q|^2 over a cluster follows from its size, mean and mean square,
    so each point folds over one small array of cluster summaries: no point
    pairs, no shuffle beyond the summaries.
    """
    sq = sum((F.col(c) * F.col(c) for c in dims), F.lit(0.0))
    stats = points.groupBy(F.col(label).alias("l")).agg(F.count(F.lit(1)).alias("n"), F.avg(sq).alias("q"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(dims)])
    table = _bounded(stats.agg(F.collect_list(F.struct(*stats.columns)).alias("_cl")), "_cl")
    mean = lambda c: sq - 2 * sum((F.col(x) * c[f"m{i}"] for i, x in enumerate(dims)), F.lit(0.0)) + c["q"]
    own = F.filter("_cl", lambda c: c["l"] == F.col(label))[0]
    rest = F.array_min(F.transform(F.filter("_cl", lambda c: c["l"] != F.col(label)), mean))
    p = points.crossJoin(F.broadcast(table)).select(id_col, (mean(own) * own["n"] / F.greatest(own["n"] - 1, F.lit(1))).alias("a"), rest.alias("b"), own["n"].alias("k"))  # one row
    return p.select(id_col, F.when(F.col("k") == 1, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b")).alias("s"))


def kmeans(points: DataFrame, k: int, dims: tuple[str, ...] = ("x", "y"), seed: int = 0, id_col: str = "cell_id") -> DataFrame:
    """Distributed k-means labels with the within-cluster squared distance of each point."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    v = VectorAssembler(inputCols=list(dims), outputCol="_f").transform(points)
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="cluster").fit(v)
    out = model.transform(v).select(id_col, *dims, "cluster")
    means = out.groupBy("cluster").agg(*[F.avg(c).alias(f"_m{c}") for c in dims])
    d2 = sum(((F.col(c) - F.col(f"_m{c}")) * (F.col(c) - F.col(f"_m{c}")) for c in dims), F.lit(0.0))
    return out.join(means, "cluster").select(id_col, "cluster", d2.alias("d2"))


def cluster_curve(points: DataFrame, ks: range, dims: tuple[str, ...] = ("x", "y"), id_col: str = "cell_id", criterion: str = "inertia") -> DataFrame:
    """(k, score) for choosing k: ``inertia``, ``ch`` (Calinski-Harabasz) or ``sh`` (silhouette)."""
    out = None
    for k in ks:
        c = kmeans(points, k, dims, id_col=id_col)
        if criterion == "sh":
            lab = points.join(c.select(id_col, "cluster"), id_col)
            s = silhouette(lab, "cluster", dims, id_col).agg(F.avg("s").alias("score"))
        else:
            mean = points.agg(*[F.avg(x).alias(f"_g{x}") for x in dims])
            tot = points.crossJoin(F.broadcast(mean)).agg(F.sum(sum(((F.col(x) - F.col(f"_g{x}")) * (F.col(x) - F.col(f"_g{x}")) for x in dims), F.lit(0.0))).alias("t"), F.count(F.lit(1)).alias("n"))  # one row
            w = c.agg(F.sum("d2").alias("w")).crossJoin(tot)
            s = w.select(F.col("w").alias("score")) if criterion == "inertia" else w.select(((F.col("t") - F.col("w")) / (k - 1) / (F.col("w") / (F.col("n") - k))).alias("score"))
        s = s.select(F.lit(k).alias("k"), "score")
        out = s if out is None else out.unionByName(s)
    return out


def principal_components(wide: DataFrame, dims: list[str], k: int) -> DataFrame:
    """Rows with a ``pc`` array of the first k principal scores."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    v = VectorAssembler(inputCols=dims, outputCol="_f").transform(wide)
    m = PCA(k=k, inputCol="_f", outputCol="_p").fit(v)
    return m.transform(v).withColumn("pc", vector_to_array("_p")).drop("_f", "_p")


def majority_label(df: DataFrame, group: str, label: str) -> DataFrame:
    """Most frequent label per group, ties to the smaller label."""
    c = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    return top_per_group(c, [group], [F.desc("_n"), F.asc(label)], 1).select(group, F.col(label).alias("majority"))


def soft_assignment(points: DataFrame, centres: DataFrame, dims: tuple[str, ...] = ("x", "y"), alpha: float = 1.0, id_col: str = "cell_id") -> DataFrame:
    """(id, cluster, q, p): Student-t membership and its sharpened target distribution.

    Memberships of a point live in one array; only per-cluster totals shuffle.
    """
    table = _bounded(centres.agg(F.collect_list(F.struct("cluster", *dims)).alias("_c")), "_c")
    d2 = lambda c: sum(((F.col(x) - c[x]) * (F.col(x) - c[x]) for x in dims), F.lit(0.0))
    total = lambda a, k: F.aggregate(a, F.lit(0.0), lambda s, c: s + c[k])
    u = points.select(id_col, *dims).crossJoin(F.broadcast(table)).select(id_col, F.transform("_c", lambda c: F.struct(  # one row
        c["cluster"].alias("cluster"), F.pow(1 + d2(c) / alpha, F.lit(-(alpha + 1) / 2)).alias("u"))).alias("_u"))
    q = u.withColumn("_s", total(F.col("_u"), "u")).select(id_col, F.transform("_u", lambda c: F.struct(c["cluster"].alias("cluster"), (c["u"] / F.col("_s")).alias("q"))).alias("_q"))
    mass = q.select(F.explode("_q").alias("c")).groupBy("c.cluster").agg(F.sum("c.q").alias("t"))
    by = mass.agg(F.map_from_entries(F.collect_list(F.struct("cluster", "t"))).alias("_t"))
    f = q.crossJoin(F.broadcast(by)).select(id_col, F.transform("_q", lambda c: F.struct(  # one row
        c["cluster"].alias("cluster"), c["q"].alias("q"), (c["q"] * c["q"] / F.col("_t")[c["cluster"]]).alias("f"))).alias("_f"))
    return (f.withColumn("_g", total(F.col("_f"), "f")).select(id_col, "_g", F.explode("_f").alias("c"))
            .select(id_col, F.col("c.cluster").alias("cluster"), F.col("c.q").alias("q"), (F.col("c.f") / F.col("_g")).alias("p")))
