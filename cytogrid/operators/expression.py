"""Sparse expression (cell, gene, value): QC, normalisation, markers, tests.

Absent rows are zeros. Every mean, variance or fraction divides by the number
of cells, never by the number of stored rows.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cytogrid.functions.special import t_two_sided
from cytogrid.operators.multitest import adjust
from cytogrid.operators.ordering import exact_quantiles, global_rank, top_per_group

# fixed values: substrings that mark control features
CONTROL_KEYWORDS = ("NegControlProbe", "Intergenic_Region", "NegControlCodeword", "UnassignedCodeword", "DeprecatedCodeword")
# fixed values: prefixes of spike-in and mitochondrial genes
SPECIAL_PREFIXES = ("ERCC", "MT-")


def count_matrix(points: DataFrame, cell: str = "cell_id", gene: str = "feature_name") -> DataFrame:
    """Transcripts -> (cell, gene, n); unassigned transcripts are dropped."""
    return points.where(F.col(cell).isNotNull() & F.col(gene).isNotNull()).groupBy(cell, gene).agg(F.count(F.lit(1)).alias("n"))


def filter_cells(expr: DataFrame, min_counts: float | None = None, max_counts: float | None = None,
                 min_genes: int | None = None, max_genes: int | None = None,
                 cell: str = "cell_id", value: str = "value") -> DataFrame:
    return _filter(expr, cell, value, min_counts, max_counts, min_genes, max_genes)


def filter_genes(expr: DataFrame, min_counts: float | None = None, max_counts: float | None = None,
                 min_cells: int | None = None, max_cells: int | None = None,
                 gene: str = "gene", value: str = "value") -> DataFrame:
    return _filter(expr, gene, value, min_counts, max_counts, min_cells, max_cells)


def _filter(expr, key, value, min_total, max_total, min_n, max_n):
    t = expr.groupBy(key).agg(F.sum(value).alias("_t"), F.sum((F.col(value) > 0).cast("long")).alias("_n"))
    ok = F.lit(True)
    for c, lo, hi in (("_t", min_total, max_total), ("_n", min_n, max_n)):
        if lo is not None:
            ok = ok & (F.col(c) >= lo)
        if hi is not None:
            ok = ok & (F.col(c) <= hi)
    return expr.join(t.where(ok).select(key), key, "left_semi")


def is_special(gene: Column) -> Column:
    out = F.lit(False)
    for p in SPECIAL_PREFIXES:
        out = out | F.startswith(gene, F.lit(p))
    return out


def is_control(feature: Column) -> Column:
    out = F.lit(False)
    for w in CONTROL_KEYWORDS:
        out = out | F.contains(feature, F.lit(w))
    return out


def align_to_panel(expr: DataFrame, cells: DataFrame, panel: DataFrame, cell: str = "cell_id", gene: str = "gene",
                   pos: str = "pos") -> DataFrame:
    """Every (cell, panel gene) with zeros filled in; the panel's order comes along.

    The result is dense by definition: cells x panel.
    """
    grid = cells.select(cell).crossJoin(panel.select(gene, pos))
    return grid.join(expr.select(cell, gene, "value"), [cell, gene], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def cell_qc(points: DataFrame, cell: str = "cell_id", feature: str = "feature_name") -> DataFrame:
    """Totals, distinct genes and one control count per keyword, per cell."""
    ctl = is_control(F.col(feature))
    return points.where(F.col(cell).isNotNull()).groupBy(cell).agg(
        F.count(F.lit(1)).alias("transcript_counts"),
        F.sum((~ctl).cast("long")).alias("total_counts"),
        F.count_distinct(F.when(~ctl, F.col(feature))).alias("n_genes_by_counts"),
        *[F.sum(F.contains(F.col(feature), F.lit(w)).cast("long")).alias(f"n_{w}") for w in CONTROL_KEYWORDS])


def normalize_log(expr: DataFrame, target: float | None = 1e4, cell: str = "cell_id", value: str = "value",
                  log: bool = True) -> DataFrame:
    """Scale every cell to ``target`` (median total when None), then log1p."""
    tot = expr.groupBy(cell).agg(F.sum(value).alias("_tot"))
    if target is None:
        med = exact_quantiles(tot.where(F.col("_tot") > 0), "_tot", {"_target": 0.5})
        tot = tot.crossJoin(F.broadcast(med))  # one row
    goal = F.lit(float(target)) if target is not None else F.col("_target")
    v = F.when(F.col("_tot") > 0, F.col(value) * goal / F.col("_tot")).otherwise(0.0)
    return expr.join(tot, cell).withColumn(value, F.log1p(v) if log else v).drop("_tot", "_target")


def gene_moments(expr: DataFrame, n_cells: DataFrame, gene: str = "gene", value: str = "value") -> DataFrame:
    """(gene, n, mean, var_pop, var_samp) over all cells; ``n_cells`` is one row with column n."""
    v = F.col(value).cast("double")
    s = expr.groupBy(gene).agg(F.sum(v).alias("_s"), F.sum(v * v).alias("_q")).crossJoin(F.broadcast(n_cells))
    mean = F.col("_s") / F.col("n")
    ss = F.greatest(F.col("_q") - F.col("_s") * mean, F.lit(0.0))
    return s.select(gene, "n", mean.alias("mean"), (ss / F.col("n")).alias("var_pop"), F.try_divide(ss, F.col("n") - 1).alias("var_samp"))


def z_scale(expr: DataFrame, cells: DataFrame, ddof: int = 1, max_value: float | None = 10.0,
            cell: str = "cell_id", gene: str = "gene") -> DataFrame:
    """z per gene for stored values plus the shared value of the zeros: (cell, gene, z, z0).

    Zeros all map to z0 = -mean/sd, so the matrix stays sparse.
    """
    n = cells.agg(F.count(F.lit(1)).alias("n"))
    sd = F.sqrt("var_samp" if ddof else "var_pop")
    m = gene_moments(expr, n, gene).select(gene, "mean", F.when(sd > 0, sd).otherwise(1.0).alias("_sd"))
    top = (lambda c: F.least(c, F.lit(float(max_value)))) if max_value is not None else (lambda c: c)
    return expr.join(m, gene).select(cell, gene, top((F.col("value") - F.col("mean")) / F.col("_sd")).alias("z"),
                                     top(-F.col("mean") / F.col("_sd")).alias("z0"))


def group_sizes(cells: DataFrame, in_group: Column) -> DataFrame:
    """One row: n_in, n_out."""
    return cells.agg(F.sum(in_group.cast("long")).alias("n_in"), F.sum((~in_group).cast("long")).alias("n_out"))


def marker_stats(expr: DataFrame, cells: DataFrame, markers: DataFrame, cell: str = "cell_id", label: str = "cell_type") -> DataFrame:
    """Per (cell type, marker): fractions and means inside/outside the type.

    mean_in/out divide by all cells of the side, pos_mean_in/out by positive
    cells; fold and specificity add 1e-10 below. Sums are taken per (type of
    the cell, gene) first, so no cell x marker-type product is formed. Markers
    without a positive value and types without cells have zeros.
    """
    v = F.col("value").cast("double")
    per = (expr.join(markers.select("gene").distinct(), "gene", "left_semi").where(v > 0)
           .join(cells.select(cell, label), cell).groupBy("gene", F.col(label).alias("_t"))
           .agg(F.sum(v).alias("_s"), F.count(F.lit(1)).alias("_p")))
    size = cells.groupBy(F.col(label).alias("cell_type")).agg(F.count(F.lit(1)).alias("n_cells"))
    all_n = cells.agg(F.count(F.lit(1)).alias("_N"))
    mine = F.col("_t") == F.col("cell_type")
    j = (markers.select("cell_type", "gene").distinct().join(per, "gene", "left").groupBy("cell_type", "gene").agg(
        F.sum(F.when(mine, F.col("_s"))).alias("s_in"), F.sum(F.when(mine, F.col("_p"))).alias("p_in"), F.sum("_s").alias("_S"), F.sum("_p").alias("_P"))
        .join(size, "cell_type", "left").crossJoin(F.broadcast(all_n)))  # one row
    j = j.fillna(0, ["n_cells", "_S", "_P"])
    s_in, p_in = F.coalesce("s_in", F.lit(0.0)), F.coalesce("p_in", F.lit(0))
    s_out, p_out = F.col("_S") - s_in, F.col("_P") - p_in
    n_in, n_out = F.col("n_cells"), F.col("_N") - F.col("n_cells")
    div0 = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    out = j.select("cell_type", "gene", "n_cells", div0(s_in, n_in).alias("mean_in"), div0(s_out, n_out).alias("mean_out"),
                   div0(s_in, p_in).alias("pos_mean_in"), div0(s_out, p_out).alias("pos_mean_out"),
                   (100 * div0(p_in, n_in)).alias("pct_in"), (100 * div0(p_out, n_out)).alias("pct_out"))
    return (out.withColumn("fold", F.col("mean_in") / (F.col("mean_out") + 1e-10))
            .withColumn("pos_fold", F.col("pos_mean_in") / (F.col("pos_mean_out") + 1e-10))
            .withColumn("specificity", F.col("pct_in") / (F.col("pct_out") + 1e-10)))


def marker_quality(fold: Column, pct: Column) -> Column:
    return F.when((fold >= 2) & (pct >= 30), "Excellent").when((fold >= 1.5) | (pct >= 20), "Good").otherwise("Poor")


def markers_from_matrix(wide: DataFrame, types: Sequence[str], gene: str = "gene") -> DataFrame:
    """Wide marker matrix -> (cell_type, gene) for positive entries."""
    long = wide.select(gene, F.explode(F.create_map(*[x for t in types for x in (F.lit(t), F.col(f"`{t}`").cast("double"))])).alias("cell_type", "_w"))
    return long.where(F.col("_w") > 0).select("cell_type", gene)


def marker_availability(markers: DataFrame, measured: DataFrame) -> DataFrame:
    """Per type: markers, available, missing, complete."""
    m = markers.join(measured.select("gene").distinct().withColumn("_ok", F.lit(1)), "gene", "left")
    return m.groupBy("cell_type").agg(
        F.count(F.lit(1)).alias("n_markers"), F.sum(F.coalesce("_ok", F.lit(0))).cast("long").alias("available"),
        F.sum(1 - F.coalesce("_ok", F.lit(0))).cast("long").alias("missing")).withColumn("complete", F.col("missing") == 0)


def gene_set_score(expr: DataFrame, cells: DataFrame, sets: DataFrame, n_bins: int = 25, cell: str = "cell_id") -> DataFrame:
    """(cell, set, score): mean over the set minus mean over all genes of the same expression bins.

    Deterministic form of the random-control score: controls are every gene
    outside the set in bins the set touches. Every cell has a row for every set
    that shares a gene with the data; without reads in either side it scores 0.
    """
    n = cells.agg(F.count(F.lit(1)).alias("n"))
    ranked = global_rank(gene_moments(expr, n).select("gene", "mean"), ["mean", "gene"], "_r", "_g")
    bins = ranked.select("gene", F.floor((F.col("_r") - 1) * n_bins / F.col("_g")).alias("_bin"))
    in_set = sets.join(bins, "gene").select(F.col("cell_type").alias("set"), "gene", "_bin")
    control = (in_set.select("set", "_bin").distinct().join(bins, "_bin").join(in_set.select("set", "gene"), ["set", "gene"], "left_anti"))
    weights = (in_set.select("set", "gene", F.lit(1).alias("_side")).unionByName(control.select("set", "gene", F.lit(-1).alias("_side"))))
    size = weights.groupBy("set").agg(F.sum((F.col("_side") == 1).cast("long")).alias("_a"), F.sum((F.col("_side") == -1).cast("long")).alias("_b"))
    part = F.when(F.col("_side") == 1, F.col("value") / F.col("_a")).otherwise(-F.col("value") / F.col("_b"))
    read = expr.join(weights, "gene").join(size, "set").groupBy(cell, "set").agg(F.sum(part).alias("score"))
    every = cells.select(cell).distinct().crossJoin(size.select("set"))  # cells x sets: the table itself
    return every.join(read, [cell, "set"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def welch_t(expr: DataFrame, cells: DataFrame, in_group: Column, cell: str = "cell_id") -> DataFrame:
    """Per gene: Welch t, degrees of freedom, means and detection fractions in/out, fold."""
    flag = cells.select(cell, in_group.alias("_in"))
    n = group_sizes(flag, F.col("_in"))
    v = F.col("value").cast("double")
    side = lambda c, s: F.sum(F.when(F.col("_in") == s, c).otherwise(0.0))
    a = (expr.join(flag, cell).groupBy("gene").agg(
        side(v, True).alias("s1"), side(v * v, True).alias("q1"), side(v, False).alias("s0"), side(v * v, False).alias("q0"),
        side((v > 0).cast("double"), True).alias("p1"), side((v > 0).cast("double"), False).alias("p0"))
        .crossJoin(F.broadcast(n)))  # one row
    m1, m0 = F.col("s1") / F.col("n_in"), F.col("s0") / F.col("n_out")
    v1 = (F.col("q1") - F.col("s1") * m1) / (F.col("n_in") - 1) / F.col("n_in")
    v0 = (F.col("q0") - F.col("s0") * m0) / (F.col("n_out") - 1) / F.col("n_out")
    return a.select("gene", m1.alias("mean_in"), m0.alias("mean_out"), (F.col("p1") / F.col("n_in")).alias("frac_in"),
                    (F.col("p0") / F.col("n_out")).alias("frac_out"), (m1 / (m0 + 1e-9)).alias("fold"),
                    F.when(v1 + v0 > 0, (m1 - m0) / F.sqrt(v1 + v0)).otherwise(0.0).alias("t"),
                    F.try_divide((v1 + v0) * (v1 + v0), v1 * v1 / (F.col("n_in") - 1) + v0 * v0 / (F.col("n_out") - 1)).alias("dof"))


def variable_genes(expr: DataFrame, cells: DataFrame, n_bins: int = 20, top: int | None = None) -> DataFrame:
    """Dispersion var/mean standardised within equal-count mean bins; ranked."""
    n = cells.agg(F.count(F.lit(1)).alias("n"))
    m = gene_moments(expr, n).where(F.col("mean") > 0).select("gene", "mean", (F.col("var_samp") / F.col("mean")).alias("dispersion"))
    b = (global_rank(m, ["mean", "gene"], "_r", "_g")
         .withColumn("bin", F.floor((F.col("_r") - 1) * n_bins / F.col("_g")).cast("int")).drop("_r", "_g"))
    s = b.groupBy("bin").agg(F.avg("dispersion").alias("_m"), F.stddev_samp("dispersion").alias("_s"))
    z = b.join(s, "bin").withColumn("score", F.coalesce(F.try_divide(F.col("dispersion") - F.col("_m"), F.col("_s")), F.lit(0.0))).drop("_m", "_s")
    r = global_rank(z.withColumn("_k", F.round("score", 9)), [F.desc("_k"), F.asc("gene")], "rank").drop("_k")
    return r if top is None else r.where(F.col("rank") <= top)


def spatial_bins(expr: DataFrame, cells: DataFrame, size: float, cell: str = "cell_id") -> DataFrame:
    """Sum of each gene in square bins: (bin_id 'x_y', bx, by, gene, value)."""
    b = cells.select(cell, F.floor(F.col("x") / size).alias("bx"), F.floor(F.col("y") / size).alias("by"))
    return (expr.join(b, cell).groupBy("bx", "by", "gene").agg(F.sum("value").alias("value"))
            .withColumn("bin_id", F.concat_ws("_", F.col("bx").cast("string"), F.col("by").cast("string"))))


def fixed_grid(cells: DataFrame, nx: int, ny: int, cell: str = "cell_id") -> DataFrame:
    """(cell, gi, gj) with step (max-min)/(n-1) from one-row bounds."""
    e = cells.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    idx = lambda c, a, b, n: F.floor((F.col(c) - F.col(a)) / ((F.col(b) - F.col(a)) / F.lit(float(n - 1)))).cast("int")
    return cells.crossJoin(F.broadcast(e)).select(cell, idx("x", "_x0", "_x1", nx).alias("gi"), idx("y", "_y0", "_y1", ny).alias("gj"))


def grid_sums(expr: DataFrame, cells: DataFrame, nx: int, ny: int, cell: str = "cell_id") -> DataFrame:
    """Total expression of every grid bin, empty bins included: (spot, gi, gj, total, n_cells)."""
    spark = expr.sparkSession
    g = fixed_grid(cells, nx, ny, cell)
    per_cell = expr.groupBy(cell).agg(F.sum("value").alias("_v"))
    t = g.join(per_cell, cell, "left").groupBy("gi", "gj").agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("total"), F.count(F.lit(1)).alias("n_cells"))
    full = (spark.range(nx).select(F.col("id").cast("int").alias("gi")).withColumn("gj", F.explode(F.sequence(F.lit(0), F.lit(ny - 1)))))
    return full.join(t, ["gi", "gj"], "left").select(
        F.concat(F.lit("pseudo_"), F.col("gi").cast("string"), F.lit("_"), F.col("gj").cast("string")).alias("spot"), "gi", "gj",
        F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n_cells", F.lit(0)).cast("long").alias("n_cells"))


def grid_composition(cells: DataFrame, nx: int, ny: int, cell: str = "cell_id", label: str = "cell_type") -> DataFrame:
    """Label proportions and dominant label per non-empty grid spot."""
    g = fixed_grid(cells, nx, ny, cell).join(cells.select(cell, label), cell)
    c = g.groupBy("gi", "gj", label).agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy("gi", "gj").agg(F.sum("n").alias("n_cells"),
                                  F.min_by(label, F.struct((-F.col("n")).alias("k"), F.col(label).alias("t"))).alias("dominant"))
    return c.join(t, ["gi", "gj"]).withColumn("proportion", F.col("n") / F.col("n_cells"))


def regress_out_log_total(expr: DataFrame, cells: DataFrame, cell: str = "cell_id") -> DataFrame:
    """Per gene least-squares on log(total) over all cells: (gene, slope, intercept).

    Closed form from sums; zeros add nothing to sum(y) and sum(xy).
    """
    tot = expr.groupBy(cell).agg(F.log(F.sum("value")).alias("_lx"))
    xs = tot.agg(F.count(F.lit(1)).alias("_n"), F.sum("_lx").alias("_sx"), F.sum(F.col("_lx") * F.col("_lx")).alias("_sxx"))
    g = (expr.join(tot, cell).groupBy("gene").agg(F.sum("value").alias("_sy"), F.sum(F.col("value") * F.col("_lx")).alias("_sxy"))
         .crossJoin(F.broadcast(xs)))  # one row
    slope = (F.col("_n") * F.col("_sxy") - F.col("_sx") * F.col("_sy")) / (F.col("_n") * F.col("_sxx") - F.col("_sx") * F.col("_sx"))
    return g.withColumn("slope", slope).select("gene", "slope", ((F.col("_sy") - F.col("slope") * F.col("_sx")) / F.col("_n")).alias("intercept"))


def group_means(expr: DataFrame, cells: DataFrame, cell: str = "cell_id", label: str = "cell_type") -> DataFrame:
    """(group, gene, mean over all cells of the group); absent combinations are zero rows."""
    size = cells.groupBy(F.col(label).alias("group")).agg(F.count(F.lit(1)).alias("_n"))
    s = (expr.join(cells.select(cell, F.col(label).alias("group")), cell).groupBy("group", "gene").agg(F.sum("value").alias("_s")))
    # groups x genes: the output itself
    grid = size.crossJoin(expr.select("gene").distinct())
    return grid.join(s, ["group", "gene"], "left").select("group", "gene", (F.coalesce("_s", F.lit(0.0)) / F.col("_n")).alias("mean"))


def group_correlation(means: DataFrame) -> DataFrame:
    """Pearson correlation between group mean profiles; pairs of groups only."""
    b = means.select(F.col("group").alias("group_b"), "gene", F.col("mean").alias("_m"))
    return (means.join(b, "gene").groupBy(F.col("group").alias("group_a"), "group_b").agg(F.corr("mean", "_m").alias("corr")))


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Make names unique: second and later occurrences get '-1', '-2', …"""
    r = global_rank(df, [name, order], "_k", partition_by=[name])
    return r.withColumn(name, F.when(F.col("_k") > 1, F.concat(F.col(name), F.lit("-"), (F.col("_k") - 1).cast("string")))
                        .otherwise(F.col(name))).drop("_k")


def map_with_fallback(df: DataFrame, key: str, mapping: DataFrame, map_key: str, map_value: str, order: str) -> DataFrame:
    """Look ``key`` up (last duplicate wins); unmapped values stay as they are."""
    last = mapping.groupBy(F.col(map_key).alias(key)).agg(F.max_by(map_value, order).alias("_to"))
    return df.join(last, key, "left").withColumn("mapped", F.coalesce("_to", key)).drop("_to")


def resolve_column(df: DataFrame, candidates: Sequence[str], default=None) -> Column:
    """First existing column of ``candidates``, else a literal."""
    for c in candidates:
        if c in df.columns:
            return F.col(c)
    return F.lit(default)


def sanitise(df: DataFrame, strings: Mapping[str, str] | None = None) -> DataFrame:
    """Strings: NULL -> 'NA'; everything in ``strings`` is cast to string first."""
    for c in strings or {}:
        df = df.withColumn(c, F.col(c).cast("string"))
    return df.fillna("NA")


def de_all_groups(expr: DataFrame, cells: DataFrame, cell: str = "cell_id", label: str = "cell_type") -> DataFrame:
    """Every group against the rest in one pass: Welch t with two-sided p and BH-adjusted p per group, means, detection fractions, fold.

    Stored values are summed once per (group, gene); the rest of a group is the
    total less the group. Genes a group never shows have a row, as all groups x
    genes are the result. Groups of one cell, or with one cell outside, have null t and p.
    """
    v = F.col("value").cast("double")
    g = F.col(label).alias("group")
    per = (expr.join(cells.select(cell, g), cell).groupBy("group", "gene")
           .agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.sum((v > 0).cast("double")).alias("p")))
    total = per.groupBy("gene").agg(*[F.sum(c).alias(f"{c}_all") for c in "sqp"])
    size = cells.groupBy(g).agg(F.count(F.lit(1)).cast("double").alias("n1")).crossJoin(F.broadcast(cells.agg(F.count(F.lit(1)).cast("double").alias("n"))))  # one row
    j = size.crossJoin(total).join(per, ["group", "gene"], "left").fillna(0.0, ["s", "q", "p"]).withColumn("n0", F.col("n") - F.col("n1"))  # groups x genes: the table itself
    m1, m0 = F.col("s") / F.col("n1"), F.try_divide(F.col("s_all") - F.col("s"), F.col("n0"))
    spread = lambda q, s, m, n: F.try_divide(F.greatest(q - s * m, F.lit(0.0)), (n - 1) * n)
    v1 = spread(F.col("q"), F.col("s"), m1, F.col("n1"))
    v0 = spread(F.col("q_all") - F.col("q"), F.col("s_all") - F.col("s"), m0, F.col("n0"))
    stats = j.select("group", "gene", m1.alias("mean_in"), m0.alias("mean_out"), (F.col("p") / F.col("n1")).alias("frac_in"), F.try_divide(F.col("p_all") - F.col("p"), F.col("n0")).alias("frac_out"),
                     (m1 / (m0 + 1e-9)).alias("fold"), F.when(v1 + v0 > 0, (m1 - m0) / F.sqrt(v1 + v0)).when(v1 + v0 == 0, 0.0).alias("t"),
                     F.try_divide((v1 + v0) * (v1 + v0), v1 * v1 / (F.col("n1") - 1) + v0 * v0 / (F.col("n0") - 1)).alias("dof"))
    tested = stats.withColumn("p", F.when(F.col("t") == 0, 1.0).when(F.col("dof").isNotNull(), t_two_sided(F.col("t"), F.col("dof"))))
    return adjust(tested, "bh", by=("group",))


def marker_validation(expr: DataFrame, cells: DataFrame, markers: DataFrame, cell: str = "cell_id", label: str = "cell_type") -> DataFrame:
    """Per type over all its measured markers: n_cells, n_markers, mean over (cells x markers) inside and outside the type, fold."""
    measured = markers.join(expr.select("gene").distinct(), "gene", "left_semi")
    s = marker_stats(expr, cells, measured, cell, label)
    g = s.groupBy("cell_type").agg(F.first("n_cells").alias("n_cells"), F.count(F.lit(1)).alias("n_markers"), F.avg("mean_in").alias("mean_in"), F.avg("mean_out").alias("mean_out"))
    return g.withColumn("fold", F.col("mean_in") / (F.col("mean_out") + 1e-10))


def top_listed_markers(expr: DataFrame, cells: DataFrame, listed: DataFrame, n: int, cell: str = "cell_id", label: str = "cell_type") -> DataFrame:
    """Best ``n`` markers of each type by the mean of positive values in the type, among the first 2n of ``listed`` (cell_type, gene, place)."""
    first = top_per_group(listed, ["cell_type"], [F.asc("place"), F.asc("gene")], 2 * n)
    mine = (expr.where(F.col("value") > 0).join(cells.select(cell, F.col(label).alias("cell_type")), cell).join(first, ["cell_type", "gene"])
            .groupBy("cell_type", "gene").agg(F.round(F.avg("value"), 9).alias("pos_mean")))
    return top_per_group(mine, ["cell_type"], [F.desc("pos_mean"), F.asc("gene")], n, rank="rank")
