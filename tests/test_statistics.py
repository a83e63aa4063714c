import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytogrid.functions import special as SP
from cytogrid.operators import autocorrelation as A, communication as C, enrichment as E, expression as X, graph as G, multitest as MT, niches as N, summaries as U, validation as V
from cytogrid.operators.ordering import OrderedBlocks, exact_quantiles, global_rank, value_ranks


def test_ordered_blocks_against_pandas(spark):
    g = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": np.arange(3000), "g": np.where(g.uniform(size=3000) < 0.7, "hot", g.choice(list("abc"), 3000)), "v": g.integers(0, 20, 3000)})
    df = spark.createDataFrame(pdf).repartition(13)
    got = OrderedBlocks(df, ["v", "id"], ["g"]).row_number("r", "n").running("s", "sum", "v").running("m", "max", "id").df.toPandas().sort_values(["g", "v", "id"]).reset_index(drop=True)
    want = pdf.sort_values(["g", "v", "id"]).reset_index(drop=True)
    assert (got.r == want.groupby("g").cumcount() + 1).all()
    assert (got.n == want.groupby("g").id.transform("size")).all()
    assert (got.s == want.groupby("g").v.cumsum()).all()
    assert (got.m == want.groupby("g").id.cummax()).all()
    assert (got._block if "_block" in got else 0) == 0


def test_global_rank_one_hot_value(spark):
    df = spark.range(5000).select("id", F.lit(1.0).alias("v"))
    r = global_rank(df, [F.desc("v"), F.asc("id")], "rank").toPandas()
    assert (r.sort_values("id")["rank"].to_numpy() == np.arange(1, 5001)).all()


def test_exact_quantiles(spark):
    g = np.random.default_rng(1)
    v = np.concatenate([np.zeros(400), g.normal(size=777), [np.nan]])
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    q = exact_quantiles(df, "v", {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.985, "e": 1.0}).first()
    assert np.allclose(list(q), np.nanquantile(v, [0, 0.25, 0.5, 0.985, 1]))


def padj(spark, method, clip=True, p=(0.01, 0.04, 0.03, 0.005)):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "gene long, p double")
    return [r.p_adj for r in MT.adjust(df, method, clip=clip).orderBy("gene").collect()]


def test_bh_and_holm_step(spark):
    assert np.allclose(padj(spark, "bh"), [0.02, 0.04, 0.04, 0.02])
    assert np.allclose(padj(spark, "holm_step", clip=False), [0.03, 0.04, 0.06, 0.02])
    assert np.allclose(padj(spark, "bonferroni", clip=False), [0.04, 0.16, 0.12, 0.02])
    assert np.allclose(padj(spark, "by"), np.minimum(np.array([0.02, 0.04, 0.04, 0.02]) * (1 + 1 / 2 + 1 / 3 + 1 / 4), 1))
    assert np.allclose(padj(spark, "holm_sidak"), [1 - 0.99 ** 3, 1 - 0.97 ** 2, 1 - 0.97 ** 2, 1 - 0.995 ** 4])
    assert np.allclose(padj(spark, "qvalue"), [0.02, 0.04, 0.04, 0.02])


def test_special_functions(spark):
    df = spark.createDataFrame([(3.84146, 1.0), (18.307, 10.0), (0.0, 3.0), (500.0, 2.0)], "x double, k double")
    p = [r[0] for r in df.select(SP.chi2_sf(F.col("x"), F.col("k"))).collect()]
    assert np.allclose(p[:3], [0.05, 0.05, 1.0], atol=1e-4) and p[3] < 1e-100
    t = spark.createDataFrame([(2.228139, 10.0), (0.0, 5.0), (-12.706205, 1.0)], "t double, k double")
    assert np.allclose([r[0] for r in t.select(SP.t_two_sided(F.col("t"), F.col("k"))).collect()], [0.05, 1.0, 0.05], atol=1e-6)
    z = spark.createDataFrame([(v,) for v in (-3.0, -0.5, 0.0, 1.96, 4.0)], "z double")
    got = [r[0] for r in z.select(SP.normal_sf(F.col("z"))).collect()]
    assert np.allclose(got, [0.5 * math.erfc(v / math.sqrt(2)) for v in (-3.0, -0.5, 0.0, 1.96, 4.0)], atol=2e-7)
    g = [r[0] for r in spark.createDataFrame([(v,) for v in (0.5, 1.0, 7.3, 150.0)], "x double").select(SP.lgamma(F.col("x"))).collect()]
    assert np.allclose(g, [math.lgamma(v) for v in (0.5, 1.0, 7.3, 150.0)])


def test_parse_overlap(spark):
    df = spark.createDataFrame([("3/5",), ("x",), ("1/0",), (None,), ("1/2/3",), ("/",)], "t string")
    assert [r[0] for r in df.select(SP.parse_overlap(F.col("t"))).collect()] == [0.6, 0, 0, 0, 0, 0]


def long(spark, m):
    """Dense matrix -> sparse (cell_id, gene, value) and cells."""
    i, j = np.nonzero(m)
    e = spark.createDataFrame(pd.DataFrame({"cell_id": i, "gene": [f"g{q}" for q in j], "value": m[i, j].astype(float)}))
    return e, spark.range(m.shape[0]).withColumnRenamed("id", "cell_id")


def weights(spark, w):
    i, j = np.nonzero(w)
    return spark.createDataFrame(pd.DataFrame({"src": i, "dst": j, "weight": w[i, j].astype(float)}))


def test_moran_line(spark):
    e, c = long(spark, np.array([[1], [2], [3], [4]]))
    w = np.zeros((4, 4))
    for a in range(3):
        w[a, a + 1] = w[a + 1, a] = 1
    r = A.moran_geary(e, c, weights(spark, w)).first()
    assert abs(r.moran_i - 1 / 3) < 1e-12 and abs(r.geary_c - 0.4) < 1e-12


@pytest.fixture(scope="module")
def counts():
    g = np.random.default_rng(5)
    m = g.poisson(0.7, (60, 6))
    w = (g.uniform(size=(60, 60)) < 0.08).astype(float)
    np.fill_diagonal(w, 0)
    return m, w


def test_moran_asymmetric_sparse(spark, counts):
    m, w = counts
    e, c = long(spark, m)
    got = {r.gene: r for r in A.moran_geary(e, c, weights(spark, w)).collect()}
    for k in range(m.shape[1]):
        x = m[:, k].astype(float)
        z = x - x.mean()
        assert abs(got[f"g{k}"].moran_i - 60 / w.sum() * (w * np.outer(z, z)).sum() / (z @ z)) < 1e-10
        assert abs(got[f"g{k}"].geary_c - 60 / (2 * w.sum()) * (w * (x[:, None] - x[None]) ** 2).sum() / (z @ z)) < 1e-10


def test_coexpression_matches_dense(spark, counts):
    m, w = counts
    e, c = long(spark, m)
    X_ = m - m.mean(0)
    cov = X_.T @ w @ X_
    for r in A.coexpression(e, c, weights(spark, w)).collect():
        a, b = int(r.gene_a[1:]), int(r.gene_b[1:])
        d = cov[a, a] * cov[b, b]
        assert (r.cor is None) if d <= 0 else abs(r.cor - cov[a, b] / math.sqrt(d)) < 1e-9


def test_entropy_matches_dense(spark, counts):
    m, w = counts
    e, c = long(spark, m)
    got = {r.gene: r for r in A.neighbour_entropy_test(e, c, weights(spark, w)).collect()}
    i, j = np.nonzero(w)
    for k in range(m.shape[1]):
        x = m[:, k]
        ex = np.zeros(x.max() + 1)
        for a in x:
            for b in x:
                ex[abs(a - b)] += 1 / 3600
        ob = np.bincount(abs(x[i] - x[j]), minlength=len(ex)) / len(i)
        pos = ob > 0
        assert abs(got[f"g{k}"].ent - (ob[pos] * np.log(ob[pos] / ex[pos])).sum()) < 1e-10
        assert got[f"g{k}"].df == (ex > 1 / 60).sum() - 1


def test_pmf_of_differences(spark):
    p = spark.createDataFrame([("g", 0, 0.5), ("g", 1, 0.5)], "gene string, value long, prob double")
    assert {r.value: r.prob for r in A.abs_difference_pmf(p).collect()} == {0: 0.5, 1: 0.5}


def test_low_pass_matches_dense(spark):
    g = np.random.default_rng(3)
    n = 25
    a = np.triu(g.uniform(size=(n, n)) < 0.2, 1)
    e = spark.createDataFrame([(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(a))], "src long, dst long, weight double")
    m = g.poisson(1.0, (n, 3)).astype(float)
    x, cells = long(spark, m)
    s = (a | a.T).astype(float)
    d = np.where(s.sum(1) > 0, s.sum(1), 1)
    lap = np.eye(n) - s / np.sqrt(np.outer(d, d))
    want = np.clip(np.linalg.solve(np.eye(n) + 0.7 * lap, m), 0, None)
    got = A.low_pass(x, G.laplacian(e, cells, normalized=True).persist(), 0.7, order=12).toPandas()
    dense = np.zeros_like(m)
    dense[got.cell_id, [int(q[1:]) for q in got.gene]] = got.value
    assert np.allclose(dense, want, atol=1e-5)


def test_low_pass_by_tiles_matches_joins(spark, monkeypatch):
    from cytogrid.operators import spatial as S
    g = np.random.default_rng(4)
    n = 160
    m = g.poisson(0.7, (n, 3)).astype(float)
    x, _ = long(spark, m)
    xy = np.column_stack([g.uniform(0, 6, n), g.uniform(-40, 40, n)])
    xy[5] = xy[4]
    cells = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "cell_id long, x double, y double")
    e = S.radius_pairs(cells, 1.5).withColumn("weight", F.lit(1.0))
    want = {(r.cell_id, r.gene): r.value for r in A.low_pass(x, G.laplacian(e, cells, normalized=True).persist(), 1.0, order=3).collect() if r.value > 0}
    joined, low_pass = [], A.low_pass
    monkeypatch.setattr(A, "low_pass", lambda *a: (joined.append(1), low_pass(*a))[1])
    for rows in (40, 4):  # several tiles; too full for tiles
        monkeypatch.setattr(A, "with_margin", lambda *a: S.with_margin(*a, rows=rows))
        got = {(r.cell_id, r.gene): r.value for r in A.radius_low_pass(x, cells, 1.5, 1.0, order=3).collect()}
        assert all(abs(got.get(k, 0) - want.get(k, 0)) < 1e-12 for k in got.keys() | want.keys())
        assert len(joined) == (rows == 4)


def test_type_flow_by_tiles_matches_joins(spark, monkeypatch):
    from cytogrid.operators import spatial as S
    g = np.random.default_rng(6)
    n = 150
    x, _ = long(spark, g.poisson(0.8, (n, 4)).astype(float))
    xy = np.column_stack([g.uniform(0, 5, n), g.uniform(-70, 70, n)])
    cells = spark.createDataFrame([(i, float(a), float(b), None if i % 7 == 0 else "ab"[i % 2]) for i, (a, b) in enumerate(xy)], "cell_id long, x double, y double, cell_type string")
    lr = spark.createDataFrame([("g0", "g1"), ("g1", "g1"), ("g2", "g0"), ("g2", "g0"), ("g3", "none")], "ligand string, receptor string")
    lr = lr.join(x.select("gene").distinct(), lr.ligand == F.col("gene"), "left_semi")
    weights = C.directed(S.radius_pairs(cells, 1.5).withColumn("weight", F.lit(1.0)))
    want = {tuple(r) for r in C.type_flow(x, lr, weights, cells, min_ints=3).collect()}
    joined, flow = [], C.type_flow
    monkeypatch.setattr(C, "type_flow", lambda *a: (joined.append(1), flow(*a))[1])
    for rows in (40, 1):  # several tiles; too full for tiles
        monkeypatch.setattr(C, "with_margin", lambda *a, **k: S.with_margin(*a, rows=rows, **k))
        assert {tuple(r) for r in C.radius_type_flow(x, lr, cells, 1.5, min_ints=3).collect()} == want
        assert len(joined) == (rows == 1)
    assert len(want) > 10


def test_enrichment_moments_match_all_permutations(spark):
    pairs = [(0, 1), (1, 2), (2, 3), (0, 3), (1, 4), (4, 5)]
    labels = list("aaabbc")
    e = spark.createDataFrame(pairs, "src long, dst long")
    c = spark.createDataFrame(list(enumerate(labels)), "cell_id long, cell_type string")
    seen = {}
    for perm in set(itertools.permutations(labels)):
        cnt = {}
        for i, j in pairs:
            for p in ((perm[i], perm[j]), (perm[j], perm[i])):
                cnt[p] = cnt.get(p, 0) + 1
        for p in itertools.product("abc", repeat=2):
            seen.setdefault(p, []).append(cnt.get(p, 0))
    for r in A.nhood_enrichment(e, c).collect():
        v = np.array(seen[(r.type_a, r.type_b)], float)
        assert abs(r.expected - v.mean()) < 1e-9
        if v.std() > 0:
            assert abs(r.z - (r.n - v.mean()) / v.std()) < 1e-9


def test_type_pair_moments_match_all_permutations(spark):
    m = np.array([[1, 0], [2, 1], [0, 3], [4, 1], [1, 1], [0, 2]])
    labels = list("aabbbb")
    x, c = long(spark, m)
    c = spark.createDataFrame(list(enumerate(labels)), "cell_id long, cell_type string")
    lr = spark.createDataFrame([("g0", "g1")], "ligand string, receptor string")
    perms = list(set(itertools.permutations(labels)))
    for r in C.type_pair_means(x, lr, c, min_prop=0.0).collect():
        v = [(m[[q == r.src_type for q in p], 0].mean() + m[[q == r.dst_type for q in p], 1].mean()) / 2 for p in perms]
        assert abs(r.z - (r.score - np.mean(v)) / np.std(v)) < 1e-9


def test_rank_sum_matches_pandas(spark, counts):
    m, _ = counts
    x, cells = long(spark, m)
    flag = cells.select("cell_id", (F.col("cell_id") < 20).alias("inn"))
    sizes = x.select("gene").distinct().crossJoin(X.group_sizes(flag, F.col("inn")))
    got = {r.gene: r for r in MT.rank_sum(x.join(flag, "cell_id"), "value", "inn", sizes).collect()}
    for k in range(m.shape[1]):
        ranks = pd.Series(m[:, k]).rank()
        assert got[f"g{k}"].rank_sum == ranks[:20].sum()


def test_hypergeometric(spark):
    c = spark.createDataFrame([("t", 3, 5, 4, 20)], "term string, k long, m long, hits long, universe long")
    want = sum(math.comb(5, i) * math.comb(15, 4 - i) for i in (3, 4)) / math.comb(20, 4)
    assert abs(E.hypergeometric_tail(c).first().p - want) < 1e-9


def test_consensus_vote(spark):
    rows = [(0, 0.0, 0.0, "B", 0.2), (1, 1.0, 0.0, "A", 0.9), (2, 0.0, 1.1, "A", 0.9), (3, -1.2, 0.0, "B", 0.05)]
    c = spark.createDataFrame(rows, "cell_id long, x double, y double, cell_type string, conf double")
    r = {q.cell_id: q for q in N.consensus_relabel(c, 0.5, 3, 0.6).collect()}
    assert (r[0].refined, r[0].method) == ("A", "neighborhood") and abs(r[0].consensus - 1.8 / 1.9) < 1e-9
    assert r[1].refined == "A" and r[1].consensus == 0.0


def test_silhouette_closed_form(spark):
    g = np.random.default_rng(2)
    xy, lab = g.normal(size=(40, 2)), g.integers(0, 3, 40)
    p = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(40), "x": xy[:, 0], "y": xy[:, 1], "cell_type": lab}))
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    for r in V.silhouette(p).collect():
        i = r.cell_id
        own = (lab == lab[i]) & (np.arange(40) != i)
        a, b = d2[i, own].mean(), min(d2[i, lab == q].mean() for q in set(lab) - {lab[i]})
        assert abs(r.s - (b - a) / max(a, b)) < 1e-9


def test_set_votes(spark):
    s = spark.createDataFrame([(m, q) for m, gs in {"a": "xyz", "b": "xy", "c": "xw", "d": "x"}.items() for q in gs], "method string, gene string")
    assert [r.gene for r in U.consensus(s).collect()] == ["x"]
    assert {r.gene: r.votes for r in U.set_votes(s).collect()} == {"x": 4, "y": 2, "z": 1, "w": 1}


def test_offsets_and_elbow(spark):
    d = spark.createDataFrame([(0, 1), (0, 3), (1, 2), (2, 1)], "patch int, label int")
    assert sorted((r.patch, r.label, r.global_id) for r in U.offset_ids(d, "patch", "label").collect()) == [(0, 1, 1), (0, 3, 3), (1, 2, 5), (2, 1, 6)]
    curve = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 10, 4, 2, 1.5, 1.2, 1.0])], "k int, v double")
    assert U.elbow(curve, "k", "v").first().elbow == 3


def test_normalisation_divides_by_all_cells(spark, counts):
    m, _ = counts
    x, c = long(spark, m)
    n = c.agg(F.count("*").alias("n"))
    for r in X.gene_moments(x, n).collect():
        v = m[:, int(r.gene[1:])]
        assert abs(r.mean - v.mean()) < 1e-12 and abs(r.var_samp - v.var(ddof=1)) < 1e-10


def test_require_members_fails_on_unknown(spark):
    a = spark.createDataFrame([("x",), ("q",)], "gene string")
    with pytest.raises(Exception, match="unknown gene"):
        E.require_members(a, spark.createDataFrame([("x",)], "gene string")).collect()


def test_adjusted_bootstraps_far_in_the_tail_match_the_sql(spark, tmp_path):
    import duckdb
    from cytogrid.plans.catalog import ORACLE, QUERIES
    rows = [(20 * g + b, g, far if b == 0 else 1.0 + b % 2) for g, far in enumerate((1.4, 3.0, 4.6, 5.2, 40.0)) for b in range(20)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = QUERIES["bootstrap_adjusted"](spark, str(tmp_path))
    want = con.sql(f"select {', '.join(got.columns)} from ({ORACLE['bootstrap_adjusted']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and float("inf") in [r[3] for r in want]
