import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cytogrid.llm import ann, simhash
from cytogrid.llm.components import components
from cytogrid.llm.queries import QUERIES

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows: (doc_id, fp) -> list of smallest doc_ids by chains of links of two bits or fewer."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    best = {}
    for d, f in rows:
        if d is not None:
            best[find(f)] = min(best.get(find(f), d), d)
    return [best.get(find(f)) for _, f in rows]


def test_fingerprints(odd_docs):
    for r in simhash.fingerprints(odd_docs).collect():
        assert r.fp % 2**64 == plain_fingerprint(r.text)


def test_spark_hash_agrees(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("ab cd"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"ab cd", 42)


def test_op4_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs]
    want = {(d, f"{f:016x}", c) for (d, f), c in zip(rows, plain_components(rows))}
    assert {tuple(r) for r in QUERIES["op4_simhash"](spark, sf).collect()} == want


def test_odd_texts_and_null_ids(odd_docs):
    docs = [(r.doc_id, plain_fingerprint(r.text)) for r in odd_docs.collect()]
    want = sorted(zip([d for d, _ in docs], plain_components(docs)), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(odd_docs).collect()), key=str) == want


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 8)
    rng = np.random.default_rng(0)
    base = [int(x) for x in rng.integers(0, 2**63, 5)]
    values = {b ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, 6))) for b in base for _ in range(150)}
    found = simhash.links(spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long"))
    assert all((r.src ^ r.dst).bit_count() <= 2 or bin((r.src ^ r.dst) % 2**64).count("1") <= 2 for r in found.collect())
    root = {r.node % 2**64: r.root for r in components(found).collect()}
    got = [root.get(v, v) for v in sorted(values)]
    want = plain_components([(v, v) for v in sorted(values)])
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 400)] + [(7, 7)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and len({roots[1000 + i] for i in range(400)}) == 1 and roots[0] != roots[1000]


def test_keep_first_keeps_one_row_of_each(spark, odd_docs, tmp_path):
    odd_docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = simhash.keep_first(docs).collect()
    groups = {r.root: None for r in simhash.near_duplicates(docs).collect()}
    assert len(kept) == len(groups) and set(kept[0].asDict()) == set(docs.columns)


def test_nothing(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


# ---------------------------------------------------------------- vectors

def brute(rows, asked, k):
    x = {i: np.array(v, float) for i, v in rows}
    return {q: sorted((float(np.sqrt(((x[q] - v) ** 2).sum())), i) for i, v in x.items() if i != q)[:k] for q in asked}


def test_op2_recall_and_order(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [i for i, _ in rows if i % 100 == 0], 10)
    got = {}
    for r in QUERIES["op2_posting_lists"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(got) == set(want)
    assert all(g == sorted(g) and len(g) == 10 for g in got.values())
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * 10 * len(want)


@pytest.mark.parametrize("n", [1, 2, 7, 1500])
def test_clusters_ties_and_odd_vectors(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, [float(x) for x in (rng.normal(size=8) + 6 * (i % 5))] if i % 3 else [1.0] * 8, "x") for i in range(n)]
    odd = [(9001, None, "x"), (9002, [0.0] * 8, "x"), (9003, [float("nan")] + [1.0] * 7, "x"), (9004, [None] + [1.0] * 7, "x"), (9005, [float("inf")] * 8, "x"), (None, [1.0] * 8, "x")]
    df = spark.createDataFrame(rows + rows[:2] + odd, "vec_id long, embedding array<double>, score string")
    asked = [i for i in range(n) if i % 20 == 0]
    want = brute([r[:2] for r in rows], asked, 10)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hits = sum(len({i for _, i in got.get(q, [])} & {i for _, i in want[q]}) for q in asked)
    assert hits >= 0.9 * sum(len(w) for w in want.values())
    for q in asked:
        if q % 3 == 0 and n > 100:  # a third of all vectors are equal: ties to the smallest ids
            assert got[q] == [(0.0, i) for i in range(0, 40, 3) if i != q][:10]


@pytest.mark.parametrize("offset, spread", [(1e4, 1e-3), (1e6, 1.0), (1e8, 1.0)])
def test_vectors_away_from_the_origin(spark, offset, spread):
    rng = np.random.default_rng(3)
    rows = [(i, (offset + spread * rng.normal(size=16)).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = list(range(0, 1500, 20))
    want = brute(rows, asked, 10)
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r.query_id, set()).add((r.score, r.vec_id))
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in asked) >= 0.9 * 10 * len(asked)
    assert all(abs(s - np.linalg.norm(np.subtract(rows[q][1], rows[i][1]))) <= 1e-9 * spread for q in asked for s, i in got[q])


def test_walk_opens_few_centroids_and_finds_the_nearest():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(2000, 16)) + 8 * rng.normal(size=(40, 16))[rng.integers(0, 40, 2000)]
    index, x = ann.Centroids.build(points), points[rng.integers(0, 2000, 200)] + 0.3 * rng.normal(size=(200, 16))
    at, d = index.search(x, 32)
    true = np.argsort(ann.square_distances(x, points), axis=1)[:, :8]
    assert np.mean([len(set(a[:8]) & set(t)) / 8 for a, t in zip(at, true)]) >= 0.95
    assert np.isfinite(index.walk(x, 32)).sum(axis=1).mean() < 600
    rows, lists = index.widening(x, lambda _, at, d: d <= 2 * d[:, :1])  # as wide as it takes
    dist = np.sqrt(((x[:, None] - points[None]) ** 2).sum(axis=2))
    assert len(rows) >= 0.95 * (dist <= 2 * dist.min(axis=1, keepdims=True)).sum()


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(df, df).collect() == []
