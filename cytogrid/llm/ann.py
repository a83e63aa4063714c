"""Approximate nearest neighbours with balanced posting lists.

Centroids come from a bounded sample by k-means with a penalty on full clusters.
Every vector is written to the list of its nearest centroid and, near a boundary,
to those of other centroids at nearly the same distance. Centroids are searched
by a walk of bounded width on an in-memory neighbour graph, which widens until
the farthest centroid found lies beyond all that the query reads; a query reads
the lists whose centroid lies within a ratio of its nearest one. The ratio is
measured on the sample. The nearest FIRST lists are read before the others: the
k-th distance in them bounds what the others return, and names the lists that
cannot be passed over where vectors lie close together.
Long lists are dealt out in parts, so identical vectors do not gather in a task.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from cytogrid.llm.common import durable

SAMPLE = 20_000
MOST_LISTS = 2_048
PER_LIST = 200
PART = 512
REPLICAS = 4
BOUNDARY = 1.05
DEGREE = 16
RECALL = 0.97
FIRST = 8
SLACK = 1.02
WIDTH = 32


def bounded_distances(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by the expanded square about the mean of ``b``, and for each row of ``a`` a bound of their rounding error."""
    middle = b.mean(axis=0) if len(b) else 0.0
    a, b = a - middle, b - middle
    left, right = (a * a).sum(axis=1), (b * b).sum(axis=1)
    error = 8 * (a.shape[1] + 4) * np.finfo(np.float64).eps * (left + right.max(initial=0.0))
    return np.maximum(left[:, None] + right[None] - 2 * a @ b.T, 0.0), error


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return bounded_distances(a, b)[0]


def balanced_centroids(x: np.ndarray, n: int, rounds: int = 10, penalty: float = 0.2) -> np.ndarray:
    """k-means where a cluster above the mean size looks farther away."""
    rng = np.random.default_rng(5)
    c = x[rng.permutation(len(x))[:n]].copy()
    load = np.ones(len(c))
    for _ in range(rounds):
        total, count = np.zeros_like(c), np.zeros(len(c))
        for i in range(0, len(x), 4096):
            part = x[i:i + 4096]
            own = (square_distances(part, c) * (1 + penalty * np.maximum(load - 1, 0))).argmin(axis=1)
            np.add.at(total, own, part)
            count += np.bincount(own, minlength=len(c))
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        load = count * len(c) / len(x)
    return c


@dataclass
class Centroids:
    """Centroids, the neighbours of each, and the ratio within which a query reads lists."""
    points: np.ndarray
    graph: np.ndarray
    ratio: float = 1.0

    @classmethod
    def build(cls, points: np.ndarray) -> "Centroids":
        n = len(points)
        near = square_distances(points, points)
        np.fill_diagonal(near, np.inf)
        close = np.argsort(near, axis=1)[:, :min(DEGREE, n - 1)]
        far = np.random.default_rng(6).integers(0, n, (n, 4))  # long edges keep the graph in one piece
        ring = (np.arange(n)[:, None] + 1) % n
        return cls(points, np.concatenate([close, far, ring], axis=1).astype(np.int32))

    def walk(self, x: np.ndarray, width: int) -> np.ndarray:
        """Squared distance of each row to the centroids that its walk looked at, infinite for the others.

        All rows walk together: each step opens every row's nearest unopened
        candidate and looks at its neighbours, until no row has one left that is
        nearer than the ``width``-th found.
        """
        m, n = len(x), len(self.points)
        rows = np.arange(m)
        start = np.linspace(0, n - 1, min(n, 8)).astype(np.int64)
        seen = np.zeros((m, n), bool)
        opened = np.zeros((m, n), bool)
        dist = np.full((m, n), np.inf)
        seen[:, start] = True
        dist[:, start] = square_distances(x, self.points[start])
        worst = np.full(m, np.inf)
        for step in range(n):
            waiting = np.where(opened, np.inf, dist)
            at = waiting.argmin(axis=1)
            live = np.flatnonzero(waiting[rows, at] < worst)
            if not len(live):
                break
            opened[live, at[live]] = True
            near = self.graph[at[live]]
            who = np.repeat(live, near.shape[1])
            near = near.reshape(-1)
            new = ~seen[who, near]
            who, near = who[new], near[new]
            seen[who, near] = True
            dist[who, near] = ((x[who] - self.points[near]) ** 2).sum(axis=1)
            if step % 8 == 7:
                worst = np.partition(dist, width - 1, axis=1)[:, width - 1]
        return dist

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Nearest ``width`` centroids found for each row, nearest first: their numbers and distances (not found: -1 and infinite)."""
        width = min(width, len(self.points))
        dist = self.walk(x, width)
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        found = np.take_along_axis(dist, order, axis=1)
        return np.where(np.isfinite(found), order, -1), np.sqrt(found)

    def widening(self, x: np.ndarray, wanted: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and centroids that ``wanted`` picks: it takes rows, numbers and distances, nearest first, and gives a mask that starts with
        True and ends with False. Rows whose last centroid found is wanted are searched again, four times as wide."""
        todo, width, picked = np.arange(len(x)), min(WIDTH, len(self.points)), []
        while len(todo):
            at, d = self.search(x[todo], width)
            mask = wanted(todo, at, d) & (at >= 0)
            more = mask[:, -1] & (width < len(self.points))
            row, col = np.nonzero(mask & ~more[:, None])
            picked.append((todo[row], at[row, col]))
            todo, width = todo[more], min(4 * width, len(self.points))
        rows, lists = (np.concatenate(c) for c in zip(*picked)) if picked else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return rows, lists

    def lists(self, x: np.ndarray) -> list[np.ndarray]:
        """Lists that each vector is written to: its nearest, and up to REPLICAS - 1 more within BOUNDARY of that distance."""
        at, d = self.search(x, REPLICAS)
        return [a[(a >= 0) & (r <= BOUNDARY * r[0] + 1e-12)] for a, r in zip(at, d)]


def calibrate(index: Centroids, x: np.ndarray, k: int, queries: int = 256) -> float:
    """Ratio at which the lists within it hold all but one of ten true neighbours for a share RECALL of the sample's queries, times SLACK.

    Counting by query keeps a small group of hard queries from drowning in easy ones.
    """
    q = x[:queries]
    true = square_distances(q, x)
    true[np.arange(len(q)), np.arange(len(q))] = np.inf
    near = np.argsort(true, axis=1)[:, :min(k, max(len(x) - 1, 0))]
    to = np.sqrt(square_distances(q, index.points))
    ratio = to / np.maximum(to.min(axis=1, keepdims=True), 1e-12)
    written = index.lists(x)
    need = [np.quantile([ratio[i, written[j]].min() for j in near[i]], 0.9, method="higher") for i in range(len(q)) if near.shape[1]]
    return float(np.quantile(need, RECALL) * SLACK) if need else 1.0


def valid_vectors(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id and vector as doubles, without null, zero or non-finite ones and without null ids; of several dimensions the most frequent stays."""
    v = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    fine = v.where("vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    return fine


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def fit(valid: DataFrame, k: int) -> Centroids | None:
    """Index on at most SAMPLE vectors, picked by a hash of their ids; None without vectors."""
    n = valid.count()
    if not n:
        return None
    share = min(1.0, SAMPLE / n)
    some = valid.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    if not some.num_rows:
        some = valid.orderBy("vec_id").limit(1000).select("v").toArrow()
    x = matrix(some.column("v").combine_chunks())
    index = Centroids.build(balanced_centroids(x, max(1, min(MOST_LISTS, n // PER_LIST, len(x)))))
    index.ratio = calibrate(index, x, k)
    return index


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's ``k`` nearest vectors found, by Euclidean distance in doubles, ties to the smaller vec_id.

    A vector is no neighbour of the query with its own id. Rows repeated under
    one id count once. Null, zero and non-finite vectors take no part on either side.
    """
    spark = vectors.sparkSession
    valid = valid_vectors(vectors, vec_id, vector)
    sizes = {r["n"]: r["count"] for r in valid.groupBy(F.size("v").alias("n")).count().collect()}
    dim = max(sizes, key=lambda n: (sizes[n], n), default=0)
    valid = durable(valid.where(F.size("v") == dim))
    asked = valid_vectors(queries, vec_id, vector).where(F.size("v") == dim)
    index = fit(valid, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # the index travels with the functions: at most MOST_LISTS centroids

    def post(batches):
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                written = index.lists(matrix(part.column("v")))
                row = np.repeat(np.arange(part.num_rows), [len(w) for w in written])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(written).astype(np.int32)), *[part.column(c).take(pa.array(row)) for c in ("vec_id", "v")]], names=["list", "vec_id", "v"])

    postings = durable(valid.mapInArrow(post, "list int, vec_id long, v array<double>"))
    counts = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}  # one row for each list
    length = np.array([counts.get(i, 0) for i in range(len(index.points))])
    parts = np.maximum(1, -(-length // PART))
    ratio = index.ratio

    half = len(length) // 2

    def probe(near: bool):
        def run(batches):
            for b in batches:
                for i in range(0, b.num_rows, 512):
                    part = b.slice(i, 512)
                    x, bound = matrix(part.column("v")), part.column("bound").to_numpy()

                    def first(rows, at, d):  # these lists, and as many as hold enough vectors
                        mask = np.cumsum(np.where(at >= 0, length[at], 0), axis=1) - length[at] < 4 * (k + 1)
                        mask[:, :FIRST] = True
                        return mask

                    def within(rows, at, d):
                        # a neighbour within the bound is in a list at most twice the bound farther than the nearest; where half of all lists are, the ratio alone decides
                        limit = d[:, 0] + 2 * bound[rows]
                        many = d[:, half] <= limit if d.shape[1] > half else np.zeros(len(d), bool)
                        return d <= (np.maximum(ratio * d[:, 0], np.where(many, 0.0, limit)) + 1e-12)[:, None]

                    row, lists = index.widening(x, first)
                    if not near:
                        read = row * len(length) + lists
                        row, lists = index.widening(x, within)
                        new = ~np.isin(row * len(length) + lists, read)
                        row, lists = row[new], lists[new]
                    times = parts[lists]
                    piece = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row = pa.array(np.repeat(row, times))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(lists, times).astype(np.int32)), pa.array(piece.astype(np.int32)),
                                                      *[part.column(c).take(row) for c in ("vec_id", "v", "bound")]], names=["list", "part", "vec_id", "v", "bound"])
        return run

    of_list = F.element_at(F.array(*[F.lit(int(p)) for p in parts]), F.col("list") + 1)
    dealt = postings.withColumn("part", F.pmod(F.xxhash64("vec_id"), of_list).cast("int"))
    def compare(ask: pa.Table, base: pa.Table) -> pa.Table:
        out = []
        if ask.num_rows and base.num_rows:
            ids = base.column("vec_id").to_numpy()
            x = matrix(base.column("v").combine_chunks())
            q_ids = ask.column("vec_id").to_numpy()
            qs = matrix(ask.column("v").combine_chunks())
            bounds = ask.column("bound").to_numpy()
            for i in range(0, len(qs), 256):
                q = qs[i:i + 256]
                rough, error = bounded_distances(q, x)
                rough[q_ids[i:i + 256, None] == ids[None]] = np.inf
                last = np.partition(rough, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
                most = np.minimum(last, bounds[i:i + 256] ** 2)
                row, col = np.nonzero((rough <= (most * (1 + 1e-12) + 2 * error)[:, None]) & np.isfinite(rough))
                score = np.sqrt(((q[row] - x[col]) ** 2).sum(axis=1))
                within = score <= bounds[i + row]
                row, col, score = row[within], col[within], score[within]
                order = np.lexsort((ids[col], score, row))
                row, col, score = row[order], col[order], score[order]
                first = np.searchsorted(row, row)
                keep = np.arange(len(row)) - first < k
                out.append((q_ids[i + row[keep]], ids[col[keep]], score[keep]))
        done = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(c) for c in done], names=["query_id", "vec_id", "score"])

    def read(asking: DataFrame, near: bool) -> DataFrame:
        probes = asking.select("vec_id", "v", "bound").mapInArrow(probe(near), "list int, part int, vec_id long, v array<double>, bound double")
        return probes.groupBy("list", "part").cogroup(dealt.groupBy("list", "part")).applyInArrow(compare, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        one = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return one.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)

    endless = F.lit(float("inf"))
    first = durable(best(read(asked.withColumn("bound", endless), True)))
    bounds = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) == k, F.max("score")).alias("kth"))
    rest = read(asked.join(bounds, "vec_id", "left").withColumn("bound", F.coalesce("kth", endless)), False)
    return best(first.drop("rank").union(rest)).select("query_id", "rank", "vec_id", "score")
