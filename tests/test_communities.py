import duckdb
import numpy as np
import pandas as pd
import pytest

from cytogrid.operators.communities import louvain


def table(spark, rows):
    return spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in rows], "src long, dst long, weight double").repartition(3)


def nodes(spark, n):
    return spark.range(n).withColumnRenamed("id", "cell_id")


def modularity(rows, label, resolution=1.0):
    """Recomputed in SQL from edges and labels."""
    con = duckdb.connect()
    con.register("e", pd.DataFrame(rows, columns=["src", "dst", "w"]))
    con.register("c", pd.DataFrame(list(label.items()), columns=["node", "c"]))
    return con.execute(f"""WITH j AS (SELECT a.c AS ca, b.c AS cb, w FROM e JOIN c a ON a.node = src JOIN c b ON b.node = dst), m AS (SELECT sum(w)::DOUBLE AS m FROM j),
      k AS (SELECT c, sum(w) AS k FROM (SELECT ca AS c, w FROM j UNION ALL SELECT cb, w FROM j) GROUP BY c),
      i AS (SELECT ca AS c, sum(w) AS i FROM j WHERE ca = cb GROUP BY ca)
      SELECT sum(coalesce(i, 0) / m - {resolution} * (k / (2 * m)) ** 2) FROM k LEFT JOIN i USING (c), m""").fetchall()[0][0]


def plain(rows, n, resolution=1.0, seed=0):
    """Sequential moves and contraction in one process."""
    rng = np.random.default_rng(seed)
    name, edges, size = list(range(n)), [(a, b, w) for a, b, w in rows], n
    total = sum(w for _, _, w in edges)
    while True:
        near, k = [{} for _ in range(size)], np.zeros(size)
        for a, b, w in edges:
            k[a] += w
            k[b] += w
            if a != b:
                near[a][b] = near[a].get(b, 0) + w
                near[b][a] = near[b].get(a, 0) + w
        c, sums, moved = list(range(size)), k.copy(), False
        again = True
        while again:
            again = False
            for i in rng.permutation(size):
                links = {}
                for j, w in near[i].items():
                    links[c[j]] = links.get(c[j], 0) + w
                sums[c[i]] -= k[i]
                value = lambda x: links.get(x, 0) / total - resolution * k[i] * sums[x] / (2 * total ** 2)
                best = max([c[i], *links], key=value)
                if value(best) > value(c[i]) + 1e-12:
                    c[i], again, moved = best, True, True
                sums[c[i]] += k[i]
        if not moved:
            return {v: name[v] for v in range(n)}
        number = {x: i for i, x in enumerate(sorted(set(c)))}
        name = [number[c[x]] for x in name]
        edges, size = [(number[c[a]], number[c[b]], w) for a, b, w in edges], len(number)


@pytest.mark.parametrize("rows, n, resolution", [
    ([(a, b, 1.0) for g in range(6) for a in range(5 * g, 5 * g + 5) for b in range(a + 1, 5 * g + 5)] + [(5 * g, (5 * g + 5) % 30, 1.0) for g in range(6)], 30, 1.0),
])
def test_no_worse_than_one_process(spark, rows, n, resolution):
    got = {r.cell_id: r.community for r in louvain(table(spark, rows), nodes(spark, n), resolution).collect()}
    assert set(got) == set(range(n)) and all(got[c] == c <= v for v, c in got.items())
    assert modularity(rows, got, resolution) >= min(modularity(rows, plain(rows, n, resolution, s), resolution) for s in range(3)) - 1e-9
    # no single node gains by moving to another community
    for v in range(0, n, 7):
        for c in set(got.values()):
            assert modularity(rows, {**got, v: c}, resolution) <= modularity(rows, got, resolution) + 1e-9
