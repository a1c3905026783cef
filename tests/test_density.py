"""Density hierarchy against the definition on dense matrices, from the top down."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from surveyspark.operators import density as de


def spanning_tree(n, edges):
    root, out = list(range(n)), []

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for w, a, b in sorted(edges):
        x, y = top(a), top(b)
        if x != y:
            root[y] = x
            out.append((w, a, b))
    return out


def parts(nodes, edges):
    left, out = set(nodes), []
    while left:
        stack, own = [min(left)], set()
        while stack:
            x = stack.pop()
            if x not in own:
                own.add(x)
                stack += [b if a == x else a for _, a, b in edges if x in (a, b)]
        out.append(own)
        left -= own
    return out


def brute_clusters(n, edges, least, epsilon):
    """Labels by cutting the longest edges first (the last of equal ones), stability and excess of mass."""
    tree = [(max(w, de.SHORTEST), a, b) for w, a, b in spanning_tree(n, edges)]
    clusters = []  # parent, birth, [(density at which rows leave)], rows

    def grow(nodes, own, parent, birth):
        me = len(clusters)
        clusters.append([parent, birth, 0.0, set(nodes)])
        density = 0 if birth == np.inf else 1 / birth
        while True:
            if not own:
                break
            cut = max(own)
            own = [e for e in own if e != cut]
            halves = parts(nodes, own)
            large = [h for h in halves if len(h) >= least]
            if len(large) == 2:
                clusters[me][2] += len(nodes) * (1 / cut[0] - density)
                for h in sorted(large, key=min):
                    grow(h, [e for e in own if e[1] in h], me, cut[0])
                return
            kept = large[0] if large else set()
            clusters[me][2] += (len(nodes) - len(kept)) * (1 / cut[0] - density)
            nodes, own = kept, [e for e in own if e[1] in kept]
            if not kept:
                return

    tops = [p for p in parts(range(n), tree) if len(p) >= least]
    for p in tops:
        grow(p, [e for e in tree if e[1] in p], None, np.inf)
    alone = len(tops) == 1
    below = [[c for c, x in enumerate(clusters) if x[0] == k] for k in range(len(clusters))]

    def best(k):
        return max(clusters[k][2], sum(best(c) for c in below[k]))

    chosen = []

    def choose(k):
        whole = clusters[k][0] is None and alone
        if not whole and clusters[k][2] >= sum(best(c) for c in below[k]):
            chosen.append(k)
        else:
            for c in below[k]:
                choose(c)

    for k, c in enumerate(clusters):
        if c[0] is None:
            choose(k)
    up = set()
    for k in chosen:
        while clusters[k][1] < epsilon and clusters[k][0] is not None and not (alone and clusters[clusters[k][0]][0] is None):
            k = clusters[k][0]
        up.add(k)
    labels = [-1] * n
    for k in up:
        for x in clusters[k][3]:
            labels[x] = min(clusters[k][3])
    return labels


def reach(x, k, m):
    d = np.linalg.norm(x[:, None] - x, axis=2)
    order = [sorted((d[i, j], j) for j in range(len(x)) if j != i)[:k] for i in range(len(x))]
    core = [o[m - 1][0] for o in order]
    pairs = {tuple(sorted((i, j))) for i, o in enumerate(order) for _, j in o}
    pairs |= {(min(np.flatnonzero((x == x[i]).all(axis=1))), i) for i in range(len(x))}
    return [(max(d[a, b], core[a], core[b]), int(a), int(b)) for a, b in pairs if a != b]


def blobs(seed, copies=0):
    g = np.random.default_rng(seed)
    x = np.concatenate([c + g.normal(0, s, (m, 3)) for c, s, m in ((0, 0.1, 25), (1.2, 0.05, 14), (1.5, 0.05, 9), (5, 0.4, 20), (9, 0.01, 3))] + [g.uniform(-3, 12, (12, 3))])
    return np.concatenate([x, x[:copies]]) if copies else x


@pytest.mark.parametrize("k,m,least,epsilon,copies,chunk", [(200, 2, 2, 0.0, 0, 10**6), (200, 3, 5, 0.3, 0, 10**6), (6, 2, 2, 0.2, 9, 60), (5, 2, 4, 0.0, 0, 100)])
def test_density_clusters_against_definition(spark, k, m, least, epsilon, copies, chunk):
    x = blobs(1, copies)
    want = brute_clusters(len(x), reach(x, k, m), least, epsilon)
    df = spark.createDataFrame(pd.DataFrame({"id": range(len(x)), "v": x.tolist()})).withColumn("extra", F.lit("kept"))
    df = df.unionByName(spark.createDataFrame([(1000, None, "kept")], df.schema))
    got = de.density_clusters(df, "id", "v", k, m, least, epsilon, chunk=chunk).toPandas().set_index("id")
    assert got.loc[1000, "similar"] == -1 and set(got.columns) == {"v", "extra", "similar"}
    assert got["similar"].drop(1000).sort_index().tolist() == want
    assert len(set(want)) > 3


def test_few_rows_and_equal_rows(spark):
    def labels(vectors):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, v array<double>")
        return [r.similar for r in de.density_clusters(df, "id", "v").orderBy("id").collect()]

    assert labels([]) == [] and labels([[1.0]]) == [-1] and labels([[1.0], [2.0]]) == [-1, -1]
    assert labels([[1.0]] * 4 + [[3.0]] * 5 + [[9.0]]) == [0] * 4 + [4] * 5 + [-1]


def test_neighbours_in_many_leaves(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(900, 8))
    x[100:400] = x[100]  # more copies than a leaf holds
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    got = de.near_neighbours(rows, 5, leaf=64, trees=8).toPandas()
    assert (got.groupby("a").size() == 5).all() and (got["a"] != got["b"]).all()
    d = np.linalg.norm(x[got["a"]] - x[got["b"]], axis=1)
    assert np.allclose(d, got["d"])
    true = np.sort(np.linalg.norm(x[:, None] - x, axis=2), axis=1)[:, 5]
    far = got.groupby("a")["d"].max().to_numpy()
    assert (far >= true - 1e-9).all() and np.mean(far <= true * 1.001 + 1e-12) > 0.7


def test_leaves_write_the_vectors_once(spark, monkeypatch):
    """However many levels and trees there are, vectors are written with their rows alone."""
    g = np.random.default_rng(6)
    x = g.normal(size=(500, 4))
    x[50:350] = x[50]  # need more levels than halving all rows would
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, v array<double>")
    wide = []
    for name in ("cut_lineage", "settle"):
        monkeypatch.setattr(de, name, lambda df, f=getattr(de, name): (wide.append(df.count()) if "v" in df.columns else None, f(df))[1])
    got = de._leaves(rows, 4, 32, 3, 11).toPandas()
    assert wide == [500]
    assert sorted(zip(got["tree"], got["id"])) == [(t, i) for t in range(3) for i in range(500)]
    assert (np.stack(got["v"]) == x[got["id"]]).all()
    sizes = got.groupby(["tree", "cell"]).size()
    assert sizes.max() <= 32 and sizes[sizes > 8].sum() > 1000
