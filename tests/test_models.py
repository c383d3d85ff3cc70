"""Exact neighbours, Ward's method and trees against brute force, at sizes where several blocks, rounds and ranges are needed."""

import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.operators import classify, cluster, neighbours, segmentation, trees


def points(spark, v, w=None, asks=None):
    w, asks = np.ones(len(v)) if w is None else w, np.ones(len(v), bool) if asks is None else asks
    rows = [(int(i) * 7 - 50, [float(x) for x in r], float(w[i]), bool(asks[i])) for i, r in enumerate(v)]
    return spark.createDataFrame(rows, "id long, v array<double>, w double, asks boolean")


def brute(v, k, w=None, asks=None):
    d = neighbours.squared(v, v)
    if w is not None:
        d = d * neighbours.factor(w[:, None], w[None])
    np.fill_diagonal(d, np.inf)
    out = {}
    for i in range(len(v)):
        if asks is None or asks[i]:
            order = np.lexsort((np.arange(len(v)), d[i]))[: min(k, len(v) - 1)]
            out[i * 7 - 50] = [(int(j) * 7 - 50, d[i, j]) for j in order]
    return out


def got(df):
    out, computed = {}, 0
    for r in df.collect():
        computed += r["computed"]
        if r["id"] is not None:
            out.setdefault(r["id"], {})[r["rank"]] = (r["other"], r["cost"])
    return {i: [x[j] for j in range(len(x))] for i, x in out.items()}, computed


@pytest.mark.parametrize("weighted", [False, True])
@pytest.mark.parametrize("per_cell,most", [(64, 8192), (5, 40), (20, 30)])
def test_nearest_is_exact(spark, per_cell, most, weighted):
    rng = np.random.default_rng(3)
    v = np.vstack([rng.normal(size=(150, 4)) * 0.01 + rng.normal(size=4) * 10, rng.integers(0, 3, (120, 4)), rng.normal(size=(30, 4)) * 1e5, np.ones((3, 4)) * 0.5])  # a tight group, ties, far rows, copies
    w, asks = rng.integers(1, 50, len(v)).astype(float), rng.random(len(v)) < 0.7
    k = 1 if weighted else 3
    found, computed = got(neighbours.nearest(points(spark, v, w, asks), 4, k, weighted, per_cell, most))
    assert found == brute(v, k, w if weighted else None, asks) and computed > 0


def test_nearest_of_few_and_of_what_is_no_number(spark):
    assert got(neighbours.nearest(points(spark, np.empty((0, 2))), 2, 3))[0] == {}
    assert got(neighbours.nearest(points(spark, np.ones((1, 2))), 2, 3))[0] == {}
    v = np.random.default_rng(4).normal(size=(60, 2))
    v[5, 0], v[6, 1] = np.nan, np.inf
    found, _ = got(neighbours.nearest(points(spark, v), 2, 2, False, 5, 12))
    assert found == brute(v, 2)


def test_clustered_rows_compute_few_distances(spark):
    rng = np.random.default_rng(8)
    v = (rng.normal(size=(60, 8)) * 20)[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 8))
    found, computed = got(neighbours.nearest(points(spark, v), 8, 3, most=1500))
    assert computed < 0.1 * len(v) ** 2
    d = neighbours.squared(v[:50], v)
    assert all([x[0] for x in found[i * 7 - 50]] == (np.argsort(d[i])[1:4] * 7 - 50).tolist() for i in range(50))


def same(a, b):
    """Whether two labellings are the same up to names."""
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_ward_by_rounds_is_ward(spark):
    rng = np.random.default_rng(6)
    for n, k, few in ((200, 10, 60), (16, 4, 1), (40, 3, 512), (5, 9, 1)):
        v = rng.normal(size=(n, 3)) + rng.integers(0, 4, (n, 1)) * 2
        df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "id long, a double, b double, c double")
        out = {r["id"]: r["cluster"] for r in cluster.heterogeneous_clusters(df, "id", k, few=few, per_cell=16, most=64).collect()}
        z = (v - v.mean(0)) / v.std(0, ddof=1)
        assert [out[i] for i in range(n)] == cluster.ward(z, np.ones(n), k).tolist()


def test_ward_of_embeddings(spark):
    v = np.vstack([duckdb.sql("select embedding from '/root/testdata/check_s/embeddings.parquet/*.parquet' order by vec_id limit 2000").fetchnumpy()["embedding"].tolist()]).astype(float)[:, :16]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "id long, " + ", ".join(f"e{i} double" for i in range(16)))
    out = {r["id"]: r["cluster"] for r in cluster.heterogeneous_clusters(df, "id", 10, few=900).collect()}
    u, first, n = np.unique(v, axis=0, return_index=True, return_counts=True)
    z = (u - v.mean(0)) / v.std(0, ddof=1)
    assert same([out[i] for i in first], cluster.ward(z, n, 10).tolist())


def test_ward_with_repeats_nulls_and_few_rows(spark):
    rows = [(i, float(i % 4), 1.0 if i % 4 else None, 5.0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double, constant double")
    got = {r["id"]: r["cluster"] for r in cluster.heterogeneous_clusters(df.withColumn("b", F.coalesce("b", F.lit(0.0))), "id", 4, few=2).collect()}
    assert [got[i] for i in range(8)] == [1, 2, 3, 4] * 2
    some = {r["id"]: r["cluster"] for r in cluster.heterogeneous_clusters(df.withColumn("b", F.when(F.col("id") == 7, None).otherwise(F.col("id") % 4)), "id", 2, few=2).collect()}
    assert some[7] is None and len(some) == 40 and set(some.values()) == {None, 1, 2}
    assert cluster.heterogeneous_clusters(df.limit(0), "id", 3).count() == 0


def tree_by_brute_force(x, y, w, min_size=10, min_cut=5, min_deviance=0.01):
    """The same rule, with every cut of every node tried."""

    def dev(rows):
        n, o = w[rows].sum(), w[rows][y[rows] == 1].sum()
        return -2.0 * sum(c * np.log(c / n) for c in (o, n - o) if c > 0)

    def node(rows):
        n, ones = w[rows].sum(), w[rows][y[rows] == 1].sum()
        out = {"label": bool(2 * ones > n)}
        if n < min_size or dev(rows) <= 0 or dev(rows) < min_deviance * root:
            return out
        best = None
        for f in range(x.shape[1]):
            own = rows[~np.isnan(x[rows, f])]
            values = np.unique(x[own, f])
            for a, b in zip(values, values[1:], strict=False):
                left, right = own[x[own, f] <= a], own[x[own, f] > a]
                if min(w[left].sum(), w[right].sum()) >= min_cut:
                    gain = round(dev(own) - dev(left) - dev(right), 9)
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, f, a / 2 + b / 2, left, right)
        if best:
            out |= {"feature": best[1], "at": best[2], "left": node(best[3]), "right": node(best[4])}
        return out

    root = dev(np.arange(len(y)))
    return node(np.arange(len(y)))


def as_dict(t, i=0):
    out = {"label": t.label[i]}
    if t.feature[i] >= 0:
        out |= {"feature": t.feature[i], "at": t.at[i], "left": as_dict(t, t.left[i]), "right": as_dict(t, t.right[i])}
    return out


@pytest.mark.parametrize("ranges", [256, 4])
def test_trees_are_those_of_brute_force(spark, ranges):
    rng = np.random.default_rng(2)
    n = 400
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 6, n), rng.normal(size=n).round(1)])
    y = ((x[:, 0] * x[:, 1] > 0.5) ^ (x[:, 2] > 1) ^ (rng.random(n) < 0.1)).astype(int)
    x[rng.random((n, 3)) < 0.05] = np.nan
    w = rng.integers(1, 4, n)
    rows = [(t, int(y[i]), int(w[i]), *[None if np.isnan(v) and i % 2 else float(v) for v in x[i]]) for t in (0, 1) for i in range(n) if t == 0 or i % 3]
    df = spark.createDataFrame(rows, "tree int, y int, w long, a double, b double, c double")
    grown = trees.grow(df, ["a", "b", "c"], ranges=ranges)
    some = np.arange(n)[np.arange(n) % 3 > 0]
    assert as_dict(grown[0]) == tree_by_brute_force(x, y, w)
    assert as_dict(grown[1]) == tree_by_brute_force(x[some], y[some], w[some])
    assert len(grown[0].feature) > 9


def test_trees_go_deeper_than_any_cap(spark):
    """Stripes of classes in turn: each split peels one off."""
    rows = [(0, i % 2, 12, float(i)) for i in range(14)]
    t = trees.grow(spark.createDataFrame(rows, "tree int, y int, w long, a double"), ["a"], min_deviance=0.001)[0]
    depth = lambda i: 0 if t.feature[i] < 0 else 1 + max(depth(t.left[i]), depth(t.right[i]))
    assert depth(0) > 5 and t.vote(np.arange(14.0)[:, None]).tolist() == [i % 2 == 1 for i in range(14)]


def test_rows_with_missing_features_have_votes(spark):
    rows = [(i, float(i % 2 * 10 + i % 5), None if i % 7 == 0 else 1.0) for i in range(80)]
    df = spark.createDataFrame(rows, "CellID int, a double, b double")
    errors, correct = df.where("CellID % 2 = 1 and CellID < 40"), df.where("CellID % 2 = 0")
    test = df.unionByName(spark.createDataFrame([(100, None, None), (101, float("nan"), 1.0)], "CellID int, a double, b double"))
    got = {r["CellID"]: r["votes"] for r in segmentation.tree_votes(errors.fillna(1.0), correct.fillna(1.0), test, trees=3).collect()}
    assert len(got) == 82 and all(got[i] == (3 if i % 2 else 0) for i in range(80)) and {100, 101} <= set(got)
    assert trees.votes(test.limit(0), "CellID", ["a", "b"], {}).count() == 0


def exact_machine(x, y, gamma, cost=1.0, steps=200_000):
    """Decisions of the kernel machine, by the pair of rows that violates its conditions most (Keerthi et al. 2001)."""
    k = np.exp(-gamma * neighbours.squared(x, x))
    alpha, grad = np.zeros(len(y)), -np.ones(len(y))
    for _ in range(steps):
        up = ((y > 0) & (alpha < cost)) | ((y < 0) & (alpha > 0))
        low = ((y > 0) & (alpha > 0)) | ((y < 0) & (alpha < cost))
        score = -y * grad
        i, j = np.where(up, score, -np.inf).argmax(), np.where(low, score, np.inf).argmin()
        if score[i] - score[j] < 1e-4:
            break
        step = (score[i] - score[j]) / max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
        step = min(step, cost - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else cost - alpha[j])
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        grad += step * y * (k[i] - k[j])
    return (alpha * y), (score[i] + score[j]) / 2


def test_machine_on_landmarks_is_the_kernel_machine(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2000, 4))
    y = np.where(np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2] + 0.4 * rng.normal(size=2000) > 0, 1, -1)
    other = rng.normal(size=(1500, 4))
    weights, bias = exact_machine(x, y, 0.25)
    want = np.exp(-0.25 * neighbours.squared(other, x)) @ weights + bias > 0
    train = spark.createDataFrame([(*map(float, r), "p" if c > 0 else "n") for r, c in zip(x, y, strict=True)], "a double, b double, c double, d double, y string")
    test = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(other)] + [(-1, None, 0.0, 0.0, 0.0)], "id long, a double, b double, c double, d double")
    got = {r["id"]: r["SVM"] for r in classify.rbf_svm(train, test, "y", ["a", "b", "c", "d"]).select("id", "SVM").collect()}
    agree = np.mean([(got[i] == "p") == want[i] for i in range(1500)])
    assert agree >= 0.99 and got[-1] is None


def test_rough_distances_leave_the_neighbours_exact():
    """Far from zero, with equal rows, ties and weights: the same neighbours and costs, to the last bit, as by all distances."""
    rng = np.random.default_rng(7)
    for k, weighted, shift in ((1, True, 0.0), (3, False, 1e6), (4, True, -50.0)):
        v = np.round(rng.normal(size=(600, 24)), 1) + shift
        v[300:330] = v[0]
        ids, w = np.arange(600) * 3, rng.integers(1, 90, 600).astype(float)
        search = neighbours._Search(ids[:200], v[:200], w[:200], k, weighted)
        for part in np.array_split(np.arange(600), 5):
            search.see(np.arange(200), ids[part], v[part], w[part])
        d = neighbours.squared(v[:200], v) * (neighbours.factor(w[:200, None], w[None]) if weighted else 1.0)
        d[np.arange(200), np.arange(200)] = np.inf
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        assert (search.other == ids[best]).all() and (search.cost == np.take_along_axis(d, best, 1)).all()


def test_distances_take_a_product_of_matrices():
    """4,000 x 4,000 distances of 64 features take a small part of what summing them feature by feature does."""
    v = np.random.default_rng(8).normal(size=(4000, 64))
    search = neighbours._Search(np.arange(4000), v, np.ones(4000), 1, True)
    start = time.process_time()
    search.see(np.arange(4000), np.arange(4000), v, np.ones(4000))
    took = time.process_time() - start
    start = time.process_time()
    neighbours.squared(v[:400], v)
    assert took < 10 * (time.process_time() - start) / 2


def test_ward_asks_few_clusters_again(spark, monkeypatch):
    """Clusters whose nearest is joined go on with their lists: all searches together take less than 2.3 n^2 distances, not 3 n^2."""
    asked, search = [], cluster.lists

    def counted(placed, cells, width, n, asking, *more):
        asked.append(n * asking)
        return search(placed, cells, width, n, asking, *more)

    monkeypatch.setattr(cluster, "lists", counted)
    v = np.random.default_rng(12).normal(size=(600, 16))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(v)], "id long, " + ", ".join(f"e{i} double" for i in range(16)))
    out = {r["id"]: r["cluster"] for r in cluster.heterogeneous_clusters(df, "id", 7, few=150, per_cell=16, most=128).collect()}
    assert [out[i] for i in range(600)] == cluster.ward((v - v.mean(0)) / v.std(0, ddof=1), np.ones(600), 7).tolist()
    assert len(asked) > 3 and sum(asked) < 2.3 * 600**2


def test_rounds_in_a_task_are_ward():
    rng = np.random.default_rng(13)
    v, w = rng.normal(size=(700, 5)), rng.integers(1, 9, 700).astype(float)
    one, rounds = cluster.agglomerate(v, w), cluster.in_rounds(v, w)
    assert sorted(x[2] for x in one) == sorted(x[2] for x in rounds)
    grid = np.array([(i, j) for i in range(15) for j in range(15)], float)  # nothing but ties
    assert len(cluster.in_rounds(grid, np.ones(225))) == 224


def test_single_precision_leaves_the_neighbours_exact():
    """Groups far from each other, whose rows lie nearer together than single precision tells."""
    rng = np.random.default_rng(14)
    v = (rng.normal(size=(8, 6)) * 1e4)[rng.integers(0, 8, 1600)] + rng.normal(size=(1600, 6)) * 1e-3
    ids, w = np.arange(1600), rng.integers(1, 4, 1600).astype(float)
    search = neighbours._Search(ids, v, w, 5, True)
    for part in np.array_split(ids, 3):
        search.see(ids, part, v[part], w[part])
    d = neighbours.squared(v, v) * neighbours.factor(w[:, None], w[None])
    np.fill_diagonal(d, np.inf)
    best = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert (search.other == best).all() and (search.cost == np.take_along_axis(d, best, 1)).all()
