"""Kernels against brute force on small fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyfold.kernels.components import connected_components
from skyfold.kernels.hull import convex_hull, hull_area
from skyfold.kernels.knn import knn
from skyfold.kernels.moments import fit_similarity
from skyfold.kernels.ordered import asof_neighbours, with_adjacent, with_running
from skyfold.kernels.quantile import quantiles


def cloud():
    rng = np.random.default_rng(0)
    a = rng.normal(0, 1, (500, 3))
    a[:150] = a[0]
    a[150:300] *= 0.001
    a[300:310] *= 200
    p = pd.DataFrame(a, columns=list("xyz"))
    p["mission_id"] = np.arange(500) % 2
    p["point_id"] = np.arange(500)
    return p


def test_knn_equals_brute_force(spark):
    p = cloud()
    df = spark.createDataFrame(p)
    r = knn(df, df, ["mission_id"], k=4, exclude_self=True).toPandas()
    for m in (0, 1):
        x = p[p.mission_id == m][["x", "y", "z"]].to_numpy()
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        got = r[r.mission_id == m].sort_values(["point_id", "rank"]).distance.to_numpy().reshape(-1, 4)
        assert np.abs(got - np.sort(d, 1)[:, :4]).max() < 1e-12


def test_quantiles_of_large_keys_are_exact(spark):
    p = cloud()
    q = quantiles(spark.createDataFrame(p), ["mission_id"], small_group=10, a=("x", 0.5), b=("x", 0.95), u=("y", "upper")).toPandas().set_index("mission_id")
    for m, g in p.groupby("mission_id"):
        assert abs(q.a[m] - g.x.median()) < 1e-12
        assert abs(q.b[m] - g.x.quantile(0.95)) < 1e-12
        assert q.u[m] == np.sort(g.y)[len(g) // 2]


def test_order_kernels(spark):
    p = cloud().sort_values(["mission_id", "point_id"])
    df, g, blk = spark.createDataFrame(p).repartition(7), p.groupby("mission_id").x, F.floor(F.col("point_id") / 40)
    a = with_adjacent(df, ["mission_id"], ["point_id"], blk, prev={"a": F.col("x")}, nxt={"b": F.col("x")}).toPandas().sort_values(["mission_id", "point_id"])
    assert np.array_equal(a.a.to_numpy(), g.shift(1).to_numpy(), equal_nan=True)
    assert np.array_equal(a.b.to_numpy(), g.shift(-1).to_numpy(), equal_nan=True)
    r = with_running(df, ["mission_id"], ["point_id"], blk, {"s": F.col("x")}, rank="r", total="n").toPandas().sort_values(["mission_id", "point_id"])
    assert np.abs(r.s.to_numpy() - g.cumsum().to_numpy()).max() < 1e-9
    assert (r.r.to_numpy() == g.cumcount().to_numpy() + 1).all() and (r.n == 250).all()


def test_asof(spark):
    rng = np.random.default_rng(1)
    s = np.append(np.arange(0, 40, 0.7), [80, 80, 81])
    left = spark.createDataFrame(pd.DataFrame({"m": 0, "t": rng.uniform(0, 100, 60), "i": range(60)}))
    right = spark.createDataFrame(pd.DataFrame({"m": 0, "s": s, "j": range(len(s))}))
    for x in asof_neighbours(left, right, ["m"], "t", "s", 5.0).collect():
        b, a = s[s < x.t], s[s >= x.t]
        assert (x.before and x.before.s) == (b.max() if len(b) else None)
        assert (x.after and x.after.s) == (a.min() if len(a) else None)


def test_components(spark):
    e = pd.DataFrame({"a": [*range(60), 200, 300], "b": [*range(1, 61), 201, 301]})
    n = {r.component: r["count"] for r in connected_components(spark.createDataFrame(e)).groupBy("component").count().collect()}
    assert n == {0: 61, 200: 2, 300: 2}


def test_similarity_recovers_a_known_transform(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(20, 3))
    t = np.radians(35)
    r = np.array([[np.cos(t), -np.sin(t), 0], [np.sin(t), np.cos(t), 0], [0, 0, 1]])
    y = 17 * x @ r.T + [100, 50, 10]
    p = pd.DataFrame(np.hstack([x, y]), columns=["sx", "sy", "sz", "dx", "dy", "dz"]).assign(mission_id=1)
    f = fit_similarity(spark.createDataFrame(p), ["mission_id"]).first()
    assert abs(f.scale - 17) < 1e-9 and np.allclose(f.r, r.ravel()) and np.allclose([f.tx, f.ty, f.tz], [100, 50, 10])


def test_hull(spark):
    c = pd.DataFrame([(i, j) for i in range(6) for j in range(4)] + [(10, 2)], columns=["ix", "iy"]).assign(m=1)
    a = hull_area(convex_hull(spark.createDataFrame(c), ["m"]), ["m"]).first()
    assert a.area == 15 + 7.5 and a.corners == 5


def test_ranked_quantiles_narrow_down(spark, monkeypatch):
    """Ranks are found by counting: outliers, ties and infinite values included, whatever fits the rows around a rank."""
    from skyfold.kernels import quantile

    monkeypatch.setattr(quantile, "INSIDE", 20)
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=3000), [1e12, np.inf, -np.inf], np.full(500, 0.25)])
    p = pd.DataFrame({"k": np.arange(len(v)) % 2, "v": v})
    q = quantile.ranked(spark.createDataFrame(p), ["k"], a=("v", 0.5), b=("v", 0.95), u=("v", "upper")).toPandas().set_index("k")
    for k, g in p.groupby("k"):
        s = np.sort(g["v"])
        assert np.allclose(q.loc[k, ["a", "b"]].astype(float), np.quantile(s, [0.5, 0.95])) and q.loc[k, "u"] == s[len(s) // 2]


@pytest.mark.parametrize("few, boxes, dims, k", [(4096, 1024, "xyz", 3), (10, 1024, "xyz", 1), (10, 30, "xyz", 5), (10, 30, "xy", 2)])
def test_knn_of_far_queries(spark, monkeypatch, few, boxes, dims, k):
    """Queries far outside the targets, piles of copies, keys without targets: few targets at once, many by boxes; ties to the smaller id."""
    from skyfold.kernels import knn as module

    monkeypatch.setattr(module, "FEW", few)
    monkeypatch.setattr(module, "BOXES", boxes)
    rng = np.random.default_rng(5)
    t = pd.DataFrame(rng.integers(0, 9, (1500, 3)) * 0.5, columns=list("xyz")).assign(mission_id=np.arange(1500) % 2, point_id=rng.permutation(1500))
    t.loc[:200, ["x", "y", "z"]] = 1.0
    q = pd.DataFrame(rng.normal(0, 40, (300, 3)), columns=list("xyz")).assign(mission_id=np.arange(300) % 3, point_id=np.arange(300))
    q.loc[:60, ["x", "y", "z"]] = t.loc[300:360, ["x", "y", "z"]].to_numpy()
    r = knn(spark.createDataFrame(q), spark.createDataFrame(t), ["mission_id"], dims=list(dims), k=k, exclude_self=True).toPandas().set_index("point_id").sort_values("rank")
    assert set(r.mission_id) == {0, 1} and len(r) == 200 * k
    for m in (0, 1):
        own = t[t.mission_id == m]
        for i, p in q[q.mission_id == m].set_index("point_id").iterrows():
            d2 = ((own[list(dims)].to_numpy() - p[list(dims)].to_numpy(float)) ** 2).sum(1)
            d2[own.point_id.to_numpy() == i] = np.inf
            best = np.lexsort((own.point_id.to_numpy(), d2))[:k]
            got = r.loc[[i]]
            assert np.allclose(got.distance, np.sqrt(d2[best])) and list(got["rank"]) == list(range(1, k + 1))
            if i <= 60:  # exact values, so ties are exact
                assert list(got.neighbour) == list(own.point_id.to_numpy()[best])
