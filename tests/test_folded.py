"""Figures of nearest neighbours, taken in the task that finds them, once per place."""

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

from skyfold.kernels import knn as kn
from skyfold.operators import cloud as cl

K = 4


@pytest.fixture(scope="module")
def cloud(spark):
    """A lattice with ties, piles of copies and lone far points; a second key of few points and one of a single point."""
    rng = np.random.default_rng(5)
    p = np.vstack([rng.integers(0, 12, (700, 3)) * 0.25, np.tile([[1.0, 1.0, 1.0]], (40, 1)), rng.integers(0, 3, (5, 3)) * 90.0 + 50, rng.integers(0, 2, (3, 3)) * 1.0, [[7.0, 7.0, 7.0]]])
    keys = np.r_[np.zeros(745, int), np.ones(3, int), [2]]
    pdf = pd.DataFrame({"mission_id": keys, "point_id": rng.permutation(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]})
    return pdf, spark.createDataFrame(pdf).repartition(4)


def brute(pdf, k, others):
    """Per point: distances to and ids of its k nearest, ties to the smaller id."""
    out = {}
    for m, g in pdf.groupby("mission_id"):
        g = g.sort_values("point_id")
        xs, ids = g[["x", "y", "z"]].to_numpy(), g["point_id"].to_numpy()
        d = np.sqrt(((xs[:, None] - xs[None]) ** 2).sum(2))
        for i, pid in enumerate(ids):
            at = [j for j in np.argsort(d[i], kind="stable") if not (others and j == i)][:k]
            out[m, pid] = d[i][at], xs[at]
    return out


@pytest.mark.parametrize("few", [4096, 0])
def test_figures_equal_brute_force(cloud, monkeypatch, few):
    pdf, df = cloud
    monkeypatch.setattr(kn, "FEW", few)
    want = brute(pdf, K, True)
    got = {(r["mission_id"], r["point_id"]): r for r in cl.spacing_field(df, K).collect()}
    positive = {p: d[d > 0] for p, (d, _) in want.items()}
    assert set(got) == {p for p, d in positive.items() if len(d)}
    assert all(got[p]["spacing"] == pytest.approx(np.median(positive[p])) for p in got)
    mean = {(r["mission_id"], r["point_id"]): r["mean_nn"] for r in cl.statistical_outliers(df, K).collect()}
    assert all(mean[p] == pytest.approx(d.mean()) if len(d) else mean[p] is None for p, (d, _) in want.items()) and len(mean) == len(want)
    near = {(r["mission_id"], r["point_id"]): r["distance"] for r in cl.nearest_distance(df).collect()}
    assert near == pytest.approx({p: d[0] for p, (d, _) in want.items() if len(d)})


@pytest.mark.parametrize("few", [4096, 0])
def test_covariances_equal_brute_force(cloud, monkeypatch, few):
    pdf, df = cloud
    monkeypatch.setattr(kn, "FEW", few)
    at = {(r["mission_id"], r["x"], r["y"], r["z"]): r for r in kn.folded(df, ["mission_id"], K, kn.covariance(), others=False).collect()}
    assert len(at) == len(pdf[["mission_id", "x", "y", "z"]].drop_duplicates())
    for r in pdf.itertuples():
        d, xs = brute_cache(pdf)[r.mission_id, r.point_id]
        row = at[r.mission_id, r.x, r.y, r.z]
        cov = np.cov(xs.T, bias=True) if len(xs) > 1 else np.zeros((3, 3))
        assert row["n"] == len(xs) and [row[c] for c in ("xx", "xy", "xz", "yy", "yz", "zz")] == pytest.approx([cov[i, j] for i in range(3) for j in range(i, 3)], abs=1e-9)


_cache = {}


def brute_cache(pdf):
    return _cache.setdefault("own", None) or _cache.__setitem__("own", brute(pdf, K, False)) or _cache["own"]


def test_copies_are_asked_once(cloud, monkeypatch):
    """Queries that coincide are one query, and their neighbours are those of each of them."""
    pdf, df = cloud
    asked, search = [], kn._search
    monkeypatch.setattr(kn, "_search", lambda pts, *a, **k: asked.append(pts.count()) or search(pts, *a, **k))
    three = df.select("mission_id", F.explode(F.array(*[F.col("point_id") * 3 + i for i in range(3)])).alias("qid"), "x", "y", "z")
    got = {(r["mission_id"], r["qid"]): (r["neighbour"], r["rank"], r["distance"]) for r in kn.knn(three, df, ["mission_id"], qid="qid", carry=["z"]).collect()}
    places = len(pdf[["mission_id", "x", "y", "z"]].drop_duplicates())
    assert asked == [places] and len(got) == 3 * len(pdf)
    first = pdf.groupby(["mission_id", "x", "y", "z"])["point_id"].min()
    assert all(got[r.mission_id, r.point_id * 3 + i] == (first[r.mission_id, r.x, r.y, r.z], 1, 0.0) for r in pdf.itertuples() for i in range(3))
    list(cl.nearest_distance(df).collect())
    assert asked == [places, places]
