"""Queries over all rows of their tables."""

import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from check import DATA, compare, duck
from skyfold.operators import scene
from skyfold.plans import QUERIES, SQL, derive

SF = str(DATA / "sf0.001")
EPOCHS = ("baseline", "current")


@pytest.mark.parametrize("name", ["b5_cell_casts", "e4_statistical_outliers", "e13_spacing_field", "e14_spacing_summary", "e20_cross_view_evidence", "e21_cross_view_summary", "e36_ghost_rejection", "j9_infrastructure"])
def test_whole_tables(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, duck(SF).execute(SQL[name]).df()) is None
    assert "epoch" not in got or set(got["epoch"]) == set(EPOCHS)


def test_normals_of_both_epochs(spark):
    got = QUERIES["e15_normals"](spark, SF).toPandas().set_index("point_id")
    points = derive.Tables(spark, SF).points.toPandas()
    assert len(got) == len(points) and set(got["epoch"]) == set(EPOCHS)
    for _, p in points.groupby(["mission_id", "epoch"]):
        at, ids = p[["x", "y", "z"]].to_numpy(), p["point_id"].to_numpy()
        for i in range(0, len(p), 50):
            d2 = ((at - at[i]) ** 2).sum(1)
            val, vec = np.linalg.eigh(np.cov(at[np.lexsort((ids, d2))[:12]].T))
            if val[1] - val[0] > 1e-6 * val[2]:
                assert abs(got.loc[ids[i], ["nx", "ny", "nz"]].to_numpy(float) @ vec[:, 0]) > 1 - 1e-6


def test_every_cell_is_cast(spark):
    got = QUERIES["b5_cell_casts"](spark, SF).toPandas().sort_values(["id", "pos"])
    number = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
    want = []
    for i, text in duck(SF).execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall():
        cells = [c for c in re.split(r"[ \t\n\x0b\f\r]+", text or "") if c]
        want += [(i, k, float(c) if number.fullmatch(c) and np.isfinite(float(c)) else None, c) for k, c in enumerate(cells)]
    assert [(r.id, r.pos, r.p) for r in got.itertuples()] == [(i, k, c) for i, k, _, c in want]
    n = np.array([w[2] for w in want], float)
    assert np.isfinite(n).any() and np.isnan(n).any() and np.allclose(got["n"].to_numpy(float), n, atol=1e-6, rtol=1e-12, equal_nan=True)


def test_risk_zones_of_every_cell(spark):
    t = derive.Tables(spark, SF)
    p, o = t.points.toPandas(), t.objects.toPandas()
    want = []
    for m, q in p.groupby("mission_id"):
        z = q["z"].groupby([np.floor(q["x"] / 2).astype(int), np.floor(q["y"] / 2).astype(int)]).mean().to_dict()
        cause = {}
        for c, at in z.items():
            d = []
            for sx, sy in ((1, 0), (0, 1)):
                a, b = z.get((c[0] + sx, c[1] + sy)), z.get((c[0] - sx, c[1] - sy))
                d.append((a - b) / 4 if None not in (a, b) else (a - at) / 2 if a is not None else (at - b) / 2 if b is not None else 0.0)
            if np.degrees(np.arctan(np.hypot(*d))) > 25:
                cause[c] = "slope"
        x, y = zip(*z)
        for name, kind in (("debris", "unclassified"), ("flood", "water")):
            for f in o[(o["class"] == kind) & (o["object_id"] % 8 == m)].itertuples():
                fx, fy, r = f.object_id % 47 * 1.1, f.object_id * 7 % 53 * 0.9, np.sqrt(max(float(f.area), 1) / np.pi) + 1.5
                cause |= {(i, j): name for i in range(min(x), max(x) + 1) for j in range(min(y), max(y) + 1) if np.hypot(i * 2 + 1 - fx, j * 2 + 1 - fy) <= r}
        while cause:
            zone, todo = {}, [next(iter(cause))]
            while todo:
                c = todo.pop()
                if c in cause:
                    zone[c] = cause.pop(c)
                    todo += [(c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)]
            if len(zone) > 1:
                n = Counter(zone.values())
                at = np.mean(list(zone), axis=0)
                want.append((m, max(("flood", "debris", "slope"), key=lambda k: n[k]), len(zone), at[0] * 2 + 1, at[1] * 2 + 1, len(zone) * 4.0))
    columns = ["mission_id", "cause", "cells", "cx", "cy", "area_m2"]
    got = sorted(tuple(r) for r in QUERIES["f15_risk_zones"](spark, SF).select(columns).toPandas().itertuples(index=False))
    assert {w[1] for w in want} == {"flood", "debris", "slope"} and len(got) == len(want)
    for g, w in zip(got, sorted(want)):
        assert g[:3] == w[:3] and np.allclose(np.array(g[3:], float), w[3:])


def _fit(p):
    n = np.linalg.svd(p - p.mean(0), full_matrices=False)[2][-1]
    n = -n if n[2] < 0 else n
    return n, -n @ p.mean(0)


def test_classes_on_a_coloured_slope(spark):
    """A ramp with a green crown, a blue pool below it, a grey roof and a wall above it: all heights are over the ramp."""
    rng = np.random.default_rng(5)
    v, f = [], []

    def face(p, colour):
        f.append((1, len(f), len(v), len(v) + 1, len(v) + 2))
        v.extend([(1, len(v) + i, *map(float, q), *colour) for i, q in enumerate(p)])

    up, wall = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0]]), np.array([[0, 0, 0], [0, 1, 0], [0, 0, 1.0]])
    want = {}
    for kind, n, lift, shape, colour in (("ground", 300, 0, up, (120, 120, 120)), ("vegetation", 9, 3, up, (40, 160, 40)), ("water", 5, -1, up, (30, 60, 200)), ("roof", 7, 5, up, (150, 150, 150)), ("wall", 6, 3, wall, (150, 150, 150)), ("unclassified", 4, 4, up, (30, 60, 200))):
        for x, y in rng.uniform(0, 40, (n, 2)):
            p = shape + [x, y, 0.0]
            p[:, 2] += 0.2 * (p[:, 0] if shape is up else x) + lift
            want[len(f)] = kind
            face(p, colour)
    got = scene.classify_faces(spark.createDataFrame(v, "mission_id long, vid long, x double, y double, z double, r int, g int, b int"), spark.createDataFrame(f, "mission_id long, fid long, v0 long, v1 long, v2 long")).toPandas().set_index("fid")
    assert got["cls"].to_dict() == want
    conf = got.groupby("cls")["confidence"].agg(["min", "max"]).round(6)
    assert tuple(conf.loc["vegetation"]) == (0.95, 0.95) and tuple(conf.loc["water"]) == (0.6, 0.6) and tuple(conf.loc["roof"]) == (0.75, 0.75) and tuple(conf.loc["unclassified"]) == (0, 0) and conf.loc["ground", "min"] >= 0.35


def test_infrastructure_over_the_ground(spark):
    rng = np.random.default_rng(6)
    xy = rng.uniform(0, 50, (400, 2))
    v = np.column_stack([xy, 0.02 * xy[:, 0] + 10 + rng.uniform(0, 0.3, 400)])
    n, d = _fit(v[np.argsort(v[:, 2])[:40]])
    rows = [("vegetation", 5, 5, 10, 14), ("vegetation", 20, 8, 10, 11), ("vegetation", 30, 30, 12, 20), ("structure", 1, 1, 10, 16), ("tower", 9, 7, 10, 40), ("tower", 40, 40, 10, 35), ("road", 0, 0, 10, 10), ("road", 3, 9, 10, 10), ("vehicle", 2, 2, 10, 12)]
    o = pd.DataFrame([(1, i, c, x, x + 2.0 + 3 * (i == 7), y, y + 1.0, float(a), float(b), float(b - a), 2.0) for i, (c, x, y, a, b) in enumerate(rows)], columns="mission_id object_id class x0 x1 y0 y1 z0 z1 height area".split()).astype({c: float for c in ("x0", "x1", "y0", "y1")})
    got = scene.infrastructure(spark.createDataFrame(o), scene.lowest_plane(spark.createDataFrame(pd.DataFrame(v, columns=list("xyz")).assign(mission_id=1)))).first()
    h = [np.array([r.x0 + r.x1, r.y0 + r.y1, r.z0 + r.z1]) / 2 @ n + d for r in o[:3].itertuples()]
    h = [x for x in h if x >= 1]
    assert got["trees"] == len(h) == 2 and np.isclose(got["mean_tree_height"], np.mean(h)) and np.isclose(got["max_tree_height"], max(h))
    assert (got["buildings"], got["min_tower_height"], got["roads"], got["road_width"], got["vehicles"]) == (1, 6.0, 2, 3.5, 1)
    assert np.isclose(got["min_tower_gap"], np.linalg.norm([8, 6, 12]))
