"""Verticals, ground bands and corridors with known truth."""

import numpy as np
import pandas as pd
import pytest

from skyfold.operators import orient

DOWN = [1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0]  # looks along -z, the image's upper edge along +y
AHEAD = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, -1.0, 0.0]  # looks along +y, the image's upper edge along +z


def cams(spark, rows):
    return spark.createDataFrame([(m, i, *map(float, c), r) for i, (m, c, r) in enumerate(rows)], "mission_id long, frame_id long, cx double, cy double, cz double, r array<double>")


def cloud(spark, parts):
    return spark.createDataFrame(pd.concat([pd.DataFrame(p, columns=list("xyz")).assign(mission_id=m, point_id=np.arange(len(p)) + 100_000 * m) for m, p in parts]))


def slope(rng, n, normal, noise=0.02, side=40.0):
    normal = np.asarray(normal) / np.linalg.norm(normal)
    a = np.linalg.svd(normal[None, :])[2][1:]
    return rng.uniform(-side, side, (n, 2)) @ a + normal * rng.normal(0, noise, (n, 1))


def test_priors(spark):
    rng = np.random.default_rng(1)
    flat = slope(rng, 300, (0.1, 0, 1))
    blob = rng.uniform(0, 1, (50, 3)) * (5, 2, 9)
    points = cloud(spark, [(1, flat), (2, flat), (3, blob), (4, blob), (5, -flat)])
    poses = cams(spark, [(m, (i, i, 60), DOWN) for m in (1, 5) for i in range(4)] + [(m, (i, 0, 3), AHEAD) for m in (2, 3) for i in range(4)] + [(6, (0, 0, 0), AHEAD)])
    enu = spark.createDataFrame([(4, [0.0, 0.0, -2.0, 0.0, 0.0, 2.0, 0.0, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]), (3, [1.0, 0.5, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0])], "mission_id long, m array<double>")
    got = {r["mission_id"]: r for r in orient.scene_vertical(points, poses, enu).collect()}
    up = lambda m: np.array([got[m][c] for c in orient.UP])
    assert {m: r["prior"] for m, r in got.items()} == {1: "camera_facing_surface", 2: "camera_image_up", 3: "camera_image_up", 4: "enu_vertical", 5: "camera_facing_surface", 6: "camera_image_up"}
    want = np.array([0.1, 0, 1]) / np.linalg.norm([0.1, 0, 1])
    assert up(1) @ want > 0.9999 and up(5) @ want > 0.9999 and np.allclose(up(2), (0, 0, 1)) and np.allclose(up(4), (1, 0, 0)) and np.allclose(up(6), (0, 0, 1))
    alone = orient.scene_vertical(cloud(spark, [(7, blob)]), poses.limit(0)).first()
    assert alone["prior"] == "smallest_extent_axis" and (alone["ux"], alone["uy"], alone["uz"]) == (0, 1, 0)


def test_sloping_shell_under_clutter(spark):
    rng = np.random.default_rng(2)
    normal = np.array([0.2, -0.1, 1.0]) / np.linalg.norm([0.2, -0.1, 1.0])
    ground = slope(rng, 3000, normal)
    clutter = np.column_stack([rng.uniform(-40, 40, (2000, 2)), rng.uniform(-3, 25, 2000)])
    noise = rng.uniform(-1, 1, (900, 3)) * (40, 40, 40)
    points = cloud(spark, [(1, np.vstack([ground, clutter])), (2, noise), (3, ground[:30])])
    vertical = spark.createDataFrame([(m, 0.0, 0.0, 1.0) for m in (1, 2, 3)], "mission_id long, ux double, uy double, uz double")
    got = {r["mission_id"]: r for r in orient.band_plane(points, vertical).collect()}
    assert got[1]["method"] == "geometry_plane_fit" and np.array([got[1][c] for c in ("gx", "gy", "gz")]) @ normal > 0.9998 and got[1]["rms_m"] < 0.2
    assert {m: (got[m]["method"], got[m]["gz"]) for m in (2, 3)} == {2: ("up_prior", 1.0), 3: ("up_prior", 1.0)}


def test_corridor(spark):
    line = [(1, (3.0 * i, 4.0 * i + (i % 2), 50 + i % 3), DOWN) for i in range(20)]
    square = [(3, (10.0 * (i % 4), 10.0 * (i // 4), 50), DOWN) for i in range(16)]
    back = [(2, c, r) for _, c, r in reversed(line)]
    normal = spark.createDataFrame([(m, 0.0, 0.0, 1.0) for m in (1, 2, 3, 4)], "mission_id long, nx double, ny double, nz double")
    got = {r["mission_id"]: r for r in orient.corridor_axis(cams(spark, line + back + square + [(4, c, r) for _, c, r in line[:4]]), normal).collect()}
    h = {m: np.array([got[m][c] for c in ("hx", "hy", "hz")], dtype=object) for m in got}
    assert np.allclose(h[1].astype(float), (0.6, 0.8, 0), atol=0.01) and np.allclose(h[2].astype(float), -h[1].astype(float))
    assert list(h[3]) == [None] * 3 and got[3]["ratio"] == pytest.approx(1) and got[4]["ratio"] is None and list(h[4]) == [None] * 3
