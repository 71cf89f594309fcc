"""Bridges between sheets, best views with occlusion, disagreement of views on scenes with known truth."""

import pytest
from pyspark.sql import functions as F

from skyfold.operators import consistency

DOWN = [1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0]
POSES = "mission_id long, frame_id long, cx double, cy double, cz double, r array<double>, f double, width int, height int"
V, FACES = "mission_id long, vid long, x double, y double, z double", "mission_id long, fid long, v0 long, v1 long, v2 long"


def test_one_bridge_between_two_sheets(spark):
    """Mission 1 has two level sheets 4 m apart and one triangle from one to the other; mission 2 has one sheet with long triangles."""
    rows = [(m, 10_000 * k + 100 * i + j, i * 0.25, j * 0.25, 4.0 * k, 0.0, 0.0, 1.0) for m, sheets in ((1, 2), (2, 1)) for k in range(sheets) for i in range(41) for j in range(41)]
    cloud = spark.createDataFrame(rows, "mission_id long, point_id long, x double, y double, z double, nx double, ny double, nz double")
    v = spark.createDataFrame([(1, 0, 5.0, 5.0, 0.0), (1, 1, 5.0, 6.0, 0.0), (1, 2, 5.0, 5.0, 4.0), (1, 3, 6.0, 5.0, 0.0), (2, 0, 0.0, 0.0, 0.0), (2, 1, 8.0, 0.0, 0.0), (2, 2, 0.0, 8.0, 0.0)], V)
    f = spark.createDataFrame([(1, 0, 0, 1, 2), (1, 1, 0, 1, 3), (2, 0, 0, 1, 2)], FACES)
    got = {(r["mission_id"], r["fid"]): r for r in consistency.bridge_faces(v, f, cloud, 3.0).collect()}
    assert {k: r["bridge"] for k, r in got.items()} == {(1, 0): True, (1, 1): False, (2, 0): False}
    assert got[1, 0]["cosine"] == pytest.approx(0) and got[1, 0]["mid_distance"] == pytest.approx(2, abs=0.2) and got[1, 0]["mid_spacing"] == pytest.approx(0.25)


def test_best_view_and_occlusion(spark):
    """Two views of one face: the nearer one wins unless its depth shows something in front; equal views go to the first frame."""
    v = spark.createDataFrame([(m, i, x, y, 0.0) for m in (1, 2, 3) for i, (x, y) in enumerate([(0.0, 0.0), (0.0, 1.0), (1.0, 0.0)])], V)
    f = spark.createDataFrame([(m, 0, 0, 1, 2) for m in (1, 2, 3)] + [(3, 1, 0, 2, 1)], FACES)  # wound either way
    pose = lambda m, i, x, z: (m, i, x, 0.3, z, DOWN, 60.0, 64, 64)
    poses = spark.createDataFrame([pose(1, 1, 0.3, 20.0), pose(1, 2, 0.5, 40.0), pose(2, 5, 0.0, 30.0), pose(2, 6, 2 / 3, 30.0), pose(3, 7, 90.0, 20.0), pose(3, 8, 0.3, 600.0)], POSES)
    one = {(r["mission_id"], r["fid"]): r for r in consistency.best_views(v, f, poses).collect()}
    assert {k: r["frame_id"] for k, r in one.items()} == {(1, 0): 1, (2, 0): 5, (3, 0): -1, (3, 1): -1} and one[1, 0]["score"] == pytest.approx(1 / (1 + 20 / 500), abs=1e-3)
    depth = spark.createDataFrame([(1, 1, a, b, 12.0) for a in range(64) for b in range(64)] + [(1, 2, a, b, 40.0) for a in range(64) for b in range(64)], "mission_id long, frame_id long, u int, v int, z double")
    hidden = {(r["mission_id"], r["fid"]): r["frame_id"] for r in consistency.best_views(v, f, poses, depth).collect()}
    assert hidden[1, 0] == 2 and hidden[2, 0] == 5
    small = {(r["mission_id"], r["fid"]): r["frame_id"] for r in consistency.best_views(v, f, poses, depth, cell=3.0).collect()}
    assert small == hidden


def test_views_of_a_plane_agree(spark):
    """Views of z = 0 from 20 m agree to the pixel pitch; a map with a wrong scale does not."""
    poses = spark.createDataFrame([(1, i, 1.0 * i if i < 3 else 50.0, 0.0, 20.0, DOWN, 60.0, 24, 24) for i in range(4)], POSES)
    px = [(1, i, a, b, 20.0 if i != 2 else 21.5) for i in range(3) for a in range(24) for b in range(24)] + [(1, 3, a, 0, 20.0) for a in range(24)]
    depth = spark.createDataFrame(px, "mission_id long, frame_id long, u int, v int, z double")
    pairs = {(r["frame_id"], r["next_frame"]): r for r in consistency.view_disagreement(depth, poses).collect()}
    assert set(pairs) == {(0, 1), (1, 2)}  # frame 3 has too few pixels
    assert pairs[0, 1]["median_nn_m"] < 0.34 and pairs[1, 2]["median_nn_m"] > 1.4 and pairs[0, 1]["separation_m"] == 1
    s = consistency.disagreement_summary(spark.createDataFrame([tuple(r) for r in pairs.values()], "mission_id long, frame_id long, next_frame long, separation_m double, median_nn_m double").withColumn("frame_id", F.col("frame_id"))).first()
    assert s["pairs"] == 2 and s["sep_lt5m"] == s["median_disagreement_m"] and s["sep_gt20m"] is None
