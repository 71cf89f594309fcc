"""Best views of faces: cells of cameras that look any way, and what the query reads."""

import math

from check import DATA, compare, duck
from skyfold.operators import consistency, views
from skyfold.plans import QUERIES, SQL, derive, q_consistency


def test_cells_lose_no_view(spark):
    """Cameras of all tilts: narrow cells give what one cell for everything gives."""
    v = spark.createDataFrame([(0, 50 * i + j, i * 2.0, j * 2.0, ((i * j) % 5) * 0.7) for i in range(20) for j in range(20)], "mission_id long, vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 50 * i + j, 50 * i + j, 50 * i + j + 1, 50 * i + j + 50) for i in range(19) for j in range(19)], "mission_id long, fid long, v0 long, v1 long, v2 long")
    cams = []
    for k in range(24):
        tilt, turn = math.radians(k * 15), math.radians(k * 40)
        c, s, p, q = math.cos(tilt), math.sin(tilt), math.cos(turn), math.sin(turn)
        r = [p, -q * c, q * s, q, p * c, -p * s, 0.0, s, c]
        cams.append((0, k, (k % 5) * 8.0, (k % 7) * 5.0, 2.0 + k % 4 * 6.0, r, 40.0, 64, 48))
    poses = spark.createDataFrame(cams, "mission_id long, frame_id long, cx double, cy double, cz double, r array<double>, f double, width int, height int")
    rows = lambda cell: {(x["fid"], x["frame_id"]) for x in consistency.best_views(v, f, poses, reach=60.0, cell=cell).collect()}
    got = rows(3.0)
    assert got == rows(1e6) and len({k for _, k in got}) > 3


def test_query_makes_no_cloud(spark):
    t = derive.Tables(spark, str(DATA / "sf0.001"))
    v, f = q_consistency.mesh(t)
    assert "points" not in vars(t) and "fid" in f.columns and "vid" in v.columns
    name = "i15_best_views"
    assert compare(QUERIES[name](spark, t.sf_dir).toPandas(), duck(t.sf_dir).execute(SQL[name]).df()) is None


def test_nothing_that_grows_is_broadcast(spark):
    """Vertices, faces and the cells of cameras are shuffled; only rows for each mission may be broadcast."""
    t = derive.Tables(spark, str(DATA / "sf0.001"))
    cells = consistency.best_views(*q_consistency.mesh(t), q_consistency.poses(t), cell=20.0)
    for df, keys in ((cells, ("gx", "gy")), (consistency.face_geometry(*q_consistency.mesh(t)), ("v0", "v1", "v2", "vid"))):
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "HashJoin" in x]
        assert not [x for x in joins if any(f"{k}#" in x.split("],")[0] for k in keys)]


def test_cameras_are_asked_once_per_place(spark, monkeypatch):
    """Points of one place share its votes, whatever their epoch; the search meets places, not points."""
    asked = []
    nearest = views.nearest_cameras
    monkeypatch.setattr(views, "nearest_cameras", lambda points, *a: asked.append(points.count()) or nearest(points, *a))
    rows = [(1, "ab"[i % 2], i, float(i % 4), float(i % 3), 2.0) for i in range(120)]
    p = spark.createDataFrame(rows, "mission_id long, epoch string, point_id long, x double, y double, z double")
    r = [1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0]
    cams = spark.createDataFrame([(1, i, 0.5 * i, 1.0, 60.0, r, 60.0, 64, 64) for i in range(9)], "mission_id long, frame_id long, cx double, cy double, cz double, r array<double>, f double, width int, height int")
    depth = spark.createDataFrame([(1, i, u, v, 57.0 + i) for i in range(9) for u in range(64) for v in range(0, 64, 2)], "mission_id long, frame_id long, u long, v long, z double")
    e = views.cross_view_evidence(p, cams, depth, also=("epoch",)).toPandas().sort_values("point_id").reset_index(drop=True)
    assert asked == [12] and list(e["point_id"]) == list(range(120)) and list(e["epoch"]) == [r[1] for r in rows]
    votes = e[["observable", "agree", "behind", "closer"]].assign(place=e["point_id"] % 12)
    assert len(votes.drop_duplicates()) == 12 and votes["observable"].max() > 0
    assert (e["agree"] + e["behind"] + e["closer"] == e["observable"]).all()
    kept = views.reject_ghosts(p, cams, depth).toPandas()
    assert set(kept["point_id"]) == set(e.loc[~((e["closer"] >= 1) & (e["agree"] <= 0)), "point_id"])
