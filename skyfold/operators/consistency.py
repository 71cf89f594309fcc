"""Agreement between views, between a mesh and its cloud, and which view shows a face."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from skyfold.functions.stats import norm3
from skyfold.kernels.knn import knn
from skyfold.operators.mesh import corners, face_geometry
from skyfold.operators.telemetry import KEY
from skyfold.operators.views import POSE, camera_axes, unproject
from skyfold.session import once

# Pixels a view needs, borders of the separation buckets in metres; limits of a bridge; reach, angle and depth slack of a view.
LEAST_PIXELS = 50
BUCKETS = [("sep_lt5m", 0.0, 5.0), ("sep_5_20m", 5.0, 20.0), ("sep_gt20m", 20.0, float("inf"))]
BRIDGE_COS = 0.5
BRIDGE_EMPTY = 0.75
SPACING_NEIGHBOURS = 4
VIEW_REACH = 500.0
LEAST_COS = 0.1
DEPTH_SLACK = (1.02, 0.05)
NEAREST_DEPTH = 0.01
STEEP, EDGE = 1e-3, 1e-6  # least slope of a ray that meets a height for certain; rounding of the box of a view


def view_disagreement(depth: DataFrame, poses: DataFrame, least: int = LEAST_PIXELS) -> DataFrame:
    """``frame_id, next_frame, separation_m, median_nn_m``: how far the surface of a view lies from that of the next one.

    All pairs of consecutive frames of a mission in which both have ``least`` pixels; the pair is part of the key of one neighbour
    search, in which every pixel of the first view looks for the second view's nearest point.
    """
    at = once(unproject(depth, poses).withColumn("pid", F.col("v") * F.lit(1 << 20) + F.col("u")))
    full = at.groupBy(*KEY, "frame_id").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*KEY).orderBy("frame_id")
    cams = poses.select(*KEY, "frame_id", "cx", "cy", "cz").join(full, [*KEY, "frame_id"])
    nxt = lambda c: F.lead(c).over(order)
    apart = norm3(*[F.col(c) - nxt(c) for c in ("cx", "cy", "cz")])
    pairs = cams.select(*KEY, "frame_id", nxt("frame_id").alias("next_frame"), apart.alias("separation_m"), "n", nxt("n").alias("n2"))
    pairs = once(pairs.filter((F.col("n") >= least) & (F.col("n2") >= least)).select(*KEY, "frame_id", "next_frame", "separation_m"))
    a = at.join(pairs.select(*KEY, "frame_id"), [*KEY, "frame_id"]).withColumnRenamed("frame_id", "pair")
    b = at.join(pairs.select(*KEY, F.col("next_frame").alias("frame_id"), F.col("frame_id").alias("pair")), [*KEY, "frame_id"])
    near = knn(a, b, [*KEY, "pair"], qid="pid", tid="pid").groupBy(*KEY, "pair").agg(F.percentile("distance", 0.5).alias("median_nn_m"))
    return pairs.join(near.withColumnRenamed("pair", "frame_id"), [*KEY, "frame_id"])


def disagreement_summary(pairs: DataFrame) -> DataFrame:
    """Median and 95th percentile over the pairs of a mission, and the median in each bucket of camera separation."""
    m, s = F.col("median_nn_m"), F.col("separation_m")
    return pairs.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("pairs"), F.percentile(m, 0.5).alias("median_disagreement_m"), F.percentile(m, 0.95).alias("p95_disagreement_m"),
        *[F.percentile(F.when((s >= lo) & (s < hi), m), 0.5).alias(name) for name, lo, hi in BUCKETS],
    )


def bridge_faces(v: DataFrame, f: DataFrame, cloud: DataFrame, gap: float, cos: float = BRIDGE_COS, empty: float = BRIDGE_EMPTY) -> DataFrame:
    """Faces with ``longest, cosine, mid_distance, mid_spacing, bridge``: those that close a gap between two sheets of the cloud.

    A bridge has an edge longer than ``gap``, stands across the normals of the cloud at its corners, and has nothing of the cloud near
    the middle of its longest edge, measured by the cloud's own spacing there.  ``cloud(point_id, x, y, z, nx, ny, nz)``.
    """
    cloud = once(cloud.select(*KEY, "point_id", *"xyz", "nx", "ny", "nz"))
    near = knn(cloud, cloud, KEY, k=SPACING_NEIGHBOURS, exclude_self=True)
    spacing = near.groupBy(*KEY, "point_id").agg(F.percentile(F.when(F.col("distance") > 0, F.col("distance")).otherwise(F.lit(float("inf"))), 0.5).alias("spacing"))
    spaced = once(cloud.join(spacing, [*KEY, "point_id"], "left"))
    at = knn(v.select(*KEY, "vid", *"xyz"), cloud, KEY, qid="vid", carry=["nx", "ny", "nz"]).select(*KEY, "vid", "nx", "ny", "nz")
    own = face_geometry(v, f).select(*KEY, "fid", "longest", *[F.col(c).alias(f"f{c}") for c in ("nx", "ny", "nz")])
    c = corners(v, f.select(*KEY, "fid", "v0", "v1", "v2"))
    edges = [F.struct(norm3(*[F.col(f"{x}{i}") - F.col(f"{x}{j}") for x in "xyz"]).alias("d"), F.lit(-k).alias("k"), *[((F.col(f"{x}{i}") + F.col(f"{x}{j}")) / 2).alias(x) for x in "xyz"]) for k, (i, j) in enumerate(((1, 0), (2, 1), (0, 2)))]
    mids = c.select(*KEY, "fid", F.greatest(*edges).alias("e")).select(*KEY, "fid", *[F.col(f"e.{x}").alias(x) for x in "xyz"])
    mid = knn(mids, spaced, KEY, qid="fid", carry=["spacing"]).select(*KEY, "fid", F.col("distance").alias("mid_distance"), F.col("spacing").alias("mid_spacing"))
    each = f.select(*KEY, "fid", F.explode(F.array("v0", "v1", "v2")).alias("vid")).join(at, [*KEY, "vid"]).groupBy(*KEY, "fid").agg(*[F.avg(n).alias(n) for n in ("nx", "ny", "nz")])
    length = norm3(F.col("nx"), F.col("ny"), F.col("nz")) + 1e-30
    cosine = F.abs(F.col("fnx") * F.col("nx") + F.col("fny") * F.col("ny") + F.col("fnz") * F.col("nz")) / length
    j = own.join(each, [*KEY, "fid"]).join(mid, [*KEY, "fid"]).withColumn("cosine", cosine)
    hollow = (F.col("mid_distance") > empty * F.col("mid_spacing")) & (F.col("mid_spacing") < float("inf"))
    return j.select(*KEY, "fid", "longest", "cosine", "mid_distance", "mid_spacing", ((F.col("longest") > gap) & (F.col("cosine") < cos) & hollow).alias("bridge"))


def best_views(v: DataFrame, f: DataFrame, poses: DataFrame, depth: DataFrame | None = None, reach: float = VIEW_REACH, cell: float | None = None) -> DataFrame:
    """``fid, frame_id, score`` of the view that shows each face best; frame -1 where none does.

    A view counts if its camera is nearer than ``reach``, the face looks at it, its centre lies inside the image and is not behind the
    view's depth there.  The score is the cosine over 1 + depth / reach; ties go to the first frame.  Faces look to the side of the
    mean camera.  Candidates come from cells of the ground: a camera enters the cells that its image can show up to ``reach``, and of
    these, if all its corners look up or all down, only those where it shows heights that faces of the mission have.
    """
    g = face_geometry(v, f).select(*KEY, "fid", "cx", "cy", "cz", "nx", "ny", "nz").toDF(*KEY, "fid", "x", "y", "z", "nx", "ny", "nz")
    mean = poses.groupBy(*KEY).agg(*[F.avg(c).alias(f"k{c[1]}") for c in ("cx", "cy", "cz")])
    g = g.join(mean, KEY)
    turn = F.when(sum(((F.col(f"k{a}") - F.col(a)) * F.col(f"n{a}") for a in "xyz"), F.lit(0.0)) < 0, -1.0).otherwise(1.0)
    g = once(g.select(*KEY, "fid", *"xyz", *[(turn * F.col(f"n{a}")).alias(f"n{a}") for a in "xyz"]))
    # the box of a view: its camera and the corners of its image at the reach
    size = cell or reach / 4
    rays = [[s * F.col("width") / 2 / F.col("f"), t * F.col("height") / 2 / F.col("f"), F.lit(1.0)] for s in (-1, 1) for t in (-1, 1)]
    far = [[sum((F.col("r")[3 * i + k] * ray[k] for k in range(3)), F.lit(0.0)) * reach + F.col(c) for i, c in enumerate(("cx", "cy"))] for ray in rays]
    lo = [F.greatest(F.least(F.col(c), *[p[i] for p in far]), F.col(c) - reach) for i, c in enumerate(("cx", "cy"))]
    hi = [F.least(F.greatest(F.col(c), *[p[i] for p in far]), F.col(c) + reach) for i, c in enumerate(("cx", "cy"))]
    # where the rays through the corners meet the lowest and the highest face; all that is seen between lies in the hull of these points
    turned = lambda ray, i: sum((F.col("r")[3 * i + k] * ray[k] for k in range(3)), F.lit(0.0))
    slopes = [turned(ray, 2) for ray in rays]
    sure = (F.least(*slopes) > STEEP) | (F.greatest(*slopes) < -STEEP)
    meets = [F.greatest(F.lit(0.0), (F.col(h) - F.col("cz")) / F.when(sure, s)) for h in ("_lo", "_hi") for s in slopes]
    shown = [[F.col(c) + t * turned(ray, i) for t, ray in zip(meets, rays + rays)] for i, c in enumerate(("cx", "cy"))]
    lo = [F.when(sure, F.greatest(a, F.least(*p))).otherwise(a) for a, p in zip(lo, shown)]
    hi = [F.when(sure, F.least(a, F.greatest(*p))).otherwise(a) for a, p in zip(hi, shown)]
    first, last = [F.floor((a - EDGE) / size) for a in lo], [F.floor((a + EDGE) / size) for a in hi]
    span = lambda i: F.explode(F.sequence(first[i], F.greatest(first[i], last[i])))
    heights = g.groupBy(*KEY).agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    cams = poses.select(*KEY, "frame_id", *POSE).join(F.broadcast(heights), KEY).withColumn("gx", span(0)).withColumn("gy", span(1)).drop("_lo", "_hi")
    # a camera enters many cells, which the estimated size of its table does not show: shuffled, not broadcast
    j = g.withColumn("gx", F.floor(F.col("x") / size)).withColumn("gy", F.floor(F.col("y") / size)).join(cams.hint("merge"), [*KEY, "gx", "gy"])
    away = norm3(*[F.col(f"c{a}") - F.col(a) for a in "xyz"])
    cosine = sum(((F.col(f"c{a}") - F.col(a)) * F.col(f"n{a}") for a in "xyz"), F.lit(0.0)) / F.when(F.col("_far") > 0, F.col("_far"))
    a, b, c = camera_axes(F.col("x"), F.col("y"), F.col("z"))
    j = j.withColumn("_far", away).filter((F.col("_far") < reach) & (F.col("_far") > 1e-9)).withColumn("_cos", cosine).filter(F.col("_cos") > LEAST_COS)
    j = j.select(*KEY, "fid", "frame_id", "_cos", "width", "height", "f", a.alias("_a"), b.alias("_b"), c.alias("_d")).filter(F.col("_d") > NEAREST_DEPTH)
    u, w = F.col("f") * F.col("_a") / F.col("_d") + F.col("width") / 2, F.col("f") * F.col("_b") / F.col("_d") + F.col("height") / 2
    j = j.withColumn("_u", u).withColumn("_v", w).filter("_u >= 0 AND _u < width - 1 AND _v >= 0 AND _v < height - 1")
    if depth is not None:
        # a view without any depth map hides nothing; where it has one, a pixel without depth shows nothing
        has = depth.select(*KEY, "frame_id").distinct().withColumn("_map", F.lit(True))
        px = depth.filter("z > 0").select(*KEY, "frame_id", F.col("u").cast("long").alias("_pu"), F.col("v").cast("long").alias("_pv"), F.col("z").alias("_z"))
        j = j.withColumn("_pu", F.floor(F.col("_u"))).withColumn("_pv", F.floor(F.col("_v")))
        j = j.join(has, [*KEY, "frame_id"], "left").join(px, [*KEY, "frame_id", "_pu", "_pv"], "left")
        j = j.filter(F.col("_map").isNull() | (F.col("_d") <= F.col("_z") * DEPTH_SLACK[0] + DEPTH_SLACK[1]))
    best = j.groupBy(*KEY, "fid").agg(F.max(F.struct((F.col("_cos") / (1 + F.col("_d") / reach)).alias("score"), (-F.col("frame_id")).alias("k"))).alias("b"))
    return f.select(*KEY, "fid").join(best, [*KEY, "fid"], "left").select(*KEY, "fid", F.coalesce(-F.col("b.k"), F.lit(-1)).cast("long").alias("frame_id"), F.coalesce("b.score", F.lit(0.0)).alias("score"))
