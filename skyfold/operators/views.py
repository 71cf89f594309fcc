"""Points, cameras and depth pixels together.

Poses carry ``frame_id, cx, cy, cz``, the row-major camera-to-world rotation
``r`` (9 values), focal length ``f`` and image size ``width, height``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyfold.functions.stats import clip, norm3
from skyfold.kernels.knn import knn
from skyfold.kernels.quantile import median_mad, quantiles
from skyfold.operators.cloud import VOXEL, estimate_normals, voxels
from skyfold.operators.telemetry import KEY
from skyfold.session import cut, once

# Depth budget share and floor, neighbour cameras.
BUDGET_SHARE = 0.08
NEAREST_CAMERAS = 8
PLACE = [*KEY, "x", "y", "z"]
EVIDENCE = ["observable", "agree", "behind", "closer", "max_shortfall", "min_range"]
POSE = ["cx", "cy", "cz", "r", "f", "width", "height"]


def camera_axes(x: Column, y: Column, z: Column) -> list[Column]:
    """World position in the camera of the joined pose columns."""
    d = [x - F.col("cx"), y - F.col("cy"), z - F.col("cz")]
    return [sum((F.col("r")[3 * j + i] * d[j] for j in range(3)), F.lit(0.0)) for i in range(3)]


def project(pairs: DataFrame) -> DataFrame:
    """Pixel ``u, v``, depth ``zc`` and ``inside`` for rows that hold a point and a pose."""
    a, b, c = camera_axes(F.col("x"), F.col("y"), F.col("z"))
    p = pairs.select("*", a.alias("_a"), b.alias("_b"), c.alias("zc"))
    ok = F.col("zc") > 1e-9
    u = F.when(ok, F.floor(F.col("f") * F.col("_a") / F.col("zc") + F.col("width") / 2))
    v = F.when(ok, F.floor(F.col("f") * F.col("_b") / F.col("zc") + F.col("height") / 2))
    p = p.withColumn("u", u).withColumn("v", v).drop("_a", "_b")
    return p.withColumn("inside", F.coalesce((F.col("u") >= 0) & (F.col("u") < F.col("width")) & (F.col("v") >= 0) & (F.col("v") < F.col("height")), F.lit(False)))


def unproject(depth: DataFrame, poses: DataFrame, voxel: float = 0.5) -> DataFrame:
    """World points of depth pixels with a confidence that falls with the square of depth."""
    j = depth.filter("z > 0").withColumnRenamed("z", "d").join(poses.select(*KEY, "frame_id", *POSE), [*KEY, "frame_id"])
    cam = [(F.col("u") + 0.5 - F.col("width") / 2) * F.col("d") / F.col("f"), (F.col("v") + 0.5 - F.col("height") / 2) * F.col("d") / F.col("f"), F.col("d")]
    world = [sum((F.col("r")[3 * i + k] * cam[k] for k in range(3)), F.col(c)) for i, c in enumerate(("cx", "cy", "cz"))]
    conf = clip(F.exp(-(F.col("d") * F.col("d") / F.col("f") * 0.5) / voxel), 0.05, 1.0)
    return j.select(*KEY, "frame_id", "u", "v", *[e.alias(a) for e, a in zip(world, "xyz")], conf.alias("confidence"))


def nearest_cameras(points: DataFrame, poses: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest cameras of each point: ``point_id, frame_id, rank, range_m``."""
    cams = poses.select(*KEY, "frame_id", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    return knn(points, cams, KEY, k=k, tid="frame_id").select(*KEY, "point_id", F.col("neighbour").alias("frame_id"), "rank", F.col("distance").alias("range_m"))


def min_camera_range(points: DataFrame, poses: DataFrame, floor: float = 0.5) -> DataFrame:
    """Nearest camera range and the depth uncertainty it allows."""
    n = nearest_cameras(points, poses, 1).select(*KEY, "point_id", "range_m")
    return n.withColumn("budget_m", F.greatest(BUDGET_SHARE * F.col("range_m"), F.lit(floor)))


def place_evidence(points: DataFrame, poses: DataFrame, depth: DataFrame, floor: float = 0.5) -> DataFrame:
    """Votes of the nearest cameras about each place that holds points, asked once for all of them: agree, closer or behind its budget."""
    spots = cut(points.groupBy(*PLACE).agg(F.min("point_id").alias("point_id")))
    near = nearest_cameras(spots, poses, NEAREST_CAMERAS).withColumn("least", F.min("range_m").over(Window.partitionBy(*KEY, "point_id")))
    j = near.join(spots, [*KEY, "point_id"]).join(poses.select(*KEY, "frame_id", *POSE), [*KEY, "frame_id"])
    p = project(j)
    seen = p.select(*KEY, "point_id", "frame_id", "least", "zc", F.when(F.col("inside"), F.col("u")).alias("u"), F.when(F.col("inside"), F.col("v")).alias("v"))
    d = depth.filter("z > 0").select(*KEY, "frame_id", "u", "v", F.col("z").alias("zd"))
    e = seen.join(d, [*KEY, "frame_id", "u", "v"], "left").select(*KEY, "point_id", "least", "zd", (F.col("zd") - F.col("zc")).alias("gap"))
    budget = F.greatest(BUDGET_SHARE * F.col("least"), F.lit(floor))
    votes = e.groupBy(*KEY, "point_id").agg(
        F.count("zd").alias("observable"), F.count_if(F.abs("gap") <= budget).alias("agree"), F.count_if(F.col("gap") > budget).alias("behind"),
        F.count_if(F.col("gap") < -budget).alias("closer"), F.coalesce(F.max(-F.col("gap")), F.lit(0.0)).alias("max_shortfall"), F.min("least").alias("min_range"),
    )
    return votes.join(spots, [*KEY, "point_id"]).select(*PLACE, *EVIDENCE)


def cross_view_evidence(points: DataFrame, poses: DataFrame, depth: DataFrame, floor: float = 0.5, also: tuple[str, ...] = ()) -> DataFrame:
    """``place_evidence`` of each point, named by ``point_id``; ``also`` names columns of the points that stay."""
    points = once(points)
    own = points.select(*PLACE, *also, "point_id")
    return own.join(place_evidence(points, poses, depth, floor), PLACE).select(*KEY, *also, "point_id", *EVIDENCE)


def contradicted(evidence: DataFrame) -> DataFrame:
    return evidence.filter("closer >= 1 AND agree <= 0")


def cross_view_summary(evidence: DataFrame, keys: list[str] = KEY) -> DataFrame:
    bad = (F.col("closer") >= 1) & (F.col("agree") <= 0)
    return evidence.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.count_if(F.col("observable") == 0).alias("unobservable"), F.count_if(F.col("agree") >= 1).alias("corroborated"), F.count_if(bad).alias("contradicted"),
        (100 * F.avg((F.col("agree") >= 1).cast("int"))).alias("corroborated_pct"),
    )


def reject_ghosts(points: DataFrame, poses: DataFrame, depth: DataFrame) -> DataFrame:
    """Points without the contradicted ones."""
    points = once(points)
    bad = contradicted(place_evidence(points, poses, depth)).select(*PLACE)
    return points.join(bad, PLACE, "left_anti")


def fuse_depth(depth: DataFrame, poses: DataFrame, size: float) -> DataFrame:
    """Voxel fusion of depth pixels; the most confident pixel of a voxel names its source."""
    p = voxels(unproject(depth, poses, size), size)
    w = F.col("confidence")
    return p.groupBy(*KEY, *VOXEL).agg(
        *[(F.sum(F.col(a) * w) / F.sum(w)).alias(a) for a in "xyz"], F.avg(w).alias("confidence"), F.count(F.lit(1)).alias("observations"),
        F.min(F.struct((-w).alias("c"), "frame_id", "u", "v")).alias("_s"),
    ).select(*KEY, *VOXEL, "x", "y", "z", "confidence", "observations", F.col("_s.frame_id").alias("frame_id"), F.col("_s.u").alias("u"), F.col("_s.v").alias("v"), (F.col("confidence") * F.col("observations")).alias("fusion_weight"))


def depth_stats(depth: DataFrame) -> DataFrame:
    """Value audit per frame."""
    k = [*KEY, "frame_id"]
    good = depth.filter("z > 0 AND NOT isnan(z)")
    a = depth.groupBy(*k).agg(F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("z") < 0).alias("negative"), F.count_if(F.col("z").isNull() | F.isnan("z")).alias("non_finite"))
    b = good.groupBy(*k).agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"), F.stddev_pop("z").alias("z_std"), F.count(F.lit(1)).alias("valid"))
    return a.join(b, k, "left").join(quantiles(good, k, z_median=("z", 0.5)), k, "left").withColumn("invalid_pct", 100 * (1 - F.coalesce("valid", F.lit(0)) / F.col("pixels")))


def depth_pair_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Relative depth agreement of frame pairs; ``a(pair_id, u, v, z)`` is projected, ``b`` measured."""
    j = a.withColumnRenamed("z", "zp").join(b.withColumnRenamed("z", "zm"), [*KEY, "pair_id", "u", "v"]).filter("zm > 0")
    j = once(j.select(*KEY, "pair_id", (F.abs(F.col("zp") - F.col("zm")) / F.col("zm")).alias("rel")))
    k = [*KEY, "pair_id"]
    q = quantiles(j, k, median_rel=("rel", 0.5), p95_rel=("rel", 0.95)).join(j.groupBy(*k).agg(F.count(F.lit(1)).alias("pixels")), k)
    return q.withColumn("passed", (F.col("pixels") >= 100) & (F.col("median_rel") <= 0.35) & (F.col("p95_rel") <= 1.0))


def fit_inverse_depth(obs: DataFrame, rounds: int = 5) -> DataFrame:
    """``1/z = a d + b`` per view with three-sigma rejection; at least 4 points."""
    k = [*KEY, "frame_id"]
    o = cut(obs.filter("z > 0").select(*k, F.col("d").cast("double").alias("d"), (1 / F.col("z")).alias("w")).withColumn("ok", F.lit(True)))
    for i in range(rounds):
        fit = o.filter("ok").groupBy(*k).agg(F.regr_slope("w", "d").alias("a"), F.regr_intercept("w", "d").alias("b"), F.count(F.lit(1)).alias("used")).filter("used >= 4")
        r = o.join(fit, k).withColumn("e", F.col("w") - F.col("a") * F.col("d") - F.col("b"))
        s = r.filter("ok").groupBy(*k).agg(F.stddev_pop("e").alias("s"))
        new = cut(r.join(s, k).withColumn("now", (F.col("s") < 1e-12) | (F.abs("e") <= 3 * F.col("s"))))
        if new.filter("now <> ok").isEmpty():
            break
        o = new.select(*k, "d", "w", F.col("now").alias("ok"))
    return new.groupBy(*k).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("used").alias("used"), F.count(F.lit(1)).alias("total"), F.sqrt(F.avg(F.when(F.col("ok"), F.col("e") ** 2))).alias("rmse"))


def fit_report(fits: DataFrame) -> DataFrame:
    rej = 1 - F.col("used") / F.col("total")
    f = fits.withColumn("few", F.col("total") < 10).withColumn("rejecting", rej > 0.5)
    return f.groupBy(*KEY).agg(F.count(F.lit(1)).alias("views"), F.count_if("few").alias("few_landmarks"), F.count_if("rejecting").alias("heavy_rejection"), F.avg("rmse").alias("mean_rmse"))


def conditioned_points(obs: DataFrame, points: DataFrame, poses: DataFrame, share: float = 0.05) -> DataFrame:
    """Smallest baseline and ray angle among the cameras that observe a point; a point of one camera has baseline 0 and no angle.

    Only pairs inside one point's own track are formed.
    """
    c = obs.join(poses.select(*KEY, "frame_id", "cx", "cy", "cz"), [*KEY, "frame_id"]).join(points.select(*KEY, "point_id", "x", "y", "z"), [*KEY, "point_id"])
    c = once(c.select(*KEY, "point_id", "frame_id", *[(F.col(a) - F.col("c" + a)).alias("d" + a) for a in "xyz"]))
    b = c.select(*KEY, "point_id", F.col("frame_id").alias("other"), *[F.col("d" + a).alias("e" + a) for a in "xyz"])
    p = c.join(b, [*KEY, "point_id"]).filter("frame_id < other")
    every = c.select(*KEY, "point_id").distinct()
    base = norm3(*[F.col("d" + a) - F.col("e" + a) for a in "xyz"])
    dot = sum((F.col("d" + a) * F.col("e" + a) for a in "xyz"), F.lit(0.0))
    la, lb = norm3(*[F.col("d" + a) for a in "xyz"]), norm3(*[F.col("e" + a) for a in "xyz"])
    ang = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (la * lb)))))
    seen = p.groupBy(*KEY, "point_id").agg(F.min(base).alias("min_baseline"), F.min(ang).alias("min_ray_angle_deg"), F.min(F.least(la, lb)).alias("depth"))
    out = every.join(seen, [*KEY, "point_id"], "left").withColumn("min_baseline", F.coalesce("min_baseline", F.lit(0.0)))
    return out.withColumn("conditioned", F.coalesce(F.col("min_baseline") >= share * F.col("depth"), F.lit(False)))


def track_stats(obs: DataFrame) -> DataFrame:
    """Shares of track lengths per mission."""
    n = once(obs.groupBy(*KEY, "point_id").agg(F.count(F.lit(1)).alias("n")))
    a = n.groupBy(*KEY).agg(F.count(F.lit(1)).alias("points"), F.avg("n").alias("mean_length"), *[F.avg((F.col("n") == i).cast("int")).alias(f"share_{i}") for i in (2, 3, 4, 5)], F.avg((F.col("n") >= 6).cast("int")).alias("share_6plus"))
    return a.join(quantiles(n, KEY, median_length=("n", 0.5), p90_length=("n", 0.9)), KEY)


def reprojection_summary(residuals: DataFrame) -> DataFrame:
    a = residuals.groupBy(*KEY).agg(F.avg("residual").alias("mean"), F.max("residual").alias("max"), F.count(F.lit(1)).alias("n"))
    return a.join(quantiles(residuals, KEY, median=("residual", 0.5), p95=("residual", 0.95)), KEY)


def locate_detections(det: DataFrame, depth: DataFrame, poses: DataFrame) -> DataFrame:
    """World position of the box centre of each detection; null without depth."""
    d = det.withColumn("u", F.floor((F.col("u0") + F.col("u1")) / 2)).withColumn("v", F.floor((F.col("v0") + F.col("v1")) / 2))
    w = unproject(depth, poses).select(*KEY, "frame_id", "u", "v", "x", "y", "z")
    return d.join(w, [*KEY, "frame_id", "u", "v"], "left").select(*det.columns, "x", "y", "z")


def depth_ceiling(depth: DataFrame, configured: float) -> DataFrame:
    q = quantiles(depth.filter("z > 0"), KEY, q=("z", 0.995))
    return q.select(*KEY, F.greatest(F.lit(configured), 1.1 * F.col("q")).alias("ceiling"))


def probe_views(points: DataFrame, obs: DataFrame, poses: DataFrame) -> DataFrame:
    """Support and depth ramp over image rows per view."""
    k = [*KEY, "frame_id"]
    p = project(obs.join(points.select(*KEY, "point_id", "x", "y", "z"), [*KEY, "point_id"]).join(poses.select(*k, *POSE), k)).filter("inside")
    p = once(p.select(*k, "v", "zc", "height"))
    a = p.groupBy(*k).agg(F.count(F.lit(1)).alias("support"), (F.abs(F.regr_slope("zc", "v")) * F.first("height")).alias("ramp"))
    return a.join(quantiles(p, k, median_depth=("zc", 0.5)), k).withColumn("usable", (F.col("support") >= 40) & (F.coalesce("ramp", F.lit(0.0)) <= 0.15 * F.col("median_depth")))


def sparse_dense(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """Nearest dense point of every sparse point."""
    n = once(knn(sparse, dense, KEY))
    a = n.groupBy(*KEY).agg(F.count(F.lit(1)).alias("points"), F.sqrt(F.avg(F.col("distance") ** 2)).alias("rmse_m"), F.avg((F.col("distance") <= 3).cast("int")).alias("within_3m"))
    return a.join(quantiles(n, KEY, median_m=("distance", 0.5), p95_m=("distance", 0.95)), KEY)


def detect_layers(points: DataFrame, voxel: float) -> DataFrame:
    """Sheets per XY column of 8 voxels: sorted heights with a gap above 1.5 voxels split a sheet.

    Heights are reduced to occupied bins of a fraction of the gap first, so a
    column of any size becomes few rows; bin extremes keep the gaps exact.
    """
    k = [*KEY, "ix", "iy"]
    fine = voxel * 0.5
    c = points.select(*KEY, F.floor(F.col("x") / (8 * voxel)).alias("ix"), F.floor(F.col("y") / (8 * voxel)).alias("iy"), F.floor(F.col("z") / fine).alias("b"), "z")
    b = once(c.groupBy(*k, "b").agg(F.min("z").alias("lo"), F.max("z").alias("hi"), F.count(F.lit(1)).alias("n")))
    w = Window.partitionBy(*k).orderBy("b")
    g = b.withColumn("gap", F.col("lo") - F.lag("hi").over(w))
    split = F.when(F.col("gap") > 1.5 * voxel, F.col("gap"))
    col = g.groupBy(*k).agg(F.sum("n").alias("points"), (1 + F.count(split)).alias("layers"), F.collect_list(split).alias("gaps"))
    col = once(col.filter("points >= 8"))
    a = col.groupBy(*KEY).agg(F.count(F.lit(1)).alias("columns"), F.sum("points").alias("examined"), F.count_if(F.col("layers") > 1).alias("layered_columns"), (100 * F.sum(F.when(F.col("layers") > 1, F.col("points")).otherwise(0)) / F.sum("points")).alias("layered_pct"))
    gaps = col.select(*KEY, F.explode("gaps").alias("separation"))
    return a.join(quantiles(gaps, KEY, median_separation=("separation", 0.5)), KEY, "left").withColumn("status", F.when(F.col("examined") < 500, "insufficient").otherwise("measured"))


def layer_origin(dense_pct: Column, mesh_pct: Column) -> Column:
    """Where double layers come from."""
    return F.when((dense_pct >= 5) & (mesh_pct >= 5), "A").when(dense_pct >= 5, "B").when(mesh_pct >= 5, "C").otherwise("D")
