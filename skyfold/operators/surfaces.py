"""Voxel merge that keeps surfaces apart: sibling groups around seed planes, refined on consensus planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyfold.functions.stats import clip
from skyfold.operators.cloud import VOXEL, voxels
from skyfold.operators.telemetry import KEY
from skyfold.operators.views import POSE, unproject
from skyfold.session import cut, once

NORMAL = ["nx", "ny", "nz"]
AT = [*KEY, *VOXEL]

# Least cosine to the plane's normal, reach from the plane in voxels, refinement rounds, largest step between pixels of one surface.
LEAST_COS = 0.5
REACH = 0.5
ROUNDS = 3
STEP = 0.10


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _off(prefix: str, size: float) -> Column:
    """Whether a row does not belong to the joined plane ``<prefix>x .. <prefix>nz``."""
    n = [F.col(prefix + c) for c in NORMAL]
    away = _dot([F.col(c) - F.col(prefix + c) for c in "xyz"], n)
    return (_dot([F.col(c) for c in NORMAL], n) < LEAST_COS) | (F.abs(away) > REACH * size)


def _seeded(rows: DataFrame, size: float, first: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``sib``: per voxel the most confident row is a plane, rows near it share its number, and so on with the rest.

    A round is a mergeable maximum by voxel and a join back, so a voxel may hold any share of the rows; there are as many rounds as
    surfaces in the fullest voxel.  ``first(.., base)`` gives the number to start with.
    """
    rest, done, k = rows.drop("sib"), None, 0
    if first is not None:
        rest = rest.join(first, AT)
    else:
        rest = rest.withColumn("base", F.lit(0))
    while True:
        best = F.max_by(F.struct(*"xyz", *NORMAL), F.struct("confidence", (-F.col("point_id")).alias("p")))
        seed = rest.groupBy(*AT).agg(best.alias("s")).select(*AT, *[F.col(f"s.{c}").alias(f"_{c}") for c in ("x", "y", "z", *NORMAL)])
        met = cut(rest.join(seed, AT).withColumn("off", _off("_", size)).select(*rest.columns, "off"))
        near = met.filter(~F.col("off")).drop("off").withColumn("sib", F.col("base") + k)
        done = near if done is None else done.unionByName(near)
        rest = met.filter("off").drop("off")
        k += 1
        if not rest.take(1):
            return done.drop("base")


def separate_surfaces(points: DataFrame, size: float, rounds: int = ROUNDS) -> DataFrame:
    """``points(mission_id, point_id, x, y, z, nx, ny, nz, confidence)`` with voxel and sibling number ``sib`` within it.

    Rows of a voxel belong together if their normals differ by 60 degrees at most and they lie within half a voxel of the plane.  The first
    planes are those of the most confident rows; then up to ``rounds`` times each sibling's mean and normal is its plane, and rows off
    it leave for new siblings.  Rows without a normal (null, or shorter than a half) split nothing and stay with sibling 0.
    """
    length = F.sqrt(_dot([F.col(c) for c in NORMAL], [F.col(c) for c in NORMAL]))
    unit = [F.when(length > 0.5, F.col(c) / length).alias(c) for c in NORMAL]
    rows = once(voxels(points, size).select(*AT, "point_id", "x", "y", "z", "confidence", *unit))
    plain = rows.filter("nx IS NULL").withColumn("sib", F.lit(0))
    sided = _seeded(rows.filter("nx IS NOT NULL"), size)
    for _ in range(rounds):
        sided = cut(sided)
        w = F.col("confidence")
        own = plain.select(*AT, "sib", *"xyz", "confidence", *NORMAL).unionByName(sided.select(*AT, "sib", *"xyz", "confidence", *NORMAL))
        total = F.sum(w)
        mean = own.groupBy(*AT, "sib").agg(*[(F.sum(F.col(c) * w) / F.when(total > 0, total).otherwise(1.0)).alias(f"_{c}") for c in "xyz"], *[F.coalesce(F.sum(F.col(c) * w), F.lit(0.0)).alias(f"_{c}") for c in NORMAL])
        length = F.sqrt(_dot([F.col(f"_{c}") for c in NORMAL], [F.col(f"_{c}") for c in NORMAL]))
        plane = mean.select(*AT, "sib", *[f"_{c}" for c in "xyz"], *[(F.col(f"_{c}") / length).alias(f"_{c}") for c in NORMAL], (length > 1e-6).alias("_has"))
        met = once(sided.join(plane, [*AT, "sib"]).withColumn("off", F.col("_has") & _off("_", size)).select(*sided.columns, "off"))
        leave = met.filter("off").drop("off")
        if not leave.take(1):
            break
        base = met.groupBy(*AT).agg((F.max("sib") + 1).alias("base"))
        sided = met.filter(~F.col("off")).drop("off").unionByName(_seeded(leave, size, base))
    return sided.unionByName(plain)


def voxel_merge_surfaces(points: DataFrame, size: float) -> DataFrame:
    """One point per surface and voxel: weighted centre, unit normal (zero where no row has one), confidence, observations and spread.

    Sums are taken from the voxel's corner, so large coordinates do not cancel in the spread.
    """
    p = separate_surfaces(points, size)
    w, n = F.col("confidence"), F.count(F.lit(1))
    total = F.sum(w)
    safe = F.when(total > 0, total).otherwise(1.0)
    local = {c: F.col(c) - F.col(v) * size for c, v in zip("xyz", VOXEL)}
    spread = sum((F.avg(d * d) - F.avg(d) * F.avg(d) for d in local.values()), F.lit(0.0))
    g = p.groupBy(*AT, "sib").agg(*[(F.sum(d * w) / safe).alias(c) for c, d in local.items()], *[F.coalesce(F.sum(F.col(c) * w), F.lit(0.0)).alias(c) for c in NORMAL], clip(total / n).alias("confidence"), n.alias("observations"), F.sqrt(F.greatest(spread, F.lit(0.0))).alias("residual"))
    length = F.sqrt(_dot([F.col(c) for c in NORMAL], [F.col(c) for c in NORMAL]))
    return g.select(*AT, "sib", *[(F.col(v) * size + F.col(c)).alias(c) for c, v in zip("xyz", VOXEL)], *[F.when(length > 1e-9, F.col(c) / length).otherwise(0.0).alias(c) for c in NORMAL], "confidence", "observations", "residual")


def depth_normals(depth: DataFrame, poses: DataFrame) -> DataFrame:
    """``nx, ny, nz`` of depth pixels from the four pixels around them, towards the camera; null at the rim, at gaps and at steps over a tenth.

    Neighbours come from two windows, over the rows and over the columns of a frame.
    """
    px = depth.filter("z > 0").select(*KEY, "frame_id", "u", "v", "z")
    for axis, other, low, high in (("u", "v", "l", "r"), ("v", "u", "t", "b")):
        w = Window.partitionBy(*KEY, "frame_id", other).orderBy(axis)
        for name, by in ((low, -1), (high, 1)):
            px = px.withColumn(f"z{name}", F.when(F.lag(axis, -by).over(w) == F.col(axis) + by, F.lag("z", -by).over(w)))
    for name in "lrtb":
        px = px.filter(F.lit(True)).withColumn(f"z{name}", F.when(F.abs(F.col(f"z{name}") - F.col("z")) <= STEP * F.col("z"), F.col(f"z{name}")))
    j = px.join(poses.select(*KEY, "frame_id", *POSE), [*KEY, "frame_id"])

    def at(du: int, dv: int, z: str) -> list[Column]:
        z = F.col(z)
        return [(F.col("u") + du + 0.5 - F.col("width") / 2) * z / F.col("f"), (F.col("v") + dv + 0.5 - F.col("height") / 2) * z / F.col("f"), z]

    a = [p - q for p, q in zip(at(1, 0, "zr"), at(-1, 0, "zl"))]
    b = [p - q for p, q in zip(at(0, 1, "zb"), at(0, -1, "zt"))]
    n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    j = j.select("*", *[c.alias(f"_{i}") for i, c in enumerate(n)], *[c.alias(f"_p{i}") for i, c in enumerate(at(0, 0, "z"))])
    n = [F.col(f"_{i}") for i in range(3)]
    length = F.sqrt(_dot(n, n))
    away = F.when(_dot(n, [F.col(f"_p{i}") for i in range(3)]) > 0, -1.0).otherwise(1.0)  # the camera stands at the origin
    world = [sum((F.col("r")[3 * i + k] * n[k] for k in range(3)), F.lit(0.0)) * away / length for i in range(3)]
    return j.select(*KEY, "frame_id", "u", "v", *[F.when(length > 1e-12, c).alias(name) for name, c in zip(NORMAL, world)])


def fuse_depth_surfaces(depth: DataFrame, poses: DataFrame, size: float) -> DataFrame:
    """Fusion of depth pixels that keeps surfaces of one voxel apart; the most confident pixel of each names its source."""
    pid = F.xxhash64("frame_id", "u", "v").alias("point_id")
    raw = unproject(depth, poses, size).join(depth_normals(depth, poses), [*KEY, "frame_id", "u", "v"], "left")
    raw = once(raw.select(*KEY, "frame_id", "u", "v", pid, "x", "y", "z", "confidence", *NORMAL))
    own = separate_surfaces(raw, size)
    w = F.col("confidence")
    j = own.drop("confidence").join(raw.select(*KEY, "point_id", "frame_id", "u", "v", "confidence"), [*KEY, "point_id"])
    return j.groupBy(*AT, "sib").agg(
        *[(F.sum(F.col(a) * w) / F.sum(w)).alias(a) for a in "xyz"], F.avg(w).alias("confidence"), F.count(F.lit(1)).alias("observations"), F.min(F.struct((-w).alias("c"), "frame_id", "u", "v")).alias("_s"),
    ).select(*AT, "sib", "x", "y", "z", "confidence", "observations", F.col("_s.frame_id").alias("frame_id"), F.col("_s.u").alias("u"), F.col("_s.v").alias("v"), (F.col("confidence") * F.col("observations")).alias("fusion_weight"))
