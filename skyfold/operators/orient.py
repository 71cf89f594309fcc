"""Which way is up, where the ground lies along it, and which way the flight ran."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyfold.kernels.moments import covariance3, eigen_sym3
from skyfold.kernels.quantile import quantiles
from skyfold.operators.telemetry import KEY
from skyfold.session import cut, once

# Share of the lowest points, least inliers, ratio of spreads of a corridor, alignment of shell and cameras, trials.
BAND = 0.35
LEAST_INLIERS = 0.25
LEAST_AGREEMENT = 0.5
LEAST_POINTS = 50
CORRIDOR_RATIO = 1.8
SHELL_ALIGNMENT = 0.8
SHELL_POINTS = 100
TRIALS = 200
DRAWS = 4  # hash orders that give the trials

UP = ["ux", "uy", "uz"]


def _dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _unit(v: list[Column], least: float = 1e-9) -> list[Column]:
    length = F.sqrt(_dot(v, v))
    return [F.when(length > least, c / length) for c in v]


def _axis(k: int) -> list[Column]:
    """Vector ``k`` of the eigenvectors in ``e``."""
    return [F.col("e.vectors")[3 * k + i] for i in range(3)]


def _fields(v: list[Column], name: str) -> Column:
    return F.when(v[0].isNotNull(), F.struct(*[c.alias(a) for c, a in zip(v, "xyz")])).alias(name)


def camera_priors(poses: DataFrame) -> DataFrame:
    """``axis`` (mean viewing direction), ``image_up`` (mean of the image's upper edge), mean place and number of the cameras of a mission."""
    mean = lambda sign, i: [sign * F.avg(F.col("r")[3 * j + i]) for j in range(3)]
    g = poses.groupBy(*KEY).agg(*[c.alias(f"a{i}") for i, c in enumerate(mean(1, 2))], *[c.alias(f"b{i}") for i, c in enumerate(mean(-1, 1))], *[F.avg(c).alias(f"m{c}") for c in ("cx", "cy", "cz")], F.count(F.lit(1)).alias("cameras"))
    return g.select(*KEY, _fields(_unit([F.col(f"a{i}") for i in range(3)]), "axis"), _fields(_unit([F.col(f"b{i}") for i in range(3)]), "image_up"), "mcx", "mcy", "mcz", "cameras")


def enu_vertical(alignment: DataFrame) -> DataFrame:
    """Up in scene axes from ``alignment(mission_id, m)``, row-wise 4 x 4 matrices from scene to east, north, up.

    A matrix counts only as a rotation times one positive scale; a mirror or a sheared one gives nothing.
    """
    m = [[F.col("m")[4 * i + j] for j in range(3)] for i in range(3)]
    det = m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    scale = F.when(det > 0, F.pow(det, F.lit(1 / 3)))
    off = [F.abs(_dot(m[i], m[j]) / (scale * scale) - (1.0 if i == j else 0.0)) for i in range(3) for j in range(i, 3)]
    ok = scale.isNotNull() & (F.greatest(*off) <= 1e-3)
    return alignment.filter(ok).select(*KEY, _fields(_unit(m[2]), "enu"))


def scene_vertical(points: DataFrame, poses: DataFrame, alignment: DataFrame | None = None) -> DataFrame:
    """The signed vertical ``ux, uy, uz`` of every mission with points or cameras, and the ``prior`` that gave it.

    In this order: the vertical of the alignment; the normal of the shell that the points form, towards the cameras, if the cameras look
    along it (or there are none); the upper edge of the images; the axis of the points' smallest extent.
    """
    cams = camera_priors(poses)
    shape = points.groupBy(*KEY).agg(*[(F.max(a) - F.min(a)).alias(f"e{a}") for a in "xyz"])
    c = cut(covariance3(points.select(*KEY, *"xyz"), KEY).withColumn("e", eigen_sym3("cov")))
    j = shape.join(c, KEY).join(cams, KEY, "full")
    if alignment is not None:
        j = j.join(enu_vertical(alignment), KEY, "full")
    else:
        j = j.withColumn("enu", F.lit(None).cast("struct<x:double,y:double,z:double>"))
    w = [F.col("e.values")[i] for i in range(3)]
    planarity = 1 - w[0] / F.greatest(w[1], F.lit(1e-12))
    n = _axis(0)
    seen = F.col("cameras") >= 3
    away = _dot([F.col("mcx") - F.col("mx"), F.col("mcy") - F.col("my"), F.col("mcz") - F.col("mz")], n) < 0
    sheet = [F.when(F.coalesce(F.col("n") >= SHELL_POINTS, F.lit(False)) & (w[0] + w[1] + w[2] > 0), F.when(F.coalesce(seen & away, F.lit(False)), -v).otherwise(v)) for v in n]
    j = j.withColumn("sheet", _fields(sheet, "sheet")).withColumn("planarity", planarity)
    facing = F.abs(_dot([F.col(f"sheet.{a}") for a in "xyz"], [F.col(f"axis.{a}") for a in "xyz"]))
    j = j.withColumn("facing", facing)
    least = F.least(F.col("ex"), F.col("ey"), F.col("ez"))
    extent = F.when(least.isNotNull(), F.struct(*[F.when(F.col(f"e{a}") == least, 1.0).otherwise(0.0).alias(a) for a in "xyz"]))
    first = F.when(F.col("ex") == least, F.struct(F.lit(1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))).when(F.col("ey") == least, F.struct(F.lit(0.0).alias("x"), F.lit(1.0).alias("y"), F.lit(0.0).alias("z"))).otherwise(extent)
    shell = F.col("sheet").isNotNull() & (F.col("axis").isNull() | (F.col("facing") >= SHELL_ALIGNMENT))
    prior = F.when(F.col("enu").isNotNull(), "enu_vertical").when(shell, "camera_facing_surface").when(F.col("image_up").isNotNull(), "camera_image_up").when(least.isNotNull(), "smallest_extent_axis").otherwise("unavailable")
    up = F.when(F.col("enu").isNotNull(), F.col("enu")).when(shell, F.col("sheet")).when(F.col("image_up").isNotNull(), F.col("image_up")).otherwise(first)
    return j.select(*KEY, up.alias("u"), prior.alias("prior"), "planarity", "facing").select(*KEY, *[F.col(f"u.{a}").alias(f"u{a}") for a in "xyz"], "prior", "planarity", "facing")


def _planes(band: DataFrame) -> DataFrame:
    """Planes ``trial, a, b, c, d`` through three points each, drawn by hashes of ``point_id``: no point twice in one order."""
    per = TRIALS // DRAWS
    drawn = None
    for k in range(DRAWS):
        w = Window.partitionBy(*KEY).orderBy(F.xxhash64("point_id", F.lit(k)), "point_id")
        one = band.select(*KEY, "point_id", *"xyz").withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= 3 * per).withColumn("trial", F.floor((F.col("_i") - 1) / 3) + k * per)
        drawn = one if drawn is None else drawn.unionByName(one)
    t = drawn.groupBy(*KEY, "trial").agg(F.sort_array(F.collect_list(F.struct("_i", *"xyz"))).alias("p")).filter(F.size("p") == 3)
    p = [[F.get("p", F.lit(i))[a] for a in "xyz"] for i in range(3)]
    u, v = ([q - o for q, o in zip(p[i], p[0])] for i in (1, 2))
    n = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    n = _unit(n, 1e-12)
    return t.select(*KEY, "trial", *[c.alias(a) for c, a in zip(n, "abc")], (-_dot(n, p[0])).alias("d")).dropna(subset=["a"])


def band_plane(points: DataFrame, vertical: DataFrame) -> DataFrame:
    """Ground normal ``gx, gy, gz`` from the lowest BAND of ``points(mission_id, point_id, x, y, z)`` along the vertical.

    TRIALS planes through three drawn points count their inliers (within a 300th of the band's extent) in one pass; the one with the most is
    refitted by least squares on them.  Where fewer than LEAST_INLIERS of the band fit it, or it stands steep to the vertical, the
    vertical itself is the normal: ``method`` says which.
    """
    up = vertical.filter("ux IS NOT NULL").select(*KEY, *UP)
    rows = once(points.select(*KEY, "point_id", *"xyz").join(up, KEY).withColumn("_h", _dot([F.col(a) for a in "xyz"], [F.col(u) for u in UP])))
    band = once(rows.join(quantiles(rows, KEY, _q=("_h", BAND)), KEY).filter(F.col("_h") <= F.col("_q")).select(*KEY, "point_id", *"xyz", *UP))
    size = band.groupBy(*KEY).agg(F.count(F.lit(1)).alias("band_points"), F.greatest(F.sqrt(sum(((F.max(a) - F.min(a)) ** 2 for a in "xyz"), F.lit(0.0))) / 300, F.lit(1e-4)).alias("_t")).filter(F.col("band_points") >= LEAST_POINTS)
    size = once(size)
    off = F.abs(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("c") * F.col("z") + F.col("d"))
    votes = band.join(size, KEY).join(_planes(band), KEY).filter(off < F.col("_t")).groupBy(*KEY, "trial", *"abcd").agg(F.count(F.lit(1)).alias("_v"))
    best = votes.groupBy(*KEY).agg(F.max(F.struct("_v", (-F.col("trial")).alias("t"), *"abcd")).alias("b")).filter(F.col("b._v") >= LEAST_POINTS).select(*KEY, *[F.col(f"b.{c}").alias(c) for c in "abcd"])
    held = band.join(size, KEY).join(best, KEY).filter(off < F.col("_t"))
    fit = cut(covariance3(held.select(*KEY, *"xyz"), KEY).withColumn("e", eigen_sym3("cov")))
    n = _axis(0)
    plane = fit.join(up, KEY)
    sign = F.when(_dot(n, [F.col(u) for u in UP]) < 0, -1.0).otherwise(1.0)
    plane = plane.select(*KEY, *[(sign * c).alias(g) for c, g in zip(n, ("gx", "gy", "gz"))], *["mx", "my", "mz"])
    g = [F.col(c) for c in ("gx", "gy", "gz")]
    dist = _dot([F.col(a) - F.col(f"m{a}") for a in "xyz"], g)
    near = band.join(size, KEY).join(plane, KEY).withColumn("_d", dist).filter(F.abs(F.col("_d")) < F.col("_t"))
    stats = near.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_in"), F.stddev_pop("_d").alias("rms_m"))
    j = up.join(size.select(*KEY, "band_points"), KEY, "left").join(plane, KEY, "left").join(stats, KEY, "left")
    agreement, share = _dot(g, [F.col(u) for u in UP]), F.col("_in") / F.col("band_points")
    good = F.coalesce((share >= LEAST_INLIERS) & (agreement >= LEAST_AGREEMENT), F.lit(False))
    return j.select(*KEY, *[F.when(good, F.col(c)).otherwise(F.col(u)).alias(c) for c, u in zip(("gx", "gy", "gz"), UP)], F.when(good, "geometry_plane_fit").otherwise("up_prior").alias("method"), share.alias("inlier_share"), "rms_m", agreement.alias("agreement"))


def corridor_axis(cameras: DataFrame, normal: DataFrame, order: str = "frame_id", least: int = 5, ratio: float = CORRIDOR_RATIO) -> DataFrame:
    """Main direction ``hx, hy, hz`` of a flight in the plane of ``normal(mission_id, nx, ny, nz)``; null where it has none.

    ``cameras(mission_id, cx, cy, cz)`` are laid on the plane; the direction of their largest spread counts if that is ``ratio`` times the
    next one, and points from the first half of the flight to the second.
    """
    from skyfold.kernels.ordered import with_running
    from skyfold.operators.telemetry import row_block

    n = [F.col(c) for c in ("nx", "ny", "nz")]
    high = _dot([F.col(c) for c in ("cx", "cy", "cz")], n)
    flat = cameras.select(*KEY, order, "cx", "cy", "cz").join(normal.select(*KEY, "nx", "ny", "nz"), KEY)
    flat = once(with_running(flat.select(*KEY, order, *[(F.col(f"c{a}") - high * m).alias(a) for a, m in zip("xyz", n)]), KEY, [order], row_block(order), rank="_i", total="_n"))
    late = F.col("_i") > F.floor(F.col("_n") / 2)
    half = flat.groupBy(*KEY).agg(F.count(F.lit(1)).alias("cameras"), *[(F.avg(F.when(late, F.col(a))) - F.avg(F.when(~late, F.col(a)))).alias(f"s{a}") for a in "xyz"])
    c = cut(covariance3(flat.select(*KEY, *"xyz"), KEY).withColumn("e", eigen_sym3("cov")))
    w = [F.col("e.values")[i] for i in range(3)]
    h = _axis(2)
    j = c.join(half, KEY).withColumn("ratio", F.when(F.col("cameras") >= least, w[2] / F.greatest(w[1], F.lit(1e-12))))
    sign = F.when(_dot(h, [F.col(f"s{a}") for a in "xyz"]) < 0, -1.0).otherwise(1.0)
    good = F.coalesce(F.col("ratio") >= ratio, F.lit(False))
    return j.select(*KEY, "cameras", "ratio", *[F.when(good, sign * v).alias(f"h{a}") for v, a in zip(h, "xyz")])
