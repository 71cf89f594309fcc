"""Point clouds: voxel merges, filters, footprints, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyfold.functions.stats import clip, grade, norm3
from skyfold.kernels.hull import convex_hull, hull_area
from skyfold.kernels.knn import covariance, folded, mean_distance, median_distance
from skyfold.kernels.moments import eigen_sym3
from skyfold.kernels.quantile import quantiles, with_quantiles
from skyfold.operators.telemetry import KEY
from skyfold.operators.track import GRADES
from skyfold.session import once

VOXEL = ["vx", "vy", "vz"]
PLACE = ["x", "y", "z"]


def voxels(df: DataFrame, size: float) -> DataFrame:
    return df.select("*", *[F.floor(F.col(a) / size).alias(v) for a, v in zip("xyz", VOXEL)])


def _weighted(col: str, w: Column, safe: Column) -> Column:
    return F.sum(F.col(col) * w) / safe


def voxel_merge(points: DataFrame, size: float) -> DataFrame:
    """One point per voxel from raw measurements; the spread is summed from the voxel's corner, so large coordinates do not cancel."""
    w = F.col("confidence") if "confidence" in points.columns else F.lit(1.0)
    total = F.sum(w)
    safe = F.when(total > 0, total).otherwise(1.0)
    n = F.count(F.lit(1))
    local = [F.col(a) - F.col(v) * size for a, v in zip("xyz", VOXEL)]
    sq = F.avg(sum(d * d for d in local))
    mean2 = sum(F.avg(d) * F.avg(d) for d in local)
    colour = [F.round(_weighted(c, w, safe)).cast("long").alias(c) for c in "rgb" if c in points.columns]
    return voxels(points, size).groupBy(*KEY, *VOXEL).agg(
        *[_weighted(c, w, safe).alias(c) for c in "xyz"], *colour,
        clip(total / n).alias("confidence"), n.alias("observations"),
        F.sqrt(F.greatest(sq - mean2, F.lit(0.0))).alias("residual"),
    )


def voxel_downsample(points: DataFrame, size: float) -> DataFrame:
    """Merge an already fused cloud and keep its provenance."""
    v = once(voxels(points, size))
    w, total = F.col("confidence"), F.sum("confidence")
    safe = F.when(total > 0, total).otherwise(1.0)
    normals = [n for n in ("nx", "ny", "nz") if n in points.columns]
    cell = v.groupBy(*KEY, *VOXEL).agg(
        *[_weighted(c, w, safe).alias(f"c{c}") for c in "xyz"],
        F.sum("observations").alias("observations_"), (total / F.count(F.lit(1))).alias("confidence_"),
        *[F.sum(F.col(n) * w).alias(f"s{n}") for n in normals],
    )
    d2 = sum(F.pow(F.col(c) - F.col(f"c{c}"), 2) for c in "xyz")
    spread = v.join(cell, [*KEY, *VOXEL]).groupBy(*KEY, *VOXEL).agg(
        F.sqrt(F.avg(F.pow(F.coalesce("residual", F.lit(0.0)), 2) + d2)).alias("residual")
    )
    out = cell.join(spread, [*KEY, *VOXEL])
    length = norm3(*[F.col(f"s{n}") for n in normals]) if normals else None
    return out.select(
        *KEY, *VOXEL, *[F.col(f"c{c}").alias(c) for c in "xyz"], F.col("confidence_").alias("confidence"),
        F.col("observations_").alias("observations"), "residual",
        *[F.when(length > 1e-9, F.col(f"s{n}") / length).otherwise(0.0).alias(n) for n in normals],
    )


def min_confidence(points: DataFrame, floor: float) -> DataFrame:
    return points.filter(F.col("confidence") >= floor) if "confidence" in points.columns else points


def statistical_outliers(points: DataFrame, k: int = 20, ratio: float = 2.0, keys: list[str] = KEY) -> DataFrame:
    """Points with ``mean_nn`` and ``keep``: within mean + ratio * deviation of the cloud, which ``keys`` name."""
    points = once(points)
    near = folded(points, keys, k, mean_distance(k), others=True).withColumnRenamed("mean", "mean_nn")
    mean = once(points.select(*keys, "point_id", *PLACE).join(near, [*keys, *PLACE]).select(*keys, "point_id", "mean_nn"))
    lim = mean.groupBy(*keys).agg(F.avg("mean_nn").alias("_m"), F.stddev_pop("mean_nn").alias("_s"), F.count(F.lit(1)).alias("_n"))
    j = mean.join(lim, keys)
    small = (F.col("_n") < k + 1) | (F.col("_s") == 0)
    j = j.select(*keys, "point_id", "mean_nn", (small | (F.col("mean_nn") <= F.col("_m") + ratio * F.col("_s"))).alias("keep"))
    return points.join(j, [*keys, "point_id"], "left").withColumn("keep", F.coalesce("keep", F.lit(True)))


def radius_outliers(points: DataFrame, radius: float = 0.4, least: int = 5) -> DataFrame:
    """Points with ``neighbours`` (self included) inside the radius and ``keep``.

    Coincident points are counted as one weighted position, and cells of
    ``radius / sqrt(3)`` hold only mutual neighbours: a cell with ``least``
    points settles all its members without a pair being formed.
    """
    at = ["x", "y", "z"]
    pos = once(points.groupBy(*KEY, *at).agg(F.count(F.lit(1)).alias("_c")))
    cell = radius / 3**0.5 * 0.999999
    g = [F.floor(F.col(a) / cell).alias(v) for a, v in zip(at, VOXEL)]
    pos = pos.select("*", *g)
    full = pos.groupBy(*KEY, *VOXEL).agg(F.sum("_c").alias("_full"))
    pos = once(pos.join(full, [*KEY, *VOXEL]))
    open_ = pos.filter(F.col("_full") < least)
    steps = F.sequence(F.lit(-2), F.lit(2))
    asked = open_.select(*KEY, *at, *VOXEL)
    for v in VOXEL:
        asked = asked.withColumn("_s", F.explode(steps)).withColumn(v, F.col(v) + F.col("_s")).drop("_s")
    other = pos.select(*KEY, *VOXEL, "_c", "_full", *[F.col(a).alias(f"_{a}") for a in at])
    d2 = sum(F.pow(F.col(a) - F.col(f"_{a}"), 2) for a in at)
    hit = asked.join(other, [*KEY, *VOXEL]).filter(d2 <= radius * radius).groupBy(*KEY, *at).agg(F.sum("_c").alias("_near"))
    kept = pos.join(hit, [*KEY, *at], "left").select(
        *KEY, *at, ((F.col("_full") >= least) | (F.coalesce("_near", F.lit(0)) >= least)).alias("keep")
    )
    return points.join(kept, [*KEY, *at])


def filter_cloud(points: DataFrame, size: float | None = 0.5, k: int = 20, ratio: float = 2.0, radius: float = 0.4, least: int = 5, floor: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Voxel, statistical, radius and confidence filters; the cloud and the counts per stage."""
    stages = [("input", points)]
    cur = points
    if size:
        cur = voxel_downsample(cur, size).withColumn("point_id", F.xxhash64(*KEY, *VOXEL)).drop(*VOXEL)
        stages.append(("voxel", cur := once(cur)))
    cur = once(statistical_outliers(cur, k, ratio).filter("keep").drop("keep", "mean_nn"))
    stages.append(("statistical", cur))
    cur = once(radius_outliers(cur, radius, least).filter("keep").drop("keep"))
    stages.append(("radius", cur))
    cur = min_confidence(cur, floor)
    stages.append(("confidence", cur))
    counts = None
    for i, (name, d) in enumerate(stages):
        c = d.groupBy(*KEY).agg(F.count(F.lit(1)).alias("points")).select(*KEY, F.lit(i).alias("step"), F.lit(name).alias("stage"), "points")
        counts = c if counts is None else counts.unionByName(c)
    return cur, counts


def footprint(points: DataFrame, size: float) -> DataFrame:
    """Occupied XY columns with centre and count."""
    ix, iy = F.floor(F.col("x") / size).alias("ix"), F.floor(F.col("y") / size).alias("iy")
    c = points.groupBy(*KEY, ix, iy).agg(F.count(F.lit(1)).alias("points"))
    return c.select("*", ((F.col("ix") + 0.5) * size).alias("cx"), ((F.col("iy") + 0.5) * size).alias("cy"))


def _with_threshold(cells: DataFrame) -> DataFrame:
    stats = quantiles(cells, KEY, _med=("points", 0.5)).join(cells.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_cells")), KEY)
    return cells.join(stats, KEY).withColumn("threshold", F.greatest(F.lit(1.0), 0.5 * F.col("_med"))).drop("_med")


def weak_regions(points: DataFrame, size: float, top: int = 10) -> DataFrame:
    """The most thinly covered columns of each mission with at least 8 cells."""
    c = _with_threshold(once(footprint(points, size))).filter("n_cells >= 8 AND points < threshold")
    w = Window.partitionBy(*KEY).orderBy("points", "ix", "iy")
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(*KEY, "rank", "cx", "cy", "points")


def dense_quality(points: DataFrame, size: float, noise_percent: float = 0.0) -> DataFrame:
    """Spacing, coverage, occlusion, confidence and residual in one score per mission."""
    points = once(points)
    space = nearest_distance(points).groupBy(*KEY).agg(F.avg("distance").alias("mean_spacing"))
    cells = once(footprint(points, size))
    hull = hull_area(convex_hull(cells, KEY), KEY)
    box = cells.groupBy(*KEY).agg(((F.max("ix") - F.min("ix") + 1) * (F.max("iy") - F.min("iy") + 1)).alias("_box"))
    occ = _with_threshold(cells).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("points") < F.col("threshold")).alias("sparse_cells"))
    base = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("point_count"), F.avg("confidence").alias("mean_confidence"), F.avg("residual").alias("_res"))
    j = base.join(space, KEY, "left").join(occ, KEY).join(hull, KEY).join(box, KEY)
    total = F.when(F.col("n_cells") < 3, F.greatest(F.lit(1), F.col("n_cells"))).when(
        F.col("corners") >= 3, F.greatest(F.col("n_cells"), F.round("area").cast("long"))
    ).otherwise(F.greatest(F.lit(1), F.col("_box")))
    j = j.withColumn("coverage_percent", 100.0 * F.col("n_cells") / total).withColumn("occlusion_percent", 100.0 * F.col("sparse_cells") / F.col("n_cells"))
    score = 100.0 * (
        0.30 * clip(F.col("coverage_percent") / 100) + 0.25 * clip(F.col("mean_confidence"))
        + 0.15 * clip(1 - F.coalesce("mean_spacing", F.lit(0.0)) / (2.0 * size)) + 0.15 * clip(1 - F.col("_res") / size)
        + 0.15 * clip(F.lit(1 - noise_percent / 100))
    )
    j = j.withColumn("dense_score", score)
    return j.select(*KEY, "point_count", "mean_spacing", "mean_confidence", "coverage_percent", "occlusion_percent", "sparse_cells", "dense_score", grade(F.col("dense_score"), GRADES, "Poor").alias("grade"))


def dense_confidence(points: DataFrame, voxel: float) -> DataFrame:
    c = 0.6 * (1 - F.exp(-F.col("observations") / 3.0)) + 0.4 * F.exp(-F.col("residual") / voxel)
    return points.withColumn("confidence", c)


def confidence_class(c: Column) -> Column:
    return F.when(c >= 0.7, "high").when(c >= 0.45, "medium").when(c >= 0.25, "low").otherwise("very_low")


def confidence_classes(points: DataFrame) -> DataFrame:
    names = ["high", "medium", "low", "very_low"]
    cls = confidence_class(F.col("confidence"))
    return points.groupBy(*KEY).agg(*[F.count_if(cls == n).alias(n) for n in names])


def twin_measurements(points: DataFrame) -> DataFrame:
    size = {a: F.max(a) - F.min(a) for a in "xyz"}
    return points.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("points"), F.avg("confidence").alias("mean_confidence"),
        *[f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))],
        size["x"].alias("length"), size["y"].alias("width"), size["z"].alias("height"), (size["x"] * size["y"]).alias("footprint_area"),
    )


def nearest_distance(points: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Distance of every point to its nearest other point."""
    points = once(points)
    near = folded(points, keys, 1, mean_distance(1), others=True)
    return points.select(*keys, "point_id", *PLACE).join(near, [*keys, *PLACE]).select(*keys, "point_id", F.col("mean").alias("distance"))


def spacing_stats(points: DataFrame) -> DataFrame:
    """Percentiles of the nearest-neighbour distance."""
    return quantiles(nearest_distance(points), KEY, p50=("distance", 0.5), p90=("distance", 0.9), p95=("distance", 0.95), p99=("distance", 0.99))


def spacing_field(points: DataFrame, k: int = 6, keys: list[str] = KEY) -> DataFrame:
    """Median distance to the k nearest points, zero distances dropped."""
    points = once(points)
    near = folded(points, keys, k, median_distance(k), others=True)
    return points.select(*keys, "point_id", *PLACE).join(near, [*keys, *PLACE]).select(*keys, "point_id", F.col("median").alias("spacing"))


def spacing_summary(spacing: DataFrame, keys: list[str] = KEY) -> DataFrame:
    spacing = once(spacing)
    q = quantiles(spacing, keys, p05=("spacing", 0.05), median=("spacing", 0.5), p95=("spacing", 0.95), _lo=("spacing", 0.005), _hi=("spacing", 0.995))
    inner = spacing.join(q, keys).filter("spacing BETWEEN _lo AND _hi").groupBy(*keys).agg(F.min("spacing").alias("robust_min"), F.max("spacing").alias("robust_max"))
    mean = spacing.groupBy(*keys).agg(F.avg("spacing").alias("mean"), F.count(F.lit(1)).alias("points"))
    return q.drop("_lo", "_hi").join(inner, keys).join(mean, keys).withColumn("density", 1 / F.pow("median", 3))


def estimate_normals(points: DataFrame, k: int = 20, viewpoint: tuple[float, float, float] = (0.0, 0.0, 1e6), keys: list[str] = KEY) -> DataFrame:
    """Unit normals from the k nearest points, turned towards the viewpoint."""
    points = once(points)
    near = folded(points, keys, k, covariance(), others=False).filter("n >= 3")
    c = near.withColumn("e", eigen_sym3(F.array("xx", "xy", "xz", "yy", "yz", "zz"))).select(*keys, *PLACE, *[F.col("e.vectors")[i].alias(n) for i, n in enumerate(("nx", "ny", "nz"))])
    j = points.drop("nx", "ny", "nz").join(once(c), [*keys, *PLACE], "left")
    away = sum((F.lit(v) - F.col(a)) * F.col(n) for v, a, n in zip(viewpoint, "xyz", ("nx", "ny", "nz"))) < 0
    flip = F.when(away, -1.0).otherwise(1.0)
    return j.select(*[x for x in points.columns if x not in ("nx", "ny", "nz")], *[(F.col(n) * flip).alias(n) for n in ("nx", "ny", "nz")])
