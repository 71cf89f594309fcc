"""Rasters, terrain and site analysis on sparse long tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from skyfold.kernels.hull import convex_hull, hull_area
from skyfold.kernels.quantile import quantiles
from skyfold.operators.telemetry import KEY
from skyfold.session import once

# Cell sizes of coarse layers, support floors.
NICE_CELLS = [2.0, 5.0, 10.0, 20.0, 25.0, 50.0, 100.0]
MIN_POINTS = 3
PER_ERROR_CELL = 4


def nice_cell(target):
    e = F.lit(NICE_CELLS[-1])
    for s in reversed(NICE_CELLS):
        e = F.when(F.lit(s * s) >= target, s).otherwise(e)
    return e


def grid_meta(points: DataFrame, gsd: float | None = None, spacing: DataFrame | None = None) -> DataFrame:
    """Bounds, cell size and shape per mission; the raster is sparse, so its extent costs nothing."""
    m = points.groupBy(*KEY).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    m = m.withColumn("gsd", F.lit(float(gsd))) if gsd else m.join(spacing, KEY, "left").withColumn("gsd", F.coalesce("spacing", F.lit(1.0))).drop("spacing")
    count = lambda a: (F.floor((F.col(f"{a}1") - F.col(f"{a}0")) / F.col("gsd")) + 1).cast("long")
    return m.withColumn("rows", count("y")).withColumn("cols", count("x"))


def rasterise(points: DataFrame, gsd: float) -> tuple[DataFrame, DataFrame]:
    """Highest z per north-up cell as a sparse table, with its meta rows."""
    meta = grid_meta(points, gsd)
    j = points.join(meta, KEY)
    col = F.least(F.col("cols") - 1, F.greatest(F.lit(0), ((F.col("x") - F.col("x0")) / F.col("gsd")).cast("long")))
    row = F.least(F.col("rows") - 1, F.greatest(F.lit(0), ((F.col("y1") - F.col("y")) / F.col("gsd")).cast("long")))
    grid = j.groupBy(*KEY, row.alias("row"), col.alias("col")).agg(F.max("z").alias("height"), F.count(F.lit(1)).alias("n"))
    return grid, meta


def ground_spacing(points: DataFrame) -> DataFrame:
    """Typical horizontal spacing: median distance to the nearest point at another place; 1 where there is none."""
    from skyfold.kernels.knn import knn

    points = once(points)
    near = knn(points, points, KEY, dims=("x", "y"), k=1, exclude_self=True).filter("distance > 0")
    med = quantiles(near, KEY, nn=("distance", 0.5))
    return points.select(*KEY).distinct().join(med, KEY, "left").select(*KEY, F.coalesce("nn", F.lit(1.0)).alias("spacing"))


def sample_grid(points: DataFrame, grid: DataFrame, meta: DataFrame, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """Bilinear raster height under each point with all four corners present: ``ground``."""
    j = points.join(meta, KEY)
    c, r = (F.col("x") + dx - F.col("x0")) / F.col("gsd"), (F.col("y1") - F.col("y") - dy) / F.col("gsd")
    j = j.withColumn("_c", c).withColumn("_r", r).filter("_c >= 0 AND _c < cols - 1 AND _r >= 0 AND _r < rows - 1")
    c0, r0 = F.floor("_c"), F.floor("_r")
    fc, fr = F.col("_c") - c0, F.col("_r") - r0
    corners = F.array(
        F.struct(r0.alias("row"), c0.alias("col"), ((1 - fc) * (1 - fr)).alias("w")),
        F.struct(r0.alias("row"), (c0 + 1).alias("col"), (fc * (1 - fr)).alias("w")),
        F.struct((r0 + 1).alias("row"), c0.alias("col"), ((1 - fc) * fr).alias("w")),
        F.struct((r0 + 1).alias("row"), (c0 + 1).alias("col"), (fc * fr).alias("w")),
    )
    e = j.select(*KEY, "point_id", "z", F.explode(corners).alias("k")).select(*KEY, "point_id", "z", "k.*")
    return (
        e.join(grid.select(*KEY, "row", "col", "height"), [*KEY, "row", "col"])
        .groupBy(*KEY, "point_id")
        .agg(F.first("z").alias("z"), F.sum(F.col("w") * F.col("height")).alias("ground"), F.count(F.lit(1)).alias("_hits"))
        .filter("_hits = 4")
        .drop("_hits")
    )


def dsm_error(points: DataFrame, grid: DataFrame, meta: DataFrame, dx: float = 0.0, dy: float = 0.0, least: int = 500) -> DataFrame:
    """Vertical error of the points on the raster after removing the median offset."""
    s = once(sample_grid(points, grid, meta, dx, dy).withColumn("res", F.col("z") - F.col("ground")))
    med = quantiles(s, KEY, offset_m=("res", 0.5))
    d = s.join(med, KEY).withColumn("dev", F.abs(F.col("res") - F.col("offset_m")))
    d = once(d)
    p = quantiles(d, KEY, p95_m=("dev", 0.95))
    total = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    a = d.groupBy(*KEY).agg(F.avg("dev").alias("mae_m"), F.count(F.lit(1)).alias("hits"))
    j = total.join(a, KEY, "left").join(med, KEY, "left").join(p, KEY, "left").fillna(0, ["hits"])
    enough = F.col("hits") >= least
    return j.select(*KEY, "hits", (F.col("hits") / F.col("_n")).alias("coverage"), *[F.when(enough, F.col(c)).alias(c) for c in ("offset_m", "mae_m", "p95_m")], F.when(enough, "measured").otherwise("insufficient").alias("status"))


def occupancy_cells(points: DataFrame, cell: float = 1.0) -> DataFrame:
    """Cells counted from the lower corner of the mission, last cell closed."""
    b = points.groupBy(*KEY).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    b = b.withColumn("nx", F.greatest(F.lit(1), F.ceil((F.col("x1") - F.col("x0")) / cell))).withColumn("ny", F.greatest(F.lit(1), F.ceil((F.col("y1") - F.col("y0")) / cell)))
    j = points.join(b, KEY)
    ix = F.least(F.col("nx") - 1, ((F.col("x") - F.col("x0")) / cell).cast("long"))
    iy = F.least(F.col("ny") - 1, ((F.col("y") - F.col("y0")) / cell).cast("long"))
    return j.groupBy(*KEY, ix.alias("ix"), iy.alias("iy")).agg(F.count(F.lit(1)).alias("points"), *[F.first(c).alias(c) for c in ("x0", "y0", "nx", "ny")])


def occupancy(points: DataFrame, cell: float = 1.0) -> DataFrame:
    """Modelled area per mission."""
    a = cell * cell
    full = F.count_if(F.col("points") >= MIN_POINTS)
    return occupancy_cells(points, cell).groupBy(*KEY).agg(
        full.alias("occupied_cells"), (full * a).alias("area_m2"), (full * a / 1e4).alias("area_ha"), (full * a / 1e6).alias("area_km2"), (F.count(F.lit(1)) * a).alias("any_point_area_m2")
    )


def coarse_occupancy(points: DataFrame, cell: float = 1.0, max_cells: int = 4000) -> DataFrame:
    c = occupancy_cells(points, cell)
    size = F.greatest(nice_cell(F.col("nx") * cell * F.col("ny") * cell / max_cells), F.lit(cell))
    c = c.withColumn("f", F.greatest(F.lit(1), F.round(size / cell)).cast("long"))
    return c.groupBy(*KEY, F.floor(F.col("ix") / F.col("f")).alias("ix"), F.floor(F.col("iy") / F.col("f")).alias("iy")).agg(
        F.sum("points").alias("points"), (F.first("f") * cell).alias("cell_m")
    ).filter(F.col("points") >= MIN_POINTS)


def hull(points: DataFrame, cell: float = 1.0) -> DataFrame:
    """Outline of the occupied cells in cell units and its area in square metres."""
    c = occupancy_cells(points, cell).filter(F.col("points") >= MIN_POINTS)
    return hull_area(convex_hull(c, KEY), KEY).withColumn("area", F.col("area") * cell * cell)


def elevation(points: DataFrame) -> DataFrame:
    at = F.struct("x", "y", "z")
    b = points.groupBy(*KEY).agg(
        F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.avg("z").alias("z_mean"), F.count(F.lit(1)).alias("points"),
        F.min(F.struct("z", "x", "y")).alias("_l"), F.max(F.struct("z", "x", "y")).alias("_h"),
    )
    q = quantiles(points, KEY, z_median=("z", 0.5), z_p005=("z", 0.005), z_p995=("z", 0.995))
    return b.join(q, KEY).select(
        *KEY, "points", "z_min", "z_max", (F.col("z_max") - F.col("z_min")).alias("relief"), "z_mean", "z_median", "z_p005", "z_p995",
        F.col("_l.x").alias("low_x"), F.col("_l.y").alias("low_y"), F.col("_h.x").alias("high_x"), F.col("_h.y").alias("high_y"),
    )


def elevation_histogram(points: DataFrame, bins: int = 24) -> DataFrame:
    """Equal-width bins, the last one closed."""
    b = points.groupBy(*KEY).agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    i = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("z") - F.col("lo")) / width))).otherwise(0)
    return points.join(b, KEY).groupBy(*KEY, i.cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("points"))


def error_grid(corr: DataFrame, cell: float = 2.0) -> DataFrame:
    """Median and p95 residual per supported cell; ``corr(mission_id, x, y, residual)``."""
    corr = once(corr)
    b = corr.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.greatest(F.max("x") - F.min("x"), F.lit(1.0)) * F.greatest(F.max("y") - F.min("y"), F.lit(1.0))).alias("fp"))
    b = b.withColumn("cell_m", F.greatest(F.lit(cell), nice_cell(F.col("fp") * PER_ERROR_CELL / F.col("n"))))
    j = corr.join(b, KEY).select(*KEY, "residual", "cell_m", F.floor((F.col("x") - F.col("x0")) / F.col("cell_m")).alias("ix"), F.floor((F.col("y") - F.col("y0")) / F.col("cell_m")).alias("iy"))
    j = once(j)
    k = [*KEY, "ix", "iy"]
    n = j.groupBy(*k).agg(F.count(F.lit(1)).alias("points"), F.first("cell_m").alias("cell_m"))
    return n.join(quantiles(j, k, median_m=("residual", 0.5), p95_m=("residual", 0.95)), k)


def error_grid_summary(cells: DataFrame) -> DataFrame:
    cells = once(cells)
    ok = cells.filter(F.col("points") >= MIN_POINTS)
    q = quantiles(ok, KEY, p50_median_m=("median_m", 0.5), p95_median_m=("median_m", 0.95), p99_median_m=("median_m", 0.99))
    a = cells.groupBy(*KEY).agg(
        F.count_if(F.col("points") >= MIN_POINTS).alias("measured_cells"), F.count_if(F.col("points") < MIN_POINTS).alias("dropped_cells"),
        F.min(F.when(F.col("points") >= MIN_POINTS, F.col("median_m"))).alias("min_median_m"), F.max(F.when(F.col("points") >= MIN_POINTS, F.col("median_m"))).alias("max_median_m"),
    )
    return a.join(q, KEY, "left")


def density(points: DataFrame, cell: float = 1.0) -> DataFrame:
    """Points per modelled square metre."""
    c = occupancy_cells(points, cell).groupBy(*KEY).agg(F.sum("points").alias("points"), (F.count_if(F.col("points") >= MIN_POINTS) * cell * cell).alias("area_m2"))
    return c.withColumn("points_per_m2", F.try_divide("points", "area_m2"))


def site_summary(points: DataFrame, cell: float = 1.0, anchor: DataFrame | None = None) -> DataFrame:
    """One row per mission: modelled area, outline area, box, centre of the occupied cells, heights and density.

    With ``anchor(mission_id, lat0, lon0, alt0)`` the centre also has ``lat, lon``, on the level of the lowest point, and units are
    metres; without one (for all or for a mission) they are units of the reconstruction.
    """
    from skyfold.operators.track import to_wgs84

    points = once(points)
    own = occupancy_cells(points, cell).filter(F.col("points") >= MIN_POINTS)
    centre = own.groupBy(*KEY).agg(*[(F.first(f"{a}0") + (F.avg(f"i{a}") + 0.5) * cell).alias(f"centre_{a}") for a in "xy"], F.max("nx").alias("nx"), F.max("ny").alias("ny"))
    box = points.groupBy(*KEY).agg(*[g(a).alias(f"{n}_{a}") for a in "xy" for n, g in (("lo", F.min), ("hi", F.max))], F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    s = box.join(occupancy(points, cell), KEY).join(hull(points, cell).select(*KEY, F.col("area").alias("outline_area_m2")), KEY, "left").join(centre, KEY, "left")
    s = s.join(elevation(points).select(*KEY, "points", "z_min", "z_max", "relief", "z_mean", "z_median", "z_p005", "z_p995"), KEY)
    s = s.withColumn("centre_x", F.coalesce("centre_x", "_mx")).withColumn("centre_y", F.coalesce("centre_y", "_my"))
    s = s.select(
        *KEY, "occupied_cells", (F.col("nx") * F.col("ny")).alias("extent_cells"), "area_m2", "area_ha", "any_point_area_m2", "outline_area_m2", "lo_x", "lo_y", "hi_x", "hi_y", (F.col("hi_x") - F.col("lo_x")).alias("size_x"), (F.col("hi_y") - F.col("lo_y")).alias("size_y"),
        "centre_x", "centre_y", "points", "z_min", "z_max", "relief", "z_mean", "z_median", F.col("z_p005").alias("robust_min"), F.col("z_p995").alias("robust_max"), (F.col("z_p995") - F.col("z_p005")).alias("robust_relief"), F.try_divide("points", "area_m2").alias("points_per_m2"),
    )
    if anchor is None:
        return s.withColumn("lat", F.lit(None).cast("double")).withColumn("lon", F.lit(None).cast("double")).withColumn("units", F.lit("reconstruction_units"))
    at = to_wgs84(s.select(*KEY, F.col("centre_x").alias("e"), F.col("centre_y").alias("n"), F.col("z_min").alias("u")), anchor).select(*KEY, "lat", "lon")
    return s.join(at, KEY, "left").withColumn("units", F.when(F.col("lat").isNotNull(), "meters").otherwise("reconstruction_units"))
