"""Placement of a reconstruction on a height raster: shift search with coverage rivalry, and a gate against rolled rasters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyfold.kernels.quantile import quantiles
from skyfold.operators.telemetry import KEY
from skyfold.session import cut, once

# Steps and reach of the search in metres, points a shift must hit, share of the best coverage, rolls and limit of the gate.
LEVELS = ((100.0, 3000.0), (20.0, 120.0), (5.0, 25.0))
LEAST_HITS = 500
KEEP_COVERAGE = 0.6
ROLLS = 5
GATE = 0.8
#: Residuals of the search are counted in whole centimetres, so that a shift has a bounded table of counts.
BIN_M = 0.01
OFF_BORDER = 1.234e-7  # of a bin: keeps values off the border between two bins, where the last bit would decide


def patches(grid: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """The four corner heights ``h0, h1, h2, h3`` right of and below each raster cell that has them all."""
    parts = [F.struct((F.col("row") - a).alias("row"), (F.col("col") - b).alias("col"), F.lit(2 * a + b).alias("k")) for a in (0, 1) for b in (0, 1)]
    e = grid.select(*keys, "height", F.explode(F.array(*parts)).alias("p")).select(*keys, "p.*", "height")
    corners = e.groupBy(*keys, "row", "col").agg(*[F.max(F.when(F.col("k") == k, F.col("height"))).alias(f"h{k}") for k in range(4)])
    return corners.dropna(subset=["h0", "h1", "h2", "h3"])


def ground(rows: DataFrame, patch: DataFrame, meta: DataFrame, x: Column, y: Column, keys: list[str] = KEY) -> DataFrame:
    """Rows that lie on the raster at ``x, y`` with the bilinear height ``ground``; one equi-join on the raster cell."""
    j = rows.join(meta.select(*KEY, "x0", "y1", "gsd", "rows", "cols"), KEY).withColumn("_c", (x - F.col("x0")) / F.col("gsd")).withColumn("_r", (F.col("y1") - y) / F.col("gsd"))
    j = j.filter("_c >= 0 AND _c < cols - 1 AND _r >= 0 AND _r < rows - 1").withColumn("row", F.floor("_r")).withColumn("col", F.floor("_c"))
    j = j.join(patch, [*keys, "row", "col"])
    fc, fr = F.col("_c") - F.col("col"), F.col("_r") - F.col("row")
    z = F.col("h0") * (1 - fc) * (1 - fr) + F.col("h1") * fc * (1 - fr) + F.col("h2") * (1 - fc) * fr + F.col("h3") * fc * fr
    return j.select(*rows.columns, z.alias("ground"))


def _level(points: DataFrame, patch: DataFrame, meta: DataFrame, centre: DataFrame, step: float, span: float, least: int) -> DataFrame:
    """Hits and spread ``i, j, hits, mad`` of all shifts around ``centre(bx, by)`` that hit at least ``least`` points.

    Points are summed to cells of half a step first: what meets the shifts is cells, ``(2 span / step + 1) ** 2`` times, and of that
    only counts of whole centimetres leave a task.
    """
    side = step / 2
    cells = points.groupBy(*KEY, F.floor(F.col("x") / side), F.floor(F.col("y") / side)).agg(*[F.avg(a).alias(a) for a in "xyz"], F.count(F.lit(1)).alias("n")).select(*KEY, "x", "y", "z", "n")
    reach = int(span // step)
    tried = cells.join(centre.select(*KEY, "bx", "by"), KEY)
    for a in ("i", "j"):
        tried = tried.withColumn(a, F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    hit = ground(tried, patch, meta, F.col("x") + F.col("bx") + F.col("i") * step, F.col("y") + F.col("by") + F.col("j") * step)
    bins = F.round((F.col("z") - F.col("ground")) / BIN_M + OFF_BORDER).cast("long")
    counts = once(hit.groupBy(*KEY, "i", "j", bins.alias("v")).agg(F.sum("n").alias("n")))
    shift = [*KEY, "i", "j"]
    mid = counts.groupBy(*shift).agg(F.sum("n").alias("hits"), F.percentile("v", 0.5, F.col("n")).alias("mid")).filter(F.col("hits") >= least)
    return counts.join(mid, shift).groupBy(*shift, "hits").agg((F.percentile(F.abs(F.col("v") - F.col("mid")), 0.5, F.col("n")) * BIN_M).alias("mad"))


def coregister(points: DataFrame, grid: DataFrame, meta: DataFrame, levels: tuple = LEVELS, least: int = LEAST_HITS, keep: float = KEEP_COVERAGE) -> DataFrame:
    """The shift ``dx, dy`` that lays ``points(mission_id, x, y, z)`` on the raster with the least spread of height differences.

    Coarse to fine: every level tries all shifts of its step around the best of the level before.  Only shifts that keep at least ``keep``
    of the best coverage of the first level compete, so a sliver of overlap that fits by chance does not win; equal spreads go to the
    first shift.  A mission without a shift of ``least`` hits gets none: ``dx, dy`` and ``mad`` are null and its coverage is 0.
    """
    points = once(points.select(*KEY, "x", "y", "z"))
    patch = once(patches(grid))
    total = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    best = total.select(*KEY, "_n", F.lit(0.0).alias("bx"), F.lit(0.0).alias("by"), F.lit(None).cast("double").alias("mad"), F.lit(0.0).alias("coverage"), F.lit(0.0).alias("floor"))
    for k, (step, span) in enumerate(levels):
        best = cut(best)
        tried = once(_level(points, patch, meta, best if k == 0 else best.filter("mad IS NOT NULL"), step, span, least).join(total, KEY).withColumn("cov", F.col("hits") / F.col("_n")))
        floor = tried.groupBy(*KEY).agg((F.max("cov") * keep).alias("floor")) if k == 0 else best.select(*KEY, "floor")
        win = tried.drop("_n").join(floor, KEY).filter(F.col("cov") >= F.col("floor")).groupBy(*KEY).agg(F.min(F.struct("mad", "i", "j", "cov", "floor")).alias("w"))
        new = F.col("w").isNotNull()
        best = best.join(win, KEY, "left").select(
            *KEY, "_n", (F.col("bx") + F.when(new, F.col("w.i") * step).otherwise(0.0)).alias("bx"), (F.col("by") + F.when(new, F.col("w.j") * step).otherwise(0.0)).alias("by"),
            F.coalesce("w.mad", "mad").alias("mad"), F.coalesce("w.cov", "coverage").alias("coverage"), F.coalesce("w.floor", "floor").alias("floor"),
        )
    found = F.col("mad").isNotNull()
    return best.select(*KEY, F.when(found, F.col("bx")).alias("dx"), F.when(found, F.col("by")).alias("dy"), "mad", "coverage")


def _error(hits: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Mean height difference without its median, of keys with at least ``least`` hits."""
    rows = once(hits.select(*keys, (F.col("z") - F.col("ground")).alias("res")))
    mid = quantiles(rows, keys, offset_m=("res", 0.5))
    return rows.join(mid, keys).groupBy(*keys, "offset_m").agg(F.avg(F.abs(F.col("res") - F.col("offset_m"))).alias("mae_m"), F.count(F.lit(1)).alias("hits")).filter(F.col("hits") >= least)


def roll_steps(k: Column, rows: Column, cols: Column, rolls: int = ROLLS) -> tuple[Column, Column]:
    """Row and column steps of roll ``k``: between a quarter and half of the raster, in all four directions in turn."""
    part = lambda n: F.floor(n / 4) + F.floor(k * (F.floor(n / 2) - F.floor(n / 4)) / rolls)
    return part(rows) * F.when(k % 2 == 0, 1).otherwise(-1), part(cols) * F.when(k % 4 < 2, 1).otherwise(-1)


def null_gate(points: DataFrame, grid: DataFrame, meta: DataFrame, shift: DataFrame, rolls: int = ROLLS, limit: float = GATE, least: int = LEAST_HITS) -> DataFrame:
    """Whether the placed points fit the raster better than rolled copies of it, which keep its heights but not its places.

    ``shift(mission_id, dx, dy)`` as ``coregister`` gives it.  The score is the mean difference without its median; it must stay at or below
    ``limit`` times the median score over the rolls.  All rolls are one pass with the roll as part of the key.
    """
    at = once(points.join(shift.select(*KEY, "dx", "dy"), KEY).filter("dx IS NOT NULL").select(*KEY, (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "z"))
    real = _error(ground(at, patches(grid), meta, F.col("x"), F.col("y")), KEY, least)
    dr, dc = roll_steps(F.col("roll"), F.col("rows"), F.col("cols"), rolls)
    every = F.explode(F.sequence(F.lit(0), F.lit(rolls - 1))).alias("roll")
    turned = grid.select(*KEY, "row", "col", "height", every).join(meta.select(*KEY, "rows", "cols"), KEY)
    turned = turned.select(*KEY, "roll", F.pmod(F.col("row") + dr, F.col("rows")).alias("row"), F.pmod(F.col("col") + dc, F.col("cols")).alias("col"), "height")
    keys = [*KEY, "roll"]
    null = _error(ground(at.select("*", every), patches(turned, keys), meta, F.col("x"), F.col("y"), keys), keys, least)
    null = null.groupBy(*KEY).agg(F.percentile("mae_m", 0.5).alias("null_mae_m"), F.count(F.lit(1)).alias("nulls"))
    j = points.select(*KEY).distinct().join(real, KEY, "left").join(null, KEY, "left")
    status = F.when(F.col("mae_m").isNull(), "insufficient_coverage").when(F.col("mae_m") > limit * F.col("null_mae_m"), "alignment_gate_failed").otherwise("ok")
    return j.select(*KEY, "mae_m", "offset_m", "hits", "null_mae_m", F.coalesce("nulls", F.lit(0)).alias("nulls"), status.alias("status"))
