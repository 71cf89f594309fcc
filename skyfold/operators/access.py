"""Who can be reached: passable ground connected to the border, blocked and exposed structures, the risk report of a mission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyfold.kernels.components import grid_components
from skyfold.kernels.quantile import quantiles
from skyfold.operators.scene import _reached
from skyfold.operators.telemetry import KEY
from skyfold.session import once

CELL = ["ix", "iy"]

# Limits of vehicle access and of landslides in degrees, buffers in metres, cells a structure may stand off, shares and levels.
ACCESS_DEG = 15.0
STEEP_DEG = 25.0
FLOOD_M = 25.0
OFF_CELLS = 3
LIMITED = 0.6
LEVELS = ["Low", "Medium", "High", "Critical"]
STEEP_SHARES = [(0.15, 3), (0.05, 2)]


def level_number(level: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level), F.lit(0)).cast("int")


def level_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), F.least(F.greatest(number, F.lit(1)), F.lit(4)).cast("int"))


def access_cells(grid: DataFrame, flood: DataFrame, size: float, access_deg: float = ACCESS_DEG, flood_m: float = FLOOD_M) -> DataFrame:
    """Cells of the slope grid with ``flooded, passable, reachable``.

    Passable is occupied ground no steeper than ``access_deg`` and not flooded; reachable is what connects over passable neighbours
    to the border of the mission's grid.
    """
    box = grid.groupBy(*KEY).agg(*[f(a).alias(f"{n}_{a}") for a in CELL for n, f in (("lo", F.min), ("hi", F.max))])
    wet = _reached(flood, size, flood_m).withColumn("flooded", F.lit(True))
    cells = grid.select(*KEY, *CELL, "slope_deg").join(wet, [*KEY, *CELL], "left").withColumn("flooded", F.coalesce("flooded", F.lit(False)))
    cells = once(cells.withColumn("passable", (F.col("slope_deg") <= access_deg) & ~F.col("flooded")))
    parts = once(grid_components(cells.filter("passable").select(*KEY, *CELL), KEY, CELL))
    edge = F.col("ix").isin(F.col("lo_ix"), F.col("hi_ix")) | F.col("iy").isin(F.col("lo_iy"), F.col("hi_iy"))
    open_ = parts.join(box, KEY).filter(edge).select(*KEY, "component").distinct()
    free = parts.join(open_, [*KEY, "component"], "left_semi").select(*KEY, *CELL, F.lit(True).alias("reachable"))
    return cells.join(free, [*KEY, *CELL], "left").withColumn("reachable", F.coalesce("reachable", F.lit(False)))


def ground_cells(structures: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """``structures(structure_id, x, y)`` with the nearest occupied cell within OFF_CELLS cells; ties go to the first cell.

    Cells enter the places around them, at most one list of (2 OFF_CELLS + 3) ** 2 cells each, so that a structure meets one row.
    """
    around = F.sequence(F.lit(-OFF_CELLS - 1), F.lit(OFF_CELLS + 1))
    flags = [c for c in cells.columns if c not in (*KEY, *CELL)]
    near = cells.withColumn("_i", F.explode(around)).withColumn("_j", F.explode(around))
    near = near.groupBy(*KEY, (F.col("ix") + F.col("_i")).alias("_ix"), (F.col("iy") + F.col("_j")).alias("_iy")).agg(F.collect_list(F.struct(*CELL, *flags)).alias("_near"))
    s = structures.withColumn("_ix", F.floor(F.col("x") / size)).withColumn("_iy", F.floor(F.col("y") / size)).join(near, [*KEY, "_ix", "_iy"], "left")
    away = lambda c: F.sqrt(((c["ix"] + 0.5) * size - F.col("x")) ** 2 + ((c["iy"] + 0.5) * size - F.col("y")) ** 2)
    listed = F.transform("_near", lambda c: F.struct(away(c).alias("_d"), *[c[n].alias(n) for n in (*CELL, *flags)]))
    s = s.withColumn("_c", F.array_min(F.filter(listed, lambda c: c["_d"] <= OFF_CELLS * size)))
    return s.select(*structures.columns, *[F.col(f"_c.{c}").alias(c) for c in (*CELL, *flags)])


def accessibility(cells: DataFrame, structures: DataFrame, size: float, access_deg: float = ACCESS_DEG) -> DataFrame:
    """``structure_id, state, cause`` of every structure: reachable, blocked (with its cause), or outside where no cell is near."""
    s = ground_cells(structures.select(*KEY, "structure_id", "x", "y"), cells, size)
    state = F.when(F.col("ix").isNull(), "outside").when(F.col("reachable"), "reachable").otherwise("blocked")
    cause = F.when(F.col("flooded"), "flooded_access").when(F.col("slope_deg") > access_deg, "slope_exceeds_vehicle_access").otherwise("isolated_by_terrain")
    return s.withColumn("state", state).select(*KEY, "structure_id", "state", F.when(F.col("state") == "blocked", cause).alias("cause"))


def access_grade(access: DataFrame, missions: DataFrame) -> DataFrame:
    """Structures in all, reachable and blocked per mission, with share, level and grade; structures outside count as not reached."""
    n = access.groupBy(*KEY).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("state") == "reachable").alias("reached"), F.count_if(F.col("state") == "blocked").alias("blocked"))
    j = missions.select(*KEY).distinct().join(n, KEY, "left").fillna(0, ["total", "reached", "blocked"])
    share = F.col("reached") / F.greatest("total", F.lit(1))
    none, all_, most = F.col("total") == 0, F.col("reached") == F.col("total"), share >= LIMITED
    return j.select(
        *KEY, "total", "reached", "blocked", share.alias("share"), F.when(none | all_, "Low").when(most, "Medium").otherwise("High").alias("level"),
        F.when(none, "not_applicable_no_structures").when(all_, "Good").when(most, "Limited").otherwise("Restricted").alias("grade"),
    )


def exposed_structures(cells: DataFrame, structures: DataFrame, size: float) -> DataFrame:
    """Structures whose nearest occupied cell is flooded."""
    return ground_cells(structures.select(*KEY, "structure_id", "x", "y"), cells, size).filter("flooded").select(*KEY, "structure_id")


def risk_report(cells: DataFrame, findings: DataFrame, access: DataFrame, exposed: DataFrame, steep_deg: float = STEEP_DEG) -> DataFrame:
    """One row per mission: levels of flood, landslide, debris and access, the overall level, and the slopes behind them.

    ``findings(mission_id, kind, severity)`` with kinds flood, debris_field and collapse_candidate.  A flood over structures and debris
    where structures are blocked count one level more; a level is null where there is no evidence.
    """
    cells = once(cells)
    worst = lambda *kinds: F.coalesce(F.max(F.when(F.col("kind").isin(*kinds), level_number(F.col("severity")))), F.lit(0))
    found = findings.groupBy(*KEY).agg(worst("flood").alias("flood_n"), worst("debris_field", "collapse_candidate").alias("debris_n"))
    ground = cells.groupBy(*KEY).agg(
        F.avg("slope_deg").alias("mean_slope_deg"), F.max("slope_deg").alias("max_slope_deg"), F.avg((~F.col("passable")).cast("int")).alias("impassable_share"),
        F.avg(F.col("flooded").cast("int")).alias("flooded_share"), F.avg((F.col("slope_deg") > steep_deg).cast("int")).alias("steep_share"),
    ).join(quantiles(cells, KEY, p90_slope_deg=("slope_deg", 0.9)), KEY)
    wet = exposed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("exposed"))
    grade = access_grade(access, cells).select(*KEY, "total", "blocked", "level", "grade")
    j = ground.join(found, KEY, "left").join(wet, KEY, "left").join(grade, KEY, "left").fillna(0, ["flood_n", "debris_n", "exposed"])
    steep = F.lit(1)
    for least, number in reversed(STEEP_SHARES):
        steep = F.when(F.col("steep_share") >= least, number).otherwise(steep)
    number = {
        "flood_risk": F.when(F.col("flood_n") > 0, F.least(F.lit(4), F.col("flood_n") + (F.col("exposed") > 0).cast("int"))),
        "landslide_risk": F.when(F.col("steep_share") > 0, steep),
        "debris_risk": F.when(F.col("debris_n") > 0, F.least(F.lit(4), F.col("debris_n") + (F.col("blocked") > 0).cast("int"))),
        "access_risk": F.when((F.col("total") > 0) & (F.col("blocked") > 0), F.when(F.col("level") == "Low", 1).otherwise(3)),
    }
    top = F.greatest(*[F.coalesce(n, F.lit(0)) for n in number.values()])
    return j.select(
        *KEY, *[F.when(n.isNotNull(), level_name(n)).alias(c) for c, n in number.items()], level_name(top).alias("overall"), "exposed", "blocked", "grade",
        "mean_slope_deg", "max_slope_deg", "p90_slope_deg", "impassable_share", "flooded_share", "steep_share",
    )
