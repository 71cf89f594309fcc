"""Convex hulls of occupied grid cells."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

COLUMN_BLOCK = 4096


def chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Counter-clockwise hull corners of sorted distinct points, starting at the lowest."""
    if len(points) < 3:
        return points

    def half(ps):
        out: list[tuple[float, float]] = []
        for p in ps:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    low, up = half(points), half(points[::-1])
    return low[:-1] + up[:-1]


def _chain_frame(pdf: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    pts = sorted(set(zip(pdf["hx"], pdf["hy"])))
    h = chain(pts)
    out = pd.DataFrame(h, columns=["hx", "hy"])
    out["seq"] = range(len(out))
    for k in keys:
        out[k] = pdf[k].iloc[0]
    return out[[*keys, "seq", "hx", "hy"]]


def convex_hull(cells: DataFrame, keys: Sequence[str], ix: str = "ix", iy: str = "iy") -> DataFrame:
    """Hull corners ``keys, seq, hx, hy`` of integer cells.

    Only the two extreme cells of a column can be corners, and corners of the
    whole are corners of their column block, so every task sees few rows.
    """
    keys = list(keys)
    ends = cells.groupBy(*keys, F.col(ix).alias("hx")).agg(F.array(F.min(iy), F.max(iy)).alias("_e"))
    ends = ends.select(*keys, "hx", F.explode("_e").alias("hy")).select(
        *keys, F.col("hx").cast("double"), F.col("hy").cast("double"), F.floor(F.col("hx") / COLUMN_BLOCK).alias("_block")
    )
    key_types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cells.select(*keys).schema)
    schema = f"{key_types}, seq long, hx double, hy double"
    part = ends.groupBy(*keys, "_block").applyInPandas(lambda p: _chain_frame(p, keys), schema)
    return part.groupBy(*keys).applyInPandas(lambda p: _chain_frame(p, keys), schema)


def hull_area(hull: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shoelace area and corner count per key; the corners of one hull are few."""
    keys = list(keys)
    ring = hull.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "hx", "hy"))).alias("h"))
    nxt = F.concat(F.slice("h", 2, F.greatest(F.size("h") - 1, F.lit(1))), F.slice("h", 1, 1))
    cross = F.zip_with("h", nxt, lambda a, b: a["hx"] * b["hy"] - a["hy"] * b["hx"])
    return ring.select(
        *keys,
        F.size("h").cast("long").alias("corners"),
        F.when(F.size("h") >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))) / 2).otherwise(0.0).alias("area"),
    )
