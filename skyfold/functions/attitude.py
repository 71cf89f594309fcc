"""Gimbal attitude as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def view_axes(roll: Column, pitch: Column, yaw: Column) -> list[list[Column]]:
    """Camera x, y, z axes in east-north-up; pitch is the elevation and yaw the compass course of the view."""
    p, a, r = F.radians(pitch), F.radians(yaw), F.radians(roll)
    z = [F.cos(p) * F.sin(a), F.cos(p) * F.cos(a), F.sin(p)]
    right = [F.cos(a), -F.sin(a), F.lit(0.0)]
    down = [F.sin(p) * F.sin(a), F.sin(p) * F.cos(a), -F.cos(p)]
    x = [F.cos(r) * u + F.sin(r) * v for u, v in zip(right, down)]
    y = [F.cos(r) * v - F.sin(r) * u for u, v in zip(right, down)]
    return [x, y, z]


def with_quaternion(df: DataFrame, roll: str = "roll", pitch: str = "pitch", yaw: str = "yaw", prefix: str = "q") -> DataFrame:
    """Rows with the attitude quaternion ``qw, qx, qy, qz``; the largest part leads.

    Axes, lead and scale are columns of their own so that each is computed once.
    """
    axes = view_axes(F.col(roll), F.col(pitch), F.col(yaw))
    d = df.select("*", *[e.alias(f"_m{r}{c}") for c, axis in enumerate(axes) for r, e in enumerate(axis)])
    m = [[F.col(f"_m{r}{c}") for c in range(3)] for r in range(3)]
    t = m[0][0] + m[1][1] + m[2][2]
    lead = F.when(t > 0, 0).when((m[0][0] > m[1][1]) & (m[0][0] > m[2][2]), 1).when(m[1][1] > m[2][2], 2).otherwise(3)
    d = d.withColumn("_lead", lead)
    pick = lambda *e: F.when(F.col("_lead") == 0, e[0]).when(F.col("_lead") == 1, e[1]).when(F.col("_lead") == 2, e[2]).otherwise(e[3])
    d = d.withColumn("_s", 2 * F.sqrt(pick(1 + t, 1 + 2 * m[0][0] - t, 1 + 2 * m[1][1] - t, 1 + 2 * m[2][2] - t)))
    s, own = F.col("_s"), F.col("_s") / 4
    a, b, c = (m[2][1] - m[1][2]) / s, (m[0][2] - m[2][0]) / s, (m[1][0] - m[0][1]) / s
    xy, xz, yz = (m[0][1] + m[1][0]) / s, (m[0][2] + m[2][0]) / s, (m[1][2] + m[2][1]) / s
    parts = {"w": pick(own, a, b, c), "x": pick(a, own, xy, xz), "y": pick(b, xy, own, yz), "z": pick(c, xz, yz, own)}
    return d.select(*df.columns, *[e.alias(prefix + n) for n, e in parts.items()])


def attitude_angle(w: Column, x: Column, y: Column, z: Column, axes: list[list[Column]]) -> Column:
    """Degrees between a unit quaternion and camera axes, from the trace of their relative rotation."""
    rot = [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]
    trace = sum((rot[i][j] * axes[j][i] for i in range(3) for j in range(3)), F.lit(0.0))
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))
