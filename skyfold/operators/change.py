"""Change between two surveys of a mission on a common voxel grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from skyfold.kernels.components import grid_components
from skyfold.operators.telemetry import KEY
from skyfold.session import once

AXES = ["kx", "ky", "kz"]


def joint_origin(base: DataFrame, cur: DataFrame) -> DataFrame:
    both = base.select(*KEY, "x", "y", "z").unionByName(cur.select(*KEY, "x", "y", "z"))
    b = both.groupBy(*KEY).agg(*[F.min(a).alias(f"o{a}") for a in "xyz"], F.greatest(*[F.max(a) - F.min(a) for a in "xyz"]).alias("extent"))
    return b


def keyed(df: DataFrame, origin: DataFrame, voxel: float) -> DataFrame:
    return df.join(origin, KEY).select(*df.columns, *[F.floor((F.col(a) - F.col(f"o{a}")) / voxel).alias(k) for a, k in zip("xyz", AXES)])


def voxel_diff(base: DataFrame, cur: DataFrame, voxel: float = 0.5) -> DataFrame:
    """Voxels present in one survey only: ``kind`` added or removed."""
    voxel = max(voxel, 0.2)
    base, cur = once(base), once(cur)
    o = joint_origin(base, cur)
    side = lambda d, f: keyed(d, o, voxel).select(*KEY, *AXES, F.lit(f).alias("f"))
    both = side(base, 1).unionByName(side(cur, 2))
    seen = both.groupBy(*KEY, *AXES).agg(F.bit_or("f").alias("f"))
    return seen.filter("f < 3").select(*KEY, F.when(F.col("f") == 2, "added").otherwise("removed").alias("kind"), *AXES)


def change_clusters(diff: DataFrame, origin: DataFrame, voxel: float = 0.5, least: int = 8) -> DataFrame:
    """Face-connected groups of changed voxels, measured at the lower voxel corners."""
    c = grid_components(once(diff), [*KEY, "kind"], AXES).join(origin, KEY)
    pos = {a: F.col(k) * voxel + F.col(f"o{a}") for a, k in zip("xyz", AXES)}
    g = c.groupBy(*KEY, "kind", "component").agg(
        F.count(F.lit(1)).alias("voxels"), *[F.avg(pos[a]).alias(f"c{a}") for a in "xyz"],
        *[f(pos[a]).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))],
    )
    return g.filter(F.col("voxels") >= least).withColumn("volume_m3", F.col("voxels") * voxel**3).drop("component")


def change_index(clusters: DataFrame, origin: DataFrame, voxel: float = 0.5) -> DataFrame:
    s = clusters.groupBy(*KEY).agg(F.sum("voxels").alias("v"))
    e = F.greatest(F.col("extent") * F.col("extent"), F.lit(1.0))
    return origin.join(s, KEY, "left").select(*KEY, F.least(F.lit(1.0), F.coalesce("v", F.lit(0)) * voxel**3 / e).alias("change_index"))


def majority_labels(df: DataFrame, label: str) -> DataFrame:
    """Most frequent label per voxel, ties to the lowest label."""
    n = df.groupBy(*KEY, *AXES, label).agg(F.count(F.lit(1)).alias("c"))
    return n.groupBy(*KEY, *AXES).agg(F.max(F.struct("c", (-F.col(label)).alias("m"))).alias("b")).select(*KEY, *AXES, (-F.col("b.m")).alias("label"))


def semantic_change(base: DataFrame, cur: DataFrame, voxel: float = 0.5, label: str = "class") -> DataFrame:
    """Added, removed and converted voxels per label; only for voxels up to 1 m."""
    if voxel > 1:
        raise ValueError("semantic change needs voxels of at most 1 m")
    base, cur = once(base), once(cur)
    o = joint_origin(base, cur)
    a = majority_labels(keyed(base, o, voxel), label).withColumnRenamed("label", "was")
    b = majority_labels(keyed(cur, o, voxel), label).withColumnRenamed("label", "now")
    j = a.join(b, [*KEY, *AXES], "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "converted")
    j = j.select(*KEY, kind.alias("kind"), F.coalesce("now", "was").alias("label")).filter("kind IS NOT NULL")
    n = j.groupBy(*KEY, "kind", "label").agg(F.count(F.lit(1)).alias("voxels"))
    return n.withColumn("share", F.col("voxels") / F.sum("voxels").over(Window.partitionBy(*KEY, "kind")))
