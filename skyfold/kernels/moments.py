"""Per-key moment fits: sums are built in Spark, only one small matrix per key reaches numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from skyfold.session import once


_ARRAY = T.ArrayType(T.DoubleType())
_FIT = T.StructType([T.StructField("scale", T.DoubleType()), T.StructField("r", _ARRAY)])
_EIGEN = T.StructType([T.StructField("values", _ARRAY), T.StructField("vectors", _ARRAY)])


def solve_similarity(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scales and rotations of rows ``[9 cross-covariances dst x src, variance of src]``."""
    cov, var = a[:, :9].reshape(-1, 3, 3), a[:, 9]
    u, s, vt = np.linalg.svd(cov)
    sign = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    sign[sign == 0] = 1.0
    fix = np.ones((len(a), 3))
    fix[:, 2] = sign
    r = (u * fix[:, None, :]) @ vt
    return np.where(var > 0, (s * fix).sum(1) / np.where(var > 0, var, 1.0), 1.0), r


@pandas_udf(_FIT)
def similarity_from_moments(m: pd.Series) -> pd.DataFrame:
    """Scale and rotation from ``[9 cross-covariances dst x src, variance of src]``."""
    scale, r = solve_similarity(np.stack(m.to_numpy()) if len(m) else np.zeros((0, 10)))
    return pd.DataFrame({"scale": scale, "r": list(r.reshape(-1, 9))})


@pandas_udf(_EIGEN)
def eigen_sym3(m: pd.Series) -> pd.DataFrame:
    """Ascending eigenvalues and row-wise eigenvectors of symmetric ``[xx,xy,xz,yy,yz,zz]``."""
    a = np.stack(m.to_numpy()) if len(m) else np.zeros((0, 6))
    full = a[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
    val, vec = np.linalg.eigh(full)
    return pd.DataFrame({"values": list(val), "vectors": list(vec.transpose(0, 2, 1).reshape(-1, 9))})


def covariance3(df: DataFrame, keys: Sequence[str], xyz: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Centroid ``mx,my,mz``, count ``n`` and the six population covariances ``cov``.

    Two passes: the mean first, so that large coordinates do not cancel.
    """
    keys = list(keys)
    x, y, z = (F.col(c) for c in xyz)
    df = once(df)
    mean = df.groupBy(*keys).agg(
        F.avg(x).alias("mx"), F.avg(y).alias("my"), F.avg(z).alias("mz"), F.count(F.lit(1)).alias("n")
    )
    d = df.join(mean, keys).select(*keys, (x - F.col("mx")).alias("a"), (y - F.col("my")).alias("b"), (z - F.col("mz")).alias("c"))
    prods = ["a*a", "a*b", "a*c", "b*b", "b*c", "c*c"]
    cov = d.groupBy(*keys).agg(F.array(*[F.avg(F.expr(p)) for p in prods]).alias("cov"))
    return mean.join(cov, keys)


def fit_similarity(
    pairs: DataFrame,
    keys: Sequence[str],
    src: Sequence[str] = ("sx", "sy", "sz"),
    dst: Sequence[str] = ("dx", "dy", "dz"),
    with_scale: bool = True,
) -> DataFrame:
    """Least-squares ``dst = scale * R * src + t`` per key: ``scale, r[9], tx, ty, tz, n``."""
    keys = list(keys)
    p = pairs.select(*keys, *src, *dst).dropna()
    p = once(p)
    names = [*src, *dst]
    mean = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in names])
    c = p.join(mean, keys)
    dev = {n: F.col(n) - F.col(f"m_{n}") for n in names}
    mom = c.groupBy(*keys).agg(
        F.array(
            *[F.avg(dev[d] * dev[s]) for d in dst for s in src],
            F.avg(sum(dev[s] * dev[s] for s in src)),
        ).alias("_m")
    )
    fit = mean.join(mom, keys).withColumn("_f", similarity_from_moments("_m"))
    scale = F.col("_f.scale") if with_scale else F.lit(1.0)
    fit = fit.withColumn("scale", scale).withColumn("r", F.col("_f.r"))
    rot = [sum(F.col("r")[3 * i + j] * F.col(f"m_{src[j]}") for j in range(3)) for i in range(3)]
    return fit.select(
        *keys,
        "n",
        "scale",
        "r",
        *[(F.col(f"m_{dst[i]}") - F.col("scale") * rot[i]).alias(t) for i, t in enumerate(("tx", "ty", "tz"))],
    )


def moved(x: Column, y: Column, z: Column) -> list[Column]:
    """Coordinates moved by the joined columns ``scale, r, tx, ty, tz``."""
    v = (x, y, z)
    return [
        F.col("scale") * sum(F.col("r")[3 * i + j] * v[j] for j in range(3)) + F.col(t)
        for i, t in enumerate(("tx", "ty", "tz"))
    ]
