"""Exact quantiles per key, safe when one key holds most rows.

Spark's ``percentile`` keeps every distinct value of a key in one aggregation
buffer.  That is fine for short keys and is used for them.  For longer keys the
rows are only counted: every wanted rank starts with the range of its key, counts
of equal bins narrow it, and the few rows inside are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyfold.session import cut, once

SMALL_GROUP = 5_000  # rows of a key whose values one aggregation buffer may hold
BINS = 128
INSIDE = 2_000  # rows around a rank that may be sorted together


def quantiles(
    df: DataFrame, keys: Sequence[str], small_group: int = SMALL_GROUP, **specs: tuple[str, float | str]
) -> DataFrame:
    """One row per key with ``alias = quantile(column, p)`` for ``alias=(column, p)``.

    Linear interpolation; ``p="upper"`` is the upper median, without averaging.
    """
    keys = list(keys)
    cols = list(dict.fromkeys(c for c, _ in specs.values()))
    base = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
    if not keys:
        keys = ["_all"]
        base = base.withColumn("_all", F.lit(1))
    base = once(base.dropna(subset=keys))
    sizes = cut(base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *_ranges(cols)))
    large = sizes.filter(F.col("_n") > small_group)
    if large.isEmpty():
        out = _percentiles(base, keys, specs)
    else:
        mark = F.broadcast(large.select(*keys))
        out = _percentiles(base.join(mark, keys, "left_anti"), keys, specs).unionByName(ranked(base.join(mark, keys, "left_semi"), keys, large, **specs))
    return out.drop("_all") if keys == ["_all"] else out


def _ranges(cols: Sequence[str]) -> list[Column]:
    return [f(c).alias(f"_{n}_{c}") for c in cols for n, f in (("count", F.count), ("lo", F.min), ("hi", F.max))]


def _percentiles(base: DataFrame, keys: list[str], specs: dict) -> DataFrame:
    """Quantiles of short keys; those of one column share a buffer."""
    cols = list(dict.fromkeys(c for c, _ in specs.values()))
    ps = {c: [p for cc, p in specs.values() if cc == c and p != "upper"] for c in cols}
    aggs = [F.percentile(c, ps[c]).alias(f"_p_{c}") for c in cols if ps[c]]
    aggs += [F.expr(f"-percentile_disc(0.5) WITHIN GROUP (ORDER BY -{c})").alias(f"_u_{c}") for c in cols if (c, "upper") in specs.values()]
    pick = lambda c, p: F.col(f"_u_{c}") if p == "upper" else F.col(f"_p_{c}")[ps[c].index(p)]
    return base.groupBy(*keys).agg(*aggs).select(*keys, *[pick(c, p).alias(a) for a, (c, p) in specs.items()])


def ranked(base: DataFrame, keys: Sequence[str], sizes: DataFrame | None = None, **specs: tuple[str, float | str]) -> DataFrame:
    """Quantiles of few, long keys.  ``base`` is read three times or more; only counts and the rows around a rank are kept.

    ``sizes`` holds ``_ranges`` of each key.  It is broadcast, as are the wanted ranks: a row for each long key.
    """
    keys = list(keys)
    cols = list(dict.fromkeys(c for c, _ in specs.values()))
    if sizes is None:
        sizes = cut(base.groupBy(*keys).agg(*_ranges(cols)))
    wanted = []
    for i, (c, p) in enumerate(specs.values()):
        at = F.lit(0.5 if p == "upper" else float(p)) * (F.col(f"_count_{c}") - 1)
        for top, rank in ((0, F.floor(at)), (1, F.ceil(at))):
            if top or p != "upper":
                wanted.append(F.struct(F.lit(2 * i + top).alias("_k"), rank.alias("_rank"), F.lit(0).cast("long").alias("_below"), F.col(f"_lo_{c}").alias("_a"), F.col(f"_hi_{c}").alias("_b"), F.col(f"_count_{c}").alias("_n")))
    marks = sizes.select(*keys, F.explode(F.array(*wanted)).alias("_t")).select(*keys, "_t.*").filter("_n > 0")
    value = F.element_at(F.array(*[F.col(c) for c, _ in specs.values()]), F.floor(F.col("_t._k") / 2).cast("int") + 1)

    def near(marks: DataFrame) -> DataFrame:
        """The rows within the range of a wanted rank, once for each such rank."""
        lists = F.broadcast(marks.groupBy(*keys).agg(F.collect_list(F.struct("_k", "_rank", "_below", "_a", "_b")).alias("_l")))
        rows = base.join(lists, keys).select(*keys, *cols, F.explode("_l").alias("_t")).select(*keys, "_t.*", value.alias("_v"))
        return rows.filter("_v >= _a AND _v <= _b")

    while not marks.filter((F.col("_n") > INSIDE) & (F.col("_a") < F.col("_b"))).isEmpty():
        place = F.floor((F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * (BINS - 2)) + 1
        place = F.when(F.col("_v") <= F.col("_a"), 0).when(F.col("_v") >= F.col("_b"), BINS - 1).otherwise(F.greatest(F.lit(1), F.least(F.lit(BINS - 2), place)))
        bins = near(marks).groupBy(*keys, "_k", "_rank", "_below", place.alias("_i")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        before = F.sum("_n").over(Window.partitionBy(*keys, "_k").orderBy("_i")) - F.col("_n")
        marks = bins.withColumn("_below", F.col("_below") + before).filter("_rank >= _below AND _rank < _below + _n")
        marks = cut(marks.select(*keys, "_k", "_rank", "_below", "_a", "_b", "_n"))
    found = near(marks).groupBy(*keys, "_k", "_rank", "_below", "_v").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys, "_k").orderBy("_v")) - F.col("_n")
    found = found.withColumn("_below", F.col("_below") + before).filter("_rank >= _below AND _rank < _below + _n")
    at_rank = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == k, F.col("_v"))).alias(f"_v{k}") for k in range(2 * len(specs))])
    out = []
    for i, (a, (c, p)) in enumerate(specs.items()):
        lo, hi = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        at = F.lit(0.5 if p == "upper" else float(p)) * (F.col(f"_count_{c}") - 1)
        out.append((hi if p == "upper" else F.when(lo == hi, lo).otherwise(lo + (hi - lo) * (at - F.floor(at)))).alias(a))
    return sizes.join(at_rank, keys, "left").select(*keys, *out)


def with_quantiles(df: DataFrame, keys: Sequence[str], **specs: tuple[str, float | str]) -> DataFrame:
    """The rows joined with the quantiles of their key."""
    df = once(df)
    return df.join(quantiles(df, keys, **specs), list(keys), "left")


def median_mad(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median and median absolute deviation of a column per key: ``med``, ``mad``."""
    df = once(df)
    med = quantiles(df, keys, med=(value, 0.5))
    dev = df.join(med, list(keys)).withColumn("_dev", F.abs(F.col(value) - F.col("med")))
    return med.join(quantiles(dev, keys, mad=("_dev", 0.5)), list(keys))
