"""Row-order operators that never put one whole key into one task.

A plain ``Window.partitionBy(key)`` sorts a key inside a single task.  When one
mission holds a third of all rows that task is the job.  Every function here
takes a ``chunk`` expression that is monotone in the order columns (a row block
or a time slot), works inside ``(key, chunk)``, and stitches the chunk borders
with a summary table that has one row per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyfold.session import once

CHUNK = "_chunk"


def _slots(df: DataFrame, chunk: Column | str) -> tuple[DataFrame, str]:
    """The rows with their chunk column; a named column is used and kept as it is."""
    df = once(df)
    return (df, chunk) if isinstance(chunk, str) else (df.withColumn(CHUNK, chunk), CHUNK)


def _struct(parts: dict[str, Column]) -> Column:
    return F.struct(*[e.alias(a) for a, e in parts.items()])


def with_adjacent(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | str,
    prev: dict[str, Column] | None = None,
    nxt: dict[str, Column] | None = None,
) -> DataFrame:
    """Add columns of the previous and/or next row of the same key."""
    d, slot = _slots(df, chunk)
    w = Window.partitionBy(*keys, slot).orderBy(*order)
    ws = Window.partitionBy(*keys).orderBy(slot)
    at = F.struct(*order)
    aggs, edges, local, added = [], [], [], []
    if prev:
        local.append(("_prev", F.lag(_struct(prev)).over(w)))
        aggs.append(F.max_by(_struct(prev), at).alias("_tail"))
        edges.append(F.lag("_tail").over(ws).alias("_before"))
        added += [F.coalesce("_prev", "_before")[a].alias(a) for a in prev]
    if nxt:
        local.append(("_next", F.lead(_struct(nxt)).over(w)))
        aggs.append(F.min_by(_struct(nxt), at).alias("_head"))
        edges.append(F.lead("_head").over(ws).alias("_after"))
        added += [F.coalesce("_next", "_after")[a].alias(a) for a in nxt]
    border = d.groupBy(*keys, slot).agg(*aggs).select(*keys, slot, *edges)
    out = d
    for name, e in local:
        out = out.withColumn(name, e)
    names = set(prev or {}) | set(nxt or {})
    kept = [c for c in df.columns if c not in names]
    return out.join(border, [*keys, slot], "left").select(*kept, *added)


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    chunk: Column | str,
    sums: dict[str, Column] | None = None,
    rank: str | None = None,
    total: str | None = None,
) -> DataFrame:
    """Add running sums (current row included), a 1-based row number and the row count of the key."""
    sums = sums or {}
    d, slot = _slots(df, chunk)
    w = Window.partitionBy(*keys, slot).orderBy(*order)
    ws = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    border = d.groupBy(*keys, slot).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(e).alias(f"_s_{a}") for a, e in sums.items()]
    )
    border = border.select(
        *keys,
        slot,
        F.coalesce(F.sum("_n").over(ws), F.lit(0)).alias("_n0"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_nt"),
        *[F.coalesce(F.sum(f"_s_{a}").over(ws), F.lit(0.0)).alias(f"_s0_{a}") for a in sums],
    )
    out = d.withColumn("_rn", F.row_number().over(w))
    wr = w.rowsBetween(Window.unboundedPreceding, 0)
    for a, e in sums.items():
        out = out.withColumn(f"_l_{a}", F.coalesce(F.sum(e).over(wr), F.lit(0.0)))
    out = out.join(border, [*keys, slot], "left")
    extra = [(F.col(f"_l_{a}") + F.col(f"_s0_{a}")).alias(a) for a in sums]
    if rank:
        extra.append((F.col("_rn").cast("long") + F.col("_n0")).alias(rank))
    if total:
        extra.append(F.col("_nt").alias(total))
    return out.select(*[c for c in df.columns if c not in sums], *extra)


def asof_neighbours(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    slot: float,
) -> DataFrame:
    """Both as-of neighbours of every left row.

    ``before`` is the last right row with time < left time, ``after`` the first
    with time >= left time; ties inside the right side go to the smaller struct.
    """
    left, right = once(left), once(right)
    lcols, rcols = left.columns, [c for c in right.columns if c not in keys]
    rstruct = F.struct(F.col(right_time).alias("_t"), *[F.col(c) for c in rcols])
    lhs = left.select(*keys, F.col(left_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*lcols).alias("_l"))
    rhs = right.filter(F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).alias("_t"), F.lit(1).alias("_side"), rstruct.alias("_r")
    )
    both = lhs.unionByName(rhs, allowMissingColumns=True).withColumn(CHUNK, F.floor(F.col("_t") / slot))
    up = Window.partitionBy(*keys, CHUNK).orderBy("_t", "_side", "_r")
    down = Window.partitionBy(*keys, CHUNK).orderBy(F.desc("_t"), F.desc("_side"), F.desc("_r"))
    past = (Window.unboundedPreceding, -1)
    border = rhs.withColumn(CHUNK, F.floor(F.col("_t") / slot)).groupBy(*keys, CHUNK).agg(
        F.max("_r").alias("_tail"), F.min("_r").alias("_head")
    )
    slots = both.select(*keys, CHUNK).distinct().join(border, [*keys, CHUNK], "left")
    ws, wd = Window.partitionBy(*keys).orderBy(CHUNK), Window.partitionBy(*keys).orderBy(F.desc(CHUNK))
    slots = slots.select(
        *keys,
        CHUNK,
        F.last("_tail", ignorenulls=True).over(ws.rowsBetween(*past)).alias("_before"),
        F.last("_head", ignorenulls=True).over(wd.rowsBetween(*past)).alias("_after"),
    )
    hit = (
        both.withColumn("_b", F.last("_r", ignorenulls=True).over(up.rowsBetween(*past)))
        .withColumn("_a", F.last("_r", ignorenulls=True).over(down.rowsBetween(*past)))
        .filter("_side = 0")
        .join(slots, [*keys, CHUNK], "left")
    )
    return hit.select(
        *[F.col("_l")[c].alias(c) for c in lcols],
        F.coalesce("_b", "_before").alias("before"),
        F.coalesce("_a", "_after").alias("after"),
    )
