"""Mixing sources to target weights by balanced sampling (cube method)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skyfold.llm.store import columns, others, prepare, written

WEIGHTS = (3, 1, 2)
BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-9


def word_count(text: str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: pd.DataFrame, ratio: float, cap: float, weights: tuple[float, ...]) -> pd.DataFrame:
    """``source, source_size`` with ``target``: shares by weight in source order, each at most ``cap`` times its source."""
    rows = sizes.assign(_null=sizes["source"].isna()).sort_values(["_null", "source"], kind="stable").reset_index(drop=True)
    size, w = rows["source_size"].to_numpy(float), np.resize(np.asarray(weights, float), len(rows))
    out, rest, open_ = np.zeros(len(rows)), ratio * size.sum(), np.ones(len(rows), bool)
    while open_.any():
        share = rest * w / w[open_].sum()
        over = open_ & (share > cap * size)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = cap * size[over]
        rest -= out[over].sum()
        open_ &= ~over
    return rows[["source", "source_size"]].assign(target=out)


def flight(p: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """Move fractional probabilities along directions that change neither their sum nor their size-weighted sum, until one is left at most.

    The largest open unit moves up or down and all smaller ones together make up for it (in proportion to their room and to
    ``a + b * size``), at chances that keep every expectation.  Each move makes at least one unit 0 or 1, large units first, so what is left open is small.  Where a
    unit is still open after three moves, or the open ones cannot meet both constraints, its further moves balance the words only.
    """
    out = np.where((p > EPS) & (p < 1 - EPS), p, np.round(p))
    ids = np.flatnonzero((out > 0) & (out < 1))
    ids = ids[np.argsort(-size[ids], kind="stable")]
    p, s = out[ids], size[ids].astype(float)
    rng, tries, head = np.random.default_rng(seed), 0, -1
    while len(p) > 1:
        tries, head = (tries + 1 if ids[0] == head else 0), ids[0]
        rest, room = s[1:], np.minimum(p[1:], 1 - p[1:])
        total = room.sum()
        mean = (room * rest).sum() / total
        spread = (room * (rest - mean) ** 2).sum()
        if tries < 3 and spread > EPS * max(1.0, mean):
            v = room * (-1 / total - (s[0] - mean) / spread * (rest - mean))
        elif mean > 0:
            v = room * (-s[0] / (mean * total))
        else:
            v = room * (-1 / total)
        v = np.concatenate([[1.0], v])
        with np.errstate(divide="ignore", invalid="ignore"):
            high, low = (1 - p) / np.abs(v), p / np.abs(v)
        up, down = np.where(v > 0, high, low).min(), np.where(v > 0, low, high).min()
        p = p + (up if rng.random() * (up + down) < down else -down) * v
        shut = (p < EPS) | (p > 1 - EPS)
        out[ids] = np.where(shut, np.round(p), p)
        ids, p, s = ids[~shut], p[~shut], s[~shut]
    return out


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the few that are left so that the words come nearest to what they promise, ties to fewer units."""
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if not len(open_):
        return p
    want = (p[open_] * size[open_]).sum()
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(size[k] for j, k in enumerate(open_) if m >> j & 1) - want), bin(m).count("1"), m))
    p = p.copy()
    for j, k in enumerate(open_):
        p[k] = best >> j & 1
    return p



def _balanced(units: DataFrame, group: list[str], last: bool) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "_size", "_id"], na_position="first", kind="stable")
        p, size = pdf["_p"].to_numpy(float), pdf["_size"].to_numpy(float)
        p = flight(p, size, int(np.bitwise_xor.reduce(pdf["_h"].to_numpy())) & 0x7FFFFFFF)
        pdf["_p"] = land(p, size) if last else p
        return pdf

    return units.groupBy(*group).applyInPandas(run, units.schema)


def mix_sources(docs: DataFrame, size: str = "size", ratio: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """All rows of ``docs(doc_id, source, <size>)`` with ``source_size, target, copies``.

    A source's target over its size is what each of its documents is taken: whole copies for the whole part, one more for a
    balanced sample at the fractional part.  The sample keeps both the number and the words of each source (cube method): blocks
    of about ``block`` documents fly apart, the one left open in each meets others in the next level, and the last of a source lands.
    Decisions depend on ``doc_id``, ``source`` and ``size`` only, so reruns agree.

    Null sources form one source, last in order; null ids are one id; rows alike in all three are one unit with a multiplicity, told
    apart only by row number.  Empty documents (size 0) weigh nothing; an empty table gives no rows.  Other columns are kept.  One row
    per source passes the driver.
    """
    columns(docs, "doc_id", "source", size)
    prepare(docs.sparkSession)
    rows = docs.withColumn("__mx_k", F.struct(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), F.col(size).cast("long").alias("size")))
    units = written(rows.groupBy("__mx_k").agg(F.count(F.lit(1)).alias("_n")), "mix-units")
    per = units.groupBy(F.col("__mx_k.source").alias("source")).agg(F.sum(F.col("__mx_k.size") * F.col("_n")).alias("source_size"), F.count(F.lit(1)).alias("_units")).toPandas()
    plan = targets(per[["source", "source_size"]], ratio, cap, weights)
    plan["_f"] = np.divide(plan["target"], plan["source_size"], out=np.zeros(len(plan)), where=plan["source_size"].to_numpy() > 0)
    plan = plan.merge(per[["source", "_units"]].assign(_j=per["source"].fillna("").astype(str) + per["source"].isna().astype(str)).drop(columns="source"), left_on=plan["source"].fillna("").astype(str) + plan["source"].isna().astype(str), right_on="_j")
    rates = docs.sparkSession.createDataFrame(
        [(None if pd.isna(s) else s, int(z), float(t), float(f), int(-(-n // block))) for s, z, t, f, n in plan[["source", "source_size", "target", "_f", "_units"]].itertuples(index=False)],
        "_source string, source_size long, target double, _f double, _blocks long",
    )
    fly = (
        units.join(rates, F.col("__mx_k.source").eqNullSafe(F.col("_source")))
        .withColumn("_h", F.xxhash64(F.lit(seed), "__mx_k.doc_id", "__mx_k.size"))
        .select(
            F.col("__mx_k.source").alias("_s"), F.col("__mx_k.doc_id").alias("_id"), F.col("__mx_k.size").alias("_size"), "_h", F.pmod("_h", "_blocks").alias("_block"),
            F.floor(F.col("_n") * (F.col("_f") - F.floor("_f")) + F.lit(EPS)).alias("_whole"),
            (F.col("_n") * (F.col("_f") - F.floor("_f"))).alias("_p"),
        )
        .withColumn("_p", F.greatest(F.col("_p") - F.col("_whole"), F.lit(0.0)))
    )
    done, left = None, int(plan["_units"].max() or 0) if len(plan) else 0
    blocks = -(-left // block)
    while True:
        last = blocks <= 1
        out = written(_balanced(fly, ["_s", "_block"], last), "mix-flight")
        if last:
            done = out if done is None else done.unionByName(out)
            break
        closed = (F.col("_p") <= EPS) | (F.col("_p") >= 1 - EPS)
        part = out.filter(closed)
        done = part if done is None else done.unionByName(part)
        merged = max(2, block // 4)
        fly = out.filter(~closed).withColumn("_block", F.floor(F.col("_block") / merged))
        blocks = -(-blocks // merged)
    picks = done.select(F.struct(F.col("_s").alias("source"), F.col("_id").alias("doc_id"), F.col("_size").alias("size")).alias("__mx_k"), (F.col("_whole") + F.round("_p")).cast("long").alias("__mx_extra"))
    picks = picks.join(rates, F.col("__mx_k.source").eqNullSafe(F.col("_source"))).select("__mx_k", "__mx_extra", "source_size", "target", F.floor("_f").alias("__mx_base"))
    new = ["source_size", "target", "copies"]
    keep = others(docs, *new)
    own = rows.select(*keep, "__mx_k")
    nth = F.row_number().over(Window.partitionBy("__mx_k").orderBy(F.lit(0)))
    return own.join(picks, "__mx_k").withColumn("copies", (F.col("__mx_base") + F.when(nth <= F.col("__mx_extra"), 1).otherwise(0)).cast("long")).select(*keep, *new)
