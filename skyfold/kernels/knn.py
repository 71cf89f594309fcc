"""Exact k-nearest-neighbour join on an adaptive grid.

* Coincident targets are limited to the ``k + 1`` smallest ids, which cannot
  change any answer and bounds a pile of copies.
* Keys of few targets are done at once: all of them ride with each block of
  queries, and a box bound leaves out those that no query of a slice can need.
* The cell size of other keys is halved until no tile of cells (with its
  one-cell rim) holds more than ``max_tile`` targets, so a dense spot never
  becomes one large group; tiles with many queries are salted.
* Round 0 meets each tile of queries with its targets and rim in one vectorised
  task.  A query is final once its k-th distance is inside the covered box.
* Unresolved queries meet the boxes of their key, a bounded number of them: the
  nearest boxes give a distance that is surely enough, and only boxes within it
  are joined with their points, box by box, with one row per query and box.
* Queries at one place have one answer: where many coincide, a place is asked
  once and its answer joined back to its points.
* A caller that needs only a figure of each query's neighbours (``folded``) gets
  it from the task that found them, one row per place instead of ``k`` per point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd

from pyspark.sql import DataFrame, Window, functions as F

from skyfold.session import cut, once

# Targets of a key that ride with its queries, queries of such a block and of a slice in it, keys that are broadcast, boxes of a key, queries of a tile.
FEW = 4096
BLOCK = 65_536
SLICE = 256
FEW_KEYS = 20_000
BOXES = 1024
BUSY = 16_384


def _cells(df: DataFrame, sizes: DataFrame, keys: list[str], dims: list[str], names: list[str]) -> DataFrame:
    return df.join(sizes, keys).select(
        *df.columns, "_c", *[F.floor(F.col(d) / F.col("_c")).alias(n) for d, n in zip(dims, names)]
    )


def _smallest(d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns, values and places of the ``k`` least finite values of each row and all that equal the last; the k-th value."""
    w = min(k, d2.shape[1])
    far = d2.min(axis=1) if w == 1 else np.partition(d2, w - 1, axis=1)[:, w - 1]
    r, c = np.nonzero((d2 <= far[:, None]) & np.isfinite(d2))
    v = d2[r, c]
    o = np.lexsort((c, v, r))
    r, c, v = r[o], c[o], v[o]
    return r, c, v, np.arange(len(r)) - np.searchsorted(r, r), far


def _squares(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``t``."""
    d2 = np.zeros((len(x), len(t)))
    for i in range(x.shape[1]):
        d2 += (x[:, i][:, None] - t[:, i][None, :]) ** 2
    return d2


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)


class Fold(NamedTuple):
    """What is kept of the neighbours of a query: ``run(start, d2, extra)`` gets the neighbours of all queries in order of distance, those of
    a query beginning at its ``start``, and returns the columns of ``schema``, one value per query; NaN in the first drops the query."""

    schema: str
    run: Callable[[np.ndarray, np.ndarray, list[np.ndarray]], list[np.ndarray]]

    @property
    def names(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]


def _spread(start: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` rows the number of its query."""
    return np.repeat(np.arange(len(start)), np.diff(np.r_[start, n]))


def _taken(start: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """How many points of each place count among the k nearest, the query itself (at the first place) left out."""
    w = weight.astype(np.int64)
    w[start] -= 1
    before = np.cumsum(w) - w
    return np.clip(k - (before - before[start][_spread(start, len(w))]), 0, w)


def mean_distance(k: int) -> Fold:
    """Mean distance to the k nearest other points; a place carries the number of its points."""

    def run(start: np.ndarray, d2: np.ndarray, extra: list[np.ndarray]) -> list[np.ndarray]:
        take = _taken(start, extra[0], k)
        n = np.add.reduceat(take, start)
        return [np.where(n > 0, np.add.reduceat(np.sqrt(d2) * take, start) / np.maximum(n, 1), np.nan)]

    return Fold("mean double", run)


def median_distance(k: int) -> Fold:
    """Median of the distances above 0 to the k nearest other points; a place carries the number of its points."""

    def run(start: np.ndarray, d2: np.ndarray, extra: list[np.ndarray]) -> list[np.ndarray]:
        d = np.sqrt(d2)
        take = np.where(d > 0, _taken(start, extra[0], k), 0)
        up = np.cumsum(take)
        n, base = np.add.reduceat(take, start), up[start] - take[start]
        at = [np.minimum(np.searchsorted(up, base + i, "right"), len(d) - 1) for i in (np.maximum(n - 1, 0) // 2, n // 2)]
        return [np.where(n > 0, 0.5 * d[at[0]] + 0.5 * d[at[1]], np.nan)]

    return Fold("median double", run)


def covariance() -> Fold:
    """Number of the neighbours and the six covariances of the three coordinates they carry."""

    def run(start: np.ndarray, d2: np.ndarray, extra: list[np.ndarray]) -> list[np.ndarray]:
        row = _spread(start, len(d2))
        n = np.diff(np.r_[start, len(d2)])
        off = [x - (np.add.reduceat(x, start) / n)[row] for x in (e.astype(float) for e in extra[:3])]
        return [n.astype(float), *[np.add.reduceat(off[i] * off[j], start) / n for i in range(3) for j in range(i, 3)]]

    return Fold("n double, xx double, xy double, xz double, yy double, yz double, zz double", run)


def _folded_rows(fold: Fold, first: pd.DataFrame, start: np.ndarray, d2: np.ndarray, extra: list[np.ndarray]) -> pd.DataFrame:
    """The rows ``first`` (one per query) with what is kept of their neighbours."""
    first = first.reset_index(drop=True)
    got = fold.run(start, d2, extra) if len(start) else [np.zeros(0)] * len(fold.names)
    for c, v in zip(fold.names, got):
        first[c] = v
    return first[~np.isnan(got[0])]


def _rank_all(q: pd.DataFrame, t: pd.DataFrame, d: int, k: int, exclude_self: bool, names: list[str], extra: list[str], columns: list[str], fold: Fold | None = None) -> pd.DataFrame:
    """Nearest of all targets ``t`` for each of the queries ``q``; columns ``names`` of a query stay."""
    q = q.reset_index(drop=True)
    t = t.sort_values("_tid", kind="stable").reset_index(drop=True)
    xs, ts = q[[f"_p{i}" for i in range(d)]].to_numpy(float), t[[f"_t{i}" for i in range(d)]].to_numpy(float)
    q, xs = (q[ok].reset_index(drop=True), xs[ok]) if not (ok := np.isfinite(xs).all(1)).all() else (q, xs)
    t, ts = (t[ok].reset_index(drop=True), ts[ok]) if not (ok := np.isfinite(ts).all(1)).all() else (t, ts)
    qid, tid = q["_qid"].to_numpy(), t["_tid"].to_numpy()
    n, m, need = len(q), len(t), k + exclude_self
    rows, cols, dist, rank = [], [], [], []
    if n and m:
        span = xs.max(0) - xs.min(0)
        side = max(float(span.max()), 1e-9) / max(1.0, (n / SLICE) ** (1 / d))
        order = np.lexsort(np.floor((xs - xs.min(0)) / side).T[::-1])
        for part in (order[a : a + SLICE] for a in range(0, n, SLICE)):
            x = xs[part]
            lo, hi = x.min(0), x.max(0)
            near = np.arange(m)
            if m > need:
                enough = np.partition((np.maximum(np.abs(ts - lo), np.abs(ts - hi)) ** 2).sum(1), need - 1)[need - 1]
                near = np.flatnonzero((np.maximum(np.maximum(lo - ts, ts - hi), 0.0) ** 2).sum(1) <= enough * (1 + 1e-9))
            step = max(1, 400_000 // len(near))
            for some in (part[a : a + step] for a in range(0, len(part), step)):
                d2 = _squares(xs[some], ts[near])
                if exclude_self:
                    d2[qid[some][:, None] == tid[near][None, :]] = np.inf
                r, c, v, place, _ = _smallest(d2, k)
                keep = place < k
                rows.append(some[r[keep]]), cols.append(near[c[keep]]), dist.append(v[keep]), rank.append(place[keep] + 1)
    r, c = _joined(rows, int), _joined(cols, int)
    if fold:
        start = np.flatnonzero(_joined(rank, int) == 1)
        return _folded_rows(fold, q.loc[r[start], names], start, _joined(dist, float), [t[e].to_numpy()[c] for e in extra]).assign(rank=1)[columns]
    out = q.loc[r, names].reset_index(drop=True)
    out["_d2"], out["_tid"], out["rank"] = _joined(dist, float), tid[c], _joined(rank, int)
    for e in extra:
        out[e] = t[e].to_numpy()[c]
    return out[columns]


def _rank_tile(q: pd.DataFrame, t: pd.DataFrame, d: int, k: int, inner: int, exclude_self: bool, keys: list[str], extra: list[str], columns: list[str], fold: Fold | None = None) -> pd.DataFrame:
    """Nearest targets of the queries of one tile, block by block of ``inner`` cells with a one-cell rim.

    Rank 0 marks a query that needs a wider look.
    """
    q = q.reset_index(drop=True)
    t = t.sort_values("_tid", kind="stable").reset_index(drop=True)
    xs, ts = q[[f"_p{i}" for i in range(d)]].to_numpy(float), t[[f"_t{i}" for i in range(d)]].to_numpy(float)
    n, m = len(q), len(t)
    qid, tid = q["_qid"].to_numpy(), t["_tid"].to_numpy()
    whole = q["_whole"].to_numpy(bool)
    size = float(q["_c"].iloc[0]) if n else 1.0
    final = whole.copy() if m == 0 else np.zeros(n, bool)
    rows, cols, dist, rank = [], [], [], []
    sub = np.floor_divide(q[[f"_q{i}" for i in range(d)]].to_numpy(), inner)
    order = np.lexsort(sub.T[::-1])
    cuts = np.flatnonzero(np.r_[True, (np.diff(sub[order], axis=0) != 0).any(1)]) if n else []
    for group in np.split(order, cuts[1:]) if n and m else []:
        lo = (sub[group[0]] * inner - 1) * size
        hi = ((sub[group[0]] + 1) * inner + 1) * size
        near = np.flatnonzero(((ts >= lo) & (ts < hi)).all(1))
        if not len(near):
            continue
        step = max(1, 400_000 // len(near))
        for part in (group[a : a + step] for a in range(0, len(group), step)):
            x = xs[part]
            safe = np.minimum(x - lo, hi - x).min(1)
            d2 = _squares(x, ts[near])
            if exclude_self:
                d2[qid[part][:, None] == tid[near][None, :]] = np.inf
            r, c, v, place, far = _smallest(d2, k)
            got = np.bincount(r, minlength=len(part))
            ok = (whole[part] & (len(near) == m)) | ((got >= k) & np.isfinite(far) & (np.sqrt(far) <= safe))
            final[part] = ok
            keep = (place < k) & ok[r]
            rows.append(part[r[keep]]), cols.append(near[c[keep]]), dist.append(v[keep]), rank.append(place[keep] + 1)
    r, c = _joined(rows, int), _joined(cols, int)
    named = [*keys, "_qid", *([f"_p{i}" for i in range(d)] if fold else [])]
    if fold:
        start = np.flatnonzero(_joined(rank, int) == 1)
        out = _folded_rows(fold, q.loc[r[start], named], start, _joined(dist, float), [t[e].to_numpy()[c] for e in extra]).assign(rank=1)
    else:
        out = q.loc[r, named].reset_index(drop=True)
        out["_d2"], out["_tid"], out["rank"] = _joined(dist, float), tid[c], _joined(rank, int)
        for e in extra:
            out[e] = t[e].to_numpy()[c]
    left = q.loc[~final, named].copy()
    left["rank"] = 0
    return pd.concat([out, left.reindex(columns=out.columns)], ignore_index=True)[columns] if len(left) else out[columns]


def _nearest(pairs: DataFrame, keys: list[str], k: int, extra: list[str]) -> DataFrame:
    """The k best ``(_d2, _tid)`` per query."""
    w = Window.partitionBy(*keys, "_qid").orderBy("_d2", "_tid")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*keys, "_qid", "_d2", "_tid", *extra, "rank")


def _types(*frames: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for df in frames for f in df.schema} | {"_d2": "double", "rank": "int"}


def _kept(fold: Fold | None) -> dict[str, str]:
    return dict(c.split() for c in fold.schema.split(", ")) if fold else {}


def _salted(q: DataFrame, t: DataFrame, group: list[str], size: int) -> tuple[DataFrame, DataFrame]:
    """Groups of many queries are dealt to several tasks by ``_salt``; the targets of the group go to each of them."""
    busy = q.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / size).alias("_salts")).filter("_salts > 1")
    q = q.join(busy, group, "left").withColumn("_salt", F.pmod(F.xxhash64("_qid"), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    t = t.join(busy, group, "left")
    t = t.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return q, t.select(*[F.col(c).alias(c) for c in t.columns])


def _ranked_by(q: DataFrame, t: DataFrame, group: list[str], size: int, d: int, k: int, exclude_self: bool, names: list[str], extra: list[str], fold: Fold | None = None) -> DataFrame:
    """Nearest targets of the same ``group`` for each query, ``names`` of the query kept."""
    q, t = _salted(q, t, group, size)
    columns = [*names, "rank", *fold.names] if fold else [*names, "_d2", "_tid", "rank", *extra]
    types = _types(t, q) | _kept(fold)

    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _rank_all(left, right, d, k, exclude_self, names, extra, columns, fold)

    n, at = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*group, "_salt"]
    both = q.repartition(n, *at).groupBy(*at).cogroup(t.repartition(n, *at).groupBy(*at))
    return both.applyInPandas(task, ", ".join(f"{c} {types[c]}" for c in columns))


def _boxes(placed: DataFrame, keys: list[str], axes: list[str], td: list[str]) -> tuple[DataFrame, DataFrame]:
    """Boxes of targets, BOXES a key at most, with the range of what lies in them; the size of a key's boxes in cells."""
    cells = cut(placed.groupBy(*keys, *axes).agg(F.count(F.lit(1)).alias("_n"), *[g(t).alias(f"_{n}{i}") for i, t in enumerate(td) for n, g in (("from", F.min), ("to", F.max))]))
    scale = cut(cells.groupBy(*keys).agg(F.pow(2.0, F.greatest(F.lit(0.0), F.ceil(F.log2(F.count(F.lit(1)) / BOXES) / len(axes)))).alias("_s")))
    while True:
        at = [F.floor(F.col(a) / F.col("_s")).alias(f"_b{i}") for i, a in enumerate(axes)]
        boxes = cells.join(scale, keys).select(*keys, *at, "_n", *[f"_{n}{i}" for i in range(len(axes)) for n in ("from", "to")])
        boxes = cut(boxes.groupBy(*keys, *[f"_b{i}" for i in range(len(axes))]).agg(F.sum("_n").alias("_n"), *[g(f"_{n}{i}").alias(f"_{n}{i}") for i in range(len(axes)) for n, g in (("from", F.min), ("to", F.max))]))
        many = boxes.groupBy(*keys).count().filter(F.col("count") > BOXES)
        if many.isEmpty():
            return boxes, scale
        scale = cut(scale.join(many, keys, "left").select(*keys, F.when(F.col("count").isNull(), F.col("_s")).otherwise(F.col("_s") * 2).alias("_s")))


def _boxes_asked(q: pd.DataFrame, b: pd.DataFrame, d: int, need: int, columns: list[str]) -> pd.DataFrame:
    """Without ``_enough``, the nearest boxes of each query that hold enough targets; with it, all others that begin within it."""
    q, b = q.reset_index(drop=True), b.sort_values([f"_b{i}" for i in range(d)]).reset_index(drop=True)
    xs, lo, hi = (f[[f"{c}{i}" for i in range(d)]].to_numpy(float) for f, c in ((q, "_p"), (b, "_from"), (b, "_to")))
    count, rows, cols = b["_n"].to_numpy(), [], []
    step = max(1, 400_000 // max(1, len(b)))
    for a in range(0, len(q) if len(b) else 0, step):
        x = xs[a : a + step]
        least = np.zeros((len(x), len(b)))
        for i in range(d):
            least += np.maximum(np.maximum(lo[:, i][None, :] - x[:, i][:, None], x[:, i][:, None] - hi[:, i][None, :]), 0.0) ** 2
        w = min(need, len(b))  # a box holds one target at least
        first = np.argpartition(least, w - 1, axis=1)[:, :w]
        first = np.take_along_axis(first, np.lexsort((first, np.take_along_axis(least, first, 1)), axis=1), 1)
        got = np.cumsum(count[first], axis=1) - count[first]
        home = np.zeros(least.shape, bool)
        np.put_along_axis(home, first, got < need, 1)
        if "_enough" in q:
            home = ~home & (least <= q["_enough"].to_numpy(float)[a : a + step, None] * (1 + 1e-9))
        r, c = np.nonzero(home)
        rows.append(r + a), cols.append(c)
    r, c = _joined(rows, int), _joined(cols, int)
    out = q.loc[r].reset_index(drop=True)
    for i in range(d):
        out[f"_b{i}"] = b[f"_b{i}"].to_numpy()[c]
    return out[columns]


def _far_round(todo: DataFrame, placed: DataFrame, keys: list[str], axes: list[str], td: list[str], k: int, need: int, exclude_self: bool, extra: list[str]) -> DataFrame:
    """Neighbours of queries that their tile could not settle."""
    d = len(axes)
    placed = placed.join(todo.select(*keys).distinct(), keys, "left_semi")
    boxes, scale = _boxes(placed, keys, axes, td)
    points = placed.join(scale, keys).select(*keys, *[F.floor(F.col(a) / F.col("_s")).alias(f"_b{i}") for i, a in enumerate(axes)], "_tid", *td, *extra)
    at = [f"_b{i}" for i in range(d)]
    names = [*keys, "_qid"]
    columns = [*names, *[f"_p{i}" for i in range(d)], *at]
    n = int(todo.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def asked(q: DataFrame) -> DataFrame:
        left, right = _salted(q, boxes, keys, BUSY)
        types = _types(right, left)

        def task(x: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return _boxes_asked(x, b, d, need, columns)

        group = [*keys, "_salt"]
        both = left.repartition(n, *group).groupBy(*group).cogroup(right.repartition(n, *group).groupBy(*group))
        return cut(both.applyInPandas(task, ", ".join(f"{c} {types[c]}" for c in columns)))

    def met(pairs: DataFrame) -> DataFrame:
        own = points.join(pairs.select(*keys, *at).distinct(), [*keys, *at], "left_semi")
        return _ranked_by(pairs, own, [*keys, *at], BUSY, d, k, exclude_self, names, extra).drop("rank")

    near = cut(met(asked(todo)))
    enough = near.groupBy(*names).agg(F.array_sort(F.collect_list("_d2")).alias("_all"))
    enough = enough.select(*names, F.coalesce(F.get("_all", F.lit(k - 1)), F.lit(float("inf"))).alias("_enough"))
    rest = asked(todo.join(enough, names, "left").withColumn("_enough", F.coalesce("_enough", F.lit(float("inf")))))
    return cut(_nearest(near.unionByName(met(rest)), keys, k, extra))


def _with_rim(placed: DataFrame, axes: list[str], tiles: list[str], side: int) -> DataFrame:
    """Targets repeated for every tile whose box, widened by one cell, holds them."""
    out = placed
    for a, w in zip(axes, tiles):
        near = F.array_distinct(F.array(*[F.floor((F.col(a) + s) / F.lit(side)) for s in (-1, 0, 1)]))
        out = out.withColumn(w, F.explode(near))
    return out


def _tile_round(todo, rim, keys, dims, td, axes, tiles, side, inner, k, exclude_self, extra, fold=None):
    """Round 0: final neighbours per tile and the queries that need more."""
    d = len(dims)
    q = todo
    for i, w in enumerate(tiles):
        q = q.withColumn(w, F.floor(F.col(f"_q{i}") / F.lit(side)))
    whole = [(F.col(w) * side - 1 <= F.col(f"_lo{i}")) & ((F.col(w) + 1) * side >= F.col(f"_hi{i}")) for i, w in enumerate(tiles)]
    q = q.select(*keys, *tiles, "_qid", *[F.col(c).alias(f"_p{i}") for i, c in enumerate(dims)], *[f"_q{i}" for i in range(d)], "_c", reduce(lambda x, y: x & y, whole).alias("_whole"))
    # only tiles with both queries and targets become groups; a query far from all targets is left to the boxes
    group = [*keys, *tiles]
    held = cut(rim.select(*group).distinct().join(q.select(*group).distinct(), group))
    t = rim.select(*group, "_tid", *td, *extra).join(held, group, "left_semi")
    asked = [*keys, "_qid", *[f"_p{i}" for i in range(d)]]
    every, lone = q.select(*asked), q.join(held, group, "left_anti").select(*asked)
    q, t = _salted(q.join(held, group, "left_semi"), t, group, BUSY)
    types = _types(t, q) | _kept(fold)
    columns = [*asked, "rank", *fold.names] if fold else [*keys, "_qid", "_d2", "_tid", "rank", *extra]
    schema = ", ".join(f"{c} {types[c]}" for c in columns)
    group = keys + tiles + ["_salt"]

    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _rank_tile(left, right, d, k, inner, exclude_self, keys, extra, columns, fold)

    # A fixed partition count: tasks here are bound by compute, so byte-based coalescing would starve them.
    n = int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q, t = q.repartition(n, *group), t.repartition(n, *group)
    hits = cut(q.groupBy(*group).cogroup(t.groupBy(*group)).applyInPandas(task, schema))
    good = hits.filter("rank > 0")
    good = good.select(*asked, *fold.names) if fold else good.select(*keys, "_qid", "_tid", "rank", F.sqrt("_d2").alias("distance"), *extra)
    more = every.join(hits.filter("rank = 0").select(*keys, "_qid"), keys + ["_qid"], "left_semi")
    return good, cut(more.unionByName(lone))


def _fold_far(far: DataFrame, todo: DataFrame, keys: list[str], d: int, extra: list[str], fold: Fold) -> DataFrame:
    """What ``fold`` keeps of the ranked rows of queries that no tile settled."""
    names = [*keys, "_qid", *[f"_p{i}" for i in range(d)]]
    lists = far.groupBy(*keys, "_qid").agg(F.sort_array(F.collect_list(F.struct("rank", "_d2", *extra))).alias("_l"))
    lists = todo.select(*names).join(lists, [*keys, "_qid"]).select(*names, *[F.expr(f"transform(_l, r -> r.{c})").alias(f"_l{i}") for i, c in enumerate(("_d2", *extra))])
    types = _types(todo) | _kept(fold)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            start = np.cumsum(np.r_[0, [len(x) for x in f["_l0"]]])[:-1].astype(int)
            flat = [np.concatenate(list(f[f"_l{i}"])) if len(f) else np.zeros(0) for i in range(1 + len(extra))]
            yield _folded_rows(fold, f[names], start, flat[0], flat[1:])[[*names, *fold.names]]

    return lists.mapInPandas(task, ", ".join(f"{c} {types[c]}" for c in (*names, *fold.names)))


def _search(pts: DataFrame, tgt: DataFrame, keys: list[str], dims: list[str], k: int, exclude_self: bool, extra: list[str], max_tile: int, fold: Fold | None = None) -> DataFrame:
    """Rows ``keys, _qid, _tid, rank, distance, extra`` of ``pts(keys, _qid, dims)``, or with ``fold`` its columns with ``_p0 ..`` of the query.

    ``tgt(keys, _tid, _t0 .., extra)`` holds no more copies of a place than matter.
    """
    d = len(dims)
    axes = [f"_g{i}" for i in range(d)]
    td = [f"_t{i}" for i in range(d)]
    need = k + (1 if exclude_self else 0)
    span = [F.max(t) - F.min(t) for t in td]
    widest = F.greatest(*span) if d > 1 else span[0]
    floor_ = F.greatest(widest * 1e-3, F.lit(1e-9))
    vol = reduce(lambda a, b: a * b, [F.greatest(s, floor_) for s in span])
    per = 0.5 * need + 0.5
    inner = max(2, round((200.0 / per) ** (1.0 / d)))
    side = 3 * inner if d > 2 else 5 * inner
    sizes = cut(tgt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.pow(vol * per / F.count(F.lit(1)), 1.0 / d).alias("_c")))
    known = sizes.count()
    small = F.broadcast if known <= FEW_KEYS else (lambda df: df)
    asked = [*keys, "_qid", *[F.col(c).alias(f"_p{i}") for i, c in enumerate(dims)]]
    names = [*keys, "_qid", *([f"_p{i}" for i in range(d)] if fold else [])]
    done = []

    def near(q: DataFrame, t: DataFrame) -> DataFrame:
        out = _ranked_by(q.select(*asked), t, keys, BLOCK, d, k, exclude_self, names, extra, fold)
        return out.drop("rank") if fold else out.withColumn("distance", F.sqrt("_d2")).drop("_d2")

    few = sizes.filter(F.col("_n") <= FEW).select(*keys)
    settled = few.count()
    if settled:
        done.append(near(pts.join(small(few), keys, "left_semi"), tgt.join(small(few), keys, "left_semi")))
        sizes = cut(sizes.filter(F.col("_n") > FEW))
    sizes = sizes.select(*keys, "_c")
    limit = max(max_tile, 4 * need)
    tiles = [f"_w{i}" for i in range(d)]
    while settled < known:
        placed = cut(_cells(tgt, small(sizes), keys, td, axes))
        rim = _with_rim(placed, axes, tiles, side)
        crowded = rim.groupBy(*keys, *tiles).count().groupBy(*keys).agg(F.max("count").alias("_m")).filter(F.col("_m") > limit)
        if crowded.isEmpty():
            break
        sizes = cut(
            sizes.join(crowded, keys, "left").select(
                *keys, F.when(F.col("_m").isNull(), F.col("_c")).otherwise(F.col("_c") / 2).alias("_c")
            )
        )
    if settled < known:
        reach = placed.groupBy(*keys).agg(
            *[F.min(a).alias(f"_lo{i}") for i, a in enumerate(axes)],
            *[F.max(a).alias(f"_hi{i}") for i, a in enumerate(axes)],
        )
        bounds = small(cut(reach.join(sizes, keys)))
        todo = _cells(pts, bounds, keys, dims, [f"_q{i}" for i in range(d)]).join(bounds.drop("_c"), keys)
        good, todo = _tile_round(todo, rim, keys, dims, td, axes, tiles, side, inner, k, exclude_self, extra, fold)
        done.append(good)
        if not todo.isEmpty():
            far = _far_round(todo, placed.drop("_c"), keys, axes, td, k, need, exclude_self, extra)
            done.append(_fold_far(far, todo, keys, d, extra, fold) if fold else far.withColumn("distance", F.sqrt("_d2")).drop("_d2"))
    if not done:  # no targets at all
        done.append(near(pts.limit(0), tgt))
    return reduce(DataFrame.unionByName, done)


def _targets(targets: DataFrame, keys: list[str], dims: list[str], tid: str, need: int, carry: list[str]) -> DataFrame:
    """Targets by the names of ``_search``, the ``need`` smallest ids of each place."""
    td = [f"_t{i}" for i in range(len(dims))]
    tgt = targets.select(*keys, F.col(tid).alias("_tid"), *[F.col(c).alias(t) for c, t in zip(dims, td)], *[F.col(c).alias(f"_x_{c}") for c in carry])
    copies = Window.partitionBy(*keys, *td).orderBy("_tid")
    return cut(tgt.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= need).drop("_copy"))


def knn(
    queries: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    dims: Sequence[str] = ("x", "y", "z"),
    k: int = 1,
    qid: str = "point_id",
    tid: str = "point_id",
    exclude_self: bool = False,
    carry: Sequence[str] = (),
    max_tile: int = 16384,
) -> DataFrame:
    """Rows ``keys, qid, neighbour, rank, distance`` plus carried target columns.

    Ties go to the smaller target id.  ``exclude_self`` skips a target whose id
    equals the query id.  Queries of keys without targets give no rows.
    """
    keys, dims, carry = list(keys), list(dims), list(carry)
    extra = [f"_x_{c}" for c in carry]
    targets, queries = once(targets), once(queries)
    tgt = _targets(targets, keys, dims, tid, k + (1 if exclude_self else 0), carry)
    pts = queries.select(*keys, F.col(qid).alias("_qid"), *dims)
    if not exclude_self and _coincide(pts, [*keys, *dims]):
        spots = cut(pts.groupBy(*keys, *dims).agg(F.min("_qid").alias("_qid")))
        out = once(_search(spots, tgt, keys, dims, k, False, extra, max_tile).join(spots, [*keys, "_qid"]).drop("_qid"))
        out = pts.join(out, [*keys, *dims])
    else:
        out = _search(pts, tgt, keys, dims, k, exclude_self, extra, max_tile)
    return out.select(
        *keys,
        F.col("_qid").alias(qid),
        F.col("_tid").alias("neighbour"),
        "rank",
        "distance",
        *[F.col(f"_x_{c}").alias(c if c not in keys + [qid] else f"{c}_t") for c in carry],
    )


def _coincide(pts: DataFrame, place: list[str]) -> bool:
    """Whether there are two points a place or more, about; this decides the way only, not the result."""
    n, places = pts.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*place))).first()
    return n >= 2 * places > 0


def folded(points: DataFrame, keys: Sequence[str], k: int, fold: Fold, others: bool, dims: Sequence[str] = ("x", "y", "z"), max_tile: int = 16384) -> DataFrame:
    """Rows ``keys, dims`` and the columns of ``fold``, one per place of ``points(keys, point_id, dims)``.

    With ``others`` it gets the k nearest other points of a point there, as places with the number of their points, else the k nearest
    points, itself included, with their coordinates.  Ties go to the smaller ``point_id``.
    """
    keys, dims = list(keys), list(dims)
    points = once(points)
    spots = cut(points.groupBy(*keys, *dims).agg(F.min("point_id").alias("_qid"), F.least(F.count(F.lit(1)), F.lit(k + 1)).alias("_x_n")))
    if others:
        tgt = spots.select(*keys, F.col("_qid").alias("_tid"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(dims)], "_x_n")
        extra = ["_x_n"]
    else:
        tgt = _targets(points, keys, dims, "point_id", k, dims)
        extra = [f"_x_{c}" for c in dims]
    out = _search(spots.drop("_x_n"), tgt, keys, dims, k + 1 if others else k, False, extra, max_tile, fold)
    return out.select(*keys, *[F.col(f"_p{i}").alias(c) for i, c in enumerate(dims)], *fold.names)
