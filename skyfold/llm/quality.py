"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by log-count ratios (NBSVM)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skyfold.llm import lex
from skyfold.llm.store import columns, prepare

SAMPLE = 12_000  # labelled rows that a model is fitted on, at most
HELD_OUT = 2  # remainder of crc32(doc_id) modulo 4 that no model learns from
THRESHOLD = 0.7
GRAM_BITS, SHAPE_BITS, WORD_BITS = 17, 16, 16
GRAMS, SHAPES, WORDS = 0, 1 << GRAM_BITS, (1 << GRAM_BITS) + (1 << SHAPE_BITS)
DIM = WORDS + (1 << WORD_BITS)
# byte classes of word shapes: lower, upper, digit, non-ASCII, closing marks, other marks
_b = lex._byte
CLASS = np.select([(_b >= 97) & (_b <= 122), (_b >= 65) & (_b <= 90), (_b >= 48) & (_b <= 57), _b >= 128, np.isin(_b, [ord(c) for c in ".,;:?'\"()-"])], [1, 2, 3, 4, 5], 6).astype(np.uint64)


def _fold(h: np.ndarray, bits: int, base: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) + base


def features(buf: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """Distinct indicator numbers of each text: byte trigrams, words, and one to three successive word shapes.

    A shape is the set of byte classes of a word, its length class and whether it repeats the word before, or one seen earlier in the
    text; so repetition, shouting and symbol noise are n-grams as well.
    """
    starts, ends, doc = lex.words(buf, off)
    h = lex.spans_hash(buf, starts, ends)
    raw = buf.astype(np.uint64)
    tri = _fold(lex.mix(raw[:-2] << np.uint64(16) | raw[1:-1] << np.uint64(8) | raw[2:]), GRAM_BITS, GRAMS) if len(buf) > 2 else np.zeros(0, np.int64)
    bits = np.uint64(1) << CLASS[buf]
    kind = np.bitwise_or.reduceat(bits, starts) if len(starts) else np.zeros(0, np.uint64)
    if len(starts):  # reduceat runs on to the next word; blanks between are one class more and are taken out
        kind &= ~np.uint64(1 << 6)
        odd = np.add.reduceat((CLASS[buf] == 6) & lex.SPACED[buf], starts) > 0
        kind |= odd.astype(np.uint64) << np.uint64(6)
    size = np.minimum(ends - starts, 255)
    kind |= np.searchsorted([2, 4, 8, 14, 30], size).astype(np.uint64) << np.uint64(8)
    same = np.zeros(len(h), np.uint64)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    kind |= same << np.uint64(12)
    first = np.searchsorted(doc, np.arange(len(off)))
    seen = np.zeros(DIM, bool)
    words = _fold(h, WORD_BITS, WORDS)
    for d in range(len(off) - 1):
        a, b = first[d], first[d + 1]
        s = kind[a:b]
        u, at, many = np.unique(h[a:b], return_index=True, return_counts=True)
        old = np.ones(b - a, np.uint64)
        old[at] = 0
        s = s | old << np.uint64(13)
        share = np.array([(len(u) * 16 // max(1, b - a)) << 8 | min(15, int(b - a).bit_length()) | 1 << 40, (many.max(initial=0) * 16 // max(1, b - a)) | 1 << 41], np.uint64)
        parts = [tri[off[d] : max(off[d], off[d + 1] - 2)], words[a:b], _fold(lex.mix(share), SHAPE_BITS, SHAPES)] if b > a else [tri[:0]]
        for n in (1, 2, 3):
            parts.append(_fold(lex.grams(s, n, 77), SHAPE_BITS, SHAPES))
        for p in parts:
            seen[p] = True
        idx = np.flatnonzero(seen)
        seen[idx] = False
        yield idx


class Model:
    """``score = sigmoid(slope * margin + level)``, margin over indicators scaled by their log-count ratios and cut to unit length."""

    def __init__(self, weight: np.ndarray, square: np.ndarray, bias: float, slope: float, level: float):
        self.weight, self.square, self.bias, self.slope, self.level = weight, square, bias, slope, level

    def margin(self, idx: np.ndarray) -> float:
        return self.bias + (self.weight[idx].sum() / np.sqrt(self.square[idx].sum() or 1.0) if len(idx) else 0.0)

    def score(self, idx: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(idx) + self.level, -30, 30))))


def log_ratio(rows: list[np.ndarray], label: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = [np.full(DIM, smooth), np.full(DIM, smooth)]
    for idx, y in zip(rows, label):
        counts[int(y)][idx] += 1
    return np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 11) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: each step solves one dual variable exactly; the bias is one more constant indicator."""
    w, bias, alpha = np.zeros(DIM), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    q = np.array([v @ v + 1.0 for v in values])
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            grad = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - grad / q[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                worst = max(worst, abs(step))
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


def platt(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and level of a logistic curve, by Newton steps on smoothed labels."""
    pos, neg = label.sum(), len(label) - label.sum()
    t = np.where(label == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones(len(margin))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ [a, b], -30, 30)))
        g = x.T @ (p - t) + [1e-6 * a, 0]
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-6
        da, db = np.linalg.solve(hess, g)
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return (float(a), float(b)) if a > 0 else (0.0, float(np.log((pos + 1) / (neg + 1))))


def fit(rows: list[np.ndarray], label: np.ndarray, cost: float = 1.0) -> Model:
    """Every fifth row only sets the curve from margins to scores.  With one class or none, the score is the smoothed share of label 1."""
    share = (label.sum() + 1) / (len(label) + 2)
    flat = Model(np.zeros(DIM), np.zeros(DIM), 0.0, 0.0, float(np.log(share / (1 - share))))
    check = np.arange(len(rows)) % 5 == 4
    if len(set(label[~check])) < 2 or len(set(label[check])) < 2:
        return flat
    own = [rows[i] for i in np.flatnonzero(~check)]
    y = label[~check]
    ratio = log_ratio(own, y)
    values = [ratio[i] / (np.linalg.norm(ratio[i]) or 1.0) for i in own]
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    w, bias = dual_descent(own, values, np.where(y == 1, 1.0, -1.0), cost * weight)
    model = Model(w * ratio, ratio**2, bias, 1.0, 0.0)
    model.slope, model.level = platt(np.array([model.margin(rows[i]) for i in np.flatnonzero(check)]), label[check])
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled documents, those with the smallest hashes of doc_id, held-out ids left out.

    Ids whose label rows disagree, null labels and labels other than 0 and 1 are left out; of repeated documents the smallest text counts.
    The sample, and with it the one task that fits, is bounded; texts are counted as indicators in the tasks that read them.
    """
    columns(docs, "doc_id", "text")
    columns(labels, "doc_id", label)
    prepare(docs.sparkSession)
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y1")).filter("y = y1").drop("y1")
    picked = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = lex.raw(batch.column("text"))
            idx = [x.astype(np.int32).tobytes() for _, _, part, offs in lex.slices(buf, off) for x in features(part, offs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(idx, pa.binary())], names=["doc_id", "y", "idx"])

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        m = fit([np.frombuffer(x, np.int32) for x in pdf["idx"]], pdf["y"].to_numpy())
        return pd.DataFrame({"weight": [m.weight.tobytes()], "square": [m.square.tobytes()], "bias": [m.bias], "slope": [m.slope], "level": [m.level]})

    counted = rows.mapInArrow(count, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, y int, idx binary")
    got = counted.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(learn, "weight binary, square binary, bias double, slope double, level double").first()
    if got is None:
        return fit([], np.zeros(0))
    return Model(np.frombuffer(got["weight"]), np.frombuffer(got["square"]), got["bias"], got["slope"], got["level"])


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all columns of ``docs``) with ``score`` of the whole text, 0 to 1; null texts count as empty and get a score too.

    The model has a fixed size and goes to every task; columns named ``score`` are replaced; an empty table gives no rows.
    """
    columns(docs, "text")
    prepare(docs.sparkSession)
    keep = [c for c in (keep if keep is not None else docs.columns) if c.lower() != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            buf, off = lex.raw(batch.column("text"))
            out = [own.score(x) for _, _, part, offs in lex.slices(buf, off) for x in features(part, offs)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.float64())], names=[*keep, "score"])

    return docs.select(*{*keep, "text"}).mapInArrow(run, schema)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, train(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, columns as they are (a column named ``score`` included)."""
    own = "__quality"
    plain = docs.withColumnRenamed("score", own)
    out = score(plain, train(docs, labels)).filter(F.col("score") >= THRESHOLD).drop("score").withColumnRenamed(own, "score")
    return out.select(*docs.columns)
