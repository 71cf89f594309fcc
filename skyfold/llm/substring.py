"""Substring dedup: an FM-index per shard tells which windows of words occur in an earlier document."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyfold.llm import lex
from skyfold.llm.fmindex import LIMIT, FMIndex
from skyfold.llm.store import columns, prepare, written

WINDOW = 50
GRAM = 8  # words of an anchor
CUT = 64  # windows of a passage, at most
SHARD_WORDS = 1 << 19


def _sliding(x: np.ndarray, n: int) -> np.ndarray:
    """Least of ``n`` consecutive values, by doubling."""
    size, out = 1, x
    while 2 * size <= n:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (n - size)], out[n - size :]) if n > size else out


def passages(h: np.ndarray, doc: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and anchor of every passage.

    The anchor of a window is its least word-gram hash, which depends on the words of the window alone: equal windows have equal
    anchors wherever they stand.  A passage is a run of windows with one anchor, cut at CUT windows.
    """
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, np.zeros(0, np.uint64)
    least = _sliding(lex.grams(h, gram, 3), window - gram + 1)
    valid = doc[: len(least)] == doc[window - 1 :]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1 : len(least)] != doc[: len(least) - 1])
    start = np.flatnonzero(valid & (new | np.concatenate([[True], ~valid[:-1]])))
    stop = np.flatnonzero(valid & (np.concatenate([new[1:], [True]]) | np.concatenate([~valid[1:], [True]]))) + 1
    parts = -(-(stop - start) // CUT)
    run = np.repeat(np.arange(len(start)), parts)
    piece = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = start[run] + piece * CUT
    return first, np.minimum(stop[run] - first, CUT), least[start[run]]


def joined(buf: np.ndarray, off: np.ndarray) -> list[bytes]:
    """The words of each text, one blank between."""
    if not len(buf):
        return [b""] * (len(off) - 1)
    word = lex.SPACED[buf]
    before = np.concatenate([[False], word[:-1]])
    before[off[:-1][off[:-1] < len(buf)]] = False
    keep = word | before
    out = np.where(word, buf, np.uint8(0x20))[keep].tobytes()
    at = np.concatenate([[0], np.cumsum(keep)])[off]
    return [out[a:b].rstrip(b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


SCAN = "doc_id long, key_a long, key_b long, n_words long, sha string, anchors array<long>"


def _lexed(batch: pa.RecordBatch):
    buf, off = lex.raw(batch.column("text"))
    for i, j, part, offs in lex.slices(buf, off):
        starts, ends, doc = lex.words(part, offs)
        h = lex.spans_hash(part, starts, ends)
        first = np.searchsorted(doc, np.arange(j - i + 1))
        key_a = lex.sequence_hash(h, first[:-1], first[1:], 11).astype(np.int64)
        yield i, j, part, offs, starts, ends, doc, h, first, key_a


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: a 128-bit key of its word sequence, its words, the digest of all of them, and its distinct anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, sha, anchors = [], [], [], [], []
            for i, j, part, offs, _, _, doc, h, first, key_a in _lexed(batch):
                a += key_a.tolist()
                b += lex.sequence_hash(h, first[:-1], first[1:], 12).astype(np.int64).tolist()
                n += np.diff(first).tolist()
                sha += [hashlib.sha256(x).hexdigest() for x in joined(part, offs)]
                at, _, anchor = passages(h, doc)
                cut = np.searchsorted(doc[at] if len(at) else at, np.arange(j - i + 1))
                anchors += [np.unique(anchor[cut[d] : cut[d + 1]]).astype(np.int64) for d in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(anchors, pa.list_(pa.int64()))], names=["doc_id", "key_a", "key_b", "n_words", "sha", "anchors"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCAN)


def _passage_rows(rows: DataFrame, with_text: bool) -> DataFrame:
    """Passages of ``rows(doc_id, key_a, text, anchors)`` whose anchor is wanted; the text of a passage is the bytes from its first word to its last."""
    names = ["anchor", "ctx_a", "ctx_b", "doc_id", "key_a", "start", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, wanted, keys = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("anchors"), batch.column("key_a").to_numpy(zero_copy_only=False)
            for i, j, part, _, starts, ends, doc, h, first, key_a in _lexed(batch):
                at, n, anchor = passages(h, doc)
                if not len(at):
                    continue
                signed, owner = anchor.astype(np.int64), doc[at]
                cut = np.searchsorted(owner, np.arange(j - i + 1))
                take = np.zeros(len(at), bool)
                for d in range(j - i):
                    if keys[i + d] == key_a[d] and cut[d] < cut[d + 1]:
                        take[cut[d] : cut[d + 1]] = np.isin(signed[cut[d] : cut[d + 1]], wanted[i + d].values.to_numpy())
                at, n, signed, owner = at[take], n[take], signed[take], owner[take]
                end = at + n + WINDOW - 1
                cols = [
                    pa.array(signed), pa.array(lex.sequence_hash(h, at, end, 21).astype(np.int64)), pa.array(lex.sequence_hash(h, at, end, 22).astype(np.int64)),
                    pa.array(ids[i + owner], pa.int64()), pa.array(keys[i + owner], pa.int64()), pa.array(at - first[owner]), pa.array(end - at),
                ]
                if with_text:
                    data = part.tobytes()
                    cols.append(pa.array([data[x:y] for x, y in zip(starts[at].tolist(), ends[end - 1].tolist())], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, *["text"] * with_text])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", text binary" * with_text)


def shard_matches(texts: list[bytes], first: np.ndarray, indexed: np.ndarray, streamed: np.ndarray, window: int = WINDOW, limit: int = LIMIT) -> list[list[tuple[int, int]]]:
    """For each streamed passage the spans of words whose windows occur in an indexed passage of an earlier document.

    Indexed passages go into FM-indexes of at most ``limit`` symbols; every streamed passage is searched backwards in each.  Where the
    match reaches ``window`` words, the interval is one group of equal windows, which knows its earliest document.
    """
    buf, off = lex.raw(pa.array(texts, pa.binary()))
    starts, ends, doc = lex.words(buf, off)
    edges = np.empty(2 * len(starts) + 1, np.int64)
    edges[0:-1:2], edges[1::2], edges[-1] = starts, ends, len(buf)
    spans = pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf))])
    codes = spans.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode()
    symbols = codes.indices.to_numpy().astype(np.int64) + 1
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    earliest = np.full(len(symbols), np.iinfo(np.int64).max)
    rows = np.flatnonzero(indexed)
    sizes = np.cumsum(at[rows + 1] - at[rows] + 1)
    lane = np.flatnonzero(streamed)
    done = 0
    while done < len(rows):
        base = sizes[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(sizes, base + limit, "right")))
        part = rows[done:upto]
        n = at[part + 1] - at[part] + 1
        total = int(n.sum())
        where = np.repeat(at[part] - (np.cumsum(n) - n), n) + np.arange(total)
        gap = np.cumsum(n) - 1
        where[gap] = 0
        flat = symbols[where]
        flat[gap] = 0
        owner = np.repeat(first[part], n)
        local, coded = np.unique(flat, return_inverse=True)
        if local[0] != 0:
            coded = coded + 1
        index = FMIndex(coded, window)
        lowest = np.minimum.reduceat(owner[index.suffixes], np.flatnonzero(np.concatenate([[True], index.groups[1:] != index.groups[:-1]])))
        place = np.searchsorted(local, symbols)
        place[place == len(local)] = 0
        seen = np.where(local[place] == symbols, place + (local[0] != 0), -1)
        for _, pos, size, low in index.matching(seen, at[lane], at[lane + 1]):
            full = size == window
            earliest[pos[full]] = np.minimum(earliest[pos[full]], lowest[index.groups[low[full]]])
        done = upto
    out = []
    for r in lane:
        hit = np.flatnonzero(earliest[at[r] : at[r + 1]] < first[r])
        if not len(hit):
            out.append([])
            continue
        cut = np.flatnonzero(np.diff(hit) > window)
        out.append(list(zip(hit[np.concatenate([[0], cut + 1])].tolist(), (hit[np.concatenate([cut, [len(hit) - 1]])] + window).tolist())))
    return out


def _matched(passage: DataFrame, total: int) -> DataFrame:
    """``anchor, ctx_a, ctx_b, runs`` of distinct passages, by shards of anchors.

    A shard holds anchors of about SHARD_WORDS words.  An anchor with more words than that is dealt over a grid: its passages are cut in
    R parts, and cell (i, j) indexes part i and streams part j, so no task holds all of a hot anchor and no pair of parts is missed.
    """
    shards = max(1, -(-total // SHARD_WORDS))
    hot = passage.groupBy("anchor").agg(F.ceil(F.sum("words") / SHARD_WORDS).alias("r")).filter("r > 1")
    cells = passage.join(hot, "anchor", "left").withColumn("r", F.coalesce("r", F.lit(1).cast("long")))
    cells = cells.withColumn("own", F.pmod("ctx_a", "r"))
    every = F.sequence(F.lit(0).cast("long"), F.col("r") - 1)
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"))
    cells = cells.withColumn("cell", F.explode(F.array_distinct(F.concat(F.transform(every, lambda j: pair(F.col("own"), j)), F.transform(every, lambda i: pair(i, F.col("own")))))))
    cells = cells.select(
        F.pmod(F.xxhash64("anchor", "cell"), F.lit(shards)).alias("shard"), "anchor", F.col("cell.i").alias("i"), F.col("cell.j").alias("j"), "ctx_a", "ctx_b", "first", "text",
        (F.col("cell.i") == F.col("own")).alias("indexed"), (F.col("cell.j") == F.col("own")).alias("streamed"),
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["anchor", "i", "j", "ctx_a", "ctx_b"]).reset_index(drop=True)
        streamed = pdf["streamed"].to_numpy(bool)
        runs = shard_matches(pdf["text"].tolist(), pdf["first"].to_numpy(np.int64), pdf["indexed"].to_numpy(bool), streamed)
        out = pdf.loc[streamed, ["anchor", "ctx_a", "ctx_b"]].copy()
        out["runs"] = [[{"a": a, "b": b} for a, b in x] for x in runs]
        return out[[bool(x) for x in runs]]

    found = cells.groupBy("shard").applyInPandas(run, "anchor long, ctx_a long, ctx_b long, runs array<struct<a:long,b:long>>")
    return found.groupBy("anchor", "ctx_a", "ctx_b").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def find_repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scanned rows with the first document of their word sequence, candidate texts, and word spans to remove by ``doc_id, key_a``."""
    scan = written(scanned(docs), "sub-scan")
    named = scan.filter("doc_id IS NOT NULL")
    firsts = named.groupBy("key_a", "key_b").agg(F.min("doc_id").alias("first"))
    rows = scan.join(firsts, ["key_a", "key_b"], "left")
    reps = named.join(firsts, ["key_a", "key_b"]).filter("doc_id = first").select("doc_id", "key_a", F.explode("anchors").alias("anchor"))
    shared = reps.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    wanted = reps.join(shared, "anchor").groupBy("doc_id", "key_a").agg(F.collect_set("anchor").alias("anchors"))
    cand = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id"), "sub-candidates")
    key = ["anchor", "ctx_a", "ctx_b"]
    passage = written(_passage_rows(cand, True).groupBy(*key).agg(F.min("doc_id").alias("first"), F.min("words").alias("words"), F.first("text").alias("text")), "sub-passages")
    total = passage.agg(F.sum("words")).first()[0] or 0
    runs = written(_matched(passage, total), "sub-runs")
    found = passage.select(*key, "first").join(runs, key, "left")
    placed = _passage_rows(cand, False).join(found, key).filter("doc_id > first OR runs IS NOT NULL")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("words").alias("b")))
    span = placed.select("doc_id", "key_a", "start", F.explode(F.when(F.col("doc_id") > F.col("first"), whole).otherwise(F.col("runs"))).alias("s"))
    spans = span.groupBy("doc_id", "key_a").agg(F.collect_set(F.struct((F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b"))).alias("spans"))
    return rows, cand, spans


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, n_words, n_removed, kept_sha256, kept`` (the kept words; null if all stay).

    A window is 50 consecutive words of one document.  Each word is removed that a window covers whose word sequence also starts in a
    document with a smaller doc_id; windows are judged on the input.

    1. Rows with one word sequence (by a 128-bit key) are judged once: in all but the first document every window is a repeat.
    2. Equal windows have equal anchors (the least hash of their word 8-grams), so only passages whose anchor stands in two documents
       can hold repeats.  Equal passages are merged to the smallest doc_id before they move.
    3. Passages go to shards by anchor.  A shard builds a compressed FM-index over its passages (wavelet matrix over the BWT) and
       streams them through it by backward search; matches of 50 words report the earliest document that holds them.

    Null or empty texts and texts under 50 words keep everything; a null doc_id is neither earlier nor later than any other, so its
    row keeps everything; rows that share a doc_id do not remove each other's words; an empty table gives no rows.
    """
    columns(docs, "doc_id", "text")
    prepare(docs.sparkSession)
    rows, cand, spans = find_repeats(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, spans_ = batch.column("doc_id"), batch.column("key_a").to_numpy(zero_copy_only=False), batch.column("spans").to_pylist()
            take, gone, kept = [], [], []
            for i, j, part, _, starts, ends, _, _, first, key_a in _lexed(batch):
                data = part.tobytes()
                for d in range(j - i):
                    if keys[i + d] != key_a[d]:
                        continue
                    n = int(first[d + 1] - first[d])
                    left = np.ones(n, bool)
                    for s in spans_[i + d]:
                        left[s["a"] : s["b"]] = False
                    own = np.flatnonzero(left) + first[d]
                    take.append(i + d)
                    gone.append(n - len(own))
                    kept.append(b" ".join([data[a:b] for a, b in zip(starts[own].tolist(), ends[own].tolist())]).decode())
            picked = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(picked), batch.column("key_a").take(picked), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k.encode()).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.string())], names=["doc_id", "key_a", "n_removed", "kept_sha256", "kept"])

    cut = cand.select("doc_id", "key_a", "text").join(spans, ["doc_id", "key_a"]).mapInArrow(run, "doc_id long, key_a long, n_removed long, kept_sha256 string, kept string").dropDuplicates(["doc_id", "key_a"])
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= WINDOW)
    out = rows.select("doc_id", "key_a", "n_words", "sha", copy.alias("copy")).join(cut, ["doc_id", "key_a"], "left")
    return out.select(
        "doc_id", "n_words", F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept")
