"""Packing documents into sequences of a fixed number of tokens: best-fit decreasing over a segment tree of remaining capacities."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from skyfold.llm import lex
from skyfold.llm.store import columns, prepare, written
from skyfold.llm.tokens import ENCODE_BYTES, byte_map

CAPACITY = 4096
END_ID = 1
BUCKET_ROWS = 8192
CACHE_BYTES = 48 << 20
CACHED_PIECE = 64
_PIECE = ~np.isin(lex._byte, [0x20, 0x09, 0x0A, 0x0D])
_LETTER = (lex._byte >= 0x61) & (lex._byte <= 0x7A) | (lex._byte >= 0x41) & (lex._byte <= 0x5A)
_MARK = np.isin(lex._byte, [ord(c) for c in ".,;:!?"])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words:
    """Ids of many texts by a tokenizer that lower-cases and drops white space, each distinct piece encoded once.

    Pieces are runs without blank, tab or line end, cut once more before a mark that follows a letter: no token, normal form or special
    token of such a tokenizer reaches over these places.  Pieces that are one letter run go straight to the library's model, all others
    through its whole ``encode_batch``.  The cache of pieces is bounded in bytes.
    """

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.map = byte_map()
        self.one = re.compile(r"[a-zà-öø-ÿ]+")
        self.known: dict[bytes, bytes] = {}
        self.used = 0

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        got, whole, model, table = {}, [], self.tok.model, self.map
        for p in pieces:
            s = p.decode().lower()
            if self.one.fullmatch(s):
                got[p] = np.array([t.id for t in model.tokenize("".join([table[b] for b in s.encode()]))], "<u4").tobytes()
            else:
                whole.append(p)
        for p, e in zip(whole, self.tok.encode_batch([p.decode() for p in whole], add_special_tokens=False)):
            got[p] = np.array(e.ids, "<u4").tobytes()
        for p, ids in got.items():
            if len(p) <= CACHED_PIECE:
                self.known[p] = ids
                self.used += len(p) + len(ids) + 160
        return got

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        n = len(off) - 1
        if b"<|" not in buf.tobytes():  # a special token counts only as it is written
            buf = lex.LOWER[buf]
        starts, ends, doc = lex.words(buf, off, _PIECE)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(n, np.int64)
        mark = np.flatnonzero(_MARK[buf[1:]] & _LETTER[buf[:-1]]) + 1
        mark = mark[~np.isin(mark, off, assume_unique=True)] if n > 1 else mark
        held = _PIECE[buf]
        # the pieces without the blanks between them, in a row
        upto = np.cumsum(ends - starts)
        new = np.zeros(upto[-1] + 1, bool)
        new[0] = new[upto] = new[np.cumsum(held, dtype=np.int32)[mark] - 1] = True
        cut = np.flatnonzero(new)
        owner = doc[np.cumsum(np.bincount(np.searchsorted(cut, upto[:-1]), minlength=len(cut) - 1)[: len(cut) - 1])]
        coded = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf[held]))]).dictionary_encode()
        idx, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        if self.used > CACHE_BYTES:
            self.known.clear()
            self.used = 0
        fresh = self._learn([p for p in distinct if p not in self.known])
        parts = [self.known[p] if p in self.known else fresh[p] for p in distinct]
        flat = np.frombuffer(b"".join(parts), "<u4")
        lens = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        base = np.concatenate([[0], np.cumsum(lens)])
        size = lens[idx]
        upto = np.cumsum(size)
        out = flat[np.arange(upto[-1]) + np.repeat(base[idx] - (upto - size), size)]
        return out, np.bincount(owner, size, n).astype(np.int64)


@functools.lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): the ids of each text and ``end_id``, cut only where they exceed ``capacity``."""
    columns(docs, "doc_id", "text")
    prepare(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    kind = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *[("ids", pa.list_(pa.int32()))] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = words(path)
        for batch in batches:
            keys = batch.column("doc_id")
            buf, off = lex.raw(batch.column("text"))
            for a, b, part, offs in lex.slices(buf, off, ENCODE_BYTES):
                got, counts = own.encode(part, offs)
                got = np.insert(got, np.cumsum(counts), end_id).astype("<u4")
                counts = counts + 1
                each = -(-counts // capacity)
                doc = np.repeat(np.arange(b - a), each)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * capacity
                length = np.minimum(counts[doc] - start, capacity)
                ends = np.cumsum(length)
                cols = [
                    keys.slice(a, b - a).take(pa.array(doc)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(got[x:y]) for x, y in zip(ends - length, ends)], pa.int64()),
                ]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(got.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, schema=kind)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Tree:
    """A segment tree over remaining capacities 0..capacity: which of them have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def mark(self, at: int, on: bool) -> None:
        at += self.size
        self.any[at] = on
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def first(self, at: int) -> int | None:
        """The least marked place from ``at`` on: up until a right sibling is marked, then down to its left-most mark."""
        at += self.size
        if not self.any[at]:
            while at & 1 or not self.any[at + 1]:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < self.size:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing for ``counts[length]`` pieces of each length; the plan and the number of bins.

    Pieces of one length are alike, and so are bins filled alike: bins are kept in groups ``count, [(length, pieces a bin, first rank)]``
    by remaining capacity.  The tree gives the tightest open capacity in logarithmic time; as a bin that took a piece is tighter than
    before, it takes further pieces of that length while they fit, exactly as one by one.  So the work depends on the lengths that
    occur (at most ``capacity``), not on the number of documents.

    A row ``length, first, last, per, base, offset`` of the plan: pieces of ``length`` with ranks first..last-1 lie ``per`` to a bin in
    the bins from ``base`` on, from place ``offset`` there.  A group is cut at most twice a length and holds at most 90 different
    lengths, which bounds the plan for every input.
    """
    tree, open_ = Tree(capacity), {}
    done = []

    def add(left: int, group: tuple) -> None:
        if left == 0:
            done.append(group)
            return
        open_.setdefault(left, []).append(group)
        if len(open_[left]) == 1:
            tree.mark(left, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0

        def put(bins: int, per: int, room: int, held: list) -> None:
            nonlocal left, rank
            add(room - per * length, (bins, [*held, (length, per, rank)]))
            left -= bins * per
            rank += bins * per

        while left:
            room = tree.first(length)
            if room is None:
                per = capacity // length
                if left >= per:
                    put(left // per, per, capacity, [])
                if left:
                    put(1, left, capacity, [])
                continue
            bins, held = open_[room].pop()
            if not open_[room]:
                tree.mark(room, False)
            per = min(room // length, left)
            full = min(bins, left // per)
            if bins > full:
                add(room, (bins - full, [(n, m, r + full * m) for n, m, r in held]))
            put(full, per, room, held)
    plan, base = [], 0
    for bins, held in done + [g for groups in open_.values() for g in groups]:
        offset = 0
        for n, m, r in held:
            plan.append((n, r, r + bins * m, m, base, offset))
            offset += n * m
        base += bins
    return np.array(sorted(plan), np.int64).reshape(-1, 6), base


def numbered(parts: DataFrame) -> DataFrame:
    """``rank`` of every row among those of its length, from 0: by place in the files, inside buckets of about BUCKET_ROWS rows, moved by earlier buckets."""
    n = max(1, -(-parts.count() // BUCKET_ROWS))
    rows = parts.withColumn("__file", F.col("_metadata.file_name")).withColumn("__row", F.col("_metadata.row_index"))
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64("__file", F.shiftright("__row", 8)), F.lit(n)))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("__n")).select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("length", "__bucket").orderBy("__file", "__row")
    placed = rows.withColumn("__i", F.row_number().over(inside)).join(bases, ["length", "__bucket"])
    return placed.select(*parts.columns, (F.col("__base") + F.col("__i") - 1).alias("rank"))


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of ``docs(doc_id, text)`` with ``sequence_id`` and ``offset``, in few sequences of at most ``capacity`` tokens.

    Only the number of pieces of each length (at most ``capacity`` rows) comes to the driver; its plan is of bounded size and each piece
    finds its place by its length and its rank among pieces of that length.  Sequences are numbered from 0 and filled without gaps.

    Null and empty texts give one piece with the end id alone; a null doc_id stays null; rows alike are packed each; an empty table
    gives no rows; other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    parts = written(pieces(docs, capacity, tokenizer, end_id, with_ids), "pack-pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan, _ = best_fit(counts, capacity)
    shift = np.int64(1 << 48)
    keys = plan[:, 0] * shift + plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = plan[np.searchsorted(keys, length * shift + rank, "right") - 1]
            nth = rank - row[:, 1]
            more = [pa.array(row[:, 4] + nth // row[:, 3]), pa.array(row[:, 5] + nth % row[:, 3] * length)]
            kept = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(kept + more, names=[*names, "sequence_id", "offset"])

    names = parts.columns
    schema = ", ".join(f"{n} {t}" for n, t in parts.dtypes)
    return numbered(parts).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, doc_ids, starts``: the tokens of every sequence of ``pack(..., with_ids=True)``, and its documents with their places."""
    part = F.struct("offset", "doc_id", "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    return rows.select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("starts"))
