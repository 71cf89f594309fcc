"""Ranked lexical search with Block-Max MaxScore over a sharded impact index."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skyfold.llm import lex
from skyfold.llm.store import columns, prepare, written

TOP = 50
BLOCK = 128  # postings of a block
SPAN = 1024  # documents of a shard that are scored together
SHARD_BYTES = 8 << 20  # text of a shard; a longer text has its own
SLICE_BYTES = 512 << 10
QUERIES = 256  # of a task, at about this number
SALTS = 16
BROADCAST_BYTES = 16 << 20
#: One head per block of a posting list: its last document, its largest impact, least impact, where its bytes end, and the widths of a gap and an impact.
HEAD = np.dtype([("last", "<u4"), ("peak", "<u4"), ("least", "<u4"), ("end", "<u4"), ("gap", "u1"), ("wide", "u1"), ("n", "<u2")])
INDEX = "shard string, term binary, df long, heads binary, data binary"


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, int, np.ndarray, pa.Array, np.ndarray]]:
    """Slices of texts: doc_ids, bytes, the number of terms of each text, all terms in a row, and the text of each term."""
    for batch in batches:
        buf, off = lex.raw(batch.column("text"))
        for a, b, part, offs in lex.slices(buf, off, SLICE_BYTES):
            low = lex.LOWER[part]
            starts, ends, doc = lex.words(low, offs, lex.PLAIN)
            at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
            # the bytes of terms are exactly the bytes of PLAIN
            terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(low[lex.PLAIN[low]])])
            yield batch.column("doc_id").slice(a, b - a), len(part), np.bincount(doc, minlength=b - a), terms, doc


def totals(docs: DataFrame) -> tuple[int, int]:
    """N and L: documents with a term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = length = 0
        for batch in batches:
            buf, off = lex.raw(batch.column("text"))
            for a, b, part, offs in lex.slices(buf, off, SLICE_BYTES):
                counts = np.bincount(lex.words(lex.LOWER[part], offs, lex.PLAIN)[2], minlength=b - a)
                n += int((counts > 0).sum())
                length += int(counts.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "l": [length]})

    got = docs.select("doc_id", "text").mapInArrow(run, "n long, l long").agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    return got["n"] or 0, got["l"] or 0


def impacts(tf: np.ndarray, n: np.ndarray, docs: int, length: int) -> np.ndarray:
    """The share of a posting in a score, before the weight of its term."""
    m = 100 - 50 + 50 * n * docs // length
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def _spread(out: np.ndarray, at: np.ndarray, width: np.ndarray, value: np.ndarray) -> None:
    for b in range(4):
        some = width > b
        if not some.any():
            return
        out[at[some] + b] = value[some] >> 8 * b & 255


def _width(v: np.ndarray) -> np.ndarray:
    return (v > 0).astype(np.int64) + (v > 0xFF) + (v > 0xFFFF) + (v > 0xFFFFFF)


def posting_lists(term: np.ndarray, doc: np.ndarray, impact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coded lists from postings ordered by term and document: ``first posting of each list, heads, first head, bytes, first byte``.

    A block holds BLOCK postings of one list: gaps to the previous document (the first one to the last of the block before), then
    impacts less the block's least, each in the fewest whole bytes that fit the block.
    """
    lists = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
    size = np.diff(np.append(lists, len(term)))
    own = np.repeat(np.arange(len(lists)), size)
    nth = np.arange(len(term)) - lists[own]
    starts = np.flatnonzero(nth % BLOCK == 0)
    count = np.diff(np.append(starts, len(term)))
    block = np.repeat(np.arange(len(starts)), count)
    gap = doc - np.where(nth == 0, 0, np.concatenate([[0], doc[:-1]]))
    heads = np.zeros(len(starts), HEAD)
    heads["last"] = doc[starts + count - 1]
    heads["peak"] = np.maximum.reduceat(impact, starts)
    least = np.minimum.reduceat(impact, starts)
    heads["least"] = least
    heads["n"] = count
    gw, iw = _width(np.maximum.reduceat(gap, starts)), _width(heads["peak"].astype(np.int64) - least)
    heads["gap"], heads["wide"] = gw, iw
    size_b = count * (gw + iw)
    end = np.cumsum(size_b)
    at = end - size_b
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint8)
    j = np.arange(len(term)) - starts[block]
    _spread(out, at[block] + j * gw[block], gw[block], gap)
    _spread(out, at[block] + count[block] * gw[block] + j * iw[block], iw[block], impact - least[block])
    first_head = np.flatnonzero(nth[starts] == 0)
    first_byte = at[first_head]
    heads["end"] = end - np.repeat(first_byte, np.diff(np.append(first_head, len(starts))))
    return lists, heads, first_head, out, first_byte


def _binary(buf: np.ndarray, ends: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(buf))])


def build(docs: DataFrame, n_docs: int, length: int) -> DataFrame:
    """The index: shards of about SHARD_BYTES of text, a row for each term of each, and a row without term with the shard's doc_ids.

    Documents of a shard are numbered by ascending doc_id, nulls last, so that of two equal scores the first one wins.
    """

    def shard(keys: list, counts: list, codes: list, texts: list, tfs: list) -> pa.RecordBatch:
        ids = pa.concat_arrays(keys).cast(pa.int64())
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        order = np.lexsort((ids.fill_null(0).to_numpy(), ~known))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        one = pa.chunked_array([pa.DictionaryArray.from_arrays(c, d) for c, d in codes]).unify_dictionaries()
        dictionary = one.chunk(0).dictionary
        code = np.concatenate([c.indices.to_numpy() for c in one.chunks]).astype(np.int64)
        text = np.concatenate(texts)
        tf = np.concatenate(tfs)
        doc = place[text]
        by = np.argsort(code << 32 | doc)
        n = np.concatenate(counts)
        code, doc, impact = code[by], doc[by], impacts(tf[by], n[text[by]], n_docs, length)
        lists, heads, first_head, data, first_byte = posting_lists(code, doc, impact)
        terms = dictionary.take(pa.array(code[lists]))
        df = np.diff(np.append(lists, len(code)))
        head_ends = np.append(first_head[1:], len(heads)) * HEAD.itemsize
        cols = [terms, pa.array(df), _binary(heads.view(np.uint8), head_ends), _binary(data, np.append(first_byte[1:], len(data)))]
        held = ids.take(pa.array(order)).drop_null().to_numpy().astype("<i8")
        ends = [pa.array([b""], pa.binary()), pa.array([0], pa.int64()), pa.array([b""], pa.binary()), pa.array([held.tobytes()], pa.binary())]
        name = uuid.uuid4().hex
        both = [pa.concat_arrays([a, b]) for a, b in zip(ends, cols)]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(both[0])), *both], names=["shard", "term", "df", "heads", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [])
        used = rows = 0
        for ids, size, counts, terms, doc in _terms(batches):
            if rows and used + size > SHARD_BYTES:
                if held[2]:
                    yield shard(*held)
                held, used, rows = ([], [], [], [], []), 0, 0
            held[0].append(ids)
            held[1].append(counts)
            if len(terms):
                coded = terms.dictionary_encode()
                both, tf = np.unique(doc << 32 | coded.indices.to_numpy().astype(np.int64), return_counts=True)
                held[2].append((pa.array((both & 0xFFFFFFFF).astype(np.int32)), coded.dictionary))
                held[3].append((both >> 32) + rows)
                held[4].append(tf)
            used += size
            rows += len(ids)
        if held[2]:
            yield shard(*held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


class List:
    """One posting list of a shard; blocks are decompressed when they are asked for, once."""

    def __init__(self, heads: bytes, data: bytes, weight: int):
        self.heads = np.frombuffer(heads, HEAD)
        self.data = np.frombuffer(data, np.uint8)
        self.last = self.heads["last"].astype(np.int64)
        self.peak = self.heads["peak"].astype(np.int64) * weight
        self.bound = int(self.peak.max())
        self.weight = weight
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of a block."""
        if k not in self.open:
            h = self.heads[k]
            n, gw, iw = int(h["n"]), int(h["gap"]), int(h["wide"])
            at = int(h["end"]) - n * (gw + iw)
            docs = np.cumsum(self._ints(at, n, gw)) + (self.last[k - 1] if k else 0)
            self.open[k] = docs, (self._ints(at + n * gw, n, iw) + int(h["least"])) * self.weight
        return self.open[k]

    def _ints(self, at: int, n: int, width: int) -> np.ndarray:
        if not width:
            return np.zeros(n, np.int64)
        rows = self.data[at : at + n * width].reshape(n, width).astype(np.int64)
        return rows @ (1 << 8 * np.arange(width))


def best(lists: list[List], n_docs: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the ``top`` best of one query in one shard, by Block-Max MaxScore.

    Lists in order of their bounds: those whose bounds together stay at or below the threshold cannot lift a document into the heap
    alone.  Only the others (essential) are walked, SPAN documents at a time; what they find is dropped as soon as its score so far
    plus the maxima of the blocks that may hold it in the remaining lists does not exceed the threshold, and only blocks of documents
    that are left are decompressed.  Documents come in ascending order, so one that only equals the threshold is out.
    """
    lists = sorted(lists, key=lambda x: x.bound)
    upto = np.concatenate([[0], np.cumsum([x.bound for x in lists])])
    docs, scores, limit = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for lo in range(0, n_docs, SPAN):
        hi = min(lo + SPAN, n_docs)
        essential = int(np.searchsorted(upto[1:], limit, "right"))
        if essential == len(lists):
            break
        acc = np.zeros(hi - lo, np.int64)
        for x in lists[essential:]:
            for k in range(int(np.searchsorted(x.last, lo)), len(x.last)):
                if k and x.last[k - 1] + 1 >= hi:
                    break
                d, s = x.block(k)
                a, b = np.searchsorted(d, (lo, hi))
                acc[d[a:b] - lo] += s[a:b]
        found = np.flatnonzero(acc)
        found = found[acc[found] + upto[essential] > limit]
        if len(found) and essential:
            # block maxima of the remaining lists at each candidate
            places = [np.searchsorted(x.last, found + lo) for x in lists[:essential]]
            peaks = np.array([np.append(x.peak, 0)[p] for x, p in zip(lists[:essential], places)])
            rest = peaks.sum(axis=0)
            keep = acc[found] + rest > limit
            for j in range(essential - 1, -1, -1):
                found, rest, peaks = found[keep], rest[keep], peaks[:, keep]
                places = [p[keep] for p in places]
                if not len(found):
                    break
                x = lists[j]
                rest = rest - peaks[j]
                for k in np.unique(places[j][places[j] < len(x.last)]):
                    d, s = x.block(int(k))
                    here = np.flatnonzero(places[j] == k)
                    at = np.searchsorted(d, found[here] + lo)
                    same = d[at] == found[here] + lo
                    acc[found[here[same]]] += s[at[same]]
                keep = acc[found] + rest > limit
            else:
                found = found[keep]
        if len(found):
            docs, scores = np.concatenate([docs, found + lo]), np.concatenate([scores, acc[found]])
            if len(docs) >= top:
                by = np.lexsort((docs, -scores))[:top]
                docs, scores = docs[by], scores[by]
                limit = int(scores[-1])
    return docs, scores


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` documents with a score above 0 of each item: ``item_id, rank, doc_id, score``.

    Two reads of ``docs(doc_id, text)``: totals, then an index row for each shard and term.  The terms of ``items(item_id, text)``,
    in blocks of about QUERIES items, meet the index by an equi-join (salted, as a frequent term has a row in every shard); each pair of shard and
    block is one task with a heap for each item, and the heaps are merged by rank.

    Null texts have no terms; items without terms have no rows; repeated rows of ``items`` count once, rows with one item_id and
    different texts are ranked each; documents are ranked by row, null doc_ids after others of equal score; other columns are ignored.
    """
    columns(docs, "doc_id", "text")
    columns(items, "item_id", "text")
    prepare(docs.sparkSession)
    n_docs, length = totals(docs)
    index = written(build(docs, n_docs, length), "lexical-index")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select("item_id", low.alias("text")).distinct()
    asked = asked.select("item_id", F.array_distinct(F.regexp_extract_all("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))).alias("terms"), F.xxhash64("item_id", "text").alias("h")).filter(F.size("terms") > 0)
    asked = written(asked, "lexical-items")
    blocks = max(1, -(-asked.count() // QUERIES))
    asked = asked.withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
    asked = written(asked.withColumn("q", F.row_number().over(Window.partitionBy("block").orderBy("h", "item_id", "terms"))), "lexical-blocks")
    used = asked.select("block", "q", F.explode("terms").alias("term")).groupBy("block", "term").agg(F.collect_list("q").alias("qs"))
    used = used.withColumn("term", F.col("term").cast("binary"))
    terms = written(used.select("term").distinct(), "lexical-terms")
    # a list of terms of checked size goes to every task and drops the rest of the index before it moves; a longer one is joined by a shuffle
    index = index.join(F.broadcast(terms) if (terms.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0) <= BROADCAST_BYTES else terms, "term", "left_semi").unionByName(index.filter(F.octet_length("term") == 0))
    df = index.select("term", "df").join(terms, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((F.lit(2.0 * n_docs) + 2) / (2 * F.col("df") + 1)))
    weighed = used.join(df, "term").select("block", "term", "qs", weight.cast("long").alias("w")).filter("w > 0")
    names = asked.select("block", F.lit(b"").alias("term"), F.array().cast("array<int>").alias("qs"), F.lit(0).cast("long").alias("w")).distinct()
    salted = weighed.union(names).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = index.withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(SALTS)).cast("int")).join(salted, ["term", "salt"])
    schema = pa.schema([("block", pa.int32()), ("q", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        lists: dict[int, list[List]] = {}
        known, n = np.zeros(0, np.int64), 0
        for term, heads, data, qs, w in zip(*(t.column(c).to_pylist() for c in ("term", "heads", "data", "qs", "w"))):
            if not term:
                known = np.frombuffer(data, "<i8")
                continue
            one = List(heads, data, w)
            n = max(n, int(one.last[-1]) + 1)
            for q in qs:
                lists.setdefault(q, []).append(one)
        out: list[list] = [[], [], []]
        for q, own in lists.items():
            d, s = best(own, n, top)
            out[0].append(np.full(len(d), q, np.int32))
            out[1].append(d)
            out[2].append(s)
        if not out[0]:
            return schema.empty_table()
        q, d, s = (np.concatenate(x) for x in out)
        padded = np.append(known, 0)
        ids = pa.array(padded[np.minimum(d, len(known))], mask=d >= len(known))
        return pa.table([pa.array(np.full(len(q), block, np.int32)), pa.array(q), ids, pa.array(s)], schema=schema)

    heaps = met.select("shard", "block", "term", "heads", "data", "qs", "w").groupBy("shard", "block").applyInArrow(run, "block int, q int, doc_id long, score long")
    rank = Window.partitionBy("block", "q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = heaps.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= top)
    return ranked.join(asked.select("block", "q", "item_id"), ["block", "q"]).select("item_id", "rank", "doc_id", "score")


SQL = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ts FROM documents),
g AS (SELECT CAST(sum(CASE WHEN len(ts)>0 THEN 1 ELSE 0 END) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS l FROM d),
p AS (SELECT rid, doc_id, n, t, count(*) AS tf FROM (SELECT rid, doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000*ln((2*n_docs+2)/CAST(2*count(*)+1 AS DOUBLE))) AS BIGINT) AS w FROM p, g GROUP BY t, n_docs),
q AS (SELECT row_number() OVER () AS qid, item_id, ts FROM (SELECT DISTINCT item_id, regexp_extract_all(translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ts FROM benchmark)),
qt AS (SELECT DISTINCT qid, item_id, unnest(ts) AS t FROM q),
s AS (SELECT qid, item_id, rid, doc_id, CAST(sum(w*((1000000000*tf)//(1000*tf+20*(100-50+((50*n*n_docs)//l))))) AS BIGINT) AS score FROM qt JOIN p USING (t) JOIN w USING (t), g GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score>0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank<=50"""
