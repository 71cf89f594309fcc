"""Benchmark decontamination with a generalised suffix automaton of the test items."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyfold.llm import lex
from skyfold.llm.store import prepare, columns, others

WINDOW = 10
BLOCK_CHARS = 8_000_000


class Automaton:
    """Suffix automaton of several word sequences.

    ``step`` keeps the longest suffix of what was read that occurs in an item, cut to ``window`` words, so the state at that length
    stands for exactly those words; ``full[state]`` are the items that hold them.  Items shorter than ``window`` are windows of their own.
    """

    def __init__(self, items: list[tuple[str, list[int]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len, own = [-1], [0], [set()]
        self.short: dict[int, list[str]] = {}
        for item, seq in items:
            last, path = 0, []
            for c in seq:
                last = self._extend(last, c, own)
                path.append(last)
            for s in path:
                own[s].add(item)
        order = sorted(range(len(self.len)), key=self.len.__getitem__, reverse=True)
        for s in order:
            if self.link[s] >= 0:
                own[self.link[s]] |= own[s]
        self.full = {s: frozenset(own[s]) for s in range(len(own)) if self.len[s] >= window}
        for item, seq in items:
            if 0 < len(seq) < window:
                s = 0
                for c in seq:
                    s = self.next[s][c]
                self.short.setdefault(s, []).append((len(seq), item))

    def _extend(self, last: int, c: int, own: list[set]) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            if self.len[q] == self.len[last] + 1:
                return q
            return self._clone(last, c, q, own)
        cur = len(self.len)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        own.append(set())
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q, own)
        return cur

    def _clone(self, p: int, c: int, q: int, own: list[set]) -> int:
        new = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        own.append(set())
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def stream(self, seq: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of words covered by occurring windows, and the items of these windows."""
        state = matched = 0
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        for i, c in enumerate(seq):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.len[state]
            if c in self.next[state]:
                state = self.next[state][c]
                matched += 1
            while state and self.len[self.link[state]] >= self.window:
                state = self.link[state]
                matched = min(matched, self.len[state])
            if matched >= self.window:
                spans.append((i + 1 - self.window, i + 1))
                items |= self.full[state]
            if self.short:
                s = state
                while s > 0:
                    for n, item in self.short.get(s, ()):
                        if n <= matched:
                            spans.append((i + 1 - n, i + 1))
                            items.add(item)
                    s = self.link[s]
        return spans, items


class Block:
    """What tasks get of a bounded block of items: the automaton over word numbers, word hashes and pairs of neighbours."""

    def __init__(self, rows: list[tuple[str, str]], window: int):
        buf, off = lex.raw(pa.array([t for _, t in rows], pa.string()))
        buf = lex.LOWER[buf]
        starts, ends, doc = lex.words(buf, off, lex.PLAIN)
        self.hashes, ids = np.unique(lex.spans_hash(buf, starts, ends), return_inverse=True)
        self.bytes = {}
        for i, s, e in zip(ids.tolist(), starts.tolist(), ends.tolist()):
            self.bytes[i] = buf[s:e].tobytes()
        seqs: list[list[int]] = [[] for _ in rows]
        for d, i in zip(doc.tolist(), ids.tolist()):
            seqs[d].append(i)
        same = doc[1:] == doc[:-1]
        self.pairs = np.unique((ids[:-1].astype(np.int64) << 32 | ids[1:])[same]) if len(ids) else np.zeros(0, np.int64)
        self.least = min([window, *(len(s) for s in seqs if s)])
        self.automaton = Automaton([(rows[k][0], s) for k, s in enumerate(seqs) if s], window)

    def hits(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, tuple[list, set]]]:
        """Word starts, ends, texts, and per text with a hit its word spans and items.

        Only runs whose neighbours are all neighbours in an item can hold a window; the automaton reads these runs.
        """
        starts, ends, doc = lex.words(buf, off, lex.PLAIN)
        found: dict[int, tuple[list, set]] = {}
        if not len(starts) or not len(self.hashes):
            return starts, ends, doc, found
        h = lex.spans_hash(buf, starts, ends)
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        known = self.hashes[at] == h
        ids = np.where(known, at, -1)
        both = np.flatnonzero(known[1:] & known[:-1] & (doc[1:] == doc[:-1]))
        pair = ids[both].astype(np.int64) << 32 | ids[both + 1]
        j = np.searchsorted(self.pairs, pair)
        j[j == len(self.pairs)] = 0
        good = np.zeros(len(ids) + 1, bool)  # word i follows word i - 1 in some item
        if len(self.pairs):
            good[both[self.pairs[j] == pair] + 1] = True
        head = np.flatnonzero(known & ~good[:-1])
        stop = np.flatnonzero(known & ~good[1:]) + 1
        long = stop - head >= self.least
        first = np.searchsorted(doc, np.arange(len(off) - 1))
        for a, b in zip(head[long].tolist(), stop[long].tolist()):
            seq = ids[a:b].tolist()
            for k, w in enumerate(seq):
                if self.bytes[w] != buf[starts[a + k] : ends[a + k]].tobytes():
                    seq[k] = -1  # another word with the same hash
            spans, items = self.automaton.stream(seq)
            if spans:
                d = int(doc[a])
                mine = found.setdefault(d, ([], set()))
                mine[0].extend((s + a - int(first[d]), e + a - int(first[d])) for s, e in spans)
                mine[1].update(items)
        return starts, ends, doc, found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


HITS = "hits struct<n_words:long,spans:array<struct<first:long,end:long,byte_first:long,byte_end:long>>,items:array<string>>"
_HITS = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("byte_first", pa.int64()), ("byte_end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _scan(df: DataFrame, block, keep: list[str], carry: bool) -> DataFrame:
    kept = df.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), HITS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Block = block.value
        for batch in batches:
            buf, off = lex.raw(batch.column("text"))
            out = []
            old = batch.column("hits").to_pylist() if carry else None
            for i, j, part, offs in lex.slices(buf, off):
                part = lex.LOWER[part]
                starts, ends, doc, found = own.hits(part, offs)
                n = np.bincount(doc, minlength=j - i)
                first = np.concatenate([[0], np.cumsum(n)])
                for d in range(j - i):
                    spans, items = found.get(d, ((), ()))
                    spans = [(s, e) for s, e in spans]
                    items = set(items)
                    if old and old[i + d]["spans"]:
                        spans += [(x["first"], x["end"]) for x in old[i + d]["spans"]]
                        items |= set(old[i + d]["items"])
                    out.append({"n_words": int(n[d]), "items": sorted(items), "spans": [{"first": s, "end": e, "byte_first": int(starts[first[d] + s] - offs[d]), "byte_end": int(ends[first[d] + e - 1] - offs[d])} for s, e in merged(spans)]})
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, _HITS)], names=[*keep, "hits"])

    return df.mapInArrow(run, schema)


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: list[str] | None = None, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs(text, ...)`` with ``hits``: words, merged spans of words inside occurring windows (word and byte offsets), and item ids.

    Words are runs of 0-9, a-z (after lower-casing A-Z) and non-ASCII characters.  A window is ``window`` consecutive words of an item,
    or a whole shorter item.  Items go to the tasks in blocks of at most about ``block_chars`` characters (one longer item alone); a
    larger benchmark means more passes in the same stage, never a larger block.

    Null or empty texts have no words and no hits; items whose text or id is null, or that have no words, take no part; repeated items
    count once per id; empty tables give no rows or no hits.  A column named ``hits`` is replaced, all others of ``keep`` are returned.
    """
    columns(docs, "text")
    columns(benchmark, "item_id", "text")
    spark = docs.sparkSession
    prepare(spark)
    keep = [c for c in (keep if keep is not None else docs.columns) if c.lower() != "hits"]
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").filter("item IS NOT NULL AND text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    df, carry = docs.select(*others(docs, "hits")), False
    for b in range(n):
        rows = sorted((r["item"], r["text"]) for r in items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).collect())
        block = spark.sparkContext.broadcast(Block(rows, window))
        last = b == n - 1
        df = _scan(df, block, keep if last else others(docs, "hits"), carry)
        carry = True
    return df


def remove_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_cover: float = 0.5) -> DataFrame:
    """The columns of ``docs`` with every hit span cut out of ``text``; documents of which more than ``max_cover`` was hit are dropped.

    Clean documents, null texts included, stay as they are.  ``n_chars``, if there, follows the text.
    """
    names = docs.columns
    found = find_hits(docs, benchmark, window)
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    data = F.encode("text", "utf-8")
    cut = F.aggregate(
        "hits.spans",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(F.concat(a["out"], _part(data, a["at"], s["byte_first"])).alias("out"), s["byte_end"].alias("at")),
        lambda a: F.concat(a["out"], _part(data, a["at"], F.octet_length("text"))),
    )
    kept = found.filter(n_hit <= F.col("hits.n_words") * max_cover)
    text = F.when(F.size("hits.spans") > 0, cut).otherwise(F.col("text"))
    kept = kept.withColumn("text", text)
    if "n_chars" in names:
        kept = kept.withColumn("n_chars", F.when(F.size("hits.spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*[c for c in names if c.lower() != "hits"])


def _part(data, first, end):
    return F.decode(F.substring(data, first.cast("int") + 1, (end - first).cast("int")), "utf-8")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_hits(docs, benchmark, keep=["doc_id"])
    n_hit = F.aggregate("hits.spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


