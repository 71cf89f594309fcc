"""Spelling variants: words one edit apart, by dynamic programming down sorted lists that reuses rows through common prefixes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyfold.llm import lex
from skyfold.llm.store import columns, prepare, written

DROP = 199  # one run in so many loses a code point
LEAST_POINTS = 6
LEAST_COUNT = 5
TIMES = 5  # a form is at least so many times as frequent
GROUP = 2000  # words of a list; larger ones are split by a further half
HELD_WORDS = 200_000
HELD_BYTES = 16 << 20
CRC_LENGTH = 64
_C3 = lex._byte == 0xC3
_ALPHA = ((lex._byte >= 0x41) & (lex._byte <= 0x5A)) | ((lex._byte >= 0x61) & (lex._byte <= 0x7A))


def _crc_steps(most: int) -> list[np.ndarray]:
    """``steps[k][b]``: how the byte ``b`` of a 32-bit checksum moves on by ``k`` zero bytes; crc(a + b) is crc(a) moved on by len(b), xor crc(b)."""
    one = np.zeros(256, np.uint32)
    for b in range(256):
        v = b
        for _ in range(8):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        one[b] = v
    at = np.arange(256, dtype=np.uint32)
    now = np.array([at << np.uint32(8 * j) for j in range(4)])
    out = [now]
    for _ in range(most):
        now = now >> np.uint32(8) ^ one[now & np.uint32(0xFF)]
        out.append(now)
    return out


_steps: list[np.ndarray] = []


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Checksums of joined texts from those of both parts and the byte length of the second (at most CRC_LENGTH)."""
    if not _steps:
        _steps.extend(_crc_steps(CRC_LENGTH))
    table = np.array(_steps)
    out = second.copy()
    for j in range(4):
        out ^= table[length, j, first >> np.uint32(8 * j) & np.uint32(0xFF)]
    return out


def _altered(run: bytes, h: int) -> bytes:
    s = run.decode()
    k = h % len(s)
    return (s[:k] + s[k + 1 :]).encode()


def counted(docs: DataFrame) -> DataFrame:
    """``word, n`` of all texts (bytes), before any limit: runs of letters, A-Z lower-cased, one in DROP without one code point.

    Tasks add up their own words and hand them on when they hold HELD_WORDS, so a frequent word crosses the network a few times a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            buf, off = lex.raw(batch.column("text"))
            prefix = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in batch.column("doc_id").to_pylist()], np.uint32)
            for a, b, part, offs in lex.slices(buf, off):
                low = lex.LOWER[part]
                letter = _ALPHA[low]
                wide = _C3[low]  # the first byte of U+00C0 to U+00FF; the second follows in the same text
                letter |= wide
                letter[1:] |= wide[:-1]
                starts, ends, doc = lex.words(letter.view(np.uint8), offs, np.arange(256) == 1)
                if not len(starts):
                    continue
                at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
                coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(low[letter])]).dictionary_encode()
                code, runs = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                lens = np.fromiter(map(len, runs), np.int64, len(runs))
                own = np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs))
                h = joined_crc(prefix[a + doc], own[code], np.minimum(lens, CRC_LENGTH)[code])
                for i in np.flatnonzero((lens > CRC_LENGTH)[code]):
                    h[i] = zlib.crc32(runs[code[i]], int(prefix[a + doc[i]]))
                hit = h % DROP == 0
                counts = np.bincount(code[~hit], minlength=len(runs)).tolist()
                new = [(w, c) for w, c in zip(runs, counts) if c]
                new += [(_altered(runs[code[i]], int(h[i])), 1) for i in np.flatnonzero(hit)]
                for w, c in new:
                    if w in held:
                        held[w] += c
                    else:
                        held[w] = c
                        size += len(w)
                if len(held) >= HELD_WORDS or size >= HELD_BYTES:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, points: int = LEAST_POINTS, count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: words of at least ``points`` code points and ``count`` occurrences."""
    words = counted(docs).select(F.col("word").cast("string").alias("word"), "n")
    return words.filter((F.length("word") >= points) & (F.col("n") >= count))


def lists(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``key, word, n, a, b, short``: lists in which all pairs of words one edit apart meet, each pair in one list only.

    Take pairs whose shorter word has ``short`` code points and whose first difference stands at ``p``.  If ``p`` lies in the middle part
    ``a <= p < short - b``, both words share their first ``a`` and last ``b`` code points.  A list is cut in two halves of that part: one
    keeps pairs that differ in the second half (they share a longer beginning), one those of the first half (a longer end).  All words
    are cut once; lists of more than ``group`` words go on, until one code point is left, where an alphabet bounds them.  A word is in
    the lists of its own length and of the length below.
    """
    size = F.length("word")
    state = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("short")).filter(F.col("short") >= 1)
    state = state.withColumn("a", F.lit(0)).withColumn("b", F.lit(0))
    done, first = None, True
    while True:
        middle = F.col("short") - F.col("a") - F.col("b")
        half = F.floor(middle / 2).cast("int")
        later = F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b"))
        sooner = F.struct(F.col("a").alias("a"), (F.col("b") + middle - half).alias("b"))
        state = state.select("word", "n", "short", F.explode(F.when(middle > 1, F.array(later, sooner)).otherwise(F.array(F.struct("a", "b")))).alias("s")).select("word", "n", "short", "s.a", "s.b")
        keys = ["short", "a", "b", "head", "tail"]
        state = written(state.withColumn("head", F.expr("left(word, a)")).withColumn("tail", F.expr("right(word, b)")), "spelling-lists")
        large = state.filter(F.col("short") - F.col("a") - F.col("b") > 1).groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > group).select(*keys)
        large = written(large, "spelling-large")
        if not large.take(1):
            return state if done is None else done.unionByName(state)
        small = state.join(large, keys, "left_anti")
        done = small if done is None else done.unionByName(small)
        state = state.join(large, keys, "left_semi").select("word", "n", "short", "a", "b")


FAR = 2


def near(x: str, words: list[str], common: list[int], jump: list[int]) -> Iterator[int]:
    """Places of ``words`` (ascending) exactly one edit from ``x``.

    ``common[i]`` is the length of the prefix that word i shares with the one before; ``jump[i]`` the next place with a smaller one.
    Row d of the edit matrix holds the distances of the first d letters of a word to the first d-1, d and d+1 of ``x``; rows of a common prefix
    stay as they are.  A row without a cell below FAR ends all words with that prefix, which ``jump`` passes over.
    """
    n = len(x)
    rows = [(FAR, 0, 1 if n else FAR)]
    i, count = 0, len(words)
    while i < count:
        w = words[i]
        d = common[i]
        if d < len(rows):
            del rows[d + 1 :]
        d = len(rows) - 1
        low, mid, high = rows[d]
        while d < len(w):
            c = w[d]
            a = low + (x[d - 1] != c) if 0 < d <= n else FAR
            a = min(a, mid + 1) if d <= n else FAR
            b = min(mid + (x[d] != c), high + 1, a + 1) if d < n else FAR
            e = min(high + (x[d + 1] != c), b + 1) if d + 1 < n else FAR
            if a >= FAR and b >= FAR and e >= FAR:
                break
            d += 1
            low, mid, high = a, b, e
            rows.append((a, b, e))
        else:
            gap = n - len(w)
            if -1 <= gap <= 1 and (low, mid, high)[gap + 1] == 1:
                yield i
            i += 1
            continue
        # no word that shares more than d letters with this one is near
        i += 1
        while i < count and common[i] > d:
            i = jump[i]


def sort_list(words: list[str]) -> tuple[list[int], list[int]]:
    """For ascending words: the prefix each shares with the one before, and the next place that shares less."""
    common = [0] * len(words)
    for i in range(1, len(words)):
        a, b = words[i - 1], words[i]
        k, most = 0, min(len(a), len(b))
        while k < most and a[k] == b[k]:
            k += 1
        common[i] = k
    jump, stack = [len(words)] * len(words), []
    for i in range(len(words) - 1, -1, -1):
        while stack and common[stack[-1]] >= common[i]:
            stack.pop()
        jump[i] = stack[-1] if stack else len(words)
        stack.append(i)
    return common, jump


def _pairs(words: list[str], counts: list[int], short: int, a: int, b: int) -> Iterator[tuple[str, int, int, str]]:
    """``word, number of near words, n and text of the best`` within one list; only pairs of this list's lengths and place of difference."""
    mids = [w[a : len(w) - b] for w in words]
    order = sorted(range(len(words)), key=mids.__getitem__)
    texts = [mids[i] for i in order]
    common, jump = sort_list(texts)
    part = short - a - b
    for i in order:
        w, x = words[i], mids[i]
        found, top, who = 0, 0, ""
        for k in near(x, texts, common, jump):
            j = order[k]
            y = mids[j]
            if min(len(x), len(y)) != part:
                continue
            p = 0
            while p < part and x[p] == y[p]:
                p += 1
            if p < part or b == 0:
                found += 1
                if counts[j] > top or counts[j] == top and words[j] < who:
                    top, who = counts[j], words[j]
        if found:
            yield w, found, top, who


def variants(words: DataFrame, group: int = GROUP) -> DataFrame:
    """``word, n_near, form_n, form`` of every word of ``words(word, n)`` with a near word; the form is its near word of largest n."""
    rows = lists(words, group)
    prepare(words.sparkSession)
    keys = ["short", "a", "b", "head", "tail"]
    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, *keys).sortWithinPartitions(*keys)
    schema = pa.schema([("word", pa.string()), ("found", pa.int64()), ("top", pa.int64()), ("who", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def close() -> None:
            if len(held) > 1:
                short, a, b = held[0][:3]
                out.extend(_pairs([r[5] for r in held], [r[6] for r in held], short, a, b))
            held.clear()

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*keys, "word", "n"))):
                if held and held[-1][:5] != row[:5]:
                    close()
                held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    found = dealt.mapInArrow(run, "word string, found long, top long, who string")
    # of the largest n the smallest word: code-point order is that of UTF-8 bytes
    best = F.min(F.struct((-F.col("top")).alias("top"), "who"))
    return found.groupBy("word").agg(F.sum("found").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.top")).alias("form_n"), F.col("best.who").alias("form"))


def group_variants(docs: DataFrame, points: int = LEAST_POINTS, count: int = LEAST_COUNT, times: int = TIMES, group: int = GROUP) -> DataFrame:
    """Words of ``docs(doc_id, text)`` with their standard forms: ``word, form, root, n, n_near, form_n``.

    A word's form is its near word of largest n (ties: the smallest word) if that is at least ``times`` its n.  Along forms n grows, so a
    chain of ``k`` words needs ``times ** k`` occurrences and the root is found by few joins (at most 27 for counts below 2**63).

    Null and empty texts have no words; a null doc_id counts as an empty text before the colon; repeated rows count each; an empty
    table gives no rows; other columns are ignored.
    """
    columns(docs, "doc_id", "text")
    prepare(docs.sparkSession)
    words = written(vocabulary(docs, points, count), "spelling-words")
    found = variants(words, group)
    fits = F.col("form_n") >= times * F.col("n")
    linked = words.join(found, "word", "left").select(
        "word", F.when(fits, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form_n")).alias("form_n")
    )
    linked = written(linked, "spelling-forms")
    ups = linked.filter("form IS NOT NULL").select(F.col("word").alias("at"), F.col("form").alias("up"))
    done, open_ = None, ups.select(F.col("at").alias("word"), F.col("up").alias("root"))
    while True:
        stepped = written(open_.join(ups, F.col("root") == F.col("at"), "left").select("word", "root", "up"), "spelling-roots")
        ended = stepped.filter("up IS NULL").select("word", "root")
        done = ended if done is None else done.union(ended)
        open_ = stepped.filter("up IS NOT NULL").select("word", F.col("up").alias("root"))
        if not open_.take(1):
            break
    return linked.join(done, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
