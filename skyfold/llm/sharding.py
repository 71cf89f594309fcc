"""Sharding by histogram sort: exact byte counts below candidate boundaries, refined until the splitters fit, then one exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyfold.llm.store import columns, others, written

SHARDS = 8
BITS = 12  # candidate boundaries of one round: 2**BITS for each open interval
TOLERANCE = 0.005
BUCKET_BYTES = 64 << 20
LOW = -(1 << 63)


def _digit(key: Column, used: int) -> Column:
    """The next BITS bits of an order-preserving signed 64-bit key after its first ``used`` bits."""
    width = min(BITS, 64 - used)
    return F.shiftrightunsigned(F.shiftleft(key.bitwiseXOR(F.lit(LOW)), used), 64 - width)


def splitters(keys: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """First keys ``(h, d)`` of shards 1.. of ``keys(h, d, size)``.

    Each round counts the exact bytes of 2**BITS sub-intervals of every interval that still holds an unfinished splitter.  A splitter is
    done when a boundary lies within ``tolerance`` of a shard's bytes from its target; boundaries between different ``h`` come first,
    so equal texts stay together unless their group alone exceeds the tolerance; then the group is cut by ``d``.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    want = [total * j / shards for j in range(1, shards)]
    # open splitters: number -> (fixed first part or None, prefix of the current part, bits used, bytes below)
    open_ = {j: (None, 0, 0, 0) for j in range(len(want))} if total else {}
    best: dict[int, tuple[float, tuple[int, int]]] = {}
    while open_:
        ways: dict[tuple, list[int]] = {}
        for j, (h, prefix, used, _) in open_.items():
            ways.setdefault((h, prefix, used), []).append(j)
        used = next(iter(ways))[2]
        rows, second = keys, next(iter(ways))[0] is not None
        level = {w for w in ways if w[2] == used and (w[0] is not None) == second}
        key = F.col("d") if second else F.col("h")
        if second:
            rows = rows.filter(F.col("h").isin([w[0] for w in level]))
        if used:
            top = F.shiftrightunsigned(key.bitwiseXOR(F.lit(LOW)), 64 - used)
            rows = rows.filter(top.isin([w[1] for w in level]))
        else:
            top = F.lit(0).cast("long")
        part = F.col("h") if second else F.lit(0).cast("long")
        got: dict[tuple, dict[int, int]] = {}
        for r in rows.groupBy(part.alias("h"), top.alias("top"), _digit(key, used).alias("digit")).agg(F.sum("size").alias("size")).collect():
            got.setdefault((r["h"] if second else None, r["top"], used), {})[r["digit"]] = r["size"]
        width = min(BITS, 64 - used)
        for way in level:
            counts = got[way]
            for j in ways[way]:
                h, prefix, _, below = open_.pop(j)
                at, inside, under = below, None, below
                for digit in sorted(counts):
                    for side, value in ((digit, at), (digit + 1, at + counts[digit])):
                        full = (prefix << width | side) << (64 - used - width)
                        gap = abs(value - want[j])
                        if full < 1 << 64 and (j not in best or gap < best[j][0]):
                            best[j] = (gap, (full + LOW, LOW) if h is None else (h, full + LOW))
                    if at <= want[j] < at + counts[digit]:
                        inside, under = digit, at
                    at += counts[digit]
                if best[j][0] <= tolerance * total / shards or inside is None:
                    continue
                if used + width < 64:
                    open_[j] = (h, prefix << width | inside, used + width, under)
                elif h is None:
                    open_[j] = ((prefix << width | inside) + LOW, 0, 0, under)
    return sorted(best[j][1] for j in best)


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``docs(doc_id, text, ...)`` with ``size, text_crc32, law, shard, slot, grown_shard``; law ``bytes``.

    The sort key is ``(hash of text, doc_id)``: equal texts are neighbours and share a shard unless their group is larger than the
    tolerance.  Sizes (UTF-8 bytes plus 1) of shards differ from their mean by ``tolerance`` and one key at most.  Slots count the rows
    of a shard from 0: inside a shard rows are spread over buckets of about ``bucket_bytes`` by a hash of doc_id, numbered there, and
    moved by the number of rows in earlier buckets, so no task holds a whole shard.  Rows cross the network once.

    Null texts have size 1 and share the hash of null; null ids come first; rows alike in text and id cannot be told apart by the key
    and stay in one shard; an empty table gives no rows.  Columns that clash with the new ones are replaced.
    """
    columns(docs, "doc_id", "text")
    new = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    keep = others(docs, *new)
    rows = docs.select(
        *keep,
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("__sh_h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("__sh_d"),
    )
    keys = written(rows.select(F.col("__sh_h").alias("h"), F.col("__sh_d").alias("d"), "size"), "shard-keys")
    cuts = splitters(keys, shards, tolerance)
    total = keys.agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // (bucket_bytes * shards)))

    def place(h: Column, d: Column) -> Column:
        return sum(((h > a) | ((h == a) & (d >= b))).cast("int") for a, b in cuts) if cuts else F.lit(0)

    def bucket(h: Column, d: Column) -> Column:
        return F.pmod(F.xxhash64(d, h), F.lit(buckets))

    sizes = keys.select(place(F.col("h"), F.col("d")).alias("shard"), bucket(F.col("h"), F.col("d")).alias("__sh_b")).groupBy("shard", "__sh_b").agg(F.count(F.lit(1)).alias("__sh_n"))
    before = Window.partitionBy("shard").orderBy("__sh_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("shard", "__sh_b", F.coalesce(F.sum("__sh_n").over(before), F.lit(0)).alias("__sh_base"))
    inside = Window.partitionBy("shard", "__sh_b").orderBy("__sh_h", "__sh_d")
    placed = rows.withColumn("shard", place(F.col("__sh_h"), F.col("__sh_d")).cast("int")).withColumn("__sh_b", bucket(F.col("__sh_h"), F.col("__sh_d")))
    numbered = placed.withColumn("__sh_i", F.row_number().over(inside)).join(bases, ["shard", "__sh_b"])
    return numbered.select(*keep, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__sh_base") + F.col("__sh_i") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
