"""MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from skyfold.kernels.components import connected_components
from skyfold.llm import lex
from skyfold.llm.store import columns, forget, mark, prepare, written

SHINGLE = 5
PERCENT = 75
SLOTS = 512  # values of a signature, of which a byte each is kept
BANDS, ROWS = 32, 3  # from the first 96 values: at a similarity of 0.75 all bands miss with a chance of 3e-8
AGREE = 325  # equal slots that a pair needs before its sets are compared; at 0.75, 384 are expected with a deviation of up to 9.8
LIKELY = 372  # equal slots of pairs that are tried first
CHUNK = 64


def super_min_hash(h: np.ndarray, doc: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures ``(n, slots)`` of element hashes ``h`` of documents ``doc``; documents without elements keep the maximum.

    In step ``j`` each element gets the value ``j + r`` for the slot at place ``j`` of its own random permutation (built lazily: only
    the swaps so far are kept), and a slot keeps its least value.  Values of later steps are larger, so a document stops as soon as
    every slot holds a value below ``j``; elements of stopped documents drop out.
    """
    out = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    swaps: list[np.ndarray] = []
    for j in range(slots):
        x = lex.mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        k = (j + (x >> np.uint64(32)) % np.uint64(slots - j)).astype(np.uint16)
        at = k.copy()
        for i in range(j - 1, -1, -1):  # what earlier swaps have put at place k, then at place j
            at[at == swaps[i]] = i
        swaps.append(k)
        value = np.uint64(j) << np.uint64(48) | (lex.mix(x ^ np.uint64(0xA5A5A5A5)) >> np.uint64(16))
        np.minimum.at(out, doc * slots + at, value)
        if j + 1 < slots:
            worst = out.reshape(n, slots).max(1) >> np.uint64(48)
            live = (worst > j)[doc]
            if not live.any():
                break
            if live.mean() < 0.7:
                h, doc, swaps = h[live], doc[live], [s[live] for s in swaps]
    return out.reshape(n, slots)


def shingle_hashes(buf: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams (of the whole sequence, if shorter) and their texts."""
    buf = lex.LOWER[buf]
    starts, ends, doc = lex.words(buf, off)
    h = lex.spans_hash(buf, starts, ends)
    g = lex.grams(h, n)
    gd = doc[: len(g)]
    whole = gd == doc[n - 1 :] if len(g) else np.zeros(0, bool)
    counts = np.bincount(doc, minlength=len(off) - 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    short = np.flatnonzero((counts > 0) & (counts < n))
    few = lex.sequence_hash(h, first[short], first[short] + counts[short], 5) if len(short) else np.zeros(0, np.uint64)
    h, doc = np.concatenate([g[whole], few]), np.concatenate([gd[whole], short])
    order = np.argsort(doc, kind="stable") if len(short) else slice(None)
    return h[order], doc[order]


def band_keys(values: np.ndarray) -> np.ndarray:
    """One key per band: a hash of its number and its values."""
    part = values[:, : BANDS * ROWS].reshape(len(values), BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        out = lex.mix(part[:, :, r] + out)
    return out.astype(np.int64)


def digest_a(items: np.ndarray) -> int:
    return int(lex.mix(items).sum(dtype=np.uint64).astype(np.int64))


def digest_b(items: np.ndarray) -> int:
    return int(np.bitwise_xor.reduce(lex.mix(items + np.uint64(0x1234567)), initial=np.uint64(0)).astype(np.int64))


SIGN_BYTES = (2 << 20) - 2  # of a slice: the rounds of a signature cost the same for few texts as for many
SIGNED = "n_shingles long, set_a long, set_b long, signature binary, bands array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id`` with set size, a 128-bit digest of the set, the signature (a byte of each value) and its bands; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = lex.raw(batch.column("text"))
            sizes, a, b, sig, keys = [], [], [], [], []
            for i, j, part, offs in lex.slices(buf, off, SIGN_BYTES):
                h, doc = shingle_hashes(part, offs)
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                got = super_min_hash(h, doc, j - i)
                mixed = lex.mix(got)  # all 64 bits of a value go into its byte
                small = (mixed >> np.uint64(56)).astype(np.uint8)
                keys += list(band_keys(mixed))
                for d in range(j - i):
                    u = np.unique(h[cut[d] : cut[d + 1]])
                    sizes.append(len(u))
                    a.append(digest_a(u))
                    b.append(digest_b(u))
                    sig.append(small[d].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_a", "set_b", "signature", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {SIGNED}")


ID = "struct<doc_id:long,set_a:long>"


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sorted set hashes of the classes ``wanted(id)``; a class is named by its smallest doc_id and its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = lex.raw(batch.column("text"))
            a, out = [], []
            for i, j, part, offs in lex.slices(buf, off):
                h, doc = shingle_hashes(part, offs)
                cut = np.searchsorted(doc, np.arange(j - i + 1))
                for d in range(j - i):
                    u = np.unique(h[cut[d] : cut[d + 1]])
                    a.append(digest_a(u))
                    out.append(u.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(a, pa.int64()), pa.array(out, pa.binary())], names=["doc_id", "set_a", "items"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.select("id.doc_id").distinct(), "doc_id", "left_semi")
    found = rows.mapInArrow(run, "doc_id long, set_a long, items binary").select(F.struct("doc_id", "set_a").alias("id"), "items")
    return found.join(wanted, "id", "left_semi").dropDuplicates(["id"])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets meet the threshold.

    A class in many pairs is a hot key of a plain join, which adaptive execution splits; its set goes with every part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("items_a"), batch.column("items_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("items_b")), "b")
    return left.join(sets.select(F.col("id").alias("a"), F.col("items").alias("items_a")), "a").select("a", "b", "items_a", "items_b").mapInArrow(run, f"a {ID}, b {ID}")


def _labels(edges: DataFrame) -> DataFrame:
    return connected_components(edges, "a", "b").select(F.col("node").alias("id"), "component")


def _low_half(key: Column) -> Column:
    """The lower 32 bits of a key, as a signed int."""
    return (key.bitwiseAND(0xFFFFFFFF).bitwiseXOR(0x80000000) - F.lit(0x80000000)).cast("int")


def _chunks(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows ``band, no, part, rows``: the members of a bucket dealt into chunks of about CHUNK, large components in chunks of their own.

    Each band deals anew, so two members meet in one chunk of some band more often than by one deal.  Signatures join last.
    """
    sizes = members.groupBy("band", "component").agg(F.count(F.lit(1)).alias("own"))
    small = sizes.groupBy("band").agg(F.sum(F.when(F.col("own") < CHUNK, F.col("own")).otherwise(0)).alias("small"))
    big = F.col("own") >= CHUNK
    dealt = members.join(sizes, ["band", "component"]).join(small, "band").select(
        "id", "band", F.when(big, F.col("component")).alias("part"), F.xxhash64("component").alias("c"),
        F.pmod(F.xxhash64("id", "band"), F.ceil(F.when(big, F.col("own")).otherwise(F.col("small")) / CHUNK)).alias("chunk"),
    )
    row = F.struct("id.doc_id", "id.set_a", "c", "n_shingles", "signature", F.transform("bands", _low_half).alias("bands"))
    packed = dealt.join(classes, "id").groupBy("band", "part", "chunk").agg(F.collect_list(row).alias("rows"))
    return packed.withColumn("no", F.struct(F.col("part").isNull(), "part", "chunk"))


FIELDS = ("doc_id", "set_a", "c", "n_shingles", "signature", "bands")
TYPES = ("array<long>", "array<long>", "array<long>", "array<long>", "array<binary>", "array<array<int>>")
PAIR = "a long, a1 long, b long, b1 long"


def _pairs(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(frame, columns=["a", "a1", "b", "b1"], dtype="int64")


def _as_ids(pairs: DataFrame) -> DataFrame:
    return pairs.distinct().select(F.struct(F.col("a").alias("doc_id"), F.col("a1").alias("set_a")).alias("a"), F.struct(F.col("b").alias("doc_id"), F.col("b1").alias("set_a")).alias("b"))


def _slots(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, SLOTS)


def _likely(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Of each chunk, a forest over its components: the pairs with most equal slots first, LIKELY at least, none between joined ones."""
    flat = _chunks(members, classes).filter("part IS NULL").select(*[F.expr(f"transform(rows, x -> x.{c})").alias(c) for c in FIELDS])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                s, c = _slots(r.signature), np.asarray(r.c)
                i, j = np.nonzero(np.triu(c[:, None] != c[None, :]))
                same = (s[i] == s[j]).sum(1)
                near = same >= LIKELY
                i, j, same = i[near], j[near], same[near]
                up = {x: x for x in c.tolist()}

                def root(x):
                    while up[x] != x:
                        up[x] = up[up[x]]
                        x = up[x]
                    return x

                for k in np.argsort(-same, kind="stable"):
                    x, y = root(int(c[i[k]])), root(int(c[j[k]]))
                    if x != y:
                        up[x] = y
                        p, q = [(int(r.doc_id[z]), int(r.set_a[z])) for z in (i[k], j[k])]
                        out.append((*min(p, q), *max(p, q)))
            yield _pairs(out)

    return _as_ids(flat.mapInPandas(run, PAIR))


def _rest(members: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs of one bucket but of different components, of fitting size and with enough equal slots.

    A chunk of mixed components is compared with itself; in larger buckets each two chunks meet in one row unless they are of one
    component.  The comparison is one array operation, so a large bucket is many small tasks.  A pair that shares several buckets
    comes out of the first of them only.
    """
    several = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("band")
    packed = _chunks(members.join(several, "band", "left_semi"), classes)
    # both sides are one plan, so the signatures are shuffled by bucket once
    left, right = [packed.select("band", *[F.col(c).alias(f"{c}{i}") for c in ("part", "no", "rows")]) for i in (1, 2)]
    met = left.join(right, "band").filter("no1 < no2 AND (part1 IS NULL OR part2 IS NULL OR part1 != part2)")
    fields = lambda rows, i: [F.expr(f"transform({rows}, x -> x.{c})").alias(f"{c}{i}") for c in FIELDS]
    cross = met.select(_low_half(F.col("band")).alias("band"), *fields("rows1", 1), *fields("rows2", 2))
    alone = packed.filter("part IS NULL").select(_low_half(F.col("band")).alias("band"), *fields("rows", 1), *[F.lit(None).cast(t).alias(f"{c}2") for c, t in zip(FIELDS, TYPES)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                own = r.doc_id2 is None
                first, second = ("1", "1") if own else ("1", "2")
                get = lambda c, i: getattr(r, f"{c}{i}")  # noqa: B023, E731
                s1, s2 = _slots(get("signature", first)), _slots(get("signature", second))
                n1, n2 = np.asarray(get("n_shingles", first)), np.asarray(get("n_shingles", second))
                other = np.asarray(get("c", first))[:, None] != np.asarray(get("c", second))[None, :]
                if own:
                    other = np.triu(other)
                size = 100 * np.minimum.outer(n1, n2) >= PERCENT * np.maximum.outer(n1, n2)
                i, j = np.nonzero(other & size)
                near = (s1[i] == s2[j]).sum(1) >= AGREE
                i, j = i[near], j[near]
                b1, b2 = np.stack(get("bands", first)), np.stack(get("bands", second))
                common = b1[i] == b2[j]
                here = b1[i, common.argmax(1)] == r.band if len(i) else np.zeros(0, bool)
                d1, d2, a1, a2 = (get(c, k) for c in ("doc_id", "set_a") for k in (first, second))
                for x, y in zip(i[here], j[here]):
                    p, q = (int(d1[x]), int(a1[x])), (int(d2[y]), int(a2[y]))
                    out.append((*min(p, q), *max(p, q)))
            yield _pairs(out)

    return _as_ids(alone.unionByName(cross).mapInPandas(run, PAIR))


def _rounds(members: int, classes: int) -> int:
    """Rounds that the buckets are dealt to, so that a round shuffles no more signatures than there are classes, about."""
    return max(1, -(-members // max(1, classes)))


def components(docs: DataFrame) -> DataFrame:
    """One row ``doc_id, n_shingles, component_id, kept`` per row of ``docs(doc_id, text)``.

    Documents are linked when their sets of distinct five-word shingles have a similarity of 0.75 or more, checked on full sets.

    1. Documents with equal sets collapse to a class, named by its smallest doc_id, before anything is compared.
    2. SuperMinHash signatures are cut into bands.  In each bucket every member is paired with one hub only: the member whose buckets
       are largest in sum, that is the centre of its near copies.  Verified pairs give components.
    3. Where a bucket still holds several components, likely pairs between them are verified, a forest per chunk of the bucket; then
       all others, chunk against chunk, whose signatures may pass; where many buckets are left, they are dealt to rounds, which bounds
       the signatures on disk at a time.  So every candidate pair of the banding is verified or already
       joined, and no group is expanded into all its pairs.

    A pair of similarity 0.75 is lost with a chance of about 2.7e-8: all bands miss it (2.4e-8), or fewer than AGREE slots agree (2.8e-9
    by the binomial, slots being independent at most).  At 0.76 it is 9.4e-9.

    Null or empty texts have no shingles, link with nothing and are kept; a null doc_id links with nothing, its component is null and
    it is kept; rows with equal doc_id but different texts are documents of their own that share the name; an empty table gives no rows.
    """
    return _judged(docs).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(docs: DataFrame) -> DataFrame:
    """``components`` with the digest ``set_a, set_b`` of each row's set, and ``component_set``: unlike components may share a doc_id."""
    columns(docs, "doc_id", "text")
    prepare(docs.sparkSession)
    since = mark()
    signed = written(signatures(docs), "near-signatures")
    named = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = named.groupBy("set_a", "set_b").agg(F.min(F.struct("doc_id", "n_shingles", "signature", "bands")).alias("r"))
    classes = written(classes.select(F.struct("r.doc_id", "set_a").alias("id"), "set_b", "r.n_shingles", "r.signature", "r.bands"), "near-classes")
    signed = written(signed.select("doc_id", "n_shingles", "set_a", "set_b"), "near-rows")
    forget(docs.sparkSession, since, ("near-classes", "near-rows"))  # signatures stay with the classes only
    banded = classes.select("id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    member = written(banded.join(shared, "band"), "near-buckets")
    weight = member.groupBy("id").agg(F.sum("members").alias("weight"))
    hub = member.join(weight, "id").groupBy("band").agg(F.max(F.struct("weight", "id")).alias("h")).select("band", F.col("h.id").alias("hub"))
    pairs = written(member.join(hub, "band").filter("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct(), "near-pairs")
    del hub
    sets = written(_sets(docs, weight.select("id")), "near-sets")
    edges = written(_verified(pairs, sets), "near-edges")

    def apart(links: DataFrame) -> DataFrame:
        """Members of buckets that hold more than one component."""
        labels = written(_labels(links), "near-labels")
        at = member.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = at.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("band")
        return at.join(mixed, "band", "left_semi")

    signs = classes.select("id", "n_shingles", "signature", "bands")

    likely = written(_likely(apart(edges), signs).join(pairs, ["a", "b"], "left_anti"), "near-likely")
    edges = written(edges.unionByName(_verified(likely, sets)), "near-edges")
    tried = pairs.unionByName(likely)
    left = written(apart(edges), "near-apart")
    rounds = _rounds(left.count(), classes.count())
    for i in range(rounds):
        some = left.filter(F.pmod(F.xxhash64("band"), F.lit(rounds)) == i)
        more = written(_verified(_rest(some, signs).join(tried, ["a", "b"], "left_anti"), sets), "near-more")
        edges = edges.unionByName(more)
    final = _labels(edges).select("id", F.col("component.doc_id").alias("component_id"), F.col("component.set_a").alias("component_set"))
    forget(docs.sparkSession, since, ("near-rows", "near-classes"))
    groups = classes.join(final, "id", "left").select(F.col("id.set_a").alias("set_a"), "set_b", F.coalesce("component_id", "id.doc_id").alias("component_id"), F.coalesce("component_set", "id.set_a").alias("component_set"))
    found = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(groups, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", "set_a", "set_b", "component_set", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


@F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in "nab"]))
def _digest(text: pd.Series) -> pd.DataFrame:
    """Size and 128-bit digest of the shingle set of each text."""
    out = []
    buf, off = lex.raw(pa.array(text, pa.string(), from_pandas=True))
    for i, j, part, offs in lex.slices(buf, off):
        h, doc = shingle_hashes(part, offs)
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        for d in range(j - i):
            u = np.unique(h[cut[d] : cut[d + 1]])
            out.append((len(u), digest_a(u), digest_b(u)))
    return pd.DataFrame(out, columns=["n", "a", "b"], dtype="int64")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, of its smallest doc_id; all columns are kept.

    Rows that share a doc_id are told apart by the digest of their set: of those that are the group's smallest, the first by digest and
    text stays.  Rows without shingles and those of a null doc_id all stay.
    """
    judged = written(_judged(docs), "near-judged")
    many = written(judged.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "near-names")
    gone = judged.filter(~F.col("kept")).select("doc_id")
    key = F.col("doc_id").cast("long") == F.col("__nd_id")
    if many.isEmpty():
        return docs.join(gone.select(F.col("doc_id").alias("__nd_id")), key, "left_anti")
    names = many.select(F.col("doc_id").alias("__nd_id"))
    alone = docs.join(gone.union(many).select(F.col("doc_id").alias("__nd_id")).distinct(), key, "left_anti")
    alike = docs.join(names, key, "left_semi").select(F.struct(*docs.columns).alias("r"), F.col("doc_id").cast("long").alias("__nd_id"), _digest(F.col("text").cast("string")).alias("__nd"))
    alike = written(alike, "near-namesakes")
    first = judged.filter("kept AND n_shingles > 0").select(F.col("doc_id").alias("__nd_id"), F.col("set_a").alias("a"), F.col("set_b").alias("b"), "component_set").distinct()
    sets = alike.filter("__nd.n > 0").select("r", "__nd_id", "__nd.a", "__nd.b").join(first, ["__nd_id", "a", "b"])
    one = sets.groupBy("__nd_id", "component_set").agg(F.min_by("r", F.struct("a", "b", "r.text", F.to_json("r"))).alias("r"))
    return alone.unionByName(alike.filter("__nd.n = 0").select("r.*")).unionByName(one.select("r.*"))
