"""Each operator against a plain restatement of its contract, on the small table and on generated documents."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import fixtures
import numpy as np
import pytest
from pyspark.sql import functions as F

from skyfold.llm import decontam, licenses, mixing, neardup, quality, secret_scan, sharding, substring, tokens, topk
from skyfold.llm.store import folder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixtures.rows(), fixtures.SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], fixtures.SCHEMA)


@pytest.fixture(scope="module")
def made(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return Counter(map(tuple, rows))


def test_secrets(spark, docs, none, made):
    parts = [
        "password=abcdef", "token: abc", "secret=token: abcdefgh", 'API_KEY = "Zz9/+_.=-x"', "AKIA" + "A" * 16, "AKIA" + "B" * 15, "f" * 24, "g" * 30, "a1" * 20,
        "é日本 passwd='longvalue' AKIAAKIA" + "C" * 16, "token=" + "0" * 40 + "\npassword:  hunter22",
    ]
    rows = [(i, p) for i, p in enumerate([*parts, " x ".join(parts), "", None])]
    for df in (spark.createDataFrame(rows, "doc_id long, text string"), docs, made):
        got = secret_scan.find_secrets(df.select("doc_id", "text")).collect()
        want = [(d, *brute.secrets(t)) for d, t in pairs(df)]
        assert bag((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_spans"]) for r in got) == bag(want)
    assert secret_scan.find_secrets(none).count() == 0
    assert "Size" in secret_scan.find_secrets(docs).columns


def test_weak_parts_need_partners(spark):
    weak_secret, weak_access, end = "aB3" * 12, "ASIA12345678", "https://example.org/x"
    rows = [(0, weak_secret), (1, f"{weak_access} {weak_secret}"), (2, f"{weak_access} {'- ' * 300} {weak_secret}"), (3, f"{end} {weak_access} {weak_secret}"), (4, f"{end} {weak_secret}"), (5, f"{weak_access} password=abcdefgh")]
    got = {r["doc_id"]: [x.split(":")[0] for x in r["spans"].split(",") if x] for r in secret_scan.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: [], 1: ["weak_access", "weak_secret"], 2: [], 3: ["endpoint", "weak_access", "weak_secret"], 4: [], 5: ["weak_access", "assign"]}


def test_quality(spark, docs, none, made):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for df in (made, docs):
        got = quality.digest(df, labels)
        assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == df.count()
        assert got.filter("score IS NULL OR score < 0 OR score > 1 OR predicted != cast(score >= 0.7 AS int)").count() == 0
    assert quality.digest(none, labels).count() == 0
    assert quality.digest(docs, labels.limit(0)).filter("score != 0.5").count() == 0
    assert quality.good(docs, labels).columns == docs.columns


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.digest(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    held = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    right, n = held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).first()
    assert n > 50 and right > 0.95


def test_log_ratio_and_descent():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.concatenate([rng.integers(0, 50, 8), [60 if i % 2 else 70]])) for i in range(200)]
    model = quality.fit(rows, np.arange(200) % 2)
    assert all((model.score(r) > 0.5) == (i % 2 == 1) for i, r in enumerate(rows))


def check_tokens(spark, df):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_tokenizer())
    want = defaultdict(list)
    for d, t in pairs(df):
        want[d].append([*tok.encode(t or "", add_special_tokens=False).ids, 0])
    got = tokens.read_tokens(tokens.write_tokens(df, folder(spark, "test-tokens"), partitions=4), with_ids=True).orderBy("start").collect()
    at, last = 0, None
    for r in got:
        assert r["start"] == at and list(r["ids"]) in want[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        want[r["doc_id"]].remove(list(r["ids"]))
        assert last is None or r["doc_id"] is None or last <= r["doc_id"]
        at, last = at + r["n_tokens"], r["doc_id"] if r["doc_id"] is not None else last
    assert not any(want.values())


def test_tokens(spark, docs, none, made):
    check_tokens(spark, docs)
    check_tokens(spark, made)
    assert tokens.digest(none).count() == 0
    odd = ["a  b", "a\n\nb", " \n x", "a  b", "don't 's  ", "x<|endoftext|> y <|endoftext|>", "é. ×, «a» 12,3", "\u0085 a\x1cb", "  ", "\ta\r\nb ", "Été, ça. 日本,"]
    rows = [(i, t + u) for i, (t, u) in enumerate((t, u) for t in odd for u in odd)]
    check_tokens(spark, spark.createDataFrame(rows, "doc_id long, text string"))


def test_substring(spark, docs, none, made):
    for df in (docs, made):
        got = substring.digest(df).collect()
        rows = pairs(df)
        named = [(d, t) for d, t in rows if d is not None]
        want = brute.repeats(named) + [(None, len(brute.SPACED.findall(t or "")), 0, brute.sha(" ".join(brute.SPACED.findall(t or "")))) for d, t in rows if d is None]
        assert bag((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == bag(want)
    assert substring.digest(none).count() == 0


def test_substring_shards_split(monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 30, 300)]
    texts = [" ".join(base[a : a + 90]).encode() for a in range(0, 200, 7)] + [b"only here " * 40]
    first = np.arange(len(texts))
    both = np.ones(len(texts), bool)
    whole = substring.shard_matches(texts, first, both, both)
    assert whole == substring.shard_matches(texts, first, both, both, limit=400)
    assert any(whole)


def test_fm_index_matching():
    from skyfold.llm.fmindex import FMIndex

    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 4, 400), 0)
    index = FMIndex(text, 12)
    probe = rng.integers(1, 5, 300)
    known = {tuple(text[i : i + n]) for n in range(1, 13) for i in range(len(text) - n + 1)}
    for _, pos, size, low in index.matching(probe, np.array([0]), np.array([len(probe)])):
        p = int(pos[0])
        best = max((n for n in range(1, 13) if tuple(probe[p : p + n]) in known and p + n <= len(probe)), default=0)
        assert size[0] == best
        if best:
            at = index.suffixes[low[0]]
            assert (text[at : at + best] == probe[p : p + best]).all()


def test_near_duplicates(spark, docs, none, made):
    for df in (docs, made):
        rows = pairs(df)
        seen: dict = {}
        named = [(d, t) for d, t in rows if d is not None]
        want = brute.near(named)
        got = neardup.components(df).collect()
        assert bag((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == bag(want)
        assert all(r["component_id"] is None and r["kept"] for r in got if r["doc_id"] is None)
        assert len(got) == len(rows) and not seen
    assert neardup.components(none).count() == 0
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id BETWEEN 3000 AND 3009").count() == 0


def test_super_min_hash_estimates():
    rng = np.random.default_rng(1)
    errors = []
    for share in (0.5, 0.75, 0.9):
        for n in (4, 40, 400):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = a.copy()
            b[int(n * share) :] = rng.integers(0, 1 << 63, n - int(n * share)).astype(np.uint64)
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            s = neardup.super_min_hash(np.concatenate([a, b]), np.repeat([0, 1], n), 2)
            errors.append(abs((s[0] == s[1]).mean() - true))
    assert max(errors) < 0.2 and np.mean(errors) < 0.07


def test_signatures_lose_fewer_pairs_than_bands():
    def below(n, p):
        return sum(math.comb(neardup.SLOTS, k) * p**k * (1 - p) ** (neardup.SLOTS - k) for k in range(n))

    for p in (0.75, 0.76, 0.8):
        assert below(neardup.AGREE, p) < (1 - p**neardup.ROWS) ** neardup.BANDS


def test_near_copies_without_centre(spark):
    """A chain: neighbours are linked, ends are not; one component all the same."""
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 120])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.components(df).collect()) == bag(brute.near(rows))


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 16)) / 4)]
    rows += [(300, None), (350, [1.0, None]), (400, [float("nan")] * 16), (450, [float("inf")] * 16), (None, [0.1] * 16), (500, [0.0] * 16), (501, [0.25] * 16), (502, [0.25] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(4)
    df = df.unionByName(df.filter("vec_id IN (50, 100, 7)")).unionByName(df.filter("vec_id = 8").withColumn("vec_id", F.lit(150).cast("long")))
    con = duckdb.connect()
    con.register("embeddings", df.select("vec_id", "embedding").toPandas())
    want = bag(con.execute(topk.SQL).fetchall())
    data = [(r["vec_id"], [math.floor(256 * x) for x in r["embedding"]]) for r in df.collect() if r["vec_id"] is not None and r["embedding"] is not None and all(x is not None and math.isfinite(x) for x in r["embedding"])]
    plain = []
    for i, (v, e) in enumerate(data):
        if v % 50 == 0:
            ranked = sorted((-sum(map(int.__mul__, e, f)), w) for j, (w, f) in enumerate(data) if j != i)[:5]
            plain += [(v, n + 1, w, -s) for n, (s, w) in enumerate(ranked)]
    assert bag(plain) == want and sum(r[0] == 50 for r in plain) == 10
    for shard, block in ((4096, 512), (37, 3)):
        got = topk.top_k(df, F.col("vec_id") % 50 == 0, shard=shard, block=block)
        assert bag(got.collect()) == want
    assert topk.digest(df.limit(0)).count() == 0
    assert topk.digest(df.filter("vec_id IN (0, 1)")).count() == 1
    with pytest.raises(ValueError):
        topk.digest(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e12).cast("array<double>")))


def test_sharding(spark, docs, none, made):
    for df in (docs, made):
        got = sharding.shard(df)
        rows = got.select("doc_id", "text", "size", "text_crc32", "shard", "slot").collect()
        assert bag((r["doc_id"], r["text"]) for r in rows) == bag(pairs(df))
        assert all(r["size"] == len((r["text"] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) for r in rows)
        sizes, slots = defaultdict(int), defaultdict(list)
        for r in rows:
            sizes[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        big = max(r["size"] for r in rows)
        assert max(sizes.values()) - min(sizes.values()) <= 2 * big + 0.02 * sum(sizes.values())
    assert sharding.shard(none).count() == 0
    hot = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "one text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = [r["b"] for r in sharding.shard(hot, bucket_bytes=4096).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(got) == 8 and max(got) < 1.02 * min(got)


def test_licenses(spark, docs, none, made):
    extra = ["Released under the MIT License.", "cc by cc-by CC\tBY", "xgnu general public license", "GNU General\nPublic, License!", "mit licenses mit license", "the apache  license apache license",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files to deal in the Software without restriction", None, ""]
    df = spark.createDataFrame(list(enumerate(extra)), "doc_id long, text string")
    for t in (df, docs, made):
        got = licenses.scan(t.select("doc_id", "text")).collect()
        assert bag((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got) == bag((d, *brute.licenses(x)) for d, x in pairs(t))
        assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
    assert {r["doc_id"]: r["labels"] for r in licenses.scan(df).collect()}[6] == "mit"
    assert licenses.scan(none).count() == 0


def test_license_join_is_exact(spark):
    """Every block at the threshold is found: containment of random word sets in all windows, by brute force."""
    import random

    rng = random.Random(8)
    vocab = [f"v{i}" for i in range(30)]
    templates = [("one", " ".join(rng.sample(vocab, 9))), ("two", " ".join(rng.sample(vocab, 14))), ("six", " ".join(rng.sample(vocab, 6)))]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([5, 12, 40])))) for i in range(150)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates, 0.7, 8).collect()}
    for d, t in rows:
        w, want = t.split(), set()
        for b in range(max(1, math.ceil(len(w) / 8) - 1)):
            block = set(w[b * 8 : b * 8 + 16])
            want |= {label for label, s in templates if len(block & set(s.split())) >= math.ceil(0.7 * len(set(s.split())) - 1e-9)}
        assert got[d] == ",".join(sorted(want))


def test_decontamination(spark, docs, none, made):
    items = [(str(i), " ".join(t.split()[3:40])) for i, t in pairs(docs) if i is not None and t and i % 7 == 0] + [("s1", "w3"), ("s2", "w1 w2"), ("e", ""), ("n", None), (None, "w5 w6"), ("s1", "w3"), ("B", "The W9, w10")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = bag(brute.leaks(pairs(docs), items))
    assert bag(decontam.digest(docs, bench).collect()) == want
    split = decontam.find_hits(docs, bench, keep=["doc_id"], block_chars=300)
    assert bag((r["doc_id"], r["hits"]["n_words"], len(r["hits"]["items"])) for r in split.collect()) == bag((a, b, d) for a, b, _, d, _, _ in want.elements())
    real = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert bag(decontam.digest(made, real).collect()) == bag(brute.leaks(pairs(made), [(r["item_id"], r["text"]) for r in real.collect()]))
    assert decontam.digest(none, bench).count() == 0 and decontam.digest(docs, bench.limit(0)).filter("contaminated").count() == 0
    cut = decontam.remove_hits(made, real)
    assert cut.columns == made.columns
    clean = decontam.digest(cut, real)
    assert clean.filter("contaminated").count() == 0
    before = decontam.digest(made, real).filter("NOT contaminated").select("doc_id")
    assert made.join(before, "doc_id").select("doc_id", "text").exceptAll(cut.select("doc_id", "text")).count() == 0


def test_mixing(spark, docs, none, made):
    for df in (docs, made):
        sized = df.withColumn("words", mixing.word_count("text"))
        out = mixing.mix_sources(sized, "words", block=64)
        rows = out.select("doc_id", "source", "words", "source_size", "target", "copies").collect()
        assert len(rows) == df.count()
        own, words = defaultdict(int), defaultdict(int)
        for r in rows:
            own[r["source"]] += r["words"]
            words[r["source"]] += r["words"] * r["copies"]
            assert 0 <= r["copies"] <= 2
        order = sorted((s for s in own if s is not None)) + [s for s in own if s is None]
        total, w = 1.5 * sum(own.values()), [3, 1, 2]
        target, open_, rest = {}, list(enumerate(order)), total
        while open_:
            lam = rest / sum(w[i % 3] for i, _ in open_)
            over = [(i, s) for i, s in open_ if lam * w[i % 3] > 2 * own[s]]
            for i, s in over or open_:
                target[s] = 2.0 * own[s] if over else lam * w[i % 3]
            if not over:
                break
            rest -= sum(2 * own[s] for _, s in over)
            open_ = [x for x in open_ if x not in over]
        for r in rows:
            assert r["source_size"] == own[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        for s in own:
            big = max(r["words"] for r in rows if r["source"] == s)
            assert abs(words[s] - target[s]) <= max(0.5 * big, 0.02 * target[s]) + 1
        assert bag(rows) == bag(mixing.mix_sources(sized.repartition(3), "words", block=64).select("doc_id", "source", "words", "source_size", "target", "copies").collect())
    assert mixing.mix_sources(none.withColumn("words", F.lit(1).cast("long")), "words").count() == 0


def test_cube_flight_keeps_chances():
    size = np.array([900.0, 50, 40, 30, 30, 20, 10, 5, 5, 1])
    got = np.mean([mixing.flight(np.full(10, 0.3), size, s) for s in range(3000)], 0)
    assert np.abs(got - 0.3).max() < 0.04


def test_sql_states_the_same(spark):
    from skyfold.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, text in SQL.items():
        want = con.execute(text)
        columns = [c[0] for c in want.description]
        assert bag(QUERIES[name](spark, SF).select(*columns).collect()) == bag(want.fetchall()), name


def test_long_templates(spark):
    """A notice of 300 words, met anywhere in a text, and one of 90 across a border of the usual blocks."""
    long, mid = [f"l{i}" for i in range(300)], [f"m{i}" for i in range(90)]
    rows = [(i, " ".join([f"x{k}" for k in range(at)] + words + ["tail"] * 200)) for i, (at, words) in enumerate([(0, long), (50, long), (333, long), (30, mid), (101, mid), (10, long[:250])])]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), [("long", " ".join(long)), ("mid", " ".join(mid))])
    assert {r["doc_id"]: r["labels"] for r in got.collect()} == {0: "long", 1: "long", 2: "long", 3: "mid", 4: "mid", 5: ""}
