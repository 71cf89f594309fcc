"""Best-fit packing, ranked lexical search and spelling variants against plain restatements."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import brute
import fixtures
import numpy as np
import pytest
from tokenizers import Tokenizer

from skyfold.llm import lexical, packing, spelling

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


def test_plan_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.choice([1, 5, 17, 64, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        counts = Counter(lengths)
        plan, bins = packing.best_fit(dict(counts), capacity)
        room, seen = [capacity] * bins, Counter()
        for n, first, last, per, base, _ in plan.tolist():
            for r in range(first, last):
                room[base + (r - first) // per] -= n
                seen[n, r] += 1
        assert sorted(room) == brute.best_fit(lengths, capacity)
        assert seen == Counter((n, r) for n in counts for r in range(counts[n]))


def test_plan_does_not_grow_with_rows():
    rng = random.Random(2)
    small = {n: rng.randint(1, 50) for n in range(1, 4097)}
    large = {n: c * 100_000 + rng.randint(0, 99) for n, c in small.items()}
    (a, bins_a), (b, bins_b) = packing.best_fit(small, 4096), packing.best_fit(large, 4096)
    assert len(b) < 3 * len(a) and bins_b > 90_000 * bins_a
    assert bins_b <= 1.01 * sum(n * c for n, c in large.items()) / 4096 + 1


def check_packed(df, capacity):
    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    lengths = []
    for d, t in pairs(df):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            lengths.append(len(part))
            want[d, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    packed = packing.pack(df, capacity, with_ids=True)
    got = packed.collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(bins) == len(brute.best_fit(lengths, capacity))
    for r in packing.sequences(packed).collect():
        assert len(r["ids"]) == sum(n for _, n in bins[r["sequence_id"]]) and len(r["doc_ids"]) == len(r["starts"])


def test_packing(spark, docs, none, made):
    check_packed(docs, 4096)
    check_packed(docs, 64)
    check_packed(made, 4096)
    assert packing.pack(none).count() == 0
    odd = ["a  b", "A\n\nb's", " \n x", "́a é", "don't 's  ", "x<|endoftext|> y <|startoftext|>", "é. ×, «a» 12,3", "\u0085 a\x1cb\x0bc", "  ", "\ta\r\nb ", "Été, ΑΣ ΑΣ, 日本, İ"]
    rows = [(i, t + u) for i, (t, u) in enumerate((t, u) for t in odd for u in odd)]
    check_packed(spark.createDataFrame(rows, "doc_id long, text string"), 7)


def test_numbering_crosses_buckets(made, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 20)
    check_packed(made, 4096)


ITEMS = [(1, "the The w1 w2 w3"), (1, "the the w1 w2 w3 w4"), (2, None), (3, ""), (4, "same a, b. é 日本"), (4, "SAME a, b. é 日本"), (5, "w7 " * 40 + "unseen"), (None, "w10 w11 w12 w13 w14 w15"), (6, " ".join(f"w{i}" for i in range(300)))]


@pytest.mark.parametrize("span,block,shard", [(1024, 128, 16 << 20), (8, 4, 3000)])
def test_search(spark, docs, none, made, monkeypatch, span, block, shard):
    for name, value in (("SPAN", span), ("BLOCK", block), ("SHARD_BYTES", shard)):
        monkeypatch.setattr(lexical, name, value)
    items = spark.createDataFrame([(i, t, 1, "x") for i, t in ITEMS + ITEMS[:1]], "item_id long, text string, rank int, Score string")
    for df, top in ((docs, 50), (made, 3)):
        got = lexical.search(df, items, top)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, got.collect())) == Counter(brute.ranked(pairs(df), ITEMS, top))
    assert lexical.search(none, items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0


def test_posting_lists_round_trip():
    rng = np.random.default_rng(3)
    for limit in (1, 300, 70_000, 1 << 30):
        term = np.sort(rng.integers(0, 7, 2000))
        doc = np.concatenate([np.sort(rng.choice(max(limit, 2000), (term == t).sum(), replace=False)) for t in range(7)])
        impact = rng.integers(1, limit + 1, 2000)
        starts, heads, first_head, data, first_byte = lexical.posting_lists(term, doc, impact)
        for k, (h0, b0) in enumerate(zip(first_head, first_byte)):
            h1 = first_head[k + 1] if k + 1 < len(first_head) else len(heads)
            one = lexical.List(heads[h0:h1].tobytes(), data[b0:].tobytes(), 3)
            d, s = (np.concatenate(x) for x in zip(*(one.block(i) for i in range(h1 - h0))))
            own = slice(starts[k], starts[k] + len(d))
            assert (d == doc[own]).all() and (s == 3 * impact[own]).all()


def test_blocks_stay_closed():
    """Blocks of long, weak lists that no candidate needs are not decompressed."""
    term = np.repeat([0, 1], [20, 50_000])
    doc = np.concatenate([np.arange(20), np.arange(50_000)])
    impact = np.concatenate([np.full(20, 900), np.full(50_000, 5)])
    starts, heads, first_head, data, first_byte = lexical.posting_lists(term, doc, impact)
    lists = [lexical.List(heads[: first_head[1]].tobytes(), data[: first_byte[1]].tobytes(), 10), lexical.List(heads[first_head[1] :].tobytes(), data[first_byte[1] :].tobytes(), 1)]
    d, s = lexical.best(lists, 50_000, 10)
    assert list(d) == list(range(10)) and set(s) == {9005} and len(lists[1].open) < 10


def test_near_down_the_list():
    rng = random.Random(2)
    for _ in range(200):
        words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(60)})
        common, jump = spelling.sort_list(words)
        for x in [*words[:20], "", "abc"]:
            assert [words[i] for i in spelling.near(x, words, common, jump)] == [y for y in words if brute.one_edit(x, y)]


def test_checksums_of_joined_texts():
    a = [b"", b"1:", b"123456:", b"\xc3\xa9"]
    b = [b"", b"a", b"longer", b"x" * 64]
    for x in a:
        got = spelling.joined_crc(np.array([zlib.crc32(x)] * 4, np.uint32), np.array([zlib.crc32(y) for y in b], np.uint32), np.array([len(y) for y in b]))
        assert got.tolist() == [zlib.crc32(x + y) for y in b]


def test_spelling(spark, docs, none):
    rng = random.Random(5)
    stems = ["".join(rng.choices("abcéz", k=rng.randint(5, 9))) for _ in range(60)]
    rows = []
    for i in range(400):
        words = []
        for w in rng.choices(stems, weights=[1 / (k + 1) ** 2 for k in range(60)], k=60):
            k = rng.randrange(len(w))
            words.append(rng.choice([w, w, w, w, w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1 :], w.upper()]))
        rows.append((i if i % 50 else None, rng.choice([" ", "\n", "-"]).join(words) + " " + "q" * 70 * (i % 9 == 0)))
    rows += [(9, None), (10, ""), (None, None)] + rows[:3] * 2
    wild = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, Word string")
    for df, least, group in ((wild, 5, 2000), (wild, 1, 4), (docs, 1, 50)):
        got = spelling.group_variants(df, points=min(6, least + 2), count=least, group=group)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert {r[0]: tuple(r[1:]) for r in got.collect()} == brute.spelling(pairs(df), min(6, least + 2), least)
    assert spelling.group_variants(none).count() == 0
