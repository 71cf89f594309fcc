"""The pipeline stage by stage, each against a plain restatement on its own input."""

from __future__ import annotations

import zlib

import brute
import numpy as np

import corpus_pipeline
from skyfold.llm import mixing, quality, tokens

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        kept.append((docs, spark.read.parquet(str(tmp_path / name))))
        docs = kept[-1][1]
    text = lambda df: [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    # classifier: exactly the documents that the model accepts
    a, b = kept[0]
    assert {r[0] for r in quality.digest(a, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").select("doc_id").collect()} == {d for d, _ in text(b)}
    # near-dedup: the smallest of each group
    a, b = kept[1]
    assert sorted(d for d, _, _, k in brute.near(text(a)) if k) == sorted(d for d, _ in text(b))
    # decontamination: clean documents unchanged, no window left
    a, b = kept[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {x[0] for x in brute.leaks(text(a), items) if x[-1]}
    assert {x for x in text(a) if x[0] not in dirty} <= set(text(b)) and not any(x[-1] for x in brute.leaks(text(b), items))
    # mixing: each document as often as the mix takes it
    a, b = kept[3]
    want = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(a.withColumn("size", mixing.word_count("text"))).collect()}
    ids = [d for d, _ in text(b)]
    assert {d: ids.count(d) for d in want} == want and set(text(b)) <= set(text(a))
    # token files
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(tokens.default_tokenizer()), 0
    rows = kept[4][1].orderBy("start").collect()
    for r, (d, t) in zip(rows, sorted(text(kept[4][0]), key=lambda x: x[0]), strict=True):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0
