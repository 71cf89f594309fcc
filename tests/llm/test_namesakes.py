"""The pipeline's stages on rows that share a doc_id and on columns that the mix would add."""

from __future__ import annotations

import brute
import fixtures
from pyspark.sql import functions as F

import corpus_pipeline
from skyfold.llm import mixing, neardup


def test_namesakes_are_judged_alone(spark):
    base, own = " ".join(f"b{i}" for i in range(80)), " ".join(f"o{i}" for i in range(80))
    rows = [(1, base, "a"), (5, base + " more", "a"), (5, own, "a"), (5, None, "a"), (5, " ", "a"), (7, "the same row of a few words", "a"), (7, "the same row of a few words", "a"), (8, own, "a"), (None, own, "a"), (None, own, "a")]
    got = neardup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)).collect()
    want = [(1, base), (5, own), (5, None), (5, " "), (7, "the same row of a few words"), (None, own), (None, own)]
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(want, key=str)


def test_stages_on_the_awkward_table(spark):
    docs = spark.createDataFrame(fixtures.rows(), fixtures.SCHEMA).repartition(4)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    named = [(d, t) for d, t in rows if d is not None]
    groups = {(c if n else (d, k)) for k, (d, n, c, _) in enumerate(brute.near(named))}
    out = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns and out.count() == len(groups) + 1 + len(rows) - len(named)  # 4004 names two unlike documents
    assert out.filter("doc_id = 4003").count() == 1 and out.filter("doc_id = 4004").count() == 2

    clash = docs.filter("doc_id IS NOT NULL").drop("Target").dropDuplicates(["doc_id"])
    clash = clash.withColumns({"copies": F.lit(9), "target": F.concat(F.lit("t"), "doc_id"), "source_size": F.lit(-1)}).cache()
    out = corpus_pipeline.mixing_stage(spark, clash, "")
    got = out.collect()
    want = {r["doc_id"]: r["n"] for r in mixing.mix_sources(clash.drop("copies").withColumn("size", mixing.word_count("text"))).select("doc_id", F.col("copies").alias("n")).collect()}
    ids = [r["doc_id"] for r in got]
    assert out.columns == clash.columns and {d: ids.count(d) for d in want} == want
    assert all((r["copies"], r["target"], r["source_size"]) == (9, f"t{r['doc_id']}", -1) for r in got)
