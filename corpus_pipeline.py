"""From raw documents to token files: five stages, each a table of documents but the last.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept; its result is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyfold.llm import decontam, mixing, neardup, quality, store, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; empty and null texts are scored like any other."""
    return quality.good(docs, _table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id."""
    return neardup.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; documents that are mostly benchmark go."""
    return decontam.remove_hits(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources meet their target weights: a document comes as often as the mix takes it (not at all, once or twice)."""
    own = "__mix_size"
    plain = [c if c in ("doc_id", "source") else f"__mix_{i}" for i, c in enumerate(docs.columns)]  # no name that the mix adds
    mixed = mixing.mix_sources(docs.withColumn(own, mixing.word_count("text")).toDF(*plain, own), own)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__mix_copies")))
    return mixed.withColumnRenamed("copies", "__mix_copies").filter("__mix_copies > 0").withColumn("__mix_copy", copies).select(*[F.col(a).alias(b) for a, b in zip(plain, docs.columns)])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in ascending doc_id order in the shared folder, read back: ``doc_id, start, n_tokens, ids_crc32``."""
    return tokens.digest(docs)


STAGES = [
    ("quality_classifier", quality_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("token_files", token_stage),
]
ORACLE_SQL = None  # classifier, sampling and tokenizer have no SQL; tests compare each stage with a plain restatement


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage leaves in the shared folder goes as soon as its result is written."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with store.passing(spark):
            out = stage(spark, docs, sf_dir)
            path = store.folder(spark, f"pipeline-{name}", keep=True)
            out.write.parquet(path)
            schema = out.schema
        docs = spark.read.schema(schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
