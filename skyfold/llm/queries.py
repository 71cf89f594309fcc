"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyfold.llm import decontam, lexical, licenses, mixing, neardup, packing, quality, secret_scan, sharding, spelling, sql, substring, tokens, topk
from skyfold.llm.store import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_secret_scan(spark, sf_dir):
    return secret_scan.digest(table(spark, sf_dir, "documents"))


@query
def op2_quality_classifier(spark, sf_dir):
    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_token_files(spark, sf_dir):
    return tokens.digest(table(spark, sf_dir, "documents"))


@query
def op4_substring_dedup(spark, sf_dir):
    return substring.digest(table(spark, sf_dir, "documents"))


@query
def op5_minhash_near_dedup(spark, sf_dir):
    return neardup.components(table(spark, sf_dir, "documents"))


@query
def op6_exact_top_k(spark, sf_dir):
    return topk.digest(table(spark, sf_dir, "embeddings"))



@query
def op7_histogram_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op8_license_scan(spark, sf_dir):
    return licenses.digest(table(spark, sf_dir, "documents"))


@query
def op9_benchmark_decontamination(spark, sf_dir):
    return decontam.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sized = written(docs.select("doc_id", "source", mixing.word_count("text").alias("size")), "mix-sizes")
    out = mixing.mix_sources(sized)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op11_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op12_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op13_spelling_variants(spark, sf_dir):
    return spelling.group_variants(table(spark, sf_dir, "documents"))


SQL |= {"op4_substring_dedup": sql.SUBSTRING, "op5_minhash_near_dedup": sql.NEAR, "op6_exact_top_k": topk.SQL, "op9_benchmark_decontamination": sql.LEAKS, "op12_lexical_search": lexical.SQL}
