"""Registered queries of the package: each applies one operator, with its production parameters,
to its whole table and derives the columns of the query's contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricon.llm import (
    bpe, chunked_bpe, language, nearest, packing, quality, simhash, spelling, token_counts, token_files, toxicity, tree_weighting, whitening,
)
from rubricon.session import shared_dir, stored

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *columns)


def fold(modulus: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query
def op1_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree_weighting.score(documents(spark, sf_dir, "lang"), fold(10) != 0, F.col("lang"), across_words=True)
    held_out = (~F.col("training")).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, sf_dir), BYTE_BPE)
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 512).alias("over_limit"),
    )


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False)))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(fold(5) != 0).select("doc_id", "toxic")
    model = toxicity.train(docs.filter(~F.col("held_out")).select("doc_id", "text"), labels)
    return toxicity.score(docs, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest.search(vectors, F.col("vec_id") % 100 == 0)


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(documents(spark, sf_dir), BYTE_BPE).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        "ids",
    )
    return bpe.decode(ids, BYTE_BPE).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = quality.with_counts(documents(spark, sf_dir, "lang", "source")).drop("text")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = stored(counted.withColumn("base_failed", failed), "counts")
    return quality.judged_counts(rows).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "tokens")
    token_files.write_tokens(documents(spark, sf_dir), path, BYTE_BPE)
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "lang").withColumn("held_out", F.coalesce(fold(4) == 2, F.lit(False)))
    labelled = docs.filter(~F.col("held_out")).select("text", "lang")
    found = language.identify(docs.drop("lang"), labelled)
    return found.select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "accepted")


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), BYTE_BPE).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op11_chunked_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = chunked_bpe.encode(documents(spark, sf_dir), BYTE_RANKS, keep=["doc_id"])
    return chunked_bpe.decode(ids, BYTE_RANKS, packed="packed").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return whitening.whiten(vectors).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"
    )


@query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir))
