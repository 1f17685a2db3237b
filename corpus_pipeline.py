"""From raw documents to packed sequences: language, quality, near-duplicates, packing.

Every stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and all but
the last return the columns of `documents`. `run` writes each result to shared storage and reads
it back, so a lost executor repeats one stage at most. No stage is expressible in SQL as a whole
(trained models, reachability, retrieval), so `ORACLE_SQL` is None and tests compare with
brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricon.llm import language, packing, quality, simhash
from rubricon.llm.queries import BYTE_BPE
from rubricon.session import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is accepted as one of the languages that the labels teach."""
    return language.identify(docs, docs.select("text", "lang")).filter("accepted").select(COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers in their language and source."""
    return quality.judged(docs).filter("kept").select(COLUMNS)


def near_unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each near-duplicate group. Of repeated rows with
    that doc_id one stays; documents without a doc_id stay only where their group has none with one."""
    groups = simhash.near_duplicates(docs)
    keep = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("fp")).agg(F.count("*").alias("_n"))
    named = docs.join(keep.filter("component_id is not null").select(F.col("component_id").alias("doc_id")), "doc_id", "left_semi")
    unnamed = simhash.fingerprints(docs.filter("doc_id is null"), out="_fp").join(
        keep.filter("component_id is null").select(F.col("fp").alias("_fp")), "_fp", "left_semi"
    )
    return named.dropDuplicates(["doc_id"]).select(COLUMNS).unionByName(unnamed.dropDuplicates(["_fp"]).select(COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 ids."""
    return packing.pack(docs, BYTE_BPE).drop("ids")


STAGES = [
    ("language ID", known_language),
    ("quality rules", good_quality),
    ("SimHash near-dedup", near_unique),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
