"""Result tables: run headers, metric rows, cached responses, per-example artifacts.

Plain Parquet and JSON tables, appended in batches. Times are parameters, never the
clock, so that a run can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricon.operators.positions import first_per_key
from rubricon.operators.reports import distinct_positions

TTL_HOURS = 24
CALL_KEY = ["example_id", "model", "prompt_hash"]
SUMMARY_FILE = "summary.json"


def append(table: DataFrame, path: str, *partitions: str) -> None:
    writer = table.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def run_header(runs: DataFrame, eval_id: Column, created_at: Column, version: str, position: Column | None = None) -> DataFrame:
    """One header row per evaluation of `runs`: examples, models, and empty totals.

    With an integer `position` per example, examples are counted in bitmaps that are merged
    before the shuffle; without one, every distinct id of an evaluation is shuffled."""
    # The list holds distinct model names only, folded map-side.
    models = F.array_sort(F.collect_set("model_name"))
    if position is None:
        found = runs.groupBy(eval_id.alias("eval_id")).agg(
            F.min(created_at).alias("created_at"), F.count_distinct("example_id").alias("num_examples"), models.alias("_models")
        )
    else:
        bucket, bitmap = distinct_positions(position)
        parts = runs.groupBy(eval_id.alias("eval_id"), bucket.alias("_bucket")).agg(
            F.min(created_at).alias("created_at"), bitmap.alias("_seen"), models.alias("_models")
        )
        found = parts.groupBy("eval_id").agg(
            F.min("created_at").alias("created_at"),
            F.sum(F.bitmap_count("_seen")).alias("num_examples"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set("_models")))).alias("_models"),
        )
    return found.select(
        "eval_id",
        "created_at",
        F.lit(version).alias("dataset_version"),
        "num_examples",
        F.size("_models").cast("bigint").alias("num_models"),
        F.array_join("_models", ",").alias("models"),
        F.lit(0.0).alias("total_cost_usd"),
        F.lit(0).cast("bigint").alias("total_tokens"),
        F.lit(0.0).alias("duration_seconds"),
    )


def save_results(metrics: DataFrame, path: str, eval_id: str) -> None:
    """Append metric rows under their evaluation id."""
    append(metrics.withColumn("eval_id", F.lit(eval_id)), path, "eval_id")


def get_evaluation(headers: DataFrame, results: DataFrame) -> DataFrame:
    """All result rows with their header."""
    return headers.join(results, "eval_id")


def latest_per_model(results: DataFrame) -> DataFrame:
    """The last stored row per evaluation and model."""
    return first_per_key(results, ["eval_id", "model_id"], F.desc("created_at"), F.desc("pos"))


def recent_runs(headers: DataFrame, limit: int = 10) -> DataFrame:
    return headers.orderBy(F.desc("created_at"), F.desc("eval_id")).limit(limit)


# --- cached responses ------------------------------------------------------------------


def with_prompt_hash(calls: DataFrame) -> DataFrame:
    return calls.withColumn("prompt_hash", F.md5("prompt"))


def ttl_limit(now: str, ttl_hours: int = TTL_HOURS) -> Column:
    return F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(0), F.lit(ttl_hours))


def unexpired(cache: DataFrame, now: str, ttl_hours: int = TTL_HOURS) -> DataFrame:
    return cache.filter(F.col("created_at") > ttl_limit(now, ttl_hours))


def cache_lookup(cache: DataFrame, now: str, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Newest unexpired row per call."""
    return first_per_key(unexpired(cache, now, ttl_hours), CALL_KEY, F.desc("created_at"), F.desc("pos"))


def write_cache(cache: DataFrame, path: str, name: str, buckets: int = 64) -> None:
    """The cache as a table `name` at `path`, clustered by call: rows of a call lie in one bucket,
    sorted, so lookups read it without moving it. Choose `buckets` for buckets of a few hundred MB."""
    dealt = cache.repartition(buckets, *CALL_KEY)
    dealt.write.bucketBy(buckets, *CALL_KEY).sortBy(*CALL_KEY).option("path", path).saveAsTable(name)


def cached_calls(calls: DataFrame, cache: DataFrame, now: str, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """Calls with the cached answer they can reuse, if any.

    Only cached rows of calls that are asked for are ranked. Of a cache written by `write_cache`
    no row is moved: the calls come to its buckets.
    """
    asked = calls.select(*CALL_KEY).distinct()
    hit = cache_lookup(cache.join(asked, CALL_KEY, "left_semi"), now, ttl_hours).drop("pos")
    return calls.join(hit, CALL_KEY, "left")


def cache_purge(cache: DataFrame, now: str, ttl_hours: int = TTL_HOURS) -> DataFrame:
    """What stays after expired rows are removed."""
    return cache.filter(F.col("created_at") >= ttl_limit(now, ttl_hours))


# --- artifacts per experiment ----------------------------------------------------------


MODEL_RESULT = "struct<model_name: string, method: string, tokens: bigint, cost_micros: bigint>"
ARTIFACT = f"example_id STRING, model_results ARRAY<{MODEL_RESULT}>, experiment STRING"


def example_results(runs: DataFrame, experiment: str) -> DataFrame:
    """One nested row per example of an experiment, with the results of all its models."""
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    result = F.struct("model_name", "method", tokens.cast("bigint").alias("tokens"), F.col("cost_micros").cast("bigint").alias("cost_micros"))
    # An example has a result per model and method: the list is as long as the grid is wide.
    return runs.groupBy(F.col(experiment).alias("experiment"), "example_id").agg(F.array_sort(F.collect_list(result)).alias("model_results"))


def save_example_results(rows: DataFrame, path: str) -> None:
    """JSON artifacts, one object per line, laid out by experiment: the form for many examples."""
    rows.write.mode("append").partitionBy("experiment").json(path)


def read_artifacts(spark: SparkSession, path: str, schema: str = ARTIFACT, layout: str = "documents") -> DataFrame:
    """Artifacts of all experiments (folders `experiment=...`, or a field) with the `file` they come
    from; summaries written beside them are not artifacts.

    `documents`: a file is one object or one array of objects, indented or not, as published.
    `lines`: one object per line. What can't be read is a row without `example_id`.
    """
    options = {"multiLine": layout == "documents", "columnNameOfCorruptRecord": "_broken"}
    rows = spark.read.schema(f"{schema}, _broken STRING").options(**options).json(path)
    rows = rows.filter(F.col("_metadata.file_name") != SUMMARY_FILE).withColumn("file", F.col("_metadata.file_path"))
    return rows.withColumn("example_id", F.when(F.col("_broken").isNull(), F.col("example_id"))).drop("_broken")


def unread_artifacts(artifacts: DataFrame) -> DataFrame:
    """Files with rows that have no id, and how many."""
    return artifacts.filter("example_id is null").groupBy("experiment", "file").agg(F.count(F.lit(1)).alias("rows"))


def artifact_totals(artifacts: DataFrame) -> DataFrame:
    """`experiment, example_id, results, total_tokens, cost_micros` of the nested artifacts that have an id."""

    def total(field: str) -> Column:
        values = F.transform("model_results", lambda r: F.coalesce(r[field], F.lit(0).cast("bigint")))
        return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)

    return artifacts.filter("example_id is not null").select(
        "experiment",
        "example_id",
        F.size("model_results").cast("bigint").alias("results"),
        total("tokens").alias("total_tokens"),
        total("cost_micros").alias("cost_micros"),
    )


def experiment_summary(artifacts: DataFrame) -> DataFrame:
    """Examples, tokens and cost per experiment, of nested artifacts or of rows with their totals.

    Examples are folded first, so one large experiment does not meet in one task unfolded.
    """
    totals = artifact_totals(artifacts) if "model_results" in artifacts.columns else artifacts
    per_example = totals.groupBy("experiment", "example_id").agg(
        F.sum("total_tokens").alias("tokens"), F.sum("cost_micros").alias("micros")
    )
    return per_example.groupBy("experiment").agg(
        F.count(F.lit(1)).alias("total_examples"),
        F.sum("tokens").alias("total_tokens"),
        (F.sum("micros") / F.lit(1_000_000.0)).alias("total_cost_usd"),
    )


# --- report sink -----------------------------------------------------------------------


def write_report(sections: dict[str, DataFrame], path: str) -> None:
    """One JSON table per report section."""
    for name, table in sections.items():
        table.write.mode("overwrite").json(f"{path}/{name}")


def nested_report(summary: DataFrame, by_model: DataFrame, by_error: DataFrame) -> DataFrame:
    """One nested row: summary plus the short per-model and per-error tables.

    Only folded tables go in; detail rows are a section of their own.
    """

    def listed(table: DataFrame, name: str) -> DataFrame:
        return table.agg(F.array_sort(F.collect_list(F.struct(*table.columns))).alias(name))

    parts = summary.select(F.struct(*summary.columns).alias("summary"))
    for name, table in (("by_model", by_model), ("error_distribution", by_error)):
        parts = parts.unionByName(listed(table, name), allowMissingColumns=True)
    return parts.agg(*[F.first(c, ignorenulls=True).alias(c) for c in parts.columns])
