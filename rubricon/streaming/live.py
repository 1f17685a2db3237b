"""Running totals and cache de-duplication over arriving results."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from rubricon.operators.positions import first_per_key
from rubricon.session import shared_dir
from rubricon.sources.store import CALL_KEY


def open_stream(spark: SparkSession, path: str, schema, files: str | None = None, per_trigger: int | None = None) -> DataFrame:
    """A file stream of Parquet rows; `files` is a name pattern."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def running_by_model(results: DataFrame) -> DataFrame:
    """Rows, correct rows and cost per model so far."""
    return results.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_correct").alias("correct"),
        F.sum("cost_micros").alias("cost_micros"),
    )


def run_updates(totals: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available; each batch appends the models it changed.

    A batch writes its own directory and overwrites it when replayed, so a restart after
    a lost driver leaves no doubled rows.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
            f"{path}/batch={batch_id}"
        )

    query = (
        totals.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def current_totals(spark: SparkSession, path: str) -> DataFrame:
    """The latest totals per model out of the written batches."""
    written = spark.read.parquet(path).drop("batch")
    return first_per_key(written, ["model_name"], F.desc("batch_id")).drop("batch_id")


#: Rows travel through the state operator as JSON, so that every type comes back as it was.
ROW_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


#: Groups of keys that share a state, and what a group's state holds.
STATE_GROUPS = 1024
STATE = "keys array<string>, last_kept array<long>"


def micros(spark: SparkSession, duration: str) -> int:
    """Microseconds of a duration such as `24 hours`."""
    start = F.lit("2000-01-01").cast("timestamp")
    return spark.range(1).select(F.unix_micros(start + F.expr(f"interval {duration}")) - F.unix_micros(start)).first()[0]


def kept_places(times: np.ndarray, last: int | None, ttl: int) -> tuple[list[int], int]:
    """(places of the times that stay, last kept time). `times` rise and are distinct. A time stays
    unless a kept one lies less than `ttl` before it; times before `last` have none and stay."""
    late = 0 if last is None else int(np.searchsorted(times, last))
    kept = list(range(late))
    at = late if last is None else int(np.searchsorted(times, last + ttl))
    while at < len(times):
        kept.append(at)
        last = int(times[at])
        at = int(np.searchsorted(times, last + ttl))
    return kept, last


def answered(ttl: int):
    """The state function of `unanswered`: gives out the kept rows of one group of keys."""

    def step(group, frames, state):
        rows: dict[str, dict[int, str]] = {}  # of each key and time the smallest row
        for frame in frames:
            for key, at, row in zip(frame["key"].tolist(), frame["at"].tolist(), frame["row"].tolist()):
                of_key = rows.setdefault(key, {})
                if at not in of_key or row < of_key[at]:
                    of_key[at] = row
        if state.hasTimedOut or (not rows and not state.exists):
            state.remove()
            return
        last = dict(zip(*state.get)) if state.exists else {}
        out = []
        for key, of_key in rows.items():
            times = np.sort(np.fromiter(of_key, np.int64, len(of_key)))
            places, last[key] = kept_places(times, last.get(key), ttl)
            out += [of_key[at] for at in times[places].tolist()]
        if out:
            yield pd.DataFrame({"row": out})
        watermark = state.getCurrentWatermarkMs()
        closes = {key: (at + ttl) // 1000 + 1 for key, at in last.items()}
        last = {key: at for key, at in last.items() if closes[key] > watermark}
        if last:
            state.update((list(last), list(last.values())))
            state.setTimeoutTimestamp(max(closes[key] for key in last))
        elif state.exists:
            state.remove()

    return step


def unanswered(calls: DataFrame, ttl: str = "24 hours", lateness: str = "24 hours", state_groups: int = STATE_GROUPS) -> DataFrame:
    """The stream of calls that no kept call with the same key answers.

    Spark's keyed state holds one time per key and drops it, by an event-time timer or when its
    group is next read, once the newest call lies `ttl` and `lateness` behind it. Keys are hashed
    into `state_groups` groups, because a call of the state function costs milliseconds and a key
    microseconds; a batch reads and writes the groups of its own keys only. The number must stay
    the same for a checkpoint; on a large cluster take some hundred for each shuffle partition.

    A batch takes the times of a key in order, whatever the order of its rows, so the kept rows do
    not depend on how calls that arrive in time order are cut into batches. Of calls with the same
    key and time the one whose JSON is smallest stays. Calls without a time are all kept, and so
    are calls older than the last kept one of their key, however late they come: the clock is a
    column of its own that is null on the rows themselves, because Spark drops rows behind the
    watermark. The distinct times of a group's keys in one batch meet in one task; `per_trigger` of
    `open_stream` bounds a batch.
    """
    row, key = (F.to_json(F.struct(*c), ROW_OPTIONS) for c in (calls.columns, CALL_KEY))
    clock = F.explode(F.array(F.lit(None).cast("timestamp"), "created_at")).alias("_clock")
    group = F.pmod(F.xxhash64(*CALL_KEY), F.lit(state_groups)).alias("group")
    timed = calls.filter("created_at is not null").select(group, key.alias("key"), F.unix_micros("created_at").alias("at"), row.alias("row"), clock)
    # The rows that carry the clock end behind the watermark. The filter reads the clock, so it stays there.
    timed = timed.withWatermark("_clock", lateness).filter("_clock is null")
    kept = timed.groupBy("group").applyInPandasWithState(
        answered(micros(calls.sparkSession, ttl)), "row string", STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    rows = kept.select(F.from_json("row", calls.schema, ROW_OPTIONS).alias("r")).select("r.*")
    return rows.unionByName(calls.filter("created_at is null"))


def drop_cached(calls: DataFrame, path: str, checkpoint: str, ttl: str = "24 hours", lateness: str = "24 hours") -> None:
    """Process everything available; `unanswered` calls are appended under `path`, each batch once."""
    query = (
        unanswered(calls, ttl, lateness)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(f"{path}/out")
    )
    query.awaitTermination()


def kept_calls(spark: SparkSession, path: str, schema) -> DataFrame:
    """All calls that `drop_cached` kept under `path`."""
    return spark.read.schema(schema).parquet(f"{path}/out")


def stream_running(spark: SparkSession, results: DataFrame) -> DataFrame:
    """Drive `running_by_model` over a results stream and return the final totals."""
    path = shared_dir(spark, "stream-running")
    run_updates(running_by_model(results), f"{path}/out", f"{path}/state")
    return current_totals(spark, f"{path}/out")


def stream_cache_dedup(spark: SparkSession, calls: DataFrame, ttl: str = "24 hours") -> DataFrame:
    """Drive `drop_cached` over a stream of calls and return the kept ones."""
    path = shared_dir(spark, "stream-dedup")
    drop_cached(calls, path, f"{path}/checkpoint", ttl)
    return kept_calls(spark, path, calls.schema)
