"""Registered queries: files, samples, stores, caches, budgets, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rubricon import dims
from rubricon.operators import reports as R
from rubricon.operators import selection as S
from rubricon.operators import scoring
from rubricon.operators.positions import bucket_of, first_per_key
from rubricon.plans import fixtures as fx
from rubricon.plans import sql
from rubricon.plans.registry import query
from rubricon.plans.report_queries import cells
from rubricon.session import shared_dir, stored
from rubricon.sources import files, store
from rubricon.streaming import live

NOW = "2024-01-31 00:00:00"
BIG = "bigint"
STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"
SOURCE = "question-set"


# --- question sets on disk -------------------------------------------------------------


def _raw(rows: DataFrame) -> DataFrame:
    """Example rows as they lie on disk; null fields become missing keys."""
    return rows.select(
        "pos",
        F.col("example_id").alias("question_id"),
        "question",
        "context",
        "ground_truth",
        "python_solution",
        "level",
        F.when(F.col("pos") % 7 != 0, F.col("source")).alias("source"),
    )


def _write_splits(spark, sf_dir, *splits: str) -> str:
    root = shared_dir(spark, "splits")
    rows = _raw(fx.solutions(spark, sf_dir))
    for split in splits:
        rows.filter(F.col("level") == split).write.json(files.split_path(root, split))
    return root


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("example_id", "level", "source", "ground_truth", F.md5(F.concat("question", "context")).alias("text_md5"))


_SHOWN = "example_id, level, {source} AS source, ground_truth, md5(question || context) AS text_md5"
_SOURCE_SQL = f"CASE WHEN pos % 7 = 0 THEN '{SOURCE}' ELSE source END"


@query("scan_split", f"WITH {sql.EXAMPLES} SELECT {_SHOWN.format(source=_SOURCE_SQL)} FROM fx_examples WHERE level = 'medium'")
def scan_split(spark, sf_dir):
    root = _write_splits(spark, sf_dir, "medium")
    return _shown(files.load_split(spark, root, "medium", default_source=SOURCE))


@query("load_all_splits", f"WITH {sql.EXAMPLES} SELECT {_SHOWN.format(source=_SOURCE_SQL)} FROM fx_examples")
def load_all_splits(spark, sf_dir):
    root = _write_splits(spark, sf_dir, "easy", "medium", "hard")
    return _shown(files.load_dataset(spark, root, default_source=SOURCE))


@query(
    "load_hard",
    f"WITH {sql.EXAMPLES} SELECT {_SHOWN.format(source='''CASE WHEN pos % 7 = 0 THEN '' ELSE source END''')} FROM fx_examples WHERE level = 'hard' ORDER BY pos LIMIT 200",
)
def load_hard(spark, sf_dir):
    root = _write_splits(spark, sf_dir, "hard")
    return _shown(files.load_hard(spark, root, limit=200, level="hard"))


@query(
    "scan_limit",
    f"WITH {sql.EXAMPLES} SELECT {_SHOWN.format(source=_SOURCE_SQL)} FROM fx_examples WHERE level = 'easy' ORDER BY pos LIMIT 150",
)
def scan_limit(spark, sf_dir):
    root = _write_splits(spark, sf_dir, "easy")
    return _shown(S.head(files.load_split(spark, root, "easy", default_source=SOURCE), 150))


_HARD_SOURCE_SQL = "CASE WHEN pos % 7 = 0 THEN '' ELSE source END"
#: Elements of one array file; larger tables make more files, not larger ones.
ARRAY_WIDTH = 65_536


def _write_arrays(rows: DataFrame, path: str, head: str, tail: str, compression: str = "none") -> str:
    """Indented JSON arrays, a file per range of positions, with `head` and `tail` around the elements."""
    bucket = bucket_of("pos", ARRAY_WIDTH)
    order = Window.partitionBy("bucket").orderBy("pos")
    fields = F.struct(*[c for c in rows.columns if c != "pos"])
    made = rows.select("pos", bucket.alias("bucket"), F.to_json(fields, {"pretty": "true"}).alias("body"))
    made = made.withColumns({"first": F.lag("pos").over(order).isNull(), "last": F.lead("pos").over(order).isNull()})
    text = F.concat(F.when(F.col("first"), head).otherwise(","), F.lit("\n"), "body", F.when(F.col("last"), "\n" + tail).otherwise(""))
    made.select("bucket", "pos", text.alias("value")).sortWithinPartitions("bucket", "pos").select("bucket", "value").write.partitionBy("bucket").text(path, compression=compression)
    return path


@query("scan_array", f"WITH {sql.EXAMPLES} SELECT {_SHOWN.format(source=_HARD_SOURCE_SQL)} FROM fx_examples")
def scan_array(spark, sf_dir):
    root = shared_dir(spark, "arrays")
    rows = _raw(fx.solutions(spark, sf_dir)).withColumn("question_note", F.lit('a "}" of {[ \\'))
    _write_arrays(rows, files.split_path(root, "hard"), "[", "]")
    return _shown(files.load_hard(spark, root, layout="array"))


@query(
    "scan_items",
    f"""WITH {sql.EXAMPLES} SELECT example_id || '.trace' AS example_id, example_id AS question_id, CASE WHEN pos % 2 = 0 THEN level ELSE 'unknown' END AS level,
      'traced' AS source, question AS first_step FROM fx_examples WHERE pos % 3 = 0""",
)
def scan_items(spark, sf_dir):
    head, tail = '{"about": {"of": {"n": 1}}, "other": [{"trace_id": "x"}], "items": [', '], "more": [{"trace_id": "y"}]}'
    path = _write_arrays(_traced_rows(spark, sf_dir), shared_dir(spark, "items"), head, tail)
    rows = files.load_traced(spark, path, layout="array")
    first = F.get(F.col("reasoning_trace.steps"), F.lit(0))["description"]
    return rows.select("example_id", "question_id", "level", "source", first.alias("first_step"))


def _trace():
    step = F.struct(
        F.lit(1).alias("step_number"),
        F.lit("calculation").alias("step_type"),
        F.col("question").alias("description"),
        F.col("ground_truth").alias("code_snippet"),
    )
    return F.struct(F.lit(1).alias("total_steps"), F.array(step).alias("steps"))


def _traced_rows(spark, sf_dir) -> DataFrame:
    rows = fx.examples(spark, sf_dir).filter(F.col("pos") % 3 == 0)
    return rows.select(
        "pos", F.concat("example_id", F.lit(".trace")).alias("trace_id"), "question", "context", "ground_truth",
        F.when(F.col("pos") % 2 == 0, F.col("level")).alias("level"), _trace().alias("reasoning_trace"),
    )


def _write_traced(spark, sf_dir) -> str:
    path = shared_dir(spark, "traced")
    _traced_rows(spark, sf_dir).write.json(path)
    return path


@query(
    "load_traced",
    f"""WITH {sql.EXAMPLES} SELECT example_id || '.trace' AS example_id, example_id AS question_id, CASE WHEN pos % 2 = 0 THEN level ELSE 'unknown' END AS level,
      'traced' AS source, question AS first_step FROM fx_examples WHERE pos % 3 = 0 AND pos % 2 = 1 ORDER BY pos LIMIT 300""",
)
def load_traced(spark, sf_dir):
    rows = files.load_traced(spark, _write_traced(spark, sf_dir), limit=300, level="unknown")
    first = F.get(F.col("reasoning_trace.steps"), F.lit(0))["description"]
    return rows.select("example_id", "question_id", "level", "source", first.alias("first_step"))


@query(
    "load_transformed",
    f"WITH {sql.EXAMPLES} SELECT {_SHOWN.format(source='''CASE WHEN TRUE THEN 'hard_transformed' END''')} FROM fx_examples WHERE level = 'hard' ORDER BY pos LIMIT 100",
)
def load_transformed(spark, sf_dir):
    root = _write_splits(spark, sf_dir, "hard")
    return _shown(files.load_transformed(spark, files.split_path(root, "hard"), limit=100))


@query(
    "load_combined",
    f"""WITH {sql.EXAMPLES} SELECT example_id, level, CASE WHEN pos % 7 = 0 THEN '' ELSE source END AS source FROM fx_examples WHERE level = 'hard'
      UNION ALL SELECT * FROM (SELECT example_id || '.trace', level, 'traced' FROM fx_examples WHERE pos % 3 = 0 AND pos % 2 = 0 AND level = 'easy' ORDER BY pos LIMIT 250)""",
)
def load_combined(spark, sf_dir):
    root, traced = _write_splits(spark, sf_dir, "hard"), _write_traced(spark, sf_dir)
    rows = files.load_combined(spark, root, traced, traced_limit=250, traced_level="easy")
    return rows.select("example_id", "level", "source")


@query(
    "merge_trace",
    f"""WITH {sql.EXAMPLES} SELECT example_id, CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END AS total_steps, CASE WHEN pos % 3 = 0 THEN question ELSE '' END AS first_step FROM fx_examples""",
)
def merge_trace(spark, sf_dir):
    examples = fx.examples(spark, sf_dir).withColumn("question_id", F.col("example_id"))
    traces = files.load_traced(spark, _write_traced(spark, sf_dir))
    merged = S.merge_trace(examples, traces)
    first = F.get(F.col("reasoning_trace.steps"), F.lit(0))["description"]
    return merged.select(
        "example_id",
        F.coalesce("reasoning_trace.total_steps", F.lit(0)).cast(BIG).alias("total_steps"),
        F.coalesce(first, F.lit("")).alias("first_step"),
    )


@query(
    "scan_functions",
    """SELECT doc_id AS pos, doc_id::VARCHAR AS function_id, CASE WHEN doc_id % 10 = 4 THEN '' ELSE source END AS article_title,
      md5('def calc_' || source || text) AS text_md5 FROM documents WHERE doc_id % 10 <> 3""",
)
def scan_functions(spark, sf_dir):
    """The library from disk, with every tenth line broken and some titles missing."""
    path, f = shared_dir(spark, "functions"), fx.functions(spark, sf_dir)
    record = F.struct(
        "pos", F.col("function_id").cast("string").alias("function_id"),
        F.when(F.col("pos") % 10 != 4, F.col("article_title")).alias("article_title"), "function", "function_docstring",
    )
    line = F.when(F.col("pos") % 10 == 3, "{broken").otherwise(F.to_json(record))
    f.select(line.alias("value")).write.text(path)
    rows = files.load_functions(spark, path)
    return rows.select("pos", "function_id", "article_title", F.md5(F.concat("function", "function_docstring")).alias("text_md5"))


@query(
    "json_roundtrip",
    f"WITH {sql.EXAMPLES} SELECT example_id, level, ground_truth, question, context FROM fx_examples",
)
def json_roundtrip(spark, sf_dir):
    rows = fx.examples(spark, sf_dir).select("example_id", "level", "ground_truth", "question", "context")
    return files.from_json_rows(files.to_json_rows(rows), rows.schema.simpleString())


# --- duplicates and samples ------------------------------------------------------------


def _collided(spark, sf_dir) -> DataFrame:
    """Examples whose ids collide, some of them blank."""
    blank = F.col("pos") % 50 == 0
    shared = F.concat(F.lit("q-"), (F.col("pos") % 997).cast("string"))
    return fx.examples(spark, sf_dir).withColumn("example_id", F.when(blank, "").otherwise(shared))


_COLLIDED_SQL = "collided AS (SELECT * REPLACE (CASE WHEN pos % 50 = 0 THEN '' ELSE 'q-' || (pos % 997) END AS example_id) FROM fx_examples)"
_RANK_SQL = "CASE level WHEN 'easy' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"


def _split_rank():
    return F.when(F.col("level") == "easy", 0).when(F.col("level") == "medium", 1).otherwise(2)


@query(
    "last_wins_by_id",
    f"""WITH {sql.EXAMPLES}, {_COLLIDED_SQL} SELECT example_id, level, pos FROM collided WHERE example_id <> ''
      QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY {_RANK_SQL} DESC, pos DESC) = 1""",
)
def last_wins_by_id(spark, sf_dir):
    return S.last_by_id(_collided(spark, sf_dir), _split_rank()).select("example_id", "level", "pos")


@query(
    "dedup_first",
    f"""WITH {sql.EXAMPLES}, {_COLLIDED_SQL} SELECT example_id, level, pos FROM collided
      QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY {_RANK_SQL}, pos) = 1""",
)
def dedup_first(spark, sf_dir):
    return first_per_key(_collided(spark, sf_dir), ["example_id"], _split_rank(), F.col("pos")).select("example_id", "level", "pos")


@query(
    "stride_sample",
    f"""WITH {sql.EXAMPLES}, n AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY pos) - 1 AS at, count(*) OVER (PARTITION BY level) AS total FROM fx_examples),
      picks AS (SELECT level, total, i, CASE WHEN total <= 30 THEN i ELSE CAST(floor(i * (total / 30.0::DOUBLE)) AS BIGINT) END AS at
        FROM (SELECT DISTINCT level, total FROM n) t, range(30) AS r(i) WHERE i < total)
      SELECT n.level, example_id, i + 1 AS selection_index FROM n JOIN picks p ON n.level = p.level AND n.at = p.at""",
)
def stride_sample(spark, sf_dir):
    picked = S.stride_sample(fx.examples(spark, sf_dir), 30)
    return picked.select("level", "example_id", "selection_index")


# --- budgets and progress --------------------------------------------------------------


@query(
    "budget_guard",
    f"""WITH {sql.LOG}, t AS (SELECT pos, example_id, cost_cents, sum(cost_cents) OVER w AS total_cost, sum(1 + pos % 90) OVER w AS total_tokens, 1 + pos % 90 AS tokens
        FROM fx_log WINDOW w AS (PARTITION BY example_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
      SELECT pos, example_id, CAST(total_cost AS BIGINT) AS total_cost, CAST(total_tokens AS BIGINT) AS total_tokens,
        total_cost > 60000 OR total_tokens > 1500 AS over_budget FROM t
      WHERE NOT (total_cost - cost_cents > 60000 OR total_tokens - tokens > 1500)""",
)
def budget_guard(spark, sf_dir):
    calls = fx.log(spark, sf_dir).select("pos", "example_id", "cost_cents").withColumn("tokens", 1 + F.col("pos") % 90)
    kept = S.budget_guard(calls, ["example_id"], "pos", "cost_cents", "tokens", max_cost=60000, max_tokens=1500)
    return kept.select("pos", "example_id", "total_cost", "total_tokens", "over_budget")


@query(
    "progress",
    f"""WITH {sql.LOG}, t AS (SELECT row_number() OVER (ORDER BY pos) AS row_no, count(*) OVER () AS group_rows,
        sum(cost_cents) OVER (ORDER BY pos ROWS UNBOUNDED PRECEDING) AS total_cost FROM fx_log)
      SELECT row_no, group_rows, CAST(total_cost AS BIGINT) AS total_cost FROM t WHERE row_no % 5 = 0""",
)
def progress(spark, sf_dir):
    calls = fx.log(spark, sf_dir).select("pos", "cost_cents")
    return S.progress(calls, "pos", "cost_cents").select("row_no", "group_rows", "total_cost")


# --- cached responses ------------------------------------------------------------------


@query("prompt_hash", f"WITH {sql.LOG} SELECT pos, prompt_hash FROM fx_log")
def prompt_hash(spark, sf_dir):
    return store.with_prompt_hash(fx.log(spark, sf_dir).select("pos", "prompt")).select("pos", "prompt_hash")


@query(
    "cache_lookup",
    f"""WITH {sql.LOG} SELECT example_id, model, prompt_hash, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created, cost_cents FROM fx_log
      WHERE created_at > TIMESTAMP '{NOW}' - INTERVAL 240 HOUR
      QUALIFY row_number() OVER (PARTITION BY example_id, model, prompt_hash ORDER BY created_at DESC, pos DESC) = 1""",
)
def cache_lookup(spark, sf_dir):
    hits = store.cache_lookup(fx.log(spark, sf_dir).drop("prompt"), NOW, 240)
    return hits.select(*store.CALL_KEY, F.date_format("created_at", STAMP).alias("created"), "cost_cents")


@query(
    "cached_calls",
    f"""WITH {sql.LOG}, hits AS (SELECT example_id, model, prompt_hash, created_at, cost_cents FROM fx_log WHERE created_at > TIMESTAMP '{NOW}' - INTERVAL 240 HOUR
        QUALIFY row_number() OVER (PARTITION BY example_id, model, prompt_hash ORDER BY created_at DESC, pos DESC) = 1),
      asked AS (SELECT pos AS call_id, example_id, CASE WHEN pos % 4 = 0 THEN 'other' ELSE model END AS model, prompt_hash FROM fx_log WHERE pos % 3 = 0)
      SELECT call_id, asked.example_id, asked.model, coalesce(strftime(created_at, '%Y-%m-%d %H:%M:%S.%f'), '') AS created, coalesce(cost_cents, -1) AS cost_cents
      FROM asked LEFT JOIN hits ON asked.example_id = hits.example_id AND asked.model = hits.model AND asked.prompt_hash = hits.prompt_hash""",
)
def cached_calls(spark, sf_dir):
    """New calls against a cache that is clustered by call."""
    log = fx.log(spark, sf_dir)
    path = shared_dir(spark, "cache")
    name = "cache_" + path.rsplit("-", 1)[1]
    store.write_cache(log.drop("prompt"), path, name, 16)
    model = F.when(F.col("pos") % 4 == 0, "other").otherwise(F.col("model"))
    asked = log.filter(F.col("pos") % 3 == 0).select(F.col("pos").alias("call_id"), "example_id", model.alias("model"), "prompt_hash")
    found = store.cached_calls(asked, spark.table(name), NOW, 240)
    created = F.coalesce(F.date_format("created_at", STAMP), F.lit(""))
    return found.select("call_id", "example_id", "model", created.alias("created"), F.coalesce("cost_cents", F.lit(-1)).alias("cost_cents"))


@query("cache_purge", f"WITH {sql.LOG} SELECT pos, example_id, model FROM fx_log WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR")
def cache_purge(spark, sf_dir):
    return store.cache_purge(fx.log(spark, sf_dir), NOW, 24).select("pos", "example_id", "model")


# --- result tables ---------------------------------------------------------------------


def _evaluation():
    return F.concat(F.lit("eval_"), F.date_format("created_at", "yyyyMMdd"))


_EVALUATION_SQL = "'eval_' || strftime(created_at, '%Y%m%d')"


def _headers(spark, sf_dir) -> DataFrame:
    runs = fx.log(spark, sf_dir).select("created_at", "example_id", F.col("model").alias("model_name"))
    return store.run_header(runs, _evaluation(), F.col("created_at"), "v1", F.col("example_id").cast(BIG))


_HEADER_SQL = f"""{sql.LOG}, headers AS (SELECT {_EVALUATION_SQL} AS eval_id, min(created_at) AS created_at, 'v1' AS dataset_version,
  count(DISTINCT example_id) AS num_examples, count(DISTINCT model) AS num_models, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM fx_log GROUP BY 1)"""
_HEADER_COLUMNS = "eval_id, strftime(created_at, '%Y-%m-%d %H:%M:%S.%f') AS created, dataset_version, num_examples, num_models, models"


def _header_columns(rows: DataFrame) -> DataFrame:
    created = F.date_format("created_at", STAMP).alias("created")
    return rows.select("eval_id", created, "dataset_version", "num_examples", "num_models", "models")


@query("run_header", f"WITH {_HEADER_SQL} SELECT {_HEADER_COLUMNS} FROM headers")
def run_header(spark, sf_dir):
    path = shared_dir(spark, "headers")
    store.append(_headers(spark, sf_dir), path)
    return _header_columns(spark.read.parquet(path))


@query("recent_runs", f"WITH {_HEADER_SQL} SELECT {_HEADER_COLUMNS} FROM headers ORDER BY headers.created_at DESC LIMIT 10")
def recent_runs(spark, sf_dir):
    return _header_columns(store.recent_runs(_headers(spark, sf_dir), 10))


def _results(spark, sf_dir) -> DataFrame:
    return fx.log(spark, sf_dir).select(
        _evaluation().alias("eval_id"), F.col("model").alias("model_id"), "example_id", "created_at", "pos", "cost_cents"
    )


@query(
    "get_evaluation",
    f"""WITH {_HEADER_SQL}, latest AS (SELECT {_EVALUATION_SQL} AS eval_id, model AS model_id, arg_max(example_id, (created_at, pos)) AS example_id,
        arg_max(cost_cents, (created_at, pos)) AS cost_cents FROM fx_log GROUP BY 1, 2)
      SELECT eval_id, num_examples, num_models, model_id, example_id, cost_cents FROM headers JOIN latest USING (eval_id)""",
)
def get_evaluation(spark, sf_dir):
    latest = store.latest_per_model(_results(spark, sf_dir)).drop("created_at")
    found = store.get_evaluation(_headers(spark, sf_dir), latest)
    return found.select("eval_id", "num_examples", "num_models", "model_id", "example_id", "cost_cents")


@query(
    "save_results",
    f"""WITH {sql.LOG} SELECT {_EVALUATION_SQL} AS eval_id, model AS model_id, count(*) AS rows_kept, CAST(sum(cost_cents) AS BIGINT) AS cost_cents
      FROM fx_log GROUP BY 1, 2""",
)
def save_results(spark, sf_dir):
    path = shared_dir(spark, "results")
    store.append(_results(spark, sf_dir), path, "eval_id")
    kept = spark.read.schema(_results(spark, sf_dir).schema).parquet(path)
    return kept.groupBy("eval_id", "model_id").agg(
        F.count(F.lit(1)).alias("rows_kept"), F.sum("cost_cents").alias("cost_cents")
    )


def _artifacts(spark, sf_dir) -> DataFrame:
    """Nested artifacts written per experiment (the level), indented, with a summary beside them, read back."""
    path = shared_dir(spark, "artifacts")
    runs = scoring.with_cost(fx.calls(spark, sf_dir, fx.MODEL_NAMES))
    rows = store.example_results(runs, "level").withColumn("pos", F.substring("example_id", 6, 20).cast(BIG))
    rows = stored(rows, "nested")
    for level in dims.LEVELS:
        found = rows.filter(F.col("experiment") == level).drop("experiment")
        _write_arrays(found, f"{path}/experiment={level}", "[", "]", "gzip")
    return store.read_artifacts(spark, path)


_ARTIFACT_SQL = f"""WITH {sql.runs(fx.MODEL_NAMES)}, {sql.MODELS}, per_example AS (
  SELECT level AS experiment, example_id, count(*) AS results, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens,
    CAST(sum((prompt_tokens * milli_in + completion_tokens * milli_out + 500) // 1000) AS BIGINT) AS cost_micros
  FROM fx_runs LEFT JOIN fx_models USING (model_name) GROUP BY 1, 2)"""


@query("example_artifacts", f"{_ARTIFACT_SQL} SELECT * FROM per_example")
def example_artifacts(spark, sf_dir):
    return store.artifact_totals(_artifacts(spark, sf_dir))


@query(
    "experiment_summary",
    f"""{_ARTIFACT_SQL} SELECT experiment, count(*) AS total_examples, CAST(sum(total_tokens) AS BIGINT) AS total_tokens,
      CAST(sum(cost_micros) AS BIGINT) / 1000000.0 AS total_cost_usd FROM per_example GROUP BY 1""",
)
def experiment_summary(spark, sf_dir):
    return store.experiment_summary(_artifacts(spark, sf_dir))


@query(
    "report_nested",
    f"""WITH {sql.scored()} SELECT (SELECT count(*) FROM scored) AS total, (SELECT count(*) FILTER (is_correct) FROM scored) AS correct,
      (SELECT string_agg(model_name || '=' || n, ',' ORDER BY model_name) FROM (SELECT model_name, count(*) FILTER (is_correct) AS n FROM scored GROUP BY 1)) AS models,
      (SELECT string_agg(error_category || '=' || n, ',' ORDER BY error_category) FROM (SELECT error_category, count(*) AS n FROM scored WHERE NOT is_correct GROUP BY 1)) AS errors""",
)
def report_nested(spark, sf_dir):
    """The sections written as JSON tables, read back, and nested into one report row."""
    path = shared_dir(spark, "report")
    found = stored(cells(spark, sf_dir), "cells")  # several sections read it
    sections = {
        "summary": R.overall(found),
        "by_model": R.by_model(found).select("model_name", "total", "correct"),
        "errors": R.error_distribution(found),
    }
    store.write_report(sections, path)
    back = {name: spark.read.schema(t.schema).json(f"{path}/{name}") for name, t in sections.items()}
    nested = store.nested_report(back["summary"], back["by_model"], back["errors"])

    def listed(items, key, value):
        return F.array_join(F.transform(items, lambda e: F.concat(e[key], F.lit("="), e[value].cast("string"))), ",")

    return nested.select(
        "summary.total",
        "summary.correct",
        listed("by_model", "model_name", "correct").alias("models"),
        listed("error_distribution", "error_category", "errors").alias("errors"),
    )


# --- streams ---------------------------------------------------------------------------


@query(
    "stream_running",
    f"""WITH {sql.LOG} SELECT model AS model_name, count(*) AS total, count(*) FILTER (pos % 3 > 0) AS correct,
      CAST(sum(cost_cents) * 10000 AS BIGINT) AS cost_micros FROM fx_log GROUP BY 1""",
)
def stream_running(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = live.open_stream(spark, sf_dir, schema, "events.parquet")
    results = events.select(
        F.col("event_type").alias("model_name"),
        (F.col("event_id") % 3 > 0).alias("is_correct"),
        (F.round(F.col("value") * 100).cast(BIG) * 10000).alias("cost_micros"),
    )
    return live.stream_running(spark, results)


@query(
    "stream_cache_dedup",
    f"""WITH {sql.LOG}, timed AS (
      SELECT example_id, model, prompt_hash, list_sort(list(DISTINCT created_at)) AS times FROM fx_log GROUP BY 1, 2, 3)
    SELECT example_id, model, prompt_hash, unnest(list_reduce(list_transform(times, lambda t: [t]),
      lambda kept, t: CASE WHEN t[1] >= kept[len(kept)] + INTERVAL 24 HOUR THEN list_concat(kept, t) ELSE kept END)) AS created_at
    FROM timed""",
)
def stream_cache_dedup(spark, sf_dir):
    """Calls arrive in four deliveries in time order; the stream stops and goes on after each."""
    path = shared_dir(spark, "stream-dedup")
    log = fx.log(spark, sf_dir).select("created_at", *store.CALL_KEY)
    first, last = log.agg(F.min("created_at"), F.max("created_at")).first()
    since = F.unix_micros("created_at") - F.unix_micros(F.lit(first))
    delivery = F.coalesce(F.floor(since * 4 / (F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)) + 1)), F.lit(0))
    for n in range(4):
        log.filter(delivery == n).write.mode("append").parquet(f"{path}/in")
        live.drop_cached(live.open_stream(spark, f"{path}/in", log.schema), path, f"{path}/checkpoint")
    return live.kept_calls(spark, path, log.schema)
