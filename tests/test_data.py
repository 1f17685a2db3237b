"""Samples, running totals, files, stores and streams."""

import json
import random
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubricon import dims
from rubricon.operators import grid, positions, prompts, reports, scoring, selection
from rubricon.operators.errors import merge_analysis
from rubricon.operators.positions import running_totals
from rubricon.plans import fixtures as fx
from rubricon.sources import files, store
from rubricon.streaming import live


@pytest.mark.parametrize(("n", "total"), [(3, 10), (10, 10), (11, 10), (7, 1000), (1, 5), (3, 0), (0, 5), (50, 64)])
def test_stride_sample(spark, n, total):
    rows = spark.range(total).select(F.col("id").alias("pos"), F.lit("easy").alias("level"))
    got = [(r["pos"], r["selection_index"]) for r in selection.stride_sample(rows, n, width=16).orderBy("selection_index").collect()]
    picks = list(range(total)) if n >= total else [int(i * (total / n)) for i in range(n)]
    assert got == [(p, i + 1) for i, p in enumerate(picks)]


def test_running_totals_cross_buckets_and_null_groups(spark):
    rows = spark.range(500).select((F.col("id") * 3).alias("pos"), F.when(F.col("id") % 5 > 0, "hot").alias("g"), F.col("id").alias("v"))
    got = running_totals(rows, ["g"], "pos", {"total": "v"}, width=64).collect()
    for key in ("hot", None):
        mine, seen = sorted((r["pos"], r) for r in got if r["g"] == key), 0
        for i, (_, r) in enumerate(mine, 1):
            seen += r["v"]
            assert (r["row_no"], r["total"], r["group_rows"]) == (i, seen, len(mine))


@pytest.mark.parametrize(("group", "width", "fanout"), [([], 16, 4), ([], 4, 2), (["g"], 16, 4), (["g"], 1000, 4), (["g", "h"], 8, 3)])
def test_running_totals_up_a_tree(spark, monkeypatch, group, width, fanout):
    monkeypatch.setattr(positions, "FANOUT", fanout)
    i = F.col("id")
    rows = spark.range(900).select((i * 3).alias("pos"), F.when(i % 7 > 0, i % 3).alias("g"), F.when(i > 890, "rare").alias("h"), (i % 11).alias("v"))
    got = running_totals(rows, group, "pos", {"total": "v"}, width).collect()
    assert len(got) == 900
    seen, sizes = {}, {}
    for r in got:
        key = tuple(r[c] for c in group)
        sizes[key] = sizes.get(key, 0) + 1
    for r in sorted(got, key=lambda r: r["pos"]):
        key = tuple(r[c] for c in group)
        n, total = seen.get(key, (0, 0))
        seen[key] = n + 1, total + r["v"]
        assert (r["row_no"], r["total"], r["group_rows"]) == (*seen[key], sizes[key])


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_of_running_totals(spark):
    rows = spark.range(5000).select(F.col("id").alias("pos"), (F.col("id") % 50).alias("g"), F.col("id").alias("v"))
    assert "SinglePartition" not in plan_of(selection.progress(rows.select("pos", "v"), "pos", "v"))
    assert plan_of(running_totals(rows, ["g"], "pos", {"t": "v"})).count("Exchange hashpartitioning") == 1


def budget(spark, costs, **limits):
    rows = [(i, "a", c, 1) for i, c in enumerate(costs)]
    df = spark.createDataFrame(rows, "pos BIGINT, example_id STRING, cost BIGINT, tokens BIGINT")
    out = selection.budget_guard(df, ["example_id"], "pos", "cost", "tokens", **limits)
    return [(r["pos"], r["over_budget"]) for r in out.orderBy("pos").collect()]


def test_budget_guard(spark):
    assert budget(spark, [5, 5, 5], max_cost=10) == [(0, False), (1, False), (2, True)]
    assert budget(spark, [5, 6, 5], max_cost=10) == [(0, False), (1, True)]
    assert budget(spark, [5, 6, 5], max_cost=10, stop=False) == [(0, False), (1, True), (2, True)]
    assert budget(spark, [5, 6, 5], max_tokens=1) == [(0, False), (1, True)]
    assert len(budget(spark, [5, 6, 5])) == 3


# --- files -----------------------------------------------------------------------------

RECORDS = [
    {"question_id": "a", "question": "q1", "context": "[]", "ground_truth": 5, "level": "hard", "python_solution": "x = 1"},
    {"question_id": "b", "question": "q2", "ground_truth": "yes", "level": "medium", "inventory": {"n": 1}},
    "not an object",
    {"question_id": "c", "ground_truth": None, "source": "other", "difficulty": 2.5},
]


@pytest.fixture()
def root(tmp_path):
    (tmp_path / "hard.json").write_text(json.dumps(RECORDS))
    (tmp_path / "easy.json").write_text(json.dumps(RECORDS[0]))
    traced = {"items": [{"trace_id": "a.trace", "question": "q", "level": "hard", "reasoning_trace": {"total_steps": 1, "steps": [{"step_number": 1, "step_type": "calculation"}]}}, {"trace_id": "z.trace"}]}
    (tmp_path / "traced.json").write_text(json.dumps(traced))
    return str(tmp_path)


@pytest.mark.parametrize("indent", [None, 2])
def test_arrays_of_several_files(spark, tmp_path, indent):
    for name, ids in (("b", "cd"), ("a", "ab")):
        (tmp_path / f"{name}.json").write_text(json.dumps([{"question_id": i} for i in ids], indent=indent))
    rows = files.read_records(spark, str(tmp_path), "question_id STRING", layout="array")
    assert rows.count() == 4
    assert [r["question_id"] for r in rows.orderBy("pos").collect()] == ["a", "b", "c", "d"]
    assert rows.select("pos").distinct().count() == 4


def test_broken_files_and_wrong_layout_raise(spark, tmp_path):
    (tmp_path / "cut.json").write_text(json.dumps([{"question_id": "a"}] * 3, indent=2)[:-9])
    (tmp_path / "list.json").write_text(json.dumps([{"question_id": "a"}], indent=2))
    for name, layout in (("cut", "array"), ("list", "lines")):
        with pytest.raises(Exception, match="no JSON"):
            files.read_records(spark, str(tmp_path / f"{name}.json"), "question_id STRING", layout=layout).collect()


def test_lines_keep_file_order(spark, tmp_path):
    (tmp_path / "part-0.json").write_text('{"question_id": "0"}\n\n{"question_id": "1"}\n')
    (tmp_path / "part-1.json").write_text("".join(f'{{"question_id": "{i}"}}\n' for i in range(2, 500)))
    rows = files.read_records(spark, str(tmp_path), "question_id STRING")
    assert rows.count() == 500
    assert [r["question_id"] for r in rows.orderBy("pos").collect()] == [str(i) for i in range(500)]


def test_indented_items_and_long_arrays(spark, tmp_path):
    items = {"items": [{"trace_id": f"{i}.trace", "question": "q"} for i in range(3)]}
    (tmp_path / "traced.json").write_text("\n " + json.dumps(items, indent=4))
    assert files.load_traced(spark, str(tmp_path / "traced.json"), layout="array").count() == 3
    (tmp_path / "long.json").write_text(json.dumps([{"question_id": str(i), "question": "x" * 1000} for i in range(20_000)]))
    assert files.read_records(spark, str(tmp_path / "long.json"), "question_id STRING", layout="array").count() == 20_000


def test_array_layout(spark, root):
    rows = files.load_split(spark, root, "hard", layout="array", default_source="set").orderBy("pos").collect()
    assert [r["example_id"] for r in rows] == ["a", "b", "c"]
    assert [r["ground_truth"] for r in rows] == ["5", "yes", None]
    assert {r["level"] for r in rows} == {"hard"}
    assert [r["source"] for r in rows] == ["set", "set", "other"]
    assert (rows[1]["inventory"], rows[2]["difficulty"], rows[2]["question"]) == ('{"n":1}', 2.5, "")
    everything = files.load_dataset(spark, root, layout="array")
    assert everything.count() == 4  # three hard rows, one object as a list, no medium file
    with pytest.raises(ValueError, match="Invalid split"):
        files.load_dataset(spark, root, "extreme")
    with pytest.raises(ValueError, match="Invalid layout"):
        files.load_dataset(spark, root, layout="columns")


def test_level_filters_and_limits(spark, root):
    assert [r["example_id"] for r in files.load_hard(spark, root, level="medium", layout="array").collect()] == ["b"]
    assert [r["level"] for r in files.load_hard(spark, root, limit=2, layout="array").collect()] == ["hard", "medium"]
    traced = files.load_traced(spark, f"{root}/traced.json", layout="array").orderBy("pos").collect()
    assert [(r["example_id"], r["question_id"], r["level"]) for r in traced] == [("a.trace", "a", "hard"), ("z.trace", "z", "unknown")]
    assert traced[0]["reasoning_trace"]["steps"][0]["step_type"] == "calculation"
    combined = files.load_combined(spark, root, f"{root}/traced.json", traced_limit=1, layout="array")
    assert sorted(r["example_id"] for r in combined.collect()) == ["a", "a.trace", "b", "c"]
    assert files.load_combined(spark, root, f"{root}/traced.json", layout="array").count() == 3


# --- stores and streams ----------------------------------------------------------------


def test_cache_limits_are_strict(spark):
    rows = [(0, "e", "m", "p", "2024-01-30 00:00:00"), (1, "e", "m", "p", "2024-01-30 00:00:01"), (2, "e", "m", "q", "2024-01-29 23:59:59")]
    cache = spark.createDataFrame(rows, "pos BIGINT, example_id STRING, model STRING, prompt STRING, created_at STRING")
    cache = store.with_prompt_hash(cache.withColumn("created_at", F.to_timestamp("created_at")))
    assert [r["pos"] for r in store.cache_lookup(cache, "2024-01-31 00:00:00").collect()] == [1]
    assert sorted(r["pos"] for r in store.cache_purge(cache, "2024-01-31 00:00:00").collect()) == [0, 1]
    calls = cache.select("example_id", "model", "prompt_hash").distinct()
    found = store.cached_calls(calls, cache.drop("prompt"), "2024-01-31 00:00:00").collect()
    assert sum(r["created_at"] is not None for r in found) == 1


def test_artifacts_skip_summary(spark, tmp_path):
    for name in ("a", "summary"):
        (tmp_path / f"{name}.json").write_text(json.dumps({"experiment": "x", "example_id": name, "total_tokens": 3, "cost_micros": 5}))
    schema = "experiment STRING, example_id STRING, total_tokens BIGINT, cost_micros BIGINT"
    rows = store.read_artifacts(spark, str(tmp_path), schema)
    assert [tuple(r) for r in store.experiment_summary(rows).collect()] == [("x", 1, 3, 5 / 1e6)]


def _split_stream(spark, sf_dir, path, parts):
    events = fx.log(spark, sf_dir).orderBy("created_at").toPandas()
    size = -(-len(events) // parts)
    for i in range(parts):
        spark.createDataFrame(events.iloc[i * size : (i + 1) * size]).coalesce(1).write.mode("append").parquet(path)


def test_running_stream_equals_batch(spark, sf_dir, tmp_path):
    path = f"{tmp_path}/in"
    _split_stream(spark, sf_dir, path, 4)
    schema = spark.read.parquet(path).schema

    def shaped(df):
        return df.select(F.col("model").alias("model_name"), (F.col("pos") % 3 > 0).alias("is_correct"), F.col("cost_cents").alias("cost_micros"))

    streamed = live.stream_running(spark, shaped(live.open_stream(spark, path, schema, per_trigger=1)))
    batch = live.running_by_model(shaped(spark.read.parquet(path)))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_stream_dedup_within_ttl(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a"), ("2024-01-01 05:00:00", "a"), ("2024-01-01 06:00:00", "b")]
    df = spark.createDataFrame(rows, "t STRING, example_id STRING").select(
        F.to_timestamp("t").alias("created_at"), "example_id", F.lit("m").alias("model"), F.lit("h").alias("prompt_hash")
    )
    path = f"{tmp_path}/in"
    df.coalesce(1).write.parquet(path)
    out = live.stream_cache_dedup(spark, live.open_stream(spark, path, df.schema))
    assert sorted(r["example_id"] for r in out.collect()) == ["a", "b"]


def _kept_hours(spark, path, hours, cuts):
    """Hours that stay, when calls of one key (and a null one) arrive in the given batches."""
    schema = "created_at TIMESTAMP, example_id STRING, model STRING, prompt_hash STRING"
    start = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    bounds = [0, *cuts, len(hours)]
    for lo, hi in zip(bounds, bounds[1:]):
        rows = [(h, key) for h in hours[lo:hi] for key in ("a", None)]
        df = spark.createDataFrame(rows, "h INT, example_id STRING")
        at = F.when(F.col("h").isNotNull(), start + F.make_dt_interval(F.lit(0), F.col("h")))
        df.select(at.alias("created_at"), "example_id", F.lit("m").alias("model"), F.lit("h").alias("prompt_hash")).write.mode("append").parquet(f"{path}/in")
        live.drop_cached(live.open_stream(spark, f"{path}/in", schema), path, f"{path}/checkpoint")
    out = live.kept_calls(spark, path, schema).withColumn("h", (F.unix_timestamp("created_at") - F.unix_timestamp(start)) / 3600)
    found = {key: sorted((r["h"] for r in out.filter(F.col("example_id").eqNullSafe(key)).collect()), key=lambda h: (h is None, h)) for key in ("a", None)}
    assert found["a"] == found[None]
    return found["a"]


@pytest.mark.parametrize("cuts", [[], [3], [1, 2, 5]])
def test_stream_dedup_is_the_same_for_any_cut(spark, tmp_path, cuts):
    """A time passes 24 hours after the last kept one, not after the last seen one."""
    assert _kept_hours(spark, str(tmp_path), [0, 0, 10, 23, 24, 40, 49, 80], cuts) == [0, 24, 49, 80]


def test_stream_dedup_keeps_late_and_timeless_calls(spark, tmp_path):
    assert _kept_hours(spark, str(tmp_path), [50, 20, None, 60, None], [1, 3]) == [20, 50, None, None]


def test_stream_dedup_keeps_calls_behind_the_watermark(spark, tmp_path):
    """Hour 2 comes 498 hours late and is kept; the state of the key outlives no timer, and a new
    call after its end is kept as well."""
    assert _kept_hours(spark, str(tmp_path), [0, 10, 500, 2, 510, 900, 905], [2, 3, 5]) == [0, 2, 500, 900]


def test_stream_dedup_returns_rows_as_they_were(spark, tmp_path):
    """Every type survives the state operator, and of equal times the smallest row stays."""
    schema = (
        "created_at TIMESTAMP, example_id STRING, model STRING, prompt_hash STRING, big BIGINT, real DOUBLE, money DECIMAL(20,4), "
        "at TIMESTAMP, flags ARRAY<BOOLEAN>, raw BINARY, note STRING"
    )
    start = datetime(2024, 1, 1, 0, 0, 0, 123456)
    row = (start, "a", "m", "h", 2**60 + 1, 0.1, Decimal("1.2345"), start, [True, None], bytearray(b"\x00\xff"), 'quote " and\nline')
    bare = (start, None, "m", "h", *[None] * 7)
    again = (start + timedelta(hours=1), *row[1:])
    spark.createDataFrame([row, row, bare, again], schema).write.parquet(f"{tmp_path}/in")
    out = live.stream_cache_dedup(spark, live.open_stream(spark, f"{tmp_path}/in", schema)).collect()
    assert sorted(map(tuple, out), key=lambda r: r[1] is None) == [row, bare]


def test_kept_places_follow_the_rule(spark):
    """Against the rule one time after the other."""
    rng = random.Random(5)
    for _ in range(300):
        times = sorted(rng.sample(range(60), rng.randint(1, 25)))
        last = rng.choice([None, rng.randint(-20, 50)])
        kept, newest = [], last
        for place, t in enumerate(times):
            if newest is None or not newest <= t < newest + 7:
                kept.append(place)
                newest = t if newest is None else max(newest, t)
        assert live.kept_places(np.array(times), last, 7) == (kept, newest)


# --- reports, grid, prompts ------------------------------------------------------------


def test_published_counts(spark):
    """59 of 90 answers right, 31 errors in five categories, three models."""
    right = {"gemini-2.5-flash": 24, "gpt-4o-mini": 23, "claude-haiku-4": 12}
    errors = ["execution_error"] * 19 + ["extraction_error"] * 4 + ["numerical_calculation_error"] * 4 + ["formula_error"] * 3 + ["logic_error"]
    rows, wrong = [], iter(errors)
    for model, n in right.items():
        for i in range(30):
            ok = i < n
            rows.append((f"e{i}", model, "POT", ["easy", "medium", "hard"][i % 3], "general", ok, None if ok else next(wrong), 100))
    schema = "example_id STRING, model_name STRING, method STRING, level STRING, model_type STRING, is_correct BOOLEAN, error_category STRING, cost_micros BIGINT"
    cells = reports.summary_cells(spark.createDataFrame(rows, schema))
    assert tuple(reports.overall(cells).first())[:3] == (90, 59, 31)
    board = [(r["model_name"], r["correct"], round(r["accuracy"], 1)) for r in reports.leaderboard(cells).collect()]
    assert board == [("gemini-2.5-flash", 24, 80.0), ("gpt-4o-mini", 23, 76.7), ("claude-haiku-4", 12, 40.0)]
    counted = {r["error_category"]: r["errors"] for r in reports.error_distribution(cells).collect()}
    assert counted == {"execution_error": 19, "extraction_error": 4, "numerical_calculation_error": 4, "formula_error": 3, "logic_error": 1}
    assert reports.by_model_type(cells).filter("model_type = 'reasoning'").first()["accuracy"] == 0.0


def test_empty_reports(spark, sf_dir):
    cells = reports.summary_cells(scoring.score_runs(fx.runs(spark, sf_dir).filter("pos < 0")))
    assert tuple(reports.overall(cells).first()) == (0, 0, 0, 0.0)
    assert [r["total"] for r in reports.by_level(cells).collect()] == [0, 0, 0]


def test_breakdowns_agree(spark, sf_dir):
    cells = reports.summary_cells(scoring.score_runs(fx.runs(spark, sf_dir))).cache()
    wrong = reports.overall(cells).first()["incorrect"]
    assert sum(r["errors"] for r in reports.error_distribution(cells).collect()) == wrong
    assert sum(r["errors"] for r in reports.model_errors(cells).collect()) == wrong
    wide = {r["model_name"]: r for r in reports.model_level_pivot(cells).collect()}
    for r in reports.model_level(cells).collect():
        assert wide[r["model_name"]][f"{r['level']}_correct"] == r["correct"]
    cells.unpersist()


def test_call_errors_become_execution_errors(spark, sf_dir):
    runs = fx.runs(spark, sf_dir).filter("pos < 10").withColumn("call_error", F.when(F.col("pos") == 3, "timeout"))
    bad = scoring.score_runs(runs).filter("pos = 3").select("error_category", "error_confidence", "cost_micros", "is_correct", "predicted_num", "predicted_text").distinct()
    assert [tuple(r) for r in bad.collect()] == [("execution_error", 1.0, 0, False, None, None)]


def test_clustered_cache_is_not_moved(spark, tmp_path):
    rows = spark.range(4000).select(
        F.col("id").alias("pos"), (F.col("id") % 300).cast("string").alias("example_id"), (F.col("id") % 3).cast("string").alias("model"), F.md5((F.col("id") % 4).cast("string")).alias("prompt_hash"),
        F.timestamp_seconds(F.col("id")).alias("created_at"),
    )
    store.write_cache(rows, str(tmp_path / "cache"), "cache_of_test", 8)
    calls = rows.filter("pos < 10").select(*store.CALL_KEY)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.cached_calls(calls, spark.table("cache_of_test"), "1970-01-01 02:00:00")
        plan = plan_of(found)
        lines = plan.split("\n")
        scan = next(i for i, x in enumerate(lines) if "cache_of_test" in x)
        above = lines[:scan]
        depth = lambda x: len(x) - len(x.lstrip(" :+-"))
        chain, at = [], depth(lines[scan])
        for x in reversed(above):
            if depth(x) < at:
                chain, at = [*chain, x], depth(x)
        assert any("Window" in x for x in chain) and not any("Exchange" in x for x in chain)
        assert sorted((r["example_id"], r["created_at"].timestamp()) for r in found.collect()) == [(str(i), 3900.0 + i) for i in range(10)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE cache_of_test")


def test_override_forms(spark):
    base = dims.blended_prices(spark)
    columns = "model_name STRING, provider STRING, model_id STRING, max_tokens INT, temperature DOUBLE, price DECIMAL(10,3)"
    from decimal import Decimal

    patch = spark.createDataFrame([("gpt-4o", None, "new", 5, 0.5, Decimal("9.000")), ("nope", None, None, None, None, None)], columns)
    pick = ["model_id", "max_tokens", "temperature", "price"]
    bulk = selection.model_overrides(base, patch, True).select(*pick).collect()
    single = selection.model_overrides(base, patch, True, single=True).select(*pick).collect()
    assert [tuple(r) for r in bulk] == [("new", 5, 0.5, Decimal("2.500"))]
    assert [tuple(r) for r in single] == [("new", 128000, None, Decimal("9.000"))]
    assert selection.model_overrides(base, patch.limit(0), False).count() == len(dims.BLENDED_PRICES)


def test_merge_keeps_unrouted_rows(spark):
    key = [("e1", "m", "COT"), ("e2", "m", "COT"), ("e3", "m", "COT")]
    runs = spark.createDataFrame(
        [(*k, c, 0.3, "old") for k, c in zip(key, ["unknown", "hallucination", None])],
        "example_id STRING, model_name STRING, method STRING, error_category STRING, error_confidence DOUBLE, error_evidence STRING",
    )
    notes = spark.createDataFrame([(*k, "UNIT_ERROR", 0.8, "new") for k in key], "example_id STRING, model_name STRING, method STRING, error_type STRING, confidence DOUBLE, evidence STRING")
    got = {r["example_id"]: (r["error_category"], r["mapped_category"], r["error_evidence"]) for r in merge_analysis(runs, notes).collect()}
    assert got == {
        "e1": ("unit_error", "numerical_extraction_error", "new"),
        "e2": ("hallucination", "hallucination", "old"),
        "e3": (None, None, "old"),
    }


def test_prompts(spark):
    df = spark.createDataFrame([("cot_only", "Q {context}?", "C", None)], "t STRING, q STRING, c STRING, s STRING")
    none = F.lit(None).cast("string")
    text = df.select(prompts.render("t", F.col("q"), F.col("c"), F.col("s"), none).alias("p")).first()["p"]
    assert text.startswith("Think step-by-step and show your work.\n\nQuestion: Q {context}?\n\nContext:\nC\n\nNot provided\n")
    with pytest.raises(Exception, match="Unknown template: nope"):
        df.select(prompts.render(F.lit("nope"), F.col("q"), F.col("c"), F.col("s"), none)).collect()
    shown = df.select(prompts.enhance_prompt("q", F.lit("")).alias("a"), prompts.enhance_prompt("q", F.lit("FN")).alias("b")).first()
    assert shown["a"] == "Q {context}?" and "\nAvailable Financial Functions:\nFN\n" in shown["b"]


def test_grid(spark):
    examples = spark.createDataFrame([("a",), ("b",)], "example_id STRING")
    cells = grid.evaluation_grid(examples, ["m1", "m2"], ["COT", "POT"])
    assert cells.count() == 8
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_artifacts_are_nested_documents(spark, tmp_path):
    for level, ids in (("easy", "ab"), ("hard", "c")):
        folder = tmp_path / f"experiment={level}"
        folder.mkdir()
        for i in ids:
            results = [{"model_name": "m", "method": "COT", "tokens": 5, "cost_micros": 2}, {"model_name": "n", "method": "POT", "tokens": 7}]
            (folder / f"{i}.json").write_text(json.dumps({"example_id": i, "model_results": results}, indent=2))
        (folder / "summary.json").write_text(json.dumps({"experiment_name": level, "results": []}, indent=2))
    (tmp_path / "experiment=hard" / "broken.json").write_text('{\n "example_id": "d", \n')
    (tmp_path / "experiment=hard" / "noid.json").write_text('[{"model_results": []},\n {"example_id": "e", "model_results": []}]')
    found = store.read_artifacts(spark, str(tmp_path))
    totals = {(r["experiment"], r["example_id"]): (r["results"], r["total_tokens"], r["cost_micros"]) for r in store.artifact_totals(found).collect()}
    assert totals == {("easy", "a"): (2, 12, 2), ("easy", "b"): (2, 12, 2), ("hard", "c"): (2, 12, 2), ("hard", "e"): (0, 0, 0)}
    assert sorted((r["file"].rsplit("/", 1)[1], r["rows"]) for r in store.unread_artifacts(found).collect()) == [("broken.json", 1), ("noid.json", 1)]
    summary = {r["experiment"]: r["total_examples"] for r in store.experiment_summary(found).collect()}
    assert summary == {"easy": 2, "hard": 2}


def test_distinct_counts_without_expand(spark):
    runs = spark.range(100_000).select(
        (F.col("id") % 40_000).alias("pos"), (F.col("id") % 40_000).cast("string").alias("example_id"), (F.col("id") % 3).cast("string").alias("model_name"),
        F.lit(True).alias("is_correct"), F.lit(1).alias("cost_micros"), F.timestamp_seconds("id").alias("at"), (F.col("id") % 2).alias("e"),
    )
    totals = reports.report_totals(runs)
    assert "Expand" not in plan_of(totals) and tuple(totals.first())[:4] == (40_000, 3, 100_000, 100_000)
    assert tuple(reports.report_totals(runs.limit(0)).first())[:4] == (0, 0, 0, 0)
    headers = [store.run_header(runs, F.col("e"), F.col("at"), "v", p) for p in (F.col("pos"), None)]
    assert "Expand" not in plan_of(headers[0])
    assert sorted(map(tuple, headers[0].collect())) == sorted(map(tuple, headers[1].collect()))
