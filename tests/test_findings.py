"""Faults found by review: plans that must hold on large tables, rows that must stay right."""

from pyspark.sql import functions as F

from rubricon.functions import answers as A
from rubricon.functions import steps as S
from rubricon.llm import language
from rubricon.operators import errors as E
from rubricon.operators import grid as G
from rubricon.operators import reports as R
from rubricon.operators import scoring
from rubricon.operators.binding import bind
from rubricon.plans import data_queries
from rubricon.plans import fixtures as fx
from rubricon.sources import store


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


CALL = "example_id STRING, model_name STRING, method STRING"


def test_responses_are_never_broadcast(spark):
    examples = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "example_id STRING")
    grid = G.evaluation_grid(examples, ["m", "n"], ["COT"]).drop("model_rank")
    responses = spark.createDataFrame(
        [("a", "m", "COT", "five", 3, 4), ("b", "n", "COT", None, 5, 6), (None, "m", "COT", "six", 7, 8)],
        f"{CALL}, raw_response STRING, prompt_tokens INT, completion_tokens INT",
    )
    filled = G.fill_grid(grid, responses)
    assert "Broadcast" not in plan(filled)
    lost = ("failed", "no response", 0, 0)
    rows = sorted((r["example_id"] or "", r["model_name"], r["parse_status"], r["raw_response"], r["prompt_tokens"], r["completion_tokens"]) for r in filled.collect())
    assert rows == sorted(
        [("", "m", *lost), ("", "n", *lost), ("b", "m", *lost), ("b", "n", "failed", "no response", 5, 6)]
        + 2 * [("a", "m", "success", "five", 3, 4), ("a", "n", *lost)]
    )
    costs = plan(filled.select("example_id", "parse_status", "prompt_tokens"))
    assert "raw_response" not in costs[costs.index("SortMergeJoin") : costs.index("Exchange")]


def test_analyses_are_never_broadcast(spark):
    runs = spark.createDataFrame([("a", "m", "COT", "unknown", 0.3, "")], f"{CALL}, error_category STRING, error_confidence DOUBLE, error_evidence STRING")
    analyses = spark.createDataFrame([("a", "m", "COT", "LOGIC_ERROR", 0.9, "why")], f"{CALL}, error_type STRING, confidence DOUBLE, evidence STRING")
    merged = E.merge_analysis(runs, analyses)
    assert "SortMergeJoin" in plan(merged)
    assert merged.select("error_category", "error_confidence").collect() == [("logic_error", 0.9)]


def test_every_labelled_text_teaches_its_language(spark):
    """More texts than the old samples of 1,500 and 500 held, each with words of its own."""
    n = 2_400
    docs = spark.range(n).select(
        F.concat(F.lit("the word "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("text"), F.lit("en").alias("lang")
    )
    docs = docs.unionAll(spark.createDataFrame([(None, "en"), ("le mot", "fr"), ("kein", None)], "text STRING, lang STRING"))
    found = language.gram_counts(docs.filter("lang is not null").withColumn("fold", (F.length("text") % 2).cast("int")).fillna({"fold": 0}))
    counts = {(r["lang"], r["gram"]): r["n0"] + r["n1"] for r in found.collect()}
    assert counts["en", "  th"] == counts["en", "the "] == counts["en", "word"] == n
    assert counts["fr", " mot"] == 1 and not any("kei" in g for _, g in counts)
    models, limits = language.train(docs)
    assert models.langs == ["en", "fr"] and limits[0] < limits[1] == float("inf")
    contexts, share = models.backoff[3]  # after "wor" only "d" follows, n times over all texts
    codes = language.np.array([[ord(c) for c in "wor"]], language.np.uint32)
    at = language.np.searchsorted(contexts, models._key(codes)[0])
    assert abs(share[at, 0] - language.DISCOUNT / n) < 1e-12


def test_bound_columns_are_compiled_by_a_projection(spark):
    """A generator interprets its expressions next to a function of higher order: it only unpacks."""
    rows = spark.createDataFrame([("a 1 b 22",), (None,)], "t STRING")
    bound = bind(rows, {"t": F.upper("t"), "n": F.transform(F.regexp_extract_all("t", F.lit(r"\d+"), F.lit(0)), lambda m: m.try_cast("int"))})
    assert bound.columns == ["t", "n"] and [tuple(r) for r in bound.collect()] == [("A 1 B 22", [1, 22]), (None, None)]
    generators = [line for line in bound.filter("size(n) > 0")._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Generate" in line]
    assert len(generators) == 1 and "regexp" not in generators[0]


def test_tables_are_not_sorted_for_their_first_error_type(spark):
    """a smallest text is aggregated by sorting, so that runs must be folded before it."""
    rows = [(1, "b", 5, True), (1, "a", 3, False), (1, "a", 9, True), (1, None, 4, True), (None, None, 7, False), (2, "c", None, True), (2, "d", 8, True)]
    runs = spark.createDataFrame(rows, "paper_table INT, paper_error_type STRING, pos BIGINT, is_correct BOOLEAN")
    found = R.by_table(runs)
    assert [(r["table_no"], r["error_type"], r["total"], r["correct"]) for r in found.collect()] == [(0, None, 1, 0), (1, "a", 4, 3), (2, "d", 2, 2)]
    below = plan(found)[plan(found).rindex("SortAggregate") :]
    assert below.count("HashAggregate") == 2


def test_orders_are_dealt_evenly(spark, tmp_path):
    """more splits than cores say nothing about where the rows are."""
    path = str(tmp_path / "orders")
    cores = spark.sparkContext.defaultParallelism
    for n in [*[1] * (3 * cores), 5_000]:
        spark.range(n).coalesce(1).write.mode("append").parquet(path)
    sizes = fx.dealt(spark.read.parquet(path), 500).groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert sizes.sum() == 5_000 + 3 * cores and len(sizes) >= 10 and sizes.max() < 1_000


def test_artifacts_are_written_compressed(spark, tmp_path):
    """indented artifacts are mostly names and blanks."""
    rows = spark.range(200).select(F.col("id").alias("pos"), F.format_string("test-%d", "id").alias("example_id"), F.expr(
        "transform(sequence(1, 22), i -> named_struct('model_name', 'm' || i, 'method', 'COT', 'tokens', i, 'cost_micros', id)) AS model_results"))
    path = data_queries._write_arrays(rows, str(tmp_path / "experiment=easy"), "[", "]", "gzip")
    files = [f for f in (tmp_path / "experiment=easy").rglob("part-*")]
    assert path and files and all(f.suffix == ".gz" for f in files)
    totals = store.artifact_totals(store.read_artifacts(spark, str(tmp_path)))
    assert sorted((int(r["example_id"][5:]), r["results"], r["total_tokens"], r["cost_micros"]) for r in totals.collect()) == [(i, 22, 253, 22 * i) for i in range(200)]
    assert spark.read.text(path).count() and sum(f.stat().st_size for f in files) < 60_000


def test_lone_commas_are_no_numbers(spark):
    """numbers as before, without a failing cast for each comma."""
    texts = ["Therefore, the answer is 1,234.50, or ,5 and ,.5 ,. 7. 8,9", ",", "", None, ",,", "3,"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    cast = F.transform(F.regexp_extract_all("t", F.lit(E.WRITTEN_NUMBER), 0), lambda m: F.translate(m, ",", "").try_cast("double"))
    assert all(r[0] == r[1] for r in df.select(E.written_numbers(F.col("t")), cast).collect())
    assert df.select(E.written_numbers(F.col("t"))).first()[0] == [None, 1234.5, None, 5.0, 0.5, None, 7.0, 89.0]
    assert "CASE WHEN" in plan(df.select(E.written_numbers(F.col("t"))))


def test_envelopes_are_parsed_once(spark):
    """the parse was pasted into the branch of every field."""
    chat = '{"response":{"choices":[{"message":{"content":" a "}}],"usage":{"prompt_tokens":3,"completion_tokens":4}}}'
    df = spark.createDataFrame([("openai", chat), ("google", chat), ("openai", "{"), ("other", chat), (None, None)], "p STRING, e STRING")
    read = bind(df, {"r": A.read_envelope("p", "e")}).select("r.*")
    assert [tuple(r) for r in read.collect()] == [("a", 3, 4), *4 * [("", 0, 0)]]
    assert plan(read).count("parseJson") <= 1


def test_first_objects_agree_with_counted_braces(spark):
    """the pattern finds what counting braces finds, and nothing else."""
    key = '"final_answer"'
    texts = [
        f"x {{{key}: 1, {{}}}} y", f'a {{"b": 1}} {{{key}: 2}}', f"}} {{{key}: 3}}", f'{{{{{key}: 4}}}}', f'{{"a": [{{"b": {{"c": 1}}}}], {key}: 5}} {{',
        f'{{"a": {{"b": {{"c": {{"d": 1}}}}}}, {key}: 6}} end', f'{{"a": "}}", {key}: 7}}', f"{{ {{{key}: 8}}", f'{{"x": {{{key}: 9}}}} then {{{key}: 10}}', "", None,
        f'{{"s": [{",".join(["{}"] * 300)}], {key}: 11}} {{', f'{{"s": [{",".join(["{}"] * 5000)}], {key}: 12}}', f'{{{{"a"}}}} {{{key}: 13}}', f"\n{{\n{key}: 14\n}}\n",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    fits = lambda p: p.contains(A.ANSWER_KEY) & ~p.startswith("{{") & A.holds_answer(p)
    counted = F.get(F.filter(A.balanced_objects("t"), fits), F.lit(0))
    rows = df.select(A.balanced_object("t"), counted, F.regexp_extract("t", A.FIRST_OBJECT, 1)).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows]
    assert rows[4][2] and not rows[5][2] and not rows[2][2] and rows[1][2] == '{"b": 1}'


def test_programs_cost_no_copies_of_rows(spark):
    """Each bound step copies the row, and programs need none."""
    runs = spark.createDataFrame(
        [("a", "m", "POT", "```python\nanswer = 5\n```", "answer = 5", None, "5", "Order 5", 1, 1)],
        f"{CALL}, raw_response STRING, execution_output STRING, execution_error STRING, ground_truth STRING, context STRING, prompt_tokens INT, completion_tokens INT",
    )
    scored = scoring.score_runs(runs)
    assert scored.first()["executed_code"] == "def solution():\n    # Define variables name and value\nanswer = 5\n\nresult = solution()"
    assert plan(scored.select("error_category")).count("Generate inline") == 3


def test_step_fields_need_no_function_per_step(spark):
    """fields of all steps are taken at once, null steps and lists as before."""
    kind = f"array<{S.STEP_TYPE.simpleString()}>"
    one, two, odd = (1, "calculation", "a", "b"), (2, "conditional", "c", "d"), (None, None, None, None)
    rows = [([one, two], [one, two]), ([one, two], [two, one, odd]), ([one], []), ([], [one]), ([one], None), (None, [one]), ([odd, one], [None, one])]
    df = spark.createDataFrame(rows, f"t {kind}, a {kind}")
    found = df.select(S.step_order("t", "a"), S.reasoning_similarity("t", "a"), S.hallucination_rate("t", "a"))
    assert "lambda" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [
        (1.0, 1.0, 0.0), (0.5, 2 / 3, 0.5), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, 1.0, 0.0),
    ]
