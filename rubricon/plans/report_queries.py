"""Registered queries: scoring, errors, breakdowns, curated cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricon import dims
from rubricon.functions import answers as A
from rubricon.functions import numbers as N
from rubricon.functions import programs as P
from rubricon.functions.text import preview
from rubricon.operators import errors as E
from rubricon.operators import grid as G
from rubricon.operators import prompts
from rubricon.operators import reports as R
from rubricon.operators import scoring
from rubricon.operators import selection as S
from rubricon.operators.binding import bind
from rubricon.plans import fixtures as fx
from rubricon.plans import sql
from rubricon.plans.registry import query
from rubricon.plans.sql import quote, rows
from rubricon.session import stored

KEY = ["example_id", "model_name", "method"]
KEYS = "example_id, model_name, method"


def scored(spark: SparkSession, sf_dir: str, models=None) -> DataFrame:
    return scoring.score_runs(fx.runs(spark, sf_dir, models))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.summary_cells(scored(spark, sf_dir))


def accuracy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells for reports that need no error category: nothing is classified for them."""
    return R.summary_cells(scoring.with_cost(scoring.read_answers(fx.runs(spark, sf_dir))))


# --- grid, responses, model choice -----------------------------------------------------


@query(
    "eval_grid",
    f"WITH {sql.EXAMPLES} SELECT example_id, level, model_name, method FROM fx_examples, {sql.grid(fx.MODEL_NAMES)}",
)
def eval_grid(spark, sf_dir):
    grid = G.evaluation_grid(fx.examples(spark, sf_dir), fx.MODEL_NAMES, dims.METHODS)
    return grid.select("example_id", "level", "model_name", "method")


def _answered(spark, sf_dir):
    """Responses of every model, except that some calls never came back."""
    lost = (F.col("pos") + F.col("ord")) % 11 == 0
    kept = ["raw_response", "prompt_tokens", "completion_tokens"]
    return fx.runs(spark, sf_dir, fx.MODEL_NAMES).filter(~lost).select(*KEY, *kept)


_ANSWERED_SQL = f"""WITH {sql.runs(fx.MODEL_NAMES)}, filled AS (
  SELECT r.*, (pos + ord) % 11 = 0 AS lost FROM fx_runs r)"""


def _filled(spark, sf_dir):
    grid = G.evaluation_grid(fx.examples(spark, sf_dir), fx.MODEL_NAMES, dims.METHODS)
    return G.fill_grid(grid.select("example_id", "model_name", "method"), _answered(spark, sf_dir))


@query(
    "grid_responses",
    f"""{_ANSWERED_SQL} SELECT {KEYS}, CASE WHEN lost THEN 'failed' ELSE 'success' END AS parse_status,
      CASE WHEN lost THEN 0 ELSE prompt_tokens END AS prompt_tokens,
      CASE WHEN lost THEN 0 ELSE completion_tokens END AS completion_tokens,
      md5(CASE WHEN lost THEN 'no response' ELSE raw_response END) AS response_md5 FROM filled""",
)
def grid_responses(spark, sf_dir):
    return _filled(spark, sf_dir).select(
        *KEY, "parse_status", "prompt_tokens", "completion_tokens", F.md5("raw_response").alias("response_md5")
    )


@query(
    "failed_passthrough",
    f"""{_ANSWERED_SQL} SELECT {KEYS}, CASE WHEN lost THEN 'no response' END AS error,
      CASE WHEN NOT lost THEN {sql.cot("raw_response")} END AS answer FROM filled""",
)
def failed_passthrough(spark, sf_dir):
    rows = G.pass_failed(_filled(spark, sf_dir))
    return rows.select(*KEY, "error", A.cot_answer("content").alias("answer"))


@query(
    "cost_totals",
    f"""{_ANSWERED_SQL}, {sql.MODELS} SELECT example_id, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS total_tokens,
      CAST(sum((prompt_tokens * milli_in + completion_tokens * milli_out + 500) // 1000) AS BIGINT) / 1000000.0 AS cost
      FROM filled LEFT JOIN fx_models USING (model_name) WHERE NOT lost GROUP BY example_id""",
)
def cost_totals(spark, sf_dir):
    return R.cost_totals(scoring.with_cost(_filled(spark, sf_dir)))


@query(
    "models_by_type",
    f"""WITH {sql.runs()}, {sql.MODELS} SELECT model_name, count(*) AS runs, count(DISTINCT example_id) AS examples
      FROM fx_runs JOIN fx_models USING (model_name) WHERE model_type = 'reasoning' GROUP BY model_name""",
)
def models_by_type(spark, sf_dir):
    chosen = S.of_model_type(fx.calls(spark, sf_dir), dims.REASONING)
    return chosen.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("runs"), F.count_distinct("example_id").alias("examples")
    )


@query(
    "budget_set_models",
    f"""WITH {sql.runs()} SELECT model_name, count(*) AS runs FROM fx_runs
      WHERE model_name IN ({sql.names(dims.BUDGET_SETS["full"])}) GROUP BY model_name""",
)
def budget_set_models(spark, sf_dir):
    return S.of_budget_set(fx.calls(spark, sf_dir), "full").groupBy("model_name").agg(F.count(F.lit(1)).alias("runs"))


@query(
    "model_availability",
    f"""WITH {sql.runs()}, {sql.MODELS} SELECT r.model_name,
      CASE WHEN m.model_name IS NULL THEN 'unknown' WHEN m.provider IN ('openai', 'google') THEN 'available' ELSE 'no_key' END AS status,
      count(*) AS runs FROM fx_runs r LEFT JOIN fx_models m USING (model_name) GROUP BY ALL""",
)
def model_availability(spark, sf_dir):
    asked = fx.calls(spark, sf_dir).groupBy("model_name").agg(F.count(F.lit(1)).alias("runs"))
    return S.model_availability(asked, ["openai", "google"]).select("model_name", "status", "runs")


_BLENDED_SQL = "fx_blended AS (SELECT * FROM (" + rows(
    [(m, p, i, t, float(c), x) for m, p, i, t, c, x in dims.BLENDED_PRICES]
) + ") AS t(model_name, provider, model_id, max_tokens, price, temperature))"


@query(
    "model_overrides",
    f"""WITH {sql.EXAMPLES}, {_BLENDED_SQL}, patches AS (
      SELECT CASE level WHEN 'easy' THEN 'gpt-4o' WHEN 'medium' THEN 'gemini-2.5-pro' ELSE 'not-a-model' END AS model_name,
             CASE level WHEN 'easy' THEN 'google' WHEN 'medium' THEN 'elsewhere' END AS provider,
             CAST(max(pos) % 4096 + 1 AS BIGINT) AS max_tokens FROM fx_examples GROUP BY level)
      SELECT b.model_name, CASE WHEN p.provider IN ('openai', 'anthropic', 'google') THEN p.provider ELSE b.provider END AS provider,
             b.model_id, p.max_tokens AS max_tokens, coalesce(b.temperature, -1.0) AS temperature, b.price
      FROM fx_blended b JOIN patches p USING (model_name)""",
)
def model_overrides(spark, sf_dir):
    level = F.col("level")
    patches = (
        fx.examples(spark, sf_dir)
        .groupBy("level")
        .agg(F.max("pos").alias("last"))
        .select(
            F.when(level == "easy", "gpt-4o").when(level == "medium", "gemini-2.5-pro").otherwise("not-a-model").alias("model_name"),
            F.when(level == "easy", "google").when(level == "medium", "elsewhere").alias("provider"),
            F.lit(None).cast("string").alias("model_id"),
            (F.col("last") % 4096 + 1).alias("max_tokens"),
            F.lit(None).cast("double").alias("temperature"),
            F.lit(None).cast("decimal(10,3)").alias("price"),
        )
    )
    patched = S.model_overrides(dims.blended_prices(spark), patches, any_overrides=True)
    return patched.select(
        "model_name", "provider", "model_id", F.col("max_tokens").cast("bigint").alias("max_tokens"),
        F.coalesce("temperature", F.lit(-1.0)).alias("temperature"), F.col("price").cast("double").alias("price"),
    )


# --- scoring one answer ----------------------------------------------------------------


@query("cot_extract", f"WITH {sql.runs(fx.MODEL_NAMES, ['COT'])} SELECT {KEYS}, {sql.cot('raw_response')} AS answer FROM fx_runs")
def cot_extract(spark, sf_dir):
    runs = fx.runs(spark, sf_dir, fx.MODEL_NAMES, ["COT"])
    return runs.select(*KEY, A.cot_answer("raw_response").alias("answer"))


_SPELLED_SQL = f"""WITH {sql.runs(fx.MODEL_NAMES, ["POT"])}, spelled AS (SELECT *,
  CASE pos % 4 WHEN 0 THEN ' ' || answer || ' ' WHEN 1 THEN answer || '%' WHEN 2 THEN '$' || answer
    ELSE '1,' || answer END AS pred
  FROM (SELECT *, nullif(regexp_extract(execution_output, 'answer = (.+)', 1), '') AS answer FROM fx_runs))"""


def _spelled(spark, sf_dir):
    """Recorded outputs in several spellings: blanks, percent, currency sign, commas."""
    answer = P.program_output("execution_output")["text"]
    pos = F.col("pos") % 4
    runs = fx.runs(spark, sf_dir, fx.MODEL_NAMES, ["POT"]).withColumn("answer", answer)
    return runs.withColumn(
        "pred",
        F.when(pos == 0, F.concat(F.lit(" "), "answer", F.lit(" ")))
        .when(pos == 1, F.concat("answer", F.lit("%")))
        .when(pos == 2, F.concat(F.lit("$"), "answer"))
        .otherwise(F.concat(F.lit("1,"), "answer")),
    )


@query("check_answer", f"{_SPELLED_SQL} SELECT {KEYS}, {sql.check('pred', 'ground_truth')} AS is_correct FROM spelled")
def check_answer(spark, sf_dir):
    return _spelled(spark, sf_dir).select(*KEY, N.check_answer("pred", "ground_truth").alias("is_correct"))


@query(
    "deviation",
    f"{_SPELLED_SQL} SELECT {KEYS}, round({sql.deviation(sql.number('pred', ',%'), sql.number('ground_truth', ',%'))}, 9) AS deviation FROM spelled",
)
def deviation(spark, sf_dir):
    return _spelled(spark, sf_dir).select(*KEY, F.round(N.deviation("pred", "ground_truth"), 9).alias("deviation"))


@query(
    "cost_split",
    f"""WITH {sql.runs()}, {sql.MODELS} SELECT {KEYS},
      coalesce((prompt_tokens * milli_in + completion_tokens * milli_out + 500) // 1000, -1) AS cost_micros
      FROM fx_runs LEFT JOIN fx_models USING (model_name)""",
)
def cost_split(spark, sf_dir):
    return scoring.with_cost(fx.calls(spark, sf_dir)).select(*KEY, F.coalesce("cost_micros", F.lit(-1)).alias("cost_micros"))


@query(
    "cost_blended",
    f"""WITH {sql.runs()}, {_BLENDED_SQL} SELECT {KEYS},
      round((prompt_tokens + completion_tokens) / 1000000.0 * coalesce(nullif(price, 0), 15.0), 9) AS cost
      FROM fx_runs LEFT JOIN fx_blended USING (model_name)""",
)
def cost_blended(spark, sf_dir):
    prices = F.broadcast(dims.blended_prices(spark).select("model_name", "price"))
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    runs = fx.calls(spark, sf_dir).join(prices, "model_name", "left")
    return runs.select(*KEY, F.round(N.blended_cost(tokens, F.col("price")), 9).alias("cost"))


@query(
    "token_estimate",
    f"""WITH {sql.runs(fx.MODEL_NAMES)} SELECT {KEYS}, round(length(question || context) * 1.3, 6) AS prompt_estimate,
      round(length(question || context) * 1.3 + completion_tokens, 6) AS total_estimate FROM fx_runs""",
)
def token_estimate(spark, sf_dir):
    estimate = N.estimate_tokens(F.length(F.concat("question", "context")))
    runs = fx.calls(spark, sf_dir, fx.MODEL_NAMES)
    return runs.select(
        *KEY,
        F.round(estimate, 6).alias("prompt_estimate"),
        F.round(estimate + F.col("completion_tokens"), 6).alias("total_estimate"),
    )


@query(
    "previews",
    """SELECT doc_id, left(text, 100) AS cut_100, left(text, 200) AS cut_200,
      CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS dotted_2000,
      CASE WHEN length(text) > 3000 THEN left(text, 3000) || '...' ELSE text END AS dotted_3000 FROM documents""",
)
def previews(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cuts = [preview("text", n).alias(f"cut_{n}") for n in (100, 200)]
    dotted = [preview("text", n, "...").alias(f"dotted_{n}") for n in (2000, 3000)]
    return docs.select("doc_id", *cuts, *dotted)


# --- scored and classified rows --------------------------------------------------------


@query(
    "score_runs",
    f"""WITH {sql.scored(fx.MODEL_NAMES)} SELECT {KEYS}, level, model_type, predicted_num, is_correct, coalesce(cost_micros, -1) AS cost_micros,
      coalesce(error_category, '') AS error_category, md5(coalesce(executed_code, '')) AS code_md5 FROM scored""",
)
def score_runs(spark, sf_dir):
    return scored(spark, sf_dir, fx.MODEL_NAMES).select(
        *KEY, "level", "model_type", "predicted_num", "is_correct", F.coalesce("cost_micros", F.lit(-1)).alias("cost_micros"),
        F.coalesce("error_category", F.lit("")).alias("error_category"),
        F.md5(F.coalesce("executed_code", F.lit(""))).alias("code_md5"),
    )


def _raised():
    """Calls that raised instead of answering: every second model of every 11th example."""
    return F.when((F.col("pos") % 11 == 0) & (F.col("ord") % 2 == 0), F.concat(F.lit("timeout "), F.col("pos").cast("string")))


@query(
    "failed_calls",
    f"""WITH {sql.scored(fx.MODEL_NAMES)}, called AS (SELECT *, CASE WHEN pos % 11 = 0 AND ord % 2 = 0 THEN 'timeout ' || pos END AS call_error FROM scored)
      SELECT {KEYS}, call_error IS NULL AND is_correct AS is_correct, CASE WHEN call_error IS NULL THEN predicted_num END AS predicted_num,
        CASE WHEN call_error IS NULL THEN coalesce(cost_micros, -1) ELSE 0 END AS cost_micros,
        CASE WHEN call_error IS NULL THEN coalesce(error_category, '') ELSE 'execution_error' END AS error_category,
        CASE WHEN call_error IS NOT NULL THEN 'Call or execution raised: ' || call_error ELSE '' END AS raised,
        coalesce(call_error, execution_error, '') AS execution_error FROM called""",
)
def failed_calls(spark, sf_dir):
    rows = scoring.score_runs(fx.runs(spark, sf_dir, fx.MODEL_NAMES).withColumn("call_error", _raised()))
    raised = F.col("error_evidence").startswith("Call or execution raised")
    return rows.select(
        *KEY, "is_correct", "predicted_num", F.coalesce("cost_micros", F.lit(-1)).alias("cost_micros"),
        F.coalesce("error_category", F.lit("")).alias("error_category"),
        F.when(raised, F.col("error_evidence")).otherwise("").alias("raised"),
        F.coalesce("execution_error", F.lit("")).alias("execution_error"),
    )


_ERROR_COLUMNS_SQL = """error_category,
  CASE error_category WHEN 'rounding_error' THEN 0.9 WHEN 'numerical_calculation_error' THEN 0.7 WHEN 'hallucination' THEN 0.6
    WHEN 'unknown' THEN 0.3 ELSE 0.95 END::DOUBLE AS confidence,
  CASE error_category WHEN 'execution_error' THEN 'POT code execution failed: Undefined variable in generated code'
    WHEN 'parsing_error' THEN 'Failed to parse answer from response'
    WHEN 'numerical_calculation_error' THEN 'Answer within ' || printf('%.1f', deviation * 100) || '% of ground truth (likely calculation error)'
    WHEN 'hallucination' THEN 'Found ' || len({foreign}) || ' values in response not present in context'
    WHEN 'unknown' THEN 'Could not automatically classify error - manual review needed' END AS evidence,
  error_category <> 'unknown' AS auto_classified"""
_ERROR_COLUMNS_SQL = _ERROR_COLUMNS_SQL.replace("{foreign}", sql.foreign("coalesce(executed_code, raw_response)", "context"))


def _error_columns(rows):
    return rows.select(
        *KEY,
        F.col("error.category").alias("error_category"),
        F.col("error.confidence").alias("confidence"),
        F.col("error.evidence").alias("evidence"),
        F.col("error.auto_classified").alias("auto_classified"),
    )


@query("classify_errors", f"WITH {sql.scored(fx.MODEL_NAMES)} SELECT {KEYS}, {_ERROR_COLUMNS_SQL} FROM scored WHERE NOT is_correct")
def classify_errors(spark, sf_dir):
    return _error_columns(E.classify(S.wrong_rows(scored(spark, sf_dir, fx.MODEL_NAMES))))


@query("classify_batch", f"WITH {sql.scored(fx.MODEL_NAMES)} SELECT {KEYS}, {_ERROR_COLUMNS_SQL} FROM scored WHERE NOT is_correct")
def classify_batch(spark, sf_dir):
    return _error_columns(E.classify_batch(scored(spark, sf_dir, fx.MODEL_NAMES), fx.examples(spark, sf_dir)))


@query(
    "wrong_rows",
    f"WITH {sql.scored(fx.MODEL_NAMES)} SELECT {KEYS}, level, predicted_num FROM scored WHERE NOT is_correct",
)
def wrong_rows(spark, sf_dir):
    read = scoring.read_answers(fx.runs(spark, sf_dir, fx.MODEL_NAMES))
    return S.wrong_rows(read).select(*KEY, "level", "predicted_num")


@query(
    "hallucination",
    f"""WITH {sql.scored(fx.MODEL_NAMES)}, found AS (
      SELECT {KEYS}, {sql.foreign("coalesce(executed_code, raw_response)", "context")} AS numbers FROM scored)
      SELECT {KEYS}, len(numbers) AS n_foreign, len(numbers) >= 2 AS is_hallucination,
        array_to_string(list_transform(numbers[1:5], lambda n: CAST(CAST(round(n * 100) AS BIGINT) AS VARCHAR)), ',') AS sample_cents
      FROM found WHERE numbers IS NOT NULL""",
)
def hallucination(spark, sf_dir):
    text = F.coalesce("executed_code", "raw_response")
    # Bound: the filter and each field would search the texts again.
    found = bind(scored(spark, sf_dir, fx.MODEL_NAMES), {"numbers": E.foreign_numbers(text, F.col("context"))})
    cents = F.transform(F.slice("numbers", 1, 5), lambda n: F.round(n * 100).cast("bigint").cast("string"))
    return found.filter(F.col("numbers").isNotNull()).select(
        *KEY,
        F.size("numbers").cast("bigint").alias("n_foreign"),
        (F.size("numbers") >= E.FOREIGN_MINIMUM).alias("is_hallucination"),
        F.array_join(cents, ",").alias("sample_cents"),
    )


_MESSAGES = [
    "SyntaxError: invalid syntax", "NameError: name 'x' is not defined", "TypeError: bad operand",
    "ZeroDivisionError: division by zero", "ValueError: could not convert", "IndexError: out of range",
    "KeyError: 'total'", "MemoryError", "TypeError raised from NameError",
]


@query(
    "exec_error_type",
    f"""WITH {sql.EXAMPLES}, failed AS (SELECT example_id, [{sql.names(_MESSAGES)}][pos % {len(_MESSAGES)} + 1] AS message FROM fx_examples)
      SELECT example_id, CASE {" ".join(f"WHEN contains(message, {quote(n)}) THEN {quote(l)}" for n, l in P.EXECUTION_ERRORS.items())}
        ELSE {quote(P.OTHER_EXECUTION_ERROR)} END AS error_type FROM failed""",
)
def exec_error_type(spark, sf_dir):
    message = F.get(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("pos") % len(_MESSAGES)).cast("int"))
    return fx.examples(spark, sf_dir).select("example_id", P.execution_error_type(message).alias("error_type"))


@query(
    "needs_analysis",
    f"WITH {sql.scored(fx.MODEL_NAMES)} SELECT {KEYS}, error_category FROM scored WHERE error_category IN ({sql.names(dims.ROUTED_CATEGORIES)})",
)
def needs_analysis(spark, sf_dir):
    return S.needs_analysis(scored(spark, sf_dir, fx.MODEL_NAMES)).select(*KEY, "error_category")


_LABELS = ["FORMULA_ERROR", "UNIT_ERROR", "LOGIC_ERROR", "INCOMPLETE", "MISUNDERSTANDING", "SOMETHING_ELSE"]


def _analysis_text():
    label = F.get(F.array(*[F.lit(x) for x in _LABELS]), (F.col("pos") % len(_LABELS)).cast("int"))
    k = F.col("pos").cast("string")
    return F.concat(
        F.when(F.col("pos") % 7 == 6, "").otherwise(F.concat(F.lit("ERROR_TYPE: "), label, F.lit("\n"))),
        F.lit("summary: wrong step "), k, F.lit("\nDETAILED_ANALYSIS: first\nsecond line\nLIKELY_CAUSE: haste\n"),
        F.lit("CORRECT_APPROACH: redo "), k, F.lit("\n"),
        F.when(F.col("pos") % 5 == 4, "").otherwise(
            F.concat(F.lit("CONFIDENCE: "), (F.col("pos") % 3).cast("string"), F.lit(".25"))
        ),
    )


_ANALYSIS_SQL = f"""CASE WHEN pos % 7 = 6 THEN '' ELSE 'ERROR_TYPE: ' || [{sql.names(_LABELS)}][pos % {len(_LABELS)} + 1] || chr(10) END
  || 'summary: wrong step ' || pos || chr(10) || 'DETAILED_ANALYSIS: first' || chr(10) || 'second line' || chr(10)
  || 'LIKELY_CAUSE: haste' || chr(10) || 'CORRECT_APPROACH: redo ' || pos || chr(10)
  || CASE WHEN pos % 5 = 4 THEN '' ELSE 'CONFIDENCE: ' || (pos % 3) || '.25' END"""


def _label_sql(label: str, default: str) -> str:
    pattern = f"(?is){label}:\\s*(.+?)(?:\\n[A-Z_]+:|$)"
    return f"coalesce(nullif({sql.strip(f'regexp_extract(analysis, {quote(pattern)}, 1)')}, ''), {quote(default)})"


_FIELDS_SQL = f"""{_label_sql("ERROR_TYPE", "UNKNOWN")} AS error_type, {_label_sql("SUMMARY", "Analysis incomplete")} AS summary,
  {_label_sql("DETAILED_ANALYSIS", "")} AS detailed_analysis, {_label_sql("LIKELY_CAUSE", "")} AS likely_cause,
  {_label_sql("CORRECT_APPROACH", "")} AS correct_approach,
  greatest(least(coalesce(TRY_CAST(regexp_extract(analysis, 'CONFIDENCE:\\s*([\\d.]+)', 1) AS DOUBLE), 0.7), 1.0), 0.0)::DOUBLE AS confidence"""


@query(
    "analysis_fields",
    f"WITH {sql.EXAMPLES}, a AS (SELECT example_id, {_ANALYSIS_SQL} AS analysis FROM fx_examples) SELECT example_id, {_FIELDS_SQL} FROM a",
)
def analysis_fields(spark, sf_dir):
    rows = fx.examples(spark, sf_dir).withColumn("analysis", _analysis_text())
    return rows.select("example_id", A.analysis_fields("analysis").alias("f")).select("example_id", "f.*")


_EVIDENCE_SQL = """'[' || error_type || '] ' || summary || chr(10) || chr(10) || '상세 분석: ' || detailed_analysis || chr(10) || chr(10)
  || '원인: ' || likely_cause || chr(10) || chr(10) || '올바른 접근: ' || correct_approach"""


@query(
    "evidence_fields",
    f"""WITH {sql.EXAMPLES}, a AS (SELECT example_id, pos, question, {_ANALYSIS_SQL} AS analysis FROM fx_examples),
      f AS (SELECT example_id, pos, question, {_FIELDS_SQL} FROM a),
      e AS (SELECT *, CASE WHEN pos % 3 = 0 THEN repeat(question || ' ', 9) ELSE {_EVIDENCE_SQL} END AS evidence FROM f)
      SELECT example_id,
        CASE WHEN pos % 3 = 0 THEN CASE WHEN length(evidence) > 200 THEN left(evidence, 200) || '...' ELSE evidence END ELSE summary END AS summary,
        CASE WHEN pos % 3 = 0 THEN '' ELSE detailed_analysis END AS detail,
        CASE WHEN pos % 3 = 0 THEN '' ELSE likely_cause END AS cause,
        CASE WHEN pos % 3 = 0 THEN '' ELSE correct_approach END AS approach FROM e""",
)
def evidence_fields(spark, sf_dir):
    rows = fx.examples(spark, sf_dir).withColumn("f", A.analysis_fields(_analysis_text()))
    plain = F.repeat(F.concat("question", F.lit(" ")), 9)
    evidence = F.when(F.col("pos") % 3 == 0, plain).otherwise(A.compose_evidence(F.col("f")))
    fields = rows.withColumn("evidence", evidence).select("example_id", A.evidence_fields("evidence").alias("e"))
    return fields.select("example_id", "e.*")


_ALIAS_SQL = "aliases AS (SELECT * FROM (" + rows(dims.CATEGORY_ALIASES) + ") AS t(label, alias_of))"


@query(
    "merge_analysis",
    # An analysis exists for every second example; its fields depend on the example alone.
    f"""WITH {sql.scored(fx.MODEL_NAMES)}, {_ALIAS_SQL},
      wrong AS (SELECT {KEYS}, pos, error_category AS rule, {_ANALYSIS_SQL} AS analysis FROM scored WHERE NOT is_correct),
      routed AS (SELECT {KEYS}, rule, CASE WHEN pos % 2 = 0 AND rule IN ({sql.names(dims.ROUTED_CATEGORIES)}) THEN analysis END AS analysis FROM wrong),
      fields AS (SELECT {KEYS}, rule, analysis, {_FIELDS_SQL} FROM routed),
      m AS (SELECT {KEYS}, CASE WHEN analysis IS NULL THEN rule ELSE lower(error_type) END AS error_category,
        CASE WHEN analysis IS NOT NULL THEN confidence WHEN rule = 'numerical_calculation_error' THEN 0.7
          WHEN rule = 'hallucination' THEN 0.6 WHEN rule = 'unknown' THEN 0.3 ELSE 0.95 END::DOUBLE AS error_confidence FROM fields)
      SELECT {KEYS}, error_category, coalesce(alias_of, error_category) AS mapped_category, error_confidence
      FROM m LEFT JOIN aliases ON label = error_category""",
)
def merge_analysis(spark, sf_dir):
    wrong = S.wrong_rows(scored(spark, sf_dir, fx.MODEL_NAMES))
    # Scored once: both sides of the merge read it.
    wrong = stored(wrong.select(*KEY, "pos", "error_category", "error_confidence", "error_evidence"), "wrong")
    fields = A.analysis_fields(_analysis_text())
    analyses = (
        wrong.filter(F.col("pos") % 2 == 0)
        .select(*KEY, fields.alias("f"))
        .select(*KEY, "f.error_type", "f.confidence", A.compose_evidence(F.col("f")).alias("evidence"))
    )
    return E.merge_analysis(wrong, analyses).select(*KEY, "error_category", "mapped_category", "error_confidence")


_LABEL_DIM_SQL = "labels_of AS (SELECT * FROM (" + rows(dims.CATEGORY_LABELS) + ") AS t(category, icon, icon_class, label))"
_SEVERITY_SQL = "severity_of AS (SELECT * FROM (" + rows([(c[0], c[5]) for c in dims.CATEGORIES]) + ") AS t(category, severity))"


@query(
    "category_labels",
    f"""WITH {sql.scored()}, {_LABEL_DIM_SQL}, {_SEVERITY_SQL},
      e AS (SELECT error_category, count(*) AS errors FROM scored WHERE NOT is_correct GROUP BY 1)
      SELECT error_category, errors, coalesce(icon, '❓') AS icon, coalesce(icon_class, 'unknown') AS icon_class, coalesce(label, error_category) AS label,
        coalesce(severity, 'medium') AS severity
      FROM e LEFT JOIN labels_of l ON l.category = error_category LEFT JOIN severity_of s ON s.category = error_category""",
)
def category_labels(spark, sf_dir):
    return E.with_labels(R.error_distribution(cells(spark, sf_dir))).select(
        "error_category", "errors", "icon", "icon_class", "label", "severity"
    )


# --- breakdowns ------------------------------------------------------------------------

_ACC = "round(CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (is_correct) / count(*) * 100 END, 6) AS accuracy"
_COUNTS = "count(*) AS total, count(*) FILTER (is_correct) AS correct"
_COST = "coalesce(CAST(sum(cost_micros) AS BIGINT), 0) / 1000000.0 AS cost"
_SCORED = f"WITH {sql.scored()}"


@query("overall", f"{_SCORED} SELECT {_COUNTS}, count(*) FILTER (NOT is_correct) AS incorrect, {_ACC} FROM scored")
def overall(spark, sf_dir):
    return R.overall(accuracy_cells(spark, sf_dir))


@query(
    "by_model_method",
    f"{_SCORED} SELECT model_name, method, {_COUNTS}, {_COST}, {_ACC}, round(count(*) FILTER (is_correct) / count(*) * 100, 1) AS accuracy_1 FROM scored GROUP BY 1, 2",
)
def by_model_method(spark, sf_dir):
    return R.by_model_method(accuracy_cells(spark, sf_dir))


@query("by_model", f"{_SCORED} SELECT model_name, {_COUNTS}, {_COST}, {_ACC} FROM scored GROUP BY 1")
def by_model(spark, sf_dir):
    return R.by_model(accuracy_cells(spark, sf_dir))


@query(
    "leaderboard",
    f"{_SCORED} SELECT model_name, {_COUNTS}, {_COST}, {_ACC} FROM scored GROUP BY 1 ORDER BY accuracy DESC, model_name",
)
def leaderboard(spark, sf_dir):
    return R.leaderboard(accuracy_cells(spark, sf_dir))


@query(
    "by_level",
    f"""{_SCORED}, g AS (SELECT level, {_COUNTS}, {_ACC} FROM scored GROUP BY 1)
      SELECT l.level, coalesce(total, 0) AS total, coalesce(correct, 0) AS correct, coalesce(accuracy, 0.0) AS accuracy
      FROM ({rows([(x,) for x in dims.LEVELS])}) AS l(level) LEFT JOIN g USING (level)""",
)
def by_level(spark, sf_dir):
    return R.by_level(accuracy_cells(spark, sf_dir))


@query("model_level", f"{_SCORED} SELECT model_name, level, {_COUNTS}, {_ACC} FROM scored GROUP BY 1, 2")
def model_level(spark, sf_dir):
    return R.model_level(accuracy_cells(spark, sf_dir))


@query(
    "model_level_pivot",
    f"{_SCORED} SELECT model_name, "
    + ", ".join(
        f"count(*) FILTER (level = '{x}' AND is_correct) AS {x}_correct, count(*) FILTER (level = '{x}') AS {x}_total"
        for x in dims.LEVELS
    )
    + " FROM scored GROUP BY 1",
)
def model_level_pivot(spark, sf_dir):
    return R.model_level_pivot(accuracy_cells(spark, sf_dir))


@query("by_model_type", f"{_SCORED} SELECT model_type, {_COUNTS}, {_ACC} FROM scored GROUP BY 1")
def by_model_type(spark, sf_dir):
    return R.by_model_type(accuracy_cells(spark, sf_dir))


@query("type_lookup_default", f"{_SCORED} SELECT model_name, model_type, count(*) AS runs FROM scored GROUP BY 1, 2")
def type_lookup_default(spark, sf_dir):
    runs = fx.calls(spark, sf_dir).groupBy("model_name").agg(F.count(F.lit(1)).alias("runs"))
    return S.with_model_type(runs)


@query("type_lookup_inner", f"{_SCORED} SELECT model_name, model_type, count(*) AS runs FROM scored WHERE registered GROUP BY 1, 2")
def type_lookup_inner(spark, sf_dir):
    runs = fx.calls(spark, sf_dir).groupBy("model_name").agg(F.count(F.lit(1)).alias("runs"))
    return S.with_model_type(runs, None)


@query("error_dist", f"{_SCORED} SELECT error_category, count(*) AS errors FROM scored WHERE NOT is_correct GROUP BY 1")
def error_dist(spark, sf_dir):
    return R.error_distribution(cells(spark, sf_dir))


_CATEGORY_DIM_SQL = f"({rows([(c[0],) for c in dims.CATEGORIES])}) AS d(error_category)"


@query(
    "error_dist_full",
    f"""{_SCORED}, g AS (SELECT error_category, count(*) AS errors FROM scored WHERE NOT is_correct GROUP BY 1)
      SELECT d.error_category, coalesce(errors, 0) AS errors FROM {_CATEGORY_DIM_SQL} LEFT JOIN g USING (error_category)""",
)
def error_dist_full(spark, sf_dir):
    return R.error_distribution_full(cells(spark, sf_dir))


@query(
    "model_errors",
    f"""{_SCORED}, g AS (SELECT model_name, error_category, count(*) AS errors FROM scored WHERE NOT is_correct GROUP BY 1, 2)
      SELECT m.model_name, d.error_category, coalesce(errors, 0) AS errors
      FROM (SELECT DISTINCT model_name FROM g) m, {_CATEGORY_DIM_SQL} LEFT JOIN g
        ON g.model_name = m.model_name AND g.error_category = d.error_category""",
)
def model_errors(spark, sf_dir):
    return R.model_errors(cells(spark, sf_dir))


@query(
    "model_error_map",
    f"""{_SCORED}, g AS (SELECT model_name, method, error_category, count(*) AS errors FROM scored WHERE NOT is_correct GROUP BY ALL)
      SELECT model_name, method, string_agg(error_category || '=' || errors, ',' ORDER BY error_category) AS errors FROM g GROUP BY 1, 2""",
)
def model_error_map(spark, sf_dir):
    entry = lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    listed = F.array_join(F.transform(F.map_entries("errors"), entry), ",")
    return R.model_error_map(cells(spark, sf_dir)).select("model_name", "method", listed.alias("errors"))


@query(
    "top_errors",
    f"""{_SCORED}, g AS (SELECT model_type, error_category, count(*) AS errors FROM scored WHERE NOT is_correct GROUP BY 1, 2)
      SELECT model_type, error_category, errors, row_number() OVER (PARTITION BY model_type ORDER BY errors DESC, error_category) AS rank
      FROM g QUALIFY rank <= 5""",
)
def top_errors(spark, sf_dir):
    return R.top_errors(cells(spark, sf_dir), 5).withColumn("rank", F.col("rank").cast("bigint"))


@query("pot_series", f"{_SCORED} SELECT model_name, {_COUNTS}, {_ACC} FROM scored WHERE method = 'POT' GROUP BY 1")
def pot_series(spark, sf_dir):
    return R.pot_series(accuracy_cells(spark, sf_dir))


@query(
    "report_totals",
    f"{_SCORED} SELECT count(DISTINCT example_id) AS examples, count(DISTINCT model_name) AS models, count(*) AS evaluations, count(*) FILTER (is_correct) AS correct, {_COST} FROM scored",
)
def report_totals(spark, sf_dir):
    return R.report_totals(scoring.with_cost(scoring.read_answers(fx.runs(spark, sf_dir))))


@query(
    "report_cube",
    f"""{_SCORED} SELECT CASE WHEN grouping(model_name) = 0 THEN 'model_method' WHEN grouping(level) = 0 THEN 'level'
        WHEN grouping(model_type) = 0 THEN 'model_type' WHEN grouping(error_category) = 0 THEN 'error_category' ELSE 'overall' END AS section,
      model_name, method, level, model_type, error_category, {_COUNTS}, {_COST}, {_ACC}
      FROM scored GROUP BY GROUPING SETS ((), (model_name, method), (level), (model_type), (error_category))""",
)
def report_cube(spark, sf_dir):
    return R.report_cube(cells(spark, sf_dir))


_CARDS_SQL = f"""WITH {sql.scored(fx.MODEL_NAMES)}, g AS (
  SELECT example_id, level, model_name, method, {_COUNTS} FROM scored GROUP BY 1, 2, 3, 4),
cards AS (
  SELECT example_id, level, CAST(sum(total) AS BIGINT) AS total, CAST(sum(correct) AS BIGINT) AS correct,
    string_agg(model_name || ':' || method || ':' || correct || '/' || total, ',' ORDER BY model_name || ':' || method || ':' || correct || '/' || total) AS results
  FROM g GROUP BY 1, 2)"""


@query(
    "problem_cards",
    f"""{_CARDS_SQL} SELECT example_id, level, total, correct, CASE WHEN correct = total THEN 'all-correct' WHEN correct = 0 THEN 'all-wrong' ELSE 'mixed' END AS state,
      correct > total / 2 AS majority, correct < total AS has_wrong, results FROM cards""",
)
def problem_cards(spark, sf_dir):
    return R.problem_cards(scoring.read_answers(fx.runs(spark, sf_dir, fx.MODEL_NAMES)))


@query("problem_filter", f"{_CARDS_SQL} SELECT example_id, level, correct, total FROM cards WHERE correct < total")
def problem_filter(spark, sf_dir):
    cards = R.problem_cards(scoring.read_answers(fx.runs(spark, sf_dir, fx.MODEL_NAMES)))
    return S.problem_filter(cards, "wrong").select("example_id", "level", "correct", "total")


@query(
    "dataset_stats",
    f"""WITH {sql.EXAMPLES} SELECT 'total' AS section, 'all' AS name, count(*) AS n FROM fx_examples
      UNION ALL SELECT 'level', l.level, count(e.level) FROM ({rows([(x,) for x in dims.LEVELS])}) AS l(level) LEFT JOIN fx_examples e USING (level) GROUP BY 2
      UNION ALL SELECT 'source', source, count(*) FROM fx_examples GROUP BY 2""",
)
def dataset_stats(spark, sf_dir):
    return R.dataset_stats(fx.examples(spark, sf_dir))


# --- curated cases ---------------------------------------------------------------------

_CASES_SQL = "fx_cases AS (SELECT * FROM (" + rows(dims.PAPER_CASES) + (
    ") AS t(case_id, paper_table, paper_error_type, paper_description, paper_source))"
)


@query(
    "paper_cases",
    f"""WITH {sql.EXAMPLES}, {_CASES_SQL} SELECT example_id, level, ground_truth, paper_table, paper_error_type, paper_source
      FROM fx_examples JOIN fx_cases ON example_id = case_id""",
)
def paper_cases(spark, sf_dir):
    found = scoring.paper_examples(fx.examples(spark, sf_dir)).orderBy("paper_table")
    return found.select("example_id", "level", "ground_truth", "paper_table", "paper_error_type", "paper_source")


@query(
    "paper_missing",
    f"WITH {sql.EXAMPLES}, {_CASES_SQL} SELECT case_id, paper_table FROM fx_cases WHERE case_id NOT IN (SELECT example_id FROM fx_examples)",
)
def paper_missing(spark, sf_dir):
    return scoring.missing_cases(fx.examples(spark, sf_dir)).select("case_id", "paper_table")


_PAPER_RUNS_SQL = f"""WITH {sql.scored(fx.MODEL_NAMES)}, {_CASES_SQL}, paper_runs AS (
  SELECT s.*, paper_table, paper_error_type FROM scored s LEFT JOIN fx_cases ON example_id = case_id)"""


def _paper_runs(spark, sf_dir, how="inner"):
    runs = scoring.read_answers(fx.runs(spark, sf_dir, fx.MODEL_NAMES))
    cases = F.broadcast(fx.cases(spark))
    return runs.join(cases, runs["example_id"] == cases["case_id"], how)


@query(
    "paper_runs",
    f"""{_PAPER_RUNS_SQL} SELECT {KEYS}, paper_table, is_correct, coalesce(error_category, '') AS error_category, coalesce(cost_micros, -1) AS cost_micros
      FROM paper_runs WHERE paper_table IS NOT NULL""",
)
def paper_runs(spark, sf_dir):
    cases = F.broadcast(fx.cases(spark))
    runs = fx.runs(spark, sf_dir, fx.MODEL_NAMES)
    chosen = runs.join(cases, runs["example_id"] == cases["case_id"])
    return scoring.score_runs(chosen).select(
        *KEY, "paper_table", "is_correct", F.coalesce("error_category", F.lit("")).alias("error_category"),
        F.coalesce("cost_micros", F.lit(-1)).alias("cost_micros"),
    )


_ACC1 = "round(count(*) FILTER (is_correct) / count(*) * 100, 1) AS accuracy"


@query(
    "by_error_type",
    f"{_PAPER_RUNS_SQL} SELECT coalesce(paper_error_type, 'Unknown') AS error_type, {_COUNTS}, {_ACC1} FROM paper_runs GROUP BY 1",
)
def by_error_type(spark, sf_dir):
    return R.by_error_type(_paper_runs(spark, sf_dir, "left"))


@query(
    "by_table",
    f"""{_PAPER_RUNS_SQL} SELECT coalesce(paper_table, 0) AS table_no, arg_min(paper_error_type, pos) AS error_type, {_COUNTS}, {_ACC1}
      FROM paper_runs GROUP BY 1""",
)
def by_table(spark, sf_dir):
    return R.by_table(_paper_runs(spark, sf_dir, "left"))


# --- prompts ---------------------------------------------------------------------------

from rubricon import templates as T  # noqa: E402


def _template_sql(text: str, values: dict[str, str]) -> str:
    out = quote(text)
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


_RENDER_SQL = "CASE template " + " ".join(
    f"WHEN {quote(name)} THEN "
    + _template_sql(
        f"{system}\n\n{user}",
        {
            "functions_instructions": f"CASE WHEN fn IS NULL THEN '' ELSE {quote(T.FUNCTIONS_NOTE)} END",
            "functions": "coalesce(fn, '')",
            "question": "question",
            "context": "context",
            "python_solution": f"coalesce(nullif(sol, ''), {quote(T.NO_SOLUTION)})",
        },
    )
    for name, (system, user) in T.TEMPLATES.items()
) + " END"


@query(
    "render_prompts",
    f"""WITH {sql.EXAMPLES}, {sql.SOLUTIONS}, r AS (
      SELECT example_id, m.methodology, m.template, question, context,
        CASE WHEN pos % 3 = 0 THEN NULL ELSE python_solution END AS sol,
        CASE WHEN pos % 2 = 0 THEN 'FN ' || source END AS fn
      FROM fx_solutions, ({rows([(k, v) for k, v in T.METHOD_TEMPLATES.items()] + [("other", T.DEFAULT_TEMPLATE)])}) AS m(methodology, template)),
      p AS (SELECT example_id, methodology, {_RENDER_SQL} AS prompt FROM r)
      SELECT example_id, methodology, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM p""",
)
def render_prompts(spark, sf_dir):
    names = F.array(*[F.lit(m) for m in [*T.METHOD_TEMPLATES, "other"]])
    rows_ = fx.solutions(spark, sf_dir).select("*", F.explode(names).alias("methodology"))
    prompt = prompts.render(
        prompts.template_for("methodology"),
        F.col("question"),
        F.col("context"),
        F.when(F.col("pos") % 3 != 0, F.col("python_solution")),
        F.when(F.col("pos") % 2 == 0, F.concat(F.lit("FN "), "source")),
    )
    made = rows_.select("example_id", "methodology", prompt.alias("prompt"))
    return made.select("example_id", "methodology", F.length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("prompt_md5"))


@query(
    "exp_prompts",
    f"""WITH {sql.EXAMPLES}, p AS (SELECT example_id, method,
        CASE WHEN method = 'COT' THEN {quote(T.COT_SYSTEM)} ELSE {quote(T.POT_SYSTEM)} END AS system,
        CASE WHEN context NOT IN ('', '[]') THEN 'The following question context is provided for your reference.' || chr(10) || context || chr(10) || chr(10) ELSE '' END
          || 'Question: ' || question || chr(10) || chr(10) || CASE WHEN method = 'COT' THEN {quote(T.COT_PREFIX)} ELSE {quote(T.POT_PREFIX)} END AS usr
      FROM fx_examples, (VALUES ('COT'), ('POT')) AS m(method))
      SELECT example_id, method, md5(system || chr(10) || chr(10) || usr) AS prompt_md5, length(usr) AS user_chars FROM p""",
)
def exp_prompts(spark, sf_dir):
    methods = F.array(*[F.lit(m) for m in dims.METHODS])
    made = fx.examples(spark, sf_dir).select("*", F.explode(methods).alias("method"))
    made = made.select("example_id", "method", prompts.experiment_prompt("method", "question", "context").alias("p"))
    whole = F.concat("p.system", F.lit("\n\n"), "p.user")
    return made.select("example_id", "method", F.md5(whole).alias("prompt_md5"), F.length("p.user").cast("bigint").alias("user_chars"))


@query(
    "analysis_prompts",
    f"""WITH {sql.scored(fx.MODEL_NAMES)}, w AS (SELECT {KEYS}, question, CASE WHEN pos % 4 = 0 THEN '' ELSE repeat(context || ' ', 200) END AS ctx,
        ground_truth, raw_response, predicted_text FROM scored WHERE error_category IN ({sql.names(dims.ROUTED_CATEGORIES)})),
      p AS (SELECT {KEYS}, {_template_sql(T.ANALYSIS_PROMPT, {"question": "question", "context": f"CASE WHEN ctx = '' THEN {quote(T.NO_CONTEXT)} ELSE left(ctx, 3000) END", "ground_truth": "ground_truth", "predicted_answer": "coalesce(predicted_text, 'None')", "raw_response": "left(repeat(raw_response || ' ', 60), 2000)"})} AS prompt FROM w)
      SELECT {KEYS}, md5(prompt) AS prompt_md5, length(prompt) AS n_chars FROM p""",
)
def analysis_prompts(spark, sf_dir):
    rows_ = S.needs_analysis(scored(spark, sf_dir, fx.MODEL_NAMES))
    context = F.when(F.col("pos") % 4 == 0, "").otherwise(F.repeat(F.concat("context", F.lit(" ")), 200))
    # Bound: a prompt mentions its context more than once.
    long = bind(rows_, {"_context": context, "_response": F.repeat(F.concat("raw_response", F.lit(" ")), 60)})
    prompt = prompts.analysis_prompt(
        F.col("question"), F.col("_context"), F.col("ground_truth"), F.col("predicted_text"), F.col("_response")
    )
    made = long.select(*KEY, prompt.alias("prompt"))
    return made.select(*KEY, F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast("bigint").alias("n_chars"))
