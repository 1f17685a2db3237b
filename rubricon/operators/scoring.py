"""From recorded responses to scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon import dims
from rubricon.functions import numbers as N
from rubricon.functions import programs as P
from rubricon.functions import steps as S
from rubricon.functions.answers import cot_answer
from rubricon.functions.text import strip
from rubricon.operators import errors
from rubricon.operators.binding import bind
from rubricon.operators.grid import CELL


def read_answers(runs: DataFrame) -> DataFrame:
    """Add `predicted_num`, `predicted_text` and `is_correct`.

    COT answers come out of the response text, POT answers out of recorded program output.
    """
    is_cot = F.col("method") == "COT"
    # `program_output_text`, a column for each value: columns that are mentioned more than once are
    # projected and compiled, while a function over an array is interpreted.
    text = runs.withColumn("_output", F.when(~is_cot, strip("execution_output")))
    text = text.withColumn("_assigned", P.assigned_answer("_output"))
    text = bind(text, {"predicted_text": P.answer_in_output("_output", "_assigned")}).drop("_output", "_assigned")
    read = text.withColumns(
        {
            "predicted_num": F.when(is_cot, cot_answer("raw_response")).otherwise(N.to_number("predicted_text")),
            "truth_num": N.to_number("ground_truth", ",%"),
        }
    )
    by_number = N.check_number("predicted_num", "truth_num")
    same_text = F.coalesce(N.check_answer("predicted_text", "ground_truth"), F.lit(False))
    both = F.col("predicted_num").isNotNull() & F.col("truth_num").isNotNull()
    return bind(read, {"is_correct": F.when(both, by_number).otherwise(same_text)})


def with_cost(runs: DataFrame) -> DataFrame:
    """Add `cost_micros` from the registry's two prices (NULL for models outside it) and
    `model_type` (general outside it)."""
    registry = dims.models(runs.sparkSession).select(
        "model_name",
        N.milli_price("price_in").alias("_milli_in"),
        N.milli_price("price_out").alias("_milli_out"),
        F.col("model_type").alias("_type"),
    )
    cost = N.split_cost_micros("prompt_tokens", "completion_tokens", F.col("_milli_in"), F.col("_milli_out"))
    joined = runs.join(F.broadcast(registry), "model_name", "left")
    return joined.withColumns(
        {"cost_micros": cost, "model_type": F.coalesce("_type", F.lit(dims.GENERAL))}
    ).drop("_milli_in", "_milli_out", "_type")


def score_runs(runs: DataFrame) -> DataFrame:
    """Scored and classified rows: answer, correctness, cost, model type and error.

    Rows whose call raised (`call_error`) become execution errors of confidence 1 without an
    answer, at no cost.
    """
    if "call_error" not in runs.columns:
        runs = runs.withColumn("call_error", F.lit(None).cast("string"))
    raised = F.col("call_error").isNotNull()
    has_program = (F.col("method") == "POT") & ~raised
    scored = with_cost(read_answers(runs))
    # `fenced_or_whole` and `wrap_solution`, a column for each value. Not bound: programs that nobody reads are pruned.
    scored = scored.withColumn("_fenced", F.when(has_program, P.fenced_code("raw_response")))
    scored = scored.withColumn("_code", F.when(has_program, P.code_or_text("_fenced", "raw_response")))
    scored = scored.withColumn("_program", P.with_head("_code"))
    scored = scored.withColumn("executed_code", P.with_call("_program")).drop("_fenced", "_code", "_program")
    answered = (F.col("predicted_num").isNotNull() | F.col("predicted_text").isNotNull()) & ~raised
    scored = scored.withColumns(
        {
            "is_correct": F.col("is_correct") & ~raised,
            "predicted_num": F.when(~raised, F.col("predicted_num")),
            "predicted_text": F.when(~raised, F.col("predicted_text")),
            "parse_status": F.when(answered, "success").otherwise("failed"),
            "cost_micros": F.when(raised, F.lit(0)).otherwise(F.col("cost_micros")),
        }
    )
    wrong = ~F.col("is_correct")
    classified = errors.classify(scored)
    return classified.withColumns(
        {
            "error_category": F.when(raised, dims.EXECUTION).when(wrong, F.col("error.category")),
            "error_confidence": F.when(raised, 1.0).when(wrong, F.col("error.confidence")),
            "error_evidence": F.when(raised, F.concat(F.lit("Call or execution raised: "), F.col("call_error")))
            .when(wrong, F.col("error.evidence"))
            .otherwise(""),
            "execution_error": F.coalesce("call_error", "execution_error"),
        }
    ).drop("error", "call_error")


def with_truth_steps(examples: DataFrame) -> DataFrame:
    """Add `truth_steps`, read from `python_solution`. Before examples meet models, so that a
    program is read once, not once per model."""
    none = F.array().cast(f"array<{S.STEP_TYPE.simpleString()}>")
    return bind(examples, {"truth_steps": F.coalesce(S.truth_steps("python_solution"), none)})


def metrics(answers: DataFrame) -> DataFrame:
    """All step and answer measures per (example, model), computed inside the row.

    Reads `ground_truth, raw_steps, final_answer, raw_response` and `truth_steps`, or
    `python_solution` where these have not been read yet.
    """
    t, a = F.col("truth_steps"), F.col("answer_steps")
    prepared = bind(
        answers if "truth_steps" in answers.columns else with_truth_steps(answers),
        {
            "answer_steps": S.answer_steps("raw_steps"),
            "_final": N.compare_final("ground_truth", F.coalesce("final_answer", "raw_response")),
        },
    )
    measured = prepared.withColumns(
        {
            "final_answer_correct": F.col("_final.correct"),
            "final_answer_matches_type": F.col("_final.type_match"),
            "step_completeness": S.step_completeness(t, a),
            "step_count_equal": S.same_count(t, a),
            "step_order_correct": S.step_order(t, a),
            "reasoning_similarity": S.reasoning_similarity(t, a),
            "hallucination_rate": S.hallucination_rate(t, a),
        }
    ).withColumn("has_hallucination", F.col("hallucination_rate") > 0)
    return measured.withColumn(
        "overall_reasoning_score",
        N.overall_score(
            F.col("final_answer_correct"),
            F.col("step_completeness"),
            F.col("step_order_correct"),
            F.col("has_hallucination"),
            F.col("hallucination_rate"),
        ),
    ).drop("_final")


def paper_examples(examples: DataFrame) -> DataFrame:
    """Examples that are curated cases, with the case's columns."""
    cases = F.broadcast(dims.paper_cases(examples.sparkSession))
    return examples.join(cases, examples["example_id"] == cases["case_id"]).drop("case_id")


def missing_cases(examples: DataFrame) -> DataFrame:
    """Curated cases without an example. Only matching ids are read out of the examples."""
    cases = dims.paper_cases(examples.sparkSession)
    present = examples.select("example_id").join(
        F.broadcast(cases.select(F.col("case_id").alias("example_id"))), "example_id", "left_semi"
    )
    return cases.join(present, cases["case_id"] == present["example_id"], "left_anti")


__all__ = ["CELL", "metrics", "missing_cases", "paper_examples", "read_answers", "score_runs", "with_cost"]
