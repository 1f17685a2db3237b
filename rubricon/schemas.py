"""Explicit schemas; sources never infer."""

from __future__ import annotations

from rubricon.functions.steps import STEP_TYPE

STEP = STEP_TYPE.simpleString()

# Answers stay text: they may be numbers or words. Open-shaped objects stay JSON text.
RAW_EXAMPLE = (
    "question_id STRING, question STRING, context STRING, ground_truth STRING, python_solution STRING, "
    "level STRING, source STRING, difficulty DOUBLE, inventory STRING, statistics STRING"
)
TRACE = f"STRUCT<total_steps: INT, steps: ARRAY<{STEP}>>"
TRACED_ITEM = (
    "trace_id STRING, question STRING, context STRING, ground_truth STRING, level STRING, "
    f"reasoning_trace {TRACE}"
)
RAW_FUNCTION = "function_id STRING, article_title STRING, function STRING, function_docstring STRING"

EXAMPLE_COLUMNS = [
    "pos",
    "example_id",
    "question_id",
    "question",
    "context",
    "ground_truth",
    "level",
    "source",
    "difficulty",
    "inventory",
    "statistics",
    "python_solution",
    "reasoning_trace",
]
