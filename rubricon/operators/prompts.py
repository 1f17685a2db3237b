"""Prompts as columns. Templates are cut at their placeholders once and rendered by
`concat`, so inserted text is never searched for placeholders again."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricon.functions.text import as_col, first_chars
from rubricon.templates import (
    ANALYSIS_PROMPT,
    COT_PREFIX,
    COT_SYSTEM,
    DEFAULT_TEMPLATE,
    ENHANCED_PROMPT,
    FUNCTIONS_NOTE,
    METHOD_TEMPLATES,
    NO_CONTEXT,
    NO_SOLUTION,
    POT_PREFIX,
    POT_SYSTEM,
    TEMPLATES,
)

CONTEXT_LIMIT = 3000
RESPONSE_LIMIT = 2000


def fill(template: str, values: dict[str, Column]) -> Column:
    """`template` with every `{name}` of `values` replaced by its column."""
    names = "|".join(map(re.escape, values))
    pieces = re.split(r"\{(" + names + r")\}", template)
    parts = [values[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def render(template: Column | str, question: Column, context: Column, solution: Column, functions: Column) -> Column:
    """System text, a blank line and the user text of the template named in a column.

    Without a solution the prompt says so; without functions their places stay empty.
    Unknown template names raise.
    """
    values = {
        "question": question,
        "context": context,
        "python_solution": F.coalesce(F.nullif(solution, F.lit("")), F.lit(NO_SOLUTION)),
        "functions_instructions": F.when(functions.isNotNull(), FUNCTIONS_NOTE).otherwise(""),
        "functions": F.coalesce(functions, F.lit("")),
    }
    name = as_col(template)
    out = None
    for key, (system, user) in TEMPLATES.items():
        text = fill(f"{system}\n\n{user}", values)
        out = F.when(name == key, text) if out is None else out.when(name == key, text)
    return out.otherwise(F.raise_error(F.concat(F.lit("Unknown template: "), F.coalesce(name, F.lit("null")))))


def template_for(methodology: Column | str) -> Column:
    """Template of a methodology, the structured one by default."""
    m = as_col(methodology)
    out = None
    for key, template in METHOD_TEMPLATES.items():
        out = F.when(m == key, template) if out is None else out.when(m == key, template)
    return out.otherwise(DEFAULT_TEMPLATE)


def experiment_prompt(method: Column | str, question: Column | str, context: Column | str) -> Column:
    """STRUCT<system, user> of a COT or POT experiment; empty contexts are left out."""
    m, q, c = as_col(method), as_col(question), as_col(context)
    asked = F.concat(F.lit("Question: "), q, F.lit("\n"))
    referenced = F.concat(
        F.lit("The following question context is provided for your reference.\n"), c, F.lit("\n\n"), asked
    )
    body = F.when(c.isNull() | c.isin("", "[]"), asked).otherwise(referenced)
    is_cot = m == "COT"
    return F.struct(
        F.when(is_cot, COT_SYSTEM).otherwise(POT_SYSTEM).alias("system"),
        F.concat(body, F.lit("\n"), F.when(is_cot, COT_PREFIX).otherwise(POT_PREFIX)).alias("user"),
    )


def analysis_prompt(question: Column, context: Column, truth: Column, predicted: Column, response: Column) -> Column:
    """Prompt that asks why an answer is wrong, with long inputs cut to their limits."""
    shown = F.when(F.coalesce(context, F.lit("")) == "", NO_CONTEXT).otherwise(first_chars(context, CONTEXT_LIMIT))
    values = {
        "question": question,
        "context": shown,
        "ground_truth": truth.cast("string"),
        "predicted_answer": F.coalesce(predicted.cast("string"), F.lit("None")),
        "raw_response": first_chars(response, RESPONSE_LIMIT),
    }
    return fill(ANALYSIS_PROMPT, values)


def enhance_prompt(prompt: Column | str, functions_text: Column | str) -> Column:
    """Prompt plus retrieved functions and instructions; unchanged when there are none."""
    p, f = as_col(prompt), as_col(functions_text)
    enhanced = fill(ENHANCED_PROMPT, {"prompt": p, "functions": f})
    return F.when(F.coalesce(f, F.lit("")) == "", p).otherwise(enhanced)


def prompt_sizes(rows: DataFrame, plain_template: str, rag_template: str) -> DataFrame:
    """`plain_chars` and `rag_chars` per row, from `question, context, python_solution, functions_text`."""
    common = [F.col("question"), F.col("context"), F.col("python_solution")]
    return rows.withColumns(
        {
            "plain_chars": F.length(render(F.lit(plain_template), *common, F.lit(None).cast("string"))),
            "rag_chars": F.length(render(F.lit(rag_template), *common, F.col("functions_text"))),
        }
    )
