"""Reasoning steps as ARRAY<STRUCT>: reading them and comparing two lists.

Everything works inside the row with higher-order functions, so a step metric
costs no explode and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubricon.functions.text import as_col, contains_any, fold_out, let, lines, strip

STEP_TYPE = T.StructType(
    [
        T.StructField("step_number", T.IntegerType()),
        T.StructField("step_type", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("code_snippet", T.StringType()),
    ]
)

# Step types and the line shapes that reveal them.
VARIABLE, CALCULATION, CONDITIONAL, RESULT = STEP_TYPES = [
    "variable_definition",
    "calculation",
    "conditional",
    "return_result",
]
OPERATORS = ["+", "-", "*", "/"]
TEXT_DEFINITION = r"^[\p{L}\p{N}_\s]+=\s*[\d.]+"
TEXT_CONDITIONAL = r"^(if|elif)\s"
TEXT_RESULT = r"^(return|answer)\s"
TEXT_NUMBERED = r"^[\d\s-]+\.\s"
SIMILARITY_FLOOR = 0.5


def make_step(number: Column, kind: Column, description: Column, snippet: Column) -> Column:
    return F.struct(
        number.cast("int").alias("step_number"),
        kind.cast("string").alias("step_type"),
        description.alias("description"),
        snippet.alias("code_snippet"),
    )


def truth_steps(solution: Column | str) -> Column:
    """Steps of a reference program. Numbers are line numbers and count skipped lines."""

    def read(line: Column, at: Column) -> Column:
        text = strip(line)
        one_equals = F.length(text) - F.length(F.replace(text, F.lit("="), F.lit(""))) == 1
        kind = (
            F.when(one_equals, VARIABLE)
            .when(contains_any(text, OPERATORS), CALCULATION)
            .when(text.contains("if"), CONDITIONAL)
            .when(text.contains("return") | text.contains("answer"), RESULT)
        )
        label = (
            F.when(kind == VARIABLE, "Define variable: ")
            .when(kind == CALCULATION, "Calculate: ")
            .when(kind == CONDITIONAL, "Conditional check: ")
            .otherwise("Return result: ")
        )
        return make_step(at + 1, kind, F.concat(label, text), text)

    rows = F.transform(lines(strip(solution)), read)
    return F.filter(rows, lambda s: s["step_type"].isNotNull())


def answer_steps(raw_steps: Column | str) -> Column:
    """Steps of a model answer, numbered by position; unknown types count as definitions."""

    def read(step: Column, at: Column) -> Column:
        kind = F.lower(step["step_type"])
        return make_step(
            at + 1,
            F.when(kind.isin(STEP_TYPES), kind).otherwise(VARIABLE),
            F.coalesce(step["description"], F.lit("")),
            F.coalesce(step["code_snippet"], F.lit("")),
        )

    return F.transform(as_col(raw_steps), read)


def with_defaults(step: Column) -> Column:
    return make_step(
        F.coalesce(step["step_number"], F.lit(0)),
        F.coalesce(step["step_type"], F.lit(VARIABLE)),
        F.coalesce(step["description"], F.lit("")),
        F.coalesce(step["code_snippet"], F.lit("")),
    )


def read_steps(text: Column | str) -> Column:
    """`reasoning_steps` of a JSON text; missing fields get defaults, non-objects are skipped.

    Well-formed lists are read in one typed pass; only lists that do not fit the schema go
    through the slower open-shaped reader.
    """
    t = as_col(text)
    typed = F.from_json(t, f"reasoning_steps ARRAY<{STEP_TYPE.simpleString()}>")["reasoning_steps"]
    # Read once: mentioned twice, the text would be parsed twice.
    whole = let(typed, lambda steps: F.when(F.forall(steps, lambda s: s.isNotNull()), F.transform(steps, with_defaults)))
    return F.coalesce(whole, steps_from_json(F.try_parse_json(t)))


def steps_from_json(doc: Column) -> Column:
    """`reasoning_steps` of a VARIANT of any shape."""
    items = F.filter(
        F.try_variant_get(doc, "$.reasoning_steps", "array<variant>"),
        lambda v: F.schema_of_variant(v).startswith("OBJECT"),
    )

    def read(v: Column) -> Column:
        return make_step(
            F.coalesce(F.try_variant_get(v, "$.step_number", "int"), F.lit(0)),
            F.coalesce(F.try_variant_get(v, "$.step_type", "string"), F.lit(VARIABLE)),
            F.coalesce(F.try_variant_get(v, "$.description", "string"), F.lit("")),
            F.coalesce(F.try_variant_get(v, "$.code_snippet", "string"), F.lit("")),
        )

    return F.transform(items, read)


def text_steps(content: Column | str) -> Column:
    """One step per non-blank line of free text.

    The number only advances on lines without a recognised shape. One count is carried from
    line to line, so the whole pass stays inside the row and in proportion to its lines.
    """
    rows = F.filter(F.transform(lines(content), strip), lambda l: l != "")

    def shape(line: Column) -> Column:
        return (
            F.when(line.contains("=") & line.rlike(TEXT_DEFINITION), "v")
            .when(contains_any(line, OPERATORS), "c")
            .when(line.rlike(TEXT_CONDITIONAL), "i")
            .when(line.rlike(TEXT_RESULT), "r")
            .when(line.rlike(TEXT_NUMBERED), "N")
            .otherwise("O")
        )

    marked = F.transform(rows, lambda l: F.struct(shape(l).alias("mark"), l.alias("line")))

    def read(m: Column, number: Column) -> Column:
        kind = (
            F.when(m["mark"].isin("v", "N"), VARIABLE)
            .when(m["mark"] == "c", CALCULATION)
            .when(m["mark"] == "i", CONDITIONAL)
            .when(m["mark"] == "r", RESULT)
        )
        label = (
            F.when(m["mark"] == "v", F.lit("Define variable: "))
            .when(m["mark"] == "c", F.lit("Calculate: "))
            .when(m["mark"] == "i", F.lit("Conditional: "))
            .when(m["mark"] == "r", F.lit("Final result: "))
            .when(m["mark"] == "N", F.concat(F.lit("Step "), number.cast("string"), F.lit(": ")))
        )
        return make_step(number, kind, F.coalesce(F.concat(label, m["line"]), F.lit("")), m["line"])

    def number_all(m: Column) -> Column:
        def step(count: Column, line: Column) -> tuple[Column, Column, Column]:
            number = count + F.when(line["mark"].isin("N", "O"), 1).otherwise(0)
            return number, number, F.lit(True)

        return let(fold_out(m, F.lit(0), "int", step), lambda numbers: F.transform(m, lambda e, at: read(e, F.get(numbers, at))))

    return let(marked, number_all)


# --- comparing two lists ---------------------------------------------------------------


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 when equal or `b` lies in `a`, 0.5 when `a` lies in `b`, else word Jaccard."""
    x, y = F.lower(as_col(a)), F.lower(as_col(b))

    def words(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))

    wx, wy = words(x), words(y)
    return (
        F.when((x == y) | x.contains(y), 1.0)
        .when(y.contains(x), 0.5)
        .otherwise(set_jaccard(wx, wy))
    )


def set_jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of two arrays without repeats; 0 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(common.cast("double"), F.size(a) + F.size(b) - common), F.lit(0.0))


def no_steps(steps: Column) -> Column:
    return steps.isNull() | (F.size(steps) == 0)


def matched_steps(truth: Column, answer: Column) -> Column:
    """Truth steps with a same-numbered answer step of equal type and similar description."""

    def has_twin(t: Column) -> Column:
        return F.exists(
            answer,
            lambda a: (a["step_number"] == t["step_number"])
            & (a["step_type"] == t["step_type"])
            & (similarity(t["description"], a["description"]) > SIMILARITY_FLOOR),
        )

    return F.filter(truth, has_twin)


def step_completeness(truth: Column | str, answer: Column | str) -> Column:
    t, a = as_col(truth), as_col(answer)
    share = F.size(matched_steps(t, a)).cast("double") / F.nullif(F.size(t), F.lit(0))
    return F.when(no_steps(a) | no_steps(t), 0.0).otherwise(share)


def same_count(truth: Column | str, answer: Column | str) -> Column:
    t, a = as_col(truth), as_col(answer)
    return F.when(no_steps(a) | no_steps(t), False).otherwise(F.size(t) == F.size(a))


def step_order(truth: Column | str, answer: Column | str) -> Column:
    """1 when the types agree over the common prefix, else 0.5; 0 without answer steps."""
    t, a = F.coalesce(as_col(truth), F.array().cast(T.ArrayType(STEP_TYPE))), as_col(answer)
    shared = F.least(F.size(t), F.size(a))

    def leading_types(steps: Column) -> Column:
        return F.slice(steps["step_type"], F.lit(1), shared)

    agrees = leading_types(t) == leading_types(a)
    return F.when(no_steps(a), 0.0).when(agrees, 1.0).otherwise(0.5)


def step_field(steps: Column, field: str) -> Column:
    """Distinct values of a field, which is taken out of the array without a function per step."""
    return F.array_distinct(steps[field])


def reasoning_similarity(truth: Column | str, answer: Column | str) -> Column:
    """Jaccard of the two sets of step types."""
    t, a = as_col(truth), as_col(answer)
    return F.when(no_steps(a) | no_steps(t), 0.0).otherwise(
        set_jaccard(step_field(t, "step_type"), step_field(a, "step_type"))
    )


def extra_steps(truth: Column | str, answer: Column | str) -> Column:
    """Answer step numbers that the truth does not have."""
    return F.array_except(step_field(as_col(answer), "step_number"), step_field(as_col(truth), "step_number"))


def hallucination_rate(truth: Column | str, answer: Column | str) -> Column:
    """Extra steps per truth step; may exceed 1."""
    t, a = as_col(truth), as_col(answer)
    rate = F.size(extra_steps(t, a)).cast("double") / F.nullif(F.size(t), F.lit(0))
    return F.when(no_steps(a) | no_steps(t), 0.0).otherwise(rate)
