"""Number parsing, answer comparison and cost arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubricon.functions.text import as_col, int_div, strip, without

# Grammar of a numeric answer, tolerances, blended default price.
NUMERIC = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)\s*$"
ANSWER_TOLERANCE = 0.002
ABSOLUTE_TOLERANCE = 0.001
DEFAULT_BLENDED_PRICE = 15.0
TOKENS_PER_CHAR = 1.3
SCORE_WEIGHTS = {"correct": 0.4, "completeness": 0.3, "order": 0.1, "grounded": 0.2}


def to_number(c: Column | str, drop: str = "") -> Column:
    """DOUBLE when the trimmed text (without the `drop` characters) is a number, else NULL.

    One explicit grammar, so that engine-specific spellings such as `1.0d` or
    `1_000` never count as numbers.
    """
    text = as_col(c).cast("string")
    text = without(text, drop)
    # Text outside the grammar extracts '', which casts to NULL.
    return F.regexp_extract(text, NUMERIC, 1).try_cast("double")


def is_numeric(c: Column | str) -> Column:
    return to_number(c).isNotNull()


def within_tolerance(pred: Column, truth: Column, tolerance: float = ANSWER_TOLERANCE) -> Column:
    """Relative tolerance, inclusive; an exclusive absolute one around a zero truth."""
    relative = F.abs(pred - truth) / F.nullif(F.abs(truth), F.lit(0.0))
    return F.when(truth == 0, F.abs(pred) < tolerance).otherwise(relative <= tolerance)


def check_answer(pred: Column | str, truth: Column | str, tolerance: float = ANSWER_TOLERANCE) -> Column:
    """Is the prediction right? Numbers by tolerance, anything else as trimmed lower-case text."""
    pred, truth = as_col(pred), as_col(truth)
    p, t = to_number(pred, ",%"), to_number(truth, ",%")
    same_text = F.lower(strip(pred.cast("string"))) == F.lower(
        strip(F.coalesce(truth.cast("string"), F.lit("none")))
    )
    return (
        F.when(pred.isNull(), F.lit(False))
        .when(p.isNotNull() & t.isNotNull(), within_tolerance(p, t, tolerance))
        .otherwise(same_text)
    )


def check_number(pred_num: Column | str, truth_num: Column | str, tolerance: float = ANSWER_TOLERANCE) -> Column:
    """`check_answer` for answers that were already parsed to DOUBLE."""
    p, t = as_col(pred_num), as_col(truth_num)
    return F.coalesce(within_tolerance(p, t, tolerance), F.lit(False))


def compare_final(truth: Column | str, answer: Column | str) -> Column:
    """STRUCT<correct, type_match> under the absolute tolerance.

    The answer is a number, JSON text whose `final_answer` is read (0 when the key is
    missing, no match when it is null), or text convertible to a number.
    """
    truth, answer = as_col(truth), as_col(answer)
    t = to_number(truth, ",")
    direct = to_number(answer, ",")
    doc = F.try_parse_json(F.when(strip(answer).startswith("{"), answer))
    has_key = F.try_variant_get(doc, "$.final_answer", "variant").isNotNull()
    from_doc = F.when(has_key, to_number(F.try_variant_get(doc, "$.final_answer", "string"))).otherwise(F.lit(0.0))
    a = F.when(F.schema_of_variant(doc).startswith("OBJECT"), from_doc).otherwise(direct)
    usable = t.isNotNull() & a.isNotNull()
    truth_prefix = truth.cast("string").contains("ANSWER: ")
    answer_prefix = F.upper(strip(answer.cast("string"))).startswith("ANSWER:")
    return F.struct(
        F.coalesce(usable & (F.abs(t - a) < ABSOLUTE_TOLERANCE), F.lit(False)).alias("correct"),
        F.coalesce(usable & (truth_prefix == answer_prefix), F.lit(False)).alias("type_match"),
    )


def deviation(pred: Column | str, truth: Column | str) -> Column:
    """Relative deviation; the absolute prediction around a zero truth; NULL for text."""
    return number_deviation(to_number(pred, ",%"), to_number(truth, ",%"))


def number_deviation(p: Column, t: Column) -> Column:
    return F.when(t == 0, F.abs(p)).otherwise(F.abs(p - t) / F.nullif(F.abs(t), F.lit(0.0)))


def milli_price(price: Column | str) -> Column:
    """Price per million tokens in thousandths of a dollar, an exact integer."""
    return F.round(as_col(price) * 1000).cast("bigint")


def split_cost_micros(prompt: Column | str, completion: Column | str, milli_in: Column, milli_out: Column) -> Column:
    """Cost in micro-dollars, rounded half up from exact integer nano-dollars.

    Integer money keeps sums independent of row order, which DOUBLE does not.
    """
    nano = as_col(prompt).cast("bigint") * milli_in + as_col(completion).cast("bigint") * milli_out
    return int_div(nano + 500, 1000)


def blended_cost(total_tokens: Column | str, price: Column | str) -> Column:
    """Dollars from one blended price; missing or zero prices fall back to the default."""
    effective = F.coalesce(F.nullif(as_col(price).cast("double"), F.lit(0.0)), F.lit(DEFAULT_BLENDED_PRICE))
    return as_col(total_tokens) / F.lit(1_000_000) * effective


def estimate_tokens(prompt_chars: Column | str) -> Column:
    return as_col(prompt_chars) * F.lit(TOKENS_PER_CHAR)


def overall_score(correct: Column, completeness: Column, order: Column, has_hallucination: Column, rate: Column) -> Column:
    """Weighted reasoning score; 0 when any required measure is missing."""
    w = SCORE_WEIGHTS
    score = (
        correct.cast("double") * w["correct"]
        + completeness * w["completeness"]
        + order * w["order"]
        + (F.lit(1.0) - rate) * w["grounded"]
    )
    missing = correct.isNull() | completeness.isNull() | order.isNull() | has_hallucination.isNull()
    return F.when(missing, F.lit(0.0)).otherwise(score)


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, and 0 for an empty whole."""
    return F.coalesce(F.try_divide(part, whole) * 100, F.lit(0.0))
