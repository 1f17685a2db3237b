"""Rule-based classification of wrong answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricon import dims
from rubricon.functions.numbers import number_deviation
from rubricon.functions.programs import execution_error_type
from rubricon.functions.text import preview, without
from rubricon.operators.binding import bind
from rubricon.operators.grid import CELL
from rubricon.operators.selection import wrong_rows

# Thresholds, number shape, numbers that are never foreign.
ROUNDING_LIMIT = 0.002
CALCULATION_LIMIT = 0.10
WRITTEN_NUMBER = r"[\d,]+\.?\d*"
COMMON_NUMBERS = [1.0, 2.0, 100.0, 1000.0, 365.0, 12.0, 52.0]
SMALLEST_NUMBER = 0.01
FOREIGN_RANGE = (1.0, 1e12)
FOREIGN_MINIMUM = 2
SAMPLE_VALUES = 5
SAMPLE_CONTEXT_VALUES = 10


def written_numbers(text: Column) -> Column:
    """Every number written in the text, commas dropped; NULL entries for lone commas.

    Those are never cast: a cast that fails costs as much as many that do not.
    """
    found = F.regexp_extract_all(text, F.lit(WRITTEN_NUMBER), 0)
    return F.transform(found, lambda m: F.when(without(m, ",.") != "", without(m, ",").try_cast("double")))


def context_numbers(context: Column) -> Column:
    """Numbers of the context, also as percent, fraction, and scaled by a thousand."""
    scaled = F.transform(written_numbers(context), lambda n: F.array(n, n * 100, n / 100, n * 1000, n / 1000))
    return F.flatten(scaled)


def foreign_numbers(answer_text: Column, context: Column) -> Column:
    """Sorted distinct numbers of the answer that the context cannot explain; NULL without context."""
    low, high = FOREIGN_RANGE
    unexplained = F.array_except(written_numbers(answer_text), context_numbers(context))
    foreign = F.filter(unexplained, lambda n: (n > max(low, SMALLEST_NUMBER)) & (n < high) & ~n.isin(COMMON_NUMBERS))
    has_context = context.isNotNull() & ~context.isin("", "[]")
    return F.when(has_context, F.sort_array(foreign))


def _percent(value: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", value * 100)


def classify(rows: DataFrame) -> DataFrame:
    """Add `error`, a struct per row, by the first rule that applies.

    Order: failed execution, failed parsing, rounding, calculation, foreign numbers, unknown.
    Reads `execution_error, parse_status, predicted_text, predicted_num, truth_num,
    ground_truth, raw_response, executed_code, context`. Numbers are only extracted from
    text on rows that no earlier rule settled.
    """
    spread = F.col("deviation")
    no_answer = F.col("predicted_text").isNull() & F.col("predicted_num").isNull()
    ruled = rows.withColumn("deviation", number_deviation(F.col("predicted_num"), F.col("truth_num")))
    rule = (
        F.when(F.coalesce(F.col("execution_error"), F.lit("")) != "", dims.EXECUTION)
        .when((F.col("parse_status") == "failed") | no_answer, dims.PARSING)
        .when(spread < ROUNDING_LIMIT, dims.ROUNDING)
        .when(spread < CALCULATION_LIMIT, dims.CALCULATION)
    )
    ruled = ruled.withColumn("_rule", rule)
    # Worked out within the branch, for rows that no rule has settled.
    text = F.when(F.col("executed_code") != "", F.col("executed_code")).otherwise(F.col("raw_response"))
    searched = bind(ruled, {"_foreign": F.when(F.col("_rule").isNull(), foreign_numbers(text, F.col("context")))})
    many = F.size("_foreign") >= FOREIGN_MINIMUM
    settled = searched.withColumn(
        "_rule", F.coalesce(F.col("_rule"), F.when(many, dims.HALLUCINATION), F.lit(dims.UNKNOWN))
    )
    return settled.withColumn("error", _error_struct()).drop("_rule", "_foreign")


def _error_struct() -> Column:
    rule, spread, foreign = F.col("_rule"), F.col("deviation"), F.col("_foreign")
    predicted = F.coalesce(F.col("predicted_text"), F.col("predicted_num").cast("string"))
    failure = execution_error_type(F.col("execution_error"))

    def by_rule(choices: dict[str, Column]) -> Column:
        out = None
        for name, value in choices.items():
            out = F.when(rule == name, value) if out is None else out.when(rule == name, value)
        return out

    numeric_details = F.create_map(
        F.lit("predicted"), predicted,
        F.lit("ground_truth"), F.col("ground_truth"),
        F.lit("deviation_percent"), (spread * 100).cast("string"),
    )
    known = F.array_distinct(F.array_compact(context_numbers(F.col("context"))))
    context_sample = F.slice(F.sort_array(known), 1, SAMPLE_CONTEXT_VALUES)
    return F.struct(
        rule.alias("category"),
        by_rule(
            {
                dims.EXECUTION: F.lit(0.95),
                dims.PARSING: F.lit(0.95),
                dims.ROUNDING: F.lit(0.90),
                dims.CALCULATION: F.lit(0.70),
                dims.HALLUCINATION: F.lit(0.60),
                dims.UNKNOWN: F.lit(0.30),
            }
        ).alias("confidence"),
        by_rule(
            {
                dims.EXECUTION: F.concat(F.lit("POT code execution failed: "), failure),
                dims.PARSING: F.lit("Failed to parse answer from response"),
                dims.ROUNDING: F.concat(
                    F.lit("Answer within "), _percent(spread, 3), F.lit(" of ground truth (< 0.2% tolerance)")
                ),
                dims.CALCULATION: F.concat(
                    F.lit("Answer within "), _percent(spread, 1), F.lit(" of ground truth (likely calculation error)")
                ),
                dims.HALLUCINATION: F.concat(
                    F.lit("Found "), F.size(foreign).cast("string"), F.lit(" values in response not present in context")
                ),
                dims.UNKNOWN: F.lit("Could not automatically classify error - manual review needed"),
            }
        ).alias("evidence"),
        by_rule(
            {
                dims.EXECUTION: F.create_map(
                    F.lit("error_message"), F.col("execution_error"),
                    F.lit("error_type"), failure,
                    F.lit("executed_code"), F.col("executed_code"),
                ),
                dims.PARSING: F.create_map(
                    F.lit("raw_response_preview"), preview("raw_response", 200),
                    F.lit("parse_status"), F.col("parse_status"),
                ),
                dims.ROUNDING: numeric_details,
                dims.CALCULATION: numeric_details,
                dims.HALLUCINATION: F.create_map(
                    F.lit("hallucinated_values"), F.to_json(F.slice(foreign, 1, SAMPLE_VALUES)),
                    F.lit("context_values_sample"), F.to_json(context_sample),
                ),
                dims.UNKNOWN: numeric_details,
            }
        ).alias("details"),
        (rule != dims.UNKNOWN).alias("auto_classified"),
        F.lit(None).cast("string").alias("manual_override"),
    )


def classify_batch(runs: DataFrame, examples: DataFrame) -> DataFrame:
    """Classify the wrong rows of `runs`, with truth and context looked up by example id.

    Ids without an example get no truth and an empty context.
    """
    from rubricon.functions.numbers import to_number

    lookup = examples.select("example_id", "ground_truth", "context")
    rows = wrong_rows(runs.drop("ground_truth", "context")).join(lookup, "example_id", "left")
    rows = rows.withColumn("context", F.coalesce("context", F.lit(""))).withColumn(
        "truth_num", to_number("ground_truth", ",%")
    )
    return classify(rows)


def merge_analysis(runs: DataFrame, analyses: DataFrame) -> DataFrame:
    """Let a written analysis replace the category of routed rows.

    `analyses` holds one row per cell with `error_type, confidence, evidence`. The raw label
    becomes `error_category`; `mapped_category` is its place in the taxonomy.
    """
    a = analyses.select(
        *CELL,
        F.lower("error_type").alias("_category"),
        F.col("confidence").alias("_confidence"),
        F.col("evidence").alias("_evidence"),
    )
    # Both sides may hold many rows for each that was read: never gathered for a broadcast.
    joined = runs.join(a.hint("merge"), CELL, "left")
    routed = F.coalesce(F.col("error_category").isin(dims.ROUTED_CATEGORIES), F.lit(False)) & F.col("_category").isNotNull()

    def swap(new: str, old: str) -> Column:
        return F.when(routed, F.col(new)).otherwise(F.col(old))

    merged = joined.withColumns(
        {
            "error_confidence": swap("_confidence", "error_confidence"),
            "error_evidence": swap("_evidence", "error_evidence"),
            "error_category": swap("_category", "error_category"),
        }
    ).drop("_category", "_confidence", "_evidence")
    aliases = F.broadcast(dims.category_aliases(runs.sparkSession))
    return (
        merged.join(aliases, merged["error_category"] == aliases["label"], "left")
        .withColumn("mapped_category", F.coalesce("alias_of", "error_category"))
        .drop("label", "alias_of")
    )


def with_labels(rows: DataFrame) -> DataFrame:
    """Add icon, icon class, label and severity of `error_category`; unknown ones keep their name."""
    spark = rows.sparkSession
    key = F.replace(F.lower(F.coalesce("error_category", F.lit(dims.UNKNOWN))), F.lit(" "), F.lit("_"))
    labels = F.broadcast(dims.category_labels(spark).withColumnRenamed("category", "_label_key"))
    meta = F.broadcast(dims.categories(spark).select(F.col("category").alias("_meta_key"), "severity"))
    keyed = rows.withColumn("_key", key)
    return (
        keyed.join(labels, keyed["_key"] == labels["_label_key"], "left")
        .join(meta, keyed["_key"] == meta["_meta_key"], "left")
        .withColumns(
            {
                "icon": F.coalesce("icon", F.lit(dims.NO_ICON)),
                "icon_class": F.coalesce("icon_class", F.lit("unknown")),
                "label": F.coalesce("label", "error_category", F.lit(dims.NO_LABEL)),
                "severity": F.coalesce("severity", F.lit("medium")),
            }
        )
        .drop("_key", "_label_key", "_meta_key")
    )
