"""Fixed lookup tables: model registry, prices, error categories, curated cases.

All of them have a constant number of rows, so joining them by broadcast is safe at
any data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values ----------------------------------------------------------------------

LEVELS = ["easy", "medium", "hard"]
METHODS = ["COT", "POT"]
GENERAL, REASONING = MODEL_TYPES = ["general", "reasoning"]

# name, display name, provider, type, $ per million input tokens, $ per million output tokens
MODELS = [
    ("gpt-4o", "GPT-4o", "openai", GENERAL, "2.500", "10.000"),
    ("gpt-4o-mini", "GPT-4o Mini", "openai", GENERAL, "0.150", "0.600"),
    ("claude-sonnet-4", "Claude Sonnet 4", "anthropic", GENERAL, "3.000", "15.000"),
    ("claude-haiku-4", "Claude 3 Haiku", "anthropic", GENERAL, "0.250", "1.250"),
    ("gemini-2.5-flash", "Gemini 2.0 Flash", "google", GENERAL, "0.075", "0.300"),
    ("gemini-2.0-flash", "Gemini 2.0 Flash Exp", "google", GENERAL, "0.075", "0.300"),
    ("gpt-o1", "GPT o1", "openai", REASONING, "15.000", "60.000"),
    ("gpt-o1-mini", "GPT o1 Mini", "openai", REASONING, "1.100", "4.400"),
    ("claude-opus-4", "Claude Opus 4", "anthropic", REASONING, "15.000", "75.000"),
    ("gemini-2.5-pro", "Gemini 2.5 Pro", "google", REASONING, "1.250", "10.000"),
]

BUDGET_SETS = {
    "economic": ["gpt-4o-mini", "claude-haiku-4", "gemini-2.5-flash"],
    "balanced": ["gpt-4o", "claude-sonnet-4", "gemini-2.5-pro"],
    "full": [
        "gpt-4o-mini",
        "gpt-4o",
        "gpt-o1-mini",
        "claude-haiku-4",
        "claude-sonnet-4",
        "gemini-2.5-flash",
        "gemini-2.5-pro",
    ],
}

# model, provider, provider's model id, output token limit, blended $ per million tokens, temperature
BLENDED_PRICES = [
    ("gpt-5-2025-08-07", "openai", "gpt-5-2025-08-07", 128000, "15.000", None),
    ("gpt-4o-mini", "openai", "gpt-4o-mini", 128000, "0.150", None),
    ("gpt-4o", "openai", "gpt-4o", 128000, "2.500", None),
    ("claude-sonnet-4.5", "anthropic", "claude-sonnet-4-5-20250929", 64000, "3.000", 1.0),
    ("claude-opus-4.5", "anthropic", "claude-opus-4-5-20251101", 64000, "25.000", 1.0),
    ("claude-haiku-4.5", "anthropic", "claude-haiku-4-5-20251001", 64000, "5.000", 1.0),
    ("claude-opus-4.1", "anthropic", "claude-opus-4-1-20250805", 32000, "15.000", 1.0),
    ("claude-sonnet-4", "anthropic", "claude-sonnet-4-20250514", 64000, "3.000", 1.0),
    ("claude-3-haiku", "anthropic", "claude-3-haiku-20240307", 4096, "0.250", 1.0),
    ("gemini-2.5-pro", "google", "gemini-2.5-pro", 1000000, "2.500", 1.0),
    ("gemini-2.0-flash", "google", "gemini-2.0-flash", 1000000, "0.075", 1.0),
    ("gemini-2.5-flash", "google", "gemini-2.5-flash", 1000000, "0.075", 1.0),
]
PROVIDERS = ["openai", "anthropic", "google"]

EXECUTION, PARSING, ROUNDING = "execution_error", "parsing_error", "rounding_error"
CALCULATION, HALLUCINATION, UNKNOWN = "numerical_calculation_error", "hallucination", "unknown"

# category, paper table, description, example ids, found automatically, severity
CATEGORIES = [
    ("misunderstanding_of_problem", 6, "Model misunderstands the problem requirements", "test-2164", False, "high"),
    ("formula_application_error", 7, "Model applies incorrect formula or equation", "test-2162", False, "high"),
    ("numerical_extraction_error", 8, "Model extracts wrong numerical values from context", "test-2017", True, "medium"),
    (CALCULATION, 9, "Model makes arithmetic calculation mistakes", "test-2208", True, "medium"),
    ("unsolvable_problem", 10, "Problem is unsolvable with given information", "test-114", False, "low"),
    ("ambiguous_statement", 11, "Problem statement is ambiguous", "test-142", False, "low"),
    ("oversimplified_process", 12, "Solution process is oversimplified", "validation-24", False, "medium"),
    ("incorrect_answer", 13, "Ground truth answer is incorrect", "test-8", False, "low"),
    ("relaxed_evaluation", 14, "Evaluation criteria too relaxed", "validation-68", True, "low"),
    (EXECUTION, None, "POT code execution failed", None, True, "high"),
    (PARSING, None, "Response parsing failed", None, True, "high"),
    (ROUNDING, None, "Answer within 0.2% tolerance", None, True, "low"),
    (HALLUCINATION, None, "Used values not present in context", None, True, "high"),
    (UNKNOWN, None, "Unclassified error", None, False, "medium"),
]

# label of a written analysis (lower case) → category of the taxonomy
CATEGORY_ALIASES = [
    ("misunderstanding", "misunderstanding_of_problem"),
    ("formula_error", "formula_application_error"),
    ("extraction_error", "numerical_extraction_error"),
    ("calculation_error", CALCULATION),
    ("unit_error", "numerical_extraction_error"),
    ("logic_error", "formula_application_error"),
    ("incomplete", "oversimplified_process"),
]

# category or analysis label → icon, icon class, label
CATEGORY_LABELS = [
    ("formula_error", "🔢", "formula", "수식 오류"),
    ("misunderstanding", "🤔", "misunderstanding", "문제 이해 오류"),
    ("calculation_error", "🧮", "calculation", "계산 오류"),
    (CALCULATION, "🧮", "calculation", "수치 계산 오류"),
    ("extraction_error", "📊", "extraction", "값 추출 오류"),
    ("unit_error", "📏", "unit", "단위 오류"),
    (EXECUTION, "⚠️", "execution", "실행 오류"),
    ("logic_error", "🔗", "formula", "논리 오류"),
    ("incomplete", "⏳", "unknown", "불완전한 풀이"),
    (UNKNOWN, "❓", "unknown", "미분류"),
]
NO_ICON = "❓"
NO_LABEL = "미분류"

# id, paper table, error type, description, source set
PAPER_CASES = [
    ("test-2164", 6, "Misunderstanding of Problem", "DeepSeek-R1 misunderstands the problem requirements", "hard"),
    ("test-2162", 7, "Formula Application Error", "DeepSeek-R1 applies incorrect formula", "hard"),
    ("test-2017", 8, "Numerical Extraction Error", "DeepSeek-R1 extracts wrong numerical values", "hard"),
    ("test-2208", 9, "Numerical Calculation Error", "DeepSeek-R1 makes calculation mistakes", "hard"),
    ("test-114", 10, "Unsolvable Problem", "Original CodeFinQA problem was unsolvable", "CodeFinQA"),
    ("test-142", 11, "Ambiguous Statement", "CodeTAT-QA problem had ambiguous phrasing", "CodeTAT-QA"),
    ("validation-24", 12, "Oversimplified Process", "FinanceMath had oversimplified solution process", "FinanceMath"),
    ("test-8", 13, "Incorrect Answer", "FinCode had incorrect ground truth answer", "FinCode"),
    ("validation-68", 14, "Relaxed Evaluation", "FinanceMath had relaxed evaluation criteria", "FinanceMath"),
]

# categories sent on to a written analysis
ROUTED_CATEGORIES = [UNKNOWN, CALCULATION]


# --- as DataFrames ---------------------------------------------------------------------


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table as a local relation, whose exact size the optimizer knows."""
    values = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    fields = [f.strip().split(" ", 1) for f in schema.split(";")]
    names = ", ".join(name for name, _ in fields)
    casts = ", ".join(f"CAST({name} AS {kind}) AS {name}" for name, kind in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")


def models(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(MODELS)]
    return literal_table(
        spark,
        rows,
        "ord INT; model_name STRING; display_name STRING; provider STRING; model_type STRING; "
        "price_in DECIMAL(10,3); price_out DECIMAL(10,3)",
    )


def budget_sets(spark: SparkSession) -> DataFrame:
    rows = [(name, model) for name, members in BUDGET_SETS.items() for model in members]
    return literal_table(spark, rows, "set_name STRING; model_name STRING")


def blended_prices(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(BLENDED_PRICES)]
    return literal_table(
        spark,
        rows,
        "ord INT; model_name STRING; provider STRING; model_id STRING; max_tokens INT; "
        "price DECIMAL(10,3); temperature DOUBLE",
    )


def categories(spark: SparkSession) -> DataFrame:
    rows = [(i, *row) for i, row in enumerate(CATEGORIES)]
    return literal_table(
        spark,
        rows,
        "ord INT; category STRING; paper_table INT; description STRING; example_id STRING; "
        "auto_detectable BOOLEAN; severity STRING",
    )


def category_aliases(spark: SparkSession) -> DataFrame:
    return literal_table(spark, CATEGORY_ALIASES, "label STRING; alias_of STRING")


def category_labels(spark: SparkSession) -> DataFrame:
    return literal_table(spark, CATEGORY_LABELS, "category STRING; icon STRING; icon_class STRING; label STRING")


def paper_cases(spark: SparkSession) -> DataFrame:
    return literal_table(
        spark,
        PAPER_CASES,
        "case_id STRING; paper_table INT; paper_error_type STRING; paper_description STRING; paper_source STRING",
    )


def levels(spark: SparkSession) -> DataFrame:
    return literal_table(spark, list(enumerate(LEVELS)), "ord INT; level STRING")


def model_types(spark: SparkSession) -> DataFrame:
    return literal_table(spark, list(enumerate(MODEL_TYPES)), "ord INT; model_type STRING")
