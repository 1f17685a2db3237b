"""Accuracy, cost and error breakdowns.

Most reports start from `summary_cells`: one pass that folds all runs into a small table
by model, method, level, type and category. Its size depends on the number of models and
categories, not on the number of runs, so everything behind it is cheap and no key can
be hot after the map-side fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricon import dims
from rubricon.functions.numbers import percent
from rubricon.operators.positions import top_per_key

CELL_KEYS = ["model_name", "method", "level", "model_type", "error_category"]


def counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("total"), F.count_if("is_correct").alias("correct")]


def dollars(micros: Column) -> Column:
    return (F.coalesce(micros, F.lit(0)) / F.lit(1_000_000.0)).alias("cost")


def accuracy(digits: int = 6) -> Column:
    return F.round(percent(F.col("correct"), F.col("total")), digits).alias("accuracy")


def summary_cells(scored: DataFrame) -> DataFrame:
    """Runs folded to one row per combination of the report dimensions they have.

    Reports without error categories can start from unclassified runs.
    """
    keys = [c for c in CELL_KEYS if c in scored.columns]
    return scored.groupBy(*keys).agg(*counts(), F.sum("cost_micros").alias("cost_micros"))


def roll(cells: DataFrame, *keys: str) -> DataFrame:
    """Total, correct, cost and accuracy of the cells by `keys`."""
    summed = cells.groupBy(*keys).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("correct"), F.lit(0)).alias("correct"),
        F.sum("cost_micros").alias("_micros"),
    )
    return summed.select(*keys, "total", "correct", dollars(F.col("_micros")), accuracy())


def overall(cells: DataFrame) -> DataFrame:
    return roll(cells).select("total", "correct", (F.col("total") - F.col("correct")).alias("incorrect"), "accuracy")


def by_model_method(cells: DataFrame) -> DataFrame:
    return roll(cells, "model_name", "method").withColumn("accuracy_1", F.round("accuracy", 1))


def by_model(cells: DataFrame) -> DataFrame:
    return roll(cells, "model_name")


def by_level(cells: DataFrame) -> DataFrame:
    """Easy, medium and hard, also where a level has no rows."""
    found = roll(cells, "level").drop("cost")
    return _filled(dims.levels(cells.sparkSession).select("level"), found, "level")


def _filled(dimension: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Every row of a small dimension, with zeroes where nothing was found."""
    joined = dimension.join(found, key, "left")
    return joined.select(key, *[F.coalesce(c, F.lit(0)).alias(c) for c in found.columns if c != key])


def model_level(cells: DataFrame) -> DataFrame:
    return roll(cells, "model_name", "level").drop("cost")


def model_level_pivot(cells: DataFrame) -> DataFrame:
    """One row per model with correct and total counts of each level side by side."""
    wide = []
    for level in dims.LEVELS:
        here = F.col("level") == level
        wide.append(F.coalesce(F.sum(F.when(here, F.col("correct"))), F.lit(0)).alias(f"{level}_correct"))
        wide.append(F.coalesce(F.sum(F.when(here, F.col("total"))), F.lit(0)).alias(f"{level}_total"))
    return cells.groupBy("model_name").agg(*wide)


def by_model_type(cells: DataFrame) -> DataFrame:
    """General and reasoning models, also where one of them has no rows."""
    found = roll(cells, "model_type").drop("cost")
    return _filled(dims.model_types(cells.sparkSession).select("model_type"), found, "model_type")


def _error_cells(cells: DataFrame) -> DataFrame:
    """Wrong and classified cells only, with their row count as `errors`."""
    return cells.filter(F.col("error_category").isNotNull() & (F.col("total") > F.col("correct"))).withColumn(
        "errors", F.col("total") - F.col("correct")
    )


def error_distribution(cells: DataFrame) -> DataFrame:
    counted = _error_cells(cells).groupBy("error_category").agg(F.sum("errors").alias("errors"))
    return counted.orderBy(F.desc("errors"), "error_category")


def error_distribution_full(cells: DataFrame) -> DataFrame:
    """All categories of the taxonomy, zero where nothing fell into one."""
    found = _error_cells(cells).groupBy("error_category").agg(F.sum("errors").alias("errors"))
    taxonomy = dims.categories(cells.sparkSession).select(F.col("category").alias("error_category"))
    return _filled(taxonomy, found, "error_category")


def model_errors(cells: DataFrame) -> DataFrame:
    """Error counts per model and category; models with an error get every category."""
    names = [c[0] for c in dims.CATEGORIES]
    here = F.col("error_category")
    wide = _error_cells(cells).groupBy("model_name").agg(
        *[F.coalesce(F.sum(F.when(here == c, F.col("errors"))), F.lit(0)).alias(c) for c in names]
    )
    pairs = F.array(*[F.struct(F.lit(c).alias("error_category"), F.col(c).alias("errors")) for c in names])
    return wide.select("model_name", F.inline(pairs))


def model_error_map(cells: DataFrame) -> DataFrame:
    """Per model and method a MAP of category → count (at most one entry per category)."""
    errors = _error_cells(cells).groupBy("model_name", "method", "error_category").agg(F.sum("errors").alias("errors"))
    entry = F.struct("error_category", "errors")
    return errors.groupBy("model_name", "method").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("errors"))


def top_errors(cells: DataFrame, k: int = 5) -> DataFrame:
    """The most frequent categories per model type."""
    counted = _error_cells(cells).groupBy("model_type", "error_category").agg(F.sum("errors").alias("errors"))
    return top_per_key(counted, ["model_type"], k, F.desc("errors"), F.col("error_category"))


def leaderboard(cells: DataFrame) -> DataFrame:
    return by_model(cells).orderBy(F.desc("accuracy"), "model_name")


def pot_series(cells: DataFrame) -> DataFrame:
    """Accuracy per model over POT runs only."""
    return roll(cells.filter(F.col("method") == "POT"), "model_name").select("model_name", "total", "correct", "accuracy")


CUBE_SETS = {
    "overall": [],
    "model_method": ["model_name", "method"],
    "level": ["level"],
    "model_type": ["model_type"],
    "error_category": ["error_category"],
}


def report_cube(cells: DataFrame) -> DataFrame:
    """Every breakdown in one table; `section` names the grouping set of a row."""
    grouped = cells.groupingSets([[F.col(k) for k in keys] for keys in CUBE_SETS.values()], *CELL_KEYS).agg(
        F.grouping_id(*CELL_KEYS).alias("_gid"),
        F.sum("total").alias("total"),
        F.sum("correct").alias("correct"),
        F.sum("cost_micros").alias("_micros"),
    )
    section = None
    for name, keys in CUBE_SETS.items():
        gid = sum(1 << (len(CELL_KEYS) - 1 - i) for i, c in enumerate(CELL_KEYS) if c not in keys)
        section = F.when(F.col("_gid") == gid, name) if section is None else section.when(F.col("_gid") == gid, name)
    return grouped.select(
        section.alias("section"), *CELL_KEYS, "total", "correct", dollars(F.col("_micros")), accuracy()
    )


# --- per example -----------------------------------------------------------------------


def problem_cards(scored: DataFrame) -> DataFrame:
    """One card per example: score, state, and its results as sorted text.

    Results are folded by model and method first, so a card lists at most one entry per
    cell of the grid however often a cell was run.
    """
    cells = scored.groupBy("example_id", "level", "model_name", "method").agg(*counts())
    entry = F.concat_ws(":", "model_name", "method", F.concat_ws("/", F.col("correct").cast("string"), F.col("total").cast("string")))
    cards = cells.groupBy("example_id", "level").agg(
        F.sum("total").alias("total"),
        F.sum("correct").alias("correct"),
        F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("results"),
    )
    return cards.select(
        "example_id",
        "level",
        "total",
        "correct",
        F.when(F.col("correct") == F.col("total"), "all-correct")
        .when(F.col("correct") == 0, "all-wrong")
        .otherwise("mixed")
        .alias("state"),
        (F.col("correct") > F.col("total") / 2).alias("majority"),
        (F.col("correct") < F.col("total")).alias("has_wrong"),
        "results",
    )


def distinct_positions(position: Column | str) -> tuple[Column, Column]:
    """(group to count in, aggregate) for an exact distinct count of an integer: a bitmap per 32,768
    neighbouring values, merged before the shuffle. Sum `bitmap_count` over the groups."""
    return F.bitmap_bucket_number(position), F.bitmap_construct_agg(F.bitmap_bit_position(position))


def report_totals(scored: DataFrame, position: str = "pos") -> DataFrame:
    """Totals of a report. `position` is the integer that an example has in its question set."""
    bucket, bitmap = distinct_positions(position)
    parts = scored.groupBy(bucket.alias("_bucket")).agg(
        bitmap.alias("_seen"),
        F.array_sort(F.collect_set("model_name")).alias("_models"),
        F.count(F.lit(1)).alias("_rows"),
        F.count_if("is_correct").alias("_correct"),
        F.sum("cost_micros").alias("cost_micros"),
    )
    return parts.agg(
        F.coalesce(F.sum(F.bitmap_count("_seen")), F.lit(0)).alias("examples"),
        F.size(F.array_distinct(F.flatten(F.collect_set("_models")))).cast("bigint").alias("models"),
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("evaluations"),
        F.coalesce(F.sum("_correct"), F.lit(0)).alias("correct"),
        dollars(F.sum("cost_micros")),
    )


def cost_totals(responses: DataFrame) -> DataFrame:
    """Tokens and cost per example over its successful responses."""
    done = responses.filter(F.col("parse_status") == "success")
    return done.groupBy("example_id").agg(
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("total_tokens"),
        dollars(F.sum("cost_micros")),
    )


# --- curated cases ---------------------------------------------------------------------


def by_error_type(paper_runs: DataFrame) -> DataFrame:
    key = F.coalesce("paper_error_type", F.lit("Unknown")).alias("error_type")
    return paper_runs.groupBy(key).agg(*counts()).select("error_type", "total", "correct", accuracy(1))


def by_table(paper_runs: DataFrame) -> DataFrame:
    """Per paper table (0 when there is none), with the first error type by position.

    Runs are folded by error type first: a smallest text can't be kept in a hash table, so that
    all runs would be sorted for it; a smallest position can.
    """
    key = F.coalesce("paper_table", F.lit(0)).alias("table_no")
    cells = paper_runs.groupBy(key, "paper_error_type").agg(*counts(), F.min("pos").alias("_pos"))
    grouped = cells.groupBy("table_no").agg(
        F.sum("total").alias("total"), F.sum("correct").alias("correct"), F.min_by("paper_error_type", "_pos").alias("error_type")
    )
    return grouped.select("table_no", "error_type", "total", "correct", accuracy(1)).orderBy("table_no")


# --- data sets -------------------------------------------------------------------------


def dataset_stats(examples: DataFrame) -> DataFrame:
    """Row counts: in all, per known level (zero when absent), and per source."""
    spark = examples.sparkSession
    cells = examples.groupBy("level", "source").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.groupingSets([[], ["level"], ["source"]], "level", "source").agg(
        F.grouping_id("level", "source").alias("_gid"), F.sum("n").alias("n")
    )
    section = F.when(F.col("_gid") == 3, "total").when(F.col("_gid") == 1, "level").otherwise("source")
    found = rows.select(section.alias("section"), F.coalesce("level", "source", F.lit("all")).alias("name"), "n")
    known = found.filter((F.col("section") != "level") | F.col("name").isin(dims.LEVELS))
    empty = dims.levels(spark).select(F.lit("level").alias("section"), F.col("level").alias("name"), F.lit(0).cast("bigint").alias("n"))
    return known.unionByName(empty).groupBy("section", "name").agg(F.sum("n").alias("n"))


def prompt_size_delta(sizes: DataFrame) -> DataFrame:
    """How much longer prompts with retrieved functions are than plain ones."""
    delta = F.col("rag_chars") - F.col("plain_chars")
    return sizes.agg(
        F.count(F.lit(1)).alias("prompts"),
        F.round(F.avg(delta), 6).alias("avg_delta"),
        F.max(delta).alias("max_delta"),
        F.count_if(delta > 0).alias("longer"),
    )
