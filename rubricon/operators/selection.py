"""Choosing rows: samples, splits, models, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubricon import dims
from rubricon.operators.binding import bind
from rubricon.operators.positions import (
    BUCKET_WIDTH,
    bucket_of,
    bucket_offsets,
    first_per_key,
    running_totals,
)


def head(examples: DataFrame, limit: int | None, order: str = "pos") -> DataFrame:
    """The first `limit` rows by position (top-n, no full sort); all of them without a limit."""
    return examples.orderBy(order).limit(limit) if limit else examples


def of_level(examples: DataFrame, level: str | None) -> DataFrame:
    return examples.filter(F.col("level") == level) if level else examples


def stride_index(i: Column, n: int, total: Column) -> Column:
    """Index of the i-th of n evenly spaced picks out of `total` rows."""
    return F.when(total <= n, i).otherwise(F.floor(i * (total.cast("double") / F.lit(n)))).cast("bigint")


def stride_sample(examples: DataFrame, n: int, group: str = "level", order: str = "pos", width: int = BUCKET_WIDTH) -> DataFrame:
    """n evenly spaced rows per group with a 1-based `selection_index`.

    Bucket counts tell which buckets hold a pick; only their rows are numbered.
    """
    if n < 1:
        return examples.limit(0).withColumn("selection_index", F.lit(0))
    buckets = bucket_offsets(examples, [group], order, {}, width)
    total, start = F.col("_group_rows"), F.col("_n_before")
    end = start + F.col("_n")
    spacing = F.greatest(total.cast("double") / n, F.lit(1.0))
    low = F.greatest(F.floor(start / spacing) - 1, F.lit(0))
    high = F.least(F.ceil(end / spacing) + 1, F.lit(n), total) - 1
    near = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    inside = F.filter(
        F.transform(near, lambda i: F.struct(i.alias("i"), stride_index(i, n, total).alias("at"))),
        lambda p: (p["at"] >= start) & (p["at"] < end),
    )
    picks = bind(buckets, {"_picks": inside}).filter(F.size("_picks") > 0)
    picks = picks.select(F.col(group).alias("_g"), F.col("_bucket").alias("_b"), "_n_before", "_picks")
    keyed = examples.withColumn("_eb", bucket_of(order, width))
    near_rows = keyed.join(picks, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_eb") == F.col("_b")))
    inside_bucket = Window.partitionBy(group, "_eb").orderBy(order)
    numbered = near_rows.withColumn("_at", F.col("_n_before") + F.row_number().over(inside_bucket) - 1)
    hit = F.get(F.filter("_picks", lambda p: p["at"] == F.col("_at")), F.lit(0))
    chosen = numbered.withColumn("selection_index", hit["i"] + 1).filter(F.col("selection_index").isNotNull())
    return chosen.select(*examples.columns, "selection_index")


def combine(primary: DataFrame, *others: DataFrame) -> DataFrame:
    """Union of several sources, one row per `example_id`; earlier sources and positions win."""
    ranked = primary.withColumn("_source", F.lit(0))
    for i, other in enumerate(others, 1):
        ranked = ranked.unionByName(other.withColumn("_source", F.lit(i)), allowMissingColumns=True)
    return first_per_key(ranked, ["example_id"], F.col("_source"), F.col("pos")).drop("_source")


def last_by_id(splits: DataFrame, split_rank: Column) -> DataFrame:
    """One row per non-blank id; later splits and later positions replace earlier ones."""
    known = splits.filter(F.col("example_id").isNotNull() & (F.col("example_id") != ""))
    return first_per_key(known, ["example_id"], split_rank.desc(), F.col("pos").desc())


def merge_trace(examples: DataFrame, traces: DataFrame) -> DataFrame:
    """Attach `reasoning_trace` by question id; examples without one keep what they have."""
    t = traces.select("question_id", F.col("reasoning_trace").alias("_trace"))
    own = F.col("reasoning_trace") if "reasoning_trace" in examples.columns else F.lit(None)
    merged = examples.join(t, "question_id", "left").withColumn("reasoning_trace", F.coalesce(F.col("_trace"), own))
    return merged.drop("_trace")


# --- models ----------------------------------------------------------------------------


def with_model_type(runs: DataFrame, unknown_as: str | None = dims.GENERAL) -> DataFrame:
    """Add `model_type` from the registry. Models outside it count as `unknown_as`,
    or are left out when that is None."""
    registry = F.broadcast(dims.models(runs.sparkSession).select("model_name", "model_type"))
    if unknown_as is None:
        return runs.join(registry, "model_name")
    return runs.join(registry, "model_name", "left").withColumn(
        "model_type", F.coalesce("model_type", F.lit(unknown_as))
    )


def of_model_type(runs: DataFrame, model_type: str) -> DataFrame:
    return with_model_type(runs, None).filter(F.col("model_type") == model_type)


def of_budget_set(runs: DataFrame, set_name: str) -> DataFrame:
    members = dims.budget_sets(runs.sparkSession).filter(F.col("set_name") == set_name)
    return runs.join(F.broadcast(members.select("model_name")), "model_name", "left_semi")


def model_availability(requested: DataFrame, providers_with_key: list[str]) -> DataFrame:
    """Add `status` to requested models: available, no_key, or unknown."""
    registry = F.broadcast(dims.models(requested.sparkSession).select("model_name", "provider"))
    known = requested.drop("provider").join(registry, "model_name", "left")
    return known.withColumn(
        "status",
        F.when(F.col("provider").isNull(), "unknown")
        .when(F.col("provider").isin(providers_with_key), "available")
        .otherwise("no_key"),
    )


OVERRIDABLE = ["provider", "model_id", "max_tokens", "temperature", "price"]


def model_overrides(config: DataFrame, overrides: DataFrame, any_overrides: bool, single: bool = False) -> DataFrame:
    """Default model settings patched by an override row of the same model.

    With any override present only overridden models stay. A provider outside the known
    ones is ignored. The bulk form takes limits as given but no price; the single-model
    form takes limits only along with a known provider, and prices always.
    """
    o = overrides.select("model_name", *[F.col(c).alias(f"_{c}") for c in OVERRIDABLE])
    joined = config.join(F.broadcast(o), "model_name", "inner" if any_overrides else "left")
    known = F.coalesce(F.col("_provider").isin(dims.PROVIDERS), F.lit(False))
    limits = known if single else F.lit(True)

    def patch(column: str, allowed: Column) -> Column:
        return F.when(allowed & F.col(f"_{column}").isNotNull(), F.col(f"_{column}")).otherwise(F.col(column))

    allowed = {
        "provider": known,
        "model_id": F.lit(True),
        "max_tokens": limits,
        "temperature": limits,
        "price": F.lit(single),
    }
    return joined.withColumns({c: patch(c, a) for c, a in allowed.items()}).drop(*[f"_{c}" for c in OVERRIDABLE])


# --- budgets ---------------------------------------------------------------------------


def budget_guard(
    calls: DataFrame,
    group: list[str],
    order: str,
    cost: str,
    tokens: str,
    max_cost: int | None = None,
    max_tokens: int | None = None,
    stop: bool = True,
) -> DataFrame:
    """Running cost and token totals per group; with `stop`, rows behind the first one that
    goes over a limit are dropped (that row itself stays, marked `over_budget`)."""
    totals = running_totals(calls, group, order, {"total_cost": cost, "total_tokens": tokens})

    def over(cost_total: Column, token_total: Column) -> Column:
        hit = F.lit(False)
        if max_cost:
            hit = hit | (cost_total > max_cost)
        if max_tokens:
            hit = hit | (token_total > max_tokens)
        return hit

    marked = totals.withColumn("over_budget", over(F.col("total_cost"), F.col("total_tokens")))
    if not stop:
        return marked
    before = over(F.col("total_cost") - F.col(cost), F.col("total_tokens") - F.col(tokens))
    return marked.filter(~before)


def progress(calls: DataFrame, order: str, cost: str, every: int = 5) -> DataFrame:
    """Every `every`-th row with its number, the table's row count and the cost so far."""
    totals = running_totals(calls, [], order, {"total_cost": cost})
    return totals.filter(F.col("row_no") % every == 0)


# --- rows by outcome -------------------------------------------------------------------


def wrong_rows(runs: DataFrame) -> DataFrame:
    return runs.filter(~F.col("is_correct"))


def problem_filter(cards: DataFrame, which: str) -> DataFrame:
    """Cards by button: `all`, `wrong` (any wrong answer), or a level name."""
    if which == "all":
        return cards
    return cards.filter(F.col("has_wrong")) if which == "wrong" else cards.filter(F.col("level") == which)


def needs_analysis(runs: DataFrame) -> DataFrame:
    """Wrong rows whose category goes on to a written analysis."""
    return runs.filter(F.col("error_category").isin(dims.ROUTED_CATEGORIES))
