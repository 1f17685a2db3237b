"""The evaluation grid and the responses that fill it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = ["example_id", "model_name", "method"]


def evaluation_grid(examples: DataFrame, models: list[str], methods: list[str]) -> DataFrame:
    """One row per example, model and method, made inside the row from the two short lists."""
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("model_rank"), F.lit(m).alias("model_name"), F.lit(method).alias("method"))
            for i, m in enumerate(models)
            for method in methods
        ]
    )
    return examples.select("*", F.inline(cells))


def fill_grid(grid: DataFrame, responses: DataFrame) -> DataFrame:
    """Attach responses; cells without one become failed rows that cost nothing.

    Both sides may hold many rows for each row that was read, which the optimizer's size estimates
    do not see: it would gather the responses on the driver to broadcast them. They are always
    merged, and a flag tells what is missing, so that texts are only moved for those who read them.

    Both are shuffled by example alone: its cells stay together, and rows that repeat an id and much
    of a text are written as a fraction of what they take apart. Model and method are compared from
    both sides, for the optimizer would shuffle by what it knows to be equal.
    """
    told = responses.withColumn("_told", F.col("raw_response").isNotNull())
    told = told.withColumnsRenamed({c: f"_of_{c}" for c in CELL})
    example, *others = CELL
    same = F.col(example) == F.col(f"_of_{example}")
    for c in others:
        same = same & (F.col(c) <= F.col(f"_of_{c}")) & (F.col(c) >= F.col(f"_of_{c}"))
    joined = grid.select(*CELL, *[c for c in grid.columns if c not in CELL]).join(told.hint("merge"), same, "left")
    joined = joined.drop(*[f"_of_{c}" for c in CELL])
    missing = ~F.coalesce("_told", F.lit(False))
    return joined.withColumns(
        {
            "parse_status": F.when(missing, "failed").otherwise("success"),
            "raw_response": F.coalesce("raw_response", F.lit("no response")),
            "prompt_tokens": F.coalesce("prompt_tokens", F.lit(0)),
            "completion_tokens": F.coalesce("completion_tokens", F.lit(0)),
        }
    ).drop("_told")


def pass_failed(responses: DataFrame) -> DataFrame:
    """Split off what parsing must not touch: failed responses carry their text as `error`."""
    failed = F.col("parse_status") != "success"
    return responses.withColumn("error", F.when(failed, F.col("raw_response"))).withColumn(
        "content", F.when(~failed, F.col("raw_response"))
    )
