"""Row numbers and running totals over large or unevenly sized groups.

Groups of ordinary size take a plain window: one exchange. Groups that are counted to have more
rows than a bucket is wide, and whole tables, are cut into position buckets. Bucket totals are
summed up a tree of `FANOUT` children a node; a node's starting point is that of its parent plus
its elder siblings' totals. So windows span a bucket's rows or a node's children, and no task
holds all totals of a table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rubricon.functions.text import int_div

BUCKET_WIDTH = 65_536
FANOUT = 4096


def bucket_of(order: str, width: int = BUCKET_WIDTH) -> Column:
    return int_div(F.col(order), width)


def _same(left: list[str], right: str) -> Column:
    """Equality of columns and their namesakes with the prefix `right`, nulls included."""
    match = F.lit(True)
    for c in left:
        match = match & F.col(c).eqNullSafe(F.col(f"{right}{c}"))
    return match


def _started(totals: DataFrame, group: list[str], values: list[str], last: int) -> DataFrame:
    """Adds to nodes (`_node`, from 0 to `last`) the sums of all nodes before them in their group
    (`_before_*`) and the group's rows."""
    placed = totals.withColumn("_parent", int_div(F.col("_node"), FANOUT))
    siblings = Window.partitionBy(*group, "_parent")
    elder = siblings.orderBy("_node").rowsBetween(Window.unboundedPreceding, -1)
    own = {f"_before_{v}": F.coalesce(F.sum(v).over(elder), F.lit(0)) for v in values}
    if last < FANOUT:
        return placed.withColumns({**own, "_group_rows": F.sum("_n").over(siblings)}).drop("_parent")
    parents = placed.groupBy(*group, F.col("_parent").alias("_node")).agg(*[F.sum(v).alias(v) for v in values])
    above = _started(parents, group, values, last // FANOUT)
    above = above.select(
        *[F.col(g).alias(f"_p_{g}") for g in group],
        F.col("_node").alias("_p__parent"),
        "_group_rows",
        *[F.col(f"_before_{v}").alias(f"_above_{v}") for v in values],
    )
    joined = placed.withColumns(own).join(above, _same([*group, "_parent"], "_p_"))
    return joined.select(
        *totals.columns, "_group_rows", *[(F.col(f"_before_{v}") + F.col(f"_above_{v}")).alias(f"_before_{v}") for v in values]
    )


def bucket_offsets(df: DataFrame, group: list[str], order: str, sums: dict[str, str], width: int = BUCKET_WIDTH) -> DataFrame:
    """Per (group, bucket): rows and sums before it, rows inside it, rows of the group."""
    last = df.agg(F.max(bucket_of(order, width)).alias("last")).first()["last"] or 0
    per_bucket = df.groupBy(*group, bucket_of(order, width).alias("_node")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_s_{out}") for out, c in sums.items()]
    )
    started = _started(per_bucket, group, ["_n", *[f"_s_{out}" for out in sums]], last)
    return started.select(
        *group,
        F.col("_node").alias("_bucket"),
        "_n",
        F.col("_before__n").alias("_n_before"),
        "_group_rows",
        *[F.col(f"_before__s_{out}").alias(f"_before_{out}") for out in sums],
    )


def _totals_by_bucket(df: DataFrame, group: list[str], order: str, sums: dict[str, str], width: int) -> DataFrame:
    offsets = bucket_offsets(df, group, order, sums, width)
    keyed = df.withColumn("_bucket", bucket_of(order, width))
    renamed = offsets.withColumnsRenamed({c: f"_g_{c}" for c in [*group, "_bucket"]})
    inside = Window.partitionBy(*group, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return keyed.join(renamed, _same([*group, "_bucket"], "_g_")).select(
        *df.columns,
        (F.col("_n_before") + F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(order))).alias("row_no"),
        F.col("_group_rows").alias("group_rows"),
        *[(F.col(f"_before_{out}") + F.sum(c).over(inside)).alias(out) for out, c in sums.items()],
    )


def running_totals(
    df: DataFrame,
    group: list[str],
    order: str,
    sums: dict[str, str] | None = None,
    width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Add `row_no` (from 1), `group_rows` and one inclusive running total per entry of `sums`.

    `order` must be an integer that is unique within its group, so that a bucket holds at
    most `width` rows. Use integer measures: their totals do not depend on summation order.
    """
    sums = sums or {}
    if not group:
        return _totals_by_bucket(df, group, order, sums, width)
    # At most one group in `width` rows is that large.
    large = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > width)
    large = large.select(*[F.col(g).alias(f"_l_{g}") for g in group])
    some = not large.isEmpty()
    ordinary = df.join(F.broadcast(large), _same(group, "_l_"), "left_anti") if some else df
    every = Window.partitionBy(*group)
    so_far = every.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ordinary.select(
        *df.columns,
        F.row_number().over(every.orderBy(order)).cast("bigint").alias("row_no"),
        F.count(F.lit(1)).over(every).alias("group_rows"),
        *[F.sum(c).over(so_far).alias(out) for out, c in sums.items()],
    )
    if not some:
        return totals
    cut = df.join(F.broadcast(large), _same(group, "_l_"), "left_semi")
    return totals.unionByName(_totals_by_bucket(cut, group, order, sums, width))


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first by `order`. The rank limit is applied before the shuffle,
    so a key that holds most of the table still ships at most one row per task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], k: int, *order: Column, rank_name: str = "rank") -> DataFrame:
    """At most `k` rows per key with their rank; the limit is applied before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank_name, rank).filter(F.col(rank_name) <= k)
