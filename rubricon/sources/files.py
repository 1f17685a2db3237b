"""Question sets and function libraries from JSON.

Two layouts are read:

* `array` – one JSON array (or a single object, taken as a one-row list) per file, indented or
  not, the form data sets are published in.
* `lines` – one object per line. Records may carry their position as `pos`.

In both, large files are split between tasks. `pos` stands for list order, which a DataFrame does
not have. It is unique, follows the file's path, then the place in the file, and does not depend
on how Spark packs files into tasks. A file that is broken or in the other layout raises; only where
`skip_broken` is asked for are single broken lines left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricon.dims import LEVELS
from rubricon.operators.selection import combine, head, of_level

from rubricon.schemas import EXAMPLE_COLUMNS, RAW_EXAMPLE, RAW_FUNCTION, TRACE, TRACED_ITEM
from rubricon.sources.arrays import array_records

LAYOUTS = ("array", "lines")


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _in_file_order(rows: DataFrame, place: Column) -> DataFrame:
    """Rows with `pos` from `place` within their file, files following each other by path."""
    names = sorted(rows.inputFiles())
    if len(names) == 1:
        return rows.withColumn("pos", place)
    ranks = rows.sparkSession.createDataFrame(list(enumerate(names)), "_rank BIGINT, _file STRING")
    ranked = rows.withColumns({"_file": F.input_file_name(), "pos": place}).join(F.broadcast(ranks), "_file", "left")
    return ranked.withColumn("pos", F.shiftleft("_rank", 44) + F.col("pos")).drop("_file", "_rank")


def _checked(good: Column, what: str) -> Column:
    return F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(what), F.input_file_name())).cast("boolean"))


def _read_lines(spark: SparkSession, path: str, fields: str, skip_broken: bool) -> DataFrame:
    # Lines are shorter than splits are long, so a split's start plus the row's number in its task
    # is unique in a file and rises along it.
    row_in_task = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_start"))
    rows = _in_file_order(rows, F.col("_start") + row_in_task).filter(F.trim("value") != "")
    parsed = F.from_json("value", f"pos BIGINT, {fields}, _broken STRING", {"columnNameOfCorruptRecord": "_broken"})
    rows = rows.withColumn("r", parsed)
    good = F.ltrim("value").startswith("{") & F.col("r._broken").isNull()
    rows = rows.filter(good if skip_broken else _checked(good, "a line is no JSON object (one array per file is layout='array'): "))
    names = spark.createDataFrame([], fields).columns
    return rows.select(F.coalesce("r.pos", "pos").alias("pos"), *[F.col(f"r.{n}") for n in names])


def read_records(
    spark: SparkSession, path: str, fields: str, layout: str = "lines", inner: str | None = None, skip_broken: bool = False
) -> DataFrame:
    """Rows `pos` + `fields` of a JSON source; `inner` names a list inside the top object. List
    elements that are no objects are left out. A missing path gives no rows."""
    if layout not in LAYOUTS:
        raise ValueError(f"Invalid layout: {layout}. Must be one of {LAYOUTS}")
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"pos BIGINT, {fields}")
    if layout == "lines":
        return _read_lines(spark, path, fields, skip_broken)
    return array_records(spark, path, fields, inner, skip_broken)


def _text(name: str, default: str = "") -> Column:
    return F.coalesce(F.col(name), F.lit(default)).alias(name)


def _as_examples(rows: DataFrame, level: Column, source: Column, example_id: str = "question_id") -> DataFrame:
    """Map raw records onto the example columns, with defaults for missing keys."""
    have = set(rows.columns)

    def optional(name: str, kind: str) -> Column:
        return (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)

    return rows.select(
        "pos",
        F.coalesce(F.col(example_id), F.lit("")).alias("example_id"),
        _text("question_id"),
        _text("question"),
        _text("context"),
        "ground_truth",
        level.alias("level"),
        source.alias("source"),
        optional("difficulty", "double"),
        optional("inventory", "string"),
        optional("statistics", "string"),
        optional("python_solution", "string"),
        optional("reasoning_trace", TRACE),
    ).select(*EXAMPLE_COLUMNS)


def split_path(root: str, split: str) -> str:
    return f"{root.rstrip('/')}/{split}.json"


def load_split(spark: SparkSession, root: str, split: str, layout: str = "lines", default_source: str = "") -> DataFrame:
    """One split. Its level is the split's name; a missing file gives no rows."""
    rows = read_records(spark, split_path(root, split), RAW_EXAMPLE, layout)
    return _as_examples(rows, F.lit(split), F.coalesce("source", F.lit(default_source)))


def load_dataset(spark: SparkSession, root: str, split: str | None = None, **options) -> DataFrame:
    """One split, or easy, medium and hard together. Unknown splits raise."""
    if split:
        if split not in LEVELS:
            raise ValueError(f"Invalid split: {split}. Must be one of {LEVELS}")
        return load_split(spark, root, split, **options)
    first, *others = [load_split(spark, root, name, **options) for name in LEVELS]
    for other in others:
        first = first.unionByName(other)
    return first


def load_hard(spark: SparkSession, root: str, limit: int | None = None, level: str | None = None, layout: str = "lines") -> DataFrame:
    """The hard split with the levels written in it, filtered, then limited by position."""
    rows = read_records(spark, split_path(root, "hard"), RAW_EXAMPLE, layout)
    found = _as_examples(rows, F.coalesce("level", F.lit("unknown")), F.coalesce("source", F.lit("")))
    return head(of_level(found, level), limit)


def load_traced(
    spark: SparkSession, path: str, limit: int | None = None, level: str | None = None,
    layout: str = "lines", source: str = "traced",
) -> DataFrame:
    """Examples with reasoning traces: the `items` list of one object, or one item per line."""
    rows = read_records(spark, path, TRACED_ITEM, layout, inner="items" if layout == "array" else None)
    named = rows.withColumn("question_id", F.replace(F.coalesce("trace_id", F.lit("")), F.lit(".trace"), F.lit("")))
    found = _as_examples(named, F.coalesce("level", F.lit("unknown")), F.lit(source), example_id="trace_id")
    return head(of_level(found, level), limit)


def load_transformed(spark: SparkSession, path: str, limit: int | None = None, layout: str = "lines") -> DataFrame:
    rows = read_records(spark, path, RAW_EXAMPLE, layout).drop("difficulty", "inventory", "statistics", "python_solution")
    return head(_as_examples(rows, F.coalesce("level", F.lit("unknown")), F.lit("hard_transformed")), limit)


def load_combined(
    spark: SparkSession,
    root: str,
    traced_path: str,
    hard_limit: int | None = None,
    hard_level: str | None = None,
    traced_limit: int | None = None,
    traced_level: str | None = None,
    layout: str = "lines",
) -> DataFrame:
    """The hard split, plus traced examples when a traced argument is given; one row per id."""
    hard = load_hard(spark, root, hard_limit, hard_level, layout)
    if traced_limit is None and traced_level is None:
        return combine(hard)
    return combine(hard, load_traced(spark, traced_path, traced_limit, traced_level, layout))


def load_functions(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """The function library; broken rows are skipped, missing fields are empty."""
    rows = read_records(spark, path, RAW_FUNCTION, layout, skip_broken=True)
    names = ["function_id", "article_title", "function", "function_docstring"]
    return rows.select("pos", *[_text(n) for n in names])


def to_json_rows(rows: DataFrame) -> DataFrame:
    """Rows as JSON objects in one text column (nulls kept out), with the row's id."""
    return rows.select("example_id", F.to_json(F.struct(*rows.columns)).alias("json"))


def from_json_rows(rows: DataFrame, schema: str) -> DataFrame:
    return rows.select(F.from_json("json", schema).alias("r")).select("r.*")
