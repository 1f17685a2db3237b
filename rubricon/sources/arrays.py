"""The objects of large JSON arrays, one file read by many tasks.

A file is cut into fragments that end with a closing brace; Spark's text reader hands ranges of
them to different tasks. Whether a fragment begins inside a string, and how deep, is unknown to
its task, but what it does to either state is not: the number of its quotes tells whether the
state flips, and the brackets outside of strings, for both cases, how the depth moves. These
transitions are composed over the fragments of a range and then over the ranges of a file, of
which there are few. A second pass gives every fragment its state, ends elements where a closing
brace comes back to the list's depth, and joins the fragments of each; only elements over a
range's edge meet in a further step. Text is shuffled once, by range.

What is broken raises: text before or behind the value, strings or brackets left open, elements
without a comma between them, elements that are no JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rubricon.functions.text import let
from rubricon.operators.binding import bind
from rubricon.session import stored

RANGE = ["file", "start"]
FAR = 1 << 30
ROW_BITS = (1 << 33) - 1
ANY_BLANK = r"\s"


def fragments(spark: SparkSession, path: str) -> DataFrame:
    """`value` (without its closing brace), `file`, `start` of its range, `row` rising within it, `file_bytes`."""
    meta = F.col("_metadata")
    return spark.read.text(path, lineSep="}").select(
        "value",
        meta["file_path"].alias("file"),
        meta["file_block_start"].alias("start"),
        meta["file_size"].alias("file_bytes"),
        F.monotonically_increasing_id().bitwiseAND(ROW_BITS).alias("row"),
    )


def _walk(parts: Column, which: int) -> Column:
    """Over the brackets of every second part: `moved` depth, the lowest depth reached (`low`), and that before the last bracket."""
    text = F.array_join(F.filter(parts, lambda _, i: i % 2 == which), "")
    brackets = F.filter(F.split(F.regexp_replace(text, r"[^\[\]{]+", ""), ""), lambda c: c != "")
    state = "struct<moved: int, low: int, before: int>"

    def step(acc: Column, bracket: Column) -> Column:
        moved = acc["moved"] + F.when(bracket == "]", -1).otherwise(1)
        return F.struct(moved.alias("moved"), F.least(acc["low"], moved).alias("low"), acc["low"].alias("before")).cast(state)

    return F.aggregate(brackets, F.struct(F.lit(0), F.lit(FAR), F.lit(FAR)).cast(state), step)


def with_transitions(rows: DataFrame) -> DataFrame:
    """Adds `flips` (1 where the state changes between outside and inside a string) and, for a
    beginning outside (`out`) and inside (`within`), the walk over the brackets; `out_step` and
    `within_step` are the depth moved including the closing brace."""
    plain = F.when(F.contains("value", F.lit("\\")), F.regexp_replace("value", r"(?s)\\.", "")).otherwise(F.col("value"))
    parts = F.split(plain, '"')
    found = let(parts, lambda p: F.struct(((F.size(p) - 1) % 2).alias("flips"), _walk(p, 0).alias("out"), _walk(p, 1).alias("within")))
    rows = bind(rows, {"t": found}).select("*", "t.*").drop("t")
    return rows.withColumns(
        {
            "out_step": F.col("out.moved") - F.when(F.col("flips") == 0, 1).otherwise(0),
            "within_step": F.col("within.moved") - F.when(F.col("flips") == 1, 1).otherwise(0),
        }
    )


def _sum_before(c: str | Column, *partition: str, order: list[str]) -> Column:
    window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(c).over(window), F.lit(0))


def range_states(rows: DataFrame) -> DataFrame:
    """Per range: `inside` (1: begins in a string), `depth`, rows before it in the file and in all
    files (by path), and what is the same for a whole file: `opener`, `file_rows`, `closed` (its
    last byte is a closing brace). One row per range; only numbers are shuffled for it."""
    narrow = rows.select(
        *RANGE, "row", "flips", "out_step", "within_step", "file_bytes",
        (F.octet_length("value") + 1).cast("bigint").alias("bytes"), F.regexp_extract("value", r"\S", 0).alias("opener"),
    )
    narrow = narrow.withColumn("inside", _sum_before("flips", *RANGE, order=["row"]) % 2)
    totals = narrow.groupBy(*RANGE, "file_bytes").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum("flips") % 2).alias("flips"),
        F.sum(F.when(F.col("inside") == 0, F.col("out_step")).otherwise(F.col("within_step"))).alias("out_step"),
        F.sum(F.when(F.col("inside") == 0, F.col("within_step")).otherwise(F.col("out_step"))).alias("within_step"),
        F.sum("bytes").alias("bytes"),
        F.min_by("opener", "row").alias("opener"),
    )
    whole = Window.partitionBy("file")
    placed = totals.withColumn("inside", _sum_before("flips", "file", order=["start"]) % 2)
    step = F.when(F.col("inside") == 0, F.col("out_step")).otherwise(F.col("within_step"))
    return placed.select(
        *RANGE,
        "inside",
        _sum_before(step, "file", order=["start"]).alias("depth"),
        _sum_before("n", "file", order=["start"]).alias("rows_before"),
        # One row per range of all files: the only step that sees them together.
        _sum_before("n", order=["file", "start"]).alias("rows_before_all"),
        F.sum("n").over(whole).alias("file_rows"),
        (F.sum("bytes").over(whole) == F.col("file_bytes")).alias("closed"),
        F.min_by("opener", "start").over(whole).alias("opener"),
    )


def _with_states(rows: DataFrame, ranges: DataFrame, list_depth: Column) -> DataFrame:
    """Adds each fragment's depth and place, whether it ends an element, and checks the file's shape."""
    r = ranges.withColumnRenamed("inside", "range_inside")
    rows = rows.join(F.broadcast(r), RANGE)  # one row per split of the input
    inside = (F.col("range_inside") + _sum_before("flips", *RANGE, order=["row"])) % 2
    rows = rows.withColumn("inside", inside)
    outside = F.col("inside") == 0
    rows = rows.withColumns(
        {
            "walk": F.when(outside, F.col("out")).otherwise(F.col("within")),
            "step": F.when(outside, F.col("out_step")).otherwise(F.col("within_step")),
            "open_end": (F.col("inside") + F.col("flips")) % 2 == 0,
        }
    )
    at_range = F.row_number().over(Window.partitionBy(*RANGE).orderBy("row")) - 1
    rows = rows.withColumns({"at": F.col("depth") + _sum_before("step", *RANGE, order=["row"]), "place": F.col("rows_before") + at_range})
    end = F.col("at") + F.col("step")
    last = F.col("place") == F.col("file_rows") - 1
    complete = ~last | F.col("closed")
    low, before = F.col("at") + F.col("walk.low"), F.col("at") + F.col("walk.before")
    tail = F.regexp_extract("value", r"([^\]\s])?\s*$", 1) == ""
    good = (
        F.when(~last, (low > 0) & ((end > 0) | ((end == 0) & (F.col("place") == F.col("file_rows") - 2))))
        .when(F.col("closed"), (low > 0) & (end == 0) & F.col("open_end") & ((F.col("at") > 0) | (F.col("place") == 0)))
        .when((F.col("at") == 0) & (F.col("place") > 0), F.trim(F.regexp_replace("value", ANY_BLANK, "")) == "")
        .otherwise((before > 0) & (F.col("at") + F.col("walk.moved") == 0) & F.col("open_end") & tail)
    )
    good = good & ((F.col("place") > 0) | F.col("opener").isin("[", "{")) & list_depth.isNotNull()
    return rows.filter(_checked(good)).withColumns(
        {
            "ends": (F.col("open_end") & (end == list_depth) & complete).cast("int"),
            "lowest": F.least(F.col("at"), low, F.when(end != list_depth, end).otherwise(FAR)),
            "pos": F.col("rows_before_all") + at_range,
        }
    )


def _checked(good: Column, what: str = "no JSON array or object: ") -> Column:
    return F.when(good, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(what), F.col("file"))).cast("boolean"))


def _joined(pieces: str, order: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, pieces))), lambda p: p[pieces]), "")


def elements(spark: SparkSession, path: str, inner: str | None) -> DataFrame:
    """`file, pos, text, lowest` of what ends with an object of the list: the object and what stands
    between it and the object before. `pos` rises along a file and over files by path."""
    rows = with_transitions(fragments(spark, path))
    ranges = stored(range_states(rows), "ranges")
    depths = F.when(F.col("opener") == "{", 2) if inner else F.when(F.col("opener") == "[", 1).when(F.col("opener") == "{", 0)
    rows = _with_states(rows, ranges, depths).withColumn("piece", F.concat("value", F.lit("}")))
    rows = rows.withColumn("element", _sum_before("ends", *RANGE, order=["row"]))
    pieces = rows.groupBy(*RANGE, "element").agg(
        _joined("piece", "row").alias("text"), F.max("ends").alias("ends"), F.max("pos").alias("pos"), F.min("lowest").alias("lowest")
    )
    whole = (F.col("element") > 0) & (F.col("ends") == 1)
    # What touches a range's edge: two pieces a range at most. A piece without an end goes on in the next one.
    edges = pieces.filter(~whole).withColumn("element", _sum_before("ends", "file", order=["start", "element"]))
    over_edges = edges.groupBy("file", "element").agg(
        _joined("text", "start").alias("text"), F.max("ends").alias("ends"), F.max("pos").alias("pos"), F.min("lowest").alias("lowest")
    )
    found = [x.select("file", "pos", "text", "lowest") for x in (pieces.filter(whole), over_edges.filter("ends = 1"))]
    return found[0].unionByName(found[1]).withColumn("opened", F.substring(F.regexp_replace("text", r"^\s+", ""), 1, 1))


def _last_of(listed: Column) -> Column:
    return F.try_element_at(F.from_json(listed, "ARRAY<STRING>"), F.lit(-1))


def _in_list(text: Column) -> Column:
    """The object that ends a text `, {...}` or `[1, {...}`; other elements before it are passed over."""
    body = F.regexp_replace(text, r"^\s*[\[,]\s*", "")
    return let(body, lambda b: F.when(b.startswith("{"), b).otherwise(_last_of(F.concat(F.lit("["), b, F.lit("]")))))


def array_items(spark: SparkSession, path: str) -> DataFrame:
    """`pos, item` of every object in the arrays of a path; a file with a single object is a list of one."""
    found = elements(spark, path, None)
    alone = (F.col("opened") == "{") & (F.col("lowest") <= 0)
    found = found.filter(_checked(alone | F.col("opened").isin("[", ",")))
    return found.select("file", "pos", F.when(alone, F.col("text")).otherwise(_in_list(F.col("text"))).alias("item"))


def inner_items(spark: SparkSession, path: str, inner: str) -> DataFrame:
    """`pos, item` of every object in the list named `inner` of the top objects of a path; a file
    without that list gives no rows."""
    found = elements(spark, path, inner)
    # A text that leaves the list's depth closes one value of the top object and opens another:
    # completed, it is an object whose last key is the list that is read now.
    leaves = F.col("lowest") < 2
    cut = F.concat(F.regexp_replace("text", r"^\s*[\]}]\s*,", "{"), F.lit("]}"))
    key = F.try_element_at(F.json_object_keys(cut), F.lit(-1))
    found = bind(found, {"head": F.when(leaves, F.struct(cut.alias("cut"), F.coalesce(key, F.lit("")).alias("key")))})
    named = found.filter(F.col("head").isNotNull()).select("file", "pos", (F.col("head.key") == inner).alias("on"))
    turns = named.withColumn("was", F.lag("on").over(Window.partitionBy("file").orderBy("pos"))).filter(F.col("on") != F.coalesce("was", F.lit(False)))
    # A key occurs once in an object: two turns a file.
    marks = turns.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("pos", "on"))).alias("marks"))
    placed = found.join(marks, "file")
    on = F.try_element_at(F.filter("marks", lambda m: m["pos"] <= F.col("pos")), F.lit(-1))["on"]
    first = _last_of(F.element_at(F.from_json("head.cut", "MAP<STRING,STRING>"), F.lit(inner)))
    item = F.when(F.col("head").isNull(), _in_list(F.col("text"))).otherwise(first)
    return placed.filter(F.coalesce(on, F.lit(False))).select("file", "pos", item.alias("item"))


def array_records(spark: SparkSession, path: str, fields: str, inner: str | None, skip_broken: bool) -> DataFrame:
    """`pos` and `fields` of the objects; values of another type than asked for are null."""
    items = inner_items(spark, path, inner) if inner else array_items(spark, path)
    parsed = F.from_json("item", f"{fields}, _broken STRING", {"columnNameOfCorruptRecord": "_broken"})
    rows = bind(items, {"r": parsed})
    good = F.col("item").isNotNull() & (F.col("r._broken").isNull() | F.try_parse_json("item").isNotNull())
    rows = rows.filter(good if skip_broken else _checked(good))
    names = spark.createDataFrame([], fields).columns
    return rows.select("pos", *[F.col(f"r.{n}") for n in names])
