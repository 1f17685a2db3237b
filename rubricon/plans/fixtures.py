"""Inputs derived from the driver tables, following FIXTURES.md part B.

Every table grows with the table it is read from. Grids are made by exploding a
constant list inside the row, so no join is involved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubricon import dims
from rubricon.functions.text import int_div, money
from rubricon.operators.binding import bind

UNLISTED = "unlisted"
MODEL_NAMES = [m[0] for m in dims.MODELS] + [UNLISTED]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A driver table, spread over all cores when it comes in fewer splits than that.

    Only narrow input rows are moved, before anything is derived from them; large tables
    arrive in enough splits and are not moved at all.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Orders of one task: each becomes up to 22 runs, so that few bytes are much work.
TASK_ORDERS = 20_000


def dealt(orders: DataFrame, rows: int = TASK_ORDERS) -> DataFrame:
    """Narrow rows dealt evenly, about `rows` to a task and a task for each core at least.

    Splits are cut by bytes and filled by row groups: whatever their number, a few may hold all
    rows. The rows are counted from the files' footers.
    """
    cores = orders.sparkSession.sparkContext.defaultParallelism
    return orders.repartition(max(cores, -(-orders.count() // rows)))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    o = dealt(o.select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus"))
    k, cents = F.col("o_orderkey"), F.round(F.col("o_totalprice") * 100).cast("bigint")
    first = F.left("o_orderpriority", F.lit(1))
    total = money(cents)
    return o.select(
        k.alias("pos"),
        F.concat(F.lit("test-"), k.cast("string")).alias("example_id"),
        F.when(first.isin("1", "2"), "hard").when(first == "3", "medium").otherwise("easy").alias("level"),
        cents.alias("cents"),
        total.alias("ground_truth"),
        F.concat(F.lit("What is the total of order "), k.cast("string"), F.lit("?")).alias("question"),
        F.when(k % 20 == 0, "[]")
        .otherwise(F.concat(F.lit("Order "), k.cast("string"), F.lit(" total "), total))
        .alias("context"),
        F.concat(F.lit("status-"), F.col("o_orderstatus")).alias("source"),
    )


def grid_cells(models: list[str], methods: list[str]) -> Column:
    """ARRAY of (ord, model_name, mo, method), one entry per model and method."""
    return F.array(
        *[
            F.struct(
                F.lit(MODEL_NAMES.index(m)).alias("ord"),
                F.lit(m).alias("model_name"),
                F.lit(dims.METHODS.index(method)).alias("mo"),
                F.lit(method).alias("method"),
            )
            for m in models
            for method in methods
        ]
    )


def case_number() -> Column:
    return (F.col("pos") * 7 + F.col("ord") * 13 + F.col("mo") * 5) % 10


def calls(spark: SparkSession, sf_dir: str, models: list[str] | None = None, methods: list[str] | None = None) -> DataFrame:
    """Recorded calls without their texts: one row per example, model and method."""
    cells = grid_cells(models or MODEL_NAMES, methods or dims.METHODS)
    k, order = F.col("pos"), F.col("ord")
    return examples(spark, sf_dir).select("*", F.inline(cells)).withColumns(
        {
            "prompt_tokens": 200 + k % 800,
            "completion_tokens": 50 + (k * 31 + order) % 400,
            "latency_seconds": ((k * 17 + order * 3) % 5000) / 1000.0,
        }
    )


def runs(spark: SparkSession, sf_dir: str, models: list[str] | None = None, methods: list[str] | None = None) -> DataFrame:
    """Recorded responses: calls with response text and the outcome of program runs."""
    cents, c, is_pot = F.col("cents"), F.col("_case"), F.col("method") == "POT"
    answer = (
        F.when(c <= 3, cents)
        .when(c == 4, int_div(cents * 1001, 1000))
        .when(c == 5, int_div(cents * 105, 100))
        .when(c == 8, cents * 2)
        .when(c == 9, cents * 3)
    )
    base = bind(calls(spark, sf_dir, models, methods), {"_case": case_number()})
    base = bind(base, {"_cents": answer})
    base = bind(base, {"_amount": money("_cents")})
    cot = F.concat(
        F.when(c == 8, "Take 7777.77 and 8888.88. ").otherwise(""), F.lit("Therefore, the answer is "), "_amount"
    )
    pot = F.concat(
        F.lit("```python\n"),
        F.when(c == 8, "x = 7777.77\ny = 8888.88\n").otherwise(""),
        F.lit("answer = "),
        F.when(c == 7, "x").otherwise(F.col("_amount")),
        F.lit("\n```"),
    )
    text = F.coalesce(F.when(is_pot, pot).otherwise(cot), F.lit("I cannot determine it."))
    return bind(
        base,
        {
            "raw_response": text,
            "execution_output": F.when(is_pot, F.concat(F.lit("answer = "), "_amount")),
            "execution_error": F.when(is_pot & (c == 7), "NameError: name 'x' is not defined"),
        },
    ).drop("_case", "_cents", "_amount")


def solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples with a reference program (`python_solution`)."""
    text = F.concat(
        F.lit("qty = "), (F.col("pos") % 50).cast("string"),
        F.lit("\nprice = "), F.col("cents").cast("string"),
        F.lit("\n\ntotal = qty * price\nprint(total / 2)\nif total > 0:\n    return total"),
    )
    return examples(spark, sf_dir).withColumn("python_solution", text)


def step(kind: str, description: Column, snippet: Column, number: int) -> Column:
    return F.struct(
        F.lit(number).alias("step_number"),
        F.lit(kind).alias("step_type"),
        description.alias("description"),
        snippet.alias("code_snippet"),
    )


def answer_step_rows(spark: SparkSession, sf_dir: str, models: list[str] | None = None, solved: DataFrame | None = None) -> DataFrame:
    """Examples × models with the raw steps of each answer (`raw_steps`), five variants.

    `solved` are the solutions with further columns that belong to the example alone."""
    def written(number: int, kind: str, label: str, code: Column, as_kind: str | None = None) -> Column:
        return step(as_kind or kind, F.concat(F.lit(label), code), code, number)

    base = (solutions(spark, sf_dir) if solved is None else solved).select("*", F.inline(grid_cells(models or MODEL_NAMES, ["COT"])))
    qty = F.concat(F.lit("qty = "), (F.col("pos") % 50).cast("string"))
    price = F.concat(F.lit("price = "), F.col("cents").cast("string"))
    d, calc, cond, ret = "variable_definition", "calculation", "conditional", "return_result"
    s1 = written(1, d, "Define variable: ", qty)
    s2 = written(2, d, "Define variable: ", price)
    s3 = written(3, d, "Define variable: ", F.lit("total = qty * price"))
    s4 = written(4, calc, "Calculate: ", F.lit("print(total / 2)"))
    s5 = written(5, cond, "Conditional check: ", F.lit("if total > 0:"))
    s6 = written(6, ret, "Return result: ", F.lit("return total"))
    s4_swapped = written(4, calc, "Calculate: ", F.lit("print(total / 2)"), as_kind=cond.upper())
    s5_swapped = written(5, cond, "Conditional check: ", F.lit("if total > 0:"), as_kind="other")
    s7, s8 = (step(calc, F.lit("Check the total"), F.lit(""), n) for n in (7, 8))
    v = (F.col("pos") + F.col("ord")) % 5
    steps = (
        F.when(v == 0, F.array(s1, s2, s3, s4, s5, s6))
        .when(v == 1, F.array(s1, s2, s3, s4, s5))
        .when(v == 2, F.array(s1, s2, s3, s4_swapped, s5_swapped, s6))
        .when(v == 3, F.array(s1, s2, s3, s4, s5, s6, s7, s8))
    )
    return bind(base, {"raw_steps": steps})


def structured_texts(spark: SparkSession, sf_dir: str, models: list[str] | None = None) -> DataFrame:
    """Structured answer texts in eight states of repair (`content`)."""
    base = answer_step_rows(spark, sf_dir, models)
    amount = F.col("ground_truth")
    steps = F.coalesce(F.to_json("raw_steps"), F.lit("[]"))
    doc = F.concat(F.lit('{"final_answer":'), amount, F.lit(',"reasoning_steps":'), steps, F.lit("}"))
    v = F.col("variant")
    base = bind(base, {"variant": (F.col("pos") * 3 + F.col("ord")) % 8})
    base = bind(base, {"_doc": F.when(F.coalesce(~v.isin(2, 4, 5, 6), F.lit(True)), doc)})
    doc = F.col("_doc")
    content = (
        F.when(v == 0, doc)
        .when(v == 1, F.concat(F.lit("Result:\n```json\n"), doc, F.lit("\n```")))
        .when(v == 2, F.concat(F.lit('Sure. {"final_answer": -'), amount, F.lit("}")))
        .when(v == 3, F.concat(F.lit("Here: "), doc, F.lit(" That is all.")))
        .when(v == 4, F.concat(F.lit('"final_answer": '), amount, F.lit(", oops")))
        .when(v == 5, F.concat(F.lit("Some text\nanswer: "), amount, F.lit("\nThanks")))
        .when(v == 6, F.concat(F.lit("No idea about "), F.col("question"), F.lit("\n1. try again\ntotal = 5 ")))
        .otherwise(F.replace(F.replace(doc, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}")))
    )
    return bind(base, {"content": content}).drop("_doc")


def functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The function library, one row per document."""
    return table(spark, sf_dir, "documents", "doc_id", "source", "text").select(
        F.col("doc_id").alias("pos"),
        F.col("doc_id").alias("function_id"),
        F.col("source").alias("article_title"),
        F.concat(F.lit("def calc_"), F.col("source")).alias("function"),
        F.col("text").alias("function_docstring"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval queries: benchmark passages and two literal ones without usable words."""
    literal = dims.literal_table(spark, [(-1, "what is the"), (-2, "12")], "query_id BIGINT; query STRING")
    return (
        table(spark, sf_dir, "benchmark", "item_id", "text")
        .select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
        .unionByName(literal)
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached calls, one row per event."""
    return table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props").select(
        F.col("event_id").alias("pos"),
        F.col("ts").cast("timestamp").alias("created_at"),
        F.col("user_id").cast("string").alias("example_id"),
        F.col("event_type").alias("model"),
        F.round(F.col("value") * 100).cast("bigint").alias("cost_cents"),
        F.md5("props").alias("prompt_hash"),
        F.col("props").alias("prompt"),
    )


def cases(spark: SparkSession) -> DataFrame:
    return dims.paper_cases(spark)
