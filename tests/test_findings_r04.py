"""Findings of round 4."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rubricon.llm import nearest


def test_nearest_keeps_no_pairs_of_queries_and_windows(spark, monkeypatch):
    """on random directions all windows are open; nothing as large as queries × windows is made."""
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(6_000, 16)).astype("float32")
    vectors[17] = vectors[16]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(40, [9.0] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<FLOAT>")
    kept, keep = [], nearest.stored
    monkeypatch.setattr(nearest, "stored", lambda d, label: kept.append(keep(d, label)) or kept[-1])
    monkeypatch.setattr(nearest, "SLICE_BYTES", 16 * 8 * 1_000, raising=False)  # three slices
    got = {}
    for r in nearest.search(df, F.col("vec_id") % 2 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert len(got) == 3_000
    assert max(d.count() for d in kept if "window" in d.columns or "bound" in d.columns) <= 6_000
    v = vectors.astype(float)
    v[40] = min(v[40].tolist(), [9.0] * 16)
    for q in range(0, 6_000, 250):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [got[q][i + 1] for i in range(10)] == np.lexsort((np.arange(6_000), d))[:10].tolist()


def test_nearest_compares_open_windows_only():
    """the pairs that the triangle inequality leaves open, and rows whose squares overflow."""
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(40, 16)) * 50
    near = centres[:, None] + draw.normal(size=(40, 256, 16))
    radius = np.sqrt(((near - near.mean(1)[:, None]) ** 2).sum(2)).max(1)
    queries = near[:, 0]
    opened = nearest.open_pairs(queries, np.full(40, 5.0), near.mean(1), radius)
    assert opened.diagonal().all() and opened.sum() < 80
    assert nearest.open_pairs(queries, np.full(40, np.inf), near.mean(1), radius).all()
    huge = draw.normal(size=(300, 4)) * 1e25
    best = nearest.Nearest(np.arange(3), huge[:3], np.full(3, np.inf), 5)
    best.show(np.arange(300), huge)
    q, ids, _ = best.settle()
    d = np.sqrt(((huge - huge[1]) ** 2).sum(1))
    assert ids[q == 1].tolist() == [k for k in np.argsort(d) if k != 1][:5]


def test_first_chars_cuts_by_characters(spark):
    """the byte cut is taken for ASCII only, and characters are not counted for it."""
    from rubricon.functions.text import first_chars

    texts = ["", "abc", "x" * 40, "é" * 40, "a" * 9 + "é" * 9, "漢字" * 20, "a" * 10 + "漢" * 9, "\U0001f600" * 12, "a" * 9 + "\U0001f600", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [r[0] for r in df.select(first_chars("t", 10)).collect()]
    assert got == [t if t is None else t[:10] for t in texts]


def codegen_sizes(spark, df):
    """Bytes of the largest generated method of each stage; over 8,000 the JVM interprets it."""
    import re

    package = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = package.codegenString(df._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text)]


def test_wrong_rows_are_scored_in_methods_that_the_jvm_compiles(spark, sf_dir):
    """one generated method had 8,960 bytes."""
    from rubricon.operators import selection
    from rubricon.plans import fixtures as fx
    from rubricon.plans import report_queries

    wrong = selection.wrong_rows(report_queries.scored(spark, sf_dir, fx.MODEL_NAMES))
    sizes = codegen_sizes(spark, wrong.select(*report_queries.KEY, "error_category", "error_confidence", "error_evidence"))
    assert sizes and max(sizes) < 8_000


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_and_scores_are_worked_out_once(spark, sf_dir):
    """F2: the filter and three fields searched the texts again. F5: both sides of the merge scored all runs."""
    from __spark_entry__ import queries

    # Once for the numbers of each row, once within the classification; the plan's text shows them
    # again where it lists a projection, so that the sizes of the two forms are told apart.
    assert physical(queries()["hallucination"](spark, sf_dir)).count("array_except(") == 2
    merged = physical(queries()["merge_analysis"](spark, sf_dir))
    assert "o_totalprice" not in merged and "orders.parquet" not in merged


def test_doubled_braces_are_not_counted(spark):
    """steps with doubled braces have four levels; a flat object is sought where one can be."""
    from rubricon.functions import answers as A

    key = '"final_answer"'
    texts = [
        f'{{{{{key}:1,"reasoning_steps":[{{{{"a":2}}}},{{{{"a":3}}}}]}}}}', f'x {{"a": {{"b": {{"c": {{"d": 1}}}}}}, {key}: 6}} {{', f'{{"a":{{"b":{{"c":{{"d":{{}}}}}}}},{key}:7}}',
        f'{key} {{"a": 1}} {{{key}: 8}}', f'{{{key}: {{{key}: 9}}', f'{{"s": [{{}}], {key}: 10}}\n``` {{}}', f"{key}}} {{ {key}", f'no {{"x": 1}}', "", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    fits = lambda p: p.contains(A.ANSWER_KEY) & ~p.startswith("{{") & A.holds_answer(p)
    counted = F.get(F.filter(A.balanced_objects("t"), fits), F.lit(0))
    flat = F.regexp_extract("t", A.FLAT_OBJECT, 0)
    rows = df.select(A.balanced_object("t"), counted, F.regexp_extract("t", A.FIRST_DEEP_OBJECT, 1), flat, F.col("t").rlike(A.FLAT_END)).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows]
    assert rows[0][2] == texts[0] and rows[1][2] and not rows[2][2]
    assert all(r[4] for r in rows if r[3]) and not rows[0][4]
    assert [r[0] for r in df.select(A.json_object("t")).collect()] == [
        '{"final_answer":1,"reasoning_steps":[{"a":2},{"a":3}]}', texts[1][2:-2], texts[2], f"{{{key}: 8}}", f"{{{key}: 9}}", texts[5].split("\n")[0], None, None, None, None,
    ]


def test_steps_are_read_once(spark):
    """the list was parsed for its check and again for its values."""
    from rubricon.functions import steps as S

    df = spark.createDataFrame([('{"reasoning_steps":[{"step_number":1},null]}',), ('{"reasoning_steps":[{"step_type":"x"}]}',), ("{",), (None,)], "t STRING")
    read = df.select(S.read_steps("t").alias("steps"))
    assert physical(read).count("from_json(") == 1
    assert [r[0] and [tuple(s) for s in r[0]] for r in read.collect()] == [[(1, S.VARIABLE, "", "")], [(0, "x", "", "")], None, None]


def test_cells_of_an_example_are_shuffled_together(spark):
    """Cells were dealt by example, model and method; repeated and null keys match as before."""
    from rubricon.operators import grid as G

    cells = [("a", "m", "COT", 1), ("a", "m", "POT", 2), ("a", "n", "COT", 3), ("b", "m", "COT", 4), ("b", "m", "COT", 5), (None, "m", "COT", 6), ("c", None, "COT", 7)]
    given = [("a", "m", "COT", "x", 1, 2), ("a", "m", "COT", "y", 3, 4), ("a", "n", "COT", None, 5, 6), ("b", "m", "COT", "z", None, 8), (None, "m", "COT", "w", 9, 9), ("c", None, "COT", "v", 9, 9)]
    grid = spark.createDataFrame(cells, "example_id STRING, model_name STRING, method STRING, n INT")
    responses = spark.createDataFrame(given, "example_id STRING, model_name STRING, method STRING, raw_response STRING, prompt_tokens INT, completion_tokens INT")
    filled = G.fill_grid(grid, responses)
    assert filled.columns == ["example_id", "model_name", "method", "n", "raw_response", "prompt_tokens", "completion_tokens", "parse_status"]
    none = ("no response", 0, 0, "failed")
    assert sorted(tuple(r)[3:] for r in filled.collect()) == [
        (1, "x", 1, 2, "success"), (1, "y", 3, 4, "success"), (2, *none), (3, "no response", 5, 6, "failed"), (4, "z", 0, 8, "success"), (5, "z", 0, 8, "success"), (6, *none), (7, *none),
    ]
    dealt = [x.split(",")[0:2] for x in physical(G.fill_grid(grid, responses)).split("hashpartitioning(")[1:]]
    assert len(dealt) == 2 and all("example_id#" in first and second.strip()[0].isdigit() for first, second in dealt)
