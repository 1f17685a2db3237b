"""Rule tables: hand-written rows for each scoring and extraction rule, edges included."""

import pytest
from pyspark.sql import functions as F

from rubricon.functions import answers as A
from rubricon.functions import numbers as N
from rubricon.functions import programs as P
from rubricon.functions import steps as S
from rubricon.functions import tokens as K
from rubricon.operators import errors as E


def evaluate(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i INT, {schema}")
    return [r["out"] for r in df.select("i", column.alias("out")).orderBy("i").collect()]


def test_check_answer(spark):
    table = [
        (None, "5", False),
        ("1,234", "1234", True),
        ("12%", "12", True),
        ("0.0019", "0", True),
        ("0.002", "0", False),
        ("1002", "1000", True),
        ("100.2", "100", False),  # 0.20000000000000284 / 100 is above the limit in DOUBLE
        ("100.21", "100", False),
        ("B", " b ", True),
        ("abc", "5", False),
        ("-5", "5", False),
        ("1e2", "100", True),
    ]
    got = evaluate(spark, [t[:2] for t in table], "p STRING, t STRING", N.check_answer("p", "t"))
    assert got == [t[2] for t in table]


def test_compare_final(spark):
    table = [
        ("5", "5.0009", (True, True)),
        ("5", "5.001", (False, True)),
        ("5", '{"final_answer": 5}', (True, True)),
        ("0", '{"note": 1}', (True, True)),
        ("5", '{"final_answer": null}', (False, False)),
        ("5", "ANSWER: 5", (False, False)),
        ("1,000", "1000", (True, True)),
        ("five", "5", (False, False)),
        ("5", None, (False, False)),
    ]
    got = evaluate(spark, [t[:2] for t in table], "t STRING, a STRING", N.compare_final("t", "a"))
    assert [tuple(g) for g in got] == [t[2] for t in table]


def test_deviation(spark):
    table = [("5", "5", 0.0), ("3", "0", 3.0), ("0", "0", 0.0), ("x", "5", None), ("110%", "100", 0.1), (None, "5", None)]
    got = evaluate(spark, [t[:2] for t in table], "p STRING, t STRING", N.deviation("p", "t"))
    assert got == [pytest.approx(t[2]) if t[2] is not None else None for t in table]


@pytest.mark.parametrize(
    ("text", "value"),
    [("5", True), (" -5.5 ", True), ("1e5", True), (".5", True), ("5.", True), ("1.0d", False), ("1_000", False), ("", False), ("5 6", False), ("NaN", False)],
)
def test_numeric_grammar(spark, text, value):
    assert evaluate(spark, [(text,)], "t STRING", N.is_numeric("t")) == [value]


def test_costs(spark):
    micros = N.split_cost_micros("p", "c", F.lit(75), F.lit(300))
    assert evaluate(spark, [(1000, 1000), (7, 0), (6, 0)], "p INT, c INT", micros) == [375, 1, 0]
    assert evaluate(spark, [(1_000_000, None), (1_000_000, 2.5)], "n INT, p DOUBLE", N.blended_cost("n", "p")) == [15.0, 2.5]
    assert evaluate(spark, [(100,)], "n INT", N.estimate_tokens("n")) == [pytest.approx(130.0)]


def test_overall_score(spark):
    cols = [F.col(c) for c in "abcde"]
    rows = [(True, 1.0, 1.0, False, 0.0), (False, 0.5, 0.5, True, 0.5), (True, None, 1.0, False, 0.0)]
    got = evaluate(spark, rows, "a BOOLEAN, b DOUBLE, c DOUBLE, d BOOLEAN, e DOUBLE", N.overall_score(*cols))
    assert got == [pytest.approx(1.0), pytest.approx(0.3), 0.0]


def test_cot_answer(spark):
    table = [
        ("Therefore, the answer is 12.5", 12.5),
        ("therefore the answer is: -3%", -3.0),
        ("The answer is 7. The final answer: 8", 7.0),
        ("Final answer: 9", 9.0),
        ("My Answer: 10\n", 10.0),
        ("Answer: 10 apples and 4", 4.0),
        ("the answer is 1,234", 1.0),
        ("it costs $1,234", 234.0),
        ("growth of 5%", 5.0),
        ("no number", None),
        (None, None),
    ]
    assert evaluate(spark, [t[:1] for t in table], "t STRING", A.cot_answer("t")) == [t[1] for t in table]


STEP = '{"step_number":1,"step_type":"calculation","description":"d","code_snippet":"c"}'


def parse(spark, texts, how):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, content STRING")
    df = df.withColumn("found", A.json_object("content")).select("i", how("content", "found").alias("p"))
    return [r["p"] for r in df.orderBy("i").collect()]


def test_parse_structured(spark):
    nested = f'{{"final_answer": 5, "reasoning_steps": [{STEP}, 3, {{}}]}}'
    compact = f'{{"final_answer":1,"reasoning_steps":[{STEP}]}}'
    doubled = compact.replace("{", "{{").replace("}", "}}")
    texts = [
        '{"final_answer": 42}',
        nested,
        f"x ```json\n{compact}\n``` y",
        f"See {compact} and more",
        doubled,
        '{"final_answer": "B"}',
        '{"final_answer": -7}',
        '"final_answer": -7, oops',
        '"final_answer": "abc" oops',
        "first\nanswer: 12\nlast",
        "  plain text  ",
        "",
        "} stray {\"final_answer\": 1} tail",
    ]
    got = parse(spark, texts, A.parse_structured)
    assert [g["final_answer"] for g in got] == [
        "42", "5", "1", "1", "1", "B", "-7", "-7", "abc", "12", "plain text", None, "1",
    ]
    assert [g["final_answer_type"] for g in got] == ["numeric"] * 5 + ["text"] + ["numeric"] * 2 + ["text", "numeric", "text", "text", "numeric"]
    assert [g["parse_status"] for g in got] == ["success"] * 7 + ["partial"] * 5 + ["success"]
    assert [tuple(s) for s in got[1]["reasoning_steps"]] == [
        (1, "calculation", "d", "c"),
        (0, "variable_definition", "", ""),
    ]
    assert all(len(got[i]["reasoning_steps"]) == 1 for i in (2, 3, 4))


def test_parse_blocks_falls_back_to_steps(spark):
    got = parse(spark, ["intro\n\nx = 5\na + b\nif a\n1. go on\nreturn x", '{"final_answer": 1}'], A.parse_blocks)
    steps = [(s["step_number"], s["step_type"], s["description"]) for s in got[0]["reasoning_steps"]]
    assert steps == [
        (1, None, ""),
        (1, "variable_definition", "Define variable: x = 5"),
        (1, "calculation", "Calculate: a + b"),
        (1, "conditional", "Conditional: if a"),
        (2, "variable_definition", "Step 2: 1. go on"),
        (2, "return_result", "Final result: return x"),
    ]
    assert got[0]["parse_message"] == "Parsed 6 reasoning steps from unstructured text"
    assert got[1]["parse_status"] == "success"


def test_unknown_provider(spark):
    df = spark.createDataFrame([("other", "text")], "provider STRING, content STRING")
    run = F.struct(F.lit(True).alias("success"), F.lit("1").alias("output"), F.lit(None).cast("string").alias("error"))
    args = (F.col("provider"), F.lit(False), F.col("content"), F.lit(None).cast("string"), run)
    assert df.select(A.parse_response(*args).alias("p")).first()["p"] is None
    with pytest.raises(Exception, match="Unknown provider type: other"):
        df.select(A.parse_response(*args, strict=True).alias("p")).collect()


def test_analysis_fields(spark):
    text = "error_type: UNIT_ERROR\nSUMMARY: s\nDETAILED_ANALYSIS: a\nb\nLIKELY_CAUSE: c\nCORRECT_APPROACH: d\nCONFIDENCE: 1.7"
    got = evaluate(spark, [(text,), ("nothing",)], "t STRING", A.analysis_fields("t"))
    assert tuple(got[0]) == ("UNIT_ERROR", "s", "a\nb", "c", "d", 1.0)
    assert tuple(got[1]) == ("UNKNOWN", "Analysis incomplete", "", "", "", 0.7)
    composed = evaluate(spark, [(text,)], "t STRING", A.evidence_fields(A.compose_evidence(A.analysis_fields("t"))))
    assert tuple(composed[0]) == ("s", "a\nb", "c", "d")


def test_extract_code(spark):
    table = [
        ("a\n```python\nx = 1\n```", "x = 1"),
        ("```\ny\n``` then ```python\nz\n```", "z"),
        ("```\ny\n```", "y"),
        ("say\nx = 1\nok", "x = 1"),
        ("say\n```\nanything here", "anything here"),
        ("just prose", None),
        ("```python\n```", ""),
    ]
    assert evaluate(spark, [t[:1] for t in table], "t STRING", P.extract_code("t")) == [t[1] for t in table]


def test_program_output(spark):
    table = [
        ("answer = 5", ("5", 5.0)),
        ("12", ("12", 12.0)),
        ("total 3 then 4", ("4", 4.0)),
        ("  ", (None, None)),
        ("Answer = 'x'", ("x", None)),
        ("words", ("words", None)),
        ("a 9\n-7.5", ("-7.5", -7.5)),
        (None, (None, None)),
    ]
    got = evaluate(spark, [t[:1] for t in table], "t STRING", P.program_output("t"))
    assert [tuple(g) for g in got] == [t[1] for t in table]


def test_truth_steps(spark):
    text = "\nx = 1\n\na == b\nx += 1\n# a - b\nif x\nnothing\nreturn x"
    got = evaluate(spark, [(text,)], "t STRING", S.truth_steps("t"))[0]
    assert [(s["step_number"], s["step_type"]) for s in got] == [
        (1, "variable_definition"),
        (4, "variable_definition"),
        (5, "calculation"),
        (6, "conditional"),
        (8, "return_result"),
    ]


def test_similarity(spark):
    table = [("a b", "a b", 1.0), ("a b c", "b", 1.0), ("b", "a b c", 0.5), ("a", "", 1.0), ("a b", "c d", 0.0), ("a b", "b c", 1 / 3)]
    got = evaluate(spark, [t[:2] for t in table], "a STRING, b STRING", S.similarity("a", "b"))
    assert got == [pytest.approx(t[2]) for t in table]


def test_keywords(spark):
    words = evaluate(spark, [("Generate x", "Generate éleven abc_d net")], "f STRING, d STRING", K.function_keywords("f", "d"))[0]
    assert set(words) == {"generate", "rate", "net"}
    asked = evaluate(spark, [("What is abc123 growth of the 12 loans?",)], "q STRING", K.query_keywords("q"))[0]
    assert sorted(asked) == ["123", "growth", "loans"]


def classified(spark, rows):
    schema = (
        "i INT, execution_error STRING, predicted_text STRING, ground_truth STRING, raw_response STRING, "
        "executed_code STRING, context STRING, parse_status STRING"
    )
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema).withColumns(
        {"predicted_num": N.to_number("predicted_text", ",%"), "truth_num": N.to_number("ground_truth", ",%")}
    )
    return [r["error"] for r in E.classify(df).orderBy("i").collect()]


def test_classify(spark):
    ok = "success"
    rows = [
        ("NameError: x", "100", "100", "", None, "5", ok),
        (None, None, "100", "text", None, "5", ok),
        (None, "100", "100", "text", None, "5", "failed"),
        (None, "100.19", "100", "", None, "5", ok),
        (None, "100.2", "100", "", None, "5", ok),
        (None, "109.99", "100", "", None, "5", ok),
        (None, "110", "100", "uses 700 and 800", None, "5", ok),
        (None, "110", "100", "uses 700 only, and 1 2 100 365 0.005", None, "5", ok),
        (None, "200", "100", "uses 500 and 0.005 of 5 and 700", None, "5", ok),
        (None, "200", "100", "700 and 800", None, "[]", ok),
        (None, "200", "100", "700 and 800", None, "", ok),
        (None, "200", "100", "700 and 800", "x = 5", "5", ok),
        (None, "abc", "100", "no numbers", None, "5", ok),
        (None, "3", "0", "3", None, "3", ok),
    ]
    got = classified(spark, rows)
    assert [g["category"] for g in got] == [
        "execution_error", "parsing_error", "parsing_error", "rounding_error", "numerical_calculation_error",
        "numerical_calculation_error", "hallucination", "unknown", "unknown", "unknown", "unknown", "unknown",
        "unknown", "unknown",
    ]
    assert [g["confidence"] for g in got][:8] == [0.95, 0.95, 0.95, 0.9, 0.7, 0.7, 0.6, 0.3]
    assert got[0]["evidence"] == "POT code execution failed: Undefined variable in generated code"
    assert got[3]["evidence"] == "Answer within 0.190% of ground truth (< 0.2% tolerance)"
    assert got[6]["evidence"] == "Found 2 values in response not present in context"
    assert got[6]["details"]["hallucinated_values"] == "[700.0,800.0]"
    assert [g["auto_classified"] for g in got][6:8] == [True, False]
