"""Registered queries: response parsing, programs, steps and step metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricon import dims
from rubricon.functions import answers as A
from rubricon.functions import numbers as N
from rubricon.functions import programs as P
from rubricon.functions import steps as S
from rubricon.operators import scoring
from rubricon.operators.binding import bind
from rubricon.plans import fixtures as fx
from rubricon.plans import sql
from rubricon.plans.registry import query
from rubricon.plans.sql import number, quote, rows, strip

PAIR = ["example_id", "model_name"]
PAIRS = "example_id, model_name"
BIG = "bigint"


def steps_text(steps: str | Column) -> Column:
    """Steps as one comparable text."""
    one = lambda s: F.concat_ws(
        "|", s["step_number"].cast("string"), F.coalesce(s["step_type"], F.lit("-")), s["description"], s["code_snippet"]
    )
    return F.array_join(F.transform(steps, one), ";")


_STEPS_TEXT_SQL = (
    "array_to_string(list_transform({steps}, lambda s: concat_ws('|', s.step_number::VARCHAR, "
    "coalesce(s.step_type, '-'), s.description, s.code_snippet)), ';')"
)


# --- JSON and structured answers -------------------------------------------------------

_COLLAPSE = "replace(replace({c}, '{{{{', '{{'), '}}}}', '}}')"


def _object_sql(c: str) -> str:
    """Flat object, tail object, then first to last brace (what a balanced scan finds here)."""
    flat = f"nullif(regexp_extract({c}, {quote(A.FLAT_OBJECT)}, 0), '')"
    tail_pattern = r'(\{[\s\S]*?"final_answer"[\s\S]*?\})(?:\s*$|\s*```)'
    tail = f"nullif(regexp_extract({c}, {quote(tail_pattern)}, 1), '')"
    outer = "nullif(regexp_extract(" + c + r", '(\{[\s\S]*\})', 1), '')"
    valid = [f"CASE WHEN json_valid({x}) THEN {x} END" for x in (flat, tail, outer)]
    return f"coalesce({', '.join(valid)})"


def _parse_ctes() -> str:
    collapsed = _COLLAPSE.format(c="content")
    return f"""{sql.texts()}, bodies AS (SELECT *, {collapsed} AS body FROM fx_texts),
found AS (SELECT *, coalesce({_object_sql("content")}, {_object_sql("body")}) AS doc_text FROM bodies),
answered AS (SELECT *, CASE WHEN NOT contains(body, '"final_answer"') THEN NULL
      WHEN regexp_matches(body, {quote(A.ANSWER_NUMBER)}) THEN regexp_extract(body, {quote(A.ANSWER_NUMBER)}, 1)
      WHEN regexp_matches(body, {quote(A.ANSWER_QUOTED)}) THEN regexp_extract(body, {quote(A.ANSWER_QUOTED)}, 1)
      WHEN regexp_matches(body, {quote(A.ANSWER_BARE)}) THEN regexp_extract(body, {quote(A.ANSWER_BARE)}, 1) END AS by_regex,
    list_filter(string_split({strip("body")}, chr(10)), lambda l: starts_with(upper({strip("l")}), 'ANSWER:'))[-1] AS last_answer FROM found),
lined AS (SELECT *, {strip(f"substr({strip('last_answer')}, 8)")} AS by_line FROM answered)"""


def _with_found(rows: DataFrame) -> DataFrame:
    return bind(rows, {"found": A.json_object("content")})


@query(
    "json_extract",
    f"WITH {_parse_ctes()} SELECT {PAIRS}, doc_text IS NOT NULL AS has_object, coalesce(md5(doc_text), '') AS object_md5 FROM lined",
)
def json_extract(spark, sf_dir):
    rows = _with_found(fx.structured_texts(spark, sf_dir))
    return rows.select(
        *PAIR, F.col("found").isNotNull().alias("has_object"), F.coalesce(F.md5("found"), F.lit("")).alias("object_md5")
    )


_PARSED_SQL = f"""CASE WHEN doc_text IS NOT NULL THEN TRY_CAST(json_extract_string(doc_text, '$.final_answer') AS DOUBLE)
    WHEN by_regex IS NOT NULL THEN {number("by_regex")} {{line}} END AS answer_num,
  CASE WHEN doc_text IS NOT NULL THEN 'numeric' WHEN by_regex IS NOT NULL THEN CASE WHEN {number("by_regex")} IS NULL THEN 'text' ELSE 'numeric' END
    {{line_type}} ELSE 'text' END AS answer_type,
  CASE WHEN doc_text IS NOT NULL THEN 'success' ELSE 'partial' END AS parse_status"""


@query(
    "parse_structured",
    f"""WITH {_parse_ctes()} SELECT {PAIRS}, {_PARSED_SQL.format(line=f"WHEN by_line IS NOT NULL THEN {number('by_line')}", line_type=f"WHEN by_line IS NOT NULL AND {number('by_line')} IS NOT NULL THEN 'numeric'")},
      CASE WHEN doc_text IS NOT NULL OR by_regex IS NOT NULL OR by_line IS NOT NULL THEN '' ELSE left({strip("body")}, 100) END AS raw_text,
      CASE WHEN doc_text IS NOT NULL AND variant <> 2 THEN coalesce(len(raw_steps), 0) ELSE 0 END AS n_steps FROM lined""",
)
def parse_structured(spark, sf_dir):
    rows = _with_found(fx.structured_texts(spark, sf_dir))
    parsed = bind(rows, {"p": A.parse_structured("content", "found")})
    raw = F.col("p.parse_message").startswith("No structured")
    return parsed.select(
        *PAIR,
        N.to_number("p.final_answer").alias("answer_num"),
        F.col("p.final_answer_type").alias("answer_type"),
        F.col("p.parse_status").alias("parse_status"),
        F.when(raw, F.col("p.final_answer")).otherwise("").alias("raw_text"),
        F.size("p.reasoning_steps").cast(BIG).alias("n_steps"),
    )


@query(
    "parse_blocks",
    f"""WITH {_parse_ctes()} SELECT {PAIRS}, {_PARSED_SQL.format(line="", line_type="")},
      CASE WHEN doc_text IS NOT NULL THEN CASE WHEN variant <> 2 THEN coalesce(len(raw_steps), 0) ELSE 0 END WHEN by_regex IS NOT NULL THEN 0
        ELSE len(list_filter(string_split(body, chr(10)), lambda l: {strip("l")} <> '')) END AS n_steps FROM lined""",
)
def parse_blocks(spark, sf_dir):
    rows = _with_found(fx.structured_texts(spark, sf_dir))
    parsed = bind(rows, {"p": A.parse_blocks("content", "found")})
    return parsed.select(
        *PAIR,
        N.to_number("p.final_answer").alias("answer_num"),
        F.col("p.final_answer_type").alias("answer_type"),
        F.col("p.parse_status").alias("parse_status"),
        F.size("p.reasoning_steps").cast(BIG).alias("n_steps"),
    )


#: Models whose answers are chat texts; those of the others are taken as program runs here.
_CHAT_MODELS = [(m[0], m[2]) for m in dims.MODELS if m[2] in ("openai", "anthropic")]


@query(
    "parse_all",
    f"""WITH {_parse_ctes()}, p AS (SELECT {PAIRS}, provider, ground_truth, {_PARSED_SQL.format(line="WHEN provider = 'openai' AND by_line IS NOT NULL THEN " + number("by_line"), line_type="WHEN provider = 'openai' AND by_line IS NOT NULL AND " + number("by_line") + " IS NOT NULL THEN 'numeric'")}
      FROM (SELECT lined.*, coalesce(m.provider, 'program') AS provider FROM lined LEFT JOIN ({rows(_CHAT_MODELS)}) AS m(model_name, provider) ON m.model_name = lined.model_name))
      SELECT {PAIRS}, CASE provider WHEN 'program' THEN TRY_CAST(ground_truth AS DOUBLE) ELSE answer_num END AS answer_num,
        CASE provider WHEN 'program' THEN 'success' ELSE parse_status END AS parse_status FROM p""",
)
def parse_all(spark, sf_dir):
    rows = _with_found(fx.structured_texts(spark, sf_dir))
    names = {p: [m for m, q in _CHAT_MODELS if q == p] for p in ("openai", "anthropic")}
    provider = F.when(F.col("model_name").isin(names["openai"]), "openai").when(F.col("model_name").isin(names["anthropic"]), "anthropic")
    run = F.struct(F.lit(True).alias("success"), F.col("ground_truth").alias("output"), F.lit(None).cast("string").alias("error"))
    parsed = bind(rows, {"p": A.parse_response(provider, provider.isNull(), F.col("content"), F.col("found"), run)})
    return parsed.select(*PAIR, N.to_number("p.final_answer").alias("answer_num"), F.col("p.parse_status").alias("parse_status"))


@query(
    "parse_strict",
    f"""WITH {_parse_ctes()}, p AS (SELECT {PAIRS}, provider, {_PARSED_SQL.format(line="WHEN provider = 'openai' AND by_line IS NOT NULL THEN " + number("by_line"), line_type="WHEN provider = 'openai' AND by_line IS NOT NULL AND " + number("by_line") + " IS NOT NULL THEN 'numeric'")}
      FROM (SELECT lined.*, m.provider FROM lined JOIN ({rows(_CHAT_MODELS)}) AS m(model_name, provider) ON m.model_name = lined.model_name))
      SELECT {PAIRS}, answer_num, answer_type, parse_status FROM p""",
)
def parse_strict(spark, sf_dir):
    """Chat texts only; with `strict`, a row of an unknown provider would raise."""
    names = {p: [m for m, q in _CHAT_MODELS if q == p] for p in ("openai", "anthropic")}
    texts = fx.structured_texts(spark, sf_dir).filter(F.col("model_name").isin([m for m, _ in _CHAT_MODELS]))
    provider = F.when(F.col("model_name").isin(names["openai"]), "openai").otherwise("anthropic")
    run = F.lit(None).cast("struct<success: boolean, output: string, error: string>")
    parsed = bind(_with_found(texts), {"p": A.parse_response(provider, F.lit(False), F.col("content"), F.col("found"), run, strict=True)})
    return parsed.select(
        *PAIR, N.to_number("p.final_answer").alias("answer_num"), F.col("p.final_answer_type").alias("answer_type"), F.col("p.parse_status").alias("parse_status")
    )


@query(
    "final_answer_regex",
    f"WITH {_parse_ctes()} SELECT {PAIRS}, by_regex AS value, {number('by_regex')} AS answer_num FROM lined WHERE by_regex IS NOT NULL",
)
def final_answer_regex(spark, sf_dir):
    body = A.collapse_braces("content")
    rows = bind(fx.structured_texts(spark, sf_dir), {"value": A.answer_by_regex(body)})
    return rows.filter(F.col("value").isNotNull()).select(*PAIR, "value", N.to_number("value").alias("answer_num"))


@query("answer_line", f"WITH {_parse_ctes()} SELECT {PAIRS}, by_line AS value FROM lined WHERE by_line IS NOT NULL")
def answer_line(spark, sf_dir):
    rows = bind(fx.structured_texts(spark, sf_dir), {"value": A.answer_line("content")})
    return rows.filter(F.col("value").isNotNull()).select(*PAIR, "value")


@query(
    "json_steps",
    f"""WITH {sql.texts()} SELECT {PAIRS}, len(raw_steps) AS n_steps, md5({_STEPS_TEXT_SQL.format(steps="raw_steps")}) AS steps_md5
      FROM fx_docs WHERE raw_steps IS NOT NULL""",
)
def json_steps(spark, sf_dir):
    rows = fx.answer_step_rows(spark, sf_dir).filter(F.col("raw_steps").isNotNull())
    doc = F.concat(F.lit('{"reasoning_steps":'), F.to_json("raw_steps"), F.lit("}"))
    read = bind(rows, {"steps": S.read_steps(doc)})
    return read.select(*PAIR, F.size("steps").cast(BIG).alias("n_steps"), F.md5(steps_text("steps")).alias("steps_md5"))


_MARK_SQL = f"""CASE WHEN regexp_matches(l, {quote(S.TEXT_DEFINITION)}) THEN 'v' WHEN regexp_matches(l, '[-+*/]') THEN 'c'
  WHEN regexp_matches(l, {quote(S.TEXT_CONDITIONAL)}) THEN 'i' WHEN regexp_matches(l, {quote(S.TEXT_RESULT)}) THEN 'r'
  WHEN regexp_matches(l, {quote(S.TEXT_NUMBERED)}) THEN 'N' ELSE 'O' END"""


@query(
    "text_steps",
    f"""WITH exploded AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_at FROM documents),
      trimmed AS (SELECT doc_id, line_at, {strip("raw")} AS l FROM exploded),
      marked AS (SELECT doc_id, line_at, l, {_MARK_SQL} AS mark FROM trimmed WHERE l <> ''),
      numbered AS (SELECT *, sum(CASE WHEN mark IN ('N', 'O') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_at) AS n,
        row_number() OVER (PARTITION BY doc_id ORDER BY line_at) AS line_no FROM marked)
      SELECT doc_id, line_no, CAST(n AS BIGINT) AS step_number,
        CASE mark WHEN 'v' THEN 'variable_definition' WHEN 'N' THEN 'variable_definition' WHEN 'c' THEN 'calculation' WHEN 'i' THEN 'conditional'
          WHEN 'r' THEN 'return_result' ELSE '' END AS step_type,
        md5(CASE mark WHEN 'v' THEN 'Define variable: ' || l WHEN 'c' THEN 'Calculate: ' || l WHEN 'i' THEN 'Conditional: ' || l
          WHEN 'r' THEN 'Final result: ' || l WHEN 'N' THEN 'Step ' || CAST(n AS BIGINT) || ': ' || l ELSE '' END) AS description_md5
      FROM numbered""",
)
def text_steps(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents", "doc_id", "text")
    docs = bind(docs, {"steps": S.text_steps("text")})
    rows = docs.select("doc_id", F.posexplode("steps").alias("at", "s"))
    return rows.select(
        "doc_id",
        (F.col("at") + 1).cast(BIG).alias("line_no"),
        F.col("s.step_number").cast(BIG).alias("step_number"),
        F.coalesce("s.step_type", F.lit("")).alias("step_type"),
        F.md5("s.description").alias("description_md5"),
    )


# --- envelopes and program runs --------------------------------------------------------


def _envelope() -> Column:
    """A provider's response JSON around the recorded text."""
    text, p, c = F.concat(F.lit(" "), "raw_response", F.lit("\n")), F.col("prompt_tokens"), F.col("completion_tokens")
    lift = lambda s: F.to_json(F.struct(s.alias("response")))
    chat = F.struct(
        F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"),
        F.struct(p.alias("prompt_tokens"), c.alias("completion_tokens")).alias("usage"),
    )
    blocks = F.struct(
        F.array(F.struct(text.alias("text"))).alias("content"),
        F.struct(p.alias("input_tokens"), c.alias("output_tokens")).alias("usage"),
    )
    candidates = F.struct(
        F.array(F.struct(F.struct(F.array(F.struct(text.alias("text"))).alias("parts")).alias("content"))).alias("candidates"),
        F.struct(p.alias("promptTokenCount"), c.alias("candidatesTokenCount")).alias("usageMetadata"),
    )
    m = F.col("model_name")
    return F.when(m == "gpt-4o-mini", lift(chat)).when(m == "claude-haiku-4", lift(blocks)).otherwise(lift(candidates))


@query(
    "envelope",
    f"""WITH {sql.runs(fx.MODEL_NAMES)} SELECT {PAIRS}, method, md5({strip("raw_response")}) AS text_md5, prompt_tokens, completion_tokens FROM fx_runs""",
)
def envelope(spark, sf_dir):
    m = F.col("model_name")
    provider = F.when(m == "gpt-4o-mini", "openai").when(m == "claude-haiku-4", "anthropic").otherwise("google")
    runs = fx.runs(spark, sf_dir, fx.MODEL_NAMES).select(*PAIR, "method", provider.alias("provider"), _envelope().alias("envelope"))
    read = bind(runs, {"e": A.read_envelope("provider", "envelope")})
    return read.select(*PAIR, "method", F.md5("e.text").alias("text_md5"), "e.prompt_tokens", "e.completion_tokens")


@query(
    "program_result",
    f"""WITH {sql.runs(fx.MODEL_NAMES, ["POT"])} SELECT {PAIRS}, CASE WHEN execution_error IS NULL THEN 'success' ELSE 'failed' END AS parse_status,
      CASE WHEN execution_error IS NULL THEN nullif(regexp_extract(execution_output, 'answer = (.+)', 1), '') END AS answer,
      CASE WHEN execution_error IS NULL THEN 'Code executed successfully' ELSE execution_error END AS parse_message,
      CASE WHEN execution_error IS NULL AND execution_output IS NOT NULL THEN 'numeric' ELSE 'text' END AS answer_type FROM fx_runs""",
)
def program_result(spark, sf_dir):
    runs = bind(fx.runs(spark, sf_dir, fx.MODEL_NAMES, ["POT"]), {"output": P.program_output_text("execution_output")})
    failed = F.col("execution_error").isNotNull()
    made = runs.select(*PAIR, A.program_result(~failed, F.col("output"), F.col("execution_error")).alias("p"))
    return made.select(
        *PAIR, "p.parse_status", F.col("p.final_answer").alias("answer"), "p.parse_message",
        F.col("p.final_answer_type").alias("answer_type"),
    )


_OUTPUTS = ["answer = 5", " 12 ", "total 3 then 4", "", "Answer='yes'", "done\n-7.5", "no numbers", "x\nanswer = [1, 2]\n"]


@query(
    "program_output",
    f"""WITH {sql.EXAMPLES}, o AS (SELECT example_id, CASE WHEN pos % 2 = 0 THEN 'answer = ' || ground_truth
        ELSE [{", ".join("replace(" + quote(x.replace(chr(10), "~")) + ", '~', chr(10))" for x in _OUTPUTS)}][pos // 2 % {len(_OUTPUTS)} + 1] END AS output FROM fx_examples),
      s AS (SELECT example_id, {strip("output")} AS o, {strip("regexp_extract(" + strip("output") + ", '(?i)answer\\s*=\\s*(.+)', 1)")} AS a FROM o),
      t AS (SELECT example_id, CASE WHEN o = '' THEN NULL WHEN a <> '' THEN
          CASE WHEN regexp_matches(a, '^''[^'']*''$') THEN substr(a, 2, length(a) - 2) ELSE a END
        WHEN regexp_matches({strip("string_split(o, chr(10))[-1]")}, '^-?\\d+\\.?\\d*$') THEN {strip("string_split(o, chr(10))[-1]")}
        ELSE coalesce(regexp_extract_all(o, '-?\\d+\\.?\\d*')[-1], o) END AS text FROM s)
      SELECT example_id, text, {number("text")} AS number FROM t""",
)
def program_output(spark, sf_dir):
    sample = F.get(F.array(*[F.lit(x) for x in _OUTPUTS]), (F.floor(F.col("pos") / 2) % len(_OUTPUTS)).cast("int"))
    output = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("answer = "), "ground_truth")).otherwise(sample)
    rows = bind(fx.examples(spark, sf_dir), {"o": P.program_output(output)})
    return rows.select("example_id", "o.text", "o.number")


_LOOSE_SQL = "[' ', 'Compute it.', 'x = 1', '  return x', '```', 'total is done', 'for i in y', 'a/b']"
_LOOSE = [" ", "Compute it.", "x = 1", "  return x", "```", "total is done", "for i in y", "a/b"]


def _reply() -> Column:
    """Responses with a Python fence, a bare fence, loose code around an open fence, or prose."""
    v = F.col("pos") % 4
    bit = lambda shift: F.get(F.array(*[F.lit(x) for x in _LOOSE]), ((F.floor(F.col("pos") / shift)) % 8).cast("int"))
    return (
        F.when(v == 0, F.concat(F.lit("Sure:\n```python\nanswer = "), "ground_truth", F.lit("\n```\nbye")))
        .when(v == 1, F.concat(F.lit("Code\n```\nreturn "), "ground_truth", F.lit("\n```")))
        .when(v == 2, F.concat_ws("\n", F.lit("Start"), bit(4), bit(32), F.lit("end of text")))
        .otherwise(F.concat(F.lit("It cannot be done for "), "example_id"))
    )


_REPLY_SQL = f"""CASE pos % 4 WHEN 0 THEN 'Sure:' || chr(10) || '```python' || chr(10) || 'answer = ' || ground_truth || chr(10) || '```' || chr(10) || 'bye'
  WHEN 1 THEN 'Code' || chr(10) || '```' || chr(10) || 'return ' || ground_truth || chr(10) || '```'
  WHEN 2 THEN 'Start' || chr(10) || {_LOOSE_SQL}[pos // 4 % 8 + 1] || chr(10) || {_LOOSE_SQL}[pos // 32 % 8 + 1] || chr(10) || 'end of text'
  ELSE 'It cannot be done for ' || example_id END"""
_CODE_SQL = f"""(regexp_matches({strip("l")}, '[=+\\-*/]') OR regexp_matches({strip("l")}, '^(def |class |return |print\\(|if |else:|for |while |import |from )'))"""
_FENCE_SQL = f"starts_with({strip('l')}, '```')"
_LINES_SQL = f"""list_filter(string_split(reply, chr(10)), lambda l, i: NOT {_FENCE_SQL} AND ({_CODE_SQL} OR
  coalesce(list_position(list_transform(string_split(reply, chr(10)), lambda l: {_FENCE_SQL}), TRUE), 0) BETWEEN 1 AND i))"""


@query(
    "code_extract",
    f"""WITH {sql.EXAMPLES}, r AS (SELECT example_id, {_REPLY_SQL} AS reply FROM fx_examples),
      c AS (SELECT example_id, CASE WHEN regexp_matches(reply, '(?s)```python\\s*\\n?(.*?)\\n?```') THEN {strip("regexp_extract(reply, '(?s)```python\\s*\\n?(.*?)\\n?```', 1)")}
        WHEN regexp_matches(reply, '(?s)```\\s*\\n?(.*?)\\n?```') THEN {strip("regexp_extract(reply, '(?s)```\\s*\\n?(.*?)\\n?```', 1)")}
        WHEN len({_LINES_SQL}) > 0 THEN {strip(f"array_to_string({_LINES_SQL}, chr(10))")} END AS code FROM r)
      SELECT example_id, code IS NOT NULL AS has_code, coalesce(code, '') AS code FROM c""",
)
def code_extract(spark, sf_dir):
    rows = bind(fx.examples(spark, sf_dir), {"reply": _reply()})
    rows = bind(rows, {"code": P.extract_code("reply")})
    return rows.select("example_id", F.col("code").isNotNull().alias("has_code"), F.coalesce("code", F.lit("")).alias("code"))


@query(
    "code_lines",
    f"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS l FROM conversations)
      SELECT conv_id, turn, count(*) AS n_lines, count(*) FILTER ({_CODE_SQL}) AS n_code FROM l GROUP BY 1, 2""",
)
def code_lines(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "conversations", "conv_id", "turn", "text").withColumn("l", F.split("text", "\n"))
    code = F.size(F.filter("l", P.looks_like_code))
    per_row = rows.select("conv_id", "turn", F.size("l").alias("n"), code.alias("c"))
    return per_row.groupBy("conv_id", "turn").agg(F.sum("n").alias("n_lines"), F.sum("c").alias("n_code"))


@query(
    "wrap_solution",
    f"""WITH {sql.EXAMPLES}, c AS (SELECT example_id, CASE pos % 3 WHEN 0 THEN 'return ' || ground_truth
        WHEN 1 THEN 'def solution():' || chr(10) || '    return ' || ground_truth
        ELSE 'def solution():' || chr(10) || '    return ' || ground_truth || chr(10) || 'solution()' END AS code, pos FROM fx_examples)
      SELECT example_id, CASE pos % 3 WHEN 0 THEN 'def solution():' || chr(10) || '    # Define variables name and value' || chr(10) || code || chr(10) || chr(10) || 'result = solution()'
        WHEN 1 THEN code || chr(10) || chr(10) || 'result = solution()' ELSE code END AS program FROM c""",
)
def wrap_solution(spark, sf_dir):
    v, head = F.col("pos") % 3, F.lit("def solution():\n    return ")
    code = (
        F.when(v == 0, F.concat(F.lit("return "), "ground_truth"))
        .when(v == 1, F.concat(head, "ground_truth"))
        .otherwise(F.concat(head, "ground_truth", F.lit("\nsolution()")))
    )
    rows = bind(fx.examples(spark, sf_dir), {"code": code})
    return rows.select("example_id", P.wrap_solution("code").alias("program"))


# --- steps -----------------------------------------------------------------------------

_TRUTH_ROWS_SQL = f"""exploded AS (
  SELECT example_id, unnest(string_split({strip("python_solution")}, chr(10))) AS raw,
    generate_subscripts(string_split({strip("python_solution")}, chr(10)), 1) AS step_number FROM fx_solutions),
trimmed AS (SELECT example_id, step_number, {strip("raw")} AS l FROM exploded),
truth AS (SELECT * FROM (SELECT example_id, step_number, l AS code_snippet,
  CASE WHEN l = '' THEN NULL WHEN len(string_split(l, '=')) = 2 THEN 'variable_definition' WHEN regexp_matches(l, '[+\\-*/]') THEN 'calculation'
    WHEN contains(l, 'if') THEN 'conditional' WHEN contains(l, 'return') OR contains(l, 'answer') THEN 'return_result' END AS step_type FROM trimmed) WHERE step_type IS NOT NULL),
truth_steps AS (SELECT *, CASE step_type WHEN 'variable_definition' THEN 'Define variable: ' WHEN 'calculation' THEN 'Calculate: '
    WHEN 'conditional' THEN 'Conditional check: ' ELSE 'Return result: ' END || code_snippet AS description FROM truth)"""


@query(
    "truth_steps",
    f"WITH {sql.EXAMPLES}, {sql.SOLUTIONS}, {_TRUTH_ROWS_SQL} SELECT example_id, step_number, step_type, description, code_snippet FROM truth_steps",
)
def truth_steps(spark, sf_dir):
    rows = bind(fx.solutions(spark, sf_dir), {"steps": S.truth_steps("python_solution")})
    rows = rows.select("example_id", F.inline("steps"))
    return rows.withColumn("step_number", F.col("step_number").cast(BIG))


_ANSWER_ROWS_SQL = f"""answer_steps AS (
  SELECT {PAIRS}, pos, generate_subscripts(raw_steps, 1) AS step_number, unnest(raw_steps) AS s FROM fx_answer_steps WHERE raw_steps IS NOT NULL),
answers AS (SELECT {PAIRS}, pos, step_number, s.description AS description, s.code_snippet AS code_snippet,
  CASE WHEN lower(s.step_type) IN ('variable_definition', 'calculation', 'conditional', 'return_result') THEN lower(s.step_type) ELSE 'variable_definition' END AS step_type FROM answer_steps)"""


@query(
    "answer_steps",
    f"WITH {sql.answer_steps()}, {_ANSWER_ROWS_SQL} SELECT {PAIRS}, step_number, step_type, description FROM answers",
)
def answer_steps(spark, sf_dir):
    rows = bind(fx.answer_step_rows(spark, sf_dir), {"steps": S.answer_steps("raw_steps")})
    rows = rows.select(*PAIR, F.inline("steps"))
    return rows.select(*PAIR, F.col("step_number").cast(BIG).alias("step_number"), "step_type", "description")


def _similarity_sql(a: str, b: str) -> str:
    words = lambda c: f"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> ''))"
    x, y = words(a), words(b)
    return f"""(CASE WHEN lower({a}) = lower({b}) OR contains(lower({a}), lower({b})) THEN 1.0 WHEN contains(lower({b}), lower({a})) THEN 0.5
      ELSE coalesce(len(list_intersect({x}, {y})) / nullif(len({x}) + len({y}) - len(list_intersect({x}, {y})), 0), 0.0) END)::DOUBLE"""


# Truth steps once per example, answer steps and measures within the row: nothing is joined back.
_TRUTH_LIST_SQL = f"""list_filter(list_transform(list_transform(string_split({strip("python_solution")}, chr(10)), lambda l: {strip("l")}), lambda l, i:
  struct_pack(n := i, k := CASE WHEN l = '' THEN NULL WHEN len(string_split(l, '=')) = 2 THEN 'variable_definition' WHEN regexp_matches(l, '[+\\-*/]') THEN 'calculation'
    WHEN contains(l, 'if') THEN 'conditional' WHEN contains(l, 'return') OR contains(l, 'answer') THEN 'return_result' END, l := l)), lambda s: s.k IS NOT NULL) AS lines,
list_transform(lines, lambda s: struct_pack(n := s.n, k := s.k, d := CASE s.k WHEN 'variable_definition' THEN 'Define variable: ' WHEN 'calculation' THEN 'Calculate: '
    WHEN 'conditional' THEN 'Conditional check: ' ELSE 'Return result: ' END || s.l)) AS ts"""
_MEASURES_SQL = f"""{sql.answer_steps(truth=_TRUTH_LIST_SQL)},
both_lists AS (SELECT * EXCLUDE (raw_steps, lines), list_transform(raw_steps, lambda s, i: struct_pack(n := i, d := s.description,
  k := CASE WHEN lower(s.step_type) IN ('variable_definition', 'calculation', 'conditional', 'return_result') THEN lower(s.step_type) ELSE 'variable_definition' END)) AS ans FROM fx_answer_steps),
typed AS (SELECT *, list_transform(ts, lambda s: s.k) AS tk, list_transform(ans, lambda s: s.k) AS ak, list_transform(ts, lambda s: s.n) AS tn FROM both_lists),
measured AS (SELECT *,
  CASE WHEN ans IS NULL THEN 0 ELSE len(list_filter(ts, lambda t: CASE WHEN ans[t.n].k = t.k THEN {_similarity_sql("t.d", "ans[t.n].d")} > 0.5 ELSE FALSE END)) END AS matched,
  CASE WHEN ans IS NULL THEN 0.0 ELSE matched / len(ts) END::DOUBLE AS step_completeness,
  CASE WHEN ans IS NULL THEN FALSE ELSE len(ts) = len(ans) END AS step_count_equal,
  CASE WHEN ans IS NULL THEN 0.0 WHEN tk[1:least(len(tk), len(ak))] = ak[1:least(len(tk), len(ak))] THEN 1.0 ELSE 0.5 END::DOUBLE AS step_order_correct,
  CASE WHEN ans IS NULL THEN 0.0 ELSE len(list_intersect(list_distinct(tk), list_distinct(ak))) / len(list_distinct(list_concat(tk, ak))) END::DOUBLE AS reasoning_similarity,
  CASE WHEN ans IS NULL THEN 0 ELSE len(list_filter(ans, lambda a: NOT list_contains(tn, a.n))) END AS n_extra
  FROM typed)"""


def _lists(spark, sf_dir) -> DataFrame:
    """Truth steps, read once per example, and answer steps of every model."""
    solved = bind(fx.solutions(spark, sf_dir), {"t": S.truth_steps("python_solution")})
    return bind(fx.answer_step_rows(spark, sf_dir, solved=solved), {"a": S.answer_steps("raw_steps")})


@query("step_match", f"WITH {_MEASURES_SQL} SELECT {PAIRS}, matched FROM measured WHERE ans IS NOT NULL")
def step_match(spark, sf_dir):
    rows = _lists(spark, sf_dir).filter(F.col("a").isNotNull())
    return rows.select(*PAIR, F.size(S.matched_steps(F.col("t"), F.col("a"))).cast(BIG).alias("matched"))


@query("step_completeness", f"WITH {_MEASURES_SQL} SELECT {PAIRS}, round(step_completeness, 6) AS step_completeness, step_count_equal FROM measured")
def step_completeness(spark, sf_dir):
    return _lists(spark, sf_dir).select(
        *PAIR, F.round(S.step_completeness("t", "a"), 6).alias("step_completeness"), S.same_count("t", "a").alias("step_count_equal")
    )


@query("step_order", f"WITH {_MEASURES_SQL} SELECT {PAIRS}, step_order_correct FROM measured")
def step_order(spark, sf_dir):
    return _lists(spark, sf_dir).select(*PAIR, S.step_order("t", "a").alias("step_order_correct"))


@query("reasoning_similarity", f"WITH {_MEASURES_SQL} SELECT {PAIRS}, round(reasoning_similarity, 6) AS reasoning_similarity FROM measured")
def reasoning_similarity(spark, sf_dir):
    return _lists(spark, sf_dir).select(*PAIR, F.round(S.reasoning_similarity("t", "a"), 6).alias("reasoning_similarity"))


@query("extra_steps", f"WITH {_MEASURES_SQL} SELECT {PAIRS}, n_extra, round(n_extra / len(ts), 6) AS hallucination_rate FROM measured")
def extra_steps(spark, sf_dir):
    extra = F.coalesce(F.size(S.extra_steps("t", "a")), F.lit(0))
    return _lists(spark, sf_dir).select(
        *PAIR,
        F.when(F.col("a").isNull(), 0).otherwise(extra).cast(BIG).alias("n_extra"),
        F.round(S.hallucination_rate("t", "a"), 6).alias("hallucination_rate"),
    )


def _final_answer() -> Column:
    v = F.col("pos") % 5
    return (
        F.when(v == 0, F.col("ground_truth"))
        .when(v == 1, F.concat(F.lit('{"final_answer": '), "ground_truth", F.lit("}")))
        .when(v == 2, F.concat(F.lit("1,"), "ground_truth"))
        .when(v == 3, F.lit('{"note": 1}'))
    )


_FINAL_SQL = """CASE pos % 5 WHEN 0 THEN ground_truth WHEN 1 THEN '{"final_answer": ' || ground_truth || '}'
  WHEN 2 THEN '1,' || ground_truth WHEN 3 THEN '{"note": 1}' END"""
_COMPARE_SQL = f"""{number("ground_truth", ",")} AS tn,
  CASE pos % 5 WHEN 1 THEN {number("ground_truth")} WHEN 3 THEN 0.0 ELSE {number("coalesce(final_answer, raw)", ",")} END AS an"""
_RESULT_SQL = "coalesce(tn IS NOT NULL AND an IS NOT NULL AND abs(tn - an) < 0.001, FALSE)"
_TYPE_SQL = "(tn IS NOT NULL AND an IS NOT NULL AND NOT starts_with(upper(coalesce(final_answer, raw)), 'ANSWER:'))"


def _final_rows(spark, sf_dir, solved: DataFrame | None = None) -> DataFrame:
    raw = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("ANSWER: "), "ground_truth")).otherwise(F.col("ground_truth"))
    return fx.answer_step_rows(spark, sf_dir, solved=solved).withColumns({"final_answer": _final_answer(), "raw_response": raw})


_FINAL_COLUMNS_SQL = f"{_FINAL_SQL} AS final_answer, CASE WHEN pos % 2 = 0 THEN 'ANSWER: ' || ground_truth ELSE ground_truth END AS raw"
_FINAL_ROWS_SQL = f"""finals AS (SELECT {PAIRS}, pos, ground_truth, {_FINAL_COLUMNS_SQL} FROM fx_answer_steps),
compared AS (SELECT *, {_COMPARE_SQL} FROM finals)"""


@query(
    "compare_final",
    f"WITH {sql.answer_steps()}, {_FINAL_ROWS_SQL} SELECT {PAIRS}, {_RESULT_SQL} AS correct, {_TYPE_SQL} AS type_match FROM compared",
)
def compare_final(spark, sf_dir):
    result = N.compare_final("ground_truth", F.coalesce("final_answer", "raw_response"))
    return bind(_final_rows(spark, sf_dir), {"r": result}).select(*PAIR, "r.correct", "r.type_match")


_SCORE_SQL = """round(final_correct::INT * 0.4::DOUBLE + step_completeness * 0.3::DOUBLE + step_order_correct * 0.1::DOUBLE
  + (1.0::DOUBLE - n_extra / len(ts)) * 0.2::DOUBLE, 6)"""
_SCORED_SQL = f"""{_MEASURES_SQL}, finals AS (SELECT *, {_FINAL_COLUMNS_SQL} FROM measured), compared AS (SELECT * EXCLUDE (tn), {_COMPARE_SQL} FROM finals),
full_rows AS (SELECT *, {_RESULT_SQL} AS final_correct, {_TYPE_SQL} AS final_type FROM compared)"""


def _metrics(spark, sf_dir) -> DataFrame:
    return scoring.metrics(_final_rows(spark, sf_dir, scoring.with_truth_steps(fx.solutions(spark, sf_dir))))


@query(
    "metrics",
    f"""WITH {_SCORED_SQL} SELECT {PAIRS}, final_correct AS final_answer_correct, final_type AS final_answer_matches_type,
      round(step_completeness, 6) AS step_completeness, step_count_equal, step_order_correct, round(reasoning_similarity, 6) AS reasoning_similarity,
      round(n_extra / len(ts), 6) AS hallucination_rate, n_extra > 0 AS has_hallucination, {_SCORE_SQL} AS overall_reasoning_score FROM full_rows""",
)
def metrics(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    rounded = ["step_completeness", "reasoning_similarity", "hallucination_rate", "overall_reasoning_score"]
    plain = ["final_answer_correct", "final_answer_matches_type", "step_count_equal", "step_order_correct", "has_hallucination"]
    return m.select(*PAIR, *plain, *[F.round(c, 6).alias(c) for c in rounded])


@query(
    "overall_score",
    f"WITH {_SCORED_SQL} SELECT model_name, count(*) AS answers, round(avg({_SCORE_SQL}), 6) AS avg_score FROM full_rows GROUP BY 1",
)
def overall_score(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    score = F.round("overall_reasoning_score", 6)
    return m.groupBy("model_name").agg(F.count(F.lit(1)).alias("answers"), F.round(F.avg(score), 6).alias("avg_score"))


_OTHER = ["what is the total", "order", "What is the total of order 17? Please", "net profit margin of it", ""]


@query(
    "similarity",
    f"""WITH {sql.EXAMPLES}, o AS (SELECT example_id, question, CASE WHEN pos % 6 = 5 THEN upper(question) ELSE [{sql.names(_OTHER)}][pos % 6 + 1] END AS other FROM fx_examples)
      SELECT example_id, round({_similarity_sql("question", "other")}, 6) AS forward, round({_similarity_sql("other", "question")}, 6) AS backward FROM o""",
)
def similarity(spark, sf_dir):
    picked = F.get(F.array(*[F.lit(x) for x in _OTHER]), (F.col("pos") % 6).cast("int"))
    other = F.when(F.col("pos") % 6 == 5, F.upper("question")).otherwise(picked)
    rows = bind(fx.examples(spark, sf_dir), {"other": other})
    return rows.select(
        "example_id",
        F.round(S.similarity("question", "other"), 6).alias("forward"),
        F.round(S.similarity("other", "question"), 6).alias("backward"),
    )


@query(
    "jaccard",
    """WITH w AS (SELECT conv_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS words FROM conversations),
      p AS (SELECT conv_id, min(turn) AS turn FROM w GROUP BY 1),
      f AS (SELECT w.conv_id, w.words FROM w JOIN p USING (conv_id, turn))
      SELECT w.conv_id, w.turn, len(list_intersect(w.words, f.words)) AS common,
        coalesce(round(len(list_intersect(w.words, f.words)) / nullif(len(list_distinct(list_concat(w.words, f.words))), 0), 6), 0.0) AS jaccard
      FROM w JOIN f USING (conv_id)""",
)
def jaccard(spark, sf_dir):
    """Word overlap of every turn with the first turn of its conversation."""
    turns = fx.table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != ""))
    first = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    pairs = turns.select("conv_id", "turn", words.alias("w")).join(first.select("conv_id", words.alias("f")), "conv_id")
    return pairs.select(
        "conv_id",
        "turn",
        F.size(F.array_intersect("w", "f")).cast(BIG).alias("common"),
        F.round(S.set_jaccard(F.col("w"), F.col("f")), 6).alias("jaccard"),
    )
