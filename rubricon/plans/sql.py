"""Building blocks of the oracle SQL (DuckDB): the derived inputs and scored runs."""

from __future__ import annotations

from rubricon import dims
from rubricon.functions import answers as A
from rubricon.functions import numbers as N
from rubricon.operators import errors as E
from rubricon.plans.fixtures import MODEL_NAMES

BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def quote(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


def rows(values: list[tuple]) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(map(quote, v)) + ")" for v in values)


def names(values: list[str]) -> str:
    return ", ".join(map(quote, values))


def money(c: str) -> str:
    return f"(({c}) // 100)::VARCHAR || '.' || lpad((({c}) % 100)::VARCHAR, 2, '0')"


def strip(c: str) -> str:
    return f"trim({c}, {BLANKS})"


def number(c: str, drop: str = "") -> str:
    text = c
    for char in drop:
        text = f"replace({text}, {quote(char)}, '')"
    return f"TRY_CAST(regexp_extract({text}, {quote(N.NUMERIC)}, 1) AS DOUBLE)"


def cot(c: str) -> str:
    picks = [f"TRY_CAST(replace(regexp_extract({c}, {quote(p)}, 1), '%', '') AS DOUBLE)" for p in A.COT_PATTERNS]
    last = f"TRY_CAST(regexp_extract_all({c}, {quote(A.ANY_NUMBER)})[-1] AS DOUBLE)"
    return f"coalesce({', '.join(picks)}, {last})"


def within(p: str, t: str, tolerance: float = N.ANSWER_TOLERANCE) -> str:
    return f"(CASE WHEN {t} = 0 THEN abs({p}) < {tolerance} ELSE abs({p} - {t}) / nullif(abs({t}), 0) <= {tolerance} END)"


def check(p: str, t: str) -> str:
    """Answer check of two text expressions."""
    pn, tn = number(p, ",%"), number(t, ",%")
    truth_text = f"coalesce({t}, 'none')"
    return (
        f"(CASE WHEN {p} IS NULL THEN FALSE WHEN {pn} IS NOT NULL AND {tn} IS NOT NULL THEN {within(pn, tn)} "
        f"ELSE lower({strip(p)}) = lower({strip(truth_text)}) END)"
    )


def deviation(p: str, t: str) -> str:
    return f"(CASE WHEN {t} = 0 THEN abs({p}) ELSE abs({p} - {t}) / nullif(abs({t}), 0) END)"


def written(c: str) -> str:
    found = f"regexp_extract_all({c}, {quote(E.WRITTEN_NUMBER)})"
    return (
        f"list_filter(list_transform({found}, lambda m: TRY_CAST(replace(m, ',', '') AS DOUBLE)), "
        "lambda n: n IS NOT NULL)"
    )


def foreign(text: str, context: str) -> str:
    known = f"flatten(list_transform({written(context)}, lambda n: [n, n * 100, n / 100, n * 1000, n / 1000]))"
    common = ", ".join(map(str, E.COMMON_NUMBERS))
    return (
        f"(CASE WHEN {context} IS NOT NULL AND {context} NOT IN ('', '[]') THEN list_sort(list_filter(list_distinct({written(text)}), "
        f"lambda n: n > 0.01 AND NOT list_contains([{common}], n) AND n > 1 AND n < 1e12 AND NOT list_contains({known}, n))) END)"
    )


EXAMPLES = f"""fx_examples AS (
  SELECT o_orderkey AS pos, 'test-' || o_orderkey AS example_id,
         CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'hard'
              WHEN left(o_orderpriority, 1) = '3' THEN 'medium' ELSE 'easy' END AS level,
         CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         {money("CAST(round(o_totalprice * 100) AS BIGINT)")} AS ground_truth,
         'What is the total of order ' || o_orderkey || '?' AS question,
         CASE WHEN o_orderkey % 20 = 0 THEN '[]'
              ELSE 'Order ' || o_orderkey || ' total ' || {money("CAST(round(o_totalprice * 100) AS BIGINT)")} END AS context,
         'status-' || o_orderstatus AS source
  FROM orders)"""

MODELS = "fx_models AS (SELECT * FROM (" + rows(
    [(i, m[0], m[2], m[3], int(round(float(m[4]) * 1000)), int(round(float(m[5]) * 1000))) for i, m in enumerate(dims.MODELS)]
) + ") AS t(ord, model_name, provider, model_type, milli_in, milli_out))"


def grid(models: list[str] | None = None, methods: list[str] | None = None) -> str:
    cells = [
        (MODEL_NAMES.index(m), m, dims.METHODS.index(x), x) for m in models or MODEL_NAMES for x in methods or dims.METHODS
    ]
    return f"({rows(cells)}) AS g(ord, model_name, mo, method)"


def runs(models: list[str] | None = None, methods: list[str] | None = None) -> str:
    """CTEs `fx_examples` and `fx_runs`."""
    return f"""{EXAMPLES}, fx_cases_of AS (
  SELECT e.*, g.*, (pos * 7 + ord * 13 + mo * 5) % 10 AS c FROM fx_examples e, {grid(models, methods)}),
fx_amounts AS (
  SELECT *, CASE WHEN c <= 3 THEN cents WHEN c = 4 THEN cents * 1001 // 1000 WHEN c = 5 THEN cents * 105 // 100
                 WHEN c = 8 THEN cents * 2 WHEN c = 9 THEN cents * 3 END AS ac FROM fx_cases_of),
fx_runs AS (
  SELECT pos, example_id, level, cents, ground_truth, question, context, source, ord, model_name, mo, method,
         CASE WHEN method = 'COT' THEN
                CASE WHEN ac IS NULL THEN 'I cannot determine it.'
                     ELSE CASE WHEN c = 8 THEN 'Take 7777.77 and 8888.88. ' ELSE '' END
                          || 'Therefore, the answer is ' || {money("ac")} END
              WHEN c = 7 THEN '```python' || chr(10) || 'answer = x' || chr(10) || '```'
              WHEN ac IS NULL THEN 'I cannot determine it.'
              ELSE '```python' || chr(10)
                   || CASE WHEN c = 8 THEN 'x = 7777.77' || chr(10) || 'y = 8888.88' || chr(10) ELSE '' END
                   || 'answer = ' || {money("ac")} || chr(10) || '```' END AS raw_response,
         CASE WHEN method = 'POT' AND ac IS NOT NULL THEN 'answer = ' || {money("ac")} END AS execution_output,
         CASE WHEN method = 'POT' AND c = 7 THEN 'NameError: name ''x'' is not defined' END AS execution_error,
         200 + pos % 800 AS prompt_tokens, 50 + (pos * 31 + ord) % 400 AS completion_tokens,
         ((pos * 17 + ord * 3) % 5000) / 1000.0 AS latency_seconds
  FROM fx_amounts)"""


def scored(models: list[str] | None = None, methods: list[str] | None = None) -> str:
    """CTEs up to `scored`: answers, correctness, cost, category."""
    wrapped = (
        "'def solution():' || chr(10) || '    # Define variables name and value' || chr(10) || "
        f"coalesce(nullif({strip('''regexp_extract(raw_response, '(?s)```python\\s*\\n?(.*?)\\n?```', 1)''')}, ''), {strip('raw_response')}) "
        "|| chr(10) || chr(10) || 'result = solution()'"
    )
    return f"""{runs(models, methods)}, {MODELS},
read AS (
  SELECT r.*, {number("ground_truth", ",%")} AS truth_num,
         CASE WHEN method = 'COT' THEN {cot("raw_response")}
              ELSE {number("regexp_extract(execution_output, 'answer = (.+)', 1)")} END AS predicted_num,
         CASE WHEN method = 'POT' THEN nullif(regexp_extract(execution_output, 'answer = (.+)', 1), '') END AS predicted_text,
         CASE WHEN method = 'POT' THEN {wrapped} END AS executed_code
  FROM fx_runs r),
judged AS (
  SELECT read.*, coalesce(m.model_type, 'general') AS model_type, m.model_name IS NOT NULL AS registered,
         coalesce({within("predicted_num", "truth_num")}, FALSE) AS is_correct,
         (prompt_tokens * milli_in + completion_tokens * milli_out + 500) // 1000 AS cost_micros,
         {deviation("predicted_num", "truth_num")} AS deviation
  FROM read LEFT JOIN fx_models m USING (model_name)),
scored AS (
  SELECT *, CASE WHEN NOT is_correct THEN
      CASE WHEN execution_error IS NOT NULL THEN 'execution_error'
           WHEN predicted_num IS NULL AND predicted_text IS NULL THEN 'parsing_error'
           WHEN deviation < 0.002 THEN 'rounding_error'
           WHEN deviation < 0.1 THEN 'numerical_calculation_error'
           WHEN len({foreign("coalesce(executed_code, raw_response)", "context")}) >= 2 THEN 'hallucination'
           ELSE 'unknown' END END AS error_category
  FROM judged)"""


SOLUTIONS = """fx_solutions AS (
  SELECT *, 'qty = ' || (pos % 50) || chr(10) || 'price = ' || cents || chr(10) || chr(10)
    || 'total = qty * price' || chr(10) || 'print(total / 2)' || chr(10) || 'if total > 0:' || chr(10)
    || '    return total' AS python_solution FROM fx_examples)"""


def _step(n: int, kind: str, description: str, snippet: str) -> str:
    return (
        f"{{'step_number': {n}, 'step_type': '{kind}', 'description': {description}, 'code_snippet': {snippet}}}"
    )


def answer_steps(models: list[str] | None = None, truth: str = "") -> str:
    """CTEs up to `fx_answer_steps`; `truth` is a list of columns that are worked out once per example."""
    qty, price = "'qty = ' || (pos % 50)", "'price = ' || cents"
    d, calc, cond, ret = "variable_definition", "calculation", "conditional", "return_result"
    s1 = _step(1, d, f"'Define variable: ' || {qty}", qty)
    s2 = _step(2, d, f"'Define variable: ' || {price}", price)
    s3 = _step(3, d, "'Define variable: total = qty * price'", "'total = qty * price'")
    s4 = _step(4, calc, "'Calculate: print(total / 2)'", "'print(total / 2)'")
    s5 = _step(5, cond, "'Conditional check: if total > 0:'", "'if total > 0:'")
    s6 = _step(6, ret, "'Return result: return total'", "'return total'")
    s4x = s4.replace(f"'{calc}'", "'CONDITIONAL'")
    s5x = s5.replace(f"'{cond}'", "'other'")
    s7, s8 = (_step(n, calc, "'Check the total'", "''") for n in (7, 8))
    solved = f"fx_solved AS MATERIALIZED (SELECT *, {truth} FROM fx_solutions), " if truth else ""
    return f"""{EXAMPLES}, {SOLUTIONS}, {solved}fx_answer_steps AS (
  SELECT e.*, g.*, CASE (pos + ord) % 5
      WHEN 0 THEN [{s1}, {s2}, {s3}, {s4}, {s5}, {s6}]
      WHEN 1 THEN [{s1}, {s2}, {s3}, {s4}, {s5}]
      WHEN 2 THEN [{s1}, {s2}, {s3}, {s4x}, {s5x}, {s6}]
      WHEN 3 THEN [{s1}, {s2}, {s3}, {s4}, {s5}, {s6}, {s7}, {s8}] END AS raw_steps
  FROM {"fx_solved" if truth else "fx_solutions"} e, {grid(models or MODEL_NAMES, ["COT"])})"""


def texts(models: list[str] | None = None) -> str:
    """CTEs up to `fx_texts`."""
    doc = "'{\"final_answer\":' || ground_truth || ',\"reasoning_steps\":' || coalesce(to_json(raw_steps)::VARCHAR, '[]') || '}'"
    return f"""{answer_steps(models)}, fx_docs AS (
  SELECT *, {doc} AS doc, (pos * 3 + ord) % 8 AS variant FROM fx_answer_steps),
fx_texts AS (
  SELECT *, CASE variant
      WHEN 0 THEN doc
      WHEN 1 THEN 'Result:' || chr(10) || '```json' || chr(10) || doc || chr(10) || '```'
      WHEN 2 THEN 'Sure. {{"final_answer": -' || ground_truth || '}}'
      WHEN 3 THEN 'Here: ' || doc || ' That is all.'
      WHEN 4 THEN '"final_answer": ' || ground_truth || ', oops'
      WHEN 5 THEN 'Some text' || chr(10) || 'answer: ' || ground_truth || chr(10) || 'Thanks'
      WHEN 6 THEN 'No idea about ' || question || chr(10) || '1. try again' || chr(10) || 'total = 5 '
      ELSE replace(replace(doc, '{{', '{{{{'), '}}', '}}}}') END AS content
  FROM fx_docs)"""


LOG = """fx_log AS (
  SELECT event_id AS pos, ts AS created_at, user_id::VARCHAR AS example_id, event_type AS model,
         CAST(round(value * 100) AS BIGINT) AS cost_cents, md5(props) AS prompt_hash, props AS prompt FROM events)"""
