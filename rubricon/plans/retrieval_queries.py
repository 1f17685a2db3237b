"""Registered queries: keywords, function retrieval, prompts with functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rubricon.functions import tokens as K
from rubricon.operators import prompts
from rubricon.operators import retrieval as X
from rubricon.plans import fixtures as fx
from rubricon.plans import sql
from rubricon.plans.registry import query
from rubricon.plans.report_queries import _template_sql
from rubricon.plans.sql import quote
from rubricon import templates as T

BIG = "bigint"

_WORDS_SQL = "list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z]{{3,}}'))"


def _terms_sql(c: str, terms: list[str]) -> str:
    return f"list_filter([{sql.names(terms)}], lambda t: contains(lower({c}), t))"


_INDEX_SQL = f"""fx_index AS (SELECT doc_id AS pos, list_distinct(list_concat(regexp_extract_all(lower('def calc_' || source), '[a-z]{{3,}}'),
    {_terms_sql("text", K.FINANCE_TERMS)}, {_WORDS_SQL.format(c="text")})) AS keywords FROM documents),
fx_query_texts AS (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL VALUES (-1, 'what is the'), (-2, '12')),
fx_asked AS (SELECT query_id, query, list_distinct(list_filter(list_concat({_WORDS_SQL.format(c="query")}, regexp_extract_all(query, '\\d{{3,}}'),
    {_terms_sql("query", K.QUERY_TERMS)}), lambda w: w NOT IN ({sql.names(K.QUERY_STOP_WORDS)}))) AS keywords FROM fx_query_texts)"""
_SCORES_SQL = f"""{_INDEX_SQL}, pairs AS (
  SELECT q.query_id, f.pos, count(*) AS common, any_value(len(qk)) AS nq, any_value(len(fk)) AS nf
  FROM (SELECT query_id, keywords AS qk, unnest(keywords) AS t FROM fx_asked) q JOIN (SELECT pos, keywords AS fk, unnest(keywords) AS t FROM fx_index) f USING (t) GROUP BY 1, 2),
scores AS (SELECT query_id, pos, common, common / (nq + nf - common) AS score FROM pairs)"""
_TOP_SQL = f"""{_SCORES_SQL}, best AS (SELECT query_id, pos, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS rank FROM scores QUALIFY rank <= 5),
first_rows AS (SELECT doc_id AS pos, row_number() OVER (ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 5),
fallback AS (SELECT query_id, rank, pos FROM (SELECT query_id FROM fx_query_texts WHERE query_id NOT IN (SELECT query_id FROM best)), first_rows),
ranked AS (SELECT query_id, rank, pos FROM best UNION ALL SELECT query_id, rank, pos FROM fallback)"""


def _listed(words: str):
    return F.array_join(F.array_sort(words), " ")


@query(
    "function_keywords",
    f"WITH {_INDEX_SQL} SELECT pos, len(keywords) AS n_keywords, md5(array_to_string(list_sort(keywords), ' ')) AS keywords_md5 FROM fx_index",
)
def function_keywords(spark, sf_dir):
    indexed = X.index_functions(fx.functions(spark, sf_dir))
    return indexed.select("pos", F.col("n_keywords").cast(BIG).alias("n_keywords"), F.md5(_listed("keywords")).alias("keywords_md5"))


@query(
    "query_keywords",
    f"WITH {_INDEX_SQL} SELECT query_id, array_to_string(list_sort(keywords), ' ') AS keywords FROM fx_asked",
)
def query_keywords(spark, sf_dir):
    return X.index_queries(fx.queries(spark, sf_dir)).select("query_id", _listed("keywords").alias("keywords"))


@query("keyword_index", f"WITH {_INDEX_SQL} SELECT unnest(keywords) AS keyword, pos FROM fx_index")
def keyword_index(spark, sf_dir):
    return X.keyword_index(X.index_functions(fx.functions(spark, sf_dir)))


@query("retrieve_scores", f"WITH {_SCORES_SQL} SELECT query_id, pos, common, round(score, 9) AS score FROM scores")
def retrieve_scores(spark, sf_dir):
    q, f = X.index_queries(fx.queries(spark, sf_dir)), X.index_functions(fx.functions(spark, sf_dir))
    return X.score_pairs(q, f).withColumn("score", F.round("score", 9))


@query("retrieve_topk", f"WITH {_TOP_SQL} SELECT query_id, rank, pos, round(score, 9) AS score FROM best")
def retrieve_topk(spark, sf_dir):
    q, f = X.index_queries(fx.queries(spark, sf_dir)), X.index_functions(fx.functions(spark, sf_dir))
    best = X.top_functions(q, f, 5)
    return best.select("query_id", F.col("rank").cast(BIG).alias("rank"), "pos", F.round("score", 9).alias("score"))


@query("retrieve_fallback", f"WITH {_TOP_SQL} SELECT query_id, rank, pos FROM fallback")
def retrieve_fallback(spark, sf_dir):
    functions = fx.functions(spark, sf_dir)
    q, f = X.index_queries(fx.queries(spark, sf_dir)), X.index_functions(functions)
    rest = X.fallback(q, X.top_functions(q, f, 5), functions, 5)
    return rest.select("query_id", F.col("rank").cast(BIG).alias("rank"), "pos")


_CONTEXT_TEXTS_SQL = """fx_query_texts AS (SELECT item_id AS query_id, 'net growth of item ' || item_id || '? ' || coalesce(left(text, 200), '') AS query FROM benchmark)"""
_CONTEXT_TOP_SQL = _TOP_SQL.replace(
    "fx_query_texts AS (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL VALUES (-1, 'what is the'), (-2, '12'))", _CONTEXT_TEXTS_SQL
)


@query("retrieve_context", f"WITH {_CONTEXT_TOP_SQL} SELECT query_id, rank, pos, round(score, 9) AS score FROM best")
def retrieve_context(spark, sf_dir):
    """Searched with the question and the opening of its context."""
    asked = fx.table(spark, sf_dir, "benchmark", "item_id", "text")
    question = F.concat(F.lit("net growth of item "), F.col("item_id").cast("string"), F.lit("?"))
    asked = asked.select(F.col("item_id").alias("query_id"), K.retrieval_query(question, "text").alias("query"))
    best = X.top_functions(X.index_queries(asked), X.index_functions(fx.functions(spark, sf_dir)), 5)
    return best.select("query_id", F.col("rank").cast(BIG).alias("rank"), "pos", F.round("score", 9).alias("score"))


@query("retrieve_kept", f"WITH {_TOP_SQL} SELECT query_id, rank, pos FROM best WHERE score >= 0.05 AND rank <= 3")
def retrieve_kept(spark, sf_dir):
    """Candidates that an outside filter keeps; stand-ins for missing matches have score 0."""
    keep = (F.col("score") >= 0.05) & (F.col("rank") <= 3)
    kept = X.retrieve(fx.queries(spark, sf_dir), fx.functions(spark, sf_dir), 5, keep=keep)
    return kept.select("query_id", F.col("rank").cast(BIG).alias("rank"), "pos")


_BLOCK_SQL = f"""{_TOP_SQL}, blocks AS (SELECT query_id, {quote(X.BLOCK_TITLE)} || string_agg('# ' || source || chr(10) || '```python' || chr(10) || 'def calc_' || source || chr(10) || '```' || chr(10) || chr(10), '' ORDER BY rank) AS block
  FROM ranked JOIN documents ON pos = doc_id GROUP BY 1)"""


def _blocks(spark, sf_dir):
    functions = fx.functions(spark, sf_dir)
    ranked = X.retrieve(fx.queries(spark, sf_dir), functions, 5)
    return X.format_functions(ranked, functions)


@query("format_functions", f"WITH {_BLOCK_SQL} SELECT query_id, block AS functions_text FROM blocks")
def format_functions(spark, sf_dir):
    return _blocks(spark, sf_dir)


@query(
    "enhance_prompt",
    f"""WITH {_BLOCK_SQL}, p AS (SELECT query_id, CASE WHEN query_id % 4 = 0 THEN 'Q: ' || query
        ELSE {_template_sql(T.ENHANCED_PROMPT, {"functions": "block", "prompt": "'Q: ' || query"})} END AS prompt FROM fx_query_texts JOIN blocks USING (query_id))
      SELECT query_id, md5(prompt) AS prompt_md5, length(prompt) AS n_chars FROM p""",
)
def enhance_prompt(spark, sf_dir):
    rows = fx.queries(spark, sf_dir).join(_blocks(spark, sf_dir), "query_id")
    shown = F.when(F.col("query_id") % 4 == 0, "").otherwise(F.col("functions_text"))
    made = rows.select("query_id", prompts.enhance_prompt(F.concat(F.lit("Q: "), "query"), shown).alias("prompt"))
    return made.select("query_id", F.md5("prompt").alias("prompt_md5"), F.length("prompt").cast(BIG).alias("n_chars"))


_DEFAULT_LEN = len("\n\n".join(T.TEMPLATES["default"]).replace("{question}", "").replace("{context}", "").replace("{python_solution}", ""))
_RAG_LEN = len(
    "\n\n".join(T.TEMPLATES["cot_rag"])
    .replace("{question}", "").replace("{context}", "").replace("{python_solution}", "")
    .replace("{functions_instructions}", T.FUNCTIONS_NOTE).replace("{functions}", "")
)


@query(
    "prompt_size_delta",
    f"""WITH {_BLOCK_SQL}, d AS (SELECT {_RAG_LEN} + length(block) - {_DEFAULT_LEN} AS delta FROM blocks)
      SELECT count(*) AS prompts, round(avg(delta), 6) AS avg_delta, max(delta) AS max_delta, count(*) FILTER (delta > 0) AS longer FROM d""",
)
def prompt_size_delta(spark, sf_dir):
    from rubricon.operators.reports import prompt_size_delta as summarise

    rows = fx.queries(spark, sf_dir).join(_blocks(spark, sf_dir), "query_id").select(
        F.col("query").alias("question"), F.lit("[]").alias("context"), F.lit("x = 1").alias("python_solution"), "functions_text"
    )
    sizes = prompts.prompt_sizes(rows, "default", "cot_rag")
    return summarise(sizes).withColumn("max_delta", F.col("max_delta").cast(BIG))
