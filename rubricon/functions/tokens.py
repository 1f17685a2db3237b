"""Keyword sets for retrieval. Word limits are spelled out as letter and digit runs,
because `\\b` means different things to different regex engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubricon.functions.text import as_col

# Finance terms looked up as substrings, query stop words, restored terms.
FINANCE_TERMS = [
    "calculate", "return", "yield", "rate", "growth", "bonus", "probability", "salary",
    "investment", "revenue", "income", "ratio", "percentage", "value", "cost", "profit",
    "margin", "depreciation", "amortization", "npv", "irr", "cash", "flow", "earnings",
    "share", "dividend", "yoy", "ytd", "annual", "yearly", "monthly", "compounding",
    "discount", "interest", "principal", "payment", "annuity", "premium",
]
QUERY_STOP_WORDS = [
    "the", "a", "an", "is", "of", "to", "in", "for", "with", "what", "how", "find", "get",
    "calculate", "compute",
]
QUERY_TERMS = ["return", "growth", "rate"]
NOT_WORD = r"[^\p{L}\p{N}_]+"
MIN_LENGTH = 3
QUERY_CONTEXT_CHARS = 200


def _latin_words(text: Column) -> Column:
    """Whole words made of a-z only, at least three letters."""
    words = F.array_distinct(F.split(text, NOT_WORD))
    return F.filter(words, lambda w: w.rlike("^[a-z]{3,}$"))


def _present_terms(text: Column, terms: list[str]) -> Column:
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def function_keywords(source: Column | str, docstring: Column | str) -> Column:
    """Distinct keywords of a library function: letter runs of its source, finance terms
    found anywhere in its docstring, and the docstring's words."""
    code, doc = F.lower(as_col(source)), F.lower(as_col(docstring))
    runs = F.regexp_extract_all(code, F.lit(r"[a-z]{3,}"), 0)
    return F.array_distinct(F.concat(runs, _present_terms(doc, FINANCE_TERMS), _latin_words(doc)))


def query_keywords(query: Column | str) -> Column:
    """Distinct keywords of a question: words, digit runs (also inside words) and restored
    terms, without stop words."""
    q = F.lower(as_col(query))
    digits = F.regexp_extract_all(q, F.lit(r"\d{3,}"), 0)
    found = F.concat(_latin_words(q), digits, _present_terms(q, QUERY_TERMS))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(QUERY_STOP_WORDS)))


def retrieval_query(question: Column | str, context: Column | str) -> Column:
    """Question plus the opening of its context, the text that retrieval searches for."""
    return F.concat(as_col(question), F.lit(" "), F.left(F.coalesce(as_col(context), F.lit("")), F.lit(QUERY_CONTEXT_CHARS)))
