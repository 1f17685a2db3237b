"""Reading answers out of response text: free text, JSON, provider envelopes, analyses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubricon.functions import steps as S
from rubricon.functions.numbers import is_numeric, to_number
from rubricon.functions.text import as_col, fold_out, let, lines, preview, strip, without

# Answer phrases in order of priority, number shapes, JSON shapes.
COT_PATTERNS = [
    r"[Tt]herefore,?\s*the\s+answer\s+is\s*[:\s]*([+-]?\d+\.?\d*%?)",
    r"[Tt]he\s+answer\s+is\s*[:\s]*([+-]?\d+\.?\d*%?)",
    r"[Ff]inal\s+answer[:\s]*([+-]?\d+\.?\d*%?)",
    r"[Aa]nswer[:\s]*([+-]?\d+\.?\d*%?)\s*$",
]
PHRASE_GUARD = "nswer"
ANY_NUMBER = r"[+-]?\d+\.?\d*"
FLAT_OBJECT = r'\{[^{}]*"final_answer"[^{}]*\}'
# What a flat object needs behind its key; a search for the key itself, where that for a flat object tries every brace.
FLAT_END = r'"final_answer"[^{}]*\}'
TAIL_END = r'\}\s*(?:$|```)'
ANSWER_KEY = '"final_answer"'
BRACE_OR_TEXT = r"[{}]|[^{}]+"
# The first balanced object of a text without stray closing braces before it: three levels, 64 objects in one; then
# four, as steps with doubled braces have.
FIRST_OBJECT = r"^(?>[^{}]*)(\{(?:(?>[^{}]+)|\{(?:(?>[^{}]+)|\{(?>[^{}]*)\}){0,64}+\}){0,128}+\})"
FIRST_DEEP_OBJECT = r"^(?>[^{}]*)(\{(?:(?>[^{}]+)|\{(?:(?>[^{}]+)|\{(?:(?>[^{}]+)|\{(?>[^{}]*)\}){0,64}+\}){0,64}+\}){0,128}+\})"
ANSWER_NUMBER = r'"final_answer"\s*:\s*(\d+\.?\d*)'
ANSWER_QUOTED = r'"final_answer"\s*:\s*"([^"]*)"'
ANSWER_BARE = r'"final_answer"\s*:\s*([^,}\s]+)'
DEFAULT_CONFIDENCE = 0.7
RAW_TEXT_PREVIEW = 100
EVIDENCE_PREVIEW = 200

PARSED_TYPE = T.StructType(
    [
        T.StructField("final_answer", T.StringType()),
        T.StructField("final_answer_type", T.StringType()),
        T.StructField("reasoning_steps", T.ArrayType(S.STEP_TYPE)),
        T.StructField("parse_status", T.StringType()),
        T.StructField("parse_message", T.StringType()),
    ]
)


def cot_answer(text: Column | str) -> Column:
    """DOUBLE from a worked answer: the first phrase that matches, else the last number."""
    t = as_col(text)
    # A phrase that does not match extracts '', which is no number, so coalesce moves on.
    # All phrases contain the guard; other texts go straight to their last number.
    phrases = [without(F.regexp_extract(t, p, 1), "%").try_cast("double") for p in COT_PATTERNS]
    last = F.try_element_at(F.regexp_extract_all(t, F.lit(ANY_NUMBER), 0), F.lit(-1)).try_cast("double")
    return F.coalesce(F.when(t.contains(PHRASE_GUARD), F.coalesce(*phrases)), last)


# --- JSON inside text -----------------------------------------------------------------


def holds_answer(text: Column) -> Column:
    return F.try_variant_get(F.try_parse_json(text), "$.final_answer", "variant").isNotNull()


def balanced_objects(content: Column | str) -> Column:
    """ARRAY of the outermost brace-balanced pieces of a text, in order.

    A stray closing brace leaves the depth below zero, so that nothing opens until it is
    made up for.
    """
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(-1).alias("begin"))

    def step(s: Column, token: Column) -> tuple[Column, Column, Column]:
        opens, closes = token == "{", token == "}"
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        begin = F.when(opens & (s["depth"] == 0), s["at"]).otherwise(s["begin"])
        end = s["at"] + F.octet_length(token)
        complete = closes & (depth == 0) & (begin >= 0)
        state = F.struct(depth.alias("depth"), end.alias("at"), F.when(complete, -1).otherwise(begin).alias("begin"))
        return state, F.struct(begin.alias("begin"), end.alias("end")), complete

    # Byte offsets: a piece is cut out of the text once, when it is complete.
    tokens = F.regexp_extract_all(as_col(content), F.lit(BRACE_OR_TEXT), 0)
    spans = fold_out(tokens, zero, "struct<begin: int, end: int>", step)
    piece = lambda raw, p: F.substring(raw, p["begin"] + 1, p["end"] - p["begin"]).cast("string")
    return let(as_col(content).cast("binary"), lambda raw: F.transform(spans, lambda p: piece(raw, p)))


def balanced_object(content: Column | str) -> Column:
    """First balanced piece that is JSON with a `final_answer` key.

    Most texts have one object of few levels, which a pattern finds; braces are only counted
    through a text where that one isn't it and more follow, or where the pattern finds none.
    """
    c = as_col(content)

    def fits(p: Column) -> Column:
        return p.contains(ANSWER_KEY) & ~p.startswith("{{") & holds_answer(p)

    def chosen(p: Column) -> Column:
        behind = F.substr(c, F.instr(c, "{") + F.length(p))
        counted = F.get(F.filter(balanced_objects(c), fits), F.lit(0))
        return F.when((p != "") & fits(p), p).when((p == "") | behind.contains("{"), counted)

    deep = lambda p: F.when(p != "", p).otherwise(F.regexp_extract(c, FIRST_DEEP_OBJECT, 1))
    return let(let(F.regexp_extract(c, FIRST_OBJECT, 1), deep), chosen)


def valid_json(text: Column) -> Column:
    """The text if it is JSON. An object never begins with two braces: such texts are not parsed,
    for a parser that fails costs several times as much as one that does not."""
    return F.when(~text.startswith("{{") & F.try_parse_json(text).isNotNull(), text)


def tail_object(content: Column | str) -> Column:
    """Text from the first brace to the first closing brace behind the answer key that ends
    the text or precedes a fence; NULL without one. Positions instead of a lazy pattern:
    one pass over the text, whatever its length."""

    def cut(opened: Column, key_at: Column) -> Column:
        behind_key = key_at + (len(ANSWER_KEY) - 1)
        end_at = F.regexp_instr(F.substr(opened, behind_key + 1), F.lit(TAIL_END))
        return F.when(key_at > 0, let(end_at, lambda end: F.when(end > 0, F.left(opened, behind_key + end))))

    opened = F.substr(as_col(content), F.instr(as_col(content), "{"))
    return let(opened, lambda text: let(F.instr(text, ANSWER_KEY), lambda key_at: cut(text, key_at)))


def find_object(content: Column | str) -> Column:
    """JSON text of the answer object: a flat one, else one that runs to the end or a closing
    fence, else the first balanced one. Texts without the answer key are not searched."""
    c = as_col(content)
    flat = F.when(c.rlike(FLAT_END), F.nullif(F.regexp_extract(c, FLAT_OBJECT, 0), F.lit("")))
    found = F.coalesce(let(flat, valid_json), let(tail_object(c), valid_json), balanced_object(c))
    return F.when(c.contains(ANSWER_KEY) & c.contains("{"), found)


def collapse_braces(content: Column | str) -> Column:
    return F.replace(F.replace(as_col(content), F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))


def json_object(content: Column | str) -> Column:
    """The answer object: from the text as it is, else with doubled braces collapsed."""
    raw = as_col(content)
    doubled = raw.contains("{{") | raw.contains("}}")
    return F.coalesce(find_object(raw), F.when(doubled, let(collapse_braces(raw), find_object)))


def answer_by_regex(content: Column | str) -> Column:
    """Text after `"final_answer":` in broken JSON: unsigned number, quoted, bare; else NULL."""
    c = as_col(content)
    picks = [(p, F.regexp_extract(c, p, 1)) for p in (ANSWER_NUMBER, ANSWER_QUOTED, ANSWER_BARE)]
    out = F.when(~c.contains('"final_answer"'), F.lit(None).cast("string"))
    for pattern, value in picks:
        out = out.when(c.rlike(pattern), value)
    return out


def answer_line(content: Column | str) -> Column:
    """Text behind the last line that starts with `ANSWER:` in any case; NULL without one."""
    hits = F.filter(lines(strip(content)), lambda l: F.upper(strip(l)).startswith("ANSWER:"))
    last = strip(F.try_element_at(hits, F.lit(-1)))
    return strip(F.substring(last, 8, 2147483647))


def answer_type(value: Column) -> Column:
    return F.when(is_numeric(value), "numeric").otherwise("text")


def _parsed(final_answer, answer_kind, steps, status, message) -> Column:
    return F.struct(
        final_answer.cast("string").alias("final_answer"),
        answer_kind.alias("final_answer_type"),
        steps.alias("reasoning_steps"),
        F.lit(status).alias("parse_status"),
        message.alias("parse_message"),
    ).cast(PARSED_TYPE)


def _no_steps() -> Column:
    return F.array().cast(T.ArrayType(S.STEP_TYPE))


def _from_json(found: Column) -> Column:
    def read(doc: Column) -> Column:
        value = F.try_variant_get(doc, "$.final_answer", "variant")
        kind = F.regexp_extract(F.schema_of_variant(value), "^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)", 1)
        return _parsed(
            F.try_variant_get(doc, "$.final_answer", "string"),
            F.when(kind != "", "numeric").otherwise("text"),
            F.coalesce(S.read_steps(found), _no_steps()),
            "success",
            F.lit("Successfully parsed structured JSON"),
        )

    return let(F.try_parse_json(found), read)


def _from_regex(value: Column) -> Column:
    return _parsed(value, answer_type(value), _no_steps(), "partial", F.lit("Extracted final_answer from content"))


def _from_line(value: Column) -> Column:
    message = F.lit("Extracted ANSWER from last line (fallback mode)")
    return _parsed(value, answer_type(value), _no_steps(), "partial", message)


def _if_found(value: Column, result: Callable[[Column], Column]) -> Column:
    """`result(value)` where there is a value, evaluated once; else NULL."""
    return let(value, lambda v: F.when(v.isNotNull(), result(v)))


def parse_structured(content: Column | str, found: Column | str) -> Column:
    """Chat-completion text → parsed response. `found` is `json_object(content)`."""
    raw, found = as_col(content), as_col(found)
    body = collapse_braces(raw)
    raw_result = _parsed(
        F.when(body != "", preview(strip(body), RAW_TEXT_PREVIEW)),
        F.lit("text"),
        _no_steps(),
        "partial",
        F.lit("No structured format found, using raw text"),
    )
    return F.coalesce(
        F.when(found.isNotNull(), _from_json(found)),
        _if_found(answer_by_regex(body), _from_regex),
        _if_found(answer_line(body), _from_line),
        raw_result,
    )


def _from_text(steps: Column) -> Column:
    count = F.size(steps).cast("string")
    message = F.concat(F.lit("Parsed "), count, F.lit(" reasoning steps from unstructured text"))
    return _parsed(F.lit(None), F.lit("text"), steps, "partial", message)


def parse_blocks(content: Column | str, found: Column | str) -> Column:
    """Content-block text → parsed response; unstructured text becomes steps line by line."""
    raw, found = as_col(content), as_col(found)
    body = collapse_braces(raw)
    return F.coalesce(
        F.when(found.isNotNull(), _from_json(found)),
        _if_found(answer_by_regex(body), _from_regex),
        let(S.text_steps(body), _from_text),
    )


def program_result(success: Column, output: Column, error: Column) -> Column:
    """Outcome of a program run → parsed response. The run itself is an input, never made here."""
    failed = _parsed(F.lit(None), F.lit("text"), _no_steps(), "failed", error)
    done = _parsed(output, answer_type(output), _no_steps(), "success", F.lit("Code executed successfully"))
    return F.when(F.coalesce(success, F.lit(False)), done).otherwise(failed)


def parse_response(provider: Column, is_program: Column, content: Column, found: Column, run: Column, strict: bool = False) -> Column:
    """Dispatch by program flag, then provider. Unknown providers give NULL, or raise when strict.

    `run` is STRUCT<success, output, error>.
    """
    unknown = (
        F.raise_error(F.concat(F.lit("Unknown provider type: "), provider)).cast(PARSED_TYPE)
        if strict
        else F.lit(None).cast(PARSED_TYPE)
    )
    return (
        F.when(is_program, program_result(run["success"], run["output"], run["error"]))
        .when(provider == "openai", parse_structured(content, found))
        .when(provider == "anthropic", parse_blocks(content, found))
        .otherwise(unknown)
    )


# --- provider envelopes ----------------------------------------------------------------

# Where each provider keeps the text and the token counts.
ENVELOPE_PATHS = {
    "openai": (
        "$.response.choices[0].message.content",
        "$.response.usage.prompt_tokens",
        "$.response.usage.completion_tokens",
    ),
    "anthropic": (
        "$.response.content[0].text",
        "$.response.usage.input_tokens",
        "$.response.usage.output_tokens",
    ),
    "google": (
        "$.response.candidates[0].content.parts[0].text",
        "$.response.usageMetadata.promptTokenCount",
        "$.response.usageMetadata.candidatesTokenCount",
    ),
}


def read_envelope(provider: Column | str, envelope: Column | str) -> Column:
    """STRUCT<text, prompt_tokens, completion_tokens> from a provider's JSON; parsed once per row."""
    p = as_col(provider)

    def read(doc: Column) -> Column:
        def pick(index: int, kind: str) -> Column:
            out = None
            for name, paths in ENVELOPE_PATHS.items():
                value = F.try_variant_get(doc, paths[index], kind)
                out = F.when(p == name, value) if out is None else out.when(p == name, value)
            return out

        return F.struct(
            F.coalesce(strip(pick(0, "string")), F.lit("")).alias("text"),
            F.coalesce(pick(1, "bigint"), F.lit(0)).alias("prompt_tokens"),
            F.coalesce(pick(2, "bigint"), F.lit(0)).alias("completion_tokens"),
        )

    # Pasted into the branches, the parse would run once per field.
    return let(F.try_parse_json(as_col(envelope)), read)


# --- error analyses written by a model -------------------------------------------------


def labelled_field(text: Column, label: str) -> Column:
    """Text behind `LABEL:` up to the next upper-case label or the end; '' when absent."""
    return strip(F.regexp_extract(text, rf"(?is){label}:\s*(.+?)(?=\n[A-Z_]+:|$)", 1))


def analysis_fields(text: Column | str) -> Column:
    """STRUCT of the five labelled fields and a confidence clipped to [0, 1]."""
    t = as_col(text)
    confidence = F.coalesce(
        F.regexp_extract(t, r"CONFIDENCE:\s*([\d.]+)", 1).try_cast("double"), F.lit(DEFAULT_CONFIDENCE)
    )

    def field(label: str, default: str) -> Column:
        return F.coalesce(F.nullif(labelled_field(t, label), F.lit("")), F.lit(default))

    return F.struct(
        field("ERROR_TYPE", "UNKNOWN").alias("error_type"),
        field("SUMMARY", "Analysis incomplete").alias("summary"),
        field("DETAILED_ANALYSIS", "").alias("detailed_analysis"),
        field("LIKELY_CAUSE", "").alias("likely_cause"),
        field("CORRECT_APPROACH", "").alias("correct_approach"),
        F.greatest(F.least(confidence, F.lit(1.0)), F.lit(0.0)).alias("confidence"),
    )


# Section labels of a composed evidence text.
DETAIL_LABEL = "상세 분석"
CAUSE_LABEL = "원인"
APPROACH_LABEL = "올바른 접근"


def compose_evidence(analysis: Column) -> Column:
    """One evidence text out of `analysis_fields`."""
    return F.concat(
        F.lit("["), analysis["error_type"], F.lit("] "), analysis["summary"],
        F.lit(f"\n\n{DETAIL_LABEL}: "), analysis["detailed_analysis"],
        F.lit(f"\n\n{CAUSE_LABEL}: "), analysis["likely_cause"],
        F.lit(f"\n\n{APPROACH_LABEL}: "), analysis["correct_approach"],
    )


def evidence_fields(evidence: Column | str) -> Column:
    """Split an evidence text back into sections; plain evidence becomes a short summary."""
    e = F.coalesce(as_col(evidence), F.lit(""))

    def section(label: str) -> Column:
        return strip(F.regexp_extract(e, rf"(?s){label}:\s*(.+?)(?:\n\n|$)", 1))

    summary = strip(F.regexp_extract(e, r"\[[\w_]+\]\s*(.+?)(?:\n\n|$)", 1))
    detail = section(DETAIL_LABEL)
    return F.struct(
        F.when((summary == "") & (detail == ""), preview(e, EVIDENCE_PREVIEW, "...")).otherwise(summary).alias("summary"),
        detail.alias("detail"),
        section(CAUSE_LABEL).alias("cause"),
        section(APPROACH_LABEL).alias("approach"),
    )
