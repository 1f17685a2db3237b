"""Program text: finding code in a response, wrapping it, reading its recorded output.

Nothing here runs code; outcomes arrive as a table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rubricon.functions.numbers import to_number
from rubricon.functions.text import as_col, contains_any, let, lines, starts_with_any, strip

# Fences, code markers, error names.
FENCE = "```"
PYTHON_FENCE = "```python"
CODE_MARKS = ["=", "+", "-", "*", "/"]
CODE_STARTS = ["def ", "class ", "return ", "print(", "if ", "else:", "for ", "while ", "import ", "from "]
SOLUTION_HEAD = "def solution():"
SOLUTION_OPENING = "def solution():\n    # Define variables name and value\n"
SOLUTION_CALL = "\n\nresult = solution()"
ASSIGNED_ANSWER = r"(?i)answer\s*=\s*(.+)"
QUOTED = r"""^(["'])([^"'\\]*)\1$"""
PLAIN_NUMBER = r"^-?\d+\.?\d*$"
OUTPUT_NUMBER = r"-?\d+\.?\d*"
EXECUTION_ERRORS = {
    "SyntaxError": "Python syntax error in generated code",
    "NameError": "Undefined variable in generated code",
    "TypeError": "Type mismatch in calculation",
    "ZeroDivisionError": "Division by zero",
    "ValueError": "Invalid value conversion",
    "IndexError": "Index out of range",
    "KeyError": "Missing dictionary key",
}
OTHER_EXECUTION_ERROR = "Unknown execution error"


def looks_like_code(line: Column | str) -> Column:
    text = strip(line)
    return contains_any(text, CODE_MARKS) | starts_with_any(text, CODE_STARTS)


def code_lines(text: Column | str) -> Column:
    """Lines that look like code, plus every line behind an unclosed fence."""
    rows = lines(text)
    fences = F.transform(rows, lambda l: strip(l).startswith(FENCE))

    def kept(opened: Column) -> Column:
        def keep(line: Column, at: Column) -> Column:
            inside = (opened > 0) & (at >= opened)
            return ~strip(line).startswith(FENCE) & (inside | looks_like_code(line))

        return F.filter(rows, keep)

    return let(F.array_position(fences, F.lit(True)), kept)


def fenced_code(text: Column | str) -> Column:
    """Trimmed text of the first closed Python fence, else of the first closed fence; NULL
    without one. Plain searches for the fence marks: no backtracking over long responses."""
    t = as_col(text)

    def closed(opening: str) -> Column:
        rest = F.substr(t, F.instr(t, opening) + len(opening))
        return F.when(t.contains(opening) & rest.contains(FENCE), strip(F.substring_index(rest, FENCE, 1)))

    return F.when(t.contains(FENCE), F.coalesce(closed(PYTHON_FENCE), closed(FENCE)))


def extract_code(text: Column | str) -> Column:
    """Code of a Python fence, of any fence, or the lines that look like code; else NULL."""
    t = as_col(text)
    loose = code_lines(t)
    joined = let(loose, lambda l: F.when(F.size(l) > 0, strip(F.array_join(l, "\n"))))
    return F.coalesce(fenced_code(t), joined)


def fenced_or_whole(text: Column | str) -> Column:
    """Fenced code, or the whole trimmed response when no fence holds anything."""
    return let(fenced_code(text), lambda code: code_or_text(code, text))


def code_or_text(code: Column | str, text: Column | str) -> Column:
    """The code found in a text, or all of the trimmed text."""
    c = as_col(code)
    return F.when(c != "", c).otherwise(strip(text))


def wrap_solution(code: Column | str) -> Column:
    """Program text with a `solution()` function and a call that keeps its result."""
    return let(with_head(code), with_call)


def with_head(code: Column | str) -> Column:
    c = as_col(code)
    return F.when(c.contains(SOLUTION_HEAD), c).otherwise(F.concat(F.lit(SOLUTION_OPENING), c))


def with_call(program: Column | str) -> Column:
    p = as_col(program)
    elsewhere = F.replace(p, F.lit("def solution()"), F.lit("")).contains("solution()")
    called = elsewhere & p.rlike(r"(?m)^\s*solution\(\)")
    return F.when(called, p).otherwise(F.concat(p, F.lit(SOLUTION_CALL)))


def program_output(output: Column | str) -> Column:
    """STRUCT<text, number> from recorded output; NULL fields for blank output."""
    text = program_output_text(output)
    return F.struct(text.alias("text"), to_number(text).alias("number"))


def program_output_text(output: Column | str) -> Column:
    """The answer in recorded output: an assignment, the last line or the last number, else all of it."""
    return let(strip(output), lambda out: let(assigned_answer(out), lambda a: answer_in_output(out, a)))


def assigned_answer(output: Column | str) -> Column:
    return strip(F.regexp_extract(as_col(output), ASSIGNED_ANSWER, 1))


def answer_in_output(output: Column | str, assigned: Column | str) -> Column:
    """`program_output_text` of trimmed output and the answer that it assigns."""
    out, a = as_col(output), as_col(assigned)
    last_line = strip(F.try_element_at(lines(out), F.lit(-1)))
    last_number = F.try_element_at(F.regexp_extract_all(out, F.lit(OUTPUT_NUMBER), 0), F.lit(-1))
    loose = F.when(last_line.rlike(PLAIN_NUMBER), last_line).otherwise(F.coalesce(last_number, out))
    return F.when(out != "", F.when(a != "", F.regexp_replace(a, QUOTED, "$2")).otherwise(loose))


def execution_error_type(message: Column | str) -> Column:
    """What went wrong in a failed run: the first known error name that appears."""
    m = as_col(message)
    out = None
    for name, label in EXECUTION_ERRORS.items():
        out = F.when(m.contains(name), label) if out is None else out.when(m.contains(name), label)
    return out.otherwise(OTHER_EXECUTION_ERROR)
