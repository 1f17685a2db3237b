"""Small text helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\f"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` evaluated once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Items of a block, and blocks of a group, in `fold_out`.
FOLD_BLOCK = 64


def _cut(items: Column, width: int) -> Column:
    last = F.floor((F.size(items) - 1) / F.lit(width)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda j: F.slice(items, j * width + 1, F.lit(width)))


def fold_out(items: Column, zero: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """ARRAY of what a fold over `items` gives out on its way.

    `step(state, item)` returns the next state (of the type of `zero`), a value of type `kind`, and
    whether that is given out. A fold copies what it carries at every step, so items are folded in
    blocks and blocks in groups: a step copies a block's values, a block a group's, and only a
    group all values before it.
    """
    none = F.array().cast(f"array<{kind}>")

    def carried(state: Column, out: Column) -> Column:
        return F.struct(state.alias("state"), out.alias("out"))

    def one(acc: Column, item: Column) -> Column:
        state, value, given = step(acc["state"], item)
        return carried(state, F.when(given, F.array_append(acc["out"], value)).otherwise(acc["out"]))

    def behind(acc: Column, parts: Column, merge: Callable[[Column, Column], Column]) -> Column:
        """The fold of `parts` from the state of `acc`, its values put behind those of `acc`."""
        finish = lambda a: carried(a["state"], F.concat(acc["out"], a["out"]))
        return F.aggregate(parts, carried(acc["state"], none), merge, finish)

    block = lambda acc, x: behind(acc, x, one)
    group = lambda acc, x: behind(acc, _cut(x, FOLD_BLOCK), block)
    return let(items, lambda x: F.aggregate(_cut(x, FOLD_BLOCK**2), carried(zero, none), group, lambda acc: acc["out"]))


def strip(c: Column | str) -> Column:
    """Trim every kind of ASCII blank from both ends, not only spaces."""
    return F.trim(as_col(c), F.lit(BLANKS))


def without(c: Column | str, chars: str) -> Column:
    """The text without some characters: plain searches, while `translate` looks up each character."""
    text = as_col(c)
    for char in chars:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def lines(c: Column | str) -> Column:
    return F.split(as_col(c), "\n")


def first_chars(c: Column | str, limit: int) -> Column:
    """The first `limit` characters. Characters are only counted through a text where its first
    `limit` bytes are not all ASCII: read as Latin-1, other bytes take two bytes of UTF-8."""
    text = as_col(c)
    cut = F.substring(text.cast("binary"), 1, limit)
    ascii_only = F.octet_length(F.decode(cut, "ISO-8859-1")) == limit
    return F.when(F.octet_length(text) <= limit, text).when(ascii_only, cut.cast("string")).otherwise(F.left(text, F.lit(limit)))


def preview(c: Column | str, limit: int, ellipsis: str = "") -> Column:
    """The first `limit` characters, with `ellipsis` only where text was cut."""
    col = as_col(c)
    cut = F.left(col, F.lit(limit))
    return F.when(F.length(col) > limit, F.concat(cut, F.lit(ellipsis))).otherwise(col)


def contains_any(c: Column, needles: list[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | c.contains(needle)
    return hit


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | c.startswith(prefix)
    return hit


def int_div(a: Column | str, b: int) -> Column:
    """Integer division, exact over the whole BIGINT range."""
    return F.call_function("div", as_col(a), F.lit(b))


def money(cents: Column | str) -> Column:
    """Integer cents as text with two decimals (exact, no floating point)."""
    c = as_col(cents)
    return F.concat(
        int_div(c, 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0")
    )
