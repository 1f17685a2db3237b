"""Columns that are computed exactly once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name of the struct that is unpacked again at once.
BOUND = "_bound"


def bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that the optimizer will not copy into the plan above them.

    A plain derived column is pasted into every filter and condition that mentions it:
    with nested regular expressions the plan grows multiplicatively and each copy is
    evaluated again; an explode even adds a filter on the exploded value's size. Here the values come out of a one-element generator, which stays a
    pipelined narrow step (no shuffle, no materialisation) but ends the pasting. The generator
    only unpacks a struct that a projection below it has made: projections are compiled, while a
    generator interprets its expressions wherever one of them has no generated code.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*kept, made.alias(BOUND)).select(*kept, F.inline(F.array(BOUND)))
