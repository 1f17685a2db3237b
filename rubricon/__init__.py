"""rubricon: scoring and analysis of recorded model answers as Spark DataFrames."""

__version__ = "0.1.0"
