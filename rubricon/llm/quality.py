"""Quality rules with a robust multivariate outlier test.

Counts of every text are taken in one pass. Each language and source then has a
minimum-covariance-determinant estimate of its transformed statistics: from three deterministic
starts, concentration steps fit centre and scatter to the (n + p + 1) / 2 rows that lie nearest
until the determinant no longer falls; the fit with the smallest determinant is taken, and a last
reweighted step uses all rows that fit. Quantiles and moments are partial aggregates
over all rows, so a group of any size never meets in one task. A document is rejected if its
squared Mahalanobis distance is above `CUTOFF`, or by the base rules.

The statistics are mean word length and shares of symbols, capitals, repeated lines and repeated
words. Each is shrunk by `PRIOR` words of the plain corpus, so a short text is no outlier by chance,
and no scale is taken as smaller than its `FLOOR`, so a group of spotless texts keeps a text with
a single symbol.

Groups of fewer than `LEAST_ROWS` rows take the estimate of all rows of their language, and that of
the whole corpus if that is too small as well; null languages and sources are groups of their own.
Null and empty texts have zero counts and fail the base rules. Rows are kept as they are, repeated
ones too; columns that have the name of an added one are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricon.llm.flat import row_rounds, span_hash, sums_by_row, text_bytes, word_spans
from rubricon.session import stored

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals"]
STATISTICS = ["word_length", "symbols", "capitals", "lines", "repeats"]
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
LEAST_ROWS = 100
#: The nearest half of a five-dimensional normal law has this part of its scatter.
CORE_SCATTER = 0.523
#: Fall of a log determinant below which a fit has converged; accuracy of quantiles.
SETTLED, ACCURACY = 1e-3, 10_000
PRIOR = 40.0
#: Smallest standard deviation taken of each statistic, on its transformed scale.
FLOOR = [0.03, 0.04, 0.05, 0.15, 0.15]
#: Squared distance above which a text is rejected; the chi-squared law with 5 degrees of freedom
#: exceeds it once in ten million.
CUTOFF = 41.0
#: Squared distance up to which a row takes part in the reweighted step (97.5 % point).
REWEIGHT = 12.83

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal at all, has an equal before it) for each key."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[order][1:] == keys[order][:-1]
    any_, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    any_[order] = same[1:] | same[:-1]
    later[order] = same[:-1]
    return any_, later


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS of each row of flat texts."""
    n = len(offsets) - 1
    starts, ends, words = word_spans(data, offsets)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    capital, letter = (data - np.uint8(65)) < 26, ((data | np.uint8(0x20)) - np.uint8(97)) < 26
    out = {
        "n_words": np.diff(words),
        "word_chars": sums_by_row(chars[ends] - chars[starts], words),
        "n_symbols": sums_by_row(_IS_SYMBOL[data], offsets),
        "n_letters": sums_by_row(letter, offsets),
        "n_capitals": sums_by_row(capital, offsets),
    }
    # Lines end at a line feed or with their text.
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    end = np.sort(np.concatenate([breaks, offsets[1:]]))
    line_row = np.searchsorted(np.cumsum(np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=n) + 1), np.arange(len(begin)), "right")
    begin, end = (x[np.lexsort((x, line_row))] if n > 1 else x for x in (begin, end))
    with_word = np.flatnonzero(np.searchsorted(starts, end) > np.searchsorted(starts, begin))
    row_salt = (np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    _, later = repeated(span_hash(data, begin[with_word], end[with_word]) ^ row_salt[line_row[with_word]])
    out["n_dup_lines"] = np.bincount(line_row[with_word[later]], minlength=n)
    out["n_lines"] = np.bincount(line_row[with_word], minlength=n)
    # Windows of five words, each within one text.
    hashes = span_hash(data, starts, ends)
    out["n_repeat_words"] = np.zeros(n, np.int64)
    if len(hashes) >= WINDOW:
        rolled = np.zeros(len(hashes) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            rolled = (rolled ^ hashes[k : k + len(rolled)]) * np.uint64(0x9E3779B97F4A7C15)
            rolled ^= rolled >> np.uint64(31)
        row = np.repeat(np.arange(n), np.diff(words))
        inside = np.flatnonzero(row[: len(rolled)] == row[WINDOW - 1 :])
        found, _ = repeated(rolled[inside] ^ row_salt[row[inside]])
        change = np.bincount(inside[found], minlength=len(hashes) + WINDOW)
        change[WINDOW:] -= change[:-WINDOW].copy()
        out["n_repeat_words"] = sums_by_row(np.cumsum(change)[: len(hashes)] > 0, words)
    return out


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds COUNTS as longs."""
    kept = [c for c in df.columns if c not in COUNTS]
    schema = df.select(*kept, *[F.lit(0).cast("long").alias(c) for c in COUNTS]).schema

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.schema.names.index(text)))
            for lo, hi in row_rounds(offsets):
                counts = text_counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                columns = [batch.column(batch.schema.names.index(c)).slice(lo, hi - lo) for c in kept]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(counts[c].astype(np.int64)) for c in COUNTS], [*kept, *COUNTS])

    return df.mapInArrow(run, schema)


def transformed(mean_length: float) -> list[Column]:
    """STATISTICS of a row of counts; `mean_length` is the corpus's mean word length."""
    words = F.col("n_words") + PRIOR

    def share(part: str, whole: Column) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / whole)))

    return [
        F.log((F.col("word_chars") + PRIOR * mean_length) / words),
        share("n_symbols", F.col("word_chars") + PRIOR * mean_length),
        share("n_capitals", F.col("n_letters") + PRIOR * mean_length),
        share("n_dup_lines", F.col("n_lines") + PRIOR / 10),
        share("n_repeat_words", words),
    ]


def squared_distance() -> Column:
    x = [F.col(s) - F.get("centre", F.lit(i)) for i, s in enumerate(STATISTICS)]
    p = len(STATISTICS)
    terms = [F.get("inverse", F.lit(i * p + j)) * x[i] * x[j] * (1 if i == j else 2) for i in range(p) for j in range(i, p)]
    return sum(terms[1:], terms[0])


def symmetric(flat: np.ndarray) -> np.ndarray:
    """Matrices of the rows of their upper triangles."""
    p = len(STATISTICS)
    out = np.zeros((len(flat), p, p))
    for k, (i, j) in enumerate((i, j) for i in range(p) for j in range(i, p)):
        out[:, i, j] = out[:, j, i] = flat[:, k]
    return out


ESTIMATES = "grp string, start int, centre array<double>, inverse array<double>, size double"


def estimate_rows(grp, start, centre: np.ndarray, scatter: np.ndarray) -> pa.RecordBatch:
    kind = pa.list_(pa.float64())
    inverse = np.linalg.inv(scatter).reshape(len(scatter), -1)
    columns = [grp, start, pa.array(list(centre), kind), pa.array(list(inverse), kind), pa.array(np.linalg.slogdet(scatter)[1], pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["grp", "start", "centre", "inverse", "size"])


def estimates(moments: DataFrame, inflate: float) -> DataFrame:
    """(grp, start, centre, inverse, size: log of the scatter's determinant) from each group's
    count, sums and sums of products."""
    p = len(STATISTICS)

    def run(batches):
        for batch in batches:
            n = np.maximum(np.asarray(batch["n"], float), 1)
            sums = np.array(batch["sums"].to_pylist(), float).reshape(-1, p)
            products = symmetric(np.array(batch["products"].to_pylist(), float).reshape(len(n), -1))
            centre = sums / n[:, None]
            scatter = (products / n[:, None, None] - centre[:, :, None] * centre[:, None, :]) * inflate
            scatter = (scatter + scatter.transpose(0, 2, 1)) / 2 + np.diag(np.square(FLOOR))
            yield estimate_rows(batch["grp"], batch["start"], centre, scatter)

    return moments.mapInArrow(run, ESTIMATES)


def products(x: list[Column]) -> Column:
    return F.array(*[F.sum(x[i] * x[j]) for i in range(len(x)) for j in range(i, len(x))])


def moments(rows: DataFrame) -> DataFrame:
    x = [F.col(s) for s in STATISTICS]
    return rows.groupBy("grp", "start").agg(F.count("*").alias("n"), F.array(*map(F.sum, x)).alias("sums"), products(x).alias("products"))


def starts(rows: DataFrame) -> DataFrame:
    """ESTIMATES to start from, three for each group: around coordinate-wise medians, the scatter of
    median absolute deviations alone, of spatial signs, and of hyperbolic tangents."""
    p = len(STATISTICS)
    middle = [F.percentile_approx(s, 0.5, ACCURACY) for s in STATISTICS]
    centres = stored(rows.groupBy("grp").agg(F.array(*middle).alias("centre")), "medians")
    off = [F.col(s) - F.col("centre")[i] for i, s in enumerate(STATISTICS)]
    # Normal law: a standard deviation is 1.4826 median absolute deviations.
    scale = [F.sqrt(F.pow(1.4826 * F.percentile_approx(F.abs(x), 0.5, ACCURACY), 2) + f * f) for x, f in zip(off, FLOOR)]
    spread = rows.join(centres, "grp").groupBy("grp").agg(F.array(*scale).alias("scale"))
    frames = stored(centres.join(spread, "grp"), "scales")
    z = [F.col(f"z{i}") for i in range(p)]
    scaled = rows.join(frames, "grp").select("grp", *[(off[i] / F.col("scale")[i]).alias(f"z{i}") for i in range(p)])
    length = F.greatest(F.sqrt(sum((x * x for x in z[1:]), z[0] * z[0])), F.lit(1e-9))
    summed = scaled.groupBy("grp").agg(
        F.count("*").alias("n"), products([x / length for x in z]).alias("signs"), products([F.tanh(x) for x in z]).alias("tanhs")
    )

    def run(batches):
        for batch in batches:
            n = np.asarray(batch["n"], float)[:, None, None]
            centre, scale = (np.array(batch[c].to_pylist(), float).reshape(-1, p) for c in ("centre", "scale"))
            shapes = [np.tile(np.eye(p), (len(n), 1, 1))]
            for c, factor in (("signs", p), ("tanhs", 2)):
                shapes.append(symmetric(np.array(batch[c].to_pylist(), float).reshape(len(n), -1)) / n * factor + 0.01 * np.eye(p))
            for k, shape in enumerate(shapes):
                start = pa.array(np.full(len(n), k, np.int32))
                yield estimate_rows(batch["grp"], start, centre, shape * scale[:, :, None] * scale[:, None, :])

    return summed.join(frames, "grp").mapInArrow(run, ESTIMATES)


def grouped(rows: DataFrame, lang: str, source: str) -> tuple[DataFrame, DataFrame]:
    """`rows` with `grp`, the group whose estimate a row uses, and `levels`, all groups that it
    belongs to; and the groups in use (grp)."""
    name = F.to_json(F.struct(F.col(lang).alias("l"), F.col(source).alias("s")))
    language = F.to_json(F.struct(F.col(lang).alias("l")))
    # Marked by level: without its nulls, a name of one level can equal one of another.
    rows = rows.withColumns({"_fine": F.concat(F.lit("source "), name), "_wide": F.concat(F.lit("language "), language)})
    fine = stored(rows.filter(~F.col("base_failed")).groupBy("_fine", "_wide").agg(F.count("*").alias("_n_fine")), "sizes")
    wide = fine.groupBy("_wide").agg(F.sum("_n_fine").alias("_n_wide"))
    chosen = F.when(F.col("_n_fine") >= LEAST_ROWS, F.col("_fine")).when(F.col("_n_wide") >= LEAST_ROWS, F.col("_wide")).otherwise(F.lit(""))
    used = stored(fine.join(wide, "_wide").select("_fine", chosen.alias("grp")), "groups")
    rows = rows.join(used, "_fine", "left").withColumn("levels", F.array("_fine", "_wide", F.lit(""))).drop("_fine", "_wide")
    return rows, used.select("grp").distinct()


def fitted_estimates(rows: DataFrame) -> DataFrame:
    """(grp, centre, inverse) of every group, from `rows` (grp, STATISTICS)."""

    def near(current: DataFrame) -> DataFrame:
        return rows.join(current.select("grp", "start", "centre", "inverse"), "grp").select("grp", "start", *STATISTICS, squared_distance().alias("d2"))

    # The core has (n + p + 1) / 2 rows: the next of these shares of a group that has at least as many.
    shares = [0.5 + k / 100 for k in range(51)]
    above = F.ceil(50 * (len(STATISTICS) + 1) / F.count("*"))
    limit = F.get(F.percentile_approx("d2", F.array(*map(F.lit, shares)), ACCURACY), F.least(above, F.lit(50)).cast("int"))
    current = stored(starts(rows), "estimates")
    least = None
    while True:
        core = stored(near(current).groupBy("grp", "start").agg(limit.alias("limit")), "limits")
        chosen = near(current).join(core, ["grp", "start"]).filter("d2 <= limit")
        current = stored(estimates(moments(chosen), 1 / CORE_SCATTER), "estimates")
        now = current.select("grp", "start", F.col("size").alias("now"))
        if least is None:
            least = stored(now.withColumnsRenamed({"now": "least"}), "sizes")
            continue
        # A step lowers the determinant or leaves it; approximate quantiles alone could raise it again.
        met = now.join(least, ["grp", "start"])
        if met.filter(F.col("now") < F.col("least") - SETTLED).isEmpty():
            break
        least = stored(met.select("grp", "start", F.least("now", "least").alias("least")), "sizes")
    best = current.groupBy("grp").agg(F.min_by(F.struct("start", "centre", "inverse"), F.struct("size", "start")).alias("best")).select("grp", "best.*")
    fitting = near(stored(best, "best")).filter(F.col("d2") <= REWEIGHT)
    return estimates(moments(fitting), 1.0).select("grp", "centre", "inverse")


def judged(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds COUNTS, `base_failed`, `distance` (squared Mahalanobis; null where the base rules fail)
    and `kept`; columns of `df` with these names are replaced, all others are kept, whatever their names."""
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # The fit works with columns of its own, so the given ones go through it under other names.
    inner = {c: f"_given{i}" for i, c in enumerate(df.columns)}
    rows = df.select(*[F.col(f"`{c}`").alias(name) for c, name in inner.items()])
    # Read once for every step of the fit, so the counts are written down first.
    counted = stored(with_counts(rows, inner[text]).withColumn("base_failed", base_failed), "counts")
    found = judged_counts(counted, inner[lang], inner[source])
    added = [*COUNTS, "base_failed", "distance", "kept"]
    given = [F.col(name).alias(c) for c, name in inner.items() if c.lower() not in added]
    return found.select(*given, *added)


def judged_counts(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """As `judged`, for rows that have their counts and `base_failed`."""
    total = counted.filter("not base_failed").agg(F.sum("word_chars"), F.sum("n_words")).first()
    mean_length = (total[0] or 5) / (total[1] or 1)
    rows, used = grouped(counted, lang, source)
    rows = rows.withColumns(dict(zip(STATISTICS, transformed(mean_length))))
    # A row counts at every level that some row falls back to, not only at its own.
    members = rows.filter("not base_failed").select(F.explode("levels").alias("grp"), *STATISTICS)
    found = stored(fitted_estimates(members.join(stored(used, "used"), "grp", "left_semi")), "estimates")
    distance = F.when(~F.col("base_failed"), squared_distance())
    return (
        rows.join(found, "grp", "left")
        .withColumn("distance", distance)
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))
        .drop("grp", "levels", "centre", "inverse", *STATISTICS)
    )
