"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; every other training text is unlabelled, whatever its
label says. Features are the presence of words and of word beginnings (four and five bytes) among
`BUCKETS` hashes. How many positive and unlabelled texts have each feature is counted over all
training texts; the `FEATURES` that tell most are used. A linear classifier is then trained in
numpy on bounded samples (`POSITIVES`, `UNLABELLED`) by the non-negative risk estimator: with the
class prior p, the risk of positives counts p times, and the risk of unlabelled texts as negatives
is corrected by p times that of positives as negatives; where that difference turns negative the
step goes back up instead. The prior is the share of toxic among labelled training texts.

Null and empty texts have no features and get the score of a text without any. Without positives
nothing is toxic (score 0). Repeated rows are scored each for itself. Other columns are kept;
those that have the name of an added one are replaced. A label counts as toxic if any of its rows
says 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubricon.llm.bpe import with_column
from rubricon.llm.flat import lower_ascii, row_rounds, span_hash, text_bytes, word_spans

BUCKETS_LOG2 = 18
FEATURES = 1500
POSITIVES, UNLABELLED = 15_000, 30_000
#: Training texts that a feature must be in, among positives.
LEAST_POSITIVES = 3
#: How much more common it must be among positives than among unlabelled texts; what is only
#: commoner in longer texts stays out.
LEAST_LIFT = 3.0
EPOCHS, BATCH, RATE, SLACK = 30, 1024, 0.3, 0.0
SEED = 17


def feature_pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct feature of each text."""
    data = lower_ascii(data)
    inside = ((data - np.uint8(97)) < 26) | (data >= 128)
    plain = np.where(inside, data, np.uint8(0x20))
    starts, ends, bounds = word_spans(plain, offsets)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(bounds))
    hashed = [span_hash(plain, starts, ends)]
    for size in (4, 5):
        hashed.append(span_hash(plain, starts, np.minimum(ends, starts + size)) * np.uint64(2 * size + 1))
    pairs = np.unique(np.concatenate([row << BUCKETS_LOG2 | (h >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64) for h in hashed]))
    return pairs >> BUCKETS_LOG2, pairs & ((1 << BUCKETS_LOG2) - 1)


def rounds(column: pa.Array):
    data, offsets = text_bytes(column)
    for lo, hi in row_rounds(offsets):
        yield lo, hi, *feature_pairs(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])


def feature_counts(texts: DataFrame) -> DataFrame:
    """(bucket, positive, other): texts with the feature, of `texts` (text, positive)."""

    def run(batches):
        size = 1 << BUCKETS_LOG2
        counts = np.zeros((2, size), np.int64)
        for batch in batches:
            positive = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).astype(bool)
            for lo, hi, row, bucket in rounds(batch.column(0)):
                of_positive = positive[lo:hi][row]
                counts[0] += np.bincount(bucket[of_positive], minlength=size)
                counts[1] += np.bincount(bucket[~of_positive], minlength=size)
        used = np.flatnonzero(counts.any(axis=0))
        columns = [pa.array(used), pa.array(counts[0][used]), pa.array(counts[1][used])]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "positive", "other"])

    found = texts.mapInArrow(run, "bucket long, positive long, other long")
    return found.groupBy("bucket").agg(F.sum("positive").alias("positive"), F.sum("other").alias("other"))


def chosen_features(counts, positives: int, others: int) -> np.ndarray:
    """Buckets with the largest likelihood ratio between positive and unlabelled texts."""
    a, b = np.asarray(counts["positive"]).astype(float), np.asarray(counts["other"]).astype(float)
    p, q = (a + 0.5) / (positives + 1), (b + 0.5) / (others + 1)
    gain = a * np.log(p / q) + np.maximum(positives - a, 0) * np.log((1 - np.minimum(p, 0.999)) / (1 - np.minimum(q, 0.999)))
    gain[(a < LEAST_POSITIVES) | (p < LEAST_LIFT * q)] = 0
    order = np.lexsort((np.asarray(counts["bucket"]), -gain))[:FEATURES]
    return np.sort(np.asarray(counts["bucket"])[order[gain[order] > 0]])


def chosen_of(row: np.ndarray, bucket: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature number) of the pairs whose bucket was chosen."""
    if not len(features):
        return row[:0], bucket[:0]
    at = np.minimum(np.searchsorted(features, bucket), len(features) - 1)
    known = features[at] == bucket
    return row[known], at[known]


def sampled_features(texts: DataFrame, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts by features as booleans, which are positive) of bounded samples."""

    def run(batches):
        for batch in batches:
            lists = []
            for lo, hi, row, bucket in rounds(batch.column(0)):
                row, number = chosen_of(row, bucket, features)
                cuts = np.searchsorted(row, np.arange(hi - lo + 1))
                lists += [number[a:b] for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.list_(pa.int64()))], ["positive", "features"])

    rows = texts.mapInArrow(run, "positive boolean, features array<long>").toArrow().combine_chunks()
    lists = rows["features"].combine_chunks()
    x = np.zeros((len(rows), len(features)), bool)
    x[np.repeat(np.arange(len(rows)), np.diff(np.asarray(lists.offsets))), np.asarray(lists.flatten())] = True
    return x, np.asarray(rows["positive"]).astype(bool)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def train_non_negative(x: np.ndarray, positive: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """(weights, bias) by the non-negative risk with sigmoid loss and Adagrad."""
    draw = np.random.default_rng(SEED)
    w, bias = np.zeros(x.shape[1]), 0.0
    square_w, square_b = np.full(x.shape[1], 1e-6), 1e-6
    of_positive, of_other = np.flatnonzero(positive), np.flatnonzero(~positive)
    if not len(of_positive) or not len(of_other):
        return w, -10.0
    for _ in range(EPOCHS):
        others = draw.permutation(of_other)
        for lo in range(0, len(others), BATCH):
            u, p = others[lo : lo + BATCH], draw.choice(of_positive, min(BATCH, len(of_positive)), replace=False)
            xu, xp = x[u].astype(np.float32), x[p].astype(np.float32)
            su, sp = sigmoid(xu @ w + bias), sigmoid(xp @ w + bias)
            # Loss of a text as negative is s, as positive 1 - s.
            negative_risk = su.mean() - prior * sp.mean()
            slope_u, slope_p = su * (1 - su) / len(u), prior * sp * (1 - sp) / len(p)
            if negative_risk >= -SLACK:
                grad_u, grad_p = slope_u, -slope_p - slope_p  # whole risk
            else:
                grad_u, grad_p = -slope_u, slope_p  # back up
            grad_w, grad_b = xu.T @ grad_u + xp.T @ grad_p + 1e-5 * w, grad_u.sum() + grad_p.sum()
            square_w, square_b = square_w + grad_w**2, square_b + grad_b**2
            w, bias = w - RATE * grad_w / np.sqrt(square_w), bias - RATE * grad_b / np.sqrt(square_b)
    return w, float(bias)


def train(texts: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) from training texts (doc_id, text) and labels (doc_id, toxic)."""
    by_doc = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = by_doc.agg(F.avg("toxic"), F.count("*")).first()
    prior = min(max(float(share[0] or 0), 1e-3), 0.5)
    confirmed = by_doc.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(POSITIVES).select("doc_id", F.lit(True).alias("positive"))
    marked = texts.join(F.broadcast(confirmed), "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False)))
    sizes = {r["positive"]: r["n"] for r in marked.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(True) or not sizes.get(False):
        return np.zeros(0, np.int64), np.zeros(0), -10.0
    features = chosen_features(feature_counts(marked.select("text", "positive")).toArrow(), sizes[True], sizes[False])
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    taken = marked.filter(F.col("positive") | (place < min(1.0, UNLABELLED / sizes[False])))
    x, positive = sampled_features(taken.select("text", "positive"), features)
    return features, *train_non_negative(x, positive, prior)


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score (0 to 1); 0.5 is the boundary."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        features, weights, bias = shared.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for lo, hi, row, bucket in rounds(batch.column(text)):
                row, number = chosen_of(row, bucket, features)
                scores[lo:hi] = sigmoid(np.bincount(row, weights[number], hi - lo) + bias)
            yield with_column(batch, out, pa.array(scores))

    return df.mapInArrow(run, df.drop(out).withColumn(out, F.lit(0.0)).schema)
