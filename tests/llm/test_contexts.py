"""Contexts of the tree-weighting model that run on over the beginnings of words."""

from __future__ import annotations

import functools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rubricon.llm import tree_weighting

START = 0x0A


def line_of(text: str) -> bytes:
    return b"".join(w.encode() + b" " for w in [*text.split(), ""])


def events_of(line: bytes):
    for place, symbol in enumerate(line):
        yield (bytes([START]) + line[:place])[::-1][: tree_weighting.DEPTH], symbol


def brute_tree(lines: list[bytes]):
    """Context-tree weighting by definition over whole texts: log10 probability of a line."""
    counts: dict = {}
    for line in lines:
        for context, symbol in events_of(line):
            for k in range(8):
                for depth in range(len(context) + 1):
                    counts.setdefault((context[:depth], f"{symbol:08b}"[:k]), [0, 0])[symbol >> (7 - k) & 1] += 1

    def own(node):
        zeros, ones = counts[node]
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    def leaf(context):
        return len(context) == tree_weighting.DEPTH or context[-1:] == bytes([START])

    @functools.cache
    def block(node):
        context, before = node
        if leaf(context):
            return own(node)
        under = sum(block((context + bytes([c]), before)) for c in range(256) if (context + bytes([c]), before) in counts)
        return np.logaddexp(own(node), under) - math.log(2)

    @functools.cache
    def one(context, before, depth=0):
        node = (context[:depth], before)
        if node not in counts:
            return None
        zeros, ones = counts[node]
        here = (ones + 0.5) / (zeros + ones + 1)
        under = None if leaf(node[0]) else one(context, before, depth + 1)
        if under is None:
            return here
        weight = math.exp(own(node) - math.log(2) - block(node))
        return weight * here + (1 - weight) * under

    def log10(line):
        total = 0.0
        for context, symbol in events_of(line):
            for k in range(8):
                p = one(context, f"{symbol:08b}"[:k])
                p = 0.5 if p is None else p
                total += math.log10(p if symbol >> (7 - k) & 1 else 1 - p)
        return total

    return log10


def test_text_contexts_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tree_weighting, "CHUNK_BYTES", 300)  # several chunks, which ask for the same contexts
    rng = np.random.default_rng(11)
    stems = ["baba", "abacus", "x", "bac", "longerthansixbytes", "été", "中文", "nul\0l"]
    rows = []
    for k in range(40):
        words = ["".join(rng.choice(stems, rng.integers(1, 3))) for _ in range(rng.integers(0, 12))]
        rows.append((k, " ".join(words), k % 4 != 0, ["a", "b", None][k % 3]))
    rows.append((40, "unseen zebra quux", False, "a"))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, training BOOLEAN, lang STRING")
    scored = tree_weighting.score(docs, F.col("training"), F.col("lang"), across_words=True)
    found = {r["doc_id"]: r["score"] for r in scored.collect()}
    shares = Counter(lang for _, _, training, lang in rows if training and lang)
    trees = [(1.0, brute_tree([line_of(t) for _, t, training, _ in rows if training]))]
    for name, n in shares.items():
        trees.append((n, brute_tree([line_of(t) for _, t, training, lang in rows if training and lang == name])))
    total = sum(n for n, _ in trees)
    for doc_id, text, _, _ in rows:
        logs = [math.log(n / total) + math.log(10) * log10(line_of(text)) for n, log10 in trees]
        assert found[doc_id] == pytest.approx(np.logaddexp.reduce(logs) / math.log(10), rel=1e-4, abs=1e-4), doc_id


def test_order_of_words_counts_in_the_query(spark, tmp_path):
    from rubricon.llm.queries import QUERIES

    rows = [(k, "the small cat sat on the old mat", "en") for k in range(40)]
    rows += [(100, "the small cat sat on the old mat", "en"), (101, "mat old the on sat cat small the", "en"), (102, None, None), (103, " \n ", "en")]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in QUERIES["op1_tree_weighting"](spark, str(tmp_path)).collect()}
    assert found[100]["base_score"] == pytest.approx(found[101]["base_score"])
    assert found[100]["score"] > found[101]["score"] + 1
    assert found[102]["n_tokens"] == found[103]["n_tokens"] == 1 and found[102]["score"] == found[103]["score"]


def test_what_is_sent_grows_less_than_the_text(spark):
    """Asks are shuffled once, to groups that are written whole; chunks are large."""
    plain = spark.range(40).select("id", F.lit(True).alias("training"), F.lit(0).alias("kind"), F.repeat(F.lit("many a word "), 1 << 16).alias("text"))
    texts, _ = tree_weighting.in_chunks(plain.withColumnRenamed("id", "doc_id"))
    assert texts.select("chunk").distinct().count() == 1
    asked = tree_weighting.asked_events(texts, 1, True)
    asks = asked.select("chunk", "near").collect()
    groups = tree_weighting.stored(tree_weighting.grouped_events(asked, 1), "groups")
    assert groups.count() == len({r["near"] for r in asks})
    answers = tree_weighting.answered_events(groups, 1)
    assert "Exchange" not in answers._jdf.queryExecution().toString()
    assert answers.count() == len(asks)


def test_groups_are_answered_alike_in_parts(spark, monkeypatch):
    words = ["abacus", "bac", "x", "été", "longerthansixbytes"]
    rows = [(k, " ".join(words[(k * j) % 5] for j in range(1, 9)), "ab"[k % 2]) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING")

    def scores():
        return sorted(map(tuple, tree_weighting.score(docs, F.col("doc_id") % 4 != 0, F.col("lang"), across_words=True).select("doc_id", "score").collect()))

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    whole = scores()
    assert spark.conf.get(name) == before
    monkeypatch.setattr(tree_weighting, "GROUP_EVENTS", 1)
    monkeypatch.setattr(tree_weighting, "ANSWER_BYTES", 1)
    assert scores() == [(doc_id, pytest.approx(score, rel=1e-6)) for doc_id, score in whole]
