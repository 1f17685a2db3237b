"""Retrieval plans against brute force in plain Python."""

import random

import pytest

from rubricon.operators import retrieval as X

K = 3


@pytest.fixture(scope="module")
def library(spark):
    """A skewed library: a few words are in most functions, queries often hold only those."""
    rng = random.Random(7)
    common, rare = [f"hot{chr(97 + i)}" for i in range(4)], [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    functions = []
    for pos in range(300):
        words = [w for w in common if rng.random() < 0.7] + rng.sample(rare, rng.randint(0, 5))
        functions.append((pos, "f()", " ".join(words)))
    asked = [(q, " ".join([w for w in common if rng.random() < 0.6] + rng.sample(rare, rng.choice([0, 0, 1, 3])))) for q in range(60)]
    asked.append((60, "what is the"))
    f = spark.createDataFrame(functions, "pos BIGINT, function STRING, function_docstring STRING")
    q = spark.createDataFrame(asked, "query_id BIGINT, query STRING")
    return q, f, asked, functions


def brute(asked, functions):
    out = {}
    for q, text in asked:
        words = {w for w in text.split() if len(w) >= 3} - {"what", "the"}
        scored = []
        for pos, _, doc in functions:
            other = set(doc.split())
            if words & other:
                scored.append((-len(words & other) / len(words | other), pos))
        out[q] = [(pos, -s) for s, pos in sorted(scored)]
    return out


@pytest.mark.parametrize("salt", [20, 10**6])
def test_scores(spark, library, salt):
    q, f, asked, functions = library
    pairs = X.score_pairs(X.index_queries(q), X.index_functions(f), salt_rows=salt).collect()
    got = {(r["query_id"], r["pos"]): r["score"] for r in pairs}
    want = {(k, pos): s for k, rows in brute(asked, functions).items() for pos, s in rows}
    assert got == pytest.approx(want)


def best_of(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["pos"])
    return got


@pytest.mark.parametrize(("k", "salt", "share"), [(1, 20, 256), (K, 20, 256), (K, 10**6, 3), (K, 7, 1), (40, 20, 256), (1000, 20, 256)])
def test_top_functions(spark, library, monkeypatch, k, salt, share):
    monkeypatch.setattr(X, "COMMON_SHARE", share)
    q, f, asked, functions = library
    got = best_of(X.top_functions(X.index_queries(q), X.index_functions(f), k, salt_rows=salt).collect())
    assert got == {q: [pos for pos, _ in found[:k]] for q, found in brute(asked, functions).items() if found}


def test_top_functions_of_random_sets(spark):
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    pick = lambda most: " ".join({rng.choice(words[: rng.choice([4, 16, 64])]) for _ in range(rng.randint(0, most))})
    functions, asked = [(i, "()", pick(30)) for i in range(400)], [(i, pick(20)) for i in range(80)]
    f = X.index_functions(spark.createDataFrame(functions, "pos BIGINT, function STRING, function_docstring STRING"))
    q = X.index_queries(spark.createDataFrame(asked, "query_id BIGINT, query STRING"))
    want = {i: [pos for pos, _ in found[:K]] for i, found in brute(asked, functions).items() if found}
    assert best_of(X.top_functions(q, f, K).collect()) == want
    assert X.top_functions(q.limit(0), f, K).count() == 0 == X.top_functions(q, f.limit(0), K).count()


def test_few_pairs_are_formed(spark):
    """Seeds and candidates together are a tenth of the pairs that share a word, at most."""
    from rubricon.plans import fixtures as fx

    sf_dir = "/root/testdata/sf0.1"
    q = X.stored(X.index_queries(fx.queries(spark, sf_dir)), "q")
    f = X.stored(X.index_functions(fx.functions(spark, sf_dir)), "f")
    sharing = X.score_pairs(q, f).count()
    seeds = X.stored(X.exact_scores(X.seed_pairs(q, f, 5), q, f), "s")
    best = X._best(seeds, 5).groupBy("query_id").agg(X.F.count("*").alias("n"), X.F.min("score").alias("floor"))
    candidates = X.candidate_pairs(q, f, best.filter("n = 5").select("query_id", "floor")).count()
    assert seeds.count() + candidates < sharing / 10


def test_fallback_and_format(spark, library):
    q, f, *_ = library
    from pyspark.sql import functions as F

    f = f.withColumn("article_title", F.lit("T"))
    ranked = X.retrieve(q, f, 2)
    rows = {(r["query_id"], r["rank"]): r["pos"] for r in ranked.collect()}
    assert rows[(60, 1)] == 0 and rows[(60, 2)] == 1
    text = X.format_functions(ranked, f).filter("query_id = 60").first()["functions_text"]
    assert text == "Available financial functions:\n\n" + "# T\n```python\nf()\n```\n\n" * 2
    assert X.retrieve(q, f, 2, keep=F.col("rank") == 1).count() == 61


def test_only_wanted_bodies_leave_the_scan(spark, monkeypatch):
    """The filter lets the asked positions through and no others, unless positions share a bit."""
    from pyspark.sql import functions as F

    library = spark.range(100_000).select(F.col("id").alias("pos"), F.lit("T").alias("article_title"), F.lit("f").alias("function"))
    asked = [0, 1, 7, 8, 32_767, 32_768, 32_769, 65_536, 99_999]
    ranked = spark.createDataFrame([(q, 1, p) for p in asked for q in (1, 2)], "query_id LONG, rank INT, pos LONG")
    found = X.wanted_bodies(library, ranked)
    assert found.columns == library.columns
    assert sorted(r["pos"] for r in found.collect()) == asked
    assert X.wanted_bodies(library, ranked.filter("pos < 0")).count() == 0
    monkeypatch.setattr(X, "MARKED_BITS", 1 << 10)
    few = {r["pos"] for r in X.wanted_bodies(library, ranked).collect()}
    assert few == {p for p in range(100_000) if p % 1024 in {a % 1024 for a in asked}}
    text = X.format_functions(ranked, library)
    assert text.filter("query_id = 2").first()["functions_text"].count("# T\n") == len(asked)
