"""Finding library functions for questions by exact keyword Jaccard.

The k best functions of every question come out of a prefix-filter join in two rounds:

* Seeds. For each token the k functions with the fewest keywords that hold it are scored exactly;
  the k-th best of a question's seeds is a floor that its answer can't fall below. A question
  with fewer than k seeds has met every function that shares a word with it and is done.
* Search. Tokens are ordered by rarity, the same on both sides. To reach the floor a function must
  share a number of tokens that follows from both set sizes, so it shares the first two of them
  within prefixes whose length is known. Only postings in these prefixes, between sets whose
  sizes allow the floor, meet on the token; pairs that meet twice (once, where one token is
  enough) are scored exactly.

Tokens in many functions stand last in the order, so most of their postings lie outside of
prefixes; what is left of them is salted. No pair that could be among the k best is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricon.functions.text import as_col, int_div
from rubricon.functions.tokens import function_keywords, query_keywords
from rubricon.operators.binding import bind
from rubricon.operators.positions import top_per_key
from rubricon.session import stored

#: A token that at least one function in so many holds is common. Sets together hold each token
#: once, so there are at most this many times the mean set size of them: that is broadcast.
COMMON_SHARE = 256
SALT_ROWS = 100_000

def index_functions(functions: DataFrame) -> DataFrame:
    """`pos, keywords, n_keywords` per function; the only pass over function text."""
    words = function_keywords("function", "function_docstring")
    bound = bind(functions.select("pos", "function", "function_docstring"), {"keywords": words})
    return bound.select("pos", "keywords", F.size("keywords").alias("n_keywords"))


def index_queries(queries: DataFrame) -> DataFrame:
    bound = bind(queries.select("query_id", "query"), {"keywords": query_keywords("query")})
    return bound.select("query_id", "keywords", F.size("keywords").alias("n_keywords"))


def keyword_index(indexed: DataFrame) -> DataFrame:
    """Inverted index as (keyword, pos) rows, one per posting."""
    return indexed.select(F.explode("keywords").alias("keyword"), "pos")


def jaccard(common: Column, n_query: Column | str = "n_query", n_function: Column | str = "n_function") -> Column:
    return common.cast("double") / (as_col(n_query) + as_col(n_function) - common)


def common_tokens(functions: DataFrame) -> DataFrame:
    """`token, held` of the tokens that many functions hold, with their number."""
    total = functions.count()
    held = functions.select(F.explode("keywords").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("held"))
    return held.filter(F.col("held") * COMMON_SHARE >= total)


def by_rarity(indexed: DataFrame, key: str, common: DataFrame) -> DataFrame:
    """One row per posting with its place in the row's tokens from rare to common:
    `key, size, place, token, held` (`held` 0 for tokens that are not common)."""
    spread = indexed.select(key, "keywords").repartition(key).select(key, F.explode("keywords").alias("token"))
    known = spread.join(F.broadcast(common), "token", "left")
    # A row's own keywords come back together where they were spread, without another exchange.
    ordered = known.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "token"))).alias("tokens")
    )
    return ordered.select(key, F.size("tokens").alias("size"), F.posexplode("tokens").alias("place", "t")).select(
        key, "size", "place", "t.token", "t.held"
    )


def _met(asked: DataFrame, held: DataFrame, salt_rows: int, *conditions: Column) -> DataFrame:
    """Postings of both sides that meet on a token and fulfil the conditions. The functions of a
    common token are cut into pieces; its questions go to every piece."""
    pieces = F.greatest(F.ceil(F.col("held") / F.lit(salt_rows)), F.lit(1)).cast("int")
    f = held.withColumn("salt", F.pmod(F.xxhash64("pos"), pieces).cast("int")).drop("held")
    q = asked.withColumn("salt", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("held")
    met = q.join(f, ["token", "salt"])
    for condition in conditions:
        met = met.filter(condition)
    return met


def score_pairs(queries: DataFrame, functions: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Every query and function that share a keyword, with their Jaccard `score`.

    Takes the output of `index_queries` and `index_functions`. The output holds all such pairs by
    its nature; `top_functions` never forms them.
    """
    functions = stored(functions, "function-index")
    common = common_tokens(functions)
    q = by_rarity(queries, "query_id", common).withColumnRenamed("size", "n_query")
    f = by_rarity(functions, "pos", common).withColumnRenamed("size", "n_function")
    pairs = _met(q, f, salt_rows).groupBy("query_id", "pos", "n_query", "n_function").agg(F.count(F.lit(1)).alias("common"))
    return pairs.select("query_id", "pos", "common", jaccard(F.col("common")).alias("score"))


def exact_scores(pairs: DataFrame, queries: DataFrame, functions: DataFrame) -> DataFrame:
    """`query_id, pos, score` of distinct pairs, from both keyword sets."""
    q = queries.select("query_id", F.col("keywords").alias("_asked"))
    f = functions.select("pos", F.col("keywords").alias("_held"))
    common = F.size(F.array_intersect("_asked", "_held"))
    both = pairs.select("query_id", "pos").join(q, "query_id").join(f, "pos")
    return both.select("query_id", "pos", jaccard(common, F.size("_asked"), F.size("_held")).alias("score"))


def seed_pairs(queries: DataFrame, functions: DataFrame, k: int) -> DataFrame:
    """Distinct `query_id, pos`: for each of a query's tokens the k functions with the fewest keywords."""
    postings = functions.select(F.explode("keywords").alias("token"), "n_keywords", "pos")
    shortest = top_per_key(postings, ["token"], k, F.col("n_keywords"), F.col("pos"))
    asked = queries.select("query_id", F.explode("keywords").alias("token"))
    return asked.join(shortest.select("token", "pos"), "token").select("query_id", "pos").distinct()


def candidate_pairs(queries: DataFrame, functions: DataFrame, floors: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """Distinct `query_id, pos` of all functions that can reach the query's `floor` (above 0), and few more."""
    least = floors.agg(F.min("floor").alias("least")).first()["least"]
    if least is None:
        return queries.select("query_id", F.lit(None).cast("bigint").alias("pos")).limit(0)
    common, floor = common_tokens(functions), F.col("floor")
    # At least a share `floor` of the larger set is common; a prefix reaches to the second of those tokens.
    within = lambda share: F.col("place") <= F.col("size") - F.ceil(share * F.col("size") - SLACK) + 1
    asked = by_rarity(queries, "query_id", common).join(floors, "query_id").filter(within(floor))
    held = by_rarity(functions, "pos", common).filter(within(F.lit(least)))
    q = asked.withColumnsRenamed({"size": "n_query", "place": "at_query"})
    f = held.withColumnsRenamed({"size": "n_function", "place": "at_function"})
    need = F.greatest(F.ceil(floor / (1 + floor) * (F.col("n_query") + F.col("n_function")) - SLACK), F.lit(1))
    met = _met(
        q, f, salt_rows,
        (F.col("n_function") >= floor * F.col("n_query") - SLACK) & (F.col("n_function") * floor <= F.col("n_query") + SLACK),
        (F.col("at_query") <= F.col("n_query") - need + 1) & (F.col("at_function") <= F.col("n_function") - need + 1),
    )
    counted = met.groupBy("query_id", "pos").agg(F.count(F.lit(1)).alias("met"), F.min(F.least(need, F.lit(2))).alias("enough"))
    return counted.filter(F.col("met") >= F.col("enough")).select("query_id", "pos")


#: Floors are quotients in floating point; needed counts are rounded up from a little below.
SLACK = 1e-9


def top_functions(queries: DataFrame, functions: DataFrame, k: int = 5, salt_rows: int = SALT_ROWS) -> DataFrame:
    """The k best functions per query by score, then library position: `query_id, pos, score, rank`."""
    # Both indexes are read several times from here on: the text is worked through once.
    queries, functions = stored(queries, "query-index"), stored(functions, "function-index")
    seeds = stored(_best(exact_scores(seed_pairs(queries, functions, k), queries, functions), k), "seeds")
    reached = seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("floor"))
    floors = reached.filter(F.col("found") == k).select("query_id", "floor")
    done = seeds.join(floors, "query_id", "left_anti")
    candidates = candidate_pairs(queries, functions, floors, salt_rows)
    return done.unionByName(_best(exact_scores(candidates, queries, functions), k))


def _best(scores: DataFrame, k: int) -> DataFrame:
    return top_per_key(scores, ["query_id"], k, F.desc("score"), F.col("pos"))


def first_functions(functions: DataFrame, k: int) -> DataFrame:
    """The first k functions of the library with their rank; k is small by definition."""
    first = functions.select("pos").orderBy("pos").limit(k)
    return first.agg(F.array_sort(F.collect_list("pos")).alias("all")).select(
        F.posexplode("all").alias("rank", "pos")
    ).withColumn("rank", F.col("rank") + 1)


def with_fallback(queries: DataFrame, found: DataFrame, functions: DataFrame, k: int = 5) -> DataFrame:
    """Matches of every query; a query without any gets the first k functions of the library
    (`matched` false, score 0). The matches are computed once and joined by rank, not searched again."""
    rows = queries.select("query_id").join(found.select("query_id", "rank", "pos", "score"), "query_id", "left")
    ranks = F.when(F.col("pos").isNull(), F.sequence(F.lit(1), F.lit(k))).otherwise(F.array("rank"))
    slots = rows.select("query_id", "pos", "score", F.explode(ranks).alias("rank"))
    first = first_functions(functions, k).withColumnRenamed("pos", "_first")
    return (
        slots.join(F.broadcast(first), "rank", "left")
        .withColumn("matched", F.col("pos").isNotNull())
        .withColumns({"pos": F.coalesce("pos", "_first"), "score": F.coalesce("score", F.lit(0.0))})
        .filter(F.col("pos").isNotNull())
        .drop("_first")
    )


def fallback(queries: DataFrame, found: DataFrame, functions: DataFrame, k: int = 5) -> DataFrame:
    """Only the rows that stand in for missing matches."""
    return with_fallback(queries, found, functions, k).filter(~F.col("matched")).select("query_id", "rank", "pos")


def retrieve(queries: DataFrame, functions: DataFrame, k: int = 5, keep: Column | None = None) -> DataFrame:
    """Ranked functions per query: matches, or the fallback where nothing matched.

    `keep` is an optional predicate on the candidates (columns `query_id, rank, pos, score`),
    the place for an outside relevance filter.
    """
    q, f = index_queries(queries), index_functions(functions)
    best = top_functions(q, f, k)
    candidates = with_fallback(queries, best, functions, k).select("query_id", "rank", "pos", "score")
    return candidates if keep is None else candidates.filter(keep)


# How functions are written into a prompt.
BLOCK_TITLE = "Available financial functions:\n\n"

#: Bits of the filter in front of function bodies: 8 MB are broadcast at most.
MARKED_BITS = 1 << 26


def marked_positions(ranked: DataFrame) -> DataFrame:
    """(_bucket, _marks): bitmaps of the positions in `ranked`, merged map-side. `MARKED_BITS` bits
    at most, whatever the library: positions of a larger one share bits."""
    bit = F.pmod("pos", F.lit(MARKED_BITS))
    return ranked.groupBy(F.bitmap_bucket_number(bit).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("_marks"))


def wanted_bodies(functions: DataFrame, ranked: DataFrame) -> DataFrame:
    """The functions that `ranked` names, by a filter where they are read: bodies that nobody
    asked for are not shuffled. In a library of more than `MARKED_BITS` functions some others that
    share a bit come along."""
    bit = F.pmod("pos", F.lit(MARKED_BITS))
    place = F.bitmap_bit_position(bit)
    byte = F.substring("_marks", int_div(place, 8).cast("int") + 1, 1)
    is_marked = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int")) == 1
    placed = functions.withColumn("_bucket", F.bitmap_bucket_number(bit))
    return placed.join(F.broadcast(marked_positions(ranked)), "_bucket").filter(is_marked).select(functions.columns)


def format_functions(ranked: DataFrame, functions: DataFrame) -> DataFrame:
    """One text block per query with its functions in rank order (at most k of them). `ranked` is
    written once, because the filter of the bodies and the join both read it."""
    ranked = stored(ranked.select("query_id", "rank", "pos"), "ranked")
    body = F.concat(F.lit("# "), "article_title", F.lit("\n```python\n"), "function", F.lit("\n```\n\n"))
    bodies = wanted_bodies(functions.select("pos", "article_title", "function"), ranked).select("pos", body.alias("body"))
    texts = ranked.join(bodies, "pos")
    ordered = F.array_sort(F.collect_list(F.struct("rank", "body")))
    return texts.groupBy("query_id").agg(
        F.concat(F.lit(BLOCK_TITLE), F.array_join(F.transform(ordered, lambda e: e["body"]), "")).alias("functions_text")
    )
