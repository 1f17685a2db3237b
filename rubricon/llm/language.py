"""Language identification by interpolated Kneser-Ney character models.

Texts are lower-cased, everything but letters and marks becomes a space, and each word is read as
characters between spaces: a character is predicted from up to `ORDER - 1` before it in its word.
Every language has a model with absolute discounting on top, continuation counts below, and the
uniform law at the bottom. Grams of all languages lie in one sorted hash array per order, with a
column for each language. A text goes to the language with the lowest cross-entropy per character.

Models count all labelled documents. The rejection limit of a language comes from the
cross-entropies of all its documents, each read with a model of the half (by a hash of the text)
that it is not in: the median, plus `SPREADS` times the distance to the 90 % point, plus an allowance
for short texts. A text without a letter, and a null, is `und` with score 0. Labels that are null
teach nothing; without any labelled text all texts are `und`. Rows are kept as they are, repeated
ones too; columns that have the name of an added one are replaced.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubricon.llm.flat import row_rounds, span_hash, text_bytes, word_spans

ORDER, DISCOUNT = 4, 0.75
#: Distinct words that a task holds before it gives out the counts of their grams.
WORDS_HELD = 200_000
#: How much the limit lies above the languages' usual cross-entropy, in nats a character.
SPREADS, SHORT = 8.0, 8.0
UNKNOWN = "und"

_MIX = np.uint64(0x9E3779B97F4A7C15)
_PAD = 0x20


def letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")


def gram_keys(codes: np.ndarray) -> list[np.ndarray]:
    """For each order, the hash of the last 1..ORDER characters at every place of `codes`; a place
    whose history begins before the array reads spaces."""
    keys, key = [], np.zeros(len(codes), np.uint64)
    padded = np.concatenate([np.full(ORDER, _PAD, np.uint64), codes.astype(np.uint64)])
    for back in range(ORDER):
        key = (key ^ (padded[ORDER - back : len(padded) - back] + np.uint64(1))) * _MIX
        key ^= key >> np.uint64(29)
        keys.append(key.copy())
    return keys


def word_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(characters of all words, each behind ORDER - 1 spaces and before one; places that are
    predicted; word of each such place)."""
    pad = " " * (ORDER - 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    codes = np.frombuffer("".join(f"{pad}{w} " for w in words).encode("utf-32-le"), np.uint32)
    word = np.repeat(np.arange(len(words)), sizes)
    nth = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    places = np.flatnonzero(nth >= ORDER - 1)
    return codes, places, word[places]


class Models:
    """Kneser-Ney models of several languages as sorted hash arrays."""

    def __init__(self, langs: list[str], grams: list[tuple[int, str, int]]):
        """`grams`: (language, ORDER characters, count) of the highest order."""
        self.langs, n = langs, len(langs)
        lang = np.array([g[0] for g in grams], np.int64)
        codes = np.frombuffer("".join(g[1] for g in grams).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
        counts = np.array([g[2] for g in grams], float)
        self.tables, self.backoff = [], []
        self.uniform = 1.0 / (len(np.unique(codes[:, -1])) + 1)
        for order in range(ORDER, 0, -1):
            key = self._key(codes[:, ORDER - order :])
            context = self._key(codes[:, ORDER - order : -1]) if order > 1 else np.zeros(len(codes), np.uint64)
            keys, at = np.unique(key, return_inverse=True)
            contexts, under = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, (under, lang), counts)
            np.add.at(kinds, (under, lang), 1.0)
            prob = np.zeros((len(keys), n))
            prob[at, lang] = np.maximum(counts - DISCOUNT, 0) / total[under, lang]
            with np.errstate(invalid="ignore", divide="ignore"):
                gamma = np.where(total > 0, DISCOUNT * kinds / total, 1.0)
            self.tables.insert(0, (keys, prob))
            self.backoff.insert(0, (contexts, gamma))
            if order > 1:  # one level down a gram counts the different characters before it
                lower = np.zeros(len(codes), [("l", np.int64), ("k", np.uint64)])
                lower["l"], lower["k"] = lang, self._key(codes[:, ORDER - order + 1 :])
                _, first, counts = np.unique(lower, return_index=True, return_counts=True)
                lang, codes, counts = lang[first], codes[first], counts.astype(float)

    @staticmethod
    def _key(codes: np.ndarray) -> np.ndarray:
        key = np.zeros(len(codes), np.uint64)
        for back in range(codes.shape[1]):
            key = (key ^ (codes[:, -1 - back].astype(np.uint64) + np.uint64(1))) * _MIX
            key ^= key >> np.uint64(29)
        return key

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, default: float) -> np.ndarray:
        known, values = table
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where((known[at] == keys)[:, None], values[at], default)

    def word_losses(self, words: list[str]) -> np.ndarray:
        """(words, languages): the negative log probability of each word with its end."""
        codes, places, word = word_codes(words)
        keys = gram_keys(codes)
        prob = np.full((len(places), len(self.langs)), self.uniform)
        for order in range(1, ORDER + 1):
            context = keys[order - 2][places - 1] if order > 1 else np.zeros(len(places), np.uint64)
            gamma = self._find(self.backoff[order - 1], context, 1.0)
            prob = self._find(self.tables[order - 1], keys[order - 1][places], 0.0) + gamma * prob
        loss = -np.log(prob)
        return np.stack([np.bincount(word, loss[:, k], len(words)) for k in range(len(self.langs))], axis=1)


class Scorer:
    """Losses of texts; a direct-mapped cache of fixed size holds those of words met before."""

    def __init__(self, models: Models):
        self.models, n = models, len(models.langs)
        bits = max(10, min(19, int(np.log2((24 << 20) / (4 * n + 8)))))
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.losses = np.zeros((1 << bits, n), np.float32)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(loss of each text in each language, characters that were predicted)."""
        starts, ends, rows = word_spans(data, offsets)
        hashes = span_hash(data, starts, ends)
        slots = (hashes >> self.shift).astype(np.int64)
        losses = self.losses[slots].astype(float)
        missed = np.flatnonzero(self.keys[slots] != hashes)
        if len(missed):
            distinct, sample, back = np.unique(hashes[missed], return_index=True, return_inverse=True)
            where, raw = missed[sample], data.tobytes()
            fresh = self.models.word_losses([raw[s:e].decode() for s, e in zip(starts[where].tolist(), ends[where].tolist())])
            fresh = fresh.astype(np.float32)
            losses[missed] = fresh[back]
            self.keys[slots[where]], self.losses[slots[where]] = distinct, fresh
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
        n = len(offsets) - 1
        sums = np.stack([np.bincount(row, losses[:, k], n) for k in range(losses.shape[1])], axis=1)
        return sums, np.bincount(row, chars[ends] - chars[starts] + 1, n)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """`lang, gram, n0, n1`: how often each string of ORDER characters occurs in the texts of a
    language, over all rows of `labelled` (lang, text, fold), apart for the two folds."""

    def grams(batches):
        words: dict[tuple[str, int], Counter] = {}

        def summed(lang: str) -> pa.RecordBatch:
            both = [words.get((lang, fold), Counter()) for fold in (0, 1)]
            codes, places, word = word_codes([w for found in both for w in found])
            window = codes[places[:, None] + np.arange(1 - ORDER, 1)]
            # Two characters to a number, numbered anew: strings are told apart exactly.
            pairs = [np.unique(window[:, k].astype(np.int64) << 21 | window[:, k + 1], return_inverse=True) for k in (0, 2)]
            _, first, gram = np.unique(pairs[0][1] * len(pairs[1][0]) + pairs[1][1], return_index=True, return_inverse=True)
            times = np.array([n for found in both for n in found.values()], np.int64)[word]
            text = window[first].tobytes().decode("utf-32-le")
            columns = [pa.array([lang] * len(first), pa.string()), pa.array([text[k : k + ORDER] for k in range(0, len(text), ORDER)], pa.string())]
            for fold in (0, 1):
                mine = (word >= len(both[0])) == fold
                columns.append(pa.array(np.bincount(gram, times * mine, len(first)).astype(np.int64)))
            return pa.RecordBatch.from_arrays(columns, ["lang", "gram", "n0", "n1"])

        def held():
            for lang in sorted({lang for (lang, _), found in words.items() if found}):
                yield summed(lang)
            words.clear()

        for batch in batches:
            for lang, text, fold in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words.setdefault((lang, fold), Counter()).update((text or "").split())
                if sum(map(len, words.values())) > WORDS_HELD:
                    yield from held()
        yield from held()

    texts = labelled.select("lang", letters(F.col("text")).alias("text"), "fold")
    found = texts.mapInArrow(grams, "lang string, gram string, n0 long, n1 long")
    return found.groupBy("lang", "gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def train(labelled: DataFrame) -> tuple[Models, np.ndarray] | None:
    """(models, rejection limits) from all of `labelled` (text, lang)."""
    fold = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(2)).cast("int")
    labelled = labelled.filter(F.col("lang").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"), fold.alias("fold"))
    found = gram_counts(labelled).toArrow()
    langs = sorted(found["lang"].unique().to_pylist())
    if not langs:
        return None
    at = {lang: k for k, lang in enumerate(langs)}
    index, gram = [at[x] for x in found["lang"].to_pylist()], found["gram"].to_pylist()
    counts = [found[c].to_pylist() for c in ("n0", "n1")]
    models = Models(langs, list(zip(index, gram, map(sum, zip(*counts)))))
    parts = []
    for other, n in enumerate(counts):  # texts of a fold are read with the model of the other one
        taught = [x for x in zip(index, gram, n) if x[2]]
        known = sorted({langs[x[0]] for x in taught})
        if known:
            held = labelled.filter((F.col("fold") != other) & F.col("lang").isin(known)).select("text", "lang")
            parts.append(losses(held, Models(langs, taught), keep=["lang"]).filter("_chars > 0"))
    scored = reduce(DataFrame.unionAll, parts)
    place = F.create_map(*[x for k, i in at.items() for x in (F.lit(k), F.lit(i))])[F.col("lang")]
    usual = (
        scored.select("lang", (F.get("_losses", place) / F.col("_chars")).alias("h"))
        .groupBy("lang")
        .agg(F.percentile_approx("h", F.array(F.lit(0.5), F.lit(0.9))).alias("q"))
        .collect()
    )
    limits = np.full(len(langs), np.inf)
    for r in usual:
        if r["q"][0] is not None:
            limits[at[r["lang"]]] = r["q"][0] + SPREADS * max(r["q"][1] - r["q"][0], 0.1)
    return models, limits


def losses(df: DataFrame, models: Models, keep: list[str] | None = None) -> DataFrame:
    """Adds `_losses` (array, in the order of the models' languages) and `_chars`. Of the columns
    those of `keep` stay, or all."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    rows = df.drop("_losses", "_chars", "_letters")
    rows = rows.withColumn("_letters", letters(F.col("text")))
    if keep is not None:
        rows = rows.select(*keep, "_letters")
    schema = rows.drop("_letters").withColumns({"_losses": F.array(F.lit(0.0)), "_chars": F.lit(0).cast("long")}).schema

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            data, offsets = text_bytes(batch.column(batch.num_columns - 1))
            n = len(scorer.models.langs)
            for lo, hi in row_rounds(offsets):  # rows leave by rounds: a whole batch of texts is not held twice
                sums, chars = scorer.score(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * n, pa.int32()), pa.array(sums.ravel().astype(float)))
                columns = [batch.column(i).slice(lo, hi - lo) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*columns, listed, pa.array(chars.astype(np.int64))], [*batch.schema.names[:-1], "_losses", "_chars"])

    return rows.mapInArrow(run, schema)


def identify(df: DataFrame, labelled: DataFrame) -> DataFrame:
    """Adds `lang_pred`, `score` (0 to 1), `cross_entropy` (nats a character) and `accepted` to
    `df` (with `text`); `labelled` (text, lang) is what may be learnt from."""
    df = df.drop("lang_pred", "score", "cross_entropy", "accepted")
    trained = train(labelled)
    if trained is None:
        none = {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "cross_entropy": F.lit(None).cast("double"), "accepted": F.lit(False)}
        return df.withColumns(none)
    models, limits = trained
    least = F.array_min("_losses")
    best = F.array_position("_losses", least).cast("int") - 1
    # Marks alone are no letters, though they are read along with letters.
    named = (F.col("_chars") > 0) & F.col("text").rlike(r"\p{L}")
    # Evidence is counted for at most 50 characters, which keeps scores of long texts apart from 1.
    weight = F.least(F.lit(50.0), F.col("_chars").cast("double")) / F.col("_chars")
    rivals = F.aggregate("_losses", F.lit(0.0), lambda a, x: a + F.exp((least - x) * weight))
    limit = F.get(F.array(*[F.lit(float(x)) for x in limits]), best) + SHORT / F.sqrt("_chars")
    return (
        losses(df, models)
        .withColumns(
            {
                "lang_pred": F.when(named, F.get(F.array(*map(F.lit, models.langs)), best)).otherwise(UNKNOWN),
                "score": F.when(named, 1 / rivals).otherwise(0.0),
                "cross_entropy": F.when(named, least / F.col("_chars")),
            }
        )
        .withColumn("accepted", F.when(named, F.col("cross_entropy") <= limit).otherwise(False))
        .drop("_losses", "_chars")
    )
