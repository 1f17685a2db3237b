"""Operators against brute force, libraries and hard inputs."""

import functools
import hashlib
import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rubricon.llm import bpe, components, flat, language, nearest, packing, pretokens, quality, simhash, token_counts, token_files, toxicity, tree_weighting
from rubricon.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
HARD = [
    None, "", " ", "\n\n a", "It's  we'll\t'tis 12three 　x", "<|endoftext|>a <|endoftext|>", "汉字 и слова ß² 😀́",
    "one two one two one two one two one two one two", "a" * 3000, "word " * 4000, "x", "x", "\x00 \x1c \x85", "A\r\nA\r\nB",
]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(k if k != 3 else None, t, ["en", "de", None][k % 3], "s", 0, "kept") for k, t in enumerate(HARD)]
    rows.append(rows[-1])
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, ids STRING")


@pytest.fixture(scope="module")
def none(hard):
    return hard.limit(0)


@lru_cache(maxsize=None)
def library():
    return Tokenizer.from_file(PATH)


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_encoders_match_the_library():
    texts = HARD + ["".join(np.random.default_rng(k).choice(list("ab'sl 1!\n\té漢 "), 40)) for k in range(300)]
    data, offsets = flat.text_bytes(pa.array(texts, pa.string()))
    for encoder in (pretokens.WordEncoder(PATH, 8, 50), bpe.MergeEncoder(PATH)):
        ids, bounds = encoder.ids_of(data, offsets)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [ids_of(t) for t in texts]


def test_long_text_is_cut_without_changing_ids(monkeypatch):
    monkeypatch.setattr(pretokens, "ROUND_BYTES", 1000)
    text = "some words here and it's  there\n" * 400
    data, offsets = flat.text_bytes(pa.array([text]))
    (_, _, ids, _), = pretokens.encoded_rounds(pretokens.WordEncoder(PATH), data, offsets)
    assert ids.tolist() == ids_of(text)


def test_bpe_and_counts(hard, none):
    rows = token_counts.count_tokens(bpe.decode(bpe.encode(hard, PATH), PATH), PATH).collect()
    for r in rows:
        assert (r["ids"], r["decoded"], r["n_tokens"]) == (ids_of(r["text"]), r["text"] or "", len(ids_of(r["text"])))
    assert token_counts.count_tokens(bpe.encode(none, PATH), PATH).count() == 0


def test_decoding_of_broken_bytes_and_unknown_ids(spark):
    rows = spark.createDataFrame([([447, 247, 99999, 447],), (None,)], "ids ARRAY<INT>")
    tokenizer = Tokenizer.from_file(PATH)
    assert [r["decoded"] for r in bpe.decode(rows, PATH).collect()] == [tokenizer.decode([447, 247, 447], skip_special_tokens=False), ""]


def test_token_files(spark, hard, none, tmp_path):
    token_files.write_tokens(hard, str(tmp_path / "t"), PATH)
    rows = token_files.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    ids = sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in hard.collect())
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in rows] == ids
    texts, at = {r["doc_id"]: r["text"] for r in hard.collect()}, 0
    for r in rows:
        want = np.array(ids_of(texts[r["doc_id"]]) + [0], "<u4")
        assert (r["start"], r["n_tokens"], bytes(r["ids"])) == (at, len(want), want.tobytes())
        at += len(want)
    token_files.write_tokens(none, str(tmp_path / "none"), PATH)
    assert token_files.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_block_code_round_trip():
    draw = np.random.default_rng(1)
    for ids in (draw.zipf(1.3, 5000) % 70_000, np.arange(70_000), np.zeros(3, int), np.zeros(0, int)):
        assert token_files.decode_block(*token_files.encode_block(ids), len(ids)).tolist() == ids.tolist()


def test_packing(hard, none):
    rows = packing.pack(hard, PATH, window=64).collect()
    stream, sequences = Counter(), {}
    texts = {r["doc_id"]: r["text"] for r in hard.collect()}
    for r in rows:
        ids = np.array(ids_of(texts[r["doc_id"]]) + [0], "<u4")
        assert bytes(r["ids"]) == ids[r["start"] : r["start"] + r["length"]].tobytes() and r["doc_tokens"] == len(ids)
        stream[r["doc_id"]] += r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    copies = Counter(r["doc_id"] for r in hard.collect())
    assert stream == {k: n * (len(ids_of(texts[k])) + 1) for k, n in copies.items()}
    for pieces in sequences.values():
        ends = np.cumsum([0] + [n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == ends[:-1].tolist() and ends[-1] <= 64
    assert packing.pack(none, PATH).count() == 0


def test_packing_takes_the_nearest_document_first():
    ids = [np.array(x) for x in ([1, 2, 3, 4], [9, 8, 7, 6], [1, 2, 3, 5], [9, 8, 7, 5])]
    counts = np.concatenate([[100, 400], np.full(10, 2)])
    shard = packing.Shard(np.concatenate(ids), np.array([0, 4, 8, 12, 16]), counts)
    assert packing.packed_order(shard, 8, 0)[0] == [0, 2, 1, 3]


def brute_counts(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.search(line)) and line in seen
        seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    marked = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked)


def test_quality(hard, none, spark, sf_dir):
    rows = quality.judged(hard).collect()
    assert len(rows) == len(HARD) + 1
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(r["text"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judged(none).count() == 0
    found = QUERIES["op7_quality"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id")
    good = found.filter("quality = 1 and not base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good == 1.0


def plain_text(draw, words=120):
    """Words of 2-8 letters with a few capitals, no symbols and no repeats."""
    return " ".join("".join(draw.choice(list("abcdefghijklmnoprstuvw"), draw.integers(2, 9))).capitalize() if draw.random() < 0.1 else "".join(draw.choice(list("abcdefghijklmnoprstuvw"), draw.integers(2, 9))) for _ in range(words))


def test_quality_keeps_columns_of_any_name(spark):
    draw = np.random.default_rng(13)
    names = ["centre", "inverse", "grp", "levels", "lines", "repeats", "symbols", "capitals", "word_length", "_wide", "_fine", "limit", "start"]
    rows = [(k, plain_text(draw), "en", "s", *[float(k)] * len(names), "old") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, " + ", ".join(f"{n} DOUBLE" for n in names) + ", kept STRING")
    found = quality.judged(docs)
    assert found.columns[: 4 + len(names)] == ["doc_id", "text", "lang", "source", *names] and found.columns.count("kept") == 1
    for r in found.collect():
        assert {r[n] for n in names} == {float(r["doc_id"])} and r["kept"] is True


def test_quality_of_a_small_source_is_measured_by_its_language(spark):
    draw = np.random.default_rng(11)
    junk = lambda: " ".join("#$%&" + "".join(draw.choice(list("XYZ"), 20)) for _ in range(80))
    rows = [(k, plain_text(draw), "en", "big") for k in range(300)]
    rows += [(1000, junk(), "en", "lone"), (1001, plain_text(draw), "en", "clean")]
    rows += [(1100 + k, junk(), "en", "few") for k in range(5)] + [(1200, junk(), "xx", None), (1300, junk(), "en", None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    kept = {r["doc_id"] for r in quality.judged(docs).filter("kept").collect()}
    assert kept == {*range(300), 1001}


def test_quality_stands_a_third_of_equal_junk(spark):
    draw = np.random.default_rng(12)
    copy = " ".join("".join(draw.choice(list("abcdefgh#$"), 6)) for _ in range(90))
    rows = [(k, plain_text(draw), "en", "s") for k in range(200)] + [(1000 + k, copy, "en", "s") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    kept = {r["doc_id"] for r in quality.judged(docs).filter("kept and not base_failed").collect()}
    assert kept == set(range(200))


def brute_fingerprint(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(hard, none, spark, monkeypatch):
    for r in simhash.near_duplicates(hard).collect():
        text = HARD[r["doc_id"] if r["doc_id"] is not None else 3]
        assert r["fp"] % (1 << 64) == brute_fingerprint(text)
    assert simhash.near_duplicates(none).count() == 0


def test_vantage_shards_lose_no_link(spark, monkeypatch):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << draw.integers(0, 63, 200).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 63, 200).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near, base[:5] ^ np.uint64(7)]))
    monkeypatch.setattr(simhash, "SHARD_LIMIT", 60)
    monkeypatch.setattr(simhash, "SHARD_TARGET", 20)
    rows = spark.createDataFrame([(int(x), k) for k, x in enumerate(fps.view(np.int64))], "fp BIGINT, rep BIGINT")
    links = simhash.sharded(rows).groupBy("shard").applyInArrow(simhash.shard_links, "u long, v long")
    roots = {r["id"]: r["root"] for r in components.components(links).collect()}
    labels = np.arange(len(fps))
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= 2)
    assert [roots.get(k, k) for k in range(len(fps))] == simhash.unite(labels, a, b).tolist()


def test_leaves_hold_every_pair_and_few_others(monkeypatch):
    draw = np.random.default_rng(8)
    base = draw.integers(0, 1 << 63, 6000, dtype=np.uint64)
    near = base[:2000] ^ (np.uint64(1) << draw.integers(0, 63, 2000).astype(np.uint64))
    crowd = base[0] ^ (np.uint64(1) << draw.integers(0, 63, 900).astype(np.uint64)) ^ (np.uint64(1) << draw.integers(0, 63, 900).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near, crowd]))
    monkeypatch.setattr(simhash, "LEAF", 200)
    met, compared = np.zeros((len(fps), len(fps)), bool), 0
    for at in simhash.leaves(fps):
        compared += len(at) ** 2
        met[np.ix_(at, at)] = True
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= 2)
    assert met[a, b].all() and compared < len(fps) ** 2 / 2
    links = simhash.shard_links(pa.table({"fp": fps.view(np.int64), "rep": np.arange(len(fps))}))
    labels = simhash.unite(np.arange(len(fps)), a, b)
    assert dict(zip(links["u"].to_pylist(), links["v"].to_pylist())) == {k: r for k, r in enumerate(labels.tolist()) if k != r}


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    """component_id from texts, against all pairs of fingerprints, with shards and leaves of a few rows."""
    draw = np.random.default_rng(3)
    texts = [None, "", " \n", "a", "A", "a b"]
    for _ in range(60):
        words = [f"w{x}" for x in draw.integers(0, 500, int(draw.integers(50, 700)))]
        texts += [" ".join(words), " ".join(words).upper(), " ".join([*words[:-1], "else"]), " ".join(["new", *words, "end"])]
    texts += [texts[6]] * 30
    ids = draw.permutation(len(texts)).tolist()
    for name, size in (("SHARD_LIMIT", 40), ("SHARD_TARGET", 20), ("LEAF", 8), ("LEAF_SAMPLE", 8)):
        monkeypatch.setattr(simhash, name, size)
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id BIGINT, text STRING")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    fps = np.array([brute_fingerprint(t) for t in texts], np.uint64)
    order = np.argsort(ids)
    a, b = np.nonzero(np.bitwise_count(fps[order][:, None] ^ fps[order]) <= 2)
    want = simhash.unite(np.arange(len(texts)), a, b)
    assert (fps[order][a] != fps[order][b]).any()
    assert [got[k] for k in range(len(texts))] == want.tolist()


def test_components_of_a_chain(spark):
    links = spark.range(60).select((F.col("id") + 1).alias("u"), F.col("id").alias("v"))
    assert {(r["id"], r["root"]) for r in components.components(links).collect()} == {(k, 0) for k in range(1, 61)}
    assert components.components(links.limit(0)).count() == 0


def test_nearest_is_exact(spark):
    draw = np.random.default_rng(2)
    vectors = draw.normal(size=(400, 6)).tolist()
    vectors[7], vectors[8], vectors[9], vectors[11], vectors[12] = None, [0.0] * 6, [float("nan")] * 6, vectors[10], [1.0]
    rows = [(k, v, "x") for k, v in enumerate(vectors)] + [(13, vectors[13], "again")]
    df = spark.createDataFrame(rows, "vec_id BIGINT, embedding ARRAY<DOUBLE>, score STRING")
    got = {}
    for r in nearest.search(df, F.col("vec_id") % 10 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    ids = np.array([k for k in range(400) if k not in (7, 8, 9, 12)])
    v = np.array([vectors[k] for k in ids])
    for q in (k for k in ids if k % 10 == 0):
        d = np.sqrt(((v - vectors[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        assert got[q] == ids[np.lexsort((ids, d))][:5].tolist()
    assert nearest.search(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_few_windows_are_open_for_clustered_vectors(spark):
    draw = np.random.default_rng(9)
    centres = draw.normal(size=(40, 16)) * 50
    vectors = (np.repeat(centres, 300, 0) + draw.normal(size=(12_000, 16))).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    opened = []
    keep = nearest.stored
    nearest.stored = lambda d, label: opened.append(keep(d, label)) or opened[-1]
    try:
        found = nearest.search(df, F.col("vec_id") % 100 == 0).collect()
    finally:
        nearest.stored = keep
    table = next(d for d in opened if "bound" in d.columns)
    assert table.count() < 120 * (12_000 / nearest.WINDOW_ROWS) / 4
    v, got = np.array(vectors), {}
    for r in found:
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    for q, ranked in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        assert [ranked[k] for k in range(1, 11)] == np.lexsort((np.arange(len(v)), d))[:10].tolist()
    assert len(got) == 120


def test_language(spark, hard, none, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language.identify(hard, docs.select("text", "lang")).collect()
    assert len(found) == len(HARD) + 1
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] != "und") == letters and 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in language.identify(hard, none.select("text", "lang")).collect()} == {"und"}
    held = QUERIES["op9_language"](spark, sf_dir).filter("held_out").join(docs, "doc_id")
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_marks_alone_have_no_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = spark.createDataFrame([("\u0301",), ("\u0301 12",), ("e\u0301t\u00e9",), ("12 !",)], "text STRING")
    found = {r["text"]: (r["lang_pred"], r["score"], r["accepted"]) for r in language.identify(texts, docs.select("text", "lang")).collect()}
    assert [found[t] for t in ("\u0301", "\u0301 12", "12 !")] == [("und", 0.0, False)] * 3 and found["e\u0301t\u00e9"][0] != "und"


def test_kneser_ney_is_a_distribution():
    grams = Counter()
    for word in ("abba", "abc", "cab", "aab"):
        padded = f"   {word} "
        grams.update(padded[k : k + 4] for k in range(len(padded) - 3))
    models = language.Models(["x"], [(0, g, n) for g, n in grams.items()])
    total = 0.0
    for c in "abc ":  # the next character after "ab"
        codes = np.array([ord(x) for x in f"   ab{c}"], np.uint32)
        keys, prob = language.gram_keys(codes), np.array([[models.uniform]])
        for order in range(1, 5):
            context = keys[order - 2][-2:-1] if order > 1 else np.zeros(1, np.uint64)
            prob = models._find(models.tables[order - 1], keys[order - 1][-1:], 0.0) + models._find(models.backoff[order - 1], context, 1.0) * prob
        total += prob[0, 0]
    assert 1 - 2 * models.uniform < total <= 1 + 1e-9


def test_tree_is_a_distribution_over_words(spark, hard, none):
    found = tree_weighting.score(hard, F.lit(True), F.col("lang")).collect()
    assert len(found) == len(HARD) + 1 and all(r["score"] < 0 and r["n_known"] == r["n_tokens"] for r in found)
    counts = Counter(w for t in [*HARD, HARD[-1]] for w in [*WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)})), None])
    n, v = sum(counts.values()), len(counts)
    for r in found:
        text = HARD[r["doc_id"] if r["doc_id"] is not None else 3]
        words = [*WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)})), None]
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["train_tokens"] == n
    assert tree_weighting.score(none, F.lit(True)).count() == 0
    assert tree_weighting.score(hard, F.lit(False)).count() == len(HARD) + 1


def test_kt_and_tree_weights_by_hand():
    assert np.exp(tree_weighting.kt_block(np.array([0, 1, 2]), np.array([1, 1, 0]))) == pytest.approx([0.5, 0.125, 0.375])
    keys, zeros, ones = (np.array(x) for x in ([1], [3.0], [1.0]))
    own = np.exp(tree_weighting.kt_block(zeros, ones))[0]
    weight, total = tree_weighting.weighted(np.array(keys, np.uint64), zeros, ones, 0, (np.array([1, 1], np.uint64), np.log([0.2, 0.4])))
    assert np.exp(total[0]) == pytest.approx((own + 0.08) / 2) and weight[0] == pytest.approx(own / (own + 0.08))


def brute_tree(words: list[bytes]):
    """Context-tree weighting by definition, from {(context nearest first, bits): [zeros, ones]}."""
    counts: dict = {}

    def decisions(word):
        line = bytes([0x20]) + word + bytes([0x20])
        for place in range(1, len(line)):
            context = line[max(0, place - tree_weighting.DEPTH) : place][::-1]
            bits = f"{line[place]:08b}"
            yield from ((context, bits[:k], int(bits[k])) for k in range(8))

    for word in words:
        for context, before, bit in decisions(word):
            for depth in range(len(context) + 1):
                counts.setdefault((context[:depth], before), [0, 0])[bit] += 1

    def own(node):
        zeros, ones = counts[node]
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    def leaf(context):
        return len(context) == tree_weighting.DEPTH or context[-1:] == b" "

    @functools.cache
    def block(node):
        context, before = node
        if leaf(context):
            return own(node)
        under = sum(block((context + bytes([c]), before)) for c in range(256) if (context + bytes([c]), before) in counts)
        return np.logaddexp(own(node), under) - math.log(2)

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

    def log10(word):
        found = ((one(context, before), bit) for context, before, bit in decisions(word))
        return sum(math.log10(0.5 if p is None else p if bit else 1 - p) for p, bit in found)

    return log10


def test_tree_weighting_by_brute_force(spark):
    rng = np.random.default_rng(5)
    stems = ["baba", "abacus", "cabbage", "x", "bac", "longerthansixbytes", "\u00e9t\u00e9", "\u4e2d\u6587"]
    rows = []
    for k in range(60):
        words = ["".join(rng.choice(stems, rng.integers(1, 3))) for _ in range(rng.integers(0, 12))]
        rows.append((k, " ".join(words), k % 4 != 0, ["a", "b", None][k % 3]))
    rows.append((60, "unseen zebra quux", False, "a"))
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, training BOOLEAN, lang STRING")
    found = {r["doc_id"]: r["score"] for r in tree_weighting.score(docs, F.col("training"), F.col("lang")).collect()}

    def words_of(text):
        return [*(w.encode() for w in text.split()), b""]

    shares = Counter(lang for _, _, training, lang in rows if training and lang)
    trees = [(1.0, brute_tree([w for _, t, training, _ in rows if training for w in words_of(t)]))]
    for name, n in shares.items():
        trees.append((n, brute_tree([w for _, t, training, lang in rows if training and lang == name for w in words_of(t)])))
    total = sum(n for n, _ in trees)
    for doc_id, text, _, _ in rows:
        logs = [math.log(n / total) + math.log(10) * sum(map(log10, words_of(text))) for n, log10 in trees]
        assert found[doc_id] == pytest.approx(np.logaddexp.reduce(logs) / math.log(10), rel=1e-4, abs=1e-4), doc_id


def test_toxicity(spark, hard, none, sf_dir):
    clean = [(k, f"plain words number {k} here", 0) for k in range(200)]
    toxic = [(k, f"you nasty{k % 3} words number {k}", 1) for k in range(200, 300)]
    docs = spark.createDataFrame(clean + toxic, "doc_id BIGINT, text STRING, toxic INT")
    model = toxicity.train(docs.select("doc_id", "text"), docs.filter("doc_id % 2 = 0").select("doc_id", "toxic"))
    rows = toxicity.score(docs, model).collect()
    assert np.mean([(r["score"] >= 0.5) == bool(r["toxic"]) for r in rows]) > 0.97
    assert all(0 <= r["score"] < 0.5 for r in toxicity.score(hard, model).collect())
    nothing = toxicity.train(none.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert all(r["score"] < 0.5 for r in toxicity.score(hard, nothing).collect())


def test_pipeline_stages(spark, hard, none, sf_dir):
    docs, counts = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == corpus_pipeline.COLUMNS
        counts.append(docs.count())
        assert stage(spark, none.select(corpus_pipeline.COLUMNS), sf_dir).count() == 0
        assert stage(spark, hard.select(corpus_pipeline.COLUMNS), sf_dir).count() <= len(HARD) + 1
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    ids = docs.agg(F.count("doc_id"), F.countDistinct("doc_id")).first()
    assert ids[0] == ids[1]


def test_digest_columns(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op5_bpe"](spark, sf_dir).collect():
        ids = ids_of(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    for r in QUERIES["op8_token_files"](spark, sf_dir).collect():
        assert r["ids_crc32"] == zlib.crc32(np.array(ids_of(texts[r["doc_id"]]) + [0], "<u4").tobytes())
