"""Chunked BPE, whitening and spelling variants against libraries and brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from rubricon.llm import chunked_bpe, spelling, whitening
from rubricon.llm.queries import QUERIES
from tests.llm.test_operators import HARD

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=chunked_bpe.read_ranks(RANKS), special_tokens={})
DOCS = "doc_id BIGINT, text STRING, ids STRING, key STRING"


def docs_of(spark, texts):
    return spark.createDataFrame([(k if k != 3 else None, t, "old", "kept") for k, t in enumerate(texts)], DOCS)


def mixed_text(draw, size):
    alphabet = list("abcdest'lrvem 12!?\n\t\ré漢　\U0001f600\x1c\x85́") + ["  ", "   ", "'re", "word ", "I'll "]
    return "".join(draw.choice(alphabet, size))


def long_texts():
    draw = np.random.default_rng(3)
    return [
        *HARD, *(mixed_text(draw, n) for n in (300, 900, 1700, 2500, 4000)),
        "a" * 5000, " " * 3000 + "x" + "\n" * 900, "漢" * 1000, "ab " * 1500 + "b" * 900 + " cd" * 500, "x'" * 800 + "'re" * 700, "\U0001f600" * 400,
    ]


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 1 << 10), (200, 40), (97, 20)])
def test_chunks_encode_as_the_library(spark, chunk, overlap):
    texts = long_texts()
    found = chunked_bpe.encode(docs_of(spark, texts), RANKS, chunk=chunk, overlap=overlap)
    assert sorted(found.columns) == ["doc_id", "ids", "key", "text"]
    rows = chunked_bpe.decode(found, RANKS, packed="packed").collect()
    assert Counter(r["text"] for r in rows) == Counter(texts) and {r["key"] for r in rows} == {"kept"}
    for r in rows:
        want = ENCODING.encode_ordinary(r["text"] or "")
        assert r["ids"] == want and bytes(r["packed"]) == np.array(want, "<u4").tobytes()
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_stitches_of_a_few_long_pre_tokens_take_few_rounds(spark):
    texts = spark.createDataFrame([(1, "word and " * 400), (2, "a" * 900 + " b" * 900)], "key LONG, text STRING")
    cuts = chunked_bpe.stitches(chunked_bpe.chunks_of(texts, 100, 40), RANKS, 100, 40).collect()
    assert all(r["begin"] is not None for r in cuts if r["key"] == 1)
    assert any(r["begin"] is None for r in cuts if r["key"] == 2)


def test_chunks_of_nothing_and_unknown_ids(spark):
    assert chunked_bpe.encode(docs_of(spark, ["x"]).limit(0), RANKS).count() == 0
    kept = chunked_bpe.encode(docs_of(spark, ["a b", "x " * 300]), RANKS, keep=["key", "doc_id"], chunk=100, overlap=40)
    assert kept.columns == ["key", "doc_id", "ids"] and kept.count() == 2
    ids = spark.createDataFrame([([99999, 72, -1, 73],), ([],), (None,)], "ids ARRAY<INT>")
    want = ENCODING.decode_bytes([72, 73])
    assert [bytes(r["decoded"]) for r in chunked_bpe.decode(ids, RANKS).collect()] == [want, b"", b""]


def test_chunk_digests(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op11_chunked_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ENCODING.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def brute_whitening(vectors):
    """(x of each vector, fit list, variances and components by falling variance)."""
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    values, parts = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    return x, fit, values[::-1], parts[:, ::-1]


def check_whitening(rows, ids, vectors, wanted):
    x, fit, values, parts = brute_whitening(vectors)
    n, sums = len(fit), fit.sum(0)
    seen = {}
    for r in rows:
        seen.setdefault(r["component"], {})[r["vec_id"]] = r
    assert sorted(seen) == list(range(1, wanted + 1))
    for c, found in seen.items():
        assert sorted(found) == sorted(ids)
        want = (x - sums / n) @ parts[:, c - 1] / np.sqrt(values[c - 1])
        got = np.array([found[i]["whitened"] for i in ids])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-7
        for i, row in zip(ids, x):
            r = found[i]
            assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums))
            assert r["explained"] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening(spark):
    draw = np.random.default_rng(4)
    vectors = (draw.normal(size=(500, 24)) * np.linspace(1, 3, 24)).tolist()
    rows = [(k, v, 0.5) for k, v in enumerate(vectors)] + [(1000, vectors[3], 0.5)]
    odd = [(2000, None, 0.0), (2001, [float("nan")] * 24, 0.0), (2002, [float("inf")] + [0.0] * 23, 0.0), (2003, [None] * 24, 0.0), (2004, [1.0], 0.0), (2005, [], 0.0)]
    df = spark.createDataFrame(rows + odd, "vec_id BIGINT, embedding ARRAY<DOUBLE>, whitened DOUBLE")
    found = whitening.whiten(df).collect()
    check_whitening(found, [r[0] for r in rows], [r[1] for r in rows], 16)


def test_whitening_where_few_directions_vary(spark):
    draw = np.random.default_rng(5)
    flat = np.zeros((60, 8))
    flat[:, :3] = draw.normal(size=(60, 3))
    ids = list(range(60))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(flat)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    check_whitening(whitening.whiten(df).collect(), ids, flat, 3)
    assert whitening.whiten(df.filter("vec_id = 1")).count() == 0
    assert whitening.whiten(df.limit(0)).columns == whitening.whiten(df).columns
    assert whitening.whiten(df.limit(0)).count() == 0


def test_whitening_with_equal_variances(spark):
    corners = [[float(2 * (k >> b & 1)) for b in range(5)] for k in range(32)]
    df = spark.createDataFrame(list(enumerate(corners)), "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    places = np.zeros((32, 5))
    for r in whitening.whiten(df).collect():
        places[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["explained"] == pytest.approx(0.2) and r["identity_error"] < 1e-9
    assert np.abs(places.T @ places / 32 - np.eye(5)).max() < 1e-9


def test_whitening_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    check_whitening(QUERIES["op12_whitening"](spark, sf_dir).collect(), [r["vec_id"] for r in rows], [r["embedding"] for r in rows], 16)


def brute_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and one_apart(v, w)] for w in words}
    forms = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, words[w], len(near[w]), words.get(forms[w]))
    return out


def found_variants(df):
    rows = spelling.variants(df).collect()
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(found) == len(rows)
    return found


def spelled(draw, size):
    stems = ["".join(draw.choice(list("abneéß"), 7)) for _ in range(8)]
    words = []
    for k in range(size):
        w = list(stems[int(draw.zipf(1.6)) % 8])
        for _ in range(int(draw.integers(0, 3)) if k % 4 == 0 else 0):
            at = int(draw.integers(0, len(w)))
            w[at : at + int(draw.integers(0, 2))] = list(draw.choice(list("abnEÉ"), int(draw.integers(0, 2))))
        words.append("".join(w))
    return " ".join(words)


@pytest.mark.parametrize("shard", [1 << 16, 40])
def test_spelling_is_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(spelling, "SHARD_WORDS", shard)
    draw = np.random.default_rng(6)
    rows = [(k, spelled(draw, 300)) for k in range(40)] + [(None, "abnormal abnormal abnormally abnormally"), (50, None), (51, ""), (52, "x" * 5000 + " " + "x" * 5000), (52, "y" * 5000)]
    rows += [(60 + k, "gleichheit gleichheit gleichheiten") for k in range(30)] * 2 + [(90 + k, "gleichheyt übergröße×÷ ŸĀ") for k in range(3)]
    rows += [(200 + k, "kettenglied " * 40 + "kettenglie " * 2) for k in range(25)] + [(k, "kettengli") for k in range(230, 235)]
    df = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id BIGINT, text STRING, word STRING").repartition(5)
    want = brute_variants(rows)
    assert sum(v[3] > 0 for v in want.values()) > 60 and any(v[0] and v[1] != v[0] for v in want.values())
    assert found_variants(df) == want


def test_spelling_of_nothing(spark):
    df = spark.createDataFrame([(1, "short words"), (2, None)], "doc_id BIGINT, text STRING")
    assert found_variants(df) == {} == found_variants(df.limit(0))


def test_spelling_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in QUERIES["op13_spelling"](spark, sf_dir).collect()}
    assert found == brute_variants(rows)


def test_running_crc():
    data = np.frombuffer(b"abcdefgh" * 100, np.uint8)
    starts, ends = np.array([0, 3, 5, 10]), np.array([8, 3, 700, 300])
    got = spelling.crc_on(np.array([zlib.crc32(b"7:")] * 4, np.uint32), data, starts, ends)
    assert got.tolist() == [zlib.crc32(b"7:" + data[a:b].tobytes()) for a, b in zip(starts, ends)]


def test_index_ranks():
    words = spelling.Vocabulary(["banana", "ananas", "band", "a"])
    index = spelling.Index(words.flat, words.starts, words.lengths, len(words.alphabet))
    text = "banana$ananas$band$a$"
    place = lambda p: (text[p:].split("$")[0] + "$", text[p:].count("$") * -1)
    assert index.suffixes.tolist() == sorted(range(len(text)), key=lambda p: (place(p)[0].replace("$", "\x00"), place(p)[1]))
    before = [text[p - 1] for p in index.suffixes]
    for c, symbol in enumerate("$" + "".join(chr(x) for x in words.alphabet)):
        for at in range(len(text) + 1):
            assert index.occurrences(np.array([c]), np.array([at]))[0] == before[:at].count(symbol)
            assert index.smaller(np.array([c]), np.array([at]))[0] == sum(b < symbol for b in before[:at])
