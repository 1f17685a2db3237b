"""Long texts take time in proportion to their length."""

import random
import time

import pytest
from pyspark.sql import functions as F

from rubricon.functions import answers as A
from rubricon.functions import steps as S
from rubricon.functions.text import FOLD_BLOCK, fold_out


def brute_pieces(text):
    depth, begin, done = 0, None, []
    for i, c in enumerate(text):
        if c == "{":
            begin = i if depth == 0 else begin
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0 and begin is not None:
                done.append(text[begin : i + 1])
                begin = None
    return done


def test_balanced_pieces(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["{", "}", "é", "{}", "漢 x"]) for _ in range(rng.randint(0, 400))) for _ in range(120)]
    texts += ["", "{" * 50, "}" * 50, "{}" * (3 * FOLD_BLOCK + 1), "}{}{", "😀{é}"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for r in df.select("t", A.balanced_objects("t").alias("p")).collect():
        assert r["p"] == brute_pieces(r["t"])


@pytest.mark.parametrize("size", [0, 1, FOLD_BLOCK, FOLD_BLOCK + 1, 5 * FOLD_BLOCK, FOLD_BLOCK**2, 2 * FOLD_BLOCK**2 + 3])
def test_fold_gives_out_running_values(spark, size):
    items = F.sequence(F.lit(1), F.lit(size)) if size else F.array().cast("array<int>")
    sums = fold_out(items, F.lit(0), "int", lambda s, x: (s + x, s + x, x % 3 > 0))
    want, total = [], 0
    for x in range(1, size + 1):
        total += x
        want += [total] if x % 3 else []
    assert spark.range(1).select(sums.alias("s")).first()["s"] == want


def seconds(df, made):
    best = 1e9
    for _ in range(3):
        start = time.perf_counter()
        df.select(made.alias("x")).select(F.size("x")).collect()
        best = min(best, time.perf_counter() - start)
    return best


@pytest.mark.parametrize(
    ("made", "text", "small"),
    [
        (lambda: A.balanced_objects("t"), lambda n: "{" + '{"a": 1} text ' * n + "}", 4000),
        (lambda: A.balanced_objects("t"), lambda n: '{"a": 1} text ' * n, 4000),
        (lambda: S.text_steps("t"), lambda n: "total = 5\n1. add it\nreturn x\nplain\n" * (n // 4), 8000),
    ],
)
def test_four_times_the_text_takes_under_six_times_the_time(spark, made, text, small):
    rows = [spark.createDataFrame([(text(n),)], "t STRING").cache() for n in (small, 4 * small)]
    short, long = (seconds(r, made()) for r in rows)
    assert long < 6 * short + 0.2
