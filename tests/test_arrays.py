"""JSON arrays read in ranges, against Python's own reader."""

import json
import random

import pytest
from pyspark.sql import functions as F

from rubricon.sources import arrays, files

FIELDS = "id STRING, v STRING"
PIECES = ["a", "}", "{", "[", "]", '"', "\\", ",", ":", "\n", "é", '"}', '\\"', "\\\\", "items", '": [', "]}"]


@pytest.fixture()
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "61b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def value(rng, depth=0):
    kind = rng.random()
    if depth > 2 or kind < 0.5:
        return rng.choice(["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 8))), 1.5, None, True])
    if kind < 0.75:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(PIECES) + str(i): value(rng, depth + 1) for i in range(rng.randint(0, 3))}


def record(rng, i):
    return {"v": value(rng), "id": str(i), "items": [value(rng)]}


def written(x):
    return x if isinstance(x, str) or x is None else json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def read(spark, path, inner=None):
    rows = files.read_records(spark, str(path), FIELDS, layout="array", inner=inner).orderBy("pos").collect()
    assert len({r["pos"] for r in rows}) == len(rows)
    return [(r["id"], r["v"]) for r in rows]


def same(found, records):
    assert [r[0] for r in found] == [r["id"] for r in records]
    for (_, v), want in zip(found, (r["v"] for r in records)):
        assert v == written(want) or json.loads(v) == want


@pytest.mark.parametrize("indent", [None, 3])
def test_random_arrays(spark, tmp_path, small_ranges, indent):
    rng, everything = random.Random(indent), []
    for name in ("a", "b", "c"):
        listed = [record(rng, f"{name}{i}") if rng.random() < 0.8 else value(rng, 1) for i in range(40)]
        listed = [x for x in listed if not isinstance(x, dict) or "id" in x]
        (tmp_path / f"{name}.json").write_text(json.dumps(listed, indent=indent, ensure_ascii=name == "a") + "\n" * (name == "b"))
        everything += [x for x in listed if isinstance(x, dict)]
    same(read(spark, tmp_path), everything)


@pytest.mark.parametrize("indent", [None, 3])
def test_random_inner_lists(spark, tmp_path, small_ranges, indent):
    rng = random.Random(indent)
    for k in range(4):
        around = {f"{rng.choice(PIECES)}{i}": rng.choice([value(rng), [record(rng, "no")], {"x": record(rng, "no"), "y": {"z": 1}}]) for i in range(4)}
        items = [record(rng, str(i)) if rng.random() < 0.8 else rng.choice([1, "x", [{"id": "no"}]]) for i in range(15)]
        if k == 3:
            items = []
        keys = [*around.items(), ("items", items)]
        rng.shuffle(keys)
        (tmp_path / f"{k}.json").write_text(json.dumps(dict(keys), indent=indent))
        same(read(spark, tmp_path / f"{k}.json", "items"), [x for x in items if isinstance(x, dict)])


def test_small_files(spark, tmp_path, small_ranges):
    one = {"id": "1", "v": "x" * 300 + "{"}
    for text, want in (("[]", []), (" \n[ ]\n ", []), ("[1, [], \"}\"]", []), (json.dumps(one), [one]), (f" {json.dumps(one)}\n", [one]), (json.dumps([one] * 3), [one] * 3)):
        (tmp_path / "f.json").write_text(text)
        same(read(spark, tmp_path / "f.json"), want)


GOOD = '[{"id": "1", "v": "}"}, {"id": "2"}]'


@pytest.mark.parametrize(
    "text",
    [
        GOOD + " garbage", GOOD + "]", GOOD + GOOD, GOOD + "\n" + GOOD, GOOD[:-1], GOOD[:-9], "x" + GOOD, "garbage", GOOD[1:], GOOD + "}", GOOD + ' "x"',
        '[{"id": "1"} {"id": "2"}]', '[{"id": "1"}, {"id" "2"}]', '[{"id": "1}, {"id": "2"}]', '{"id": "1"}, {"id": "2"}', '[{"id": "1"}}]', "[[{}]", GOOD + "\n, 5",
    ],
)
def test_broken_files_raise(spark, tmp_path, text):
    (tmp_path / "f.json").write_text(text)
    with pytest.raises(Exception, match="no JSON"):
        read(spark, tmp_path / "f.json")


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    rows = [{"id": str(i), "v": "some text {\"[}" * 20} for i in range(4000)]
    (tmp_path / "big.json").write_text(json.dumps(rows, indent=1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        found = arrays.fragments(spark, str(tmp_path / "big.json"))
        assert found.select("start").distinct().count() > 8 and found.select(F.spark_partition_id()).distinct().count() > 8
        same(read(spark, tmp_path / "big.json"), rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
