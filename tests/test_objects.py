"""The reader of one large JSON object."""

import gzip
import io
import json
import random
import tracemalloc

import pytest

from momentspark.sources import objects, readers


@pytest.mark.parametrize("piece", [1, 2, 7, 1000])
def test_members_are_those_of_the_whole_object(piece):
    r = random.Random(piece)
    value = lambda: r.choice([None, True, False, 12, -3.5e2, "", 'q"uo\\te\n', "é𝔘", [1, {"a": []}], {"x": {"y": "}"}}, "z" * 300])
    for _ in range(30):
        pairs = {f"k{k}\"é": value() for k in range(r.randint(0, 20))}
        text = json.dumps(pairs, indent=r.choice([None, 2]), ensure_ascii=r.random() < 0.5)
        assert dict(objects.members(io.StringIO(f" {text}\n"), piece)) == pairs


@pytest.mark.parametrize("bad", ["", "[1]", '{"a" 1}', '{"a": 1', '{"a": 1,}', "{1: 2}", '{"a": tru}'])
def test_what_is_no_object_fails(bad):
    with pytest.raises(ValueError):
        list(objects.members(io.StringIO(bad), 3))


def test_a_large_object_takes_little_memory():
    class Endless(io.TextIOBase):
        def __init__(self):
            self.parts = iter(p for k in range(-1, 100_001) for p in (["{"] if k < 0 else [f'"f{k}": "{"x" * 500}",'] if k < 100_000 else ['"last": 1}']))

        def read(self, n=-1):
            return next(self.parts, "")

    tracemalloc.start()
    assert sum(1 for _ in objects.members(Endless())) == 100_001
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_the_data_source(spark, tmp_path):
    rows = {f"v-1-{k}.jpg": f"text {k}" for k in range(12_000)} | {"null": None}
    with gzip.open(f"{tmp_path}/a.json.gz", "wt", encoding="utf-8") as f:
        json.dump(rows, f)
    with open(f"{tmp_path}/b.json", "w") as f:
        json.dump({"a": 25.0, "b": 30}, f)
    spark.dataSource.register(objects.JsonObject)
    got = spark.read.format("json_object").schema("name string, text string").load(f"{tmp_path}/a.json.gz")
    assert {r["name"]: r["text"] for r in got.collect()} == rows
    fps = spark.read.format("json_object").schema("video string, fps double").load(f"{tmp_path}/b.json")
    assert {tuple(r) for r in fps.collect()} == {("a", 25.0), ("b", 30.0)}
    assert spark.read.format("json_object").load(f"{tmp_path}/b.json").columns == ["key", "value"]
    assert readers.json_members(spark, f"{tmp_path}/b.json", "video", "fps", "double").columns == ["video", "fps"]
