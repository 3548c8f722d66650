"""JSON arrays cut into splits of any size, against Python's own JSON reader."""

import contextlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.plans.catalog import QUERIES
from lectern.sources.arrays import array_lines
from lectern.sources.load import SourceSpec, read_json
from lectern.sources.sinks import write_json_arrays

SCHEMA = "a bigint, s string, l array<struct<x:bigint,y:string>>"


@contextlib.contextmanager
def splits_of(spark, size):
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def awkward(dice):
    texts = ['}', '{"', "]", "\\", '\\"', "\n", "é密😀", '},{"a":1', "[", "", "plain words ", "\\\\", '"', "\t,", " "]
    text = lambda: "".join(dice.choice(texts) for _ in range(dice.randrange(8)))
    inner = [{"x": dice.randrange(9), "y": text()} for _ in range(dice.randrange(3))]
    return {"a": dice.randrange(1000), "s": dice.choice([text(), None]), "l": dice.choice([inner, [], None])}


def found_in(spark, path, **spec):
    rows = read_json(spark, SourceSpec(str(path), format="json", json_array=True, schema=SCHEMA, **spec)).select("a", "s", "l").collect()
    return sorted((r.asDict(recursive=True) for r in rows), key=repr)


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_rows_of_random_arrays(spark, tmp_path, size):
    dice = random.Random(size)
    rows = []
    for number, layout in enumerate([{}, {"indent": 2}, {"separators": (",", ":")}, {"indent": 1, "ensure_ascii": False}]):
        some = [awkward(dice) for _ in range(dice.randrange(40) if size < 1000 else 400)]
        rows += some
        text = json.dumps(some, **layout) + ("\n" if number % 2 else "")
        (tmp_path / f"{number}.json").write_text(("﻿" if number == 2 else " \n") + text, encoding="utf-8")
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "blank.json").write_text("[ \n ]\n")
    with splits_of(spark, size):
        assert found_in(spark, tmp_path) == sorted(rows, key=repr)


def test_an_element_over_many_splits(spark, tmp_path):
    rows = [{"a": 1, "s": "x", "l": []}, {"a": 2, "s": '}"{' * 5000, "l": None}, {"a": 3, "s": "", "l": None}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    with splits_of(spark, 500):
        assert found_in(spark, tmp_path) == sorted(rows, key=repr)


def test_objects_without_an_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a":1,"s":"x"}\n{"a":2,\n "l":[{"x":1}]}\n')
    (tmp_path / "b.json").write_text('[{"a":3}]')
    with splits_of(spark, 9):
        assert [r["a"] for r in found_in(spark, tmp_path)] == [1, 2, 3]


@pytest.mark.parametrize("text", ['[{"a":1},{"a":2', '[{"a":1}', '[{"a":1},', '[{"s":"x\ny"}]', '[{"a":1}, 7, {"a":2}]', '[{"a":1'])
def test_malformed_arrays_end_the_read(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    for size in (5, 1 << 20):
        with splits_of(spark, size):
            with pytest.raises(Exception, match="(?i)malformed"):
                found_in(spark, tmp_path)
            found_in(spark, tmp_path, mode="DROPMALFORMED")


def test_an_array_is_read_by_many_tasks(spark, tmp_path):
    rows = [{"a": i, "s": "word " * 50} for i in range(4000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    with splits_of(spark, 50_000):
        folders = array_lines(spark, str(tmp_path / "a.json"))
        written = spark.read.text(folders[0]).where("value <> ''").groupBy(F.col("_metadata.file_path")).count().collect()
    assert len(written) > 10 and max(r["count"] for r in written) < 400


def test_nothing_to_read(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    assert found_in(spark, tmp_path) == []


def test_written_arrays_are_json(spark, tmp_path):
    df = spark.range(0, 50, 1, 7).select("id", F.when(F.col("id") % 2 == 0, "é\n}").alias("s"))
    write_json_arrays(df.where("id < 40"), str(tmp_path / "out"))
    found = [row for f in sorted((tmp_path / "out").glob("part-*")) for row in json.loads(f.read_text(encoding="utf-8"))]
    assert found == [{"id": i, "s": None if i % 2 else "é\n}"} for i in range(40)]


def test_query_over_small_splits(spark, small_dir):
    with splits_of(spark, 3000):
        df = QUERIES["source_json_array_split"](spark, small_dir)
        rows = df.drop("row_key").collect()
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    key = lambda r: r["doc_id"]
    assert sorted((r.asDict() for r in rows), key=key) == sorted((r.asDict() for r in docs.collect()), key=key)
