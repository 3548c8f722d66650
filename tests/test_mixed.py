"""JSON sources whose rows disagree on types."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lectern.sources.load import SourceSpec, load_source

SCHEMA = "id bigint, text string, notes array<string>, counts array<bigint>, rate double, `it's` boolean, rest variant"


def _load(spark, tmp_path, lines, schema=SCHEMA, **options):
    path = tmp_path / "rows.jsonl"
    path.write_text("\n".join(lines), encoding="utf-8")
    return load_source(spark, SourceSpec(str(path), name="rows", schema=schema, mixed=True, **options))


def _rows(df):
    return [r.asDict() for r in df.collect()]


def _as_text(value):
    if isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def _as_whole(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)):
        return int(value) if value == int(value) and abs(value) < 2**63 else None
    try:
        return int(value) if isinstance(value, str) else None
    except ValueError:
        return None


def _listed(value):
    return value if isinstance(value, list) or value is None else [value]


def _brute(row):
    """``id, text, notes, counts`` and the names of those that lost something."""
    notes, counts = _listed(row.get("notes")), _listed(row.get("counts"))
    out = {
        "id": None if row.get("id") is None else _as_whole(row["id"]),
        "text": None if row.get("text") is None else _as_text(row["text"]),
        "notes": notes and [None if v is None else _as_text(v) for v in notes],
        "counts": counts and [None if v is None else _as_whole(v) for v in counts],
    }
    lost = [] if out["id"] is not None or row.get("id") is None else ["id"]
    lost += ["counts"] if any(v is not None and w is None for v, w in zip(counts or [], out["counts"] or [])) else []
    return {**out, "misfits": lost}


def test_random_rows_against_plain_python(spark, tmp_path):
    rnd = random.Random(5)
    values = [1, -7, 0, 2**53 + 1, 2.5, 4.0, True, False, None, "", "12", "-3", "a \"b\"\né", "1.5", {"k": [1, "x"]}, [], [1], ["q", None, 3]]
    rows = [{c: rnd.choice(values) for c in ("id", "text", "notes", "counts") if rnd.random() < 0.85} for _ in range(400)]
    for r in rows:  # a number as text comes out in its shortest form
        for c in ("text", "notes"):
            r[c] = 4 if r.get(c) == 4.0 and not isinstance(r.get(c), bool) else r.get(c)
    got = _rows(_load(spark, tmp_path, [json.dumps({"n": i, **r}) for i, r in enumerate(rows)], "n int, id bigint, text string, notes array<string>, counts array<bigint>"))
    assert len(got) == len(rows)
    for r in got:
        expected = _brute(rows[r["n"]])
        assert {k: r[k] for k in expected} == expected, rows[r["n"]]
        assert (r["raw"] is not None) == bool(expected["misfits"])


def test_no_row_is_lost(spark, tmp_path):
    lines = ['{"id": 1, "text": ', "[1, 2]", '"x"', "nonsense", '{"id": 2, "id": 3}', "", "  \t", '{"id": 4, "rate": "many", "it\'s": "true"}', "{}", '{"id": 99999999999999999999}']
    got = {r["raw"]: r for r in _rows(_load(spark, tmp_path, lines).drop("rest"))}
    assert set(got) == {*lines[:5], lines[7], lines[9], None}
    assert all(got[line]["misfits"] is None and got[line]["id"] is None for line in lines[:5])
    assert got[lines[7]]["misfits"] == ["rate"] and got[lines[7]]["it's"] is True and got[lines[7]]["id"] == 4
    assert got[lines[9]]["misfits"] == ["id"] and got[None]["misfits"] == []


def test_keys_of_rows_that_cannot_be_read(spark, tmp_path):
    lines = ['{"id": 1', '{"id": 2', '{"id": "x"}', '{"id": 5}', '{"id": "6"}']
    keys = [r["row_key"] for r in _rows(_load(spark, tmp_path, lines, "id bigint", key="id"))]
    assert len(set(keys)) == 5 and {k for k in keys if "\\0" not in k} == {f"rows:{n:019d}" for n in (5, 6)}
    copies = _load(spark, tmp_path, lines * 2, "id bigint")
    assert copies.select("row_key").distinct().count() == 10


def test_arrays_and_splits(spark, tmp_path):
    path = tmp_path / "rows.json"
    path.write_text(json.dumps([{"id": "1", "split": "train"}, {"id": 2, "split": "test"}, {"id": [3]}, {"id": None}]), encoding="utf-8")
    rows = _rows(load_source(spark, SourceSpec(str(path), schema="id bigint, split string", mixed=True)))
    assert sorted((r["id"], r["raw"]) for r in rows if r["raw"] is None) == [(1, None)]
    assert [json.loads(r["raw"]) for r in rows if r["raw"]] == [{"id": [3]}]


def test_very_long_values_and_empty_files(spark, tmp_path):
    long = json.dumps({"id": 1, "text": ["w " * 2_000_000]})
    got = _rows(_load(spark, tmp_path, [long]).select("id", F.length("text").alias("n"), "raw"))
    assert got == [{"id": 1, "n": 4_000_004, "raw": None}]
    assert _load(spark, tmp_path, []).count() == 0


def test_schemas_that_cannot_be(spark, tmp_path):
    for schema in ("raw string", "a struct<b: int>", "a array<array<int>>", "`a?` int"):
        with pytest.raises(ValueError):
            _load(spark, tmp_path, ["{}"], schema)
    with pytest.raises(ValueError):
        _load(spark, tmp_path, ["{}"], None)


def test_the_scan_parses_each_row_once(spark, tmp_path):
    plan = _load(spark, tmp_path, ["{}"], key="id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
