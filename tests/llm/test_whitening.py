"""Whitening against NumPy's own eigenvectors of the whole covariance."""

from __future__ import annotations

import math

import numpy as np
import pytest

from lectern.llm import queries, whitening

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, components=4):
    """vec_id -> deviation and whitened (up to signs), with n, explained and the eigenvalues."""
    kept = [(i, v) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    lengths = [len(v) for _, v in kept]
    length = max(set(lengths), key=lambda n: (lengths.count(n), n)) if kept else 0
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in kept if len(v) == length]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    mean = np.array([s / n for s in sums], dtype=float)
    centred = fit.astype(float) - mean
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = [(i, sum((n * v - s) ** 2 for v, s in zip(x, sums)), (np.array(x, dtype=float) - mean) @ vectors / np.sqrt(values)) for i, x in kept]
    return n, out, values / np.square(centred).sum() * n, values


def agree(df, rows, components=4, tolerance=1e-7):
    n, expected, explained, values = brute(rows, components)
    found = {}
    for r in df.collect():
        assert r["n"] == n and r["identity_error"] <= 1e-9
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        found.setdefault((r["vec_id"], r["deviation"]), []).append((r["component"], r["whitened"]))
    assert sorted(found, key=repr) == sorted({(i, d) for i, d, _ in expected}, key=repr)
    signs = {}
    for i, deviation, white in expected:
        mine = found[i, deviation]
        assert len(mine) % components == 0
        for component, value in mine:
            other = white[component - 1]
            if abs(other) > 1e-3:
                signs.setdefault(component, set()).add(np.sign(value * other))
            assert abs(value) == pytest.approx(abs(other), abs=tolerance)
    assert all(len(s) == 1 for s in signs.values())


def test_whole_table(spark, sf_dir):
    df = queries.QUERIES["op12_whitening"](spark, sf_dir)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    agree(df, rows)
    assert df.count() == 4 * len(rows)


def test_awkward_rows(spark):
    dice = np.random.default_rng(4)
    rows = [(i, (dice.standard_normal(6) * [9, 7, 5, 3, 1, 1]).astype(np.float32).tolist()) for i in range(200)]
    rows += [(7, rows[3][1])] * 300 + [(None, rows[5][1]), (900, None), (901, []), (902, [1.0, None, 2.0, 3.0, 4.0, 5.0])]
    rows += [(903, [float("nan")] * 6), (904, [float("inf")] + [0.0] * 5), (905, [1.0, 2.0]), (906, [-0.0, 0.0, -1e-9, 0.0, 0.0, 0.0])]
    df = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(9))
    agree(df, rows)
    assert df.where("vec_id = 7").count() == 4 * 301


@pytest.mark.parametrize("dimension", [1, 3])
def test_fewer_dimensions_than_components(spark, dimension):
    dice = np.random.default_rng(dimension)
    rows = [(i, (dice.standard_normal(dimension) * 2.0 ** -np.arange(dimension)).astype(np.float32).tolist()) for i in range(50)]
    df = whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    agree(df, rows, dimension)
    assert df.count() == 50 * dimension


def test_without_variance_or_rows(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], SCHEMA)
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(5)], SCHEMA)
    assert whitening.whiten(same).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in whitening.whiten(line).select("component").distinct().collect()] == [(1,)]


def test_numbers_beyond_a_bigint(spark):
    rows = [(i, [3e14 * (i % 7), float(i)]) for i in range(30)]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert {r["deviation"] for r in found.where("vec_id = 0").collect()} == {None}


def test_filter_finds_leading_pairs_of_close_and_of_steep_spectra():
    dice = np.random.default_rng(1)
    turn, _ = np.linalg.qr(dice.standard_normal((90, 90)))
    for spectrum in (1 + 0.001 * np.arange(90), 10.0 ** (-np.arange(90) / 4), np.r_[np.ones(3), np.zeros(87)]):
        spectrum = np.sort(spectrum)[::-1]
        matrix = turn * spectrum @ turn.T
        values, vectors = whitening.leading_pairs(lambda b: matrix @ b, 90, 4)
        assert values == pytest.approx(spectrum[:4], abs=1e-10 * spectrum[0])
        assert np.abs(matrix @ vectors - vectors * values).max() < 1e-10 * spectrum[0]
