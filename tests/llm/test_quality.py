from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import linear, quality
from lectern.llm.queries import QUERIES
from lectern.llm.textbatch import slices
from tests.llm import brute


def _base(text):
    text = text or ""
    w = brute.words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if brute.words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again), failed


def test_base_counts_on_odd_texts(spark):
    texts = [None, "", " \n\t", "a b\n\na b\n a b\na b", "x " * 7, "x " * 8, "x " * 9, "a b c d e f g h i " * 3, "é#ß <|> 漢字\x0bq\x1cz\x85\xa0y",
             "w " * 100_000, "same line here\n" * 30, " ".join(map(str, range(40)))]
    rows = [(i, t, "x", True) for i, t in enumerate(texts)] + [(None, "no id", "x", True), (3, texts[3], "x", True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_words string, kept boolean")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge_quality(docs, labels).collect())
    assert got == sorted((str(r[0]), *_base(r[1])) for r in rows)
    assert quality.judge_quality(docs.limit(0), labels).count() == 0


def test_whole_table(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in QUERIES["op2_quality"](spark, sf_dir).collect()}
    for r in docs.collect():
        g = rows.pop(r.doc_id)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == _base(r.text)
        assert not (g.base_failed and g.kept)
    assert not rows
    kept = quality.without_rejected(docs, labels)
    assert kept.columns == docs.columns


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, rows=2000)
    picked = labels.selectExpr("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").offset(2000)
    rows = picked.join(docs, "doc_id").select("text", "quality").collect()
    chance = np.concatenate([model.probabilities(p) for p in slices(pa.array([r.text for r in rows]))])
    sound = np.array([not _base(r.text)[-1] for r in rows])
    good = np.array([r.quality == 1 for r in rows])
    assert (chance[good & sound] >= 0.5).mean() > 0.98
    assert (chance[~good & sound] < 0.5).mean() > 0.85


def test_logistic_regression_finds_the_minimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = x @ [2, -1, 0.5] + 0.2 + rng.normal(size=200) * 0.3 > 0
    rows, columns = np.divmod(np.arange(600), 3)
    weights, offset = linear.fit_logistic(rows, columns, x.ravel(), y, 3, steps=4000, penalty=1e-2)
    share = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())
    error = share * (linear.sigmoid(x @ weights + offset) - y)
    assert x.T @ error + 1e-2 * weights == pytest.approx(np.zeros(3), abs=1e-6)
    slope, shift = linear.fit_platt(x @ weights, y)
    assert slope > 0
