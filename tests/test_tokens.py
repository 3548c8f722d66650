"""Tokens, vocabulary, padding, masks and labels."""

from collections import Counter

import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lectern import fixed
from lectern.operators import sampling, tokens
from tests.plans import count

TEXTS = ["a b a, c!", "", "  ", "é中7 x_y", "a b\nc", "b b b"]


def split(text):
    return regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\t\n\x0B\f\r ]", text)


def table(spark, texts=TEXTS, partitions=1):
    return spark.createDataFrame(list(enumerate(texts)), "k int, text string").repartition(partitions)


def vocabulary(texts, size):
    ranked = sorted(Counter(p for t in texts for p in split(t)).items(), key=lambda e: (-e[1], e[0].encode()))
    return {p: i + fixed.RESERVED_IDS for i, (p, _) in enumerate(ranked[:size])}


def test_counts(spark):
    assert {r["k"]: r["n_tokens"] for r in tokens.token_count(table(spark)).collect()} == {
        k: len(split(t)) for k, t in enumerate(TEXTS)
    }


@pytest.mark.parametrize("size", [1, 3, 5, 100])
@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_vocabulary(spark, size, partitions):
    rows = tokens.build_vocab(table(spark, partitions=partitions), size).collect()
    assert {r["piece"]: r["id"] for r in rows} == vocabulary(TEXTS, size)


def test_vocabulary_is_bounded(spark):
    with pytest.raises(ValueError):
        tokens.build_vocab(table(spark), tokens.MAX_VOCABULARY + 1)


@pytest.mark.parametrize("size", [0, 3, 100])
def test_ids(spark, size):
    known = vocabulary(TEXTS, size)
    df = table(spark, [*TEXTS, None])
    rows = tokens.encode_with_vocab(df, tokens.build_vocab(df, max(size, 1)).limit(size)).collect()
    for r in rows:
        expected = [known.get(p, fixed.UNK_ID) for p in split(r["text"] or "")]
        assert (r["ids"], r["n_tokens"]) == (expected, len(expected))


def load_letters():
    return lambda texts: [[ord(c) for c in t] for t in texts]


def test_callers_encoder(spark):
    rows = tokens.encode_with(table(spark, ["ab", "", None]), load_letters).collect()
    assert {r["k"]: (r["ids"], r["n_tokens"]) for r in rows} == {0: ([97, 98], 2), 1: ([], 0), 2: ([], 0)}


def test_filter_and_truncate_at_the_limit(spark):
    df = tokens.encode_with(table(spark, ["abc", "abcd"]), load_letters)
    assert [r["text"] for r in tokens.length_filter(df, 3).collect()] == ["abc"]
    assert {r["k"]: (len(r["ids"]), r["n_tokens"]) for r in tokens.length_truncate(df, 3).collect()} == {0: (3, 3), 1: (3, 3)}


def test_one_python_stage_for_encoding_filter_and_padding(spark):
    df = sampling.with_order_key(table(spark).withColumn("row_key", F.col("k")))
    encoded = tokens.encode_with_vocab(df, tokens.build_vocab(df, 10))
    padded = tokens.make_labels(tokens.pad_tokens(tokens.length_filter(encoded, 8), 8))
    assert count(padded, "ArrowEvalPython") == 1
    by_caller = tokens.make_labels(tokens.pad_tokens(tokens.length_filter(tokens.encode_with(df, load_letters), 8), 8))
    assert count(by_caller, "ArrowEvalPython") == 1


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=12), min_size=1, max_size=40), st.integers(1, 9))
def test_padding_properties(spark, arrays, size):
    df = spark.createDataFrame([(a, len(a)) for a in arrays], "ids array<int>, n_tokens int")
    for r in tokens.make_labels(tokens.pad_tokens(df, size)).collect():
        n = min(r["n_tokens"], size)
        assert len(r["input_ids"]) == len(r["attention_mask"]) == len(r["labels"]) == size
        assert r["input_ids"] == r["ids"][:size] + [fixed.PAD_ID] * (size - n)
        assert r["attention_mask"] == [1] * n + [0] * (size - n)
        assert [x == fixed.IGNORED_LABEL for x in r["labels"]] == [m == 0 for m in r["attention_mask"]]
        assert [x for x in r["labels"] if x != fixed.IGNORED_LABEL] == r["ids"][:size]


def test_pad_id_inside_the_text(spark):
    df = tokens.pad_tokens(spark.createDataFrame([([5, 0, 6], 3)], "ids array<int>, n_tokens int"), 5)
    assert tokens.make_labels(df).first()["labels"] == [5, 0, 6, -100, -100]
    assert tokens.make_labels(df, mask_pad_ids=True).first()["labels"] == [5, -100, 6, -100, -100]


def test_left_padding_to_the_longest_of_the_batch(spark):
    df = spark.createDataFrame(
        [(0, [1], 1), (0, [1, 2, 3], 3), (1, [4], 1), (2, list(range(9)), 9), (2, [], 0)], "batch_id int, ids array<int>, n_tokens int"
    )
    rows = tokens.pad_left_batch(df, 5).collect()
    assert sorted((r["batch_id"], r["input_ids"], r["attention_mask"]) for r in rows) == [
        (0, [0, 0, 1], [0, 0, 1]),
        (0, [1, 2, 3], [1, 1, 1]),
        (1, [4], [1]),
        (2, [0, 0, 0, 0, 0], [0, 0, 0, 0, 0]),
        (2, [0, 1, 2, 3, 4], [1, 1, 1, 1, 1]),
    ]


def test_pieces_are_looked_up_in_slices_of_a_batch(spark, monkeypatch):
    taken, plain = [], tokens._once
    monkeypatch.setattr(tokens, "SLICE_PIECES", 5, raising=False)
    monkeypatch.setattr(tokens, "_once", lambda udf: taken.append(udf.func) or plain(udf))
    vocab = spark.createDataFrame([("a", 3)], "piece string, id int")
    df = spark.createDataFrame([(i, "a b " * (i % 7) if i % 5 else None) for i in range(40)], "k int, text string").coalesce(1)
    got = {r.k: r.ids for r in tokens.encode_with_vocab(df, vocab).collect()}
    expected = [[3, 2] * (i % 7 if i % 5 else 0) for i in range(40)]
    assert got == dict(enumerate(expected))
    batch = pa.array([["a", "b"] * (len(ids) // 2) for ids in expected])
    slices = [ids.to_pylist() for ids in taken[0](iter([batch, batch.slice(7, 9), batch.slice(0, 0)]))]
    assert [ids for rows in slices for ids in rows] == expected + expected[7:16]
    assert all(len(rows) == 1 or sum(map(len, rows)) <= 5 for rows in slices)
