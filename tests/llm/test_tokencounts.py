import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import tokencounts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
PARTS = ["a", "'s", "'ll", "'re", "'", " ", "  ", "\n", "\t", "1", "é", "ß", "!", "<|endoftext|>", "don't", "\xa0", "漢", "🙂"]
PARTS += ["=", "-", "the", "ing", "\x85", "\x1c", " ", "٣", "aaaa", "    ", "XII", "ﬁ"]


@pytest.fixture(scope="module")
def counter():
    with open(PATH, "rb") as f:
        return tokencounts.Counter(f.read())


def _want(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_random_texts(counter):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    assert counter.texts(texts).tolist() == _want(texts)


def test_long_pieces_and_texts(counter):
    texts = ["=" * 3001, "ab" * 4000, " " * 5000 + "x", "word " * 30_000, "\n" * 700, ""]
    assert counter.texts(texts).tolist() == _want(texts)


def test_bounded_states_give_the_same(counter, monkeypatch):
    monkeypatch.setattr(tokencounts, "MAX_STATES", 50)
    small = tokencounts.Counter(open(PATH, "rb").read())
    rnd = random.Random(2)
    for _ in range(5):
        texts = ["".join(rnd.choice(PARTS) for _ in range(50)) for _ in range(50)]
        assert small.texts(texts).tolist() == _want(texts)


def test_scan_composes_in_order():
    rng = np.random.default_rng(0)
    maps = rng.integers(0, 5, (13, 5)).astype(np.uint8)
    state = np.arange(5)
    for chunk, done in zip(maps, tokencounts.compose_scan(maps)):
        state = chunk[state]
        assert done.tolist() == state.tolist()


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokencounts.token_counts(docs, PATH).collect()}
    want = _want([r.text for r in rows])
    assert got == {r.doc_id: (len(r.text.encode()), n, n > 1024) for r, n in zip(rows, want)}


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "one two", None), (3, "same", "x"), (3, "same", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokencounts.token_counts(docs, PATH).collect())
    assert got == [("1", 0, 0, False), ("2", 0, 0, False), ("3", 4, 1, False), ("3", 4, 1, False), ("None", 7, 2, False)]
    assert tokencounts.token_counts(docs.limit(0), PATH).count() == 0
