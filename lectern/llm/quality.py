"""Quality rules, and a hashed n-gram logistic regression trained on labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.landing import batch
from lectern.llm.linear import fit_logistic, fit_platt, sigmoid
from lectern.llm.textbatch import IS_SPACE, Slice, gram_hashes, mix, slices, text_of_word, whole_grams, word_hashes, words_of

# Base rules: fixed values of the contract.
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = b"#*$%&|<>"
# A text of good quality has at least this calibrated probability.
MIN_PROBABILITY = 0.5

TABLE_BITS = 18
WORD_GRAMS = (1, 2)
LETTER_GRAMS = (2, 3, 4)
# At most so many labelled rows are learnt from, those with the smallest hashes of their ids.
TRAIN_ROWS = 3000

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_FACTORS = np.random.default_rng(5).integers(1, 1 << 62, 8, dtype=np.uint64) | np.uint64(1)


# --- base rules


def ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words in windows of words that the text holds twice or more.

    Windows are compared exactly: numbers stand for words, then for pairs of these, and so on up to the window.
    """
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    names = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    if len(numbers) == len(words):
        return 0
    reach = 1
    while reach < window:
        names = ranks(names[:-reach] * (int(names.max()) + 1) + names[reach:])
        reach *= 2
    again = np.flatnonzero(np.bincount(names)[names] > 1)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, again, 1)
    np.add.at(change, again + window, -1)
    return int((np.cumsum(change) > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def base_counts(part: Slice) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every text."""
    character = (part.data & 0xC0) != 0x80
    in_words = _sums(character & ~IS_SPACE[part.data], part.offsets)
    symbols = _sums(_SYMBOL[part.data], part.offsets)
    rows = []
    for i in range(part.last - part.first):
        text = part.text(i)
        words = text.split()
        rows.append((len(words), in_words[i], symbols[i], repeated_lines(text), repeated_words(words)))
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    running = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=running[1:])
    return np.diff(running[offsets])


# --- n-gram features


def _features(part: Slice) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text number and table place of every n-gram, one n at a time: words, then bytes."""
    mask = np.uint64((1 << TABLE_BITS) - 1)
    words = words_of(part.data, part.offsets)
    hashes = word_hashes(part.data, words)
    owner = text_of_word(words)
    for n in WORD_GRAMS:
        inside = np.flatnonzero(whole_grams(words, n))
        grams = gram_hashes(hashes, n)[inside] if n > 1 else hashes
        yield owner[inside], (mix(grams + np.uint64(n)) & mask).astype(np.int32)
    of_byte = np.repeat(np.arange(len(part.offsets) - 1), np.diff(part.offsets))
    letters = part.data.astype(np.uint64)
    for n in LETTER_GRAMS:
        count = len(letters) - n + 1
        if count <= 0:
            continue
        total = np.full(count, n, dtype=np.uint64)
        for i in range(n):
            total += letters[i : i + count] * _FACTORS[i]
        inside = np.flatnonzero(of_byte[:count] == of_byte[n - 1 :])
        yield of_byte[inside], (total[inside] >> np.uint64(40) & mask).astype(np.int32)


def _scaled(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of the texts' feature vectors: text, place, share of its kind of n-gram; vectors have length 1."""
    n = part.last - part.first
    keys, shares = [], []
    for owner, place in _features(part):
        key, count = np.unique((owner.astype(np.int64) << TABLE_BITS) | place, return_counts=True)
        keys.append(key)
        shares.append(np.sqrt(count))
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    value = np.bincount(where, weights=np.concatenate(shares), minlength=len(key))
    owner = key >> TABLE_BITS
    length = np.sqrt(np.bincount(owner, weights=value * value, minlength=n))
    return owner, (key & (1 << TABLE_BITS) - 1).astype(np.int32), value / length[owner]


@dataclass
class Model:
    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def scores(self, part: Slice) -> np.ndarray:
        """Scores of a slice's texts; the n-grams' counts enter by their roots, so they are counted first."""
        owner, place, value = _scaled(part)
        return np.bincount(owner, weights=value * self.weights[place], minlength=part.last - part.first) + self.offset

    def probabilities(self, part: Slice) -> np.ndarray:
        return sigmoid(self.slope * self.scores(part) + self.shift)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learnt from labelled rows, ``doc_id, quality``; every fourth of the sample calibrates the probabilities.

    Ids with contradicting labels are left out. Without rows of both classes every text has probability 1.
    """
    known = labels.select(F.col("doc_id").cast("bigint"), F.col("quality").cast("int")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    picked = known.where("quality = most").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in batches:
            for part in slices(found["text"]):
                owner, place, value = _scaled(part)
                ends = pa.array(np.searchsorted(owner, np.arange(part.last - part.first + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (place, value.astype(np.float32))]
                rest = found.slice(part.first, part.last - part.first)
                yield pa.RecordBatch.from_arrays([rest["doc_id"], rest["quality"], *lists], names=["doc_id", "quality", "places", "shares"])

    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    entries = texts.select("doc_id", "text", "quality").mapInArrow(run, "doc_id bigint, quality int, places array<int>, shares array<float>")
    sample = entries.toArrow().sort_by("doc_id")
    good = np.array(sample["quality"].to_pylist(), dtype=int) == 1
    if not len(good) or good.all() or not good.any():
        return Model(np.zeros(1 << TABLE_BITS), 0.0, 0.0, 40.0)
    counts = np.array([len(x) for x in sample["places"]])
    places, shares = (sample[c].combine_chunks().flatten().to_numpy() for c in ("places", "shares"))
    owner = np.repeat(np.arange(len(good)), counts)
    held = np.arange(len(good)) % 4 == 3
    if good[held].all() or not good[held].any():
        held = np.zeros(len(good), dtype=bool)
    use = ~held[owner]
    number = np.cumsum(~held) - 1
    weights, offset = fit_logistic(number[owner[use]], places[use], shares[use], good[~held], 1 << TABLE_BITS)
    scores = np.bincount(owner, weights=shares * weights[places], minlength=len(good)) + offset
    judge = held if held.any() else ~held
    slope, shift = fit_platt(scores[judge], good[judge])
    return Model(weights, offset, slope, shift)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_quality(docs: DataFrame, labels: DataFrame, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """``doc_id``, the base counts, ``base_failed, kept, probability`` of every whole text.

    A text fails the base rules with fewer than 20 words, or with over 30 percent of its words in repeated
    windows of eight. Else it is kept if its calibrated probability of good quality reaches the threshold. The
    probability comes from hashed word and byte n-grams, learnt from ``labels`` on a sample of bounded size.

    A null or empty text has no words and fails. A null ``doc_id`` stays; rows that repeat come out as often; an
    empty table gives none. Only ``doc_id`` and ``text`` are read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    schema = pa.schema(
        [("doc_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("probability", pa.float64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in slices(rows["text"], 1 << 19):
                counts = base_counts(part)
                failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
                chance = model.value.probabilities(part)
                ids = rows["doc_id"].slice(part.first, part.last - part.first)
                yield batch(schema, [ids, *counts.T, failed, ~failed & (chance >= min_probability), chance])

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    kinds = ", ".join(f"{c} bigint" for c in _COUNTS)
    return narrow.mapInArrow(run, f"doc_id bigint, {kinds}, base_failed boolean, kept boolean, probability double")


def without_rejected(docs: DataFrame, labels: DataFrame, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """The rows whose ``doc_id`` is kept, with all their columns; rows without an id go."""
    kept = judge_quality(docs, labels, min_probability).where("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs["doc_id"] == kept["_kept_id"], "left_semi")
