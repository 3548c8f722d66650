"""Passages that an earlier document holds already: windows of words, found by Rabin-Karp hashes.

Most windows occur once, and to shuffle a hash for every word of a corpus to learn that would be the whole
cost. So windows are first represented by the smallest hash among the short grams inside them, which equal
windows share and some seventeen neighbouring windows have in common. Only windows whose representative occurs
in more than one document are hashed and counted. That leaves out no window that repeats. A document whose words
are all those of an earlier one loses them all, so its windows need not be looked at: each of them also starts
in that earlier one, which stands for both wherever a third document is judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.landing import batch, landed
from lectern.llm.textbatch import (
    BASES,
    Words,
    gram_hashes,
    run_hashes,
    signed,
    slices,
    text_of_word,
    whole_grams,
    word_hashes,
    words_of,
)

WINDOW_WORDS = 50
GRAM_WORDS = 16
LAST_ID = 2**63 - 1
KEY = ["order_id", "text_key"]
EVERYWHERE = -1


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every ``width`` values in a row."""
    low, reach = values, 1
    while 2 * reach <= width:
        low = np.minimum(low[: len(low) - reach], low[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _representatives(words: Words, hashes: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Where whole windows start, and the smallest gram hash of each of those windows."""
    starts = np.flatnonzero(whole_grams(words, window))
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    return starts, sliding_minima(gram_hashes(hashes, gram), window - gram + 1)[starts]


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    ends = np.searchsorted(owner, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), signed(values))


def _seeds(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Every document's representatives, its number of words and a 128-bit hash of all of them."""
    kinds = {"order_id": "bigint", "text_key": "bigint", "n_words": "bigint", "w1": "bigint", "w2": "bigint"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in slices(rows["text"]):
                words = words_of(part.data, part.offsets)
                both = [word_hashes(part.data, words, b) for b in BASES]
                starts, low = _representatives(words, both[0], window, gram)
                owner = text_of_word(words)[starts]
                new = np.ones(len(low), dtype=bool)
                new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
                keys = rows.slice(part.first, part.last - part.first)
                whole = [signed(run_hashes(h, words.bounds, b)) for h, b in zip(both, BASES, strict=True)]
                seeds = _lists(low[new], owner[new], len(keys))
                columns = [keys[0], keys[1], pa.array(words.counts), *whole, seeds]
                yield pa.RecordBatch.from_arrays(columns, [*kinds, "seeds"])

    schema = ", ".join(f"{name} {kind}" for name, kind in kinds.items())
    return docs.select(*KEY, "text").mapInArrow(run, f"{schema}, seeds array<bigint>")


def _windows(marked: DataFrame, window: int, gram: int) -> DataFrame:
    """128-bit hashes of the windows whose representative is among the ``seeds`` that other documents share."""
    schema = pa.schema([(c, pa.int64()) for c in KEY] + [("place", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            seeds = rows["seeds"]
            for part in slices(rows["text"]):
                words = words_of(part.data, part.offsets)
                both = [word_hashes(part.data, words, b) for b in BASES]
                starts, low = _representatives(words, both[0], window, gram)
                shared = seeds.slice(part.first, part.last - part.first).flatten().to_numpy(zero_copy_only=False)
                starts = starts[np.isin(low, shared.view(np.uint64))]
                if not len(starts):
                    continue
                owner = text_of_word(words)[starts]
                h1, h2 = (gram_hashes(h, window, b)[starts] for h, b in zip(both, BASES, strict=True))
                ids = [rows[c].to_numpy(zero_copy_only=False)[part.first + owner] for c in KEY]
                yield batch(schema, [*ids, (starts - words.bounds[owner]).astype(np.int32), signed(h1), signed(h2)])

    columns = "order_id bigint, text_key bigint, place int, h1 bigint, h2 bigint"
    return marked.select(*KEY, "text", "seeds").mapInArrow(run, columns)


def covered(places: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Which words lie in a window that starts at one of the places: overlapping windows make one interval."""
    change = np.zeros(n_words + 1, dtype=np.int32)
    at = np.unique(places)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return np.cumsum(change)[:-1] > 0


def _without(docs: DataFrame, window: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            places = rows["places"]
            for part in slices(rows["text"]):
                counts, removed, texts = [], [], []
                for i in range(part.last - part.first):
                    words = part.text(i).split()
                    counts.append(len(words))
                    own = places[part.first + i]
                    if own.is_valid:
                        found = own.values.to_numpy()
                        gone = covered(found, len(words), window) if found[0] != EVERYWHERE else np.ones(len(words), bool)
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    removed.append(counts[-1] - len(words))
                    texts.append(b" ".join(words).decode())
                yield batch(schema, [rows["doc_id"].slice(part.first, len(counts)), counts, removed, texts])

    return docs.select("doc_id", "text", "places").mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, text string")


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS, gram: int = GRAM_WORDS) -> DataFrame:
    """``doc_id, n_words, n_removed, text``: the words left of every text, joined by one space.

    A word goes if a window of ``window`` words that covers it, within one document, also starts in a document
    with a smaller ``doc_id``. Windows are judged on the input. Repeats inside one document stay, as do windows
    that only rows of the same ``doc_id`` share; such rows are judged one by one. A row without ``doc_id``
    comes after all others. Null and empty texts, and texts shorter than a window, lose nothing. Columns other
    than ``doc_id`` and ``text`` are not read. An empty table gives none.
    """
    keyed = docs.select(
        F.col("doc_id").cast("bigint"),
        F.col("text").cast("string"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("order_id"),
        F.xxhash64("text").alias("text_key"),
    )
    seeds = landed(_seeds(keyed, window, gram), "seeds")
    copied = seeds.where(f"n_words >= {int(window)}").groupBy("n_words", "w1", "w2")
    copied = copied.agg(F.min("order_id").alias("first"), F.max("order_id").alias("last")).where("first < last")
    judged = seeds.join(landed(copied.drop("last"), "copied"), ["n_words", "w1", "w2"], "left")
    judged = landed(judged.select(*KEY, "seeds", F.coalesce(F.col("order_id") > F.col("first"), F.lit(False)).alias("copy")), "judged")

    seeds = judged.where("NOT copy").select(*KEY, F.explode("seeds").alias("seed"))
    spread = seeds.groupBy("seed").agg(F.min("order_id").alias("first"), F.max("order_id").alias("last"))
    shared = landed(spread.where("first < last").select("seed"), "shared")
    marks = seeds.join(shared, "seed").groupBy(*KEY).agg(F.collect_set("seed").alias("seeds"))
    windows = landed(_windows(keyed.join(marks, KEY), window, gram), "windows")
    firsts = windows.groupBy("h1", "h2").agg(F.min("order_id").alias("first"), F.max("order_id").alias("last"))
    firsts = landed(firsts.where("first < last").select("h1", "h2", "first"), "firsts")
    later = windows.join(firsts, ["h1", "h2"]).where("order_id > first")
    places = later.groupBy(*KEY).agg(F.collect_set("place").alias("places"))
    copies = judged.where("copy").select(*KEY).distinct().withColumn("places", F.array(F.lit(EVERYWHERE)))
    return _without(keyed.join(landed(places.unionByName(copies), "places"), KEY, "left"), window)
