"""Training texts that hold benchmark items: rare n-gram seeds, then Smith-Waterman alignment of words.

Seeds are pairs of words that stand next to each other or have one word between them, in the item or in the text.
Between two matches that follow each other an alignment loses as many points as words lie between them, in the item
or in the text, whichever has more; a match gains two. So only such pairs raise its score, and it must hold a number
of them that its least score gives. Of an item's words fewer than that number are no seeds, those of the most
frequent pairs: no alignment can do with these alone, so none is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from lectern.llm.landing import batch
from lectern.llm.textbatch import BASES, LOWER, Words, mix, signed, slices, whole_grams, word_hashes, words_of

# How far apart the words of a seed may stand.
GAPS = (1, 2)
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SCORE = 0.4
# Of a longer item this many words are enough: a passage of it counts, not only the whole.
FULL_WORDS = 50
# Less than so many words in a row, or the whole of a shorter item, is never enough.
LEAST_WORDS = 3
# Items are sent to the executors in blocks of about so many words.
BLOCK_WORDS = 2_000_000

HITS = "array<struct<item_id:bigint,score:double,first_word:bigint,last_word:bigint>>"

_HITS = pa.list_(
    pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
)

_PLAIN = LOWER.copy()
_PLAIN[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = ord(" ")


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words in lower case, without ASCII punctuation, and their hashes."""
    plain = _PLAIN[data]
    words = words_of(plain, offsets)
    return words, word_hashes(plain, words)


# --- seeds


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of two words in their order, whatever lies between them."""
    return mix(first * np.uint64(BASES[0]) + second * np.uint64(BASES[1]))


def least_score(n_words: int, min_score: float) -> float:
    full = MATCH * min(n_words, FULL_WORDS)
    return max(min_score * full, min(full, MATCH * LEAST_WORDS))


@dataclass
class Items:
    """A block of benchmark items and the seeds that lead to them."""

    ids: list[int | None]
    words: list[np.ndarray]
    seeds: np.ndarray  # sorted
    bounds: np.ndarray  # seed i leads to the entries [bounds[i], bounds[i + 1])
    item: np.ndarray
    place: np.ndarray
    sieve: np.ndarray  # by the low bits of a hash: can it be a seed?
    least: np.ndarray  # the score from which on an item is found
    need: np.ndarray  # seeds that an alignment of this score holds
    has_single: bool  # is an item one word?

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the grams that are seeds, and which seed each is."""
        maybe = np.flatnonzero(self.sieve[(grams & np.uint64(len(self.sieve) - 1)).astype(np.intp)])
        at = np.searchsorted(self.seeds, grams[maybe])
        found = self.seeds[np.minimum(at, len(self.seeds) - 1)] == grams[maybe]
        return maybe[found], at[found]


def make_items(ids: list[int | None], texts: list[str | None], frequency: dict[int, float], min_score: float = MIN_SCORE) -> Items:
    """``frequency`` has each word hash's share of the corpus' words."""
    entries: list[tuple[int, int, int]] = []
    words: list[np.ndarray] = []
    least, need = np.zeros(len(ids)), np.ones(len(ids), dtype=np.int64)
    for number, text in enumerate(texts):
        data = np.frombuffer((text or "").encode(), dtype=np.uint8)
        _, hashes = _words(data, np.array([0, len(data)]))
        words.append(hashes)
        n = len(hashes)
        if not n:
            continue
        least[number] = least_score(n, min_score)
        if n == 1:
            entries.append((int(pair_hashes(hashes, np.zeros(1, dtype=np.uint64))[0]), number, 0))
            continue
        share = np.array([frequency.get(h, 0.0) for h in hashes.tolist()])
        odds = np.zeros(n - 1)
        for gap in GAPS:
            odds[: n - gap] = np.maximum(odds[: n - gap], share[: n - gap] * share[gap:])
        pairs = max(1, int(np.ceil((least[number] - MATCH) / MATCH)))
        need[number] = pairs - (pairs - 1) // 2
        frequent = set(np.argsort(-odds, kind="stable")[: pairs - need[number]].tolist())
        for gap in GAPS:
            grams = pair_hashes(hashes[: n - gap], hashes[gap:]) if n > gap else []
            entries += [(int(g), number, i) for i, g in enumerate(grams) if i not in frequent]
    entries.sort()
    all_seeds = np.array([e[0] for e in entries], dtype=np.uint64)
    seeds, firsts = np.unique(all_seeds, return_index=True)
    sieve = np.zeros(1 << max(16, (8 * len(seeds)).bit_length()), dtype=bool)
    sieve[(seeds & np.uint64(len(sieve) - 1)).astype(np.intp)] = True
    item, place = (np.array([e[i] for e in entries], dtype=np.int64) for i in (1, 2))
    single = any(len(w) == 1 for w in words)
    return Items(ids, words, seeds, np.append(firsts, len(entries)), item, place, sieve, least, need, single)


def seed_hits(words: Words, hashes: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Places in the text where a seed begins, and the entry of the item that it leads to."""
    places, seeds = [], []
    for gap in (*GAPS, 0) if items.has_single else GAPS:
        if len(hashes) <= gap:
            continue
        grams = pair_hashes(hashes[: len(hashes) - gap], hashes[gap:] if gap else np.zeros_like(hashes))
        at, seed = items.find(grams)
        inside = whole_grams(words, gap + 1)[at]
        places.append(at[inside])
        seeds.append(seed[inside])
    if not places:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    place, seed = np.concatenate(places), np.concatenate(seeds)
    fan = items.bounds[seed + 1] - items.bounds[seed]
    entry = np.repeat(items.bounds[seed] - np.cumsum(fan) + fan, fan) + np.arange(fan.sum())
    return np.repeat(place, fan), entry


def _dense(pair: np.ndarray, place: np.ndarray, need: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Of hits in order, those of pairs that have as many different places as they need within their span."""
    fresh = np.ones(len(pair), dtype=bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (place[1:] != place[:-1])
    some = np.flatnonzero(fresh)
    last = np.arange(len(some)) + need[some] - 1
    known = last < len(some)
    a, b = some[known], some[last[known]]
    enough = (pair[a] == pair[b]) & (place[b] - place[a] <= span[a])
    return np.isin(pair, pair[a[enough]])


# --- alignment


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman over words: the best local score, and the first and last word of the passage in it.

    A row per item word; a gap along the row is a running maximum. Equal scores keep the earlier end.
    """
    steps = np.arange(len(passage) + 1)
    score, start = np.zeros(len(passage) + 1, dtype=np.int64), steps.copy()
    best, first, last = 0, 0, 0
    for word in item:
        slant = np.where(passage == word, MATCH, MISMATCH) + score[:-1]
        above = score + GAP
        row, origin = above, start
        better = slant > above[1:]
        row[1:] = np.where(better, slant, above[1:])
        origin = origin.copy()
        origin[1:] = np.where(better, start[:-1], start[1:])
        fresh = row <= 0
        row[fresh] = 0
        origin[fresh] = steps[fresh]
        lifted = row - GAP * steps
        peak = np.maximum.accumulate(lifted)
        holder = np.maximum.accumulate(np.where(lifted == peak, steps, 0))
        row, origin = peak + GAP * steps, origin[holder]
        at = int(row.argmax())
        if row[at] > best:
            best, first, last = int(row[at]), int(origin[at]), at - 1
        score, start = row, origin
    return best, first, last


def _passages(low: np.ndarray, high: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping ranges merged."""
    order = np.argsort(low, kind="stable")
    merged: list[list[int]] = []
    for a, b in zip(low[order].tolist(), high[order].tolist(), strict=True):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def find_items(column: pa.Array, items: Items) -> list[list[dict]]:
    """Per text the items it holds, with score and word range of the best passage."""
    result: list[list[dict]] = []
    lengths = np.array([len(w) for w in items.words], dtype=np.int64)
    for part in slices(column):
        n = part.last - part.first
        hits: list[list[dict]] = [[] for _ in range(n)]
        words, hashes = _words(part.data, part.offsets)
        if len(items.seeds) and len(hashes):
            place, entry = seed_hits(words, hashes, items)
            item = items.item[entry]
            text = np.searchsorted(words.bounds, place, side="right") - 1
            pair = text * len(items.ids) + item
            order = np.lexsort((place, pair))
            # An alignment has fewer words that do not match than two for each that does.
            order = order[_dense(pair[order], place[order], items.need[item[order]], 3 * lengths[item[order]])]
            begin = place - items.place[entry]
            slack = MATCH + (12 * np.minimum(lengths, FULL_WORDS)[item]) // 10
            low = np.maximum(begin - slack, words.bounds[text])
            high = np.minimum(begin + lengths[item] + slack, words.bounds[text + 1])
            cuts = np.flatnonzero(np.diff(pair[order])) + 1
            for group in np.split(order, cuts) if len(order) else []:
                t, i = divmod(int(pair[group[0]]), len(items.ids))
                wanted, least = items.words[i], items.least[i]
                best = (0, 0, 0)
                for a, b in _passages(low[group], high[group]):
                    if len(np.unique(place[group][(place[group] >= a) & (place[group] < b)])) < items.need[i]:
                        continue
                    passage = hashes[a:b]
                    if MATCH * int(np.isin(wanted, passage).sum()) < least:
                        continue  # no alignment can score higher than its matches
                    score, first, last = align(wanted, passage)
                    if score > best[0]:
                        best = (score, a + first, a + last)
                if best[0] >= least:
                    start = int(words.bounds[t])
                    share = min(1.0, best[0] / (MATCH * min(len(wanted), FULL_WORDS)))
                    hits[t].append({"item_id": items.ids[i], "score": share, "first_word": best[1] - start, "last_word": best[2] - start})
        result += hits
    return result


# --- corpus


def word_shares(docs: DataFrame, wanted: np.ndarray) -> dict[int, float]:
    """Each wanted word's share of all words of the corpus. ``wanted`` is sorted and bounded by a block."""
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = np.zeros(len(wanted), dtype=np.int64), 0
        for rows in batches:
            for part in slices(rows["text"]):
                _, hashes = _words(part.data, part.offsets)
                at = np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)
                counts += np.bincount(at[wanted[at] == hashes], minlength=len(wanted))
                total += len(hashes)
        some = np.flatnonzero(counts)
        yield batch(schema, [signed(wanted[some]), counts[some]])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total])], schema=schema)

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n"))
    found = {word: n for word, n in counted.collect()}
    total = max(found.pop(None, 0), 1)
    return {word % (1 << 64): n / total for word, n in found.items()}


def item_blocks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, each with the seeds that are rare in ``docs``."""
    items = benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (5 * block_words)))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for number in range(blocks):
        rows = items.where(place == number).distinct().orderBy("item_id", "text").collect()
        texts = [r["text"] or "" for r in rows]
        data = np.frombuffer("\n".join(texts).encode(), dtype=np.uint8)
        _, hashes = _words(data, np.array([0, len(data)]))
        if len(hashes):
            yield make_items([r["item_id"] for r in rows], texts, word_shares(docs, np.unique(hashes)), min_score)


def item_finders(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, block_words: int = BLOCK_WORDS) -> Iterator[Callable]:
    """Column functions, one per block, from a text to the items it holds."""
    for items in item_blocks(docs, benchmark, min_score, block_words):
        yield _finder(docs.sparkSession.sparkContext.broadcast(items))


def _finder(sent: Broadcast) -> Callable:
    def find(column: pa.Array) -> pa.Array:
        return pa.array(find_items(column, sent.value), type=_HITS)

    return F.arrow_udf(find, HITS)


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word`` for every document and each item it holds.

    A document is compared with an item if it holds enough of the item's seeds near each other: pairs of words next
    to each other or with one word between, without those of the words that the corpus' frequencies make most
    likely. Around the seeds the passage is aligned with the item (Smith-Waterman over words in lower case, without
    punctuation); the score is the alignment's share of what the whole item, or 50 words of a longer one, would
    give. From ``min_score`` on, and three words in a row at least or what equals them, the document holds the item;
    a shorter item is held only whole. Seeds lose none of these.

    Null and empty texts hold nothing, and an item without a word is in no text. Equal items count
    once; rows that repeat come out as often; a null ``doc_id`` or ``item_id`` stays. Only ``doc_id, text`` and
    ``item_id, text`` are read. Without documents or items nothing comes out. Nothing is shuffled but the word
    counts; the benchmark goes to the executors in blocks of bounded size.
    """
    found = None
    for find in item_finders(docs, benchmark, min_score):
        hits = docs.select(F.col("doc_id").cast("bigint"), F.explode(find(F.col("text").cast("string"))).alias("hit"))
        one = hits.select("doc_id", "hit.*")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint")
    return found


def without_contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows whose text holds no item of the benchmark, with all their columns."""
    clean = docs
    for find in item_finders(docs, benchmark, min_score):
        clean = clean.where(F.size(find(F.col("text").cast("string"))) == 0)
    return clean
