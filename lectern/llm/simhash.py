"""Near duplicates by SimHash fingerprints, found at the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lectern.llm.components import connected_components
from lectern.llm.landing import batch, columns_of, landed, whole_row
from lectern.llm.textbatch import LOWER, slices

SHINGLE_WORDS = 4
MAX_BITS = 4
HASH_SEED = 42

# The 64 bits lie in three blocks. Of at most 4 differing bits, some block has at most 1.
BLOCKS = ((0, 21), (21, 21), (42, 22))
BLOCK_BITS = MAX_BITS // len(BLOCKS)
CODE_BITS = 15
# Buckets up to this size are compared all at once, shifted against themselves; larger ones by search.
SMALL_BUCKET = 96
ROWS_AT_ONCE = 200_000

_FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


# --- fingerprints


def shingle_hashes(text: bytes, n: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every n-word shingle of a text that is in lower case already."""
    words = text.split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, take, seed = b" ".join(words), xxhash.xxh64_intdigest, HASH_SEED
    if len(words) <= n:
        return np.array([take(joined, seed)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(words) - n + 1].tolist()
    stops = (ends - 1)[n - 1 :].tolist()
    return np.array([take(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)], dtype=np.uint64)


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text, the bits that are set in over half of its hashes; zero without hashes."""
    result = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        firsts = (np.cumsum(counts) - counts)[full]
        ones = np.add.reduceat(bits, firsts, axis=0, dtype=np.int32)
        set_bits = 2 * ones > counts[full][:, None]
        result[full] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return result


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fingerprint`` (bigint of the 64 bits) of every whole text; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [np.zeros(0, dtype=np.uint64)]
            for part in slices(rows["text"]):
                low = LOWER[part.data].tobytes()
                hashes = [
                    shingle_hashes(low[a:b], shingle_words)
                    for a, b in zip(part.offsets[:-1].tolist(), part.offsets[1:].tolist(), strict=True)
                ]
                counts = np.array([len(h) for h in hashes])
                found.append(majority_bits(np.concatenate(hashes), counts))
            yield batch(_FINGERPRINTS, [rows["doc_id"], pa.array(np.concatenate(found).view(np.int64))])

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id bigint, fingerprint bigint")


# --- anchors


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """For every 15-bit value, its nearest codeword and all codewords within 2, of the perfect Hamming code.

    The syndrome of a value, the exclusive or of the places of its bits, is the place to flip for the codeword.
    A value off the code has that one at distance 1 and seven at distance 2; a codeword has itself alone. Those
    rows are filled up with the codeword again.
    """
    values = np.arange(1 << CODE_BITS)
    syndrome = np.zeros_like(values)
    for place in range(1, CODE_BITS + 1):
        syndrome ^= np.where(values >> (place - 1) & 1, place, 0)
    flip = np.concatenate([[0], 1 << np.arange(CODE_BITS)])
    home = values ^ flip[syndrome]
    near = np.repeat(home[:, None], 8, axis=1)
    filled = np.ones(len(values), dtype=int)
    for place in range(1, CODE_BITS + 1):
        other = syndrome ^ place
        rows = np.flatnonzero((syndrome > 0) & (other > place))
        near[rows, filled[rows]] = values[rows] ^ flip[place] ^ flip[other[rows]]
        filled[rows] += 1
    return home, near


_HOME, _NEAR = _code_tables()


def anchors(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``key, index``: every anchor within covering radius plus threshold of each fingerprint, in every block.

    A block's anchors are the codewords of its low 15 bits with any other bits: the covering radius is 1. A pair
    that differs in one bit of the block meets at the home anchor of either: that one is at distance 2 at most
    from the other, and where its free bits differ by one, it is the home of the other's low bits as well.
    """
    keys, rows = [], []
    index = np.arange(len(values))
    for number, (shift, width) in enumerate(BLOCKS):
        block = (values >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
        low, free = block & ((1 << CODE_BITS) - 1), block >> CODE_BITS << CODE_BITS
        tag = number << max(w for _, w in BLOCKS)
        near = _NEAR[low] | free[:, None] | tag
        fresh = np.ones(near.shape, dtype=bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :1]
        keys.append(near[fresh])
        rows.append(np.repeat(index, fresh.sum(axis=1)))
        for bit in range(CODE_BITS, width):
            keys.append(_HOME[low] | free ^ (1 << bit) | tag)
            rows.append(index)
    return np.concatenate(keys), np.concatenate(rows)


def _at_anchors(distinct: DataFrame) -> DataFrame:
    schema = pa.schema([("anchor", pa.int64()), ("fingerprint", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            values = rows["fingerprint"].to_numpy(zero_copy_only=False)
            keys, index = anchors(values.view(np.uint64))
            yield batch(schema, [keys, values[index]])

    return distinct.select("fingerprint").mapInArrow(run, "anchor bigint, fingerprint bigint")


# --- comparison at an anchor


def _smallest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _small_buckets(keys: np.ndarray, values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    left, right = [], []
    for lag in range(1, SMALL_BUCKET):
        same = np.flatnonzero(keys[lag:] == keys[:-lag])
        if not len(same):
            break
        close = same[np.bitwise_count(values[same] ^ values[same + lag]) <= max_bits]
        left.append(close)
        right.append(close + lag)
    if not left:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    label = _smallest_reachable(len(values), np.concatenate(left), np.concatenate(right))
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def _large_bucket(values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Search from every value not reached so far, against those not reached so far: copies leave at once."""
    left = np.arange(len(values))
    members, roots = [], []
    while len(left):
        root, left = left[0], left[1:]
        frontier = [root]
        while frontier and len(left):
            close = np.bitwise_count(values[left] ^ values[frontier.pop()]) <= max_bits
            if close.any():
                reached = left[close]
                left = left[~close]
                members.append(reached)
                roots.append(np.full(len(reached), root))
                frontier.extend(reached.tolist())
    return (np.concatenate(members), np.concatenate(roots)) if members else (left, left)


def bucket_links(keys: np.ndarray, values: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, of whole buckets in the order of their keys, that join every bucket's close fingerprints.

    Each fingerprint gets one link at most, to another of its group; not every pair is given.
    """
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    large = sizes > SMALL_BUCKET
    small = np.flatnonzero(np.repeat(~large & (sizes > 1), sizes))
    a, b = _small_buckets(keys[small], values[small], max_bits)
    left, right = [values[small[a]]], [values[small[b]]]
    for start, size in zip(starts[large], sizes[large], strict=True):
        a, b = _large_bucket(values[start : start + size], max_bits)
        left.append(values[start + a])
        right.append(values[start + b])
    return np.concatenate(left), np.concatenate(right)


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: links between the given distinct fingerprints, in whose closure are all pairs within ``max_bits``."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the blocks are made for 0 to {MAX_BITS} bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

        def links(upto: int) -> pa.RecordBatch:
            a, b = bucket_links(keys[:upto], values[:upto], max_bits)
            pairs = np.unique(np.stack([a, b], axis=1), axis=0)
            return batch(_LINKS, [np.ascontiguousarray(pairs[:, i]).view(np.int64) for i in (0, 1)])

        for rows in batches:
            keys = np.concatenate([keys, rows["anchor"].to_numpy(zero_copy_only=False)])
            values = np.concatenate([values, rows["fingerprint"].to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(keys) >= ROWS_AT_ONCE:
                last = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
                if last:
                    yield links(last)
                    keys, values = keys[last:], values[last:]
        if len(keys):
            yield links(len(keys))

    at_anchors = _at_anchors(distinct).repartition("anchor").sortWithinPartitions("anchor")
    return at_anchors.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` is 16 hexadecimal digits. Documents whose fingerprints differ in at most ``max_bits`` bits
    are linked; ``component_id`` is the smallest ``doc_id`` that can be reached over links. Equal fingerprints
    are brought together first, so copies cost nothing in the comparison, and links are between fingerprints.

    Null and empty texts have fingerprint zero and are linked like any other. A row without ``doc_id`` counts
    in its component but lends it no id, so a component of such rows alone has a null id. Rows that repeat come
    out as often. An empty table gives none. Columns other than ``doc_id`` and ``text`` are not read.
    """
    prints = landed(fingerprints(docs, shingle_words), "fingerprints")
    distinct = landed(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = connected_components(fingerprint_links(distinct, max_bits), "a", "b")
    rooted = distinct.join(roots, distinct.fingerprint == roots.node, "left").select(
        "fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root")
    )
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = landed(rooted.join(lowest, "root").select("fingerprint", "component_id"), "groups")
    shown = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return prints.join(groups, "fingerprint").select("doc_id", shown, "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that keep their id in :func:`near_duplicates`: one document of every group stays.

    Rows without ``doc_id`` cannot be told apart, so they all stay. Rows that repeat an id stay together. All
    columns are kept, whatever their names. Null, empty and long texts are as there; an empty table gives none.
    """
    groups = near_duplicates(docs, shingle_words, max_bits)
    kept = groups.where("doc_id IS NULL OR doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    rows = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("bigint").alias("own_id"))
    return rows.join(kept, F.col("own_id").eqNullSafe(F.col("id")), "left_semi").select(*columns_of("row", docs))
