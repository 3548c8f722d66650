"""Token counts of a byte-level BPE tokenizer from compiled finite-state transducers.

Two deterministic machines count the tokens of a text. The *splitter* reads characters and marks where the
pre-tokenizer starts a piece. It is run over equal chunks of the text from all of its states at once; the
chunks' state maps are then composed by a parallel prefix scan, which gives every chunk the state it really
starts in. The *counter* reads the bytes of a piece; each transition carries by how many tokens the encoding
of the piece so far grows (or shrinks, when the byte completes a longer token). It starts anew with each piece,
so all pieces of a slice go through it side by side.

The counter rests on two properties of BPE: without its last token, an encoding is that of the shorter text;
and tokens in a row are an encoding if every two neighbours are. So the last token of a prefix, and with it the
count, follow from the last tokens of shorter prefixes as far back as a token can reach. A state holds just
those: the longest suffix that some token starts with, and the last token and count at each place in it. States
are made when a text first needs them and kept in a dense table of bounded size.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.landing import batch
from lectern.llm.textbatch import SLICE_BYTES, slices

TOKEN_LIMIT = 1024
CHUNK = 256
MAX_STATES = 150_000
JUDGED = 24
LOCKSTEP_BYTES = 256

# --- the splitter
# What the byte-level pre-tokenizer's pattern counts as white space.
SPACES = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Contractions that are pieces of their own, by what follows the apostrophe.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")

# Symbols: a character and what follows it. A white-space character is "last" if another kind follows.
LETTER, NUMBER, OTHER, LAST_BLANK, LAST_SPACE, INNER_SPACE, SHORT, LONG = range(8)
SYMBOLS = 8
# States: what the piece being read is. BLANK is a single blank that joins what follows.
START, WORD, DIGITS, MARKS, BLANK, GAP, ENDED, ONE_MORE, TWO_MORE = range(9)
STATES = 9


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece starts, by state and symbol; symbols from SYMBOLS on begin a text."""
    goes = np.zeros((STATES, 2 * SYMBOLS), dtype=np.uint8)
    starts = np.ones((STATES, 2 * SYMBOLS), dtype=bool)
    plain = {LETTER: WORD, NUMBER: DIGITS, OTHER: MARKS, LAST_BLANK: BLANK, LAST_SPACE: ENDED}
    plain |= {INNER_SPACE: GAP, SHORT: ONE_MORE, LONG: TWO_MORE}
    for symbol, state in plain.items():
        goes[:, symbol] = goes[:, SYMBOLS + symbol] = state
    joins = {WORD: [LETTER], DIGITS: [NUMBER], MARKS: [OTHER, SHORT, LONG], GAP: [INNER_SPACE]}
    joins |= {BLANK: [LETTER, NUMBER, OTHER, SHORT, LONG], ONE_MORE: [LETTER], TWO_MORE: [LETTER]}
    for state, symbols in joins.items():
        starts[state, symbols] = False
    for state in (MARKS, BLANK):
        goes[state, [SHORT, LONG]] = MARKS
    goes[ONE_MORE, LETTER] = ENDED
    goes[TWO_MORE, LETTER] = ONE_MORE
    return goes.ravel(), starts.ravel()


_GOES, _STARTS = _splitter()


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """LETTER, NUMBER, OTHER, or LAST_SPACE for white space, by code point."""
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for point in range(0x110000):
        major = unicodedata.category(chr(point))[0]
        if major == "L":
            table[point] = LETTER
        elif major == "N":
            table[point] = NUMBER
    table[[ord(c) for c in SPACES]] = LAST_SPACE
    return table


def _symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """The symbol of every character; ``firsts`` are the places where texts begin."""
    symbol = _kinds()[points]
    begins = np.zeros(len(points) + 2, dtype=bool)
    begins[firsts] = True
    begins[len(points) :] = True
    one, two = ~begins[1:-1], ~begins[1:-1] & ~begins[2:]  # is there one more character, are there two?
    space = symbol == LAST_SPACE
    before_other = np.zeros(len(points), dtype=bool)
    before_other[:-1] = ~space[1:]
    last = space & one & before_other
    symbol[space & ~last] = INNER_SPACE
    symbol[last & (points == ord(" "))] = LAST_BLANK
    for i in np.flatnonzero(points == ord("'")):
        if one[i] and chr(points[i + 1]) in SHORT_ENDINGS:
            symbol[i] = SHORT
        elif two[i] and chr(points[i + 1]) + chr(points[i + 2]) in LONG_ENDINGS:
            symbol[i] = LONG
    symbol[firsts] += SYMBOLS
    return symbol


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Row i: the state after chunks 0 to i, by the state before chunk 0. Doubles the reach at every step."""
    done, reach = maps.copy(), 1
    while reach < len(done):
        done[reach:] = np.take_along_axis(done[reach:], done[:-reach].astype(np.intp), axis=1)
        reach *= 2
    return done


def piece_starts(symbols: np.ndarray) -> np.ndarray:
    """Where the pieces start."""
    chunks = -(-len(symbols) // CHUNK)
    padded = np.zeros(chunks * CHUNK, dtype=np.uint8)
    padded[: len(symbols)] = symbols
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    width = np.uint8(2 * SYMBOLS)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for column in columns:
        maps = _GOES[maps * width + column[:, None]]
    state = np.full(chunks, START, dtype=np.uint8)
    state[1:] = compose_scan(maps)[:-1, START]
    marks = np.empty((CHUNK, chunks), dtype=bool)
    for place, column in enumerate(columns):
        at = state * width + column
        marks[place] = _STARTS[at]
        state = _GOES[at]
    return np.flatnonzero(marks.T.ravel()[: len(symbols)])


# --- the counter


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible in Latin-1."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Counter:
    """The transducer over the bytes of a piece, compiled as far as it was needed."""

    SHIFT, LESS = 8, 200  # a table entry holds the next state and the growth, moved up to be positive

    def __init__(self, definition: bytes):
        described = json.loads(definition)
        model, split = described["model"], described["pre_tokenizer"]
        plain = (
            model["type"] == "BPE"
            and split["type"] == "ByteLevel"
            and split.get("use_regex", True)
            and not split["add_prefix_space"]
            and described["normalizer"] is None
            and not model.get("ignore_merges")
        )
        added = described["added_tokens"]
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("only a plain byte-level BPE tokenizer can be compiled")
        self.specials = [t["content"] for t in added]
        letters = byte_alphabet()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(raw(a), raw(b)): rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.halves = {a + b: (a, b) for a, b in self.ranks}
        if len(self.halves) < len(pairs):
            raise ValueError("a token that two merges make cannot be compiled")
        self.tokens = {bytes([b]) for b in range(256)} | set(self.halves)
        self.longer: dict[bytes, list[bytes] | None] = {}  # by prefix; None: too many to judge one by one
        for token in self.tokens:
            for n in range(1, len(token)):
                known = self.longer.setdefault(token[:n], [])
                if known is not None:
                    known.append(token)
                    if len(known) > JUDGED:
                        self.longer[token[:n]] = None
        self._after: dict[tuple, object] = {}
        self._fits: dict[tuple[bytes, bytes], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.states: list[tuple] = []
        self.numbers: dict[tuple, int] = {}
        self.table = np.full(1024 * 256, -1, dtype=np.int32)
        self._number((b"", ((0, None, 0),)))

    def _number(self, state: tuple) -> int:
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
            if len(self.states) * 256 > len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, dtype=np.int32)])
        return number

    def encode(self, piece: bytes) -> list[bytes]:
        """Plain BPE, to see whether a token is its own encoding."""
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, len(self.ranks)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """The tokens that stood at an end of ``token`` as it was merged, each with the rank that took it up."""
        edge, taken = [], float("inf")
        while True:
            edge.append((token, taken))
            if token not in self.halves:
                return edge
            a, b = self.halves[token]
            taken = self.ranks[a, b]
            token = (a, b)[side]

    def _neighbours(self, a: bytes | None, b: bytes) -> bool:
        """Can ``b`` follow ``a``, or begin a piece if that is None?

        Not if, while both were being merged, a merge across their border came first. Of equal merges the left
        one comes first.
        """
        key = (a, b)
        if key not in self._fits:
            if len(self._fits) > 4 * MAX_STATES:
                self._fits.clear()
            if a is None:
                self._fits[key] = self.encode(b) == [b]
            else:
                left, right = self._edge(a, 1), self._edge(b, 0)
                across = ((self.ranks.get((x, y)), tx, ty) for x, tx in left for y, ty in right)
                self._fits[key] = not any(r is not None and r < tx and r <= ty for r, tx, ty in across)
        return self._fits[key]

    def _open(self, last: bytes | None, begun: bytes) -> object:
        """What can follow ``last`` that begins with ``begun``: a set of tokens where they are few, else ``last``."""
        longer = self.longer.get(begun, ())
        if longer is None or not longer:
            return last if longer is None else frozenset()
        key = (last, begun)
        if key not in self._after:
            if len(self._after) > 4 * MAX_STATES:
                self._after.clear()
            self._after[key] = frozenset(t for t in longer if self._neighbours(last, t))
        return self._after[key]

    def _compile(self, number: int, byte: int) -> int:
        """The transition of a state: its suffix and, by place in it, what can go on from there and the count.

        Only places from which some token goes on beyond the suffix are kept: no other can matter any more.
        """
        suffix, places = self.states[number]
        text = suffix + bytes([byte])
        for place, follows, count in places:
            token = text[place:]
            if token in self.tokens and (
                token in follows if isinstance(follows, frozenset) else self._neighbours(follows, token)
            ):
                break
        else:
            raise AssertionError("no token fits")
        growth = count + 1
        kept = []
        for at, follows, c in places:
            begun = text[at:]
            if isinstance(follows, frozenset):
                follows = frozenset(t for t in follows if len(t) > len(begun) and t.startswith(begun))
            else:
                follows = self._open(follows, begun)
            if follows != frozenset():
                kept.append((at, follows, c - growth))
        kept.append((len(text), token, 0))
        cut = kept[0][0]
        after = tuple((at - cut, follows, c) for at, follows, c in kept)
        entry = self._number((text[cut:], after)) << self.SHIFT | growth + self.LESS
        self.table[number * 256 + byte] = entry
        return entry

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of every piece of ``data``."""
        if len(self.states) > MAX_STATES:
            self._clear()
        order = np.argsort(-lengths, kind="stable")
        begin, length = starts[order], lengths[order]
        state = np.zeros(len(order), dtype=np.int64)
        total = np.zeros(len(order), dtype=np.int64)
        active = len(order)
        for place in range(min(int(length[0]) if active else 0, LOCKSTEP_BYTES)):
            active = int(np.searchsorted(-length, -place, side="left"))
            at = state[:active] * 256 + data[begin[:active] + place]
            entry = self.table[at]
            if entry.min() < 0:
                for missing in np.unique(at[entry < 0]).tolist():
                    self._compile(*divmod(missing, 256))
                entry = self.table[at]
            state[:active] = entry >> self.SHIFT
            total[:active] += (entry & (1 << self.SHIFT) - 1) - self.LESS
        for i in np.flatnonzero(length > LOCKSTEP_BYTES).tolist():
            now, more = int(state[i]), 0
            for byte in data[begin[i] + LOCKSTEP_BYTES : begin[i] + length[i]].tolist():
                entry = int(self.table[now * 256 + byte])
                if entry < 0:
                    entry = self._compile(now, byte)
                now, more = entry >> self.SHIFT, more + (entry & (1 << self.SHIFT) - 1) - self.LESS
            total[i] += more
        result = np.empty_like(total)
        result[order] = total
        return result

    def texts(self, texts: list[str]) -> np.ndarray:
        """Tokens of every text. A special token's string stands for that token and splits the text."""
        parts: list[str] = []
        owner: list[int] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            pieces = [text]
            for special in self.specials:
                if special in text:
                    pieces = [p for piece in pieces for p in piece.split(special)]
            counts[i] = len(pieces) - 1
            full = [p for p in pieces if p]
            parts += full
            owner += [i] * len(full)
        if not parts:
            return counts
        whole = "".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        data = np.frombuffer(whole.encode(), dtype=np.uint8)
        firsts = np.cumsum([0, *map(len, parts)])[:-1]
        starts = piece_starts(_symbols(points, firsts))
        widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        byte_starts = (np.cumsum(widths) - widths)[starts]
        tokens = self.count(data, byte_starts, np.diff(np.append(byte_starts, len(data))))
        part = np.searchsorted(firsts, starts, side="right") - 1
        return counts + np.bincount(np.array(owner)[part], weights=tokens, minlength=len(texts)).astype(np.int64)


@lru_cache(maxsize=2)
def compiled(definition: bytes) -> Counter:
    """One transducer per worker process; it goes on growing from task to task."""
    return Counter(definition)


def token_counts(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text, for the tokenizer definition at ``path``.

    The definition is read here and sent along: executors need no file. No begin, end or other tokens are
    added. A null or empty text has 0 bytes and tokens. Rows that repeat come out as often; a null ``doc_id``
    stays; an empty table gives none. Only ``doc_id`` and ``text`` are read.
    """
    definition = docs.sparkSession.sparkContext.broadcast(Path(path).read_bytes())
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = compiled(definition.value)
        for rows in batches:
            n_bytes, n_tokens = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for part in slices(rows["text"], SLICE_BYTES // 2):
                n_bytes.append(np.diff(part.offsets))
                n_tokens.append(counter.texts([part.text(i).decode() for i in range(part.last - part.first)]))
            tokens = np.concatenate(n_tokens)
            yield batch(schema, [rows["doc_id"], np.concatenate(n_bytes), tokens, tokens > limit])

    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
