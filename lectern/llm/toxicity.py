"""Toxicity by a support vector machine over gapped subsequences, with Nyström landmarks.

A word is compared with a landmark by a subsequence string kernel: three letters in order count for both as
often as they occur, each occurrence weighted down by the letters it skips. So ``i.d.i.o.t`` and ``idiiot`` are
still close to ``idiot``. The kernel has an explicit, if large, feature space, so what the machine has learnt at
its landmarks folds into one weight per subsequence, and a whole text is scored in a fixed number of array
steps. A text counts as its worst word; it is learnt which words those are, as labels are given for texts only.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from lectern.llm.textbatch import slices

THRESHOLD = 0.7
# At most so many labelled rows of each class are learnt from, those with the smallest hashes of their ids.
TRAIN_ROWS = 2000
DECAY = 0.5
MAX_SKIP = 2
LANDMARKS = 400
ROUNDS = 4
HARMLESS = 6000
PENALTY = 1e-5
# The search for insults begins with words that would be in toxic texts alone by chance with this probability.
CHANCE = 0.05
# A clean text may hold what so many toxic ones hold: its label may be wrong.
NOISE = 20
SEED = 7

# Letters a to z are 1 to 26; EDGE stands before and after a word; letters of other scripts are hashed into the codes from
# FOREIGN on, and those that look like one of a to z are read as it; what is no letter is left out.
EDGE = 27
FOREIGN = 28
LETTERS = 64
_ALIKE = dict(zip("аеосрухіјѕԁһвкмнтԛԝαειοκνρτυχ", "aeocpyxijsdhbkmhtqwaeiokvptux"))
# Digits between two letters are read as the letters they look like.
_DIGITS = dict(zip("013457", "oieast"))
# A word's foreign letters are written by code, each as one character of its own.
_SHOWN = 0xE000
# In scripts without blanks every three characters in a row are a word, and each of them two foreign letters.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")
_WINDOW = 3
# Subsequences of the codes below FOREIGN are numbered first, then those with a foreign letter.
LATIN = FOREIGN**3
FEATURES = LATIN + LETTERS**3
_SKIPS = [(a, b) for a in range(1, MAX_SKIP + 2) for b in range(1, MAX_SKIP + 2)]


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Letter code by code point: case and accents are dropped; 255 marks white space."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for point in range(0x250):
        base = unicodedata.normalize("NFD", chr(point).lower())[0]
        if "a" <= base <= "z":
            table[point] = ord(base) - 96
    for point in range(0x250, 0x20000):
        char = chr(point)
        if _UNSPACED.match(char):
            continue  # written as two letters before they are looked up
        category = unicodedata.category(char)
        # Signs of vowels are letters where they stand for sounds as such; elsewhere marks are left out.
        if category[0] != "L" and category not in ("Mc", "So") and not (category == "Mn" and 0x900 <= point <= 0xFFF):
            continue
        base = char if 0xAC00 <= point <= 0xD7A3 else unicodedata.normalize("NFKD", char.lower())[0].lower()
        base = _ALIKE.get(base, base)
        if "a" <= base <= "z":
            table[point] = ord(base) - 96
        elif unicodedata.category(base)[0] in "LM":
            table[point] = FOREIGN + zlib.crc32(base.encode()) % (LETTERS - FOREIGN)
    table[_SHOWN : _SHOWN + LETTERS - FOREIGN] = np.arange(FOREIGN, LETTERS)
    table[[ord(c) for c in "\u3000、。，！？；："]] = 255
    table[[ord(c) for c in " \t\n\v\f\r"]] = 255
    return table


class _Pairs(dict):
    """Two foreign letters for a character, by its hash."""

    def __missing__(self, point: int) -> str:
        first, second = divmod(zlib.crc32(chr(point).encode()) % (LETTERS - FOREIGN) ** 2, LETTERS - FOREIGN)
        self[point] = chr(_SHOWN + first) + chr(_SHOWN + second)
        return self[point]


_PAIRS = _Pairs()


def _spaced(text: str) -> str:
    """The text with its runs of unspaced characters written as words that overlap."""
    if text.isascii() or not _UNSPACED.search(text):
        return text

    def words(run: re.Match) -> str:
        pairs = run[0].translate(_PAIRS)
        return " " + " ".join(pairs[i : i + 2 * _WINDOW] for i in range(0, max(len(pairs) - 2 * _WINDOW, 0) + 1, 2)) + " "

    return _UNSPACED.sub(words, text)


@lru_cache(maxsize=1)
def _digit_codes() -> np.ndarray:
    return np.array([ord(_DIGITS[d]) - 96 if d in _DIGITS else 0 for d in "0123456789"], dtype=np.uint8)


@dataclass
class Letters:
    """The letters of some texts: words stand between EDGE codes, and each text between two of those."""

    codes: np.ndarray
    firsts: np.ndarray  # where each text starts; its first code is an EDGE

    @property
    def edges(self) -> np.ndarray:
        return self.codes == EDGE


def letters_of(texts: list[str]) -> Letters:
    """Case, accents and marks are left out, and digits but for those inside words; single letters apart, as in ``i d i o t``, are read as one word."""
    texts = [_spaced(t) for t in texts]
    joined = "\n" + "".join(t + "\n" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    codes = _codes()[points]
    letter = (codes > 0) & (codes != 255)
    inside = np.flatnonzero((points[1:-1] >= 48) & (points[1:-1] <= 57) & letter[:-2] & letter[2:]) + 1
    codes[inside] = _digit_codes()[points[inside] - 48]
    edge = codes == 255
    codes[edge] = EDGE
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    edge[firsts] = True
    if len(codes) > 4:
        alone = np.zeros(len(codes), dtype=bool)
        alone[1:-1] = edge[:-2] & ~edge[1:-1] & edge[2:]
        between = np.zeros(len(codes), dtype=bool)
        between[1:-1] = edge[1:-1] & alone[:-2] & alone[2:]
        between[firsts] = False
        codes[between] = 0
    kept = codes > 0
    return Letters(codes[kept], (np.cumsum(kept) - 1)[firsts])


def subsequences(letters: Letters) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of skips: where a subsequence of three codes inside a word begins, which it is, its weight."""
    codes, edges = letters.codes.astype(np.int32), letters.edges
    foreign = bool((codes >= FOREIGN).any())
    places = np.arange(len(codes))
    ahead = np.where(edges, places, len(codes))
    after = np.full(len(codes), len(codes))
    after[:-1] = np.minimum.accumulate(ahead[::-1])[::-1][1:]  # the next edge after each place
    for a, b in _SKIPS:
        reach = a + b
        n = len(codes) - reach
        if n <= 0:
            continue
        begin = np.flatnonzero(after[:n] >= places[:n] + reach)
        one, two, three = codes[begin], codes[begin + a], codes[begin + reach]
        which = (one * FOREIGN + two) * FOREIGN + three
        if foreign:
            other = np.maximum(np.maximum(one, two), three) >= FOREIGN
            which = np.where(other, LATIN + (one * LETTERS + two) * LETTERS + three, which)
        yield begin, which, DECAY ** (reach - 2)


def word_scores(letters: Letters, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word's edge stands, and the word's score: its subsequences' weights over the root of its length."""
    total = np.zeros(len(letters.codes))
    for begin, which, weight in subsequences(letters):
        total[begin] += weights[which] * weight
    starts = np.flatnonzero(letters.edges)[:-1]
    sizes = np.diff(np.flatnonzero(letters.edges))
    return starts, np.add.reduceat(total, starts) / np.sqrt(sizes) if len(starts) else total[:0]


def text_scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """The score of each text's worst word; 0 at least, which is that of no word."""
    if not texts:
        return np.zeros(0)
    letters = letters_of(texts)
    starts, scores = word_scores(letters, weights)
    result = np.zeros(len(texts))
    text = np.searchsorted(letters.firsts, starts, side="right") - 1
    np.maximum.at(result, text, scores)
    return result


# --- learning


def word_list(texts: list[str]) -> list[list[str]]:
    """The distinct words of each text, as the kernel reads them."""
    names = np.array(["", *map(chr, range(97, 123)), " ", *map(chr, range(_SHOWN, _SHOWN + LETTERS - FOREIGN))])
    letters = letters_of(texts)
    shown = "".join(names[letters.codes].tolist())
    return [sorted(set(shown[a:b].split())) for a, b in zip(letters.firsts[:-1].tolist(), letters.firsts[1:].tolist())]


def _maps(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word number, subsequence and scaled weight of every entry of the words' feature vectors, by word."""
    letters = letters_of(words)
    sizes = np.array([len(w) + 1 for w in words])
    rows, which, weights = [], [], []
    for begin, sequence, weight in subsequences(letters):
        row = np.searchsorted(letters.firsts, begin, side="right") - 1
        rows.append(row)
        which.append(sequence)
        weights.append(weight / np.sqrt(sizes[row]))
    order = np.argsort(np.concatenate(rows), kind="stable")
    return tuple(np.concatenate(x)[order] for x in (rows, which, weights))


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Subsequence kernel of every word with every landmark."""
    row, which, weight = _maps(landmarks)
    used = np.unique(which)
    place = np.full(FEATURES, len(used))  # the last row of the table is that of all subsequences no landmark has
    place[used] = np.arange(len(used))
    table = np.zeros((len(used) + 1, len(landmarks)), dtype=np.float32)
    np.add.at(table, (place[which], row), weight)
    result = np.zeros((len(words), len(landmarks)), dtype=np.float32)
    for at in range(0, len(words), 200):
        row, which, weight = _maps(words[at : at + 200])
        firsts = np.flatnonzero(np.diff(row, prepend=-1))
        entries = table[place[which]] * weight[:, None].astype(np.float32)
        result[at + row[firsts]] = np.add.reduceat(entries, firsts, axis=0)
    return result


def fit_machine(x: np.ndarray, y: np.ndarray, share: np.ndarray, steps: int = 200) -> np.ndarray:
    """Linear support vector machine: squared hinge loss, accelerated gradient steps.

    The margin lies between 0 and 1 instead of around an offset, so that no word at all counts as harmless.
    """
    weights = momentum = np.zeros(x.shape[1])
    bound = float(np.linalg.eigvalsh((x * share[:, None]).T @ x)[-1]) + PENALTY
    for step in range(1, steps + 1):
        margin = x @ momentum
        lack = np.where(y, np.minimum(margin - 1, 0), np.maximum(margin, 0))
        new = momentum - (x.T @ (share * lack) + PENALTY * momentum) / bound
        momentum = new + step / (step + 3) * (new - weights)
        weights = new
    return weights


def with_inserted(words: list[str]) -> list[str]:
    """Each word with some other letter put in at each of two places, as its writers do to get it past a list."""
    found = []
    for w in words:
        for place in {len(w) // 3, 2 * len(w) // 3} - {0}:
            letter = chr(97 + (ord(w[place]) + 7 * len(found)) % 26)
            found.append(w[:place] + letter + w[place:])
    return found


def nystroem_weights(believed: list[str], harmless: list[str], landmarks: list[str]) -> np.ndarray:
    """The machine that tells believed insults from harmless words, folded into a weight per subsequence."""
    believed = believed + with_inserted(believed)
    square = kernel(landmarks, landmarks).astype(np.float64)
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    sound = values > 1e-5 * values[-1]
    root = vectors[:, sound] / np.sqrt(values[sound])  # the features are the kernel with the landmarks times this
    y = np.arange(len(believed) + len(harmless)) < len(believed)
    share = np.where(y, 0.5 / len(believed), 0.5 / len(harmless))
    machine = root @ fit_machine(kernel(believed + harmless, landmarks) @ root, y, share)
    row, which, weight = _maps(landmarks)
    return np.bincount(which, weights=weight * machine[row], minlength=FEATURES)


def apart(texts: list[list[str]]) -> list[list[str]]:
    """The texts that are no near copies of an earlier one. Copies would make every word of theirs look frequent.

    Texts are compared by the smallest of 64 hashes of their words; those that agree in over half are copies.
    """
    rng = np.random.default_rng(SEED)
    factors = rng.integers(1, 1 << 31, 64, dtype=np.uint64) | np.uint64(1)
    kept: list[list[str]] = []
    prints = np.zeros((len(texts), 64), dtype=np.uint64)
    for words in texts:
        if not words:
            continue
        hashes = np.array([zlib.crc32(w.encode()) for w in words], dtype=np.uint64)
        own = (hashes[:, None] * factors % np.uint64((1 << 31) - 1)).min(axis=0)
        if not ((prints[: len(kept)] == own).sum(axis=1) > 32).any():
            prints[len(kept)] = own
            kept.append(words)
    return kept


def parts_of(word: str) -> set[str]:
    """The word and its runs of four and five letters; its ends count as letters."""
    edged = f" {word} "
    return {word} | {edged[i : i + n] for n in (4, 5) for i in range(len(edged) - n + 1)}


class Parts:
    """The parts of words by number: those that some toxic text holds. Clean words know only these of theirs."""

    def __init__(self, toxic: list[list[str]], clean: list[list[str]]):
        numbers: dict[str, int] = {}
        self.of: dict[str, np.ndarray] = {}
        for w in sorted({w for words in toxic for w in words}):
            self.of[w] = np.array([numbers.setdefault(p, len(numbers)) for p in sorted(parts_of(w))], dtype=np.int32)
        for w in {w for words in clean for w in words} - self.of.keys():
            self.of[w] = np.array([numbers[p] for p in parts_of(w) if p in numbers], dtype=np.int32)
        self.size = len(numbers)

    def count(self, texts: list[list[str]]) -> np.ndarray:
        """In how many of the texts each part is."""
        n = np.zeros(self.size, dtype=np.int64)
        for words in texts:
            if words:
                n[np.unique(np.concatenate([self.of[w] for w in words]))] += 1
        return n


def too_often(texts: list[list[str]], seen: np.ndarray, clean: int, parts: Parts) -> set[str]:
    """Words that hold a part which the given toxic texts hold more often than chance would bring about, and hardly any
    clean text: ``seen`` has in how many of the ``clean`` ones each part is. One of them for every ``NOISE`` toxic
    texts, wrongly labelled maybe, does not clear a part. Insults with many endings are found by what these have in
    common.
    """
    counts = parts.count(texts)
    suspect = (counts > 0) & (NOISE * seen <= counts)
    if not suspect.any():
        return set()
    enough = np.log(CHANCE / suspect.sum()) / np.log(len(texts) / (len(texts) + clean))
    often = suspect & (counts >= max(enough, 3))
    return {w for w in {w for words in texts for w in words} if often[parts.of[w]].any()}


def learn_weights(toxic: list[list[str]], clean: list[list[str]]) -> np.ndarray:
    """A weight for every subsequence, from the words of toxic and of clean texts.

    The first insults are words with a part that toxic texts hold too often for chance. In each round a machine tells
    the words believed to be insults from words of clean texts, among them those that looked worst so far; then
    the toxic texts without such a word are searched again, by chance and by the machine. The machine alone makes no
    word believed that clean texts hold, but for that one text. Landmarks are insults, the worst harmless words and ordinary ones.
    """
    rng = np.random.default_rng(SEED)
    different = apart(toxic)
    known = Counter(w for words in clean for w in words)
    parts = Parts(different, clean)
    seen = parts.count(clean)
    counts = Counter(w for words in different for w in words)
    new = {w: n for w, n in counts.items() if NOISE * known[w] <= n}
    if not new or not known:
        return np.zeros(FEATURES)
    believed = too_often(different, seen, len(clean), parts) or {w for w, n in new.items() if n == max(new.values())}
    hard: list[str] = []
    candidates = sorted(new)
    for _ in range(ROUNDS):
        ordinary = sorted(known.keys() - believed)
        harmless = [ordinary[i] for i in rng.permutation(len(ordinary))[:HARMLESS]]
        ranked = sorted(believed, key=lambda w: (-counts[w], w))
        others = list(dict.fromkeys([w for w in hard if w not in believed] + harmless))
        landmarks = ranked[: LANDMARKS // 2]
        weights = nystroem_weights(ranked, others, landmarks + others[: LANDMARKS - len(landmarks)])
        scores = _scores(ordinary, weights)
        worst = np.argsort(-scores, kind="stable")[: LANDMARKS // 2]
        hard = list(dict.fromkeys([ordinary[i] for i in worst] + hard))
        score = dict(zip(candidates, _scores(candidates, weights)))
        limit = max(0.5, float(scores.max(initial=0.0)))
        unexplained = [words for words in different if believed.isdisjoint(words)]
        believed |= too_often(unexplained, seen, len(clean), parts)
        for words in unexplained:
            own = [w for w in words if w in new]
            if own and score[worst_own := max(own, key=lambda w: (score[w], w))] > limit:
                believed.add(worst_own)
    return weights


def _scores(words: list[str], weights: np.ndarray) -> np.ndarray:
    return word_scores(letters_of(words), weights)[1][: len(words)] if words else np.zeros(0)


@dataclass
class Model:
    weights: np.ndarray
    slope: float
    offset: float

    def texts(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * text_scores(texts, self.weights) + self.offset)))


def calibrate(scores: np.ndarray, toxic: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Platt's slope and offset by Newton steps, each class with half of the weight; targets kept off 0 and 1."""
    positive, negative = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    target = np.where(toxic, (positive + 1) / (positive + 2), 1 / (negative + 2))
    share = np.where(toxic, 0.5 / positive, 0.5 / negative)
    x = np.stack([scores, np.ones(len(scores))], axis=1)
    theta = np.array([1.0, -0.5])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ theta)))
        gradient = x.T @ (share * (p - target)) + 1e-4 * theta
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(curve, gradient)
        theta = theta - step / max(1.0, np.abs(step).max() / 5)
    return float(max(theta[0], 1e-3)), float(theta[1])


def fold(doc_id: str = "doc_id"):
    """0, 1 or 2 by the id's text; rows of 1 are held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of the labelled rows that are not held out; fold 0 and 2 also calibrate each other's scores.

    Ids with contradicting labels are left out. Without rows of both classes every text scores one half.
    """
    known = labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.where(fold() != 1).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"))
    known = known.where("toxic = most").select("doc_id", "toxic")
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = known.where("toxic = 1").orderBy(*order).limit(rows).unionByName(known.where("toxic = 0").orderBy(*order).limit(rows))
    read = F.arrow_udf(_word_lists, "array<string>")
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    sample = texts.select("doc_id", "toxic", read("text").alias("words")).toArrow().sort_by("doc_id")
    toxic = np.array(sample["toxic"].to_pylist(), dtype=int) == 1
    words = sample["words"].to_pylist()
    if not toxic.any() or toxic.all():
        return Model(np.zeros(FEATURES), 1e-3, 0.0)

    def learn(some: np.ndarray) -> np.ndarray:
        return learn_weights(*([words[i] for i in np.flatnonzero(some & (toxic == kind))] for kind in (True, False)))

    everything = np.ones(len(toxic), dtype=bool)
    half = np.arange(len(toxic)) % 2 == 0
    scores = np.zeros(len(toxic))
    for train_on in (half, ~half):
        weights = learn(train_on)
        for i in np.flatnonzero(~train_on):
            scores[i] = max(_scores(words[i], weights), default=0.0)
    return Model(learn(everything), *calibrate(np.maximum(scores, 0), toxic))


def _word_lists(column: pa.Array) -> pa.Array:
    found: list[list[str]] = []
    for part in slices(column):
        found += word_list([part.text(i).decode() for i in range(part.last - part.first)])
    return pa.array(found, type=pa.list_(pa.string()))


def _scorer(model: Broadcast) -> Callable:
    def score(column: pa.Array) -> pa.Array:
        found = [np.zeros(0)]
        for part in slices(column, 1 << 18):
            found.append(model.value.texts([part.text(i).decode() for i in range(part.last - part.first)]))
        return pa.array(np.concatenate(found))

    return F.arrow_udf(score, "double")


def scorer(docs: DataFrame, labels: DataFrame) -> Callable:
    """A column function from a text to its score."""
    score = _scorer(docs.sparkSession.sparkContext.broadcast(train(docs, labels)))
    return lambda column: score(F.col(column).cast("string"))


def score_texts(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every whole text.

    Learnt from ``labels`` (``doc_id, toxic``) of rows whose ``crc32(doc_id as text) mod 3`` is not 1, and of
    those from a sample of bounded size; nothing but the text enters a score. Null and empty texts score as a
    text without an insult; a long text counts whole, as its worst word. Texts of one score are predicted alike. A null
    ``doc_id`` is not held out. Rows that repeat come out as often. An empty table gives none. Columns other than
    ``doc_id`` and ``text`` are not read, whatever their names.
    """
    scored = docs.select(
        F.col("doc_id").cast("bigint"), F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), scorer(docs, labels)("text").alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns."""
    return docs.where(scorer(docs, labels)("text") < threshold)
