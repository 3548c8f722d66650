"""Personal data: base patterns, and further spans that boosted trees pick among high-recall candidates.

Nobody has labelled such data here, so the base matches teach: they, in the formats they might as well have been
written in and in the contexts they stand in, are what a candidate is compared with. Candidates in a format that no
such data is written in, and base matches with a digit changed so that their check fails, are what it is told from.
Other candidates in a format of their kind may well be what is looked for, so they teach nothing.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lectern.llm.boosting import Boosted, fit
from lectern.llm.landing import batch
from lectern.llm.textbatch import slices

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
# A candidate that no base pattern matches is added from this calibrated probability on.
MIN_PROBABILITY = 0.95
# At most so many different base matches and other candidates of each kind are learnt from, those with the smallest hashes.
BASE_SAMPLE = 2_000
OTHER_SAMPLE = 8_000

Span = tuple[int, int, int]  # start, kind, end

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


# --- base patterns; each reads a text once, however long its runs are


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48 << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """From each at sign back over its local part and on over its domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        local = text[free:at]
        start = free + len(local.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield start, EMAIL, free
        at = text.find("@", free)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _ips(text: str) -> Iterator[Span]:
    """Of every dotted chain of numbers, four at a time; numbers left over are too few for a match."""
    for chain in _DOTTED.finditer(text):
        parts = chain[0].split(".")
        start = chain.start()
        for i in range(0, len(parts) - 3, 4):
            end = start + sum(map(len, parts[i : i + 4])) + 3
            if all(map(_small, parts[i : i + 4])):
                yield start, IP, end
            start = end + 1


def _cards(text: str) -> Iterator[Span]:
    for m in _DIGITS.finditer(text):
        if 14 <= m.end() - m.start() <= 37 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield m.start(), CARD, m.end()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            yield m.start(), PHONE, m.end()


def base_spans(text: str) -> list[Span]:
    return sorted([*_emails(text), *_ips(text), *_cards(text), *_phones(text)])


class Places:
    """Sorted spans by where they touch: groups of spans that overlap each other, found by bisection."""

    def __init__(self, spans: list[Span]) -> None:
        self.groups: list[list[Span]] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        for span in spans:
            if self.ends and span[0] < self.ends[-1]:
                self.groups[-1].append(span)
                self.ends[-1] = max(self.ends[-1], span[2])
            else:
                self.groups.append([span])
                self.starts.append(span[0])
                self.ends.append(span[2])

    def near(self, start: int, end: int) -> list[Span]:
        """The spans that share a character with the given place."""
        groups = self.groups[bisect_right(self.ends, start) : bisect_left(self.starts, end)]
        return [s for group in groups for s in group if s[0] < end and start < s[2]]


# --- candidates

_AT = re.compile(r" ?[(\[]at[)\]] ?| at (?=[A-Za-z0-9-]{1,63}(?: dot |\.))|@", re.IGNORECASE)
_SPELT = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?[(\[]dot[)\]] ?| dot |\.)[A-Za-z0-9-]{1,63})+", re.IGNORECASE)
_RUN = re.compile(r"[0-9](?:[0-9 ().\-/]*[0-9])?")
# A written number has at most so many characters; a run of numbers has any number of them.
_LONGEST = 41
_GROUP = re.compile(r"[0-9]+")
_DOTTED_ON = re.compile(r"\.[0-9]")
_CUES = tuple(re.compile(p, re.IGNORECASE) for p in (r"mail|contact|write", r"\bip|host|server|addr", r"card|visa|pay", r"tel|phone|call|fax|mobile"))
_CONTEXT = 24
# Lists into which the sample of a kind is cut before it is one.
LISTS = 64
# So many candidates are scored at a time.
_BLOCK = 20_000


def _numbers(text: str, first: int, last: int) -> Iterator[Span]:
    """Every sequence of neighbouring digit groups in a run whose digits fit a kind: from each group at most 20."""
    groups = [m.span() for m in _GROUP.finditer(text, first, last)]
    for i, (start, _) in enumerate(groups):
        lead = text[start - 1] if start else ""
        chained = lead == "." and text[start - 2 : start - 1].isdigit()
        n = 0
        for j in range(i, len(groups)):
            end = groups[j][1]
            n += end - groups[j][0]
            if n > 20 or end - start > _LONGEST:
                break
            if n < 4:
                continue
            opened = lead == "(" and text.count("(", start, end) < text.count(")", start, end)
            at = start - (lead == "+" or opened)
            if j - i == 3 and n <= 12 and text.count(".", start, end) == 3 and not chained and not _DOTTED_ON.match(text, end):
                yield at, IP, end
            if 12 <= n:
                yield at, CARD, end
            if 7 <= n <= 15:
                yield at, PHONE, end


def proposed(text: str) -> Iterator[Span]:
    """Spans that might be of a kind; they overlap each other, and one place may stand for several kinds."""
    plain = text.lower()
    if "@" in text or "at)" in plain or "at]" in plain or " dot " in plain:
        for m in _AT.finditer(text):
            local = text[max(0, m.start() - 64) : m.start()]
            start = m.start() - len(local) + len(local.rstrip(_LOCAL))
            domain = _SPELT.match(text, m.end())
            if domain and start < m.start():
                yield start, EMAIL, domain.end()
    for m in _RUN.finditer(text):
        if m.end() - m.start() >= 7:
            yield from _numbers(text, m.start(), m.end())


def candidates(text: str) -> list[Span]:
    """All proposed spans in order."""
    return sorted(set(proposed(text)))


def _side(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in "\"'=#" else 5


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate."""
    start, kind, end = span
    piece, before = text[start:end], text[max(0, start - _CONTEXT) : start]
    groups = [len(g) for g in _GROUP.findall(piece)] or [0]
    digits = _digits(piece)
    numbers = piece.split(".")
    cue = _CUES[kind].search(before + text[end : end + _CONTEXT])
    return [
        len(piece), len(digits), len(groups), max(groups), min(groups), groups[0], groups[-1],
        piece.count(" "), piece.count("."), piece.count("-"), piece.count("(") + piece.count(")"), piece.count("/"),
        piece.startswith("+"), "@" in piece, piece.lower().count("at)") + piece.lower().count("at]") + piece.lower().count(" at "),
        len(digits) >= 12 and luhn(digits), len(numbers) == 4 and all(n.isdigit() and _small(n) for n in numbers),
        ord(digits[0]) - 48 if digits else -1, sum(map(str.isalpha, piece)) / len(piece), len(re.split(r"[. ]", piece)[-1]),
        _side(before[-1:]), _side(text[end : end + 1]), _side(before[-2:-1]), before.rstrip().endswith((":", "=")), cue is not None,
    ]


# --- learning

_AMERICAN = r"(?:(?:\+|00) ?1[ .\-/]|1[ .\-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-/])[0-9]{3}[ .\-][0-9]{4}"
_ABROAD = r"(?:\+|00) ?[1-9][0-9]{0,2}(?:[ .\-/]{1,3}(?:\([0-9]{1,5}\)|[0-9]{1,8})){1,5}"
_TRUNK = r"\(?0[1-9][0-9]{1,4}\)?[ .\-/]{1,3}[0-9]{3,8}(?:[ \-][0-9]{2,4})*|0[1-9](?:[ .\-][0-9]{2}){4}"
_PHONE_FORMAT = re.compile(f"{_AMERICAN}|{_ABROAD}|{_TRUNK}")
_CARD_FORMAT = re.compile(r"[0-9]+(?:([ .\-/])[0-9]+(?:\1[0-9]+)*)?")


def in_format(piece: str, kind: int) -> bool:
    """Whether data of the kind is written like this, so that the piece may be such data although no base pattern matches."""
    if kind == EMAIL:
        low, last = piece.lower(), re.split(r"[. )\]]+", piece)[-1]
        marked = "@" in low or "at)" in low or "at]" in low or " at " in low and "dot" in low
        return marked and len(last) > 1 and last.isalpha() and (last.islower() or piece.isupper())
    if kind == IP:
        numbers = piece.split(".")
        return len(numbers) == 4 and all(n.isdigit() and _small(n) for n in numbers)
    digits, sizes = _digits(piece), [len(g) for g in _GROUP.findall(piece)]
    if kind == CARD:
        usual = len(sizes) == 1 or (set(sizes[:-1]) == {4} and sizes[-1] <= 4) or sizes in ([4, 6, 4], [4, 6, 5])
        return usual and 14 <= len(digits) <= 19 and luhn(digits) and _CARD_FORMAT.fullmatch(piece) is not None
    return 10 <= len(digits) <= 15 and _PHONE_FORMAT.fullmatch(piece) is not None


def _other_formats(piece: str, kind: int, salt: int) -> list[str]:
    """Ways to write the same data that the base patterns do not all know."""
    digits = _digits(piece)
    if kind == EMAIL:
        local, domain = piece.rsplit("@", 1)
        names = (local, re.sub("[^A-Za-z]+", "", local) or "it")
        domains = dict.fromkeys((domain, ".".join(domain.split(".")[-2:])))
        spelt = [rest for d in domains for rest in (f" (at) {d}", f" at {d.replace('.', ' dot ')}", f"[at]{d.replace('.', '[dot]')}")]
        return [name + rest for name in names for rest in spelt]
    if kind == CARD:
        return [" ".join(digits[i : i + 4] for i in range(0, len(digits), 4)), ".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), digits]
    if kind == PHONE:
        d = digits[-10:]
        return [f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}", f"00{digits[:-10] or 1} {d[:3]} {d[3:]}"][salt % 2 :: 2]
    return []


def _spoilt(piece: str, kind: int, salt: int) -> list[str]:
    """The same format with a check that fails."""
    digits = [i for i, c in enumerate(piece) if c.isdigit()]
    if kind == EMAIL:
        local, host = piece.split("@")[0], re.split(r"[@.]", piece)[-2]
        names = (local, re.sub("[^A-Za-z]+", "", local) or "it")
        rests = (f" at {host}.Afterwards", f" at {host} dot then", f" at {host}.{'abcdefgh'[: 1 + salt % 8].title()}")
        return [name + rest for name in names for rest in rests]
    if kind == CARD:
        found = []
        for written in (piece, *_other_formats(piece, kind, salt)):
            at = [i for i, c in enumerate(written) if c.isdigit()][salt % len(digits)]
            found.append(written[:at] + str((int(written[at]) + 1 + salt % 8) % 10) + written[at + 1 :])
        return [w for w in found if not luhn(_digits(w))]
    if kind == IP:
        parts = piece.split(".")
        parts[salt % 4] = str(256 + salt % 700)
        return [".".join(parts), ".".join(parts[:3])]
    if kind == PHONE:
        d, year = _digits(piece)[-10:], 1900 + salt % 150
        years = f"{year} {year + 1} {year + 2}", f"{year}-{1 + salt % 12:02}-{1 + salt % 28:02} {salt % 24:02}"
        return [piece[: digits[6]], f"{d[:4]} {d[4:8]} {d[8:]}", f"{d[:5]}.{d[5:]}", f"{d[:3]}-{d[3:6]}-{d[6:8]}", *years]
    return []


def natural(text: str) -> Iterator[tuple[bool, Span]]:
    """A text's base matches, and its candidates that are not personal data of their kind.

    A candidate that touches no base match but is in a format of its kind may be either, and is left out.
    """
    base = base_spans(text)
    places = Places(base)
    for span in base:
        yield True, span
    for start, kind, end in proposed(text):
        near = places.near(start, end)
        if all(s[1] != kind for s in near) if near else not in_format(text[start:end], kind):
            yield False, (start, kind, end)


def examples(before: str, piece: str, after: str, kind: int, good: bool) -> Iterator[tuple[int, list[float], bool]]:
    """``kind``, features and whether it is personal data, of a sampled piece in its context and, if good, of its rewrites."""

    def seen(written: str) -> list[float]:
        return features(before + written + after, (len(before), kind, len(before) + len(written)))

    yield kind, seen(piece), good
    if not good:
        return
    salt = zlib.crc32(piece.encode())
    for written in _other_formats(piece, kind, salt):
        if in_format(written, kind):
            yield kind, seen(written), True
            if kind in (CARD, PHONE):
                yield from _in_a_list(before, written, after, kind)
    for written in _spoilt(piece, kind, salt):
        yield kind, seen(written), False


def _in_a_list(before: str, piece: str, after: str, kind: int) -> Iterator[tuple[int, list[float], bool]]:
    """The piece between others like it; candidates of its kind that take parts of several are no such data."""
    text = f"{before}{piece} {piece} {piece}{after}"
    starts = [len(before) + i * (len(piece) + 1) for i in range(3)]
    for start in starts:
        yield kind, features(text, (start, kind, start + len(piece))), True
    whole = {(start, start + len(piece)) for start in starts}
    for start, k, end in candidates(text):
        if k == kind and (start, end) not in whole and start < starts[2] + len(piece) and starts[0] < end and not in_format(text[start:end], kind):
            yield kind, features(text, (start, kind, end)), False


def made_up(number: int = 40) -> list[tuple[str, str, str, int, bool]]:
    """Base matches of every kind that are always learnt from, so that no kind is without examples however rare it is."""
    rnd = random.Random(5)
    found = []
    for i in range(number):
        digits = "".join(rnd.choice("0123456789") for _ in range(15))
        card = next(digits + c for c in "0123456789" if luhn(digits + c))
        phone = f"({rnd.randint(200, 999)}) {rnd.randint(200, 999)}-{digits[:4]}"
        email = f"{rnd.choice(['jo.lee', 'ann', 'k_roy', 'info'])}{digits[: i % 4]}@{rnd.choice(['mail.', 'a4.', '', ''])}{rnd.choice(['host', 'some-firm'])}.{rnd.choice(['com', 'org', 'de', 'info'])}"
        ip = ".".join(str(rnd.randint(1, 255)) for _ in range(4))
        for kind, piece in enumerate((email, ip, " ".join(card[j : j + 4] for j in range(0, 16, 4)), f"+1 {phone}")):
            cue = (("mail ", "write to: "), ("host ", "address="), ("card ", "paid by: "), ("call ", "tel: "))[kind][i % 2]
            before, after = ((f"Please {cue}", " today."), ("this is ", " here"), (f"x, {cue}", "\n"), ("", ""))[i // 2 % 4]
            found.append((before, piece, after, kind, True))
    return found


def train(docs: DataFrame, base: int = BASE_SAMPLE, other: int = OTHER_SAMPLE) -> list[Boosted]:
    """A model per kind, from a sample by hash of the different base matches and other candidates of all documents.

    Every kind has its own share of both, so that neither a rare kind nor a frequent one crowds another out.
    """
    schema = pa.schema([("place", pa.int64()), ("good", pa.bool_()), ("kind", pa.int32()), ("before", pa.string()), ("piece", pa.string()), ("after", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pieces of a task with the smallest hashes; a list is cut back when it is twice as long as it may be."""
        kept: list[dict[int, tuple]] = [{} for _ in range(2 * len(KINDS))]
        bounds = [1 << 63] * len(kept)

        def cut(which: int, most: int) -> None:
            if len(kept[which]) > most:
                places = sorted(kept[which])[:most]
                kept[which] = {p: kept[which][p] for p in places}
                bounds[which] = places[-1]

        for rows in batches:
            for part in slices(rows["text"]):
                for i in range(part.last - part.first):
                    text = part.text(i).decode()
                    for good, (start, kind, end) in natural(text):
                        row = (text[max(0, start - 100) : start], text[start:end], text[end : end + 100])
                        place = int.from_bytes(hashlib.blake2b("\0".join(row).encode(), digest_size=8).digest()) >> 1
                        which = 2 * kind + good
                        if place < bounds[which]:
                            kept[which][place] = row
                            most = base if good else other
                            if len(kept[which]) >= 2 * most:
                                cut(which, most)
        for which, found in enumerate(kept):
            cut(which, base if which % 2 else other)
            found = kept[which]
            n = len(found)
            columns = [[row[c] for row in found.values()] for c in range(3)]
            yield batch(schema, [list(found), [which % 2 == 1] * n, [which // 2] * n, *columns])

    shape = "place bigint, good boolean, kind int, before string, piece string, after string"
    found = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(run, shape)
    found = found.groupBy("good", "kind", "place").agg(*(F.min(c).alias(c) for c in ("before", "piece", "after")))
    # Every task sends so many. They are cut in many lists first, so that the last ones are short, however many tasks.
    for lists in (["good", "kind", F.pmod("place", F.lit(LISTS))], ["good", "kind"]):
        found = found.withColumn("n", F.row_number().over(Window.partitionBy(*lists).orderBy("place"))).where(F.col("n") <= max(base, other))
    sample = found.where(F.col("n") <= F.when(F.col("good"), base).otherwise(other)).orderBy("place", "good", "kind").toArrow().to_pylist()
    rows = [(r["before"], r["piece"], r["after"], r["kind"], r["good"]) for r in sample]
    some = [e for row in made_up() + rows for e in examples(*row)]
    some.sort(key=lambda e: zlib.crc32(repr(e).encode()))
    models = []
    for k in range(len(KINDS)):
        mine = [e for e in some if e[0] == k]
        models.append(fit(np.array([e[1] for e in mine], dtype=np.float32), np.array([e[2] for e in mine], dtype=bool)))
    return models


# --- finding


def all_spans(text: str, models: list[Boosted], min_probability: float = MIN_PROBABILITY) -> tuple[list[Span], list[Span]]:
    """Base spans, and those with the candidates added that are likely enough and touch no likelier one."""
    base = base_spans(text)
    places = Places(base)
    free = (c for c in proposed(text) if not places.near(c[0], c[2]))
    likely: list[tuple[float, int, Span]] = []
    while some := list(islice(free, _BLOCK)):
        for k, model in enumerate(models):
            mine = [c for c in some if c[1] == k]
            if mine:
                chances = model.probability(np.array([features(text, c) for c in mine], dtype=np.float32))
                likely += [(-chances[i], c[0] - c[2], c) for i, c in enumerate(mine) if chances[i] >= min_probability]
    chosen: list[Span] = []
    for _, _, span in sorted(likely):
        at = bisect_left(chosen, span)
        if (at == 0 or chosen[at - 1][2] <= span[0]) and (at == len(chosen) or span[2] <= chosen[at][0]):
            chosen.insert(at, span)
    return base, sorted(base + chosen)


def find_spans(docs: DataFrame, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """``doc_id, base, spans`` of every whole text: arrays of ``kind, start, end`` in code points, end exclusive.

    ``base`` has the leftmost matches of the four patterns that pass their checks, each kind by itself; matches
    of different kinds may overlap. ``spans`` has these and the candidates that the trees add, which overlap none
    of them. Both are in the order of ``start``, then of the kinds. A null or empty text has none. A null
    ``doc_id`` stays, rows that repeat come out as often, an empty table gives none. Only ``doc_id`` and ``text``
    are read.
    """
    models = docs.sparkSession.sparkContext.broadcast(train(docs))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(span)), ("spans", pa.list_(span))])

    def shown(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in slices(rows["text"]):
                found = [all_spans(part.text(i).decode(), models.value, min_probability) for i in range(part.last - part.first)]
                ids = rows["doc_id"].slice(part.first, len(found))
                yield batch(schema, [ids, [shown(b) for b, _ in found], [shown(s) for _, s in found]])

    kind = "array<struct<kind:string,start:int,end:int>>"
    narrow = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, f"doc_id bigint, base {kind}, spans {kind}")


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans by the first one's."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digest(spans: list[Span]) -> str:
    joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    return hashlib.sha256(joined.encode()).hexdigest()
