"""Secrets in texts: an Aho-Corasick prefilter, regular expressions anchored at its hits, then embedded checksums.

One automaton finds all keywords in the lower-cased bytes of a text; a second one, over bytes reduced to their class,
finds runs of hexadecimal digits. Patterns are tried only where a keyword stands, so a text without a hit costs one
reading. Beyond the base kinds, spans are added only where the secret itself proves that it is one: a checksum, or a
structure that has to decode.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lectern.llm.landing import batch
from lectern.llm.textbatch import slices

BASE_KINDS = ("assign", "access", "hex")
MIN_VALUE, MIN_ACCESS, MIN_HEX = 8, 16, 32


@dataclass(frozen=True)
class Rule:
    """A kind of secret. The pattern is tried where a keyword, in lower case, is found; what it matches counts if
    ``accepts`` says so, and is skipped over either way."""

    kind: str
    keywords: tuple[bytes, ...]
    pattern: re.Pattern
    accepts: Callable[[re.Match], bool]


# --- checks


BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_CHECK_DIGITS = 6


def base62(number: int, digits: int) -> bytes:
    out = bytearray()
    for _ in range(digits):
        number, rest = divmod(number, 62)
        out.append(BASE62[rest])
    return bytes(out[::-1])


def crc_token(match: re.Match) -> bool:
    """The last six characters are the CRC-32 of those before them, in base 62."""
    value = match[1]
    return base62(zlib.crc32(value[:-_CHECK_DIGITS]), _CHECK_DIGITS) == value[-_CHECK_DIGITS:]


def base58_check(value: bytes) -> bytes | None:
    """The payload, if the last four bytes are the beginning of its double SHA-256."""
    number = 0
    for c in value:
        number = number * 58 + BASE58.index(c)
    zeros = len(value) - len(value.lstrip(b"1"))
    raw = b"\0" * zeros + number.to_bytes((number.bit_length() + 7) // 8, "big")
    payload, check = raw[:-4], raw[-4:]
    return payload if hashlib.sha256(hashlib.sha256(payload).digest()).digest()[:4] == check else None


def extended_key(match: re.Match) -> bool:
    return (payload := base58_check(match[0])) is not None and len(payload) == 78


def _decoded(part: bytes) -> bytes | None:
    try:
        return base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))
    except (binascii.Error, ValueError):
        return None


def signed_claims(match: re.Match) -> bool:
    """Header and body of the token are JSON objects, and the header names its algorithm."""
    try:
        header, body = (json.loads(_decoded(part) or b"") for part in match[0].split(b".")[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(body, dict) and isinstance(header.get("alg"), str)


def private_key(match: re.Match) -> bool:
    """The body decodes to what its own length says: a DER sequence, or the new format with its magic number."""
    raw = _decoded(re.sub(rb"[\r\n\x20\t]|\\[rn]", b"", match[2]).rstrip(b"=").translate(_URL_SAFE))
    if raw is None or len(raw) < 16:
        return False
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return len(raw) == 2 + raw[1]
    size = raw[1] & 0x7F
    return 0 < size <= 4 and len(raw) == 2 + size + int.from_bytes(raw[2 : 2 + size], "big")


_URL_SAFE = bytes.maketrans(b"+/", b"-_")


def _at_least(group: int, size: int) -> Callable[[re.Match], bool]:
    return lambda match: len(match[group]) >= size


ASSIGN = Rule(
    "assign",
    (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"),
    # Bytes and ASCII letters only: no other letter folds to one of these.
    re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    _at_least(2, MIN_VALUE),
)
ACCESS = Rule("access", (b"akia",), re.compile(rb"AKIA[A-Z0-9]+"), _at_least(0, MIN_ACCESS))
HEX = re.compile(rb"[0-9a-f]+")
CHECKED = (
    Rule("github", (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"), re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), crc_token),
    Rule("npm", (b"npm_",), re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), crc_token),
    Rule("extended", (b"xprv",), re.compile(rb"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"), extended_key),
    Rule("claims", (b"eyj",), re.compile(rb"eyJ[A-Za-z0-9_-]{2,4096}\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), signed_claims),
    Rule(
        "pem",
        (b"-----begin ",),
        re.compile(rb"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----([A-Za-z0-9+/=\r\n\x20\t\\]+)-----END \1-----"),
        private_key,
    ),
)
KINDS = (*BASE_KINDS, *(r.kind for r in CHECKED))

# --- finding


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CLASS = bytes(ord("h") if chr(c) in "0123456789abcdef" else ord(".") for c in range(256))


def keyword_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for rule in (ASSIGN, ACCESS, *CHECKED):
        for word in rule.keywords:
            automaton.add_word(word.decode(), (len(word), rule))
    automaton.make_automaton()
    return automaton


def run_automaton() -> ahocorasick.Automaton:
    """Finds the place where a run of digits is long enough; the dot before it makes a run one hit."""
    automaton = ahocorasick.Automaton()
    automaton.add_word("." + "h" * MIN_HEX, MIN_HEX)
    automaton.make_automaton()
    return automaton


def spans(text: bytes, keywords: ahocorasick.Automaton, runs: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """Kind, first byte and end of every secret. Of one kind none overlap: the leftmost match is taken and skipped."""
    found, ends = [], {}
    # No byte above 127 is part of a keyword: they may all become one.
    plain = text.translate(_LOWER).decode("latin-1")
    hits = [(end - length + 1, rule) for end, (length, rule) in keywords.iter(plain)]
    hits.sort(key=lambda h: h[0])
    for start, rule in hits:
        if start < ends.get(rule.kind, 0):
            continue
        match = rule.pattern.match(text, start)
        if match is not None:
            ends[rule.kind] = match.end()
            if rule.accepts(match):
                found.append((rule.kind, start, match.end()))
    for end, length in runs.iter("." + text.translate(_CLASS).decode("ascii")):
        match = HEX.match(text, end - length)
        found.append(("hex", match.start(), match.end()))
    return found


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
SPAN = "array<struct<kind:string,start:bigint,end:bigint>>"


def _by_code_point(text: bytes, found: list[tuple[str, int, int]]) -> list[dict]:
    """The spans in order, their places counted in code points: bytes that begin one."""
    places, at, passed = {}, 0, 0
    for place in sorted({p for _, a, b in found for p in (a, b)}):
        piece = text[at:place]
        passed += len(piece) - (0 if piece.isascii() else len(piece.translate(None, delete=_BEGINNINGS)))
        places[place], at = passed, place
    ordered = sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return [{"kind": kind, "start": places[a], "end": places[b]} for kind, a, b in ordered]


_BEGINNINGS = bytes(c for c in range(256) if c & 0xC0 != 0x80)


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, base, spans`` of every row: where its text holds secrets, as kind, start and end in code points.

    ``base`` has the values assigned to names of secrets (``assign``, eight characters or more), access keys
    (``access``, 16 or more) and hexadecimal digits (``hex``, 32 or more), leftmost and without overlaps in each
    kind. ``spans`` has these, and secrets that prove themselves: tokens with a CRC-32 in base 62 (``github``,
    ``npm``), extended private keys with a double SHA-256 (``extended``), signed claims that decode (``claims``) and
    private keys of the length they state (``pem``). Both are in the order of start, then of these kinds.

    A null text is empty and holds none. Texts are read whole, however long, one row at a time. A null ``doc_id``
    stays, rows that repeat come out as often, an empty table gives none. Columns other than ``doc_id`` and ``text``
    are not read. Nothing is shuffled.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("base", _SPAN), ("spans", _SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords, runs = keyword_automaton(), run_automaton()
        for rows in batches:
            every = []
            for part in slices(rows["text"]):
                for i in range(part.last - part.first):
                    text = part.text(i)
                    every.append(_by_code_point(text, spans(text, keywords, runs)))
            base = [[s for s in found if s["kind"] in BASE_KINDS] for found in every]
            yield batch(schema, [rows["doc_id"], base, every])

    own = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return own.mapInArrow(run, f"doc_id bigint, base {SPAN}, spans {SPAN}")


def without_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``doc_id, text`` with every span of ``find_secrets`` replaced by the mark; overlapping spans become one.

    Null texts stay null. Rows, ids and other columns are as in ``find_secrets``.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords, runs = keyword_automaton(), run_automaton()
        for rows in batches:
            texts, known = [], rows["text"].is_valid().to_pylist()
            for part in slices(rows["text"]):
                for i in range(part.last - part.first):
                    text, out, at = part.text(i), [], 0
                    for _, start, end in sorted(spans(text, keywords, runs), key=lambda s: s[1:]):
                        if start >= at:
                            out += [text[at:start], mark.encode()]
                        at = max(at, end)
                    texts.append((b"".join(out) + text[at:]).decode("utf-8", "replace"))
            yield batch(schema, [rows["doc_id"], [t if k else None for t, k in zip(texts, known, strict=True)]])

    own = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id bigint, text string")
