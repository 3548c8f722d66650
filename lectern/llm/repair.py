"""Conversations repaired at the least cost, by an automaton of turn signatures that share their ends.

A turn is a letter: the initial of its role, and its fault. The letters of a conversation, read from the end, lead
through a suffix-shared automaton: turns share a node if all that follows them is the same. For every node and
every state of the grammar ``(s?(ua)+)?`` the cheapest way to the end is found once, from the node that follows.

Signatures are sorted from their ends, so a task meets the nodes in depth-first order and holds one path of them.
What a node knows is minimised further: costs less their minimum are one of a few profiles, and a letter before a
profile always gives the same steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lectern.llm.landing import batch, landed
from lectern.operators.joins import spread_join

WHITE_SPACE = " \t\n\x0b\f\r"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
# Turns that are gathered into one value at a time: 2 to the power of this.
PIECE_BITS = 12

# A letter for each initial (system, user, assistant, other) and fault (none, blank, duplicate, truncated).
LETTERS = "abcdefghijklmnop"
# Turns that have to go are alike, whatever their role.
GOES = "x"
REDUCED = "".join(GOES if i % 4 in (1, 2) else c for i, c in enumerate(LETTERS))

# States of the grammar: nothing yet, after system, after user, after assistant.
STATES = 4
_AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
_NEXT = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
_ENDS = ("", "UA", "A", "")
# Steps as they are written: kept, made user or assistant, deleted; user or assistant put in.
STEPS, EDITS = "kuadUA", "KRRDII"

Profile = tuple[int, int, int, int]
END: Profile = tuple(len(s) * INSERT_COST for s in _ENDS)


@lru_cache(maxsize=None)
def before(letter: str, follows: Profile) -> tuple[Profile, int, tuple[str, ...], tuple[int, ...]]:
    """The node of a letter before a node with these costs: its costs less their minimum, that minimum, and per
    state the steps at this turn and the state they lead to. Of equally cheap steps the edits that come first in ASCII.

    Steps of equal cost differ in an edit at this turn, so what follows never decides.
    """
    role, fault = (None, 1) if letter == GOES else ("suao"[LETTERS.index(letter) // 4], LETTERS.index(letter) % 4)
    costs, steps, leads = [], [], []
    for state in range(STATES):
        ways, at, put_in = [], state, ""
        for n in range(3):
            spent = n * INSERT_COST
            ways.append((spent + DELETE_COST + follows[at], put_in + "d", at))
            if role is not None:
                extra = spent + (TRUNCATED_COST if fault == 3 else 0)
                if at in _AFTER[role]:
                    ways.append((extra + follows[_AFTER[role][at]], put_in + "k", _AFTER[role][at]))
                turned, to = _NEXT[at]
                ways.append((extra + REROLE_COST + follows[to], put_in + turned, to))
            given, at = _NEXT[at]
            put_in += given.upper()
        cost, step, lead = min(ways, key=lambda w: (w[0], edits(w[1])))
        costs.append(cost)
        steps.append(step)
        leads.append(lead)
    least = min(costs)
    return tuple(c - least for c in costs), least, tuple(steps), tuple(leads)


def edits(steps: str) -> str:
    return steps.translate(str.maketrans(STEPS, EDITS))


class SuffixPath:
    """The nodes from the end of the last signature to its beginning; a signature with the same end reuses them."""

    def __init__(self):
        self.signature = ""  # from the end
        self.nodes: list[tuple] = []
        self.spent = [0]

    def solve(self, signature: str) -> tuple[int, list[str]]:
        """The cost of a signature, and the steps at each turn, those behind the last one added to it."""
        backwards = signature[::-1]
        shared, most = 0, min(len(backwards), len(self.signature))
        if backwards[:most] == self.signature[:most]:
            shared = most
        else:
            while backwards[shared] == self.signature[shared]:
                shared += 1
        del self.nodes[shared:], self.spent[shared + 1 :]
        for letter in backwards[shared:]:
            node = before(letter, self.nodes[-1][0] if self.nodes else END)
            self.nodes.append(node)
            self.spent.append(self.spent[-1] + node[1])
        self.signature = backwards
        if not self.nodes:
            return END[0], []
        cost, state, steps = self.spent[-1] + self.nodes[-1][0][0], 0, []
        for _, _, step, leads in reversed(self.nodes):
            steps.append(step[state])
            state = leads[state]
        steps[-1] += _ENDS[state]
        return cost, steps


_REDUCE = str.maketrans(LETTERS, REDUCED)
_INITIALS = str.maketrans(LETTERS, "".join("suao"[i // 4] for i in range(16)))
LEGAL = ("su", "ua", "au")


def _illegal(initials: str) -> int:
    """Neighbouring initials that are none of su, ua, au. No two of these pairs overlap with themselves."""
    return max(len(initials) - 1, 0) - sum(initials.count(pair) for pair in LEGAL)


SOLVED = "conv_id bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, pieces array<bigint>, segments array<string>"
_SOLVED = pa.schema(
    [("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
     ("pieces", pa.list_(pa.int64())), ("segments", pa.list_(pa.string()))]
)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, last, found = SuffixPath(), None, (0, [])
    for rows in batches:
        out = []
        for row in rows.to_pylist():
            signature = "".join(row["parts"])
            reduced = signature.translate(_REDUCE)
            if reduced != last:
                last, found = reduced, path.solve(reduced)
            cost, steps = found
            segments, at = [], 0
            for part in row["parts"]:
                segments.append("".join(steps[at : at + len(part)]))
                at += len(part)
            faults = [sum(signature.count(c) for c in LETTERS[f::4]) for f in (1, 2, 3)]
            out.append((row["conv_id"], *faults, _illegal(signature.translate(_INITIALS)), cost, row["pieces"], segments))
        yield batch(_SOLVED, zip(*out)) if out else batch(_SOLVED, [[] for _ in _SOLVED])


# --- turns as letters


def _placed(turns: DataFrame) -> DataFrame:
    """The turns once in order, each with its place; a conversation may lie in many files."""
    own = turns.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    ).select("*", F.md5("text").alias("digest"), F.monotonically_increasing_id().alias("own_place"))
    order = ["conv_id", "turn", "role", "digest", "own_place"]
    ordered = own.repartitionByRange(*order).sortWithinPartitions(*order)
    solid = F.rtrim(F.col("text"), F.lit(WHITE_SPACE))
    initial = F.substring("role", 1, 1)
    number = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(solid == "", 1).when(F.substring(solid, -1, 1).isin(".", "!", "?"), 0).otherwise(3)
    same = F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), "digest", "role"))
    placed = ordered.select(
        "conv_id", "turn", "role", "text", same.alias("same"), number.alias("initial"), fault.alias("fault"),
        F.monotonically_increasing_id().alias("place"),
    )
    return landed(placed, "turns")


def _pieces(placed: DataFrame) -> DataFrame:
    """The letters of up to 4,096 turns of a conversation, with their places."""
    firsts = placed.groupBy("same").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    firsts = landed(firsts, "firsts")
    narrow = placed.select("conv_id", "place", "initial", "fault", "same")
    told = spread_join(narrow, firsts.select("same", "first"), "same", how="left", counts=firsts.select("same", "n_rows"))
    fault = F.when((F.col("fault") != 1) & (F.col("place") > F.col("first")), 2).otherwise(F.col("fault"))
    letter = F.substring(F.lit(LETTERS), 4 * F.col("initial") + fault + 1, F.lit(1))
    piece = F.shiftright("place", PIECE_BITS).alias("piece")
    gathered = told.select("conv_id", piece, F.struct("place", letter.alias("letter")).alias("t"))
    gathered = gathered.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list("t")).alias("t"))
    part = F.array_join(F.col("t.letter"), "").alias("part")
    return landed(gathered.select("conv_id", "piece", F.col("t.place").alias("places"), part), "pieces")


def _solved(pieces: DataFrame) -> DataFrame:
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "part"))).alias("p"))
    whole = whole.select("conv_id", F.col("p.piece").alias("pieces"), F.col("p.part").alias("parts"))
    ends = F.reverse(F.translate(F.array_join("parts", ""), LETTERS, REDUCED))
    whole = whole.withColumn("ends", ends)
    # Conversations of one signature may lie in several tasks: however many there are, none has them all.
    dealt = whole.repartitionByRange(F.substring("ends", 1, 64), F.xxhash64("conv_id")).sortWithinPartitions("ends")
    return landed(dealt.drop("ends").mapInArrow(_solve, SOLVED), "solved")


def _gaps(placed: DataFrame) -> DataFrame:
    wide = "decimal(20,0)"
    between = F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.countDistinct("turn")
    gaps = placed.groupBy("conv_id").agg(F.coalesce(between, F.lit(0)).alias("gaps"))
    return gaps.withColumn("gaps", F.expr("try_cast(gaps as bigint)"))


def same_id(a: DataFrame, b: DataFrame, key: str = "conv_id") -> Column:
    return a[key].eqNullSafe(b[key])


# --- repaired


@dataclass(frozen=True)
class Repaired:
    """``summary``: a row per conversation. ``turns``: ``conv_id, place, step, role, text`` of the repaired turns, in
    the order of ``place`` and ``step``."""

    summary: DataFrame
    turns: DataFrame


def repair(turns: DataFrame) -> Repaired:
    """Conversations with the cheapest edits that make their roles ``(system? (user assistant)+)?``.

    The turns of a conversation stand by ``turn``, nulls first; of one number by role and MD5 of the text. The first
    fault of each counts: blank (nothing but white space), duplicate (role and text seen earlier there), truncated
    (the last character that is not white space is none of ``. ! ?``). Keeping a turn is free, changing its role to
    user or assistant costs 3, deleting it 4, which blank and duplicate ones require, putting in an empty user or
    assistant turn 3; a truncated turn that stays costs 3 more. ``audit`` has the initials of the edits in order; of
    equally cheap ones the least in ASCII.

    ``summary``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``. ``gaps`` are the numbers missing
    between the first and the last turn (null where that is beyond a bigint), ``illegal`` the neighbours whose role
    initials are none of su, ua, au.

    A null role or text is one space; null ids are one conversation. Roles are known by their first character; of
    any other than s, u, a no turn can be kept. Rows that repeat are duplicates. Other columns are not read. An empty
    table gives none. A conversation of any length is sorted, and its turns judged and repaired, in pieces over many
    tasks; only its letters, a byte for each turn like its audit, meet in one.
    """
    placed = _placed(turns)
    pieces = _pieces(placed)
    solved = _solved(pieces)
    audit = F.translate(F.array_join("segments", ""), STEPS, EDITS)
    found = solved.select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", audit.alias("audit"))
    gaps = _gaps(placed)
    summary = found.join(gaps, same_id(found, gaps)).select(
        found["conv_id"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )
    return Repaired(summary, _repaired_turns(placed, pieces, solved))


def _repaired_turns(placed: DataFrame, pieces: DataFrame, solved: DataFrame) -> DataFrame:
    segments = solved.select("conv_id", F.explode(F.arrays_zip("pieces", "segments")).alias("s"))
    segments = segments.select("conv_id", F.col("s.pieces").alias("piece"), F.col("s.segments").alias("segment"))
    at = pieces.join(segments, same_id(pieces, segments) & (pieces["piece"] == segments["piece"]))
    at = landed(at.select(pieces["conv_id"], "places", "segment"), "segments")
    steps = F.regexp_extract_all("segment", F.lit("[UA]*[kuad]"), F.lit(0))
    each = at.select("conv_id", F.explode(F.arrays_zip("places", steps.alias("steps"))).alias("e"))
    each = each.select("conv_id", F.col("e.places").alias("place"), F.col("e.steps").alias("steps"))

    stays = each.select("place", F.substring("steps", -1, 1).alias("step")).where("step <> 'd'")
    role = F.when(F.col("step") == "u", "user").when(F.col("step") == "a", "assistant").otherwise(F.col("role"))
    kept = placed.select("conv_id", "place", "role", "text").join(stays, "place")
    kept = kept.select("conv_id", "place", F.lit(2).alias("step"), role.alias("role"), "text")

    behind = at.select("conv_id", F.element_at("places", -1).alias("place"), F.regexp_extract("segment", "[UA]*$", 0).alias("given"), F.lit(3).alias("first"))
    ahead = each.select("conv_id", "place", F.regexp_extract("steps", "^[UA]*", 0).alias("given"), F.lit(0).alias("first"))
    given = ahead.unionByName(behind).where("given <> ''")
    given = given.select("conv_id", "place", "first", F.posexplode(F.split("given", "")).alias("n", "letter")).where("letter <> ''")
    put_in = given.select(
        "conv_id", "place", (F.col("first") + F.col("n")).alias("step"),
        F.when(F.col("letter") == "U", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"),
    )
    return kept.unionByName(put_in)


def transcript_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of each conversation's ``role:text`` in order, joined by newlines.

    SHA-256 reads from the beginning to the end: a conversation's turns run through one task, one batch at a time.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("sha256", pa.string())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, begun = None, None, False
        for rows in batches:
            done = []
            for conv_id, role, text in zip(*(rows[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if not begun or conv_id != current:
                    if begun:
                        done.append((current, digest.hexdigest()))
                    current, digest, begun = conv_id, hashlib.sha256(), True
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield batch(schema, zip(*done))
        if begun:
            yield batch(schema, [[current], [digest.hexdigest()]])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")
    return ordered.select("conv_id", "role", "text").mapInArrow(digests, "conv_id bigint, sha256 string")
