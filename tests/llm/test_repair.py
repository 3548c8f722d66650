"""Conversation repair: every way by plain recursion, over random and over awkward turns."""

from __future__ import annotations

import hashlib
import random
from functools import lru_cache

from pyspark.sql import functions as F

from lectern.llm import queries, repair
from tests.oracle import connect, differences

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\f\r"


def ordered(rows):
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    found = {}
    for row in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest())):
        found.setdefault(row[0], []).append(row)
    return found


def brute(rows):
    """conv_id -> gaps, blank, duplicate, truncated, illegal, cost, audit, repaired lines."""
    result = {}
    for conv_id, turns in ordered(rows).items():
        faults, seen = [], set()
        for _, _, role, text in turns:
            solid = text.strip(SPACE)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))

        @lru_cache(maxsize=None)
        def best(i, before, put_in):
            """``before``: the initials so far that matter: '', 's', 'u' or 'a'; at most three turns put in at once."""
            ways = []
            if i == len(turns) and before in ("", "a"):
                ways.append((0, "", ()))
            due = "assistant" if before == "u" else "user"
            if put_in < 3:
                cost, audit, lines = best(i, due[0], put_in + 1)
                ways.append((cost + 3, "I" + audit, (f"{due}:", *lines)))
            if i < len(turns):
                role, text = turns[i][2:]
                cost, audit, lines = best(i + 1, before, 0)
                ways.append((cost + 4, "D" + audit, lines))
                if faults[i] not in ("blank", "duplicate"):
                    extra = 3 * (faults[i] == "truncated")
                    if role[:1] == due[0] or role[:1] == "s" and before == "":
                        cost, audit, lines = best(i + 1, role[0], 0)
                        ways.append((cost + extra, "K" + audit, (f"{role}:{text}", *lines)))
                    cost, audit, lines = best(i + 1, due[0], 0)
                    ways.append((cost + extra + 3, "R" + audit, (f"{due}:{text}", *lines)))
            return min(ways, default=(10**9, "", ()))

        for i in range(len(turns), -1, -20):  # from the end, so that no call goes deep
            best(i, "", 0), best(i, "s", 0), best(i, "u", 0), best(i, "a", 0)
        numbers = [t[1] for t in turns if t[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [t[2][:1] for t in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        result[conv_id] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *best(0, "", 0))
    return result


def repaired(df):
    done = repair.repair(df)
    told = {r["conv_id"]: tuple(r)[1:] for r in done.summary.collect()}
    lines = {}
    for r in sorted(done.turns.collect(), key=lambda r: (r["place"], r["step"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    return {c: (*t, tuple(lines.get(c, ()))) for c, t in told.items()}


def random_rows(n, seed):
    dice = random.Random(seed)
    texts = ["Yes.", "Yes.", "No!", "cut", " cut\t", "", " \n", "Who? ", None, "x.y", "é?", "　"]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "u", "Assistant"]
    return [
        (dice.choice([None, *range(n // 6)]), dice.choice([None, -3, *range(9)]), dice.choice(roles), dice.choice(texts))
        for _ in range(n)
    ]


def test_random_turns_are_repaired_as_cheaply_as_can_be(spark):
    rows = random_rows(600, 3)
    found = repaired(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert found == brute(rows)


def test_a_conversation_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(repair, "PIECE_BITS", 2)
    rows = [(1, i, "user" if i % 3 else "assistant", f"{i % 40}" + "." * (i % 5 > 0)) for i in range(300)] + random_rows(30, 5)
    rows = [(1 if i < 320 else 2, *r[1:]) for i, r in enumerate(rows)]
    assert repaired(spark.createDataFrame(rows, SCHEMA).repartition(7)) == brute(rows)


def test_the_least_audit_of_equally_cheap_ones(spark):
    rows = [(1, 0, "assistant", "a."), (2, 0, "user", "a."), (2, 1, "user", "b."), (3, 0, "system", "s.")]
    found = repaired(spark.createDataFrame(rows, SCHEMA))
    assert found[1][5:] == (3, "IK", ("user:", "assistant:a."))
    assert found[2][5:] == (3, "KR", ("user:a.", "assistant:b."))
    assert found[3][5:] == (4, "D", ())


def test_nodes_are_shared_between_signatures_with_one_end():
    path = repair.SuffixPath()
    path.solve("eaei")
    kept = list(path.nodes)
    path.solve("xei")
    assert path.nodes[0] is kept[0] and path.nodes[1] is kept[1] and len(path.nodes) == 3
    repair.before.cache_clear()
    repair.SuffixPath().solve("ei" * 5000)
    assert repair.before.cache_info().misses < 10  # a long conversation meets few different nodes


def test_empty_table_and_clashing_columns(spark):
    empty = repair.repair(spark.createDataFrame([], SCHEMA))
    assert empty.summary.count() == 0 and empty.turns.count() == 0
    rows = [(1, 0, "user", "a.", "own", 7, 8, "z")]
    own = spark.createDataFrame(rows, f"{SCHEMA}, place string, piece bigint, step int, digest string")
    assert repaired(own) == brute([r[:4] for r in rows])


def test_digests_of_long_texts(spark):
    text = "word " * 400_000 + "."
    done = repair.repair(spark.createDataFrame([(None, 0, "user", text), (None, 1, "assistant", "é.")], SCHEMA))
    expected = hashlib.sha256(f"user:{text}\nassistant:é.".encode()).hexdigest()
    assert [tuple(r) for r in repair.transcript_digests(done.turns).collect()] == [(None, expected)]


def test_query_keeps_conversations_that_lose_all_turns(spark, tmp_path):
    rows = random_rows(150, 8) + [(10_000 + i, 0, "user", "Hello.") for i in range(60)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    df = queries.QUERIES["op13_conversation_repair"](spark, str(tmp_path))
    rows = {r["conv_id"]: r for r in df.collect()}
    assert len(rows) == df.select("conv_id").distinct().count()
    lost = [r for r in rows.values() if r["audit"] == ""]
    assert lost and all(r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() and r["cost"] == 0 for r in lost if r["blank"] == 0)


def test_query_equals_its_sql(spark, sf_dir):
    name = "op13_conversation_repair"
    assert differences(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLES[name]) == []


def test_damage_is_by_checksum(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(12) for t in (None, *range(8))]
    found = {}
    for r in queries.damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        found.setdefault((r["conv_id"], r["turn"]), []).append((r["role"], r["text"]))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        expected = {0: None, 1: [(role, "")], 2: [(role, "One Two Three")], 3: [(role, text)] * 2, 4: [("user", text)]}
        assert found.get((c, t)) == expected.get(kind, [(role, text)])
