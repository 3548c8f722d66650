import hashlib
import struct

import pytest

from lectern.llm import mixing
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, source string, size string, target string"


def _targets(sizes, weights=(3, 1, 2), budget=1.5, copies=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full: set = set()
    while True:
        left = budget * sum(sizes.values()) - sum(copies * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        new = {s for s in open_ if weight[s] * level > copies * sizes[s]}
        if not new:
            return {s: copies * sizes[s] if s in full else weight[s] * level for s in names}
        full |= new


def _brute(rows):
    size = [len(brute.words(t)) for _, t, _ in rows]
    sizes = {}
    for n, (_, _, s) in zip(size, rows):
        sizes[s] = sizes.get(s, 0) + n
    targets = _targets(sizes)
    order = lambda i: (hashlib.md5(("" if rows[i][0] is None else str(rows[i][0])).encode()).hexdigest(), rows[i][0] is not None, rows[i][0])
    entries, done = [], {}
    for i in sorted(range(len(rows)), key=order):
        s = rows[i][2]
        done[s] = done.get(s, 0) + size[i]
        if size[i]:
            entries += [((done[s] + t * sizes[s]) / targets[s], s is not None, s, order(i), t, i) for t in range(2)]
    left, copies = int(sum(targets.values()) + 0.5), [0] * len(rows)
    for *_, i in sorted(entries):
        left -= size[i]
        if left < 0:
            break
        copies[i] += 1
    return sorted((str(d), n, sizes[s], round(targets[s], 6), c * n) for (d, _, s), n, c in zip(rows, size, copies))


def _got(df):
    return sorted((str(r.doc_id), r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect())


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "own", None) for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = []
    for i in range(400):
        pick = int.from_bytes(hashlib.md5(struct.pack("ii", seed, i)).digest()[:4])
        source = ["a", "a", "a", "b", "ä", "Z", None, "tiny"][pick % 8 if pick % 97 else 7]
        rows.append((i, " ".join(["w"] * (pick // 8 % 60)) if source != "tiny" else "w", source))
    rows += [(None, "no id here", "a"), (500, None, "b"), (501, "", None), (502, "x " * 30_000, "Z")]
    got = _got(mixing.mix(_frame(spark, rows)))
    assert got == _brute(rows)


def test_repeats_and_documents(spark):
    rows = [(7, "one two three", "a")] * 3 + [(8, "four five", "b"), (9, None, "b"), (8, "other text", "b")]
    docs = _frame(spark, rows)
    mixed = mixing.mix(docs)
    assert [r[1:] for r in _got(mixed)] == [r[1:] for r in _brute(rows)]
    shown = mixing.mixed_documents(docs)
    assert shown.columns == docs.columns
    counts = {}
    for r in mixed.collect():
        counts[r.doc_id] = counts.get(r.doc_id, 0) + r.n_copies
    for doc, n in counts.items():
        assert shown.where(f"doc_id = {doc}").count() == n


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(_frame(spark, [(1, "a", "b")]).limit(0)).count() == 0
    assert _got(mixing.mix(_frame(spark, [(1, None, None), (2, " ", "b")]))) == [("1", 0, 0, 0.0, 0), ("2", 0, 0, 0.0, 0)]


def test_every_source_comes_near_its_target(spark, sf_dir):
    mixed = mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for r in mixed.groupBy("source").agg({"taken": "sum", "target": "max", "size": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= r["max(size)"]
    assert mixed.where("taken > 2 * size OR taken % greatest(size, 1) <> 0").count() == 0
