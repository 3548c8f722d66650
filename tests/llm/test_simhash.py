import numpy as np
import pytest

from lectern.llm import simhash
from tests.llm import brute

SCHEMA = "doc_id bigint, text string, fingerprint string, component_id string"


def _rows(texts):
    return [(i, t, "x", None) for i, t in enumerate(texts)]


def test_every_close_pair_meets_at_an_anchor():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    for bits in range(5):
        other = base.copy()
        for i in range(len(other)):
            for b in rng.choice(64, bits, replace=False):
                other[i] ^= np.uint64(1 << int(b))
        keys, rows = simhash.anchors(np.concatenate([base, other]))
        at = [set() for _ in range(2 * len(base))]
        for k, r in zip(keys.tolist(), rows.tolist()):
            at[r].add(k)
        assert all(at[i] & at[i + len(base)] for i in range(len(base)))


@pytest.mark.parametrize("size", [30, 400])
def test_links_join_what_brute_force_joins(size):
    rng = np.random.default_rng(size)
    values = rng.integers(0, 1 << 20, size, dtype=np.uint64)
    values = np.unique(np.concatenate([values, values ^ np.uint64(9), values ^ np.uint64(1 << 40)]))
    a, b = simhash.bucket_links(np.zeros(len(values), dtype=np.int64), values, 4)
    place = {v: i for i, v in enumerate(values.tolist())}
    label = simhash._smallest_reachable(len(values), np.array([place[x] for x in a.tolist()]), np.array([place[x] for x in b.tolist()]))
    assert label.tolist() == brute.components(list(enumerate(values.tolist())))


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    rows = [(r.doc_id, brute.simhash(r.text)) for r in docs.collect()]
    groups = brute.components(rows)
    assert got == {d: (f"{p:016x}", g) for (d, p), g in zip(rows, groups)}


def test_nulls_empty_ties_and_clashing_columns(spark):
    long = "lorem ipsum dolor " * 40_000
    texts = [None, "", " \n\t", "Ab cd", "ab CD", "one two three four five", long, long]
    rows = [*_rows(texts), (None, "ab cd", "x", None), (None, "alone and without an id", "x", None), (3, "Ab cd", "x", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    prints = [(r[0], brute.simhash(r[1])) for r in rows]
    want = sorted(((d, f"{p:016x}", g) for (d, p), g in zip(prints, brute.components(prints))), key=str)
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["0", "3", "3", "5", "6", "None", "None"]


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_group_of_near_copies(spark):
    words = [f"w{i}" for i in range(60)]
    rows = _rows([" ".join([*words[:30], f"x{i}", *words[30:]]) for i in range(300)] + ["other words here " + str(i) for i in range(20)])
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    prints = [(r[0], brute.simhash(r[1])) for r in rows]
    assert got == [(d, g) for (d, _), g in zip(prints, brute.components(prints))]
