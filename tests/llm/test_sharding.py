import pytest

from lectern.llm import sharding
from lectern.llm.queries import QUERIES


def _brute(shards, slots):
    orders = []
    for s in shards:
        offset, stride = sharding.preference(s, slots)
        orders.append([(offset + j * stride) % slots for j in range(slots)])
        assert sorted(orders[-1]) == list(range(slots))
    table = {}
    while len(table) < slots:
        for number, order in enumerate(orders):
            if len(table) < slots:
                table[next(x for x in order if x not in table)] = number
    return [table[i] for i in range(slots)]


@pytest.mark.parametrize(("n", "slots"), [(1, 7), (3, 101), (11, 499)])
def test_table_equals_turn_taking(n, slots):
    shards = [f"s{i}" for i in range(n)]
    table = sharding.fill_table(shards, slots)
    assert table == _brute(shards, slots)
    shares = [table.count(i) for i in range(n)]
    assert max(shares) - min(shares) <= 1


def test_few_slots_move():
    shards = [f"s{i}" for i in range(20)]
    before, after = (sharding.fill_table(x, 4099) for x in (shards, shards[:-1]))
    moved = sum(a != b for a, b in zip(before, after) if a != 19)
    assert moved < 0.1 * 4099


@pytest.mark.parametrize(("shards", "slots"), [([], 7), (["a", "a"], 7), (["a"], 8), (list("abc"), 2)])
def test_bad_tables(shards, slots):
    with pytest.raises(ValueError):
        sharding.fill_table(shards, slots)


def test_whole_table_against_brute_force(spark, sf_dir):
    import hashlib

    table = sharding.fill_table()
    got = {r.doc_id: (r.slot, r.shard) for r in QUERIES["op4_sharding"](spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect():
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert got.pop(r.doc_id) == (slot, sharding.SHARDS[table[slot]])
    assert not got


def test_nulls_repeats_clashes_and_files(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "b", "y"), (2, "", None)], "doc_id bigint, text string, shard string")
    assert sharding.place(docs).count() == 4
    placed = sharding.with_shard(docs)
    assert sorted(placed.columns) == sorted(docs.columns)
    assert placed.where("shard IS NULL").count() == 0
    assert sharding.place(docs.limit(0)).count() == 0
    sharding.write_sharded(docs, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(str, back.select("doc_id", "shard").collect())) == sorted(map(str, placed.select("doc_id", "shard").collect()))
