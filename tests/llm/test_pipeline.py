"""Every stage of the pipeline against a plain counterpart over what the stage before it kept."""

import pytest

import corpus_pipeline
from lectern.llm import mixing, sharding, toxicity
from lectern.llm.landing import landed
from tests.llm import brute
from tests.llm.test_decontaminate import _held, _plain
from tests.llm.test_mixing import _brute as brute_mix


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(landed(stage(spark, found[-1], sf_dir), name))
    return found


def _rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_order(steps):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "sharding"]
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
    assert set(steps[-1].columns) == {*steps[0].columns, "shard"}


def test_toxic_go(spark, sf_dir, steps):
    model = toxicity.train(steps[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = steps[0].collect()
    scores = model.texts([r.text for r in rows])
    assert {r.doc_id for r, s in zip(rows, scores) if s < 0.7} == set(_rows(steps[1]))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    gone = {r.doc_id for r in rows} - set(_rows(steps[1]))
    assert sum(labels.get(d) == 0 for d in gone) <= 0.02 * sum(v == 0 for v in labels.values())


def test_one_of_each_group_stays(steps):
    prints = [(d, brute.simhash(r.text)) for d, r in sorted(_rows(steps[1]).items())]
    assert {d for (d, _), c in zip(prints, brute.components(prints)) if d == c} == set(_rows(steps[2]))


def test_holders_of_items_go(spark, sf_dir, steps):
    items = [_plain(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = set()
    for d, r in _rows(steps[2]).items():
        words = _plain(r.text)
        if not any(_held(w, words) for w in items):
            kept.add(d)
    assert kept == set(_rows(steps[3]))


def test_mix_and_shards(steps):
    rows = [(r.doc_id, r.text, r.source) for r in steps[3].collect()]
    want = {d: taken // max(size, 1) for d, size, _, _, taken in brute_mix(rows)}
    got = {str(r.doc_id): r["count"] for r in steps[4].groupBy("doc_id").count().collect()}
    assert got == {d: n for d, n in want.items() if n}
    table = sharding.fill_table()
    placed = steps[5].withColumn("slot", sharding.slot_of()).collect()
    assert all(r.shard == sharding.SHARDS[table[r.slot]] for r in placed)
    assert len(placed) == steps[4].count() and mixing.MAX_COPIES == max(got.values())


def test_run_gives_the_last_stage(spark, sf_dir, steps):
    assert corpus_pipeline.run(spark, sf_dir).exceptAll(steps[-1]).count() == 0


def test_stages_on_nulls_and_nothing(spark, sf_dir, steps):
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, None, "s", 0), (2, "", "en", None, 0)], steps[0].schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = landed(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0
