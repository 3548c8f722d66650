"""Generation with failures, resuming, whole jobs."""

from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import Observation, functions as F

from lectern import fixed
from lectern.operators import generate, tokens
from lectern.operators.funnel import group_counts, observe_groups
from lectern.operators.resume import pending_rows
from lectern.plans import catalog, prepare, teacher
from lectern.streaming.incremental import run_incremental


def instruction_table(spark, n=20):
    return spark.range(n).select(
        "id", F.concat(F.lit("do "), F.col("id").cast("string")).alias("instruction"), F.lit("").alias("input"), F.lit("x").alias("output")
    )


def load_moody():
    """Fails on batches holding row 5, gives too few responses on those holding row 14."""

    def run(batch):
        if any("do 5<" in p for p in batch):
            raise RuntimeError("out of memory")
        return [" done \n" for p in batch if "do 14<" not in p]

    return run


def test_failed_batches_fail_row_by_row(spark):
    df = instruction_table(spark).coalesce(1)
    rows = teacher.teacher_rows(df, load_moody, order=("id",), batch_size=4).collect()
    for partitions in (1, 3):
        again = teacher.teacher_rows(df.repartition(partitions), load_moody, order=("id",), batch_size=4).collect()
        assert sorted(again, key=lambda r: r["id"]) == sorted(rows, key=lambda r: r["id"])
    assert sorted(r["id"] for r in rows) == list(range(20))
    errors = {r["id"]: r["error"] for r in rows if r["error"]}
    assert set(errors) == {5, 14}
    assert errors[5] == "RuntimeError: out of memory" and errors[14].startswith("ValueError: 0 responses")
    assert all(r["response"] == "done" for r in rows if r["id"] not in errors)
    assert all(r["response"] is None for r in rows if r["id"] in errors)


def test_generated_rows_are_written_once_and_split(spark, tmp_path):
    path = str(tmp_path / "generated")
    generate.write_generated(teacher.teacher_rows(instruction_table(spark).coalesce(1), load_moody, order=("id",)), path)
    written = spark.read.parquet(path)
    assert teacher.quarantined_rows(written).count() == written.where("failed = 'true'").count() == 2
    records = teacher.teacher_records(written)
    assert records.columns == ["instruction", "input", "original_output", "teacher_output", "text"]
    assert records.count() == 18 and all(r["text"].endswith("model\ndone") for r in records.collect())


def test_generator_is_loaded_once_per_task(spark, tmp_path):
    marks = str(tmp_path)

    def load():
        import uuid

        open(f"{marks}/{uuid.uuid4().hex}", "w").close()
        return lambda batch: batch

    df = instruction_table(spark, 3000).repartition(3).withColumn("prompt", F.col("instruction"))
    assert generate.generate_responses(df, load, batch_size=7).where("response IS NOT NULL").count() == 3000
    assert len(list(tmp_path.iterdir())) == 3


def test_head_cap_before_generation(spark):
    rows = teacher.teacher_rows(instruction_table(spark), lambda: lambda b: ["r"] * len(b), max_samples=6, order=("id",)).collect()
    assert sorted(r["id"] for r in rows) == list(range(6))


def test_pending_rows(spark):
    inputs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "row_key string, v int")
    done = spark.createDataFrame([("b", "x"), ("b", "y"), (None, "z")], "row_key string, other string")
    assert sorted(r["row_key"] for r in pending_rows(inputs, done).collect()) == ["a", "c"]
    assert pending_rows(inputs, inputs).count() == 0


def counted(df):
    return tokens.token_count(df.withColumn("text", F.upper("text")))


def test_incremental_run_goes_on_where_it_stopped(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    schema = "k int, text string"

    def add(first, last):
        spark.createDataFrame([(i, f"t {i}") for i in range(first, last)], schema).coalesce(1).write.mode("append").parquet(source)

    def run(**options):
        query = run_incremental(spark, source, spark.createDataFrame([], schema).schema, counted, out, checkpoint, **options)
        query.awaitTermination()
        return sorted(r["k"] for r in spark.read.parquet(out).collect())

    for start in (0, 10, 20):
        add(start, start + 10)
    assert run(max_files=1) == list(range(30))
    assert run() == list(range(30))
    add(30, 35)
    assert run() == list(range(35))
    assert spark.read.parquet(out).where("text = 'T 34' and n_tokens = 2").count() == 1


def test_stopped_in_the_middle(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / p) for p in ("in", "out", "checkpoint"))
    schema = spark.createDataFrame([], "k int, text string").schema
    for i in range(4):
        spark.createDataFrame([(i, "t")], schema).coalesce(1).write.mode("append").parquet(source)
    bomb = tmp_path / "bomb"
    bomb.write_text("")
    flag = str(bomb)

    def explosive(df):
        @F.udf("string")
        def touchy(k, text):
            import os

            if k == 2 and os.path.exists(flag):
                raise RuntimeError("lost")
            return text

        return df.withColumn("text", touchy("k", "text"))

    with pytest.raises(Exception):
        run_incremental(spark, source, schema, explosive, out, checkpoint, max_files=1).awaitTermination()
    partial = spark.read.schema(schema).parquet(out).count()
    assert 0 < partial < 4
    flag = str(tmp_path / "gone")
    run_incremental(spark, source, schema, explosive, out, checkpoint, max_files=1).awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]


@pytest.mark.parametrize("files", [0, 1, 3])
def test_incremental_query_reads_a_table_of_files(spark, tmp_path, files):
    path = str(tmp_path / "documents.parquet")
    docs = spark.createDataFrame([(i, f"t {i}", "en", "s") for i in range(9)], "doc_id long, text string, lang string, source string")
    docs.repartition(max(files, 1)).write.parquet(path)
    if files == 0:
        spark.createDataFrame([], docs.schema).write.mode("overwrite").parquet(path)
    rows = catalog.incremental_format(spark, str(tmp_path)).collect()
    assert sorted(int(r.row_key) for r in rows) == (list(range(9)) if files else [])
    assert all(f"t {r.row_key}" in r.text for r in rows)


def test_incremental_query_reads_a_table_in_one_file(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": [1, 2], "text": ["a b", None], "lang": ["en", None], "source": ["s", "s"]}), tmp_path / "documents.parquet")
    assert sorted(r.row_key for r in catalog.incremental_format(spark, str(tmp_path)).collect()) == ["1", "2"]


def load_words():
    return lambda texts: [[len(w) for w in t.split()] for t in texts]


def encode(df):
    return tokens.encode_with(df, load_words)


def reasoning_table(spark, partitions):
    rows = [("s", f"s:{i:03d}", f"p {i}", "t " * (i % 30), "a") for i in range(200)]
    return spark.createDataFrame(rows, "source string, row_key string, problem string, thinking string, solution string").repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_logit_training_caps_before_it_filters(spark, partitions):
    rows = prepare.logit_training_rows([reasoning_table(spark, partitions)], encode, max_samples=50, max_tokens=45)
    result = {r["row_key"]: r for r in rows.collect()}
    everything = prepare.logit_training_rows([reasoning_table(spark, 1)], encode, max_samples=None, max_tokens=10**6).collect()
    drawn = sorted(everything, key=lambda r: r["order_key"])[:50]
    assert set(result) == {r["row_key"] for r in drawn if r["n_tokens"] <= 45}
    assert 0 < len(result) < 50
    assert all(fixed.INSTRUCTION_SUFFIX in r["text"] for r in result.values())


def test_supervised_keeps_and_cuts(spark):
    rows = prepare.supervised_rows([reasoning_table(spark, 4)], encode, max_tokens=12).collect()
    assert len(rows) == 200 and max(len(r["ids"]) for r in rows) == 12
    assert not any(fixed.INSTRUCTION_SUFFIX in r["text"] for r in rows)


def test_other_columns_are_left_alone(spark):
    big = 2**53 + 1
    df = spark.createDataFrame([(big, "a", None), (None, None, [1]), (big + 2, "c", [])], "k bigint, prompt string, more array<int>")
    got = generate.generate_responses(df, lambda: lambda batch: [p and f" {p} " for p in batch]).collect()
    assert sorted(map(str, got)) == sorted(
        f"Row(k={k}, prompt={p!r}, more={m}, response={p!r}, error={e!r})" for k, p, m, e in [(big, "a", None, None), (None, None, [1], "ValueError: no response"), (big + 2, "c", [], None)]
    )


def test_teacher_job_writes_records_and_quarantine(spark, tmp_path):
    teacher.teacher_job(instruction_table(spark), load_moody, str(tmp_path), max_samples=12, order=("id",), batch_size=5)
    generated = spark.read.parquet(f"{tmp_path}/generated")
    assert sorted((r["id"], r["position"], r["batch_id"]) for r in generated.collect()) == [(i, i, i // 5) for i in range(12)]
    assert spark.read.json(f"{tmp_path}/records").count() == 11
    assert [(r["id"], r["batch_id"]) for r in spark.read.parquet(f"{tmp_path}/quarantine").collect()] == [(5, 1)]


def test_funnel_is_observed_along_the_job(spark):
    from pyspark.sql import Observation

    capped, kept = Observation("capped"), Observation("kept")
    rows = prepare.logit_training_rows([reasoning_table(spark, 4)], encode, max_samples=50, max_tokens=45, capped_rows=capped, kept_rows=kept)
    n = len(rows.collect())
    assert (capped.get["rows"], kept.get["rows"]) == (50, n)


def counting(folder, ends_at=None):
    """Answers, and leaves a file for every prompt; ends the run when it meets ``ends_at``."""

    def load():
        def run(batch):
            import os
            import uuid

            if ends_at is not None and any(f"do {ends_at}<" in p for p in batch):
                os._exit(3)
            for p in batch:
                (folder / uuid.uuid4().hex).write_text(p)
            return ["answer" for _ in batch]

        return run

    folder.mkdir()
    return load


def test_a_stopped_teacher_job_asks_only_the_rest(spark, tmp_path):
    table, path = instruction_table(spark, 40), str(tmp_path / "job")
    job = {"order": ("id",), "batch_size": 5, "commit_rows": 10}
    with pytest.raises(Exception):
        teacher.teacher_job(table, counting(tmp_path / "first", ends_at=23), path, **job)
    ledger = teacher.Ledger(spark, path)
    assert sorted(r["n_rows"] for r in ledger.entries().collect()) == [10, 10]
    assert not (tmp_path / "job" / "records").exists()

    teacher.teacher_job(table, counting(tmp_path / "second"), path, **job)
    asked = sorted(p.read_text() for p in (tmp_path / "second").iterdir())
    assert len(asked) == 20 and all(any(f"do {i}<" in p for p in asked) for i in range(20, 40))
    records = spark.read.json(f"{path}/records")
    assert records.count() == records.select("instruction").distinct().count() == 40
    rows = teacher.Ledger(spark, path).rows(spark.read.parquet(f"{path}/generated").drop("part").schema)
    assert sorted((r["id"], r["position"], r["batch_id"]) for r in rows.collect()) == [(i, i, i // 5) for i in range(40)]

    more = instruction_table(spark, 43)
    teacher.teacher_job(more, counting(tmp_path / "third"), path, **job)
    assert len(list((tmp_path / "third").iterdir())) == 3
    report = {r["n_asked"]: tuple(r)[1:] for r in teacher.teacher_report(teacher.Ledger(spark, path)).collect()}
    assert report[3] == (1, 3, 3, 0) and sorted(report) == [3, 20]


def test_a_finished_teacher_job_asks_nothing(spark, tmp_path):
    table, path = instruction_table(spark, 12), str(tmp_path / "job")
    for n in range(2):
        teacher.teacher_job(table, counting(tmp_path / f"asked{n}"), path, order=("id",), commit_rows=5)
    assert [len(list((tmp_path / f"asked{n}").iterdir())) for n in range(2)] == [12, 0]
    assert spark.read.json(f"{path}/records").count() == 12


def test_failed_rows_are_asked_again_on_demand(spark, tmp_path):
    table, path = instruction_table(spark, 20), str(tmp_path / "job")
    job = {"order": ("id",), "batch_size": 4, "commit_rows": 8}
    quarantine = lambda: [(r["id"], r["batch_id"]) for r in spark.read.parquet(f"{path}/quarantine").orderBy("id").collect()]
    teacher.teacher_job(table, load_moody, path, **job)
    assert quarantine() == [(5, 1), (14, 3)]
    teacher.teacher_job(table, counting(tmp_path / "idle"), path, **job)
    assert list((tmp_path / "idle").iterdir()) == [] and len(quarantine()) == 2
    teacher.teacher_job(table, load_moody, path, ask_failed_again=True, **job)
    assert quarantine() == [(5, 1), (14, 3)]
    teacher.teacher_job(table, counting(tmp_path / "again"), path, ask_failed_again=True, **job)
    assert len(list((tmp_path / "again").iterdir())) == 2 and quarantine() == []
    assert spark.read.json(f"{path}/records").count() == 20


def test_groups_are_counted_as_the_result_is_written(spark, tmp_path):
    rows = [(None if i % 9 == 0 else f"s{i % 4}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "source string, n int").repartition(6)
    seen = {"all": Observation(), "small": Observation(), "none": Observation()}
    small = observe_groups(observe_groups(df, seen["all"]).where("n < 40 AND source <> 's3'"), seen["small"])
    observe_groups(small.where("n < 0"), seen["none"]).write.parquet(str(tmp_path / "out"))
    got = {(r.stage, r.source): r.n_rows for r in group_counts(spark, seen).collect()}
    counts = {"all": Counter(s for s, _ in rows), "small": Counter(s for s, n in rows if n < 40 and s not in (None, "s3")), "none": Counter()}
    assert got == {(stage, s): counts[stage][s] for stage in counts for s in counts["all"]}


def test_too_many_groups_are_not_counted_wrongly(spark, tmp_path):
    seen = Observation()
    observe_groups(spark.range(40_000).withColumn("source", F.col("id").cast("string")), seen).write.parquet(str(tmp_path / "out"))
    with pytest.raises(ValueError, match="groupBy"):
        group_counts(spark, {"all": seen})


def test_a_job_over_repeated_keys_answers_every_row_once(spark, tmp_path):
    rows = instruction_table(spark, 6)
    repeated = rows.unionByName(rows.where("id < 2").withColumn("instruction", F.lit("again")))
    for name, table, n in (("plain", rows, 6), ("repeated", repeated, 8)):
        path = str(tmp_path / name)
        for _ in range(2):
            teacher.teacher_job(table, lambda: lambda batch: ["a" for _ in batch], path, order=("id",), batch_size=2, commit_rows=3)
        assert spark.read.json(f"{path}/records").count() == n
        generated = spark.read.parquet(f"{path}/generated")
        assert sorted(r.position for r in generated.select("position").collect()) == list(range(n))
