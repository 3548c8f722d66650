"""Rewards, joins with heavy keys, advantages, losses, funnel."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Observation, functions as F

from lectern import fixed
from lectern.functions import rewards
from lectern.operators import combine, funnel, joins, scoring, softloss
from lectern.plans.score import prompt_requests, scored_groups
from tests.plans import count, plan_text


@pytest.mark.parametrize(
    "text, answer, exact, plain",
    [
        (r"\boxed{1} \boxed{ 2 }", r"so \boxed{2}", 2.0, 2.0),
        (r"\boxed{2} \boxed{1}", r"\boxed{2}", 0.0, 0.0),
        (r"\boxed{}", "", 2.0, 2.0),
        (r"no box", "", 0.0, 0.0),
        (r"\boxed{x}", None, 0.0, 0.0),
        ("5", "5", 0.0, 2.0),
        (" 5 ", "5 ", 0.0, 2.0),
        (r"\boxed{5}", "5", 0.0, 2.0),
        (None, r"\boxed{5}", 0.0, 0.0),
    ],
)
def test_correctness(spark, text, answer, exact, plain):
    df = spark.createDataFrame([(text, answer)], "completion string, answer string")
    assert scoring.with_correctness_reward(df).first()["correctness_reward"] == exact
    assert scoring.with_correctness_reward(df, plain_gold=True).first()["correctness_reward"] == plain


def test_message_lists_score_like_texts(spark):
    text = r"<reasoning>a</reasoning> \boxed{1}"
    df = spark.createDataFrame(
        [([("assistant", text), ("user", "x")], r"\boxed{1}"), ([], r"\boxed{1}")],
        "completion array<struct<role:string,content:string>>, answer string",
    )
    rows = scoring.with_correctness_reward(scoring.with_format_reward(df)).collect()
    assert [(r["format_reward"], r["correctness_reward"]) for r in rows] == [(1.0, 2.0), (0.0, 0.0)]


def test_pluggable_rewards(spark):
    df = spark.createDataFrame([("<reasoning></reasoning>abc",), ("x",)], "completion string")
    specs = [("shape", 1.0, rewards.format_reward), ("size", 0.5, lambda t: F.length(t).cast("double"))]
    assert sorted(r["reward"] for r in scoring.apply_rewards(df, specs).collect()) == [0.5, 1.0 + 0.5 * 26]


def hot_rows(spark, n=3000):
    """A third of all rows on one key, another sixth without a key."""
    rng = random.Random(1)
    keys = [7] * (n // 3) + [None] * (n // 6) + [rng.randrange(100, 400) for _ in range(n - n // 3 - n // 6)]
    rows = [(k, i, float(rng.randrange(4))) for i, k in enumerate(keys)]
    return rows, spark.createDataFrame(rows, "prompt_id int, gen_idx int, reward double").repartition(5)


@pytest.mark.parametrize("rows_per_salt", [1, 50, 10**6])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_plain_join(spark, rows_per_salt, how):
    _, left = hot_rows(spark)
    right = spark.createDataFrame([(k, f"p{k}") for k in [7, *range(100, 350)]] + [(8, "unused"), (7, "twice")], "prompt_id int, p string")
    expected = sorted(map(str, left.join(right, "prompt_id", how).select("prompt_id", "gen_idx", "reward", "p").collect()))
    actual = joins.spread_join(left, right, "prompt_id", how=how, rows_per_salt=rows_per_salt)
    assert sorted(map(str, actual.select("prompt_id", "gen_idx", "reward", "p").collect())) == expected


def test_heavy_keys_are_spread_evenly(spark):
    _, left = hot_rows(spark)
    heavy = joins.heavy_keys(joins.count_keys(left, "prompt_id"), "prompt_id", 50).collect()
    assert {r["_heavy_key"]: r["_salts"] for r in heavy} == {7: 20, None: 10}
    salts = left.where("prompt_id = 7").groupBy(F.pmod(F.xxhash64(*left.columns), F.lit(20))).count().collect()
    assert len(salts) == 20 and max(r["count"] for r in salts) < 90
    counts = {r["prompt_id"]: r["n_rows"] for r in joins.count_keys(left, "prompt_id").collect()}
    for few in (2, 3, 50):
        share = max(1, math.ceil(sum(counts.values()) / few))
        found = {r["_heavy_key"] for r in joins.heavy_keys(joins.count_keys(left, "prompt_id"), "prompt_id", 1, max_keys=few).collect()}
        assert found == {k for k, n in counts.items() if n > share} and len(found) < few


def expected_advantages(rows, eps=1e-4):
    groups = {}
    for k, i, r in rows:
        groups.setdefault(k, []).append((i, r))
    out = {}
    for k, group in groups.items():
        values = [r for _, r in group]
        std = statistics.stdev(values) if len(values) > 1 else 0.0
        for i, r in group:
            out[i] = (r - statistics.fmean(values)) / (std + eps)
    return out


@pytest.mark.parametrize("rows_per_salt", [50, 10**6])
def test_advantages(spark, rows_per_salt):
    rows, df = hot_rows(spark)
    result = scoring.group_advantage(df, rows_per_salt=rows_per_salt).collect()
    expected = expected_advantages(rows)
    assert len(result) == len(rows)
    assert all(math.isclose(r["advantage"], expected[r["gen_idx"]], abs_tol=1e-6) for r in result)
    sums = {}
    for r in result:
        sums[r["prompt_id"]] = sums.get(r["prompt_id"], 0.0) + r["advantage"]
    assert all(abs(s) < 1e-6 for s in sums.values())


def test_advantage_of_single_and_equal_rewards_is_zero(spark):
    df = spark.createDataFrame([(1, 0, 3.0), (2, 0, 2.0), (2, 1, 2.0)], "prompt_id int, gen_idx int, reward double")
    values = [r["advantage"] for r in scoring.group_advantage(df).collect()]
    assert values == [0.0] * 3 and all(math.copysign(1, v) == 1 for v in values)


def test_ordinary_groups_are_shuffled_once_by_prompt(spark, tmp_path):
    hot_rows(spark)[1].write.parquet(str(tmp_path / "rows"))
    plan = plan_text(scoring.group_advantage(spark.read.parquet(str(tmp_path / "rows"))))
    assert "Window [" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_texts_do_not_reach_the_score_join(spark, small_dir, tmp_path):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    completions = docs.select(F.expr("doc_id div 4").alias("prompt_id"), F.expr("int(doc_id % 4)").alias("gen_idx"), F.col("text").alias("completion"))
    prompts = completions.select("prompt_id").distinct().withColumn("answer", F.lit(""))
    scored = scoring.score_completions(completions, prompts)
    assert scored.columns == ["prompt_id", "gen_idx", "format_reward", "correctness_reward"]
    result = scored_groups(completions, prompts, str(tmp_path / "scored"))
    assert result.count() == docs.count()


def test_requests(spark):
    df = spark.createDataFrame([("q", "a")], "question string, answer string")
    assert [r["gen_idx"] for r in prompt_requests(df).collect()] == [0, 1, 2, 3]
    assert combine.generation_requests(df, 1).count() == 1


def softmax_losses(s, t, label, temperature):
    n = min(len(s), len(t))
    s_log = s[:n] / temperature - np.logaddexp.reduce(s[:n] / temperature)
    t_log = t[:n] / temperature - np.logaddexp.reduce(t[:n] / temperature)
    p = np.exp(t_log)
    return -(p * s_log).sum(), (p * (t_log - s_log)).sum(), np.logaddexp.reduce(s) - s[label]


def logit_rows(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for example in range(6):
        for pos in range(5):
            s, t = rng.normal(0, 30, 12), rng.normal(0, 30, 9 if example % 2 else 12)
            label = -100 if example == 5 or pos == example else int(rng.integers(0, 9))
            rows.append((example, pos, label, s.tolist(), t.tolist()))
    return rows


LOGITS = "example_id int, pos int, label int, student array<double>, teacher array<double>"


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("temperature, alpha", [(2.0, 0.5), (1.0, 0.0), (3.0, 1.0)])
def test_losses_against_numpy(spark, temperature, alpha, wide):
    rows = logit_rows()
    df = spark.createDataFrame(rows, LOGITS)
    result = {r["example_id"]: r for r in softloss.soft_label_loss(df, temperature, alpha, wide_vocabulary=wide).collect()}
    for example in range(6):
        tokens = [
            softmax_losses(np.array(s), np.array(t), label, temperature) for e, _, label, s, t in rows if e == example and label != -100
        ]
        soft, kl, hard = np.mean(tokens, axis=0) if tokens else (0.0, 0.0, 0.0)
        r = result[example]
        assert r["n_tokens"] == len(tokens)
        assert np.allclose(
            [r["soft_ce"], r["kl"], r["hard_ce"], r["loss"]],
            [soft * temperature**2, kl * temperature**2, hard, alpha * soft * temperature**2 + (1 - alpha) * hard],
            rtol=1e-9,
            atol=1e-9,
        )


def test_loss_identities(spark):
    rows = softloss.token_losses(spark.createDataFrame(logit_rows(3), LOGITS)).collect()
    counted = [r for r in rows if r["soft_ce"] is not None]
    assert counted and all(r["kl"] >= -1e-12 for r in counted)
    assert all(math.isclose(r["soft_ce"] - r["kl"], r["teacher_entropy"], abs_tol=1e-9) for r in counted)


def test_long_form_equals_arrays(spark):
    rows = [(e, p, label, s[: len(t)], t) for e, p, label, s, t in logit_rows()]
    df = spark.createDataFrame(rows, LOGITS)
    entries = df.select("example_id", "pos", "label", F.posexplode(F.arrays_zip("student", "teacher")).alias("token_id", "e")).select(
        "example_id", "pos", "label", "token_id", "e.student", "e.teacher"
    )
    copied = entries.unionByName(entries.where("token_id = 3")).repartition(7)
    packed = softloss.soft_label_loss(softloss.pack_logits(copied))
    a, b = ([tuple(r) for r in x.orderBy("example_id").collect()] for x in (softloss.soft_label_loss(df), packed))
    assert np.allclose(a, b)


def test_label_outside_the_kept_entries(spark):
    entries = spark.createDataFrame(
        [(1, 0, 50, 3, 1.0, 1.0), (1, 0, 50, 9, 0.0, 0.0)], "example_id int, pos int, label int, token_id int, student double, teacher double"
    )
    for wide in (False, True):
        row = softloss.soft_label_loss(softloss.pack_logits(entries), wide_vocabulary=wide).first()
        assert row["hard_ce"] == 0.0 and abs(row["kl"]) < 1e-12 and row["soft_ce"] > 0


@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_funnel(spark, partitions):
    rows = [("a", 5, False, False), ("a", 0, False, True), ("a", 6, True, False), ("b", 9, False, False)]
    df = spark.createDataFrame(rows, "source string, n_tokens int, empty_prompt boolean, empty_response boolean").repartition(partitions)
    result = {r["source"]: tuple(r)[1:] for r in funnel.prep_funnel(df, 5).collect()}
    assert result == {"a": (3, 1, 1, 1, 2), "b": (1, 0, 1, 1, 0)}


def test_observed_funnel_needs_no_pass_of_its_own(spark, tmp_path):
    rows = [("a", 5, False, False), ("b", 9, True, False)]
    df = spark.createDataFrame(rows, "source string, n_tokens int, empty_prompt boolean, empty_response boolean")
    seen = Observation("funnel")
    funnel.observe_funnel(df, 5, seen).where("n_tokens <= 5").write.parquet(str(tmp_path / "out"))
    assert seen.get == {"loaded": 2, "empty_prompt": 1, "formatted": 1, "too_long": 1, "kept": 1}


def test_report(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 2.0, 3.0), ("a", 0.0, 0.0, 0.0)], "source string, format_reward double, correctness_reward double, reward double"
    )
    assert tuple(scoring.reward_report(df).first()) == ("a", 2, 1.5, 0.5, 0.5)
    assert fixed.GENERATIONS_PER_PROMPT == 4


def test_positions_that_cannot_be_judged_are_counted(spark):
    rows = [(1, 0, 0, [1.0, 2.0], [2.0, 1.0]), (1, 1, 0, [], [1.0]), (1, 2, 0, [1.0, None], [1.0, 2.0]), (1, 3, 0, None, [1.0]),
            (1, 4, -100, [], []), (1, 5, None, [1.0], [1.0]), (1, 6, 1, [1.0, 2.0], [float("nan"), 2.0]), (2, 0, 0, [], [])]
    df = spark.createDataFrame(rows, LOGITS)
    sql, wide = (sorted(map(tuple, softloss.soft_label_loss(df, wide_vocabulary=w).collect())) for w in (False, True))
    assert np.allclose(np.array(sql, dtype=float), np.array(wide, dtype=float))
    assert [r[:3] for r in sql] == [(1, 1, 4), (2, 0, 1)]


def test_total_weighs_tokens(spark):
    losses = softloss.soft_label_loss(spark.createDataFrame(logit_rows(1), LOGITS))
    total, rows = softloss.loss_total(losses).first(), losses.collect()
    tokens = sum(r["n_tokens"] for r in rows)
    assert (total["n_examples"], total["n_tokens"]) == (len(rows), tokens)
    for c in ("soft_ce", "kl", "hard_ce", "loss"):
        assert math.isclose(total[c], sum(r[c] * r["n_tokens"] for r in rows) / tokens, rel_tol=1e-12)
    assert tuple(softloss.loss_total(losses.where("false")).first()) == (0, 0, 0.0, 0.0, 0.0, 0.0)


def long_entries(spark, dice, positions=60, width=40):
    rows = []
    for i in range(positions):
        label = dice.choice([-100, None, *range(width + 5)])
        scale = dice.choice([1.0, 30.0, 900.0])
        kept = dice.sample(range(width + 5), dice.randrange(1, width))
        some = [(i // 7, i % 7, label, k, dice.gauss(0, scale), dice.gauss(0, scale)) for k in kept]
        rows += some + some[:2] * dice.randrange(2)
        if i % 13 == 0:
            rows.append((i // 7, i % 7, label, 99, dice.choice([None, math.nan]), 1.0))
    return spark.createDataFrame(rows, "example_id bigint, pos int, label int, token_id int, student double, teacher double")


@pytest.mark.parametrize("partitions", [1, 9])
def test_losses_of_entries_equal_those_of_gathered_ones(spark, partitions):
    entries = long_entries(spark, random.Random(5)).repartition(partitions)
    gathered = {r["example_id"]: r for r in softloss.soft_label_loss(softloss.pack_logits(entries)).collect()}
    summed = {r["example_id"]: r for r in softloss.soft_label_loss_of_entries(entries).collect()}
    assert gathered.keys() == summed.keys() and sum(r["n_refused"] for r in summed.values()) > 0
    for k, r in gathered.items():
        for c, expected in r.asDict().items():
            assert summed[k][c] == pytest.approx(expected, rel=1e-9, abs=1e-9), (k, c)


def test_entries_are_never_gathered(spark):
    plan = plan_text(softloss.entry_losses(long_entries(spark, random.Random(1), 3), unique=True))
    # Only bands are gathered, and what is below has been summed up by then.
    assert plan.count("partial_collect_list") == 1 and "partial_collect_list(struct(raw_band" in plan
    assert plan.index("partial_collect_list") < plan.index("partial_sum")


def test_total_of_losses_weighs_each_by_its_own_tokens(spark):
    rows = [
        (1, 0, 0, [1.0, 2.0], [1.0, 1.0]), (1, 1, 5, [1.0, 2.0], [1.0, 1.0]), (1, 2, 6, [1.0, 2.0], [1.0, 1.0]),
        (2, 0, 1, [9.0, 2.0], [0.0, 1.0]), (3, 0, 7, [9.0, 2.0], [0.0, 1.0]),
    ]
    logits = spark.createDataFrame(rows, "example_id int, pos int, label int, student array<double>, teacher array<double>")
    tokens = [r for r in softloss.token_losses(logits).collect()]
    total = softloss.loss_total(softloss.soft_label_loss(logits)).first()
    hard = [r["hard_ce"] for r in tokens if r["hard_ce"] is not None]
    assert len(hard) == 2 and total["hard_ce"] == pytest.approx(sum(hard) / 2)
    assert total["soft_ce"] == pytest.approx(4 * sum(r["soft_ce"] for r in tokens) / 5)
    assert total["loss"] == pytest.approx((total["soft_ce"] + total["hard_ce"]) / 2)


def test_null_keys_of_a_left_join_are_spread(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit("a")).alias("k"), "id")
    joined = joins.spread_join(rows, spark.createDataFrame([("a", 1), (None, 2)], "k string, v int"), "k", how="left")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        nulls = joined.where("k IS NULL").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert joined.count() == 4000 and joined.where("k IS NULL AND v IS NOT NULL").count() == 0
    assert len(nulls) > 1 and max(r["count"] for r in nulls) < 1000
