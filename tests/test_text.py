"""Text functions against plain Python, string by string."""

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import rewards, text as tx

STRINGS = [
    "",
    " a ",
    " x　",
    "\x1cfoo\x85\n",
    "<answer> 1 </answer>",
    "<answer>1</answer><answer>2",
    "no tag",
    r"\boxed{4} then \boxed{ 5 }",
    r"\boxed{\frac{1}{2}}",
    r"\boxed{}",
    "<reasoning>a</reasoning>",
    "</reasoning><reasoning>",
    "<reasoning>",
    "<THINK>\n hi \n</think> <think>b</think>",
    "<think></think>",
    "\\boxed{a\nb}",
]


def boxed(text):
    found = re.findall(r"\\boxed{([^}]*)}", text)
    return found[-1].strip() if found else None


def tagged(text):
    return text.rpartition("<answer>")[2].partition("</answer>")[0].strip()


def thinking(text):
    found = re.search("<think>(.*?)</think>", text, re.S | re.I)
    return found[1].strip() if found else ""


def well_formed(text):
    at, end = text.find("<reasoning>"), text.find("</reasoning>")
    return 1.0 if -1 < at < end else 0.0


def check(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select(
        "i",
        tx.strip_unicode(F.col("t")).alias("stripped"),
        tx.boxed_answer(F.col("t")).alias("boxed"),
        tx.tagged_answer(F.col("t")).alias("tagged"),
        rewards.format_reward(F.col("t")).alias("reward"),
        tx.thinking(F.col("t")).alias("thinking"),
    ).collect()
    for r in rows:
        t = texts[r["i"]]
        assert (r["stripped"], r["boxed"], r["tagged"], r["reward"], r["thinking"]) == (
            t.strip(),
            boxed(t),
            tagged(t),
            well_formed(t),
            thinking(t),
        ), repr(t)


def test_table(spark):
    check(spark, STRINGS)


def test_whitespace_is_what_python_strips():
    every = {chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000}
    assert set(fixed.WHITESPACE) == {c for c in every if c.strip() == ""}
    assert len(fixed.WHITESPACE) == 29


FRAGMENTS = st.sampled_from(
    ["<answer>", "</answer>", "<reasoning>", "</reasoning>", "<think>", "</THINK>", "\\boxed{", "}", "{", "\n", " ", "\u2003", "7", "é", "中"]
)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(FRAGMENTS, max_size=12).map("".join), min_size=30, max_size=60))
def test_random_texts(spark, texts):
    check(spark, texts)


@pytest.mark.parametrize("bad", [None])
def test_null_text(spark, bad):
    df = spark.createDataFrame([(bad,)], "t string")
    row = df.select(
        rewards.format_reward(F.col("t")).alias("f"), rewards.correctness_reward(F.col("t"), F.lit("\\boxed{1}")).alias("c")
    ).first()
    assert (row["f"], row["c"]) == (0.0, 0.0)
