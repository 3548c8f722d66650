"""Row formatting and chat text: hand cases."""

import pytest
from pyspark.sql import functions as F

from lectern import fixed
from lectern.functions import chat
from lectern.operators import formats
from lectern.operators.combine import union_align, union_all
from lectern.operators.conversations import render_conversations
from tests.plans import count


def texts(df, column):
    return [r[column] for r in df.collect()]


def test_blank_problem_gives_way_to_question(spark):
    df = spark.createDataFrame(
        [(" p ", "q"), ("\u2003", " q "), (None, "q"), (None, None), ("p", None)], "problem string, question string"
    )
    assert texts(formats.normalize_columns(df), "problem") == ["p", "q", "q", "", "p"]


def test_absent_columns_are_blank(spark):
    df = spark.createDataFrame([("q",)], "question string")
    row = formats.normalize_columns(df).first()
    assert (row["problem"], row["thinking"], row["solution"]) == ("q", "", "")


def test_instruction_goes_on_blank_problems_too(spark):
    df = formats.add_instruction(spark.createDataFrame([("",), ("p",)], "problem string"))
    assert texts(df, "problem") == [fixed.INSTRUCTION_SUFFIX, "p" + fixed.INSTRUCTION_SUFFIX]


def test_thinking_from_generations(spark):
    df = spark.createDataFrame(
        [
            ("t", ["<think>x</think>"]),
            ("", ["a <Think>\n x \n</THINK> <think>y</think>", "<think>z</think>"]),
            ("", ["none"]),
            ("", []),
            ("", None),
            ("", [None]),
        ],
        "thinking string, generations array<string>",
    )
    assert texts(formats.thinking_from_generations(df), "thinking") == ["t", "x", "", "", "", ""]


def test_response_parts(spark):
    df = spark.createDataFrame([("t", "s"), ("t", ""), ("", "s"), ("", "")], "thinking string, solution string")
    assert texts(formats.assemble_response(df), "response") == [
        "<reasoning>\nt\n</reasoning>\n\n<answer>\ns\n</answer>",
        "<reasoning>\nt\n</reasoning>",
        "<answer>\ns\n</answer>",
        "<answer>\n\n</answer>",
    ]


def test_messages_render_like_the_exchange(spark):
    df = spark.createDataFrame([("p", "r"), ("", "")], "problem string, response string")
    rows = formats.build_messages(df).select(
        chat.render_messages(F.col("messages")).alias("a"),
        chat.render_exchange(F.col("problem"), F.col("response")).alias("b"),
        chat.roles_alternate(F.col("messages")).alias("valid"),
    ).collect()
    assert all(r["a"] == r["b"] and r["valid"] for r in rows)
    assert rows[0]["a"] == "<bos><start_of_turn>user\np<end_of_turn>\n<start_of_turn>model\nr<end_of_turn>\n"


@pytest.mark.parametrize(
    "roles, valid, shown",
    [
        (["user", "model", "user"], True, ["user", "model", "user"]),
        (["user", "assistant"], True, ["user", "model"]),
        (["user", "system", "user"], True, ["user", "user"]),
        (["system", "user"], False, ["user"]),
        (["user", "user"], False, ["user", "user"]),
        (["model"], False, ["model"]),
        ([], True, []),
    ],
)
def test_role_order(spark, roles, valid, shown):
    messages = [(r, f"c{i}") for i, r in enumerate(roles)]
    df = spark.createDataFrame([(messages,)], "m array<struct<role:string,content:string>>")
    row = df.select(
        chat.roles_alternate(F.col("m")).alias("valid"), chat.render_messages(F.col("m"), add_generation_prompt=True).alias("t")
    ).first()
    assert row["valid"] is valid
    assert [p.split("\n")[0] for p in row["t"].split("<start_of_turn>")[1:]] == [*shown, "model"]


TURNS = [
    (1, 0, "user", "a"),
    (1, 1, "assistant", "b"),
    (1, 2, "user", "c"),
    (2, 0, "system", "s"),
    (2, 1, "user", "a"),
    (3, 5, "user", "late"),
    (3, 9, "model", "later"),
]


def conversation_table(spark):
    return spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string")


def test_on_invalid(spark):
    df = conversation_table(spark)
    kept = {r["conv_id"]: r["text"] for r in render_conversations(df).collect()}
    assert kept[2] == "" and kept[3].endswith("later<end_of_turn>\n") and kept[1].count("<start_of_turn>") == 3
    assert {r["conv_id"] for r in render_conversations(df, on_invalid="drop").collect()} == {1, 3}
    with pytest.raises(Exception, match="alternate"):
        render_conversations(df, on_invalid="fail").collect()
    with pytest.raises(ValueError):
        render_conversations(df, on_invalid="ignore")


def test_repeated_turns_are_invalid(spark):
    copies = [(9, 0, "user", "a")] * 40 + [(9, 1, "model", "b"), (None, 0, "user", "x"), (None, 1, "model", "y")]
    mixed = [(8, 0, "user", "a"), (8, 0, "model", "b")]
    df = spark.createDataFrame(copies + mixed, "conv_id bigint, turn bigint, role string, text string")
    every = df.unionByName(conversation_table(spark))
    for options in ({}, {"turns_per_part": 1}, {"turns_per_part": 6}):
        rows = {}
        for r in render_conversations(every, **options).collect():
            rows.setdefault(r["conv_id"], []).append(r)
        for conv_id, n in ((9, 41), (None, 2)):
            assert sum(r["n_turns"] for r in rows[conv_id]) == n
            assert {(r["valid"], r["text"]) for r in rows[conv_id]} == {(False, "")}
    assert {r["conv_id"] for r in render_conversations(df, on_invalid="drop").collect()} <= {8}
    with pytest.raises(Exception, match="alternate"):
        render_conversations(df.where("conv_id = 9"), on_invalid="fail").collect()


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_parts_are_the_whole_conversation(spark, small_dir, size):
    """Splitting long conversations changes neither their text nor whether they are valid."""
    real = spark.read.parquet(f"{small_dir}/conversations.parquet").where("conv_id > 3").unionByName(conversation_table(spark))
    options = dict(add_generation_prompt=True)
    whole = {r["conv_id"]: r for r in render_conversations(real, **options).collect()}
    parts = {}
    for r in sorted(render_conversations(real, turns_per_part=size, **options).collect(), key=lambda r: r["part"]):
        parts.setdefault(r["conv_id"], []).append(r)
        assert r["n_turns"] <= size
    assert parts.keys() == whole.keys()
    for conv_id, rows in parts.items():
        assert "".join(r["text"] for r in rows) == whole[conv_id]["text"]
        assert {r["valid"] for r in rows} == {whole[conv_id]["valid"]}
        assert sum(r["n_turns"] for r in rows) == whole[conv_id]["n_turns"]


def test_turns_are_shuffled_once(spark, small_dir):
    turns = spark.read.parquet(f"{small_dir}/conversations.parquet")
    assert count(render_conversations(turns), "Exchange") == 1


def test_turn_numbers_may_be_sparse_or_number_exchanges(spark):
    rows = [(1, 0, "user", "a"), (1, 5000, "assistant", "b")]
    rows += [(2, n, role, f"{role}{n}") for n in (1, 2) for role in ("assistant", "user")]
    rows += [(3, None, "user", "a"), (3, 1, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in render_conversations(df).collect()}
    assert [(got[i]["n_turns"], got[i]["valid"]) for i in (1, 2, 3)] == [(2, True), (4, True), (2, False)]
    said = [p.split("\n")[1] for p in got[2]["text"].split("<start_of_turn>")[1:]]
    assert [s.removesuffix("<end_of_turn>") for s in said] == ["user1", "assistant1", "user2", "assistant2"]


def test_teacher_prompt(spark):
    df = spark.createDataFrame([("i", "x"), ("i", " \u3000"), ("i", None), (None, "x")], "instruction string, input string")
    head = f"<bos><start_of_turn>user\n{fixed.TEACHER_SYSTEM}\n\n"
    tail = "<end_of_turn>\n<start_of_turn>model\n"
    assert texts(formats.teacher_prompt(df), "prompt") == [head + b + tail for b in ("i\n\nx", "i", "i", "\n\nx")]


def test_teacher_prompt_without_instruction_columns(spark):
    df = spark.createDataFrame([("p",)], "problem string")
    assert texts(formats.teacher_prompt(df), "prompt")[0].endswith("tags.\n\n<end_of_turn>\n<start_of_turn>model\n")


def test_teacher_record_of_missing_fields(spark):
    df = spark.createDataFrame([("P", "R", None)], "prompt string, response string, input string")
    assert formats.teacher_record(df).first().asDict() == {
        "instruction": "",
        "input": "",
        "original_output": "",
        "teacher_output": "R",
        "text": "PR",
    }


def test_reward_format_goes_by_columns(spark):
    def shaped(schema, *row):
        return formats.reward_format(spark.createDataFrame([row], schema)).first()

    head = f"{fixed.REWARD_SYSTEM}\n\n"
    both = shaped("problem string, solution string, question string, answer string", None, "s", "q", "a")
    assert (both["prompt"][0]["content"], both["answer"]) == (head, "s")
    asked = shaped("question string, answer string, id int", "q", "a", 7)
    assert (asked["prompt"][0]["content"], asked["answer"], asked["id"]) == (head + "q", "a", 7)
    plain = shaped("text string", "t")
    assert (plain["prompt"][0]["content"], plain["answer"]) == (head + "t", "")
    neither = shaped("question string, thinking string, solution string", "q", "t", "s")
    assert (neither["prompt"][0]["content"], neither["answer"]) == (head, "")
    assert "\\boxed{}" in fixed.REWARD_SYSTEM and "\b" not in fixed.REWARD_SYSTEM


def test_unions(spark):
    a = spark.createDataFrame([(1, "x")], "n int, t string")
    b = spark.createDataFrame([("x", 1), ("x", 1)], "t string, n int")
    assert sorted(map(tuple, union_all([a, b]).collect())) == [(1, "x")] * 3
    c = spark.createDataFrame([(2.0,)], "d double")
    assert sorted(map(tuple, union_align([a, c]).collect()), key=str) == [(1, "x", None), (None, None, 2.0)]
    for combine in (union_all, union_align):
        with pytest.raises(ValueError):
            combine([])


def test_preview_is_cut(spark):
    df = spark.createDataFrame([(2, "b" * 900), (1, "a" * 900)], "k int, text string")
    assert formats.preview(df, ["k"]).collect()[0]["preview"] == "a" * fixed.PREVIEW_CHARS
