"""Row formatting: column normalisation, responses, messages, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lectern import fixed
from lectern.functions import chat
from lectern.functions.text import blank_to_null, strip_unicode, thinking


def _stripped(df: DataFrame, column: str) -> Column:
    """The stripped column, '' where it is null or the table does not have it."""
    return F.coalesce(strip_unicode(F.col(column)), F.lit("")) if column in df.columns else F.lit("")


def _text(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) if column in df.columns else F.lit("")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Stripped ``problem``, ``thinking`` and ``solution``; a blank problem gives way to ``question``."""
    problem = _stripped(df, "question")
    if "problem" in df.columns:
        problem = F.coalesce(blank_to_null(F.col("problem")), problem)
    return df.withColumns(
        {"problem": problem, "thinking": _stripped(df, "thinking"), "solution": _stripped(df, "solution")}
    )


def add_instruction(df: DataFrame, suffix: str = fixed.INSTRUCTION_SUFFIX) -> DataFrame:
    """The problem, blank or not, followed by the instruction."""
    return df.withColumn("problem", F.concat(F.col("problem"), F.lit(suffix)))


def thinking_from_generations(df: DataFrame) -> DataFrame:
    """Fill a blank ``thinking`` from the first generation, where the table has generations."""
    if "generations" not in df.columns:
        return df
    first = F.coalesce(thinking(F.get(F.col("generations"), F.lit(0))), F.lit(""))
    return df.withColumn("thinking", F.when(F.col("thinking") == "", first).otherwise(F.col("thinking")))


def response_text(think: Column, solution: Column) -> Column:
    """Reasoning block, blank line, answer block; a blank part is left out, but not both."""
    reasoning = F.when(
        think != "", F.concat(F.lit(f"{fixed.REASONING_OPEN}\n"), think, F.lit(f"\n{fixed.REASONING_CLOSE}"))
    )
    answer = F.when(
        (solution != "") | (think == ""),
        F.concat(F.lit(f"{fixed.ANSWER_OPEN}\n"), solution, F.lit(f"\n{fixed.ANSWER_CLOSE}")),
    )
    return F.concat_ws("\n\n", reasoning, answer)


def assemble_response(df: DataFrame) -> DataFrame:
    return df.withColumn("response", response_text(F.col("thinking"), F.col("solution")))


def build_messages(df: DataFrame) -> DataFrame:
    """``messages``: the problem as user turn, the response as model turn."""
    return df.withColumn("messages", chat.message_list(("user", F.col("problem")), ("model", F.col("response"))))


def format_exchange(df: DataFrame, *, instruction: bool, generations: bool) -> DataFrame:
    """``source``, ``row_key``, ``problem`` and ``response`` of a source of any supported shape.

    ``empty_prompt`` tells rows whose problem was blank before the instruction was added, ``empty_response`` those
    that have neither thinking nor a solution.
    """
    df = normalize_columns(df)
    df = df.withColumn("empty_prompt", F.col("problem") == "")
    if instruction:
        df = add_instruction(df)
    if generations:
        df = thinking_from_generations(df)
    df = df.withColumn("empty_response", (F.col("thinking") == "") & (F.col("solution") == ""))
    return assemble_response(df).select("source", "row_key", "problem", "response", "empty_prompt", "empty_response")


def teacher_prompt(df: DataFrame, bos: str = fixed.BOS) -> DataFrame:
    """``prompt``: system text, instruction and, if not blank, input, asking the teacher for an answer."""
    given = _text(df, "input")
    body = F.concat(
        F.lit(f"{fixed.TEACHER_SYSTEM}\n\n"),
        _text(df, "instruction"),
        F.when(strip_unicode(given) != "", F.concat(F.lit("\n\n"), given)).otherwise(F.lit("")),
    )
    return df.withColumn("prompt", chat.render_prompt(body, bos))


def teacher_record(df: DataFrame) -> DataFrame:
    """The five fields of a finished teacher row, out of ``prompt`` and ``response``."""
    return df.select(
        _text(df, "instruction").alias("instruction"),
        _text(df, "input").alias("input"),
        _text(df, "output").alias("original_output"),
        F.col("response").alias("teacher_output"),
        F.concat(F.col("prompt"), F.col("response")).alias("text"),
    )


def reward_format(df: DataFrame) -> DataFrame:
    """``prompt`` as a one-message list and ``answer``; all other columns stay.

    Which columns count is decided by what the table has, never by what a row holds.
    """
    have = set(df.columns)
    if {"problem", "solution"} <= have:
        question, answer = _text(df, "problem"), F.col("solution")
    elif {"question", "answer"} <= have:
        question, answer = _text(df, "question"), F.col("answer")
    else:
        question, answer = _text(df, "text"), F.lit("")
    content = F.concat(F.lit(f"{fixed.REWARD_SYSTEM}\n\n"), question)
    return df.withColumns({"prompt": chat.message_list(("user", content)), "answer": answer})


def preview(df: DataFrame, order: list[str], rows: int = 1, chars: int = fixed.PREVIEW_CHARS) -> DataFrame:
    """The start of the first rows' texts, to look at."""
    return df.orderBy(*order).limit(rows).select(*order, F.substring("text", 1, chars).alias("preview"))
