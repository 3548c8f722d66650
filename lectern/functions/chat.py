"""Chat text out of message arrays or a single exchange."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lectern import fixed

ON_INVALID = ("empty", "drop", "fail")


def turn_text(role: Column, content: Column) -> Column:
    """One rendered turn. Roles other than user, assistant and model render nothing."""
    body = F.coalesce(content, F.lit(""))
    return (
        F.when(role == "user", F.concat(F.lit(fixed.USER_TURN), body, F.lit(fixed.END_OF_TURN)))
        .when(role.isin("assistant", "model"), F.concat(F.lit(fixed.MODEL_TURN), body, F.lit(fixed.END_OF_TURN)))
        .otherwise(F.lit(""))
    )


def turns_text(turns: Column) -> Column:
    """Rendered turns of an array of ``role``/``content`` structs, joined."""
    return F.array_join(F.transform(turns, lambda m: turn_text(m["role"], m["content"])), "")


def roles_alternate(turns: Column, first: int = 0) -> Column:
    """User turns stand exactly at the even positions. ``first`` is the position of the first turn."""
    at_place = F.transform(
        turns, lambda m, i: m["role"].eqNullSafe(F.lit("user")) == ((i + F.lit(first)) % 2 == 0)
    )
    return F.forall(at_place, lambda ok: ok)


def render_messages(messages: Column, bos: str = fixed.BOS, add_generation_prompt: bool = False) -> Column:
    """Chat text of a message array, whether or not its roles alternate."""
    tail = fixed.MODEL_TURN if add_generation_prompt else ""
    return F.concat(F.lit(bos), turns_text(messages), F.lit(tail))


def render_exchange(user: Column, model: Column, bos: str = fixed.BOS) -> Column:
    """Chat text of one user turn and one model turn: always valid, no array needed."""
    return F.concat(F.lit(bos), turn_text(F.lit("user"), user), turn_text(F.lit("model"), model))


def render_prompt(user: Column, bos: str = fixed.BOS) -> Column:
    """Chat text of one user turn that asks for an answer."""
    return F.concat(F.lit(bos), turn_text(F.lit("user"), user), F.lit(fixed.MODEL_TURN))


def message_list(*pairs: tuple[str, Column]) -> Column:
    """Array of ``role``/``content`` structs."""
    return F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in pairs])
