"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The marks of the template. A message is START role NEWLINE texts END NEWLINE; the texts of
#: adjacent turns with the same role are one message, with NEXT between them.
START, END, NEXT = "<|im_start|>", "<|im_end|>", "<|im_next|>"

#: The role whose texts are under the loss mask.
LEARNT = "assistant"

#: A line break in a role, which would end it.
BREAK = "<|nl|>"

#: Every mark begins with MARK. In roles and texts ``<|`` and ``<\`` are written with one backslash
#: after the ``<``, so no mark can come out of a text, and taking that backslash away undoes it.
MARK = "<|"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(?=\\*\|)", r"<\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(?=\\*\|)", "<")


def format_turns(
    turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """One row for each conversation: ``conv_id`` and ``formatted``.

    Turns come by ``turn``, those with equal or null numbers by role and text, null numbers first.
    Line breaks in roles get a mark of their own. Null roles and texts count as empty, a null ``conv_id`` is a conversation, rows that are
    repeated are turns of their own, and other columns are left out. A conversation is one row of
    the result, so its turns meet in one task.
    """
    own = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).cast("long").alias("turn"),
            F.coalesce(F.col(role), F.lit("")).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        ).alias("turn"),
    )
    sorted_turns = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    at = F.transform("turns", lambda t, i: F.struct(
        (F.coalesce(F.get("turns", i - 1)["role"] == t["role"], F.lit(False))).alias("same"),
        F.replace(escaped(t["role"]), F.lit("\n"), F.lit(BREAK)).alias("role"), escaped(t["text"]).alias("text"),
    ))
    merged = F.transform("turns", lambda t: F.concat(
        F.when(t["same"], F.lit(NEXT)).otherwise(F.concat(F.lit(f"{END}\n{START}"), t["role"], F.lit("\n"))), t["text"],
    ))
    return (
        sorted_turns.withColumn("turns", at)
        .select("conv_id", F.concat(F.array_join(merged, ""), F.lit(f"{END}\n")).alias("formatted"))
        .withColumn("formatted", F.expr(f"substring(formatted, {len(END) + 2})"))  # ends no message
    )


def read_turns(formatted: DataFrame, column: str = "formatted") -> DataFrame:
    """``formatted`` with ``turns``, an array of ``role`` and ``text`` read back from the column,
    adjacent turns of one role apart again. Null reads as no turn."""
    messages = F.filter(F.split(F.coalesce(F.col(column), F.lit("")), r"<\|im_start\|>", -1), lambda m: m != "")
    turns = F.flatten(F.transform(messages, lambda m: _turns(m)))
    return formatted.withColumn("turns", turns)


def _turns(message: Column) -> Column:
    line = F.instr(message, "\n")
    role = F.replace(F.substring(message, F.lit(1), line - 1), F.lit(BREAK), F.lit("\n"))
    texts = F.substring(message, line + 1, F.length(message) - line - len(END) - 1)
    return F.transform(F.split(texts, r"<\|im_next\|>", -1), lambda t: F.struct(
        unescaped(role).alias("role"), unescaped(t).alias("text"),
    ))


def loss_text(turns: Column) -> Column:
    """All text under the loss mask: the learnt role's texts in order, nothing between them."""
    learnt = F.filter(turns, lambda t: t["role"] == LEARNT)
    return F.array_join(F.transform(learnt, lambda t: t["text"]), "")
