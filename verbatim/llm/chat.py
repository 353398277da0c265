"""Chat formatting as relational work: collect the turns of a conversation, sort them, merge runs of one role, concatenate.

The template opens a block with ``<|im_start|>role`` and a line end, closes it with ``<|im_end|>`` and a line end, and parts
merged turns of one role with ``<|im_sep|>``. A control string always begins with ``<|``; inside texts a backslash doubles
and ``<|`` becomes ``<\\|``, so texts can say anything and come back unchanged. Roles are percent-encoded.

A conversation is the unit of the result, so its turns meet in one row by design; nothing is collected across
conversations. All steps are linear in the length of a conversation.

Defined results: null text and null role count as empty; turns with equal (or null) number sort by role and text, null
numbers first, repeated rows stay; conversations with a null id form one conversation; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|im_sep|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def format_chats(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, and ``pieces`` (text, loss), whose texts join to ``formatted``.

    ``pieces`` is the loss mask: true for the escaped texts of the trained roles, false for markers and other roles.
    """
    row = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    role_at = lambda k: F.get("turns", k)["role"]
    starts = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1))
    )
    runs = sorted_turns.select("conv_id", "turns", starts.alias("starts"))

    def block(first: Column, k: Column) -> Column:
        after = F.coalesce(F.get("starts", k + 1), F.size("turns"))
        texts = F.transform(F.slice("turns", first + 1, after - first), lambda t: escape(t["text"]))
        return F.struct(role_at(first).alias("role"), texts.alias("texts"))

    merged = runs.select("conv_id", F.transform("starts", block).alias("blocks"))

    def pieces_of(b: Column) -> Column:
        marker = lambda text: F.struct(text.alias("text"), F.lit(False).alias("loss"))
        loss = b["role"].isin(*trained)

        def piece(text: Column, k: Column) -> Column:
            own = F.struct(text.alias("text"), loss.alias("loss"))
            return F.when(k == 0, F.array(own)).otherwise(F.array(marker(F.lit(BREAK)), own))

        opening = marker(F.concat(F.lit(START), F.url_encode(b["role"]), F.lit("\n")))
        return F.concat(F.array(opening), F.flatten(F.transform(b["texts"], piece)), F.array(marker(F.lit(f"{END}\n"))))

    out = merged.select("conv_id", F.flatten(F.transform("blocks", pieces_of)).alias("pieces"))
    return out.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"), "pieces")


def read_back(formatted: Column) -> Column:
    """The turns in a formatted conversation: array of (role, text)."""
    opened = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda b: b != "")

    def block(b: Column) -> Column:
        role = F.url_decode(F.substring_index(b, "\n", 1))
        body = F.regexp_extract(b, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)
        return F.transform(
            F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"))
        )

    return F.flatten(F.transform(opened, block))


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")
