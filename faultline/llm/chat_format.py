"""Chat formatting with relational operators only.

The turns of a conversation are collected as structs and sorted; runs of adjacent turns of one role become one block by array
functions, and blocks are concatenated:

    [INST] role [/INST]text[PART]text</s>

Control strings inside texts and roles are escaped: a zero-width space goes after their first character, one more where some
stand there already, so reading back removes exactly one. The loss mask stands beside the string, as its segments in order, each
with a flag: loss falls on the texts of assistant turns, not on marks.

Nulls and edge cases: a null text or role is empty. A null turn sorts first; equal turn numbers are ordered by role,
then text; repeated rows are repeated turns. A null conv_id is a conversation of its own. An empty table
gives an empty result. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ZW = "​"
_ESCAPE = f"([<\\[])({_ZW}*)(/s>|/?INST\\]|PART\\])"
_UNESCAPE = f"([<\\[]){_ZW}({_ZW}*)(/s>|/?INST\\]|PART\\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_ESCAPE), F.lit(f"$1{_ZW}$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_UNESCAPE), F.lit("$1$2$3"))


def chat_format(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, segments (array of text and loss, whose texts in order are the formatted string), formatted."""
    empty = F.lit("")
    rows = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    talk = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    talk = talk.withColumn("t", F.transform("t", lambda x: F.struct(escape(x["role"]).alias("role"), escape(x["text"]).alias("text"))))
    # 1-based places at which a run of one role begins, with the place after the last turn at the end
    starts = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (i == 1) | (F.element_at("t", i)["role"] != F.element_at("t", F.greatest(i - 1, F.lit(1)))["role"]))
    talk = talk.withColumn("s", F.concat(starts, F.array(F.size("t") + 1)))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block(k: Column) -> Column:
        first = F.element_at("s", k)
        role = F.element_at("t", first)["role"]
        head, tail = F.concat(F.lit("[INST] "), role, F.lit(" [/INST]")), F.array(segment(F.lit("</s>"), F.lit(False)))

        def said(turn: Column, i: Column) -> Column:
            return F.array(segment(F.when(i == 0, head).otherwise(F.lit("[PART]")), F.lit(False)), segment(turn["text"], role == escape(F.lit(loss_role))))

        return F.concat(F.flatten(F.transform(F.slice("t", first, F.element_at("s", k + 1) - first), said)), tail)

    talk = talk.select("conv_id", F.flatten(F.transform(F.sequence(F.lit(1), F.size("s") - 1), block)).alias("segments"))
    return talk.select("conv_id", "segments", F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, text>>, unescaped."""
    blocks = F.filter(F.split(formatted, "</s>"), lambda b: b != "")

    def parse(b: Column) -> Column:
        parts = F.split(b, r" \[/INST\]", 2)
        role = unescape(F.substr(parts[0], F.lit(8)))
        return F.transform(F.split(parts[1], r"\[PART\]"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, parse))


def digest(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: turns read from the formatted string, loss from the mask."""
    loss = F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescape(x["text"])), "")
    rows = chats.select("conv_id", read_back(F.col("formatted")).alias("t"), loss.alias("loss"), F.char_length("formatted").cast("bigint").alias("formatted_chars"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    rows = rows.select("conv_id", F.size("t").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), "loss", "formatted_chars")
    return rows.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
