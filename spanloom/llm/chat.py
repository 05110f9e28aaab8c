"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context, and only that reply trainable. An
example's text is ``<s>`` and then, turn by turn, ``[INST]role[/INST]text</s>``. Those four control strings are escaped
wherever a role or a text holds them, by one backslash after the first character (``<\\/s>``); a control string that holds backslashes
there already gets one more, so that taking one away gives back exactly what stood there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)\\(/?(?:s>|INST\]))", "$1$2$3")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 target: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (from 0), n_turns, formatted, loss_start and loss_chars, last.

    ``formatted`` is the example's text, ``loss_start`` (from 0) and ``loss_chars`` say in code points which part of it is
    trainable: the escaped text of the reply, without its marks. Turns after the last reply, or of a conversation without
    one, come in a further example with nothing trainable, so that no turn is lost; ``last`` marks the example with all turns.

    Turns go by number, null first, and equal numbers by role and text; repeated rows are turns of their own. Null roles and texts are
    empty. Rows without a conversation id are one conversation. An empty table gives no example. Other columns are not looked at.
    The expansion repeats a context in every later example, so a conversation must fit in one row; conversations never meet.
    """
    each = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    each = each.select("conv_id", "turn", "role", "text", F.concat(F.lit("[INST]"), escaped(F.col("role")), F.lit("[/INST]")).alias("head"),
                       escaped(F.col("text")).alias("body"))
    whole = each.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body"))).alias("t"))
    ends = F.filter(F.sequence(F.lit(1), F.size("t")), lambda i: (F.element_at("t", i)["role"] == target) | (i == F.size("t")))
    cut = whole.select("conv_id", "t", F.posexplode(ends).alias("example", "n_turns"))
    said = F.element_at("t", F.col("n_turns"))
    formatted = F.concat(F.lit("<s>"), F.array_join(F.transform(F.slice("t", 1, F.col("n_turns")), lambda x: F.concat(x["head"], x["body"], F.lit("</s>"))), ""))
    loss = F.when(said["role"] == target, F.length(said["body"])).otherwise(0).cast("long")
    cut = cut.select("conv_id", "example", "n_turns", formatted.alias("formatted"), F.length(said["body"]).alias("end"), loss.alias("loss_chars"),
                     (F.col("n_turns") == F.size("t")).alias("last"))
    return cut.select("conv_id", "example", "n_turns", "formatted", (F.length("formatted") - 4 - F.col("end")).cast("long").alias("loss_start"),
                      "loss_chars", "last")


def parsed(formatted: Column) -> Column:
    """The turns of an example as an array of (role, text), read back from its text."""
    pieces = F.split(F.substr(formatted, F.lit(4)), "</s>")
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescaped(F.substring_index(F.substr(p, F.lit(7)), "[/INST]", 1)).alias("role"),
        unescaped(F.substr(p, F.locate("[/INST]", p) + 7)).alias("text")))
