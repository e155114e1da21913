"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn reads ``<s>role[INST] text [/INST]</s>``. Control strings inside roles and texts
get one more backslash after their first character, so none is left as such and the
inverse takes one away again. Every assistant turn becomes an example of its own: all
turns before it as context, and the mask on that reply alone. A conversation that does not
end with an assistant turn gets one more example, of all turns, with an empty mask, so that
no turn is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
OPEN, BODY, CLOSE = "<s>", "[INST] ", " [/INST]</s>"
ESCAPE = (r"([<\[])(\\*)(/?(?:s>|INST\]))", r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)(/?(?:s>|INST\]))", "$1$2$3")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *map(F.lit, ESCAPE))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *map(F.lit, UNESCAPE))


def examples(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Returns conv_id, example (number of turns in it), formatted, and the mask as
    mask_start and mask_chars (code points; zero characters if nothing is trainable).

    Turns are in the order of turn, role, text (nulls first), repeated rows each count. A
    null role or text is an empty one; only the role ``assistant`` is trainable. Rows with
    a null conv_id are one conversation. An empty table gives no examples; further
    columns are left out. An example holds its whole context, so the output of a
    conversation grows with the square of its turns: that is what the expansion is."""
    clean = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = df.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), clean(role_col).alias("role"), clean(text_col).alias("text")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    shown = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(BODY), escape(t["text"]), F.lit(CLOSE)))
    turns = turns.select("conv_id", "turns", shown.alias("shown"), F.size("turns").alias("n"))
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: (F.get("turns", i - 1)["role"] == "assistant") | (i == F.col("n")))
    rows = turns.select("conv_id", "turns", "shown", F.explode(ends).alias("example"))
    last = F.get("turns", F.col("example") - 1)
    rows = rows.select("conv_id", "example", F.array_join(F.slice("shown", 1, F.col("example")), "").alias("formatted"), F.when(last["role"] == "assistant", F.length(escape(last["text"]))).otherwise(0).alias("mask_chars"))
    return rows.select("conv_id", "example", "formatted", (F.length("formatted") - len(CLOSE) - F.col("mask_chars")).alias("mask_start"), "mask_chars")


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example."""
    pieces = F.split(formatted, "</s>", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    tail = len(CLOSE) - len("</s>")

    def turn(p: Column) -> Column:
        role = F.substr(F.substring_index(p, BODY, 1), F.lit(len(OPEN) + 1))
        at = F.length(role) + len(OPEN) + len(BODY)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(p, at + 1, F.length(p) - at - tail)).alias("text"))

    return F.transform(pieces, turn)


def read_back(rows: DataFrame) -> DataFrame:
    """Of ``examples``: per conversation n_turns, turns_sha256, loss_chars, loss_sha256
    and formatted_chars (of all its examples), from the formatted texts and masks alone."""
    masked = unescape(F.substr("formatted", F.col("mask_start") + 1, F.col("mask_chars")))
    rows = rows.select("conv_id", "example", F.length("formatted").cast("long").alias("chars"), F.struct("example", masked.alias("text")).alias("loss"), "formatted")
    whole = rows.groupBy("conv_id").agg(F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("loss")).alias("losses"), F.max_by("formatted", "example").alias("formatted"))
    whole = whole.select("conv_id", "formatted_chars", F.array_join(F.transform("losses", lambda x: x["text"]), "").alias("loss"), parse(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
