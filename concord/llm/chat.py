"""Chat formatting by prefix-target expansion (operator 3), with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable.
A turn is written as '### role: text</turn>' and a line feed. Inside texts and roles a backslash becomes '\\b', '###'
becomes '\\h' and '</turn>' becomes '\\t' (in roles also ':' becomes '\\c'), so that in the output a backslash always
begins an escape, the marks stand only where the template put them, and replacing '\\h', '\\t', '\\c' and last '\\b'
brings every text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
#: The template's marks.
OPEN, CLOSE = "### ", "</turn>\n"
#: Text inside a turn and what stands for it; the backslash comes first.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escape(text: Column, pairs: tuple = ESCAPES) -> Column:
    for raw, code in pairs:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column, pairs: tuple = ESCAPES) -> Column:
    for raw, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def expand(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) to (conv_id, example, formatted, loss_start, loss_chars, last).

    loss_start (from 0) and loss_chars mark the trainable code points of formatted: the target's escaped text, without
    its marks. Examples are numbered from 1; last marks a conversation's last one. Turns that follow the last assistant
    turn would be lost, so a conversation that does not end with one gets a closing example without a target
    (loss_chars 0, loss_start null). Turns are ordered by turn, then role and text; null turns come first, and
    repeated rows stay repeated. A null text or role is written as empty; rows with a null conv_id are one
    conversation. Other columns are ignored; no rows give no examples.

    A conversation's turns meet in one row, as its last example holds them all by definition."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
    by = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    head = lambda x: F.concat(F.lit(OPEN), escape(x["role"], ROLE_ESCAPES), F.lit(": "))
    parts = F.transform("t", lambda x: F.struct((x["role"] == TRAINED_ROLE).alias("own"), head(x).alias("head"), escape(x["text"]).alias("body")))
    whole = by.select("conv_id", parts.alias("p")).withColumn("n", F.size("p"))
    is_target = lambda i: F.element_at("p", i)["own"]
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: is_target(i) | (i == F.col("n")))
    each = whole.withColumn("turns", F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE)))).select(
        "conv_id", "p", "n", "turns", F.posexplode(ends).alias("k", "i")
    )
    target = F.element_at("p", F.col("i"))
    before = F.array_join(F.slice("turns", 1, F.col("i") - 1), "")
    return each.select(
        "conv_id",
        (F.col("k") + 1).alias("example"),
        F.concat(before, F.element_at("turns", F.col("i"))).alias("formatted"),
        F.when(target["own"], F.length(before) + F.length(target["head"])).cast("long").alias("loss_start"),
        F.when(target["own"], F.length(target["body"])).otherwise(0).cast("long").alias("loss_chars"),
        (F.col("i") == F.col("n")).alias("last"),
    )


def trained_text(examples: DataFrame) -> Column:
    """The text under an example's loss mask, as it was before formatting."""
    start, n = F.coalesce("loss_start", F.lit(0)), F.col("loss_chars")
    return unescape(F.substring(F.col("formatted"), (start + 1).cast("int"), n.cast("int")))


def read_turns(formatted: Column) -> Column:
    """The turns array<struct<role,text>> of a formatted text."""
    pieces = F.split(formatted, CLOSE)
    own = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(x: Column) -> Column:
        line = F.substr(x, F.lit(len(OPEN) + 1))
        role = F.substring_index(line, ": ", 1)
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(F.substr(line, F.length(role) + 3)).alias("text"))

    return F.transform(own, turn)


def read_back(examples: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the formatted examples alone."""
    got = examples.select(
        "conv_id",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("last"), F.col("formatted")).alias("whole"),
        F.struct("example", trained_text(examples).alias("text")).alias("loss"),
    )
    by = got.groupBy("conv_id").agg(
        F.max("whole").alias("whole"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("loss")).alias("loss")
    )
    lines = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    trained = F.array_join(F.col("loss.text"), "")
    return by.withColumn("turns", read_turns(F.col("whole"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"),
        F.sha2(trained, 256).alias("loss_sha256"),
        "formatted_chars",
    )
