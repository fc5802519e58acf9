r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the conversation up to and
including that turn, formatted, with only that reply under the loss mask. Turns
after the last reply, and conversations without one, go out as one more row with
an empty mask, so the output holds every turn. A turn is written as
``<|im_start|>role\ntext<|im_end|>\n``; inside texts and roles a backslash becomes
``\s``, ``<|`` becomes ``<\|`` and, in roles only, a line end becomes ``\r``, which
reads back exactly and leaves no control string that a text could have forged.

Turns go by ``turn`` (nulls first), then role and text; a null text or role is
empty. Repeated rows are turns of their own. Rows with a null conversation id
belong to no conversation, so each is a conversation of one turn. An empty
table gives no examples. Texts are kept whole, of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"


def escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\|"))


def unescape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("<\\|"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def _role_out(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit("\\r"))


def _role_in(x: Column) -> Column:
    return unescape(F.replace(x, F.lit("\\r"), F.lit("\n")))


def expand(conversations: DataFrame, target_role: str = "assistant") -> DataFrame:
    """Examples: ``conv_id, target (index of the turn, -1: none), formatted,
    loss_start, loss_length``; spans are in code points of ``formatted``.

    The gathered group is one conversation, the record that an example is cut
    from; its prefixes leave as rows, one at a time.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"))
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    grouped = turns.groupBy("conv_id", lone.alias("lone")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    parts = F.transform("t", lambda x: F.concat(F.lit(START), _role_out(x["role"]), F.lit("\n"), escape(x["text"]), F.lit(END)))
    grouped = grouped.withColumn("parts", parts)
    replies = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda i: F.col("t")[i]["role"] == target_role)
    grouped = grouped.withColumn("replies", replies)
    tail = F.when(F.coalesce(F.try_element_at("replies", F.lit(-1)), F.lit(-1)) < F.size("t") - 1, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>"))
    each = grouped.withColumn("target", F.explode(F.concat("replies", tail)))
    upto = F.when(F.col("target") < 0, F.size("parts")).otherwise(F.col("target") + 1)
    each = each.withColumn("formatted", F.array_join(F.slice("parts", F.lit(1), upto), ""))
    reply = F.get("t", F.col("target"))
    length = F.when(F.col("target") >= 0, F.char_length(escape(reply["text"]))).otherwise(F.lit(0)).cast("long")
    start = F.when(F.col("target") >= 0, F.char_length("formatted") - F.lit(len(END)) - length).otherwise(F.lit(0)).cast("long")
    return each.select("conv_id", "lone", "target", "formatted", start.alias("loss_start"), length.alias("loss_length"))


def parse(formatted: Column) -> Column:
    """Formatted text -> ``array<struct<role, text>>``, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(len(START) + 1), F.char_length(p))
    cut = lambda p: F.instr(body(p), "\n")
    return F.transform(pieces, lambda p: F.struct(_role_in(F.substring(body(p), F.lit(1), cut(p) - 1)).alias("role"), unescape(F.substring(body(p), cut(p) + 1, F.char_length(p))).alias("text")))


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    return unescape(F.substring(formatted, start.cast("int") + 1, length.cast("int")))


def read_back(examples: DataFrame) -> DataFrame:
    """Digests per conversation, computed from the examples alone.

    The longest example has all turns; the masks of the others, in order, have
    each reply once.
    """
    thin = examples.select(
        "conv_id", "lone", "target",
        F.char_length("formatted").cast("long").alias("chars"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"),
        "formatted",
    )
    longest = F.max_by("formatted", F.col("chars"))
    masks = F.sort_array(F.collect_list(F.when(F.col("target") >= 0, F.struct("target", "loss"))))
    out = thin.groupBy("conv_id", "lone").agg(longest.alias("formatted"), F.sum("chars").alias("formatted_chars"), masks.alias("m"))
    turns = parse(F.col("formatted"))
    text = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("m", lambda x: x["loss"]), "")
    return out.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
