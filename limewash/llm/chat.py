"""Conversations as one training text each, with a loss mask, and back again.

A message looks like ``<|im_start|>role⏎text<|im_end|>⏎``; adjacent turns of one role share a
message, their texts parted by ``<|turn|>``. Texts and roles cannot contain a mark: ``<!`` is
written ``<!!`` and ``<|`` is written ``<!|`` (and a line break in a role ``<!n``), which
``unescape`` undoes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limewash.llm.common import col

START, END, NEXT = "<|im_start|>", "<|im_end|>", "<|turn|>"
BLOCK = 256


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<!"), F.lit("<!!")), F.lit("<|"), F.lit("<!|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<!|"), F.lit("<|")), F.lit("<!!"), F.lit("<!"))


def _escaped_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<!n"))


def _role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<!n"), F.lit("\n")))


def _opening(role: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"))


CLOSING = END + "\n"


def format_chat(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    learn: tuple[str, ...] = ("assistant",), block: int = BLOCK,
) -> DataFrame:
    """One row per conversation: ``conv``, ``parts`` (the text, in pieces to be read one after the
    other) and per part ``loss``, the spans (start, length, in code points of the part) of the texts
    to learn, those of the roles ``learn``.

    Turns are put in order by (turn, role, text), a null turn first; null roles and texts count as
    empty; repeated rows stay. Rows of a null conversation form one conversation. No rows give no
    rows. Other columns of ``df`` are left out.

    Turns meet in blocks of ``block`` turn numbers, so that a long conversation is sorted and merged
    by many tasks; only finished pieces come together. A conversation must fit into one row.
    """
    turns = df.select(
        col(conv).alias("conv"),
        F.coalesce(F.floor(col(turn) / block), F.lit(-(2**62))).alias("block"),
        F.struct(
            col(turn).alias("turn"), F.coalesce(col(role), F.lit("")).alias("role"),
            F.coalesce(col(text), F.lit("")).alias("text"),
        ).alias("t"),
    )
    blocks = turns.groupBy("conv", "block").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    blocks = blocks.withColumn(
        "turns", F.transform("turns", lambda t: F.struct(_escaped_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), t["role"].isin(*learn).alias("learn")))
    )

    def lead(t, i):
        before = F.get(F.col("turns"), i - 1)["role"]
        return F.when(i == 0, "").when(t["role"] == before, NEXT).otherwise(F.concat(F.lit(CLOSING), _opening(t["role"])))

    blocks = blocks.withColumn(
        "turns", F.transform("turns", lambda t, i: F.struct(t["role"].alias("role"), t["text"].alias("text"), t["learn"].alias("learn"), lead(t, i).alias("lead")))
    )
    length = lambda t: F.length(t["lead"]) + F.length(t["text"])
    blocks = blocks.withColumn("lengths", F.transform("turns", length))
    start = lambda t, i: F.aggregate(F.slice("lengths", 1, i), F.lit(0), lambda a, x: a + x) + F.length(t["lead"])
    spans = F.transform("turns", lambda t, i: F.struct(t["learn"].alias("learn"), start(t, i).alias("start"), F.length(t["text"]).alias("length")))
    spans = F.filter(spans, lambda s: s["learn"])
    blocks = blocks.select(
        "conv",
        F.struct(
            "block",
            F.element_at("turns", 1)["role"].alias("first"),
            F.element_at("turns", -1)["role"].alias("last"),
            F.array_join(F.transform("turns", lambda t: F.concat(t["lead"], t["text"])), "").alias("body"),
            F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("loss"),
        ).alias("b"),
    )
    whole = blocks.groupBy("conv").agg(F.sort_array(F.collect_list("b")).alias("blocks"))

    def joined(b, i):
        before, after = F.get(F.col("blocks"), i - 1), F.get(F.col("blocks"), i + 1)
        lead = F.when((i > 0) & (before["last"] == b["first"]), NEXT).otherwise(_opening(b["first"]))
        tail = F.when(after.isNotNull() & (after["first"] == b["last"]), "").otherwise(CLOSING)
        return F.struct(
            F.concat(lead, b["body"], tail).alias("text"),
            F.transform(b["loss"], lambda s: F.struct((s["start"] + F.length(lead)).alias("start"), s["length"].alias("length"))).alias("loss"),
        )

    parts = F.transform("blocks", joined)
    return whole.select(
        F.col("conv").alias(conv), F.transform(parts, lambda p: p["text"]).alias("parts"), F.transform(parts, lambda p: p["loss"]).alias("loss")
    )


def parse_chat(parts: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    messages = F.filter(F.split(F.array_join(parts, ""), "\\Q" + START + "\\E"), lambda m: m != "")

    def turns(m):
        body = F.regexp_replace(m, "\\Q" + END + "\\E\n$", "")
        at = F.instr(body, "\n")
        role = F.substring(body, 1, F.lit(0) + at - 1)
        texts = F.split(F.substring(body, at + 1, F.length(body)), "\\Q" + NEXT + "\\E")
        return F.transform(texts, lambda t: F.struct(_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def learned_text(parts: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, one text after the other."""
    read = F.zip_with(parts, loss, lambda p, spans: F.array_join(F.transform(spans, lambda s: unescape(F.substring(p, s["start"] + 1, s["length"]))), ""))
    return F.array_join(read, "")
