"""Operator 7, chat formatting by event-sourced reconstruction (DataFrame functions only).

A log has rows ``(conv_id, seq, event, message, role, text)``. Events of a message, in order of seq:
``message`` starts it with a text, ``delta`` adds to it, ``edit`` replaces it, ``regenerate`` empties it and withdraws
every later message of the conversation that began before that event. Folding gives the final messages; those are
rendered with turn marks and a loss mask, and can be read back from the rendered text alone.

Template: ``<|role|>text</s>`` per turn. Inside texts ``\\``, ``<`` and ``[`` (and ``|`` in roles) become two characters
that begin with a backslash, so no mark or control string can occur in them, and one pass turns them back.
The loss mask is a list of (start, length) in code points of the rendered text, one span per assistant turn.

A conversation is one row of output, so its turns meet in one task; nothing else is gathered. Null texts and roles are
empty; turns tie by role and text; repeated turns each count; a null conv_id is one conversation; an empty log gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a character inside a text becomes, the backslash first.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"))
ROLE_ESCAPES = (*ESCAPES, ("|", "\\p"))
OPEN, CLOSE, END = "<|", "|>", "</s>"


def escaped(text: Column, rules=ESCAPES) -> Column:
    for plain, code in rules:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, rules=ESCAPES) -> Column:
    for plain, code in reversed(rules):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def folded(log: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages of an event log, by window functions over each conversation."""
    by_message = Window.partitionBy("conv_id", "message")
    upto = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    known = (
        log.select("conv_id", "seq", "event", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("began", F.min("seq").over(by_message))
        .withColumn("reset", F.max(F.when(F.col("event") != "delta", F.col("seq"))).over(by_message))
        .withColumn("redone", F.filter(F.collect_list(F.when(F.col("event") == "regenerate", F.struct("began", "seq"))).over(upto), lambda r: r.isNotNull()))
    )
    withdrawn = F.exists("redone", lambda r: (r["began"] < F.col("began")) & (F.col("began") < r["seq"]))
    kept = known.where(~withdrawn & (F.col("reset").isNull() | (F.col("seq") >= F.col("reset"))))
    part = F.struct("seq", F.when(F.col("event") == "regenerate", F.lit("")).otherwise(F.col("text")).alias("text"))
    return (
        kept.groupBy("conv_id", "message", F.col("began").alias("turn"))
        .agg(F.max("role").alias("role"), F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x["text"]), "").alias("text"))
        .select("conv_id", "turn", "role", "text")
    )


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of final messages (conv_id, turn, role, text)."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = lambda t: F.concat(F.lit(OPEN), escaped(t["role"], ROLE_ESCAPES), F.lit(CLOSE))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    sized = F.transform("pieces", lambda p: F.struct(F.length(p["head"]).alias("head"), F.length(p["body"]).alias("body"), p["loss"].alias("loss")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(
        "sizes",
        empty,
        lambda acc, p: F.struct(
            (acc["at"] + p["head"] + p["body"] + len(END)).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["head"]).alias("start"), p["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return (
        messages.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .withColumn("pieces", pieces)
        .withColumn("sizes", sized)
        .select("conv_id", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("formatted"), spans["spans"].alias("loss_mask"))
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a rendered conversation."""
    parts = F.split(formatted, END)
    whole = F.slice(parts, 1, F.size(parts) - 1)
    return F.transform(
        whole,
        lambda p: F.struct(
            unescaped(F.substring(F.substring_index(p, CLOSE, 1), len(OPEN) + 1, 1 << 30), ROLE_ESCAPES).alias("role"),
            unescaped(p.substr(F.locate(CLOSE, p) + F.lit(len(CLOSE)), F.length(p))).alias("text"),
        ),
    )


def under_mask(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(mask, lambda m: unescaped(formatted.substr(m["start"] + 1, m["length"]))), "")


def digests(out: DataFrame) -> DataFrame:
    """What a reader of the rendered text finds."""
    return (
        out.withColumn("read", read_back(F.col("formatted")))
        .withColumn("loss", under_mask(F.col("formatted"), F.col("loss_mask")))
        .select(
            "conv_id",
            F.size("read").cast("long").alias("n_turns"),
            F.sha2(F.encode(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), "utf-8"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.encode("loss", "utf-8"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def as_log(conversations: DataFrame) -> DataFrame:
    """Rows by turn as an event log: each row starts a message of its own; equal turns are told apart by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", F.row_number().over(order).alias("seq"), F.lit("message").alias("event"), F.row_number().over(order).alias("message"), "role", "text")
