"""Chat formatting with typed content parts, in DataFrame expressions only.

A message is an array of parts ``(kind, text, uri, units)``. The visitor turns text parts into
escaped text and image, audio and document parts into placeholders in their order; each placeholder
is recorded as an attachment with its reference and expanded token count (units times a rate).

Template of a turn: ``<s>[INST]`` role ``[/INST]`` body ``</s>``. Control strings inside roles and
texts are escaped reversibly: backslashes are doubled, then one is put behind the first character
of each control string; a lone backslash there cannot come from anything else.

Edge cases: null text, role or parts are empty; turns with equal numbers are ordered by role, then
body; a null conversation id is a conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<|")

#: Tokens that a placeholder stands for, by unit: image tiles, seconds of audio, document pages.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}

PARTS = "array<struct<kind:string,text:string,uri:string,units:bigint>>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in CONTROLS:
        out = F.replace(out, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def text_parts(text: Column) -> Column:
    """One text part, for tables whose messages are plain strings."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), none.cast("string").alias("uri"), none.cast("long").alias("units")))


def visit(parts: Column, rates: dict[str, int] = TOKENS_PER_UNIT) -> tuple[Column, Column]:
    """(body, attachments) of a message's parts; unknown kinds are taken as text."""
    parts = F.coalesce(parts, F.array().cast(PARTS))
    media = lambda p: p["kind"].isin(*rates)
    tokens = lambda p: sum((F.when(p["kind"] == k, F.lit(r)).otherwise(0) for k, r in rates.items()), F.lit(0)) * F.coalesce(p["units"], F.lit(1))
    body = F.array_join(F.transform(parts, lambda p: F.when(media(p), F.concat(F.lit("<|"), p["kind"], F.lit("|>"))).otherwise(escape(F.coalesce(p["text"], F.lit(""))))), "", "")
    found = F.transform(F.filter(parts, media), lambda p: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), tokens(p).cast("long").alias("n_tokens")))
    return body, found


def format_chat(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: ``(conv_id, n_turns, formatted, loss_spans, attachments, n_attachment_tokens)``.

    ``loss_spans`` holds ``(start, length)`` in code points of the bodies of trained roles.
    Running lengths come from a window, so a long conversation is streamed and sorted on disk.
    """
    body, found = visit(F.col(parts))
    turns = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), body.alias("body"), found.alias("attachments"))
    turns = turns.withColumn("head", F.concat(F.lit("<s>[INST]"), escape(F.col("role")), F.lit("[/INST]")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    size = F.length("head") + F.length("body") + 4
    placed = turns.select("conv_id", F.row_number().over(order).alias("at"), F.concat("head", "body", F.lit("</s>")).alias("piece"), (F.sum(size.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("body") - 4).alias("start"), F.length("body").cast("long").alias("length"), F.col("role").isin(*trained).alias("trained"), "attachments")
    all_turns = F.sort_array(F.collect_list(F.struct("at", "piece", "start", "length", "trained", "attachments")))
    return placed.groupBy("conv_id").agg(all_turns.alias("turns")).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns.piece"), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["trained"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
        F.flatten(F.col("turns.attachments")).alias("attachments"),
        F.aggregate(F.flatten(F.col("turns.attachments")), F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]).alias("n_attachment_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted conversation; the inverse of the template."""
    pieces = F.split(formatted, "</s>")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    head = lambda x: F.substring_index(x, "[/INST]", 1)
    return F.transform(pieces, lambda x: F.struct(unescape(F.substring(head(x), F.lit(10), F.length(x))).alias("role"), unescape(F.substring(x, F.length(head(x)) + 8, F.length(x))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
