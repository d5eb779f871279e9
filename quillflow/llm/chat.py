"""Chat formatting with typed content parts, with built-in functions only.

A message is a list of parts: text, image, audio or document. Every part is rendered in order: text
with its control characters escaped, the others as a placeholder that names their attachment; the
reference and the number of tokens that the placeholder expands to are recorded beside the text.
A turn reads `<|turn|>role`, a line end, its parts, `<|end|>` and a line end. Rendered texts hold
neither `<` nor `[`, so no control string of any template can come from a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>\n"
# Each control character and its escape; the escape character itself first.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"))
CHUNK_TURNS = 64

# Tokens that a placeholder stands for. size: pixels (width, height), seconds, pages.
PATCH = 28
AUDIO_TOKENS_A_SECOND = 25
PAGE_TOKENS = 512

PART = "struct<type:string,text:string,ref:string,width:double,height:double>"


def escape(text: Column) -> Column:
    for char, code in ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for char, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(char))
    return text


def text_part(text: Column) -> Column:
    """A message of one text part; a null text is empty."""
    empty = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), empty.cast("string").alias("ref"),
        empty.cast("double").alias("width"), empty.cast("double").alias("height")))


def part_tokens(part: Column) -> Column:
    """Tokens that a part other than text expands to: patches of an image (width x height pixels), time of an
    audio (width seconds), pages of a document (width pages). Unknown sizes count as one unit."""
    unit = lambda x: F.coalesce(x, F.lit(1.0))
    patches = F.ceil(unit(part["width"]) / PATCH) * F.ceil(unit(part["height"]) / PATCH)
    return F.when(part["type"] == "image", patches).when(
        part["type"] == "audio", F.ceil(unit(part["width"]) * AUDIO_TOKENS_A_SECOND)).when(
        part["type"] == "document", F.ceil(unit(part["width"])) * PAGE_TOKENS).otherwise(F.lit(0)).cast("long")


def render_part(part: Column) -> Column:
    """Text is escaped; another known type becomes a placeholder; an unknown type is rendered by its text."""
    placeholder = F.concat(F.lit("<|"), part["type"], F.lit(":"), escape(F.coalesce(part["ref"], F.lit(""))), F.lit("|>"))
    return F.when(part["type"].isin("image", "audio", "document"), placeholder).otherwise(
        escape(F.coalesce(part["text"], F.lit(""))))


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, parts).

    Gives conv_id, formatted, loss_spans (start, end in code points of the content of assistant turns),
    attachments (turn number, position among the turn's parts, type, ref, tokens), expanded_tokens.
    Turns are ordered by turn (nulls first), then role and content; equal rows are turns of their
    own. A null role is an empty one, null parts are an empty message, null conv_ids form one
    conversation. Stretches of turns are put together before whole conversations are.
    """
    parts = F.coalesce("parts", F.array().cast(f"array<{PART}>"))
    attachments = F.filter(
        F.transform(parts, lambda p, i: F.struct(
            i.alias("position"), p["type"].alias("type"), p["ref"].alias("ref"), part_tokens(p).alias("tokens"))),
        lambda a: a["type"].isin("image", "audio", "document"))
    turns = rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(parts, render_part), "").alias("content"), attachments.alias("attached"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit("\n"))
    piece = F.struct(
        "turn", "role", "content", F.concat(head, "content", F.lit(END)).alias("shown"),
        F.char_length(head).alias("head"), F.char_length("content").alias("size"), "attached")
    chunks = turns.groupBy("conv_id", F.floor(F.col("turn") / CHUNK_TURNS).alias("chunk")).agg(
        F.sort_array(F.collect_list(piece)).alias("p"))
    chunks = chunks.select(
        "conv_id", F.struct(
            F.coalesce("chunk", F.lit(-(1 << 62))).alias("chunk"),
            F.array_join(F.transform("p", lambda x: x["shown"]), "").alias("shown"),
            F.transform("p", lambda x: F.struct(
                (x["role"] == "assistant").alias("loss"), x["head"].alias("head"), x["size"].alias("size"))).alias("sizes"),
            F.transform("p", lambda x: x["attached"]).alias("attached")).alias("c"))
    whole = chunks.groupBy("conv_id").agg(F.sort_array(F.collect_list("c")).alias("c")).select(
        "conv_id", F.array_join(F.transform("c", lambda x: x["shown"]), "").alias("formatted"),
        F.flatten(F.transform("c", lambda x: x["sizes"])).alias("sizes"),
        F.flatten(F.transform("c", lambda x: x["attached"])).alias("attached"))
    # Running places as one fold over the turns: the spans so far and where the next turn begins.
    fold = F.aggregate(
        "sizes", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda acc, s: F.struct(
            (acc["at"] + s["head"] + s["size"] + len(END)).alias("at"),
            F.when(s["loss"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + s["head"]).alias("start"), (acc["at"] + s["head"] + s["size"]).alias("end"))))).otherwise(
                acc["spans"]).alias("spans")))
    named = F.flatten(F.transform("attached", lambda of_turn, n: F.transform(of_turn, lambda a: F.struct(
        n.alias("turn"), a["position"].alias("position"), a["type"].alias("type"), a["ref"].alias("ref"),
        a["tokens"].alias("tokens")))))
    return whole.select(
        "conv_id", "formatted", fold["spans"].alias("loss_spans"), named.alias("attachments")).withColumn(
        "expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: array of (role, text), unescaped; placeholders stay in the text."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.substring_index(p, "\n", 1)).alias("role"),
        unescape(_content(p)).alias("text")))


def _content(piece: Column) -> Column:
    """What stands between the first line end and the end mark."""
    start = F.instr(piece, "\n") + 1
    return F.substring(piece, start, F.char_length(piece) - start + 1 - len(END))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted text: number and digest of turns, size and digest of the
    text under the loss mask, size of the formatted text."""
    done = format_conversations(rows)
    read = done.select(
        "conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"),
        loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), "attachments", "expanded_tokens")
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
