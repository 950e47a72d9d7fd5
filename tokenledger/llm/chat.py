"""Chat formatting: each conversation as one string with marked turns and a loss mask (DataFrame functions only).

Texts are escaped row by row. Turns are then collected as structs, sorted, adjacent turns of one role are merged
into a block by an array aggregation, and blocks are concatenated::

    <|im_start|>user<|im_sep|>first text<|im_next|>second text<|im_end|><|im_start|>assistant<|im_sep|>...<|im_end|>

Merged turns stay told apart by a mark of their own, so :func:`turns_of` reads back every turn as it was. A control
string inside a text or role gets a backslash after its first character (either ``<`` or ``[``), and one that already
has backslashes there gets one more; nothing else is changed, so taking one away again gives the text back.

A conversation of many turns is formatted in pieces of PIECE consecutive turn numbers, each by a task of its own;
its last step only joins finished pieces. The result is one row per conversation, so the whole string of one
conversation has to fit a row.

The loss mask is a list of spans in UTF-8 bytes of the string. Each is the (escaped) text of one turn of a trained
role; marks and roles are outside.

Defined cases: a null text or role is empty; a null conversation id is a conversation; null turn numbers come first;
equal turn numbers are ordered by role, then text; repeated rows are turns; an empty table has no conversations;
other columns are not read, so their names do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenledger.operators.joins import lookup
from tokenledger.session import written

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>"
# Escaped as well: marks of other templates, which a tokenizer may know. As for the marks above, the first
# character of a control string must not occur again inside it.
RESERVED = ("<s>", "</s>", "[INST]", "[/INST]")
TRAINED = ("assistant",)

# Turn numbers per piece of a long conversation.
PIECE = 64

_TAILS = "|".join(re.escape(control[1:]).replace("/", "\\/") for control in (START, SEP, NEXT, END, *RESERVED))
ESCAPABLE = rf"([<\[])(\\*)({_TAILS})"
_ESCAPED = rf"([<\[])\\(\\*)({_TAILS})"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPABLE, r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _merged(turns: Column) -> Column:
    """Blocks (role, texts) of adjacent turns of one role."""
    none = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def step(blocks: Column, turn: Column) -> Column:
        last = F.try_element_at(blocks, F.lit(-1))
        longer = F.struct(turn["role"].alias("role"), F.array_append(last["texts"], turn["text"]).alias("texts"))
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        before = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
        return F.when(last["role"] == turn["role"], F.array_append(before, longer)).otherwise(
            F.array_append(blocks, fresh)
        )

    return F.aggregate(turns, none, step)


def _long(text: str) -> Column:
    return F.lit(len(text.encode())).cast("long")


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def _spans(blocks: Column, trained: Sequence[str]) -> Column:
    """Spans of trained texts, counted from the end of the first block's opening."""
    opening = _long(END + START + SEP)

    def texts(block: Column, i: Column) -> Column:
        def text(value: Column, j: Column) -> Column:
            before = F.when(j > 0, _long(NEXT)).when(i > 0, opening + _bytes(block["role"])).otherwise(F.lit(0))
            return F.struct(
                before.cast("long").alias("before"),
                _bytes(value).alias("size"),
                block["role"].isin(*trained).alias("trained"),
            )

        return F.transform(block["texts"], text)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(done: Column, text: Column) -> Column:
        first = done["at"] + text["before"]
        last = first + text["size"]
        span = F.struct(first.alias("start"), last.alias("end"))
        spans = F.when(text["trained"], F.array_append(done["spans"], span)).otherwise(done["spans"])
        return F.struct(last.alias("at"), spans.alias("spans"))

    return F.aggregate(F.flatten(F.transform(blocks, texts)), start, step, lambda done: done["spans"])


def _pieces(collected: DataFrame, trained: Sequence[str], *keys: str) -> DataFrame:
    """``turns`` of each row as a piece: its first and last role, what follows the first opening, spans, turns."""
    blocks = collected.select(*keys, F.size("turns").cast("long").alias("n"), _merged(F.sort_array("turns")).alias("blocks"))
    first, last = F.element_at("blocks", 1), F.element_at("blocks", -1)
    opened = F.transform(
        "blocks",
        lambda block, i: F.concat(
            F.when(i > 0, F.concat(F.lit(END + START), block["role"], F.lit(SEP))).otherwise(F.lit("")),
            F.array_join(block["texts"], NEXT),
        ),
    )
    piece = F.struct(
        first["role"].alias("first"),
        last["role"].alias("last"),
        F.array_join(opened, "").alias("body"),
        _spans(F.col("blocks"), trained).alias("spans"),
        "n",
    )
    return blocks.select(*keys, piece.alias("piece"))


def _joined(pieces: Column) -> tuple[Column, Column]:
    """The string and the spans of sorted pieces. Neighbours whose roles meet share a block."""

    def link(piece: Column, i: Column) -> Column:
        before = F.get(pieces, i - 1)
        opening = F.concat(F.lit(START), piece["first"], F.lit(SEP))
        return (
            F.when(i == 0, opening)
            .when(before["last"] == piece["first"], F.lit(NEXT))
            .otherwise(F.concat(F.lit(END), opening))
        )

    text = F.concat(
        F.array_join(F.transform(pieces, lambda piece, i: F.concat(link(piece, i), piece["body"])), ""), F.lit(END)
    )
    # Where each body starts; one number per piece.
    sizes = F.transform(
        pieces, lambda piece, i: F.struct(_bytes(link(piece, i)).alias("link"), _bytes(piece["body"]).alias("body"))
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts"))
    starts = F.aggregate(
        sizes,
        zero,
        lambda done, size: F.struct(
            (done["at"] + size["link"] + size["body"]).alias("at"),
            F.array_append(done["starts"], done["at"] + size["link"]).alias("starts"),
        ),
        lambda done: done["starts"],
    )
    shifted = F.zip_with(
        pieces,
        starts,
        lambda piece, at: F.transform(
            piece["spans"],
            lambda span: F.struct((span["start"] + at).alias("start"), (span["end"] + at).alias("end")),
        ),
    )
    return text, F.flatten(shifted)


def formatted(turns: DataFrame, trained: Sequence[str] = TRAINED) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (start, end in UTF-8 bytes)."""
    rows = turns.select(
        "conv_id",
        F.expr(f"turn div {PIECE}").alias("part"),
        F.struct(
            "turn",
            escaped(F.coalesce("role", F.lit(""))).alias("role"),
            escaped(F.coalesce("text", F.lit(""))).alias("text"),
        ).alias("turns"),
    )
    parts = turns.groupBy("conv_id").agg(
        F.min(F.expr(f"turn div {PIECE}")).alias("low"),
        F.max(F.expr(f"turn div {PIECE}")).alias("high"),
        F.count_if(F.col("turn").isNull()).alias("unnumbered"),
    )
    many = (F.col("low") != F.col("high")) | (F.col("unnumbered") > 0)
    long_ids = written(parts.filter(many & F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("long_id")))
    dealt = lookup(rows, long_ids, {"conv_id": "long_id"})
    is_long = F.col("long_id").isNotNull() | F.col("conv_id").isNull()
    collected = F.collect_list("turns").alias("turns")

    short = _pieces(dealt.filter(~is_long).groupBy("conv_id").agg(collected), trained, "conv_id")
    in_parts = _pieces(dealt.filter(is_long).groupBy("conv_id", "part").agg(collected), trained, "conv_id", "part")
    long_ = in_parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "piece"))).alias("pieces"))
    both = short.select("conv_id", F.array("piece").alias("pieces")).union(
        long_.select("conv_id", F.col("pieces.piece").alias("pieces"))
    )
    text, spans = _joined(F.col("pieces"))
    n_turns = F.aggregate("pieces", F.lit(0).cast("long"), lambda n, piece: n + piece["n"])
    return both.select("conv_id", n_turns.alias("n_turns"), text.alias("formatted"), spans.alias("loss_spans"))


def turns_of(text: Column) -> Column:
    """Turns (role, text) read back from a formatted string."""

    def split(value: Column, mark: str, limit: int = -1) -> Column:
        return F.split(value, rf"\Q{mark}\E", limit)

    blocks = split(text, END)
    opened = F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), lambda b: split(F.substr(b, F.lit(len(START) + 1)), SEP))
    turns = F.transform(
        opened,
        lambda block: F.transform(
            split(F.get(block, F.lit(1)), NEXT),
            lambda value: F.struct(
                unescaped(F.get(block, F.lit(0))).alias("role"), unescaped(value).alias("text")
            ),
        ),
    )
    return F.flatten(turns)


def loss_text_of(text: Column, spans: Column) -> Column:
    """All text under the mask, as it was before it was escaped."""
    # Inside the outer function the bytes are a variable, which spans read without copying the whole string.
    parts = F.transform(
        F.array(text.cast("binary")),
        lambda data: F.array_join(
            F.transform(
                spans,
                lambda span: unescaped(
                    F.substr(data, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int")).cast("string")
                ),
            ),
            "",
        ),
    )
    return F.get(parts, F.lit(0))


def digests(conversations: DataFrame) -> DataFrame:
    """What :func:`formatted` holds, read back: turns, text under the mask, and their lengths."""
    read = conversations.select(
        "conv_id",
        turns_of(F.col("formatted")).alias("turns"),
        loss_text_of(F.col("formatted"), F.col("loss_spans")).alias("loss"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.transform("turns", lambda turn: F.concat(turn["role"], F.lit("\n"), turn["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
