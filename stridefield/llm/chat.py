"""Chat formatting: turns of a conversation become one training string and a loss mask.

Everything is a Spark expression: turns are collected as structs and sorted, adjacent turns of one
role are merged with array functions, and the blocks are concatenated. Nothing here runs Python.

Template. Every control string starts with ``<|``::

    <|role|>user<|text|>first part<|part|>second part<|end|>
    <|role|>assistant<|text|>answer<|end|>

Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a
control string and the original comes back exactly.

Shuffle: one, by conversation. A conversation is one output row, so its turns meet in one task by
definition; everything about a conversation is linear in its turns but the loss spans, which copy
one pointer per earlier block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, PART, END = "<|role|>", "<|text|>", "<|part|>", "<|end|>"


def escape(text: Column) -> Column:
    """Double backslashes, then break every ``<|``."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`."""
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per ``conv_id``: ``formatted`` string and ``loss_spans`` array<struct<start, length>>.

    ``turns`` has conv_id, turn, role, text; other columns are ignored. Spans are code-point offsets
    (0-based) of the escaped bodies of ``loss_role`` blocks; a body may hold ``<|part|>`` marks.
    Null text and null role are empty strings; a null turn sorts first; rows of equal turn are sorted
    by role, then text; repeated rows are all kept; rows of null conv_id form one conversation.
    """
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    sorted_turns = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    last = F.size("_turns")
    starts = F.filter(
        F.sequence(F.lit(1), last),
        lambda i: (i == 1) | (F.element_at("_turns", i)["role"] != F.element_at("_turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    with_starts = sorted_turns.withColumn("_starts", starts)

    def run(start: Column, nth: Column) -> Column:
        after = F.coalesce(F.get("_starts", nth + 1), last + 1)
        texts = F.transform(F.slice("_turns", start, after - start), lambda t: escape(t["text"]))
        return F.struct(
            F.element_at("_turns", start)["role"].alias("role"), F.array_join(texts, PART).alias("body")
        )

    runs = with_starts.withColumn("_runs", F.transform("_starts", run))
    block = lambda r: F.concat(F.lit(ROLE), escape(r["role"]), F.lit(TEXT), r["body"], F.lit(END))
    head = lambda r: F.char_length(escape(r["role"])) + len(ROLE) + len(TEXT)
    # (offset of the next block, spans so far); a newline stands between blocks
    spans = F.aggregate(
        "_runs",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<role:string,start:int,length:int>>").alias("spans")),
        lambda acc, r: F.struct(
            (acc["at"] + head(r) + F.char_length(r["body"]) + len(END) + 1).alias("at"),
            F.when(
                r["role"] == loss_role,
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            r["role"].alias("role"),
                            (acc["at"] + head(r)).alias("start"),
                            F.char_length(r["body"]).alias("length"),
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
    )
    return runs.select(
        "conv_id",
        F.array_join(F.transform("_runs", block), "\n").alias("formatted"),
        F.transform(spans["spans"], lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias(
            "loss_spans"
        ),
    )


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string; the original turns, merged or not."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>\n?"), lambda b: b != "")

    def turns(block: Column) -> Column:
        halves = F.split(F.substr(block, F.lit(len(ROLE) + 1)), r"<\|text\|>", -1)
        return F.transform(
            F.split(F.element_at(halves, 2), r"<\|part\|>", -1),
            lambda p: F.struct(unescape(F.element_at(halves, 1)).alias("role"), unescape(p).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, loss_spans: Column) -> Column:
    """All text under the loss mask, unescaped and in order, with nothing between."""
    bodies = F.transform(loss_spans, lambda s: F.substr(formatted, s["start"] + 1, s["length"]))
    parts = F.flatten(F.transform(bodies, lambda b: F.split(b, r"<\|part\|>", -1)))
    return F.array_join(F.transform(parts, unescape), "")
