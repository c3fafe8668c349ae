"""Canonical exact digests: equal after Unicode, case and white-space folding.

The canonical form is NFKC, case folded, NFKC again, with runs of white space as one space. Its
fingerprint is a 128-bit xxhash. Rows are grouped by fingerprint; inside a fingerprint that occurs
more than once the canonical bytes are compared, so bytes decide, not the hash.

Shuffles: :func:`compare_with_next` moves every text once, compressed, to its place in the order of doc_id;
:func:`exact_groups` moves fingerprints of all rows, and canonical texts only of those that a filter of fixed size
takes for repeated, combined before the shuffle.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stridefield.llm.storage import Scratch, bit_filter, cut, merged, pack, unpack

#: Bits of the filter of repeated fingerprints (2 MB). Where it fills up, more texts move; the result is the same.
FILTER_BITS = 1 << 24


def canonical(text: str | None) -> str:
    """The folded form of a text; of null the empty one."""
    folded = unicodedata.normalize("NFKC", text or "")
    if not folded.isascii():
        folded = unicodedata.normalize("NFKC", folded.casefold())
    else:
        folded = folded.lower()
    return " ".join(folded.split())


def digest(canonical_text: str) -> str:
    """128-bit xxhash of the UTF-8, as 32 hex digits."""
    return xxhash.xxh3_128_hexdigest(canonical_text.encode("utf-8", "surrogatepass"))


COMPARED = {
    "doc_id": pa.int64(), "_th": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
}
_SQL = "doc_id long, _th long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _against(text: str, own: tuple[str, str], following: str, after: tuple[str, str]) -> tuple:
    """What COMPARED has after n_chars; ``own`` and ``after`` are the canonical text and fingerprint of both."""
    k = len(text) // 4
    edited = text[: len(text) - k] + following[:k]
    canon = canonical(edited)
    printed = digest(canon)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return sha, own[1], printed, float((printed, canon) == own[::-1]), float(after == own)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([pack(t or "") for t in batch.column(2).to_pylist()], pa.binary())], ["doc_id", "_th", "_text"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; each is compared with the one after it. The first and the last of a part are given out with their texts."""
    names = [*COMPARED, "_end", "_part", "_text"]
    types = [*COMPARED.values(), pa.string(), pa.int32(), pa.binary()]
    part = TaskContext.get().partitionId()
    held = None  # doc_id, th, text, (canonical, fingerprint), packed
    for batch in batches:
        out: list[tuple] = []
        for doc_id, th, packed in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
            text = unpack(packed)
            canon = canonical(text)
            row = doc_id, th, text, (canon, digest(canon)), packed
            if held is None:
                out.append((doc_id, th, *[None] * 6, "head", part, packed))
            else:
                out.append((*held[:2], len(held[2]), *_against(held[2], held[3], text, row[3]), None, part, None))
            held = row
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*held[:2], *[None] * 6, "tail", part, held[4]), types, strict=True)], names)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, th, a, b in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            text, following = unpack(a), unpack(b)
            own, after = canonical(text), canonical(following)
            out.append((doc_id, th, len(text), *_against(text, (own, digest(own)), following, (after, digest(after)))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), COMPARED.values(), strict=True)], list(COMPARED))


def compare_with_next(docs: DataFrame, scratch: Scratch, parts: int | None = None) -> DataFrame:
    """doc_id, _th (xxhash64 of the text) and COMPARED's columns for every row of ``docs`` (doc_id, text; others are ignored).

    The edited form has its last floor(n/4) code points replaced by as many first ones of the next document in
    ascending doc_id (null last; equal ids in the order of _th; after the last comes the
    first; a lone document follows itself). Likeness is 1 for equal canonical bytes, else 0. Null
    text is empty. No rows give no rows.

    Rows are range-sorted once by (doc_id, _th), so many rows of one id spread too. The first and last text of each of
    the ``parts`` (default: the shuffle partitions) meet in a second, small step.
    """
    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", F.xxhash64("text").alias("_th"), "text")
    placing = [F.col("doc_id").asc_nulls_last(), F.col("_th").asc()]
    placed = keyed.mapInArrow(_place, "doc_id long, _th long, _text binary").repartitionByRange(n, *placing).sortWithinPartitions(*placing)
    found = scratch.keep(placed.mapInArrow(_compare, f"{_SQL}, _end string, _part int, _text binary"))
    # one head and one tail a part; only the parts' numbers, one a part, are put in order
    numbers = found.filter("_end = 'tail'").select("_part")
    order = Window.orderBy("_part")
    first = F.first("_part").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = scratch.keep(numbers.select("_part", F.coalesce(F.lead("_part").over(order), first).alias("_after")))
    tails = found.filter("_end = 'tail'").select("doc_id", "_th", "_text", "_part").join(after, "_part")
    heads = found.filter("_end = 'head'").select(F.col("_part").alias("_after"), F.col("_text").alias("_next"))
    closed = tails.join(heads, "_after").select("doc_id", "_th", "_text", "_next").mapInArrow(_close, _SQL)
    return found.filter("_end IS NULL").select(*COMPARED).unionByName(closed)


def exact_groups(docs: DataFrame, printed: DataFrame, scratch: Scratch) -> DataFrame:
    """``printed`` (with doc_id, _th, fingerprint) plus class_id (least doc_id) and copies (rows of the class).

    ``docs`` has the texts; _th is xxhash64 of the text and ties the two. A null text is an empty
    one. A class is all rows of one canonical text; a null doc_id is never a class_id unless all are null.
    """
    rows = printed.select("doc_id", "_th", "fingerprint")
    counted = scratch.keep(rows.groupBy("fingerprint", "_th").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_rows")))
    repeated = counted.groupBy("fingerprint").agg(F.sum("_rows").alias("_n")).filter("_n > 1").select("fingerprint")
    repeated = scratch.keep(repeated)
    marks = docs.sparkSession.sparkContext.broadcast(bit_filter(repeated, F.xxhash64("fingerprint"), FILTER_BITS))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        for batch in batches:
            out = []
            for th, text in zip(*[batch.column(i).to_pylist() for i in range(2)], strict=True):
                canon = canonical(text)
                printed = digest(canon)
                bit = _spark_hash(printed) % FILTER_BITS
                if bits[bit >> 3] >> (bit & 7) & 1:
                    out.append((printed, th, pack(canon)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], ["fingerprint", "_th", "_canon"])

    read = docs.select(F.coalesce("text", F.lit("")).alias("text")).select(F.xxhash64("text").alias("_th"), "text")
    # equal rows collapse before they move; the packed bytes are equal exactly where the canonical ones are
    canons = read.mapInArrow(texts, "fingerprint string, _th long, _canon binary").distinct()
    canons = scratch.keep(merged(canons, repeated, ["fingerprint"], "left_semi"))
    # one row a fingerprint or class, written before the join: a join of two plain tables can be dealt anew where one is large
    first = scratch.keep(canons.groupBy("fingerprint").agg(F.min("_canon").alias("_first")))
    own = F.when(F.col("_canon") == F.col("_first"), "").otherwise(F.sha2("_canon", 256)).alias("_own")
    named = merged(canons, first, ["fingerprint"]).select("fingerprint", "_th", own)
    named = scratch.keep(merged(named, counted, ["fingerprint", "_th"]))
    classes = scratch.keep(named.groupBy("fingerprint", "_own").agg(F.min("_least").alias("class_id"), F.sum("_rows").alias("copies")))
    by_text = merged(named.select("fingerprint", "_th", "_own"), classes, ["fingerprint", "_own"]).drop("_own")
    return (
        merged(printed, by_text, ["fingerprint", "_th"], "left")
        .withColumn("class_id", F.coalesce("class_id", "doc_id"))
        .withColumn("copies", F.coalesce("copies", F.lit(1)).cast("long"))
    )


def _spark_hash(text: str) -> int:
    """What Spark's xxhash64 gives for a string."""
    return xxhash.xxh64_intdigest(text.encode(), seed=42)


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its fingerprint, the comparisons, and its class of exact copies."""
    with Scratch(docs.sparkSession) as scratch:
        printed = scratch.keep(compare_with_next(docs, scratch, parts))
        return cut(exact_groups(docs, printed, scratch).drop("_th"))
