"""Mixing sources to target weights as a time-varying curriculum, in Spark expressions only.

Every source gets a target number of words. Its weight may change linearly over training time
t in [0, 1]; the integral of that schedule says which share of the target is due by time t, and its
inverse gives each document the time at which the source's running word count reaches it. Documents
are then range-sorted by time.

A running count over a hot source would put all its rows into one task, so rows are ordered by a
digest and summed in two steps: totals per (source, digest bucket), a running sum over the buckets,
then a running sum inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stridefield.llm.storage import cut

WEIGHTS = (5, 2, 1)
#: Relative weight at the start and at the end of training, repeating over the sources like WEIGHTS.
SCHEDULES = ((1.5e0, 0.5e0), (1e0, 1e0), (0.5e0, 1.5e0))


def source_targets(sizes: DataFrame, share: float = 1.5, most: int = 2, weights=WEIGHTS) -> DataFrame:
    """One row per source of ``sizes`` (source, size): source_size, weight, target, w0, w1.

    Sources are ranked by code point, null last. ``share`` of all words is dealt by weight; a target
    stops at ``most`` times its source's size and what is over is dealt again by weight. In closed form:
    with sources sorted by size/weight, those before the first one whose level fits are full.
    The windows without a key run over one row per source.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("_rank") % len(values)).cast("int") + 1)
    ranked = (
        per_source.withColumn("_rank", rank)
        .withColumn("weight", pick([int(w) for w in weights]))
        .withColumn("w0", pick([a for a, _ in SCHEDULES]))
        .withColumn("w1", pick([b for _, b in SCHEDULES]))
        .withColumn("_cap", most * F.col("source_size"))
    )
    everything = W.partitionBy()
    by_ratio = W.orderBy((F.col("_cap") / F.col("weight")).asc(), F.col("_rank").asc())
    total = F.lit(share) * F.sum("source_size").over(everything)
    levelled = (
        ranked.withColumn("_total", total)
        .withColumn("_full", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_rest", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_rest"))
        .withColumn("_order", F.row_number().over(by_ratio))
    )
    fits = F.col("_level") * F.col("weight") <= F.col("_cap")
    first = F.min_by("_level", F.when(fits, F.col("_order"))).over(everything)
    first_at = F.min(F.when(fits, F.col("_order"))).over(everything)
    return (
        levelled.withColumn("_lambda", first)
        .withColumn("_first", first_at)
        .withColumn(
            "target",
            F.when(F.col("_order") < F.coalesce("_first", F.col("_order") + 1), F.col("_cap").cast("double")).otherwise(
                F.col("_lambda") * F.col("weight")
            ),
        )
        .select("source", "source_size", "weight", "target", "w0", "w1")
    )


def due_time(share: Column, w0: Column, w1: Column) -> Column:
    """The t at which a weight running from w0 to w1 has given ``share`` of its integral."""
    area = (w0 + w1) / 2
    slope = w1 - w0
    root = F.sqrt(F.greatest(F.lit(0e0), w0 * w0 + 2 * slope * share * area))
    t = F.when(slope == 0, share).otherwise((root - w0) / slope)
    return F.least(F.lit(1e0), F.greatest(F.lit(0e0), t))


def order_key(doc_id: Column, text: Column, row: Column | None = None) -> Column:
    """A digest that orders documents the same way in every run: of the id, or of the text's hash where that is null.

    With ``row``, a number of the row in a table, it is part of the digest: rows of one id are then spread over all places. It is for tables
    whose ids may be repeated much; there, the order is that of the table's numbers.
    """
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string")))
    return F.md5((own if row is None else F.concat_ws(" ", own, row.cast("string"))).cast("binary"))


def running_words(sized: DataFrame) -> DataFrame:
    """``sized`` (source, size, _key and an id) plus ``before``: words of its source ahead of it, by _key.

    Rows are bucketed by the first three hex digits of _key, so a source is spread over 4,096
    buckets; only the bucket totals of a source meet in one task.
    """
    bucketed = sized.withColumn("_bucket", F.substring("_key", 1, 3))
    totals = bucketed.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    ahead = totals.select(
        F.col("source").alias("_source"),
        F.col("_bucket").alias("_in"),
        F.coalesce(
            F.sum("_sum").over(W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("_ahead"),
    )
    row = [c for c in ("_row",) if c in sized.columns]
    inside = W.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size", *row)
    within = bucketed.withColumn(
        "_within", F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    return (
        within.join(ahead, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_in")), "left")
        .withColumn("before", F.col("_ahead") + F.col("_within"))
        .drop("_source", "_in", "_ahead", "_within", "_bucket")
    )


def size_of(text: Column) -> Column:
    """Words of a text (long); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(sized: DataFrame, share: float = 1.5, most: int = 2, whole: bool = False) -> DataFrame:
    """One row per row of ``sized`` (doc_id, source, size): target, taken, copies' positions.

    A source runs through its documents in digest order until its target is met, up to ``most`` times.
    With ``whole`` false the last document is cut to the words still due, so taken sums to the
    target (rounded down to a word); with ``whole`` true a document is taken where the middle of it is due.
    positions: array<double>, the training time at which each pass over the document begins.
    Size 0 takes 0 words and no position. Rows of equal digest, doc_id and size are interchangeable,
    unless ``sized`` has a _row, which then orders them. Further columns of ``sized`` are kept, but those named like
    columns made here are replaced. No rows give no rows; a null size counts as 0.
    """
    sized = sized.drop("source_size", "target", "w0", "w1", "before", "taken", "positions", "_bucket", "_within", "_ahead", "_in", "_source")
    sized = sized.withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
    targets = source_targets(sized, share, most)
    # targets: one row per source; AQE broadcasts them where they are small, and splits a hot source otherwise
    t = targets.select(F.col("source").alias("_source"), "source_size", "target", "w0", "w1")
    joined = running_words(sized).join(t, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    due = F.floor("target").cast("long")

    def taken_in(k: int) -> Column:
        start = F.col("before") + k * F.col("source_size")
        if whole:
            return F.when(2 * (due - start) >= F.col("size"), F.col("size")).otherwise(F.lit(0).cast("long"))
        return F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), due - start))

    passes = [taken_in(k) for k in range(most)]
    place = lambda k: due_time(
        (F.col("before") + k * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1e0)), F.col("w0"), F.col("w1")
    )
    positions = F.filter(
        F.array(*[F.when(p > 0, F.round(place(k), 9)) for k, p in enumerate(passes)]), lambda x: x.isNotNull()
    )
    return joined.withColumn("taken", sum(passes[1:], passes[0]).cast("long")).withColumn("positions", positions)


def narrow(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, source, size, the order key (with _row, if that is among ``also``) and the columns ``also``, cut from the lineage: texts are read once
    for everything after."""
    key = order_key(F.col("doc_id"), F.col("text"), F.col("_row") if "_row" in also else None)
    return cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key.alias("_key"), *also))
