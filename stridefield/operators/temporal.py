"""Readings in time: cleaning, weekday slots, nearest slot, as-of weather."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridefield.operators.lineage import Scratch, cut

DAYS = ["Friday", "Monday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday"]


def clean_counts(raw: DataFrame, pattern: str = "M/d/yyyy H:mm") -> DataFrame:
    """ts, count; rows with a null, a bad time or a bad number are dropped."""
    ts = F.try_to_timestamp(F.concat_ws(" ", "Date", "Time"), F.lit(pattern))
    return raw.dropna(subset=["Date", "Time", "Count"]).select(ts.alias("ts"), F.col("Count").try_cast("double").alias("count")).dropna()


def with_weekday_slot(df: DataFrame) -> DataFrame:
    """Rows with the name of their weekday and their time of day. No shuffle."""
    return df.withColumn("weekday", F.date_format("ts", "EEEE")).withColumn("slot", F.date_format("ts", "HH:mm:ss"))


def pivot_profile(profile: DataFrame) -> DataFrame:
    """slot and one column per weekday; a missing pair is null. The names are fixed, so no extra pass finds them."""
    return profile.groupBy("slot").pivot("weekday", DAYS).agg(F.first("avg_count"))


def seconds_of(slot: Column) -> Column:
    """Seconds of the day of a time written HH:mm:ss. A column expression."""
    part = F.split(slot, ":")
    return part[0].cast("long") * 3600 + part[1].cast("long") * 60 + part[2].cast("long")


def round_to_hour(ts: Column) -> Column:
    """Seconds of the day of the nearest hour, half to even; 24:00 is 0. The weekday is taken before rounding."""
    hours = (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)) / F.lit(3600.0)
    return (F.rint(hours).cast("long") % 24) * 3600


def flow_at(profile: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (query_id, ts) with avg_count of the nearest slot of their weekday, the first on ties.

    The profile has at most 7 x 96 rows when its slots are quarter hours, so it is a bounded side; it is collected to
    one sorted list per weekday before the join, which keeps one row per query and needs no second shuffle.
    """
    lists = profile.groupBy("weekday").agg(F.collect_list(F.struct(seconds_of(F.col("slot")).alias("s"), F.col("avg_count").alias("c"))).alias("_slots"))
    asked = queries.withColumn("weekday", F.date_format("ts", "EEEE")).withColumn("_at", round_to_hour(F.col("ts")))
    near = F.array_min(F.transform("_slots", lambda x: F.struct(F.abs(x["s"] - F.col("_at")).alias("d"), x["s"].alias("s"), x["c"].alias("c"))))
    return asked.join(lists, "weekday", "left").withColumn("avg_count", near["c"]).drop("_slots", "_at")


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of time; each request gets the last reading before it in its part. The part's last reading follows as a row of its own."""
    names = ["_part", "_k", "_t", "_q", "_r"]
    last, part, kinds = None, TaskContext.get().partitionId(), None
    for batch in batches:
        n, readings, kinds = batch.num_rows, batch.column("_r"), (batch.schema.field("_q").type, batch.schema.field("_r").type)
        if not n:
            continue
        before = pa.array([last], kinds[1])
        at = np.maximum.accumulate(np.where(batch.column("_k").to_numpy() == 0, np.arange(1, n + 1), 0))
        known = pa.chunked_array([before, readings]).combine_chunks().take(pa.array(at))
        asked = np.flatnonzero(batch.column("_k").to_numpy() == 1)
        last = known[n - 1].as_py()
        if len(asked):
            pick = lambda c: c.take(pa.array(asked))  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(asked), pa.int32()), pick(batch.column("_k")), pick(batch.column("_t")), pick(batch.column("_q")), pick(known)], names)
    if last is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([None], pa.int64()), pa.array([None], kinds[0]), pa.array([last], kinds[1])], names)


def weather_asof(requests: DataFrame, readings: DataFrame, tolerance: int = 3600) -> DataFrame:
    """Each request (request_id, ts) with the latest reading (ts, values) at most ``tolerance`` seconds old, else nulls.

    Requests and readings are range-sorted together by time once, so each row moves once and a hot minute is dealt to several parts; a part
    carries its last reading along. The last readings of the parts, one row each, are then carried over the borders to the requests that stand before the
    first reading of theirs. Of readings at one time the greatest struct counts; readings without a time count for none.
    """
    values = [c for c in readings.columns if c != "ts"]
    second = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    known = readings.filter("ts IS NOT NULL").groupBy("ts").agg(F.max(F.struct(second("ts").alias("at"), *values)).alias("_r"))
    known = known.select(second("ts").alias("_t"), F.lit(0).alias("_k"), F.lit(0).cast("long").alias("_n"), "_r")
    asked = requests.select(second("ts").alias("_t"), F.lit(1).alias("_k"), F.monotonically_increasing_id().alias("_n"), F.struct(*requests.columns).alias("_q"))
    order = ["_t", "_k", "_n"]
    parts = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = asked.unionByName(known, allowMissingColumns=True).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    shape = f"_part int, _k int, _t long, _q {both.schema['_q'].dataType.simpleString()}, _r {both.schema['_r'].dataType.simpleString()}"
    with Scratch(requests.sparkSession) as scratch:
        done = scratch.keep(both.select("_k", "_t", "_q", "_r").mapInArrow(_carried, shape))
        # a row a part, so the window over them is as long as there are parts
        ends = done.filter("_k = 0").select(F.col("_part").alias("_from"), "_r")
        spans = ends.withColumn("_to", F.lead("_from").over(Window.orderBy("_from"))).select(F.explode(F.sequence(F.col("_from") + 1, F.coalesce(F.col("_to"), F.greatest(F.lit(parts), F.col("_from") + 1)))).alias("_part"), F.col("_r").alias("_before"))
        whole = done.filter("_k = 1").join(spans, "_part", "left").withColumn("_r", F.coalesce("_r", "_before"))
        fresh = F.col("_t") - F.col("_r.at") <= tolerance * 1_000_000
        return cut(whole.select("_q.*", *[F.when(fresh, F.col(f"_r.{v}")).alias(v) for v in values]))
