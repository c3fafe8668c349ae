"""Risk grid and the terms of an edge's current weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stridefield.functions.scalars import rain_slowdown, wind_adjustment
from stridefield.operators.spatial import Bounds, points_near_cells

# Bands in feet with their score or factor, and the cells per side
CRIME_BANDS = ((100, 3), (500, 2), (1000, 1))
PHONE_BANDS = ((50, 0.25), (100, 0.5), (200, 0.67))
CELLS = 31


def _band(feet: Column, bands: tuple) -> Column:
    return F.coalesce(*[F.when(feet <= limit, F.lit(value)) for limit, value in bands])


def crime_score(crimes: DataFrame, bounds: Bounds, n: int = CELLS) -> DataFrame:
    """i, j, crime: sum of band scores; cells without crimes have no row. Sums combine before the shuffle."""
    return points_near_cells(crimes, bounds, n, CRIME_BANDS[-1][0]).groupBy("i", "j").agg(F.sum(_band(F.col("feet"), CRIME_BANDS)).alias("crime"))


def phone_factor(phones: DataFrame, bounds: Bounds, n: int = CELLS) -> DataFrame:
    """i, j, phone: the lowest band factor; cells without phones have no row."""
    return points_near_cells(phones, bounds, n, PHONE_BANDS[-1][0]).groupBy("i", "j").agg(F.min(_band(F.col("feet"), PHONE_BANDS)).alias("phone"))


def risk_grid(spark: SparkSession, crimes: DataFrame, phones: DataFrame, bounds: Bounds, n: int = CELLS, default: float = 1.0) -> DataFrame:
    """i, j, multiplier of all n x n cells."""
    cells = spark.range(n * n).select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"))
    joined = cells.join(crime_score(crimes, bounds, n), ["i", "j"], "left").join(phone_factor(phones, bounds, n), ["i", "j"], "left")
    crime, phone = F.coalesce("crime", F.lit(0)).cast("double"), F.col("phone").cast("double")
    value = F.when(phone.isNull(), crime).when(crime == 0, phone).otherwise(crime * phone)
    return joined.select("i", "j", F.when(value == 0, F.lit(float(default))).otherwise(value).alias("multiplier"))


def risk_matrix(grid: DataFrame) -> DataFrame:
    """i, row: multipliers by j; a row is as long as the grid is wide."""
    return grid.groupBy("i").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "multiplier"))), lambda x: x["multiplier"]).alias("row"))


def edge_weights(
    edges: DataFrame, flows: DataFrame | None = None, risk: DataFrame | None = None, weather: DataFrame | None = None, safe: bool = False, biking: float = 1.0,
    mode: str = "intended",
) -> DataFrame:
    """edges (edge_id, baseline_weight, bearing) with ``weight``, always from the baseline.

    Transport, traffic (0.01 * baseline * summed flow), safety (baseline * multiplier), weather (baseline * wind * rain, of
    the latest row of ``weather``, by ``mode``), then never below 0. Flows are summed per edge before the join; risk has one row per edge.
    """
    base, out = F.col("baseline_weight"), edges
    total = base * F.lit(biking)
    if flows is not None:
        out = out.join(flows.groupBy("edge_id").agg(F.sum("flow").alias("_flow")), "edge_id", "left")
        total = total + F.lit(0.01) * base * F.coalesce("_flow", F.lit(0.0))
    if safe and risk is not None:
        out = out.join(risk.select("edge_id", F.col("multiplier").alias("_risk")), "edge_id", "left")
        total = total + base * F.coalesce("_risk", F.lit(1.0))
    if weather is not None:
        # a global aggregate: one row whatever the input
        now = weather.agg(F.max(F.struct("ts", "wind_speed", "wind_direction", "precipitation")).alias("_w"))
        out = out.crossJoin(F.broadcast(now))
        term = wind_adjustment(F.col("_w.wind_speed"), F.col("_w.wind_direction"), F.col("bearing"), mode) * rain_slowdown(F.col("_w.precipitation"), mode)
        total = total + base * F.coalesce(term, F.lit(0.0))
    return out.withColumn("weight", F.greatest(F.lit(0.0), total)).drop("_flow", "_risk", "_w")
