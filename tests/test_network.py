"""Registered wayfinding queries against their DuckDB SQL, and small hand cases."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from stridefield.functions import scalars
from stridefield.operators import network
from stridefield.plans import queries as plans
from stridefield.plans import rooms, tables, wayfinding  # rooms registers its queries with those of tables

DATA = "/root/testdata/sf0.001"


QUERIES, ORACLES = plans.QUERIES | wayfinding.QUERIES | tables.QUERIES, plans.ORACLES | wayfinding.ORACLES | tables.ORACLES
assert "first_routes" in QUERIES and rooms


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = QUERIES[name](spark, DATA)
    columns = sorted(found.columns)
    ours = _sorted(found.select(*columns).collect())
    theirs = _sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())
    assert ours == theirs


def test_segments_keep_order_and_skip_short_ways(spark):
    ways = spark.createDataFrame([(1, [5, 6, 7]), (2, [9]), (3, [])], "way_id long, node_refs array<long>")
    rows = [tuple(r) for r in network.way_segments(ways).orderBy("way_id", "pos").collect()]
    assert rows == [(1, 0, 5, 6), (1, 1, 6, 7)]


def test_format_travel_time(spark):
    rows = spark.range(1).select(*[scalars.format_travel_time(F.lit(s)).alias(f"t{i}") for i, s in enumerate((59.9, 60.0, 125.0))]).first()
    assert tuple(rows) == ("59 sec", "1 min 0 sec", "2 min 5 sec")
