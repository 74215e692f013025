"""Price observations projected from the driver's tables, as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Point in time of the batch queries, and their freshness window in days.
AS_OF = "2000-06-30 00:00:00"
WINDOW_DAYS = 400
#: Out-of-order tolerance and freshness of the stream queries, in days.
TOLERANCE_DAYS = 2
STREAM_FRESH_DAYS = 10


def div(column, n: int):
    """Integer division of a non-negative whole number."""
    c = F.col(column) if isinstance(column, str) else column
    return F.floor(c / n).cast("bigint")


class Frames:
    """Lazy frames over one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def quotes(self) -> DataFrame:
        """Batch quotes from lineitem."""
        market = div("l_orderkey", 10)
        cents = F.lit(101) + F.round(F.col("l_extendedprice") * 100).cast("bigint") % 220
        return self.table("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey").alias("quote_id"),
            market.alias("market_id"),
            market.alias("event_id"),
            (F.col("l_linenumber") % 3).cast("bigint").alias("selection_id"),
            (F.col("l_suppkey") % 10).cast("bigint").alias("provider_id"),
            (F.col("l_partkey") % 2).cast("bigint").alias("transport_id"),
            cents.alias("cents"),
            (cents / 100).cast("decimal(10,2)").alias("decimal_price"),
            F.col("l_shipdate").alias("effective_ts"),
            F.when(F.col("l_returnflag") == "R", "suspended").otherwise("active").alias("status"),
        )

    @cached_property
    def stream(self) -> DataFrame:
        """Quote stream from events; source clocks lag by up to six days, so keys see late data."""
        cents = F.lit(101) + F.round(F.col("value") * 100).cast("bigint") % 350
        return self.table("events").select(
            F.col("event_id").cast("string").alias("quote_id"),
            div("user_id", 3).alias("market_id"),
            (F.col("user_id") % 3).alias("selection_id"),
            (F.col("event_id") % 4).alias("provider_id"),
            (div("event_id", 4) % 2).alias("transport_id"),
            cents.alias("cents"),
            F.col("ts").alias("ingested_at"),
            (F.col("ts") - F.make_dt_interval((F.col("event_id") % 7).cast("int"))).alias("source_ts"),
            F.when(F.col("event_type") == "error", "suspended").otherwise("active").alias("status"),
        )

    @cached_property
    def events(self) -> DataFrame:
        """Event dimension: ten orders an event."""
        return (
            self.table("orders")
            .groupBy(div("o_orderkey", 10).alias("event_id"))
            .agg(
                F.max("o_orderdate").alias("scheduled_start"),
                F.min("o_custkey").alias("home_id"),
                F.max("o_custkey").alias("away_id"),
                (F.min("o_custkey") % 5).alias("competition_id"),
            )
            .withColumn("sport", F.lit("football"))
        )


QUOTES = """quotes AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_suppkey AS quote_id, l_orderkey // 10 AS market_id,
  l_orderkey // 10 AS event_id, (l_linenumber % 3)::bigint AS selection_id, l_suppkey % 10 AS provider_id, l_partkey % 2 AS transport_id,
  101 + cast(round(l_extendedprice * 100) AS bigint) % 220 AS cents,
  cast((101 + cast(round(l_extendedprice * 100) AS bigint) % 220) / 100.0 AS decimal(10, 2)) AS decimal_price, l_shipdate AS effective_ts,
  CASE WHEN l_returnflag = 'R' THEN 'suspended' ELSE 'active' END AS status FROM lineitem)"""

STREAM = """stream AS (SELECT event_id::varchar AS quote_id, user_id // 3 AS market_id, user_id % 3 AS selection_id, event_id % 4 AS provider_id,
  (event_id // 4) % 2 AS transport_id, 101 + cast(round(value * 100) AS bigint) % 350 AS cents, ts AS ingested_at,
  ts - to_days((event_id % 7)::int) AS source_ts, CASE WHEN event_type = 'error' THEN 'suspended' ELSE 'active' END AS status FROM events)"""

EVENTS = """dim_events AS (SELECT o_orderkey // 10 AS event_id, max(o_orderdate) AS scheduled_start, min(o_custkey) AS home_id,
  max(o_custkey) AS away_id, min(o_custkey) % 5 AS competition_id, 'football' AS sport FROM orders GROUP BY 1)"""


class Catalogue:
    """Queries by key, and the SQL that must give the same rows."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(f):
            self.queries[name] = lambda spark, sf_dir: f(Frames(spark, sf_dir))
            if sql is not None:
                self.sql[name] = sql
            return f

        return register
