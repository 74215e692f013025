"""Poll logs as health, metrics and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INACTIVE = ("expired", "invalidated", "stale")


#: Width of the ranges in which a poll log is read.
RANGE_US = 6 * 3_600_000_000


def poll_health(polls: DataFrame, range_us: int = RANGE_US) -> DataFrame:
    """polls (poll_id, provider_id, at, snapshots, issues, throttled) with failures since the last clean poll, state and update gap.

    A throttled poll is degraded and leaves the failure count alone; three failures without data are unavailable. A feed's log
    is read in ranges of time: polls are ordered inside a range, and only a row a range is ordered over the whole log.
    """
    clean, failed = (~F.col("throttled")) & (F.col("issues") == 0), (~F.col("throttled")) & (F.col("issues") > 0)
    updated = (F.col("snapshots") > 0) & ~F.col("throttled")
    lot = F.call_function("div", F.col("at"), F.lit(range_us))
    rows = polls.withColumns({"lot": lot, "clean": clean, "failed": failed, "updated": updated})
    inside = Window.partitionBy("provider_id", "lot").orderBy("at", "poll_id")
    rows = rows.withColumn("run", F.sum(F.col("clean").cast("int")).over(inside))
    since = F.sum(F.col("failed").cast("int")).over(Window.partitionBy("provider_id", "lot", "run").orderBy("at", "poll_id"))
    before = F.last(F.when(F.col("updated"), F.col("at")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"since": since, "before": before})
    # what a range hands on: its last update, and its failures after its last clean poll
    ends = rows.groupBy("provider_id", "lot").agg(
        F.max("run").alias("runs"), F.max_by("since", F.struct("at", "poll_id")).alias("open"), F.max(F.when(F.col("updated"), F.col("at"))).alias("seen")
    )
    lots = Window.partitionBy("provider_id").orderBy("lot")
    earlier = lots.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("block", F.sum((F.col("runs") > 0).cast("int")).over(lots))
    total = F.sum("open").over(Window.partitionBy("provider_id", "block").orderBy("lot"))
    ends = ends.withColumn("total", total).select("provider_id", "lot", F.lag("total", 1, 0).over(lots).alias("carried"), F.last("seen", ignorenulls=True).over(earlier).alias("seen_before"))
    met = rows.join(ends, ["provider_id", "lot"])
    failures = F.col("since") + F.when(F.col("run") == 0, F.col("carried")).otherwise(0)
    out = met.withColumn("failures", failures).withColumn("gap", F.when(F.col("updated"), F.col("at") - F.coalesce("before", "seen_before")))
    state = (
        F.when(F.col("throttled"), "degraded").when(F.col("issues") == 0, "healthy").when(F.col("snapshots") > 0, "degraded")
        .when(F.col("failures") >= 3, "unavailable").otherwise("degraded")
    )
    return out.withColumn("state", state).select(*polls.columns, "failures", "gap", "state")


def provider_states(metrics: DataFrame, failure_ratio: float = 0.5) -> DataFrame:
    """healthy or degraded per provider from requests, errors and availability."""
    ratio = F.coalesce(F.try_divide(F.col("errors"), F.col("requests")), F.lit(0.0))
    bad = ~F.coalesce("available", F.lit(True)) | (ratio >= failure_ratio)
    return metrics.withColumn("state", F.when(bad, "degraded").otherwise("healthy"))


def system_state(stale: Column, active: Column, worst_latency: Column, degraded: Column, stale_ratio: float = 0.5, latency: float = 5.0) -> Column:
    total = stale + active
    return (
        F.when((total > 0) & (F.coalesce(F.try_divide(stale, total), F.lit(0.0)) >= stale_ratio), "unhealthy")
        .when(worst_latency > latency, "degraded").when(degraded > 0, "degraded").otherwise("healthy")
    )


def ring(df: DataFrame, by: str, order: str, size: int = 256) -> DataFrame:
    """The last size rows per key (a limit within groups: applied before the shuffle too)."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= size)


def alerts(history: DataFrame) -> DataFrame:
    """created, changed or expired per (event_id, market_id) from the previous fingerprint and state, in order of at."""
    w = Window.partitionBy("event_id", "market_id").orderBy("at")
    old, was = F.lag("fingerprint").over(w), F.lag("state").over(w)
    off, was_off = F.col("state").isin(*INACTIVE), was.isin(*INACTIVE)
    kind = (
        F.when(old.isNull(), F.when(off, "expired").otherwise("created")).when(off & ~was_off, "expired").when(F.col("fingerprint") != old, "changed")
    )
    return history.withColumn("kind", kind).where("kind IS NOT NULL")
