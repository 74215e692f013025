"""Keyed versioned state: one fold, used by the batch operator and by the streaming processor.

The rules are applied in order to each observation of a key: future ingestion, clock skew beyond the
tolerance, a backward step beyond the tolerance, a semantic duplicate, a backward step without a newer
ingestion, else a new revision. An accepted small backward step moves the current time back, so the
fold has no closed form over sorted rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ("provider_id", "market_id", "selection_id", "transport_id")
DAY_US = 86_400_000_000
#: An accepted observation's state: (revision, cents, status, effective_us, ingested_us).
State = tuple[int, int, str, int, int]


def step(now: State | None, cents: int, status: str, effective: int, ingested: int, observed: int, tolerance: int) -> tuple[State | None, str]:
    """(next state, outcome) of one observation; times in microseconds."""
    if ingested > observed:
        return now, "future_ingestion"
    if effective - observed > tolerance:
        return now, "clock_skew_exceeded"
    if now is not None:
        revision, c, s, eff, ing = now
        if eff - effective > tolerance:
            return now, "out_of_order"
        if (c, s, eff) == (cents, status, effective):
            return now, "duplicate"
        if effective < eff and ingested <= ing:
            return now, "out_of_order"
    state = ((now[0] if now else 0) + 1, cents, status, effective, ingested)
    return state, "accepted_skewed" if effective > observed else "accepted"


OUTPUT = "provider_id bigint, market_id bigint, selection_id bigint, transport_id bigint, quote_id string, observed_us bigint, effective_us bigint, cents bigint, status string, outcome string, revision bigint"


def fold(quotes: DataFrame, tolerance_us: int) -> DataFrame:
    """The outcome and revision of every observation, per key in order of (observed, effective, ingested, id).

    quotes: KEY, quote_id, cents, status, source_ts, ingested_at; each is observed when it is ingested. Rows
    are dealt by key and sorted, and one pass holds a single state, so a key of any length streams through.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = quotes.select(
        *KEY, "quote_id", us("ingested_at").alias("observed_us"), F.coalesce(us("source_ts"), us("ingested_at")).alias("effective_us"),
        us("ingested_at").alias("ingested_us"), "cents", "status",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            outcomes, revisions = [], []
            for *own, observed, effective, ingested, cents, status in zip(*(columns[c].to_pylist() for c in (*KEY, "observed_us", "effective_us", "ingested_us", "cents", "status"))):
                if own != key:
                    key, state = own, None
                state, outcome = step(state, cents, status, effective, ingested, observed, tolerance_us)
                outcomes.append(outcome)
                revisions.append(state[0] if outcome[0] == "a" else None)  # accepted
            names = [c.split()[0] for c in OUTPUT.split(", ")]
            columns |= {"outcome": pa.array(outcomes, pa.string()), "revision": pa.array(revisions, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    dealt = rows.repartition(*KEY).sortWithinPartitions(*KEY, "observed_us", "effective_us", "ingested_us", "quote_id")
    return dealt.mapInArrow(run, OUTPUT)


def accepted_versions(folded: DataFrame) -> DataFrame:
    return folded.where("outcome LIKE 'accepted%'")


def current(folded: DataFrame) -> DataFrame:
    """The latest version per key."""
    last = accepted_versions(folded).groupBy(*KEY).agg(F.max(F.struct("revision", "quote_id", "observed_us", "effective_us", "cents", "status")).alias("v"))
    return last.select(*KEY, "v.*")


def evicted(current_versions: DataFrame, as_of_us: int, window_us: int) -> DataFrame:
    """The versions that leave the state, with the reason."""
    reason = F.when(F.col("status") != "active", "inactive_evicted").when(as_of_us - F.col("effective_us") > window_us, "stale_evicted")
    return current_versions.withColumn("reason", reason).where("reason IS NOT NULL")


def suppressed(observations: DataFrame, window_us: int) -> DataFrame:
    """(KEY, invalidated_us, until_us): from each inactivity of a key until it is active again, or is evicted window_us after its last sign of life.

    observations: KEY, observed_us, status. Inactivities in a row are one; a key that never comes back is evicted.
    """
    w = Window.partitionBy(*KEY).orderBy("observed_us", "quote_id")
    off = F.col("status") != "active"
    first = off & ~F.coalesce(F.lag("status").over(w) != "active", F.lit(False))
    # what follows is what comes before in falling order: frames that grow, each row added once
    back = Window.partitionBy(*KEY).orderBy(F.desc("observed_us"), F.desc("quote_id"))
    again = F.min(F.when(~off, F.col("observed_us"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    last = F.max(F.when(off, F.col("observed_us"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    # the end of this run of inactivities: the last one before the key is active again
    runs = observations.select(*KEY, "observed_us", "quote_id", "status").withColumns({"first": first, "again": again, "last": last})
    return runs.where("first").select(*KEY, F.col("observed_us").alias("invalidated_us"), F.coalesce("again", F.col("last") + window_us).alias("until_us"))


def lives(observations: DataFrame, tolerance_us: int, window_us: int) -> DataFrame:
    """The fold of observations with eviction: a key whose version is older than window_us when its next observation comes starts a new life.

    observations: KEY, quote_id, cents, status, observed_us, effective_us, ingested_us. Returns them with outcome, revision, life, and, of
    what is accepted, evicted_us: when it leaves the state unless it is followed before. A packet that is itself older than the window when it comes is late
    for an evicted key: it is told late_for_evicted, stays in the store as stale, and begins nothing.
    """
    columns = [f.name for f in observations.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, life = None, None, 0
        for batch in batches:
            rows = []
            read = (batch.column(columns.index(c)).to_pylist() for c in (*KEY, "observed_us", "effective_us", "ingested_us", "cents", "status"))
            for *own, observed, effective, ingested, cents, status in zip(*read):
                if own != key:
                    key, now, life = own, None, 1
                elif now is not None and observed - now[3] > window_us:
                    now, life = None, life + 1
                if now is None and life > 1 and observed - effective > window_us:
                    rows.append(("late_for_evicted", None, life, None))
                    continue
                now, outcome = step(now, cents, status, effective, ingested, observed, tolerance_us)
                taken = outcome[0] == "a"  # accepted
                rows.append((outcome, now[0] if taken else None, life, now[3] + window_us if taken else None))
            told = list(zip(*rows)) if rows else [(), (), (), ()]
            more = [pa.array(told[0], pa.string()), *(pa.array(x, pa.int64()) for x in told[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*columns, "outcome", "revision", "life", "evicted_us"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in observations.schema)
    dealt = observations.repartition(*KEY).sortWithinPartitions(*KEY, "observed_us", "effective_us", "ingested_us", "quote_id").select(*columns)
    return dealt.mapInArrow(run, f"{kinds}, outcome string, revision bigint, life bigint, evicted_us bigint")


def invalidations(quotes: DataFrame, selections: DataFrame) -> DataFrame:
    """Tombstones of explicit inactivity; an inactive market fans out to all its selections.

    quotes: transport_id, market_id, selection_id (null for a whole market), status, ingested_at.
    """
    off = quotes.where("status <> 'active'").select("transport_id", "market_id", "selection_id", "ingested_at")
    whole = off.where("selection_id IS NULL").drop("selection_id").join(selections, "market_id")
    return off.where("selection_id IS NOT NULL").unionByName(whole.select("transport_id", "market_id", "selection_id", "ingested_at")).distinct()
