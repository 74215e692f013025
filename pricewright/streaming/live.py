"""The keyed fold under Structured Streaming, and a micro-batch scan."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.arbitrage import evaluated, opportunities
from ..operators.books import best_prices, books, consolidate
from ..operators.state import KEY, OUTPUT, step


def folded_stream(quotes: DataFrame, tolerance_us: int, keep_us: int | None = None) -> DataFrame:
    """Streaming counterpart of state.fold: outcome rows per micro-batch, state kept per key.

    quotes carries KEY, quote_id, cents, status, observed_us, effective_us, ingested_us. A key without updates for
    keep_us of processing time is dropped from the state.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["observed_us", "effective_us", "ingested_us", "quote_id"])
        outcomes, revisions = [], []
        for r in rows.itertuples(index=False):
            now, outcome = step(now, r.cents, r.status, r.effective_us, r.ingested_us, r.observed_us, tolerance_us)
            outcomes.append(outcome)
            revisions.append(now[0] if outcome.startswith("accepted") else None)
        if now is not None:
            state.update(now)
        if keep_us is not None:
            state.setTimeoutDuration(max(1, keep_us // 1000))
        columns = [c.split()[0] for c in OUTPUT.split(", ")]
        yield rows.assign(outcome=outcomes, revision=pd.array(revisions, dtype="Int64"))[columns]

    timeout = GroupStateTimeout.NoTimeout if keep_us is None else GroupStateTimeout.ProcessingTimeTimeout
    return quotes.groupBy(*KEY).applyInPandasWithState(
        run, OUTPUT, "revision bigint, cents bigint, status string, effective_us bigint, ingested_us bigint", "append", timeout
    )


def scan_cycle(expected: int, emit: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: consolidate the batch, build books, evaluate them and emit opportunities."""

    def cycle(batch: DataFrame, epoch: int) -> None:
        merged = consolidate(batch.where("status = 'active'")).where("NOT conflict")
        emit(opportunities(evaluated(books(best_prices(merged), expected))), epoch)

    return cycle


def poll_loop(polls: DataFrame, cycle: Callable[[DataFrame, int], None], seconds: float, checkpoint: str) -> StreamingQuery:
    """Runs a cycle over what polls has brought, every so many seconds; cycles never overlap, and ticks that fall into a running one are dropped."""
    return polls.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def drained(polls: DataFrame, cycle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs the cycle over all that is there, in as many batches as the source makes, and ends."""
    polls.writeStream.foreachBatch(cycle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class ProgressLog(StreamingQueryListener):
    """Keeps (query id, batch, input rows) of each cycle; for spark.streams.addListener."""

    def __init__(self, most: int = 256):
        self.most, self.cycles, self.ended = most, [], 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.cycles = [*self.cycles, (str(event.progress.id), event.progress.batchId, event.progress.numInputRows)][-self.most :]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended += 1


class Telemetry(StreamingQueryListener):
    """Counters per group that a stream's batches observe, summed over batches; for spark.streams.addListener.

    A batch counts once, whether it is told by the listener's events or taken from a query's progress. What it keeps is a number a
    group and batch.
    """

    NAME = "telemetry"

    def __init__(self, groups: dict[str, Column]):
        self.groups, self.batches = groups, {}

    def observed(self, rows: DataFrame) -> DataFrame:
        """rows of a stream, counted on their way by group: one pass, no shuffle."""
        return rows.observe(self.NAME, *(F.count_if(c).alias(name) for name, c in self.groups.items()))

    def take(self, progress) -> None:
        told = progress.observedMetrics.get(self.NAME)
        if told is not None:
            self.batches[str(progress.id), progress.batchId] = told.asDict()

    def counters(self) -> dict[str, int]:
        return {name: sum(b[name] for b in self.batches.values()) for name in self.groups}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.take(event.progress)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def as_events(quotes: DataFrame) -> DataFrame:
    """Batch quote columns as the fold's microsecond columns."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return quotes.select(
        *KEY, "quote_id", "cents", "status", us("ingested_at").alias("observed_us"),
        F.coalesce(us("source_ts"), us("ingested_at")).alias("effective_us"), us("ingested_at").alias("ingested_us"),
    )
