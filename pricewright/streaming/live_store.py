"""The live store and the open books as keyed state of streams, with event-time timers, in RocksDB.

LiveStore folds observations with eviction and suppression as the batch operators state.lives and state.suppressed do; OpenBooks
keeps the newest price of each slot of a market, so a batch re-prices only the markets that it touches, from what earlier ones left.
Both are restarted from their checkpoint at any batch, and their state can be read as a table (held).

A call of the state store costs as much as hundreds of rows, so keys are dealt out over shards, whose state is one Arrow table: a batch reads
and writes it once and has one timer for it, whatever the number of keys. Callers let the number of shards grow with their input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.state import KEY, step

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The state of a key: its version (revision null: none ever), whether it is alive, its life, its last observation, and an open suppression.
VERSION = "provider_id bigint, market_id bigint, selection_id bigint, transport_id bigint, quote_id string, revision bigint, cents bigint, status string, effective_us bigint, ingested_us bigint, alive boolean, life bigint, seen_us bigint, off_us bigint, last_off_us bigint"
#: kind is observation, evicted (a version left the state) or suppressed (a key is active again, from_us to until_us).
TOLD = "provider_id bigint, market_id bigint, selection_id bigint, transport_id bigint, kind string, quote_id string, observed_us bigint, effective_us bigint, cents bigint, status string, outcome string, revision bigint, life bigint, evicted_us bigint, from_us bigint, until_us bigint"
_NAMES = [c.split()[0] for c in TOLD.split(", ")]
_ORDER = ["observed_us", "effective_us", "ingested_us", "quote_id"]
#: Rows of the input to a shard, as callers count them.
SHARD = 8192


def shards_for(rows: int) -> int:
    """The number of shards for an input of so many rows."""
    return max(64, rows // SHARD)


def sharded(rows: DataFrame, by: tuple[str, ...], whole: tuple[str, ...], shards: int) -> DataFrame:
    """rows with shard, by hash of the columns by; nulls of the columns whole become 0 and a bit of nulls, so that pandas keeps them whole numbers."""
    bits = sum((F.when(F.col(c).isNull(), 1 << k).otherwise(0) for k, c in enumerate(whole)), F.lit(0))
    dealt = rows.withColumns({"shard": F.pmod(F.xxhash64(*by), F.lit(shards)).cast("int"), "nulls": bits})
    return dealt.withColumns({c: F.coalesce(c, F.lit(0)).cast("bigint") for c in whole})


_ARROW = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}


def _schema(columns: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in columns.split(", "))])


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pa.Table:
    return pa.ipc.open_stream(held).read_all()


class LiveStore(StatefulProcessor):
    """A shard of the store. A timer at the end of the first window evicts its versions when the watermark has passed, also if nothing follows."""

    def __init__(self, tolerance_us: int, window_us: int):
        self.tolerance, self.window = tolerance_us, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("version", "held binary, timer_ms bigint")

    def _ends(self, effective_us: int) -> int:
        """The millisecond at which an age beyond the window is certain."""
        return (effective_us + self.window) // 1000 + 1

    def _load(self) -> tuple[dict[tuple, list], int | None]:
        """What is held of each key, and the time of the shard's timer."""
        if not self.state.exists():
            return {}, None
        held, timer = self.state.get()
        return {row[:4]: list(row[4:]) for row in zip(*(c.to_pylist() for c in _unpacked(bytes(held)).columns))}, timer

    def _keep(self, held: dict[tuple, list], timer: int | None, passed: int = -1) -> None:
        """Store the shard, with a timer at the first end of a version that is alive; one at or before passed has gone off."""
        first = min((v[4] for v in held.values() if v[6]), default=None)
        due = None if first is None else self._ends(first)
        if due != timer:
            if timer is not None and timer > passed:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        columns = zip(*((*key, *v) for key, v in held.items()))
        schema = _schema(VERSION)
        table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        self.state.update((_packed(table), due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._load()
        came = pd.concat(list(rows)).sort_values(_ORDER)
        told = []
        for *own, c, nulls, q, s, observed, eff, ing in zip(*(came[x].tolist() for x in (*KEY, "cents", "nulls", "quote_id", "status", "observed_us", "effective_us", "ingested_us"))):
            if nulls:
                *own, c = (None if nulls >> k & 1 else x for k, x in enumerate((*own, c)))
            own = tuple(own)
            quote, revision, cents, status, effective, ingested, alive, life, _, off, last_off = held.get(own) or (None, None, None, None, None, None, False, 1, None, None, None)
            if s != "active":
                off, last_off = observed if off is None else off, observed
            elif off is not None:
                told.append((*own, "suppressed", q, observed, None, None, None, None, None, None, None, off, observed))
                off = last_off = None
            if alive and observed - effective > self.window:
                told.append((*own, "evicted", quote, observed, effective, cents, status, None, revision, life, effective + self.window, None, None))
                alive, life = False, life + 1
            if not alive and life > 1 and observed - eff > self.window:
                told.append((*own, "observation", q, observed, eff, c, s, "late_for_evicted", None, life, None, None, None))
            else:
                now, outcome = step((revision, cents, status, effective, ingested) if alive else None, c, s, eff, ing, observed, self.tolerance)
                taken = outcome.startswith("accepted")
                if now is not None:
                    revision, cents, status, effective, ingested = now
                    alive = True
                quote = q if taken else quote
                told.append((*own, "observation", q, observed, eff, c, s, outcome, revision if taken else None, life, effective + self.window if taken else None, None, None))
            held[own] = [quote, revision, cents, status, effective, ingested, alive, life, observed, off, last_off]
        self._keep(held, timer)
        yield _frame(told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, timer = self._load()
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        told = []
        for own, v in held.items():
            quote, revision, cents, status, effective, _, alive, life, *_ = v
            # a timer of a version that was followed meanwhile tells nothing
            if alive and self._ends(effective) <= passed:
                told.append((*own, "evicted", quote, None, effective, cents, status, None, revision, life, effective + self.window, None, None))
                v[6], v[7] = False, life + 1
        self._keep(held, timer, passed)
        yield _frame(told)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=_NAMES)
    whole = [c for c in _NAMES if c not in ("kind", "quote_id", "status", "outcome")]
    return out.astype({c: "Int64" for c in whole})


def live(quotes: DataFrame, tolerance_us: int, window_us: int, delay: str = "0 seconds", shards: int = 64) -> DataFrame:
    """The stream TOLD of a stream of observations (KEY, quote_id, cents, status, observed_us, effective_us, ingested_us).

    Micro-batches come in order of observed_us; what is observed at or before the watermark (the latest moment of earlier
    batches less delay) is dropped by the engine. The rows of a shard in one micro-batch are sorted together. A checkpoint keeps its number of shards.
    """
    timed = quotes.withColumn("observed_at", F.timestamp_micros("observed_us")).withWatermark("observed_at", delay)
    return sharded(timed, KEY, (*KEY, "cents"), shards).groupBy("shard").transformWithStateInPandas(LiveStore(tolerance_us, window_us), TOLD, "append", "eventTime")


#: The state of a slot: the newest moment, the least and highest price at it, the turns of its market so far, and bits of what is null in the key.
SLOTS = "market_id bigint, provider_id bigint, selection_id bigint, nulls bigint, at_us bigint, low bigint, high bigint, turn bigint"
_SLOTS = [c.split()[0] for c in SLOTS.split(", ")]
BOOK = "market_id bigint, turn bigint, cents array<bigint>"


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new group begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class OpenBooks(StatefulProcessor):
    """A shard of markets. Each batch that touches a market tells its best prices in order of selection, or none while it is not complete."""

    def __init__(self, expected: int):
        self.expected = expected

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("slots", "held binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        parts = [[came[c].to_numpy(np.int64) for c in _SLOTS[:-1]] + [np.zeros(len(came), np.int64)]]
        if self.state.exists():
            parts.append([c.to_numpy() for c in _unpacked(bytes(self.state.get()[0])).columns])
        columns = [np.concatenate(c) for c in zip(*parts)]
        fresh = np.zeros(len(columns[0]), np.int64)
        fresh[: len(came)] = 1
        market, provider, selection, nulls, at, low, high, turn = columns
        # sorted by slot and moment; only the newest moment of a slot is kept, with the extremes of its prices
        order = np.lexsort((at, provider, nulls, selection, nulls & 1, market))
        market, provider, selection, nulls, at, low, high, turn, fresh = (c[order] for c in (*columns, fresh))
        begins = _starts(market, selection, nulls, provider)
        sizes = np.diff([*begins, len(at)])
        newest = at == np.repeat(at[begins + sizes - 1], sizes)
        low = np.minimum.reduceat(np.where(newest, low, np.iinfo(np.int64).max), begins)
        high = np.maximum.reduceat(np.where(newest, high, np.iinfo(np.int64).min), begins)
        at, turn, fresh = at[begins + sizes - 1], np.maximum.reduceat(turn, begins), np.maximum.reduceat(fresh, begins)
        market, provider, selection, nulls = market[begins], provider[begins], selection[begins], nulls[begins]
        # markets: a turn for each batch that touches them
        begins = _starts(market, nulls & 1)
        sizes = np.diff([*begins, len(market)])
        touched = np.maximum.reduceat(fresh, begins)
        turns = np.maximum.reduceat(turn, begins) + touched
        slots = (market, provider, selection, nulls, at, low, high, np.repeat(turns, sizes))
        self.state.update((_packed(pa.Table.from_arrays([pa.array(c, pa.int64()) for c in slots], names=_SLOTS)),))
        # unequal prices of one moment are a conflict
        told = np.repeat(touched > 0, sizes) & (low == high)
        number = np.repeat(np.arange(len(begins)), sizes)[told]
        books: list[list[int]] = [[] for _ in begins]
        if len(number):
            legs = _starts(number, selection[told], nulls[told] & 4)
            for m, best in zip(number[legs].tolist(), np.maximum.reduceat(low[told], legs).tolist()):
                books[m].append(best)
        own = [k for k, is_touched in enumerate(touched.tolist()) if is_touched]
        ids = pd.array(market[begins][own], dtype="Int64")
        ids[(nulls[begins][own] & 1) > 0] = pd.NA
        yield pd.DataFrame({"market_id": ids, "turn": turns[own], "cents": [books[k] if len(books[k]) == self.expected else [] for k in own]})

    def close(self) -> None:
        pass


def newest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task as one row a slot and moment, with the least and highest price: a busy market is a few rows a task."""
    by = ["market_id", "provider_id", "selection_id", "at_us"]
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(by).aggregate([("cents", "min"), ("cents", "max")])
        yield from t.select([*by, "cents_min", "cents_max"]).rename_columns([*by, "low", "high"]).to_batches()


def open_books(quotes: DataFrame, expected: int, shards: int = 64) -> DataFrame:
    """The stream BOOK of a stream of quotes (market_id, provider_id, selection_id, at_us, cents), active ones alone. A checkpoint keeps its number of shards."""
    rows = quotes.select("market_id", "provider_id", "selection_id", "at_us", "cents")
    slots = rows.mapInArrow(newest, "market_id bigint, provider_id bigint, selection_id bigint, at_us bigint, low bigint, high bigint")
    # a slot without a price at a moment tells nothing of the extremes there
    slots = slots.withColumns({"low": F.coalesce("low", F.lit(2**63 - 1)), "high": F.coalesce("high", F.lit(-(2**63) + 1))})
    slots = sharded(slots, ("market_id",), ("market_id", "provider_id", "selection_id"), shards)
    return slots.groupBy("shard").transformWithStateInPandas(OpenBooks(expected), BOOK, "append", "none")


def in_starts(rows: DataFrame, at: str, starts: int, home: str, run: Callable[[DataFrame], DataFrame], ended: Callable[[StreamingQuery], None] = lambda q: None) -> str:
    """Feed rows, cut into starts by ranges of the whole-numbered column at, to the stream run(rows), started anew for each on one checkpoint.

    home is a new folder that driver and executors share; ended is called with each start's query when it is done. What the stream tells is written to its folder "told", whose path is returned.
    """
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    disk = path(home).getFileSystem(spark._jsc.hadoopConfiguration())
    low, high = rows.agg(F.min(at), F.max(at)).first()
    part = F.least(F.lit(starts - 1), F.floor((F.col(at) - low) * starts / (high - low + 1))) if low is not None else F.lit(0)
    rows.withColumn("start", part.cast("int")).write.partitionBy("start").parquet(f"{home}/cut")
    for folder in ("feed", "told"):
        disk.mkdirs(path(f"{home}/{folder}"))
    own = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        for start in range(starts):
            if not disk.exists(path(f"{home}/cut/start={start}")):
                continue
            disk.rename(path(f"{home}/cut/start={start}"), path(f"{home}/feed/{start:04}"))
            stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(f"{home}/feed")
            out = run(stream).writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{home}/state")
            query = out.trigger(availableNow=True).start(f"{home}/told")
            query.awaitTermination()
            ended(query)
    finally:
        spark.conf.unset(PROVIDER) if own is None else spark.conf.set(PROVIDER, own)
    return f"{home}/told"


def held(spark: SparkSession, home: str, name: str) -> DataFrame:
    """The state variable name (version or slots) that a stream of in_starts has left, as one row a key."""
    own = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        shards = spark.read.format("statestore").option("path", f"{home}/state").option("stateVarName", name).load().select("value.held")
    finally:
        spark.conf.unset(PROVIDER) if own is None else spark.conf.set(PROVIDER, own)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                yield from _unpacked(shard).to_batches()

    return shards.mapInArrow(rows, {"version": VERSION, "slots": SLOTS}[name])


def new_home(folder: str) -> str:
    return f"{folder}/{uuid.uuid4().hex[:12]}"
