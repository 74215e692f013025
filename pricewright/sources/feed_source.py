"""Scripted and landed feeds as Spark data sources.

`scripted_feed` serves poll outcomes (payloads, failures, delays) as a batch or as a stream of
micro-batches, one partition per feed. Real feeds land as JSON lines and are read by landed().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "provider_id string, poll int, event_id string, payload string, error string"


class FeedPartition(InputPartition):
    def __init__(self, provider_id: str, polls: list[dict]):
        self.provider_id, self.polls = provider_id, polls


def _rows(provider_id: str, polls: list[dict], first: int = 0) -> Iterator[tuple]:
    for k, poll in enumerate(polls, first):
        if poll.get("error"):
            yield provider_id, k, None, None, poll["error"]
            continue
        for event_id, payload in poll.get("events", {}).items():
            yield provider_id, k, event_id, json.dumps(payload), None


class ScriptedReader(DataSourceReader):
    def __init__(self, script: dict[str, list[dict]]):
        self.script = script

    def partitions(self) -> list[FeedPartition]:
        return [FeedPartition(p, polls) for p, polls in sorted(self.script.items())]

    def read(self, partition: FeedPartition) -> Iterator[tuple]:
        return _rows(partition.provider_id, partition.polls)


class ScriptedStream(SimpleDataSourceStreamReader):
    """Each micro-batch is one poll of every feed; a slow consumer never builds up a backlog of ticks."""

    def __init__(self, script: dict[str, list[dict]]):
        self.script = script

    def initialOffset(self) -> dict:
        return {"poll": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        k = start["poll"]
        rows = [r for p, polls in sorted(self.script.items()) for r in _rows(p, polls[k : k + 1], k)]
        return iter(rows), {"poll": k + 1 if any(k < len(x) for x in self.script.values()) else k}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for k in range(start["poll"], end["poll"]) for p, polls in sorted(self.script.items()) for r in _rows(p, polls[k : k + 1], k)])


class ScriptedFeed(DataSource):
    """Option script: JSON of {provider: [{"events": {id: payload}} or {"error": kind}, ...]}."""

    @classmethod
    def name(cls) -> str:
        return "scripted_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ScriptedReader:
        return ScriptedReader(json.loads(self.options["script"]))

    def simpleStreamReader(self, schema) -> ScriptedStream:
        return ScriptedStream(json.loads(self.options["script"]))


def scripted(spark: SparkSession, script: dict[str, list[dict]], stream: bool = False) -> DataFrame:
    spark.dataSource.register(ScriptedFeed)
    reader = spark.readStream if stream else spark.read
    return reader.format("scripted_feed").option("script", json.dumps(script)).load()


def landing(spark: SparkSession, name: str) -> str:
    """A fresh folder for landed files in the place that all machines share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file:///tmp/pricewright-landing"
    return f"{where.rstrip('/')}/landed/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON lines with exact decimals; a malformed line is a row with only _corrupt_record set."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def owned(snapshots: DataFrame, requested: DataFrame) -> DataFrame:
    """(provider_id, event_id, issue): snapshots whose ids are not those that were asked for."""
    met = snapshots.join(requested.select("provider_id", "event_id", F.lit(True).alias("asked")), ["provider_id", "event_id"], "left")
    return met.select("provider_id", "event_id", F.when(F.col("asked").isNull(), "snapshot_ownership_mismatch").alias("issue"))


def request_issue(provider: str | None, start=None, end=None, longest: int = 200) -> str | None:
    """What is wrong with a request's arguments, or None."""
    if not provider or provider != provider.strip() or len(provider) > longest:
        return "invalid_provider"
    if start is not None and end is not None and end <= start:
        return "invalid_time_range"
    return None
