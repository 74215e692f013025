"""Numbered migrations of a folder of mixed-version Parquet records, each applied once.

Records are read with schema evolution (columns that a file lacks are null). A step maps records of the version before it to its own; a ledger of applied
numbers is a table of the bucket store, whose commits refuse a number that another migration has taken meanwhile. Files of a step are
written before its number is entered, and only the files of the newest number are read, so a step that fails leaves nothing behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bucket_store import BucketStore

Step = Callable[[DataFrame], DataFrame]


class Migrations:
    """steps: {number: (name, step)}; records of root/records are those of number 0."""

    def __init__(self, spark: SparkSession, root: str, steps: dict[int, tuple[str, Step]]):
        self.spark, self.root, self.steps = spark, root.rstrip("/"), steps
        self.ledger = BucketStore(spark, f"{self.root}/ledger", buckets=1)

    def applied(self) -> dict[int, str]:
        """The folder of each number that was applied; a step whose name has changed since is an error."""
        out = {}
        for r in self.ledger.read("migration").collect():  # a row a migration
            entry = json.loads(r["payload"])
            if (own := self.steps.get(int(r["id"]))) and own[0] != entry["name"]:
                raise ValueError(f"migration {r['id']} was applied as {entry['name']}, not {own[0]}")
            out[int(r["id"])] = entry["folder"]
        return out

    def current(self) -> DataFrame:
        done = self.applied()
        folder = done[max(done)] if done else "records"
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.root}/{folder}")

    def run(self) -> list[int]:
        """Apply what was not applied yet, in order; the numbers."""
        ran = []
        for number in sorted(self.steps):
            if number in self.applied():
                continue
            name, step = self.steps[number]
            folder = f"records-{number}-{uuid.uuid4().hex[:8]}"
            step(self.current()).write.parquet(f"{self.root}/{folder}")
            entry = self.spark.createDataFrame([(str(number), json.dumps({"name": name, "folder": folder}), None)], "id string, payload string, at_us bigint")
            self.ledger.try_upsert({"migration": entry})
            ran.append(number)
        return ran


def transport_of_record(records: DataFrame) -> DataFrame:
    """Version 2: what came without a transport came by its provider."""
    known = F.coalesce("transport_provider_id", "provider_id") if "transport_provider_id" in records.columns else F.col("provider_id")
    return records.withColumns({"transport_provider_id": known, "version": F.greatest(F.col("version"), F.lit(2))})


def set_and_subject(records: DataFrame) -> DataFrame:
    """Version 3: set and subject of markets, which only records of version 3 have."""
    own = lambda c, kind: F.when(F.col("version") >= 3, F.col(c)).cast(kind) if c in records.columns else F.lit(None).cast(kind)
    return records.withColumns({"set_index": own("set_index", "int"), "subject_id": own("subject_id", "string"), "version": F.lit(3)})


STEPS: dict[int, tuple[str, Step]] = {2: ("transport_of_record", transport_of_record), 3: ("set_and_subject", set_and_subject)}
