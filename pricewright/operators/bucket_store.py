"""A store of records in hashed buckets with a numbered manifest: insert if absent, audit rows, retention, optimistic commits.

A commit writes data files first and then one manifest, numbered one above the one it is based on, by a rename that refuses
a number that is taken. Who comes second looks at what was committed meanwhile: where the buckets are others it goes on above
that, where one of them is its own it is refused and does its work again on the newer state. So a batch is visible whole or not at
all, a reader sees one version, and a batch reads and rewrites only the buckets that it touches, whatever the store has grown to.
Files that no manifest names (of refused or failed batches) are read by no one.

The manifest has an entry for each bucket and file folder, with its rows and its least time; a bucket of over FOLDERS folders is
written as one when it is touched next. Only bucket numbers and these entries reach the driver.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, payload string, at_us bigint"
#: Folders of a bucket beyond which it is written as one.
FOLDERS = 16
#: Tasks that the rows of a bucket are dealt to, so that a write has more tasks than buckets.
PARTS = 16
#: Times that a refused batch is done again.
TRIES = 8


class Refused(RuntimeError):
    """Another batch has committed to a bucket of this one since it read the store."""


class BucketStore:
    """Tables of (id, payload, at_us) under one path; a null at_us never expires.

    With head, a mark, ids that are alike up to the mark lie in one bucket, and purge is told such heads.
    before_commit is called between a batch's writing and its commit, for tests of what happens meanwhile.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, before_commit: Callable[[], None] | None = None, head: str | None = None):
        self.spark, self.path, self.buckets, self.before_commit, self.head = spark, path.rstrip("/"), buckets, before_commit, head
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsc.hadoopConfiguration()
        self._disk = self._jvm.Path(self.path).getFileSystem(self._conf)

    # manifests

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifest/{version:012}.json"

    def version(self) -> int:
        """The number of the newest manifest; 0 while there is none."""
        folder = self._jvm.Path(f"{self.path}/manifest")
        if not self._disk.exists(folder):
            return 0
        names = (f.getPath().getName() for f in self._disk.listStatus(folder))
        return max((int(n.split(".")[0]) for n in names if n[:1].isdigit()), default=0)

    def manifest(self, version: int | None = None) -> dict:
        """{"buckets": how many, "head": mark, "tables": {table: {bucket: {folder: {"rows", "least"}}}}, "touched": [[table, bucket]]}."""
        version = self.version() if version is None else version
        if not version:
            return {"buckets": self.buckets, "head": self.head, "tables": {}, "touched": []}
        stream = self._disk.open(self._jvm.Path(self._manifest(version)))
        try:
            got = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        if got["buckets"] != self.buckets:
            raise ValueError(f"the store has {got['buckets']} buckets")
        if got.get("head") != self.head:
            raise ValueError(f"the store's ids have heads up to {got.get('head')!r}")
        return got

    def _publish(self, version: int, manifest: dict) -> bool:
        """Make it the manifest of that number; False if the number is taken."""
        own, final = (self._jvm.Path(p) for p in (f"{self.path}/manifest/.{uuid.uuid4().hex}", self._manifest(version)))
        out = self._disk.create(own)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        gateway = self.spark.sparkContext._gateway
        try:
            self._jvm.FileContext.getFileContext(own.toUri(), self._conf).rename(own, final, gateway.new_array(self._jvm.Options.Rename, 0))
            return True
        except Exception as e:
            if "FileAlreadyExists" not in str(e):
                raise
            self._disk.delete(own, False)
            return False

    def _commit(self, base: int, changes: dict[str, dict[str, dict]], replaced: set[tuple[str, str]]) -> int:
        """Publish changes {table: {bucket: folders}}, in place of a bucket's folders where it is replaced, else beside them."""
        if self.before_commit is not None:
            self.before_commit()
        touched = {(t, b) for t, by in changes.items() for b in by} | replaced
        while True:
            newest = self.version()
            for v in range(base + 1, newest + 1):
                if touched & set(map(tuple, self.manifest(v)["touched"])):
                    raise Refused(f"version {v} has changed a bucket of a batch that is based on {base}")
            now = self.manifest(newest)
            for table, bucket in replaced:
                now["tables"].get(table, {}).pop(bucket, None)
            for table, by in changes.items():
                for bucket, folders in by.items():
                    now["tables"].setdefault(table, {}).setdefault(bucket, {}).update(folders)
            now["touched"] = sorted(map(list, touched))
            if self._publish(newest + 1, now):
                return newest + 1
            base = newest

    # data

    def _key(self) -> Column:
        """What rows are dealt by: the id, or its head."""
        return F.col("id") if self.head is None else F.substring_index("id", self.head, 1)

    def _place(self, key: Column) -> dict[str, Column]:
        """The bucket of a key, and its part of that."""
        spot = F.xxhash64(key)
        return {"bucket": F.pmod(spot, F.lit(self.buckets)).cast("int"), "part": F.pmod(F.shiftright(spot, 32), F.lit(PARTS)).cast("int")}

    def _bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", self._place(self._key())["bucket"])

    def dealt(self, rows: DataFrame, key: Column | None = None) -> DataFrame:
        """rows by bucket and part of a bucket; with key, rows to come whose ids, or their heads, will be that.

        What is made of them by windows or groups of bucket, part and key can be stored with these columns, and is not shuffled again.
        """
        return rows.withColumns(self._place(self._key() if key is None else key)).repartition("bucket", "part")

    def _write(self, table: str, rows: DataFrame) -> dict[str, dict]:
        """Write rows (SCHEMA, or dealt) by bucket; the folder of each bucket that has any, with its rows and least time."""
        folder = f"data/{table}-{uuid.uuid4().hex[:12]}"
        placed = rows if "part" in rows.columns else self.dealt(rows)
        placed.drop("part").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        there = self.spark.read.schema(f"{SCHEMA}, bucket int").parquet(f"{self.path}/{folder}")
        stats = there.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("at_us").alias("least")).collect()  # a row a bucket
        return {str(r["bucket"]): {f"{folder}/bucket={r['bucket']}": {"rows": r["rows"], "least": r["least"]}} for r in stats}

    def read(self, table: str, buckets: set[str] | None = None, version: int | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets, at a version."""
        by = self.manifest(version)["tables"].get(table, {})
        folders = [f"{self.path}/{f}" for b, own in sorted(by.items()) if buckets is None or b in buckets for f in own]
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def _new(self, table: str, incoming: DataFrame, base: int) -> DataFrame:
        """The rows of incoming that the table lacks; of the table, only the buckets that incoming falls into are read.

        Rows that come dealt stay so if nothing is stored.
        """
        rows = incoming.where("id IS NOT NULL")
        own = F.struct(F.col("payload").alias("p"))  # a struct, so that a null payload counts as one
        place = [c for c in ("bucket", "part") if c in rows.columns]
        each = rows.groupBy(*place, "id").agg(F.min(own).alias("low"), F.max(own).alias("high"), F.min("at_us").alias("at_us"))
        if self.manifest(base)["tables"].get(table):
            place = []
            touched = {str(r[0]) for r in self._bucket(rows).select("bucket").distinct().collect()}  # a row a bucket
            met = each.join(self.read(table, touched, base).select("id", own.alias("old")), "id", "left")
        else:  # nothing is stored: incoming is not computed only to learn its buckets
            met = each.withColumn("old", F.lit(None).cast("struct<p:string>"))
        same = (F.col("low") == F.col("high")) & (F.col("old").isNull() | (F.col("old") == F.col("low")))
        tested = F.assert_true(same, F.concat(F.lit("an id is stored with another payload: "), F.col("id")))
        if place:
            own_place = [F.col(c) == at for c, at in self._place(self._key()).items()]
            met = met.where(F.assert_true(own_place[0] & own_place[1], F.concat(F.lit("an id is dealt to another bucket: "), F.col("id"))).isNull())
        fresh = met.where(F.when(tested.isNull(), F.col("old").isNull()))
        return fresh.select(*place, "id", F.col("low.p").alias("payload"), "at_us")

    def try_upsert(self, tables: dict[str, DataFrame], audit: str | None = None) -> int:
        """One attempt at storing new rows of each table in one commit; the version that has them.

        A batch is computed once for each of its tables, and once more for its buckets where the table has rows; a costly one is to be written first.
        A stored id with another payload fails the whole batch, as do two payloads of one id in it. audit names a table that gets a row
        for each row stored. A batch that brings nothing new commits nothing.
        """
        base = self.version()
        changes: dict[str, dict[str, dict]] = {}
        replaced: set[tuple[str, str]] = set()
        for table, incoming in tables.items():
            changes[table] = self._write(table, self._new(table, incoming, base))
            if audit is not None and changes[table]:
                folders = [f"{self.path}/{f}" for own in changes[table].values() for f in own]
                told = F.to_json(F.struct(F.lit(f"{table}_stored").alias("event"), F.col("id").alias("id")))
                rows = self.spark.read.schema(SCHEMA).parquet(*folders).select(F.concat(F.lit(f"{table}:"), "id").alias("id"), told.alias("payload"), "at_us")
                for bucket, own in self._write(audit, rows).items():
                    changes.setdefault(audit, {}).setdefault(bucket, {}).update(own)
            self._compact(table, changes[table], replaced, base)
        if not any(changes.values()):
            return base
        return self._commit(base, changes, replaced)

    def _compact(self, table: str, own: dict[str, dict], replaced: set[tuple[str, str]], base: int) -> None:
        """Buckets in own that have too many folders become one folder, new rows included."""
        held = self.manifest(base)["tables"].get(table, {})
        full = {b for b in own if len(held.get(b, {})) >= FOLDERS}
        if not full:
            return
        folders = [f"{self.path}/{f}" for b in full for f in own[b]]
        whole = self._write(table, self.read(table, full, base).unionByName(self.spark.read.schema(SCHEMA).parquet(*folders)))
        own.update(whole)
        replaced |= {(table, b) for b in full}

    def upsert(self, tables: dict[str, DataFrame], audit: str | None = None) -> int:
        """try_upsert, done again while another batch comes first."""
        return self._again(lambda: self.try_upsert(tables, audit))

    def purge(self, table: str, before_us: int, referenced: DataFrame) -> int:
        """Remove rows older than before_us whose id, or its head, is not among referenced (id); how many went.

        Buckets without an old row are neither read nor written. In a bucket of one folder what is not old is written again from where it lies,
        without a shuffle; a bucket of several folders becomes one.
        """
        return self._again(lambda: self._purge(table, before_us, referenced))

    def _purge(self, table: str, before_us: int, referenced: DataFrame) -> int:
        base = self.version()
        by = self.manifest(base)["tables"].get(table, {})
        old = {b for b, own in by.items() if any(x["least"] is not None and x["least"] < before_us for x in own.values())}
        if not old:
            return 0
        expired = F.coalesce(F.col("at_us") < before_us, F.lit(False))
        named = referenced.select(F.col("id").alias("key"))
        moved = self.read(table, old, base).where(expired).join(named, self._key() == F.col("key"), "left_semi")
        whole = {b for b in old if len(by[b]) == 1}  # a file of these has rows of one bucket, so no more files come of them
        if whole != old:
            moved = moved.unionByName(self.read(table, old - whole, base).where(~expired))
        kept = self.dealt(moved)
        if whole:
            kept = kept.unionByName(self.read(table, whole, base).where(~expired).withColumns(self._place(self._key())))
        left = self._write(table, kept)
        count = lambda parts: sum(x["rows"] for own in parts for x in own.values())
        gone = count(by[b] for b in old) - count(left.values())
        if gone:
            self._commit(base, {table: left}, {(table, b) for b in old})
        return gone

    @staticmethod
    def _again(attempt: Callable[[], int]) -> int:
        for turn in range(TRIES):
            try:
                return attempt()
            except Refused:
                if turn == TRIES - 1:
                    raise
        raise AssertionError


def opportunity_tables(found: DataFrame) -> dict[str, DataFrame]:
    """The tables that one commit stores for opportunities (opportunity_id, plan, quote_ids, payload): themselves and their legs in order."""
    own = F.col("opportunity_id").cast("string")
    never = F.lit(None).cast("bigint").alias("at_us")
    legs = found.select(own.alias("own"), F.posexplode("quote_ids").alias("ordinal", "quote_id"))
    return {
        "opportunity": found.select(own.alias("id"), F.to_json(F.struct("payload", "plan")).alias("payload"), never),
        "leg": legs.select(F.concat_ws(":", "own", "ordinal").alias("id"), F.to_json(F.struct("own", "ordinal", "quote_id")).alias("payload"), never),
    }
