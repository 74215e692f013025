"""Shared helpers: tables, scratch space for written intermediates, connected components."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (local runs and tests).
LOCAL_CHECKPOINTS = "/tmp/pricewright-checkpoints"
#: Edges (16 bytes each) up to which one task finds the components.
EDGES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: an input of fewer partitions than cores (one small file) is dealt out first."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it; only a local master may go without one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{LOCAL_CHECKPOINTS}"
        os.makedirs(LOCAL_CHECKPOINTS, exist_ok=True)
    return where.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{shared_dir(spark)}/pricewright/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back (survives lost executors)."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by written() once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/pricewright/" in path:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the tables that this application made by written(); for use when none of its results is read any more.

    Operators delete what they alone read; tables that their lazy results read stay until this is called.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(scratch(spark))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """The table, to be broadcast if it is counted to have so many rows at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n: the fold of a document."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % F.lit(n)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the text of each slice stays near limit bytes (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        total = batch.column(column).nbytes
        if total <= limit:
            yield batch
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i in range(n):
            if held and held + sizes[i] > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(sizes[i])
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # idle workers keep little


def same(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of a column by which they are sorted, one value at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(column)
        if not batch.num_rows:
            continue
        at = (np.flatnonzero(np.diff(values.to_numpy())) + 1).tolist()
        for a, b in zip([0, *at], [*at, batch.num_rows]):
            if held and held[0].column(column)[0] != values[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges (u, v), and the least node that it is connected with."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    low = np.arange(len(nodes))
    while True:  # the least label of either end hooks the other end's root, then paths are halved
        least = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, low[a], least)
        np.minimum.at(new, low[b], least)
        new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars around the least node of each of its local components."""
    u = v = np.zeros(0, np.int64)
    new, held = [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        node, root = united(np.concatenate([u, *(x for x, _ in new)]), np.concatenate([v, *(y for _, y in new)]))
        return root[root != node], node[root != node]

    for batch in batches:
        new.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        held += batch.num_rows
        if held > max(1 << 20, len(u)):
            u, v = joined()
            new, held = [], 0
    u, v = joined()
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Connected components of an edge table, as (node, component): the smallest node reachable.

    Each task first replaces its edges by stars around the least nodes of its own components. Alternating large-star and
    small-star rounds follow until nothing changes: a round is two grouped minima, each joined back to the edges (AQE
    splits the edges of a hub), and is written to the shared folder, so nothing is collected and a lost executor costs
    one round. Up to EDGES edges, one task does in one step what the rounds would come to.
    """
    e = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u < v")
    # edges are 16 bytes: as many partitions as cores are enough, however many the shuffles have
    cores = edges.sparkSession.sparkContext.defaultParallelism
    e = written(e.coalesce(cores).mapInArrow(_forest, "u bigint, v bigint"), "cc")
    if e.limit(EDGES + 1).count() <= EDGES:
        done = written(e.coalesce(1).mapInArrow(_forest, "u bigint, v bigint"), "cc")
        discard(e)
        return _named(done)
    last = _digest(e)
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # large star: every neighbour above u goes to the least of u's neighbourhood
        large = (
            both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u < v")
        )
        # small star: every neighbour below v, and v itself, goes to the least one
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = (
            large.join(low, "v")
            .select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v"))
            .where("u < v")
            .distinct()
        )
        discard_after, e = e, written(small.coalesce(cores), "cc")
        discard(discard_after)
        now = _digest(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    return _named(e)


def _named(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("u").alias("node"), F.col("u").alias("component"))
    return stars.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots.distinct())


def _digest(e: DataFrame):
    return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
