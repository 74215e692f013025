"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its distinct words, word pairs and one-word skip-grams, hashed to 2^bits
coordinates; the whole text counts. The learner is online and per-coordinate (its rates follow each
coordinate's own gradients), and its L1 term leaves few weights, which are all that is broadcast: 2^bits
entries at most. It learns from a sample of labelled rows bounded by sample_rows, the rows of least
hash, streamed in that order through one task, epochs times.

Null and empty texts have no features and get the intercept's score. Equal ids keep a row each. Other
columns are never read. Without any labelled row the intercept is 0 and every score 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remainder, slices, spread, table

SLICE = 1 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    if len(_tables.get("p", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("p", int(_M)), ("q", pow(int(_M), -1, 1 << 64))):
            x = np.full(size, np.uint64(base))
            x[0] = 1
            _tables[name] = np.cumprod(x)
    return _tables["p"], _tables["q"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _letters() -> np.ndarray:
    """Each byte's random number, 0 for what stands between words; A-Z as a-z, bytes from 128 are letters."""
    numbers = _mixed(np.arange(1, 257, dtype=np.uint64) * _M) | np.uint64(1)
    out = np.zeros(256, np.uint64)
    word = [*range(48, 58), *range(97, 123), *range(128, 256)]
    out[word] = numbers[word]
    out[65:91] = out[97:123]
    return out


LETTERS = _letters()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of texts that lie end to end in data, and the text of each word."""
    value = LETTERS[data]
    inside = value != 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begin[edges] = inside[edges]
    at = np.flatnonzero(begin)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p, q = _powers(len(data))
    sums = np.add.reduceat(value * p[: len(data)], at)
    doc = np.searchsorted(offsets, at, "right") - 1
    return _mixed(sums * q[at]), doc


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(coordinate, text) of every word, pair of neighbours and skip-gram; repeated ones included."""
    h, doc = word_hashes(data, offsets)
    parts, docs = [h], [doc]
    for gap, odd in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
        same = doc[:-gap] == doc[gap:]
        parts.append(_mixed(h[:-gap][same] * np.uint64(odd) + h[gap:][same]))
        docs.append(doc[gap:][same])
    x = (np.concatenate(parts) * _M) >> np.uint64(64 - bits)
    return x.astype(np.int64), np.concatenate(docs)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column end to end, and offsets; nulls are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Ftrl:
    """Per-coordinate FTRL-proximal: w follows from z and n, and is 0 while |z| <= l1."""

    def __init__(self, bits: int, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0):
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z0 = self.n0 = 0.0

    def weights(self, i) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def intercept(self) -> float:
        return -self.z0 / ((self.beta + self.n0**0.5) / self.alpha)

    def learn(self, i: np.ndarray, label: float) -> None:
        w, b = self.weights(i), self.intercept()
        g = 1 / (1 + np.exp(-np.clip(b + w.sum(), -30, 30))) - label
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g
        self.z0 += g - ((self.n0 + g * g) ** 0.5 - self.n0**0.5) / self.alpha * b
        self.n0 += g * g


def train(labelled: DataFrame, bits: int = 20, epochs: int = 2) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero weights (coordinates, values) and the intercept, from rows (text, label, turn) in order of turn."""

    def as_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            x, doc = features(*buffers(batch.column("text")), bits)
            key = np.unique(doc << np.int64(bits) | x)
            cuts = np.searchsorted(key >> bits, np.arange(batch.num_rows + 1)).astype(np.int32)
            coordinates = pa.array((key & ((1 << bits) - 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("turn"), batch.column("label"), pa.ListArray.from_arrays(pa.array(cuts), coordinates)],
                names=["turn", "label", "x"],
            )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ftrl(bits)
        for batch in batches:
            x = batch.column("x")
            flat, cuts = x.values.to_numpy(), x.offsets.to_numpy()
            for k, label in enumerate(batch.column("label").to_pylist()):
                model.learn(flat[cuts[k] : cuts[k + 1]], float(label))
        w = model.weights(slice(None))
        kept = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(kept, -1)), pa.array(np.append(w[kept], model.intercept()))], names=["i", "w"]
        )

    rows = (
        labelled.select("text", F.col("label").cast("int").alias("label"), "turn")
        .mapInArrow(as_features, "turn bigint, label int, x array<int>")
        .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
        .repartition(1)
        .sortWithinPartitions("epoch", "turn", "label")
        .select("x", "label")
    )
    got = rows.mapInArrow(learn, "i bigint, w double").collect()  # 2^bits + 1 rows at most
    i, w = np.array([r.i for r in got], np.int64), np.array([r.w for r in got])
    return i[i >= 0], w[i >= 0], float(w[i < 0].sum())


def score(
    docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = 20, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns keep and the score of each row, in one narrow pass."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, w, b = held.value
        weights = np.zeros(1 << bits)
        weights[i] = w
        for batch in slices(batches, "text", SLICE):
            x, doc = features(*buffers(batch.column("text")), bits)
            hit = weights[x] != 0
            key = np.unique(doc[hit] << np.int64(bits) | x[hit])
            total = np.bincount(key >> bits, weights[key & ((1 << bits) - 1)], batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, keep), pa.array(1 / (1 + np.exp(-np.clip(total + b, -700, 700))))], names=[*keep, "score"]
            )

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, f"{kinds}, score double")


def learned(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, folds: int = 5):
    """A model from the labelled rows outside fold 0 (crc32 of the id modulo folds), sample_rows at most; of rows with one id, one."""
    few = (
        labels.where(F.col("toxic").isin(0, 1) & (remainder("doc_id", folds) != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label"))
        .withColumn("turn", F.xxhash64("doc_id"))
        .orderBy("turn", "doc_id")
        .limit(sample_rows)
    )
    joined = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(few), "doc_id")
    # a limit of one within each id, which Spark applies before the shuffle too: the bound is one of rows
    own = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    return train(joined.withColumn("place", F.row_number().over(own)).where("place = 1"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = learned(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        (F.coalesce(remainder("doc_id", 5), F.lit(0)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
