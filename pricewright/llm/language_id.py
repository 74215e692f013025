"""Language identification by partial matching: exact code lengths under frozen byte contexts.

For each language a context tree of variable order, ORDER at most, is filled from sampled documents: a node is a string of up to ORDER
bytes, and holds how often each byte followed it. A byte that a context has seen costs its share there; for another
one the context charges its escape (as many counts as it has distinct successors) and passes it on to the
context that is one byte shorter, down to a uniform floor over all 256 bytes. A context that was never seen passes
on for nothing, so the order that is used varies from byte to byte and from language to language. Bytes A-Z count as a-z; no others
are merged. The trees are frozen as counts, broadcast, and a text's code length is the sum over all its bytes in double
precision; the language with the shortest code wins.

The sample is the sample_rows documents of least hash per language, and total_rows in all: with over total_rows /
sample_rows languages each has an equal share of total_rows, and with over total_rows languages only that many, of least hash, are
learned. Languages are scored GROUP at a time, so tables stay small however many there are. Null texts and texts without a
letter are `und` with score 0, as is everything if nothing could be learned. Equal ids keep a row
each, and count as so many rows of the sample; ties go to the language that sorts first; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remainder, slices, spread, table
from .toxicity import buffers

ORDER = 3
GROUP = 8
SLICE = 1 << 18
LETTER = re.compile(r"[^\W\d_]")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] = LOWER[97:123]


def sampled(docs: DataFrame, sample_rows: int, folds: int = 4, held: int = 2, total_rows: int = 20_000) -> DataFrame:
    """(lang, text): per language the rows of least hash outside the held-out fold, sample_rows or its share of total_rows at most."""
    known = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(remainder("doc_id", folds) != held, F.lit(False))
    )
    known = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("place_hash"), "doc_id")
    langs = known.groupBy("lang").count().orderBy(F.xxhash64("lang"), "lang").limit(total_rows).select("lang")
    count = max(1, langs.count())
    few = max(1, min(sample_rows, total_rows // count))
    least = Window.partitionBy("lang").orderBy("place_hash", "doc_id")
    light = known.select("lang", "doc_id", "place_hash").withColumn("place", F.row_number().over(least)).where(F.col("place") <= few)
    # a limit within each group, which Spark applies before the shuffle too; of rows that are equal in all this, as many as were counted
    chosen = light.groupBy("lang", "doc_id", "place_hash").agg(F.count("*").alias("times"))
    chosen = chosen.join(F.broadcast(langs), "lang").select(*[F.col(c).alias(f"few_{c}") for c in ("lang", "doc_id", "place_hash")], "times")  # total_rows at most
    met = known.join(F.broadcast(chosen), (F.col("place_hash") == F.col("few_place_hash")) & (F.col("doc_id") == F.col("few_doc_id")) & (F.col("lang") == F.col("few_lang")))
    one = Window.partitionBy("lang", "doc_id", "place_hash").orderBy(F.lit(0))
    return met.withColumn("copy", F.row_number().over(one)).where(F.col("copy") <= F.col("times")).select("lang", "text")


def counted(sample: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, and (language, ORDER + 1 bytes, count) of all strings of the sample; a text begins after zeros."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            data, offsets = buffers(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            code = np.repeat(langs.indices.to_numpy(), np.diff(offsets)).astype(np.int64)
            key, n = np.unique(code << np.int64(32) | strings(LOWER[data], offsets), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [langs.dictionary.take(pa.array(key >> 32)), pa.array(key & 0xFFFFFFFF), pa.array(n)], names=["lang", "gram", "n"]
            )

    got = (
        sample.mapInArrow(count, "lang string, gram bigint, n bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()  # bounded by the sample: its distinct strings of four bytes in each language
    )
    lang = got.column("lang").combine_chunks().dictionary_encode() if got.num_rows else pa.array([], pa.string()).dictionary_encode()
    names = sorted(lang.dictionary.to_pylist())
    place = np.array([names.index(x) for x in lang.dictionary.to_pylist()], np.int64)
    code = place[lang.indices.to_numpy()] if got.num_rows else np.zeros(0, np.int64)
    order = np.lexsort((got.column("gram").to_numpy(), code))
    return names, code[order], got.column("gram").to_numpy().astype(np.int64)[order], got.column("n").to_numpy().astype(np.int64)[order]


def strings(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER bytes before it in the same text (0 before its begin), as one number."""
    out = data.astype(np.int64)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for k in range(1, ORDER + 1):
        before = np.zeros(len(data), np.int64)
        before[k:] = data[:-k]
        before[at < k] = 0
        out |= before << np.int64(8 * k)
    return out


class Trees:
    """The context trees of up to GROUP languages: logarithms of shares and escapes, by string, one column a language."""

    def __init__(self, languages: int, lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.languages = languages
        floor = np.full((1, languages), -np.log(256.0))
        lower = None
        for order in range(ORDER + 1):
            key = gram & ((1 << 8 * (order + 1)) - 1)
            seen, place = np.unique(key, return_inverse=True)
            count = np.zeros((len(seen), languages))
            np.add.at(count, (place, lang), n)
            context, within = np.unique(seen >> 8, return_inverse=True)
            whole, kinds = (np.zeros((len(context), languages)) for _ in range(2))
            np.add.at(whole, within, count)
            np.add.at(kinds, within, (count > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(whole > 0, np.log(kinds / (whole + kinds)), 0.0)
                share = np.log(count / (whole + kinds)[within])
            under = floor if lower is None else lower.costs(seen & ((1 << 8 * order) - 1))
            cost = np.where(count > 0, share, escape[within] + under)
            lower = _Level(order, seen, cost, context, escape, lower, floor)
        self.longest = lower

    def costs(self, gram: np.ndarray) -> np.ndarray:
        return self.longest.costs(gram)


class _Level:
    def __init__(self, order, seen, cost, context, escape, lower, floor):
        self.order, self.seen, self.cost, self.context, self.escape, self.lower, self.floor = order, seen, cost, context, escape, lower, floor

    def costs(self, gram: np.ndarray) -> np.ndarray:
        """The logarithm of each string's last byte under the bytes before it, a column a language."""
        out = np.empty((len(gram), self.floor.shape[1]))
        at = np.minimum(np.searchsorted(self.seen, gram), max(0, len(self.seen) - 1))
        hit = self.seen[at] == gram if len(self.seen) else np.zeros(len(gram), bool)
        out[hit] = self.cost[at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            rest = gram[miss]
            under = self.lower.costs(rest & ((1 << 8 * self.order) - 1)) if self.lower is not None else np.repeat(self.floor, len(miss), 0)
            if len(self.context):
                head = rest >> 8
                at = np.minimum(np.searchsorted(self.context, head), len(self.context) - 1)
                known = self.context[at] == head
                under[known] += self.escape[at[known]]
            out[miss] = under
        return out


_trees: dict[str, list[Trees]] = {}


def grown(names: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> list[Trees]:
    out = []
    for at in range(0, len(names), GROUP):
        mine = (lang >= at) & (lang < at + GROUP)
        out.append(Trees(min(GROUP, len(names) - at), lang[mine] - at, gram[mine], n[mine]))
    return out


def code_lengths(trees: list[Trees], column: pa.Array) -> Iterator[np.ndarray]:
    """For each group of languages the logarithm of each text's probability, a column a language."""
    data, offsets = buffers(column)
    gram, place = np.unique(strings(LOWER[data], offsets), return_inverse=True)
    full = np.flatnonzero(np.diff(offsets) > 0)
    for t in trees:
        code = np.zeros((len(column), t.languages))
        if len(full):
            code[full] = np.add.reduceat(t.costs(gram)[place], offsets[full], axis=0)
        yield code


def predict(docs: DataFrame, model) -> DataFrame:
    """(doc_id, lang_pred, score): score is the share of the best language by code lengths."""
    held, stamp = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = held.value[0]
        if stamp not in _trees:
            _trees.clear()
            _trees[stamp] = grown(*held.value)
        for batch in slices(batches, "text", SLICE):
            column = batch.column("text")
            n = batch.num_rows
            best, most, total = np.zeros(n, np.int64), np.full(n, -np.inf), np.zeros(n)
            for k, code in enumerate(code_lengths(_trees[stamp], column)):
                top = np.maximum(most, code.max(1))
                with np.errstate(invalid="ignore"):
                    total = total * np.where(np.isinf(most), 0.0, np.exp(most - top)) + np.exp(code - top[:, None]).sum(1)
                best = np.where(code.max(1) > most, k * GROUP + code.argmax(1), best)
                most = top
            known = [bool(names) and t is not None and LETTER.search(t) is not None for t in column.to_pylist()]
            score = np.divide(1.0, total, out=np.zeros(n), where=total > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([names[b] if ok else "und" for b, ok in zip(best, known)], pa.string()),
                    pa.array(np.where(known, score, 0.0)),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op7_language_id(spark, sf_dir: str, sample_rows: int = 300) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    model = counted(sampled(docs, sample_rows))
    return predict(docs, model).select(
        "doc_id", (F.coalesce(remainder("doc_id", 4), F.lit(0)) == 2).alias("held_out"), "lang_pred", "score"
    )
