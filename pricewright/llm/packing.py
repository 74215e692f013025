"""Packing of token sequences into windows by non-negative least squares.

Documents are cut at multiples of the window; every piece falls into a length bin (unit tokens wide,
rounded up). Shallow combinations of bins that fill the window exactly are enumerated, a non-negative
least-squares fit against the histogram gives their repeat counts, the counts are rounded down to what
is there, and what is left is packed greedily, largest bins first. Only the histogram (window / unit
rows) reaches the driver. Pieces take their places by rank within (bin, chunk), where chunks split
a bin that holds many rows.

Null and empty texts are packed as their end id alone. Equal ids are kept as rows of their own. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_of_char
from .common import slices, spread, table, written
from .token_counts import located

#: Fixed value: the word pattern of the vocabulary; white space between words is dropped.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Characters whose class or lower case the tokenizer library sees otherwise, and marks that its older tables
#: do not order among others; texts with them, or with what may be a special token, go through the library whole.
UNSETTLED = re.compile(
    "[\u07fd\u0898-\u089f\u08ca-\u08d3\u09fe\u0c3c\u0d3b\u0d3c\u0eba\u1715\u1abf-\u1ace\u1df6-\u1dfa\ua82c"
    "\u03a3\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u1c89\u208f\u209d\u209e\u209f"
    "\ua7cb-\ua7dd\ua7e2\ua7f1\uab6c\uab6d\U00010000-\U0010ffff]|<\\|"
)
#: Texts of these characters only can be split by the plainer, faster pattern NARROW_WORDS.
WIDE = re.compile("[^\x00-\x1b\x20-\x7e\u00a1\u00ab\u00bb\u00bf\u00e0-\u00f6\u00f8-\u00ff\u2010-\u2027]")
#: What of ASCII is wide.
ODD = "\x1c\x1d\x1e\x1f\x7f"
NARROW_WORDS = re.compile("'(?:[stmd]|re|ve|ll)|[a-z\u00e0-\u00f6\u00f8-\u00ff]+|[0-9]|[^\\sa-z\u00e0-\u00f6\u00f8-\u00ff0-9]+")
MAX_WORDS = 300_000
#: Characters of a chunk that is kept.
LONGEST = 64
CHUNK_ROWS = 2_000
#: Pieces whose ids are unpacked at once.
SLICE_ROWS = 512


#: Stands before the last byte of a word; no text has this byte.
LAST = b"\xff"


def by_rank(path: str) -> Callable[[bytes], list[int]]:
    """The ids of a word whose last byte follows LAST, by a rank encoder over the vocabulary.

    An id is its own rank: bytes and last bytes have the lowest, merges follow in order. A marked last byte is two bytes, whose
    rank is below every merge, so it is one symbol before anything else happens.
    """
    import tiktoken

    with open(path) as f:
        model = json.load(f)["model"]
    chars, end = byte_of_char(), model["end_of_word_suffix"]
    ranks = {}
    for token, i in model["vocab"].items():
        whole = token.removesuffix(end) if token.endswith(end) and token != end else token
        if all(c in chars for c in whole):
            data = bytes(chars[c] for c in whole)
            ranks[data if whole == token else data[:-1] + LAST + data[-1:]] = i
    ranks.setdefault(LAST, len(model["vocab"]) + 1)  # an encoder has all single bytes; this one is never left alone
    encoding = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})
    return encoding._core_bpe.encode_single_piece


class WordIds(dict):
    """The ids of each word as little-endian 32-bit bytes; bounded."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merged = by_rank(path)
        self.chunks = Chunks(self)

    def __missing__(self, word: str) -> bytes:
        if len(self) > MAX_WORDS:
            self.clear()
        data = word.encode("utf-8")
        out = self[word] = array("I", self.merged(data[:-1] + LAST + data[-1:])).tobytes()
        return out

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        low = text.lower()
        # a text that is narrow in lower case has no unsettled character and nothing to normalise
        if "<|" not in low and (not any(c in low for c in ODD) if low.isascii() else not WIDE.search(low)):
            return b"".join(map(self.chunks.__getitem__, low.split()))
        if UNSETTLED.search(text):
            return self.whole(text)
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
            if UNSETTLED.search(text):
                return self.whole(text)
        text = text.lower()
        if WIDE.search(text):
            return b"".join(map(self.__getitem__, WORDS.findall(text)))
        return b"".join(map(self.chunks.__getitem__, text.split()))


class Chunks(dict):
    """The ids of what stands between white space in a narrow text, which no word crosses; bounded."""

    def __init__(self, words: WordIds):
        self.words = words

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > MAX_WORDS:
            self.clear()
        out = b"".join(map(self.words.__getitem__, NARROW_WORDS.findall(chunk)))
        if len(chunk) <= LONGEST:
            self[chunk] = out
        return out


_ids: dict[str, WordIds] = {}


def pieces(docs: DataFrame, vocabulary: str, window: int, end_id: int, keep_ids: bool) -> DataFrame:
    """One narrow pass: (doc_id, start, length, ids_crc32, doc_tokens[, packed]) per piece of at most window ids.

    packed has the low halves of the ids, then the high halves, compressed; unpacked() reads it.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = located(vocabulary)
        if path not in _ids:
            _ids[path] = WordIds(path)
        words, codec = _ids[path], pa.Codec("zstd", 1)
        for batch in slices(batches, "text"):
            rows, starts, lengths, crcs, totals, packed = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = words.text(text) + end
                total = len(data) // 4
                for start in range(0, total, window):
                    part = data[4 * start : 4 * (start + window)]
                    rows.append(i)
                    starts.append(start)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    totals.append(total)
                    if keep_ids:
                        packed.append(codec.compress(np.frombuffer(part, "<u2").reshape(-1, 2).T.tobytes(), asbytes=True))
            out = [batch.column("doc_id").take(pa.array(rows, pa.int64()))]
            out += [pa.array(x, pa.int64()) for x in (starts, lengths, crcs, totals)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                out, names = [*out, pa.array(packed, pa.binary())], [*names, "packed"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", packed binary" * keep_ids)


def unpacked(rows: DataFrame) -> DataFrame:
    """rows with their ids in place of packed."""
    names = [c for c in rows.columns if c != "packed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                n = part.column("length").to_numpy()
                ids = [
                    np.frombuffer(codec.decompress(x, 4 * m, asbytes=True), "<u2").reshape(2, -1).T.tobytes()
                    for x, m in zip(part.column("packed").to_pylist(), n.tolist())
                ]
                offsets = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), "<i4")))
                yield pa.RecordBatch.from_arrays([*map(part.column, names), lists], names=[*names, "ids"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names)
    return rows.mapInArrow(run, f"{kinds}, ids array<int>")


def combinations(units: int, depth: int = 3) -> list[tuple[int, ...]]:
    """All multisets of at most depth bins that fill a window of so many units exactly."""
    out, todo = [], [((), units, units)]
    while todo:
        parts, rest, most = todo.pop()
        if not rest:
            out.append(parts)
        elif len(parts) < depth:
            low = -(-rest // (depth - len(parts)))
            todo += [((*parts, b), rest - b, b) for b in range(min(rest, most), low - 1, -1)]
    return out


def fit(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """min |a x - b| over x >= 0, by an active set: columns enter by steepest descent and leave at zero."""
    x = np.zeros(a.shape[1])
    gram, aim = a.T @ a, a.T @ b
    active: list[int] = []
    for _ in range(rounds):
        slope = aim - gram[:, active] @ x[active]
        slope[active] = -np.inf
        j = int(np.argmax(slope))
        if slope[j] <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        active.append(j)
        while active:
            z = np.linalg.solve(gram[np.ix_(active, active)] + 1e-9 * np.eye(len(active)), aim[active])
            if (z > 1e-12).all():
                break
            now = x[active]
            bad = z <= 1e-12
            step = float((now[bad] / np.maximum(now[bad] - z[bad], 1e-300)).min())
            x[active] = now + step * (z - now)
            stay = x[active] > 1e-12
            for k, keep in zip(list(active), stay):
                if not keep:
                    x[k] = 0.0
            active = [k for k, keep in zip(active, stay) if keep]
        x[:] = 0
        if active:
            x[active] = z
    return x


def plan(histogram: np.ndarray, depth: int = 3) -> list[tuple[dict[int, int], int]]:
    """(bins with how many of each, repeats) for all of histogram[bin], bins 1 .. window units."""
    units = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    out = []
    present = set(np.flatnonzero(left).tolist())
    ways = [c for c in combinations(units, depth) if present.issuperset(c)]
    if ways:
        a = np.zeros((units + 1, len(ways)))
        for k, way in enumerate(ways):
            for b in way:
                a[b, k] += 1
        x = fit(a, left.astype(float))
        for k in np.argsort(-x):
            way = {b: ways[k].count(b) for b in ways[k]}
            n = min(int(x[k] + 1e-6), *(int(left[b]) // m for b, m in way.items()))
            if n > 0:
                out.append((way, n))
                for b, m in way.items():
                    left[b] -= n * m
    while left.any():  # greedy: each turn uses up a bin or more
        room, way = units, {}
        for b in np.flatnonzero(left)[::-1].tolist():
            m = min(int(left[b]), room // b)
            if m:
                way[b], room = m, room - m * b
        n = min(int(left[b]) // m for b, m in way.items())
        out.append((way, n))
        for b, m in way.items():
            left[b] -= n * m
    return out


def pack(
    docs: DataFrame,
    vocabulary: str = "word_bpe_49k.json",
    window: int = 2048,
    end_id: int = 1,
    unit: int = 16,
    keep_ids: bool = True,
) -> DataFrame:
    """The pieces of docs (doc_id, text) with their sequence_id and offset there; ids where kept.

    Ids are written once with their piece, places are found for rows without them, and one join brings them together.
    """
    spark = docs.sparkSession
    cut = pieces(docs, vocabulary, window, end_id, keep_ids).withColumn("piece", F.monotonically_increasing_id())
    whole = written(cut, "pieces")
    cut = whole.drop("packed").withColumn("bin", F.ceil(F.col("length") / unit))
    rows = cut.groupBy("bin").count().collect()  # window / unit rows at most
    histogram = np.zeros(-(-window // unit) + 1, np.int64)
    for bin_, n in rows:
        histogram[bin_] = n
    chunks = int(histogram.sum()) // CHUNK_ROWS + 1
    places, sequence, taken = [], 0, np.zeros(len(histogram), np.int64)
    for way, n in plan(histogram):
        slot = 0
        for b, m in sorted(way.items(), reverse=True):
            places.append((int(b), int(taken[b]), int(taken[b]) + n * m, m, sequence, slot))
            taken[b] += n * m
            slot += m
        sequence += n
    segments = spark.createDataFrame(
        places or [(0, 0, 0, 1, 0, 0)], "bin bigint, low bigint, high bigint, each bigint, base bigint, slot0 bigint"
    )
    light = cut.withColumn("chunk", F.pmod(F.xxhash64("piece"), F.lit(chunks)))  # a repeated or null id is not a chunk
    in_chunk = Window.partitionBy("bin", "chunk").orderBy("piece")
    ranked = light.withColumn("rank", F.row_number().over(in_chunk) - 1)
    before = Window.partitionBy("bin").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        light.groupBy("bin", "chunk").count().select("bin", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    )
    placed = (
        ranked.join(starts, ["bin", "chunk"])
        .withColumn("place", F.col("rank") + F.col("first"))
        .join(F.broadcast(segments), "bin")  # at most a few hundred rows, whatever the input
        .where("place >= low AND place < high")
        .withColumn("sequence_id", F.expr("base + (place - low) div each"))
        .withColumn("slot", F.expr("slot0 + (place - low) % each"))
    )
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select(
        "piece", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"),
    )
    if keep_ids:  # the side without ids is hashed, so rows with ids are neither sorted nor held
        return unpacked(whole.select("piece", "packed").join(out.hint("shuffle_hash"), "piece").select(*out.columns[1:], "packed"))
    return out.drop("piece")


def op1_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents")))
