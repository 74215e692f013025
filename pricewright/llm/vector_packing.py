"""Best fit of pieces into sequences under several capacities at once: tokens, documents, attention cost.

A document is cut only where it is longer than the window, into whole windows and a shorter first piece. A piece demands
(length, 1 document, length squared) of a sequence, the square being what attention inside the piece costs. Pieces are dealt
into bounded chunks by a hash of their own number, so a document, a repeated id or a hot source is not a chunk. Within a chunk, pieces go
by falling length, each to the open sequence, among those with room in every dimension, that scores least: the weighted
dot-product of demand and residual ("dot"), or the weighted norm of the residual that would be left ("norm"). Without room
anywhere a new sequence is opened. Pieces of one length are placed in one vectorised step: a sequence that was best for one
of them is best for the next as long as it has room (both scores only fall), so sequences are filled in order of
their score, and the result is that of placing one by one.

Null and empty texts are packed as their end id alone. Equal ids are kept as rows of their own. Other columns are ignored;
an empty table gives an empty result. A text is held whole in a task, with its ids (4 bytes each).
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import from_json
from .common import slices, spread, table, written
from .packing import unpacked
from .token_counts import located

#: Pieces of a chunk on average.
CHUNK_ROWS = 1 << 16


class Encoder:
    """The ids of a text as little-endian 32-bit bytes.

    The vocabulary's ranks are its ids, so the rank encoder gives what the library gives (tests compare both on every
    character and on random texts), without its offsets; the library itself takes texts that name a special token.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        _, _, ranks = from_json(path)
        self.ranked = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return array("I", self.ranked.encode_ordinary(text)).tobytes()


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, vocabulary: str, window: int, end_id: int, keep_ids: bool) -> DataFrame:
    """One narrow pass: (doc_id, piece, start, length, ids_crc32[, packed]); of a document's pieces the first alone may be short."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = located(vocabulary)
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        words, codec = _encoders[path], pa.Codec("zstd", 1)
        for batch in slices(batches, "text"):
            rows, numbers, starts, lengths, crcs, packed = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = words.text(text) + end
                total = len(data) // 4
                low = 0
                for number, high in enumerate(range((total - 1) % window + 1, total + 1, window)):
                    part = data[4 * low : 4 * high]
                    rows.append(i)
                    numbers.append(number)
                    starts.append(low)
                    lengths.append(high - low)
                    crcs.append(zlib.crc32(part))
                    if keep_ids:
                        packed.append(codec.compress(np.frombuffer(part, "<u2").reshape(-1, 2).T.tobytes(), asbytes=True))
                    low = high
            out = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(numbers, pa.int32())]
            out += [pa.array(x, pa.int64()) for x in (starts, lengths, crcs)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out, names = [*out, pa.array(packed, pa.binary())], [*names, "packed"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", packed binary" * keep_ids)


def best_fit(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], score: str) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each of lengths, which fall; capacity and weights for (tokens, documents, attention cost).

    Demands and residuals are taken as shares of the capacity. Ties go to the sequence opened first.
    """
    whole = np.array(capacity, np.int64)
    scale = np.array(weights) / whole.astype(float) ** 2
    left = np.empty((1024, 3), np.int64)
    opened = 0
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    borders = np.flatnonzero(np.diff(lengths)) + 1
    for at, to in zip([0, *borders.tolist()], [*borders.tolist(), len(lengths)]):
        if at == to:
            continue
        n = int(lengths[at])
        demand = np.array([n, 1, n * n], np.int64)
        if (demand > whole).any():
            raise ValueError(f"a piece of {n} tokens is beyond the capacity of a sequence")
        fits = np.flatnonzero((left[:opened] >= demand).all(axis=1))
        if len(fits):
            now = left[fits]
            cost = now @ (demand * scale) if score == "dot" else ((now - demand) ** 2) @ scale
            fits = fits[np.argsort(cost, kind="stable")]
        room = (left[fits] // demand).min(axis=1) if len(fits) else np.zeros(0, np.int64)
        short = to - at - int(room.sum())
        if short > 0:  # no room for all of them: new sequences
            each = int((whole // demand).min())
            more = -(-short // each)
            while opened + more > len(left):
                left = np.concatenate([left, np.empty_like(left)])
            left[opened : opened + more] = whole
            fits, room = np.append(fits, np.arange(opened, opened + more)), np.append(room, np.full(more, each))
            opened += more
        ends = np.cumsum(room)
        used = int(np.searchsorted(ends, to - at)) + 1
        fits, room, ends = fits[:used], room[:used], ends[:used]
        room[-1] -= ends[-1] - (to - at)
        first = np.cumsum(room) - room
        turn = np.arange(to - at) - np.repeat(first, room)
        sequence[at:to] = np.repeat(fits, room)
        offset[at:to] = np.repeat(whole[0] - left[fits, 0], room) + turn * n
        left[fits] -= room[:, None] * demand
    return sequence, offset


def pack_vectors(
    docs: DataFrame,
    vocabulary: str = "byte_bpe_50k.json",
    window: int = 2048,
    end_id: int = 0,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05),
    score: str = "norm",
    keep_ids: bool = True,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """The pieces of docs (doc_id, text) with their sequence_id and offset there; ids where kept.

    documents and attention bound the pieces of a sequence and the sum of their squared lengths; None leaves them as wide as
    the window allows (a piece has a token at least, and squares do not exceed the square of the window).
    """
    if score not in ("norm", "dot"):
        raise ValueError("score is norm or dot")
    capacity = (window, window if documents is None else documents, window * window if attention is None else attention)
    cut = pieces(docs, vocabulary, window, end_id, keep_ids).withColumn("uid", F.monotonically_increasing_id())
    whole = written(cut, "vector_pieces")
    chunks = whole.count() // chunk_rows + 1
    names = [c for c in whole.columns if c != "packed"]

    def run(key: tuple, chunk: pa.Table) -> pa.Table:
        chunk = chunk.sort_by([("length", "descending"), ("uid", "ascending")])
        own, offset = best_fit(chunk.column("length").to_numpy(), capacity, weights, score)
        chunk = chunk.append_column("sequence_id", pa.array((key[0].as_py() << 32) + own)).append_column("offset", pa.array(offset))
        return chunk.drop_columns(["chunk"])

    kinds = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in names)
    dealt = whole.select(*names, F.pmod(F.xxhash64("uid"), F.lit(chunks)).alias("chunk")).groupBy("chunk")
    out = dealt.applyInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")
    if not keep_ids:
        return out.drop("uid")
    held = whole.select("uid", "packed").join(out.hint("shuffle_hash"), "uid").drop("uid")
    return unpacked(held.select(*(c for c in held.columns if c != "packed"), "packed"))


def op11_vector_packing(spark, sf_dir: str) -> DataFrame:
    return pack_vectors(spread(table(spark, sf_dir, "documents")), keep_ids=False)
