"""SentencePiece encoding and decoding of a piece vocabulary with byte fallback, by batched Viterbi.

Texts fall into words at borders that no piece crosses. New words of equal length advance together:
hashes of all their substrings probe the sorted keys of the pieces, and at each position the longest
arc into it that may follow the piece before it is taken by a vectorised maximum, which is stored as
the backpointer. The vocabulary ranks merges and has no likelihoods, so an arc's weight is whether
the two pieces may stand side by side in a merge encoding; exactly one path has only such arcs.
Characters outside the vocabulary become their UTF-8 bytes' pieces.

Null and empty texts have no ids. Equal ids keep a row each; other columns are not read; an
empty table gives an empty result. Decoding null ids gives an empty text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import Merges, from_pieces
from .common import slices, spread, table
from .token_counts import located

SPACE = "▁"
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
MAX_WORDS = 1_000_000
#: Text bytes whose new words are encoded together: longer batches share more of the array steps.
SLICE = 8 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Encoder(dict):
    """Ids of each word as little-endian 32-bit bytes; bounded."""

    def __init__(self, path: str):
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.texts = [sp.id_to_piece(i) for i in range(size)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(size)]
        self.byte0 = sp.piece_to_id("<0x00>")
        self.merges = from_pieces([t if ok else "" for t, ok in zip(self.texts, plain)], [sp.get_score(i) for i in range(size)])
        usable = [i for i in range(size) if plain[i] and i in self.merges.reached]
        if any(SPACE in self.texts[i].lstrip(SPACE) for i in usable):
            raise ValueError("a piece goes over a word border")
        self.raw = [bytes([i - self.byte0]) if sp.is_byte(i) else t.replace(SPACE, " ").encode("utf-8") for i, t in enumerate(self.texts)]
        self.longest = max(len(self.texts[i]) for i in usable)
        keys = np.array([self.hashed(self.texts[i]) for i in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(usable, np.int64)[order]
        # neighbours of characters that some piece has: between all others is a border
        self.inside = {t[k : k + 2] for t in (self.texts[i] for i in usable) for k in range(len(t) - 1)}

    @staticmethod
    def hashed(text: str) -> int:
        h = 0
        for c in text:
            h = (h * int(_ODD) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def segments(self, word: str) -> list[str]:
        inside = self.inside
        cuts = [k for k, pair in enumerate(map(str.__add__, word, word[1:]), 1) if pair not in inside]
        if not cuts:
            return [word]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def learn(self, words: list[str]) -> None:
        """Encode new words, segment by segment."""
        parts = {w: self.segments(w) for w in words}
        fresh: dict[int, list[str]] = {}
        for t in set().union(*parts.values()):
            if t not in self:
                fresh.setdefault(len(t), []).append(t)
        for n, group in fresh.items():
            for at in range(0, len(group), 8192):
                self.viterbi(group[at : at + 8192], n)
        for w, p in parts.items():
            if len(p) > 1:
                self[w] = b"".join([self[t] for t in p])

    def allowed(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        pairs, back = np.unique(before * Merges.SPAN + piece, return_inverse=True)
        return np.array(self.merges.all_fit(pairs.tolist()), bool)[back]

    def viterbi(self, group: list[str], n: int) -> None:
        chars = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32).reshape(-1, n)
        unknown = len(self.texts)
        m = len(group)
        found = []  # found[L - 1][:, i]: the piece of length L at i, or -1
        h = np.zeros((m, n), np.uint64)
        for size in range(1, min(n, self.longest) + 1):
            h = h[:, : n - size + 1] * _ODD + (chars[:, size - 1 :].astype(np.uint64) + np.uint64(1))
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            piece = np.where(self.keys[at] == h, self.ids[at], -1)
            if size == 1:
                piece = np.where(piece < 0, unknown, piece)
            found.append(piece)
        last = np.full((m, n + 1), -1, np.int64)
        back = np.zeros((m, n + 1), np.int64)
        for i in range(1, n + 1):
            sizes = np.arange(1, min(i, len(found)) + 1)
            piece = np.stack([found[s - 1][:, i - s] for s in sizes])
            before = last[:, i - sizes].T
            ok = piece >= 0
            ok[: i - 1] &= before[: i - 1] >= 0  # an arc from the word's begin follows nothing
            row, col = np.nonzero(ok[: i - 1])
            if len(row):
                ok[row, col] = self.allowed(before[row, col], piece[row, col])
            weight = np.where(ok, sizes[:, None], 0)
            back[:, i] = weight.max(0)
            won = back[:, i] > 0
            last[won, i] = piece[back[won, i] - 1, np.flatnonzero(won)]
        for row, text in enumerate(group):
            ids, i = [], n
            while i:
                piece = int(last[row, i])
                size = int(back[row, i])
                ids.append([piece] if piece != unknown else [self.byte0 + b for b in text[i - 1].encode("utf-8")])
                i -= size
            self[text] = np.array([x for part in reversed(ids) for x in part], "<u4").tobytes()

    def many(self, texts: list[str | None]) -> list[bytes]:
        if len(self) > MAX_WORDS:
            self.clear()
        split = [WORDS.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        self.learn([w for w in set().union(*split) if w not in self])
        return [b"".join(map(self.__getitem__, s)) for s in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").removeprefix(" ")


_encoders: dict[str, Encoder] = {}


def encoder(model: str) -> Encoder:
    path = located(model)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, ids) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(model)
        for batch in slices(batches, "text", SLICE):
            ids = [np.frombuffer(b, "<i4") for b in known.many(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, text) of each row of encoded (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(model)
        for batch in batches:
            texts = [known.decode(np.array(x or [], np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def op2_sentencepiece(spark, sf_dir: str, model: str = "piece_bpe_32k.model") -> DataFrame:
    """Per document: ids of its whole text, and whether decoding them gives the text back."""
    docs = spread(table(spark, sf_dir, "documents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(model)
        for batch in slices(batches, "text", SLICE):
            texts = batch.column("text").to_pylist()
            ids = known.many(texts)
            back = [known.decode(np.frombuffer(b, "<i4")) == (t or "") for b, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(b) // 4 for b in ids], pa.int64()), pa.array([zlib.crc32(b) for b in ids], pa.int64()), pa.array(back)],
                names=["doc_id", "n_ids", "ids_crc32", "round_trip"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_ids bigint, ids_crc32 bigint, round_trip boolean")
