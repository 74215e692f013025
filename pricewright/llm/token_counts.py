"""Token counts by a compiled finite-state transducer.

The byte-pair vocabulary is compiled, state by state as texts call for them, into a deterministic
transducer over bytes: a state holds every unfinished piece (trie node), the piece before it and how
many pieces that makes relative to the finished prefix; a transition carries the change of the
emitted-token count. Every text is cut after each CHUNK characters, wherever that falls, and each
chunk becomes a state map. Between texts' chunks the state is the word that is still open, so a map
takes the open word that comes in to a count and the open word that goes out; it is constant after the chunk's first
certain word border and is held as (head, count, tail): the head joins the word that comes in, the tail is the one that goes out. A chunk without
a border is its own map. Maps compose associatively and are folded as a balanced scan.

Nulls count as empty texts (0 bytes, 0 tokens); rows are never merged, so repeated ids give repeated
rows; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merges, from_json
from .common import slices, spread, table

#: Characters on whose class the tokenizer library and the regex module disagree, and all beyond the
#: basic plane (where many more do): fixed values; texts with them go through the library.
UNSETTLED = re.compile(
    "[\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d\u209e\u209f"
    "\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d\U00010000-\U0010ffff]"
)
#: Fixed value: the word pattern of the byte-level vocabulary.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A white-space character after another character always begins a new word, whatever came before.
BORDER = re.compile(r"(?<=\S)(?=\s)")
#: Characters of a chunk.
CHUNK = 1 << 12
MAX_STATES = 400_000
MAX_WORDS = 600_000


class Transducer:
    def __init__(self, path: str):
        self.merges, texts, _ = from_json(path)
        self.trie: dict[int, int] = {}
        self.piece, self.inner = [-1], [False]
        for i, t in enumerate(texts):
            if not t or (self.merges.split[i] is None and len(t) > 1):
                continue  # special, or never produced by a merge
            node = 0
            for b in t:
                key = node << 8 | b
                nxt = self.trie.get(key)
                if nxt is None:
                    nxt = self.trie[key] = len(self.piece)
                    self.piece.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            self.piece[node] = i
        self.reset()

    def reset(self) -> None:
        self.states, self.ids = [((0, -1, 0),)], {((0, -1, 0),): 0}
        self.next: dict[int, tuple[int, int]] = {}

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """Determinise one transition: its target and the change of the token count."""
        alive, ended = [], None
        for node, before, count in self.states[state]:
            node = self.trie.get(node << 8 | byte)
            if node is None:
                continue
            piece = self.piece[node]
            if ended is None and piece >= 0 and (before < 0 or self.merges.fits(before, piece)):
                ended = piece, count + 1
            if self.inner[node]:
                alive.append((node, before, count))
        piece, step = ended
        key = (*((n, p, c - step) for n, p, c in alive), (0, piece, 0))
        target = self.ids.get(key)
        if target is None:
            target = self.ids[key] = len(self.states)
            self.states.append(key)
        self.next[state << 8 | byte] = out = (target, step)
        return out

    def count(self, word: bytes) -> int:
        if len(self.states) > MAX_STATES:
            self.reset()
        state, total, known = 0, 0, self.next
        for b in word:
            state, step = known.get(state << 8 | b) or self.compile(state, b)
            total += step
        return total


class Counter(dict):
    """Tokens of each word, through the transducer; bounded."""

    def __init__(self, path: str):
        self.machine, self.path = Transducer(path), path
        self.library = None

    def __missing__(self, word: str) -> int:
        if len(self) > MAX_WORDS:
            self.clear()
        n = self[word] = self.machine.count(word.encode("utf-8"))
        return n

    def span(self, text: str) -> int:
        return sum(map(self.__getitem__, WORDS.findall(text)))

    def chunk_map(self, chunk: str) -> tuple[str, int, str] | str:
        """(head, count, tail), or the chunk itself where it has no certain border."""
        first = BORDER.search(chunk)
        if first is None:
            return chunk
        i = first.start()
        j = i
        for k in range(len(chunk) - 1, i, -1):
            if chunk[k].isspace() and not chunk[k - 1].isspace():
                j = k
                break
        return chunk[:i], self.span(chunk[i:j]) if j > i else 0, chunk[j:]

    def compose(self, a, b):
        if isinstance(a, str) and isinstance(b, str):
            return self.chunk_map(a + b)
        if isinstance(a, str):
            met = self.chunk_map(a + b[0])
            if isinstance(met, str):
                return met, b[1], b[2]
            return met[0], met[1] + self.span(met[2]) + b[1], b[2]
        if isinstance(b, str):
            met = self.chunk_map(a[2] + b)
            if isinstance(met, str):
                return a[0], a[1], met
            return a[0], a[1] + self.span(met[0]) + met[1], met[2]
        return a[0], a[1] + self.span(a[2] + b[0]) + b[1], b[2]

    def text(self, text: str) -> int:
        if not text:
            return 0
        if not text.isascii() and UNSETTLED.search(text):
            return self.by_library(text)
        parts = text.split("<|endoftext|>")  # as the library: one token, on both sides of it texts of their own
        return len(parts) - 1 + sum(map(self.part, parts))

    def part(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.span(text)
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:  # a balanced scan; order is kept
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        m = maps[0]
        return self.span(m) if isinstance(m, str) else self.span(m[0]) + m[1] + self.span(m[2])

    def by_library(self, text: str) -> int:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return len(self.library.encode(text, add_special_tokens=False))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of docs, in one narrow pass without a shuffle.

    vocabulary: a byte-level .json file, by a path that exists on every executor or a name of the
    public_tokenizers package.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(located(vocabulary))
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode("utf-8")) if t else 0 for t in texts], pa.int64()),
                    pa.array([count.text(t) if t else 0 for t in texts], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint"
    )


def located(vocabulary: str) -> str:
    if "/" in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


def op3_token_counts(spark, sf_dir: str, limit: int = 512) -> DataFrame:
    counts = count_tokens(spread(table(spark, sf_dir, "documents")), "byte_bpe_50k.json")
    return counts.withColumn("over_limit", F.col("n_tokens") > limit)
