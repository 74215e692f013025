"""Suffix-array removal of repeated passages over UTF-8 bytes.

A string of span (200) bytes is judged by its minimiser: the leftmost least 32-byte hash inside it. Equal
strings have equal minimisers at equal places, so all occurrences of a repeated string meet under
one anchor hash. An anchor carries the context of the strings it stands for. Occurrences are dealt by anchor and context, of a context
a few rows a task, so neither a hot anchor nor a hot context is gathered: a context that occurs twice covers all its
occurrences, and one of each context goes on. Anchors with several contexts are suffix-sorted
under their hash (suffixes that begin at anchors, with their common-prefix lengths), and one stack
scan walks the tree of common-prefix intervals. At each interval of depth d its left diversity is tested: occurrences that all share one
left extension l, or that have all they can have from the intervals inside, are settled at once; others are
ordered by what stands to the left, and give the maximal repeats of the interval, each with all its occurrences. Where
l + d >= span an occurrence covers [anchor - l, anchor + d). groups() names these maximal repeats themselves.

An anchor with over BLOCK contexts is not sorted in one place: each string of each of its contexts is hashed to 128 bits, and
equal strings meet by their hash, at a cost in proportion to the contexts.

Copies of a whole text are taken once (two 64-bit hashes stand for it; a name that unlike texts have is replaced) and are covered whole.
Null and empty texts have no bytes. Equal ids are rows of their own. Other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, slices, small, spread, table, written
from .near_dedup import gathered
from .toxicity import _M, _mixed, _powers, buffers

GRAM = 32
#: Window starts that are treated at once in a very long text.
PIECE = 1 << 20
#: The table of repeated texts (16 bytes a row) is broadcast up to this many rows; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1 << 20
#: Contexts that a task remembers to have sent once, or twice; more are sent again.
MOST_SENT = 400_000
#: Distinct contexts of one anchor up to which they are suffix-sorted.
BLOCK = 20_000
_BYTE, _BYTE2 = (_mixed(np.arange(at, at + 256, dtype=np.uint64) * _M) | np.uint64(1) for at in (5001, 6001))
_FACTORS = _mixed(np.arange(7001, 7005, dtype=np.uint64) * _M) | np.uint64(1)


def anchors(data: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """(hash, context hash, anchor, first start, last start) of each minimiser of a text."""
    width = span - GRAM + 1
    parts = []
    for at in range(0, len(data) - span + 1, PIECE):
        x = data[at : at + PIECE + span - 1]
        value = _BYTE[x]
        h, step = value, 1
        while step < GRAM:
            h = h[:-step] * np.uint64(pow(int(_M), step, 1 << 64)) + h[step:]
            step *= 2
        h = _mixed(h)
        least = (h & ~np.uint64(0x1FFFFF)) | np.arange(len(h), dtype=np.uint64)
        s = 1
        while 2 * s <= width:
            least = np.minimum(least[:-s], least[s:])
            s *= 2
        if width > s:
            least = np.minimum(least[: s - width], least[width - s :])
        place = (least & np.uint64(0x1FFFFF)).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], len(place)) - 1
        p, q = _powers(len(x) + 1)
        sums = np.append(np.uint64(0), np.cumsum(value * p[: len(x)]))
        context = _mixed((sums[last + span] - sums[first]) * q[first] + (last - first).astype(np.uint64))
        parts.append((h[place[first]], context, place[first] + at, first + at, last + at))
    hash_, context, anchor, first, last = (np.concatenate(c) for c in zip(*parts))
    lead = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    if len(lead) < len(anchor):  # a minimiser that serves windows on both sides of a border is one row
        n = np.diff(np.append(lead, len(anchor)))
        last = last[lead + n - 1]
        hash_, context, anchor, first = hash_[lead], context[lead], anchor[lead], first[lead]
        for k in np.flatnonzero(n > 1):
            value = _BYTE[data[first[k] : last[k] + span]]
            whole = (value * _powers(len(value))[0][: len(value)]).sum(keepdims=True)
            context[k] = _mixed(whole + np.uint64(last[k] - first[k]))[0]
    return hash_, context, anchor, first, last


def identified(docs: DataFrame) -> DataFrame:
    """docs with node, a name of the text: 64 bits, and other ones where another hash tells unlike texts of one name apart."""
    docs = docs.withColumn("node", F.xxhash64("text"))
    other = F.xxhash64(F.lit(7), F.col("text"))  # with another seed
    both = docs.groupBy("node").agg(F.min(other).alias("low"), F.max(other).alias("high")).where("low <> high")
    mixed = written(both.select(F.col("node").alias("mixed_node")), "mixed")
    if mixed.isEmpty():
        return docs
    met = docs.join(small(mixed, BROADCAST_ROWS), F.col("node") == F.col("mixed_node"), "left")
    return met.withColumn("node", F.when(F.col("mixed_node").isNull(), F.col("node")).otherwise(F.xxhash64("node", other))).drop("mixed_node")


def copies(docs: DataFrame) -> DataFrame:
    """(copy_node, first_id) of the texts that several rows have."""
    found = docs.groupBy("node").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")
    return written(found.select(F.col("node").alias("copy_node"), "first_id"), "copies")


ANCHORS = "hash bigint, node bigint, anchor bigint, first bigint, last bigint"


def classified(texts: DataFrame, span: int) -> DataFrame:
    """ANCHORS: hash is null where the strings from first to last are known to repeat, else the row is the one that goes on for its context."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: set[int] = set()
        sent: set[int] = set()  # contexts whose two occurrences are on their way from this task
        for batch in slices(batches, "text"):
            data, offsets = buffers(batch.column("text"))
            nodes = batch.column("node").to_numpy()
            got, owner = [], []
            for i in np.flatnonzero(np.diff(offsets) >= span):
                found = anchors(data[offsets[i] : offsets[i + 1]], span)
                got.append(found)
                owner.append(np.full(len(found[0]), nodes[i]))
            if not got:
                continue
            hash_, context, anchor, first, last = (np.concatenate(c) for c in zip(*got))
            node = np.concatenate(owner)
            # contexts that occur twice here are settled here; one of them goes on for all, the others are dealt out evenly
            kinds, lead, back, n = np.unique(context, return_index=True, return_inverse=True, return_counts=True)
            seen = np.minimum(n, 2)[back]
            follows = np.ones(len(context), bool)
            follows[lead] = False
            done = np.array([c in sent for c in kinds.tolist()], bool)
            follows[lead[done]] = True
            seen[follows] = 0
            single = set(kinds[(n == 1) & ~done].tolist())
            sent.update(kinds[(n > 1) & ~done].tolist(), single & once)
            once |= single
            for held in (once, sent):
                if len(held) > MOST_SENT:
                    held.clear()
            key = np.where(follows, _mixed(hash_ + node.astype(np.uint64) * _M + anchor.astype(np.uint64)), hash_)
            yield batch_of(key=key, context=context, node=node, anchor=anchor, first=first, last=last, seen=seen)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gathered(batches)
        if t is None:
            return
        key, context, node, anchor, first, last, seen = (t.column(c).to_numpy() for c in t.column_names)
        by = np.lexsort((anchor, node, context, key))
        k, c = key[by], context[by]
        lead = np.append(True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]))
        followers = seen[by] == 0
        twice = (np.bincount(np.cumsum(lead) - 1, seen[by]) > 1)[np.cumsum(lead) - 1] | followers
        for rows, open_ in ((by[twice], False), (by[lead & ~followers], True)):
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[rows], mask=np.full(len(rows), not open_)), *(pa.array(x[rows]) for x in (node, anchor, first, last))], names=["hash", "node", "anchor", "first", "last"]
            )

    rows = texts.select("node", "text").mapInArrow(
        scan, "key bigint, context bigint, node bigint, anchor bigint, first bigint, last bigint, seen bigint"
    )
    return rows.repartition("key", "context").mapInArrow(settle, ANCHORS)


def batch_of(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns.values()], names=list(columns))


def asked_of(texts: DataFrame, open_: DataFrame) -> DataFrame:
    """(node, text, asked): the texts with open anchors (hash, node, anchor, first, last), and these."""
    asked = open_.groupBy("node").agg(F.collect_list(F.struct("hash", "anchor", "first", "last")).alias("asked"))
    asked = written(asked.withColumnRenamed("node", "asked_node"), "asked")
    return texts.join(asked, F.col("node") == F.col("asked_node")).select("node", "text", "asked")


def cut_out(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The bytes of a batch's texts, and of each asked anchor: hash, node, anchor, first, last, where its text begins and ends there."""
    data, offsets = buffers(batch.column("text"))
    asked, nodes = batch.column("asked"), batch.column("node").to_numpy()
    flat = asked.flatten()
    row = np.repeat(np.arange(len(asked)), pc.list_value_length(asked).to_numpy())
    columns = (flat.field(c).to_numpy() for c in ("hash", "anchor", "first", "last"))
    hash_, anchor, first, last = columns
    return data, hash_, nodes[row], anchor, first, last, offsets[row], offsets[row + 1]


def contexts(texts: DataFrame, open_: DataFrame, span: int) -> DataFrame:
    """(hash, node, anchor, before, after): the bytes to the left of each open anchor, and from it on."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = span - GRAM
        for batch in slices(batches, "text"):
            data, hash_, node, at, _, _, low, high = cut_out(batch)
            a = low + at
            before = [data[max(x - reach, lo) : x][::-1].tobytes() for x, lo in zip(a.tolist(), low.tolist())]
            after = [data[x : min(x + span, hi)].tobytes() for x, hi in zip(a.tolist(), high.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hash_), pa.array(node), pa.array(at), pa.array(before, pa.binary()), pa.array(after, pa.binary())],
                names=["hash", "node", "anchor", "before", "after"],
            )

    return asked_of(texts, open_).mapInArrow(cut, "hash bigint, node bigint, anchor bigint, before binary, after binary")


def equal_strings(texts: DataFrame, open_: DataFrame, span: int) -> DataFrame:
    """(node, start, end) of the strings of open anchors that occur twice among them, by 128 bits of each string."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, _, node, _, first, last, low, _ = cut_out(batch)
            for i in range(len(node)):
                x = data[low[i] + first[i] : low[i] + last[i] + span]
                names = []
                for table_ in (_BYTE, _BYTE2):
                    value = table_[x]
                    p, q = _powers(len(value) + 1)
                    sums = np.append(np.uint64(0), np.cumsum(value * p[: len(value)]))
                    n = len(value) - span + 1
                    names.append(_mixed((sums[span : span + n] - sums[:n]) * q[:n]))
                start = np.arange(first[i], last[i] + 1)
                yield batch_of(one=names[0], two=names[1], node=np.full(len(start), node[i]), start=start)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last string so far, while it has occurred once
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two, node, start = (batch.column(c).to_numpy() for c in ("one", "two", "node", "start"))
            with_next = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
            twice = np.append(False, with_next) | np.append(with_next, False)
            if last == (one[0], two[0]):
                twice[0] = True
                if held is not None:
                    yield batch_of(node=np.array([held[0]]), start=np.array([held[1]]), end=np.array([held[1] + span]))
            yield batch_of(node=node[twice], start=start[twice], end=start[twice] + span)
            last, held = (one[-1], two[-1]), None if twice[-1] else (node[-1], start[-1])

    rows = asked_of(texts, open_).mapInArrow(hashed, "one bigint, two bigint, node bigint, start bigint")
    return rows.repartition("one", "two").sortWithinPartitions("one", "two").mapInArrow(meet, "node bigint, start bigint, end bigint")


def matrix(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows padded with zeros, and their lengths."""
    values = column.to_pylist()
    n = np.fromiter(map(len, values), np.int64, len(values))
    return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(-1, width), n


def common(m: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Common-prefix lengths of the rows i and j."""
    out = np.empty(len(i), np.int64)
    for a in range(0, len(i), 8192):
        x, y = i[a : a + 8192], j[a : a + 8192]
        unlike = m[x] != m[y]
        out[a : a + 8192] = np.where(unlike.any(1), unlike.argmax(1), m.shape[1])
    return np.minimum(out, np.minimum(n[i], n[j]))


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first, last, depth) of every common-prefix interval, children before parents; lcp[i] is between i - 1 and i."""
    stack = [(0, 0)]
    for i in range(1, len(lcp) + 1):
        depth, first = (lcp[i] if i < len(lcp) else 0), i - 1
        while depth < stack[-1][0]:
            d, first = stack.pop()
            yield first, i - 1, d
        if depth > stack[-1][0]:
            stack.append((depth, first))


class Tree:
    """The suffixes that begin at anchors, sorted under their hash, and what stands to the left of each."""

    def __init__(self, t: pa.Table, span: int):
        self.hash, self.node, self.at = (t.column(c).to_numpy() for c in ("hash", "node", "anchor"))
        self.after, self.right = matrix(t.column("after"), span)
        self.before, self.left = matrix(t.column("before"), span - GRAM)
        key = np.concatenate([self.hash.astype(">i8").view(np.uint8).reshape(-1, 8), self.after], axis=1)
        self.suffix = np.argsort(np.ascontiguousarray(key).view(f"S{span + 8}").reshape(-1), kind="stable")
        self.by_left = np.empty(len(self.suffix), np.int64)
        self.by_left[np.argsort(self.before.view(f"S{span - GRAM}").reshape(-1), kind="stable")] = np.arange(len(self.suffix))
        lcp = common(self.after, self.right, self.suffix[:-1], self.suffix[1:])
        lcp[self.hash[self.suffix[1:]] != self.hash[self.suffix[:-1]]] = 0
        self.lcp = [0, *lcp.tolist()]

    def extensions(self) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, int]]:
        """(occurrences, longest left extension of each that another one shares, depth, first, last) of every interval in which there are longer ones than inside."""
        known = np.full(len(self.suffix), -1)  # what the intervals inside gave each occurrence
        for a, b, depth in intervals(self.lcp):
            if depth < GRAM:
                continue
            who = self.suffix[a : b + 1]
            if (known[who] >= self.left[who]).all():
                continue  # no left byte is left to tell them apart
            order = self.by_left[who]
            ends = who[[order.argmin()]], who[[order.argmax()]]
            shared = int(common(self.before, self.left, *ends)[0])
            if shared >= self.left[who].max():  # not diverse: one left extension for all
                best = np.full(len(who), shared)
            else:
                who = who[np.argsort(order)]
                beside = common(self.before, self.left, who[:-1], who[1:])
                best = np.maximum(np.append(beside, 0), np.append(0, beside))
            known[who] = np.maximum(known[who], best)
            yield who, best, depth, a, b

    def groups(self, span: int) -> Iterator[tuple[np.ndarray, int, int]]:
        """(occurrences, left extension, depth) of every maximal repeat of span bytes or more, as far as contexts reach: a longer string on either side loses an occurrence."""
        for a, b, depth in intervals(self.lcp):
            if depth < GRAM:
                continue
            who = self.suffix[a : b + 1]
            # occurrences of one child of the interval go on equally to the right
            child = np.cumsum(np.append(False, np.array(self.lcp[a + 1 : b + 1]) == depth))
            order = np.argsort(self.by_left[who])
            who, child = who[order], child[order]
            beside = [0, *common(self.before, self.left, who[:-1], who[1:]).tolist()]
            whole = int(common(self.before, self.left, who[:1], who[-1:])[0])
            for x, y, left in [*intervals(beside), (0, len(who) - 1, 0)] if whole == 0 else intervals(beside):
                if left + depth >= span and child[x : y + 1].min() != child[x : y + 1].max():
                    yield who[x : y + 1], left, depth


def covered(open_contexts: DataFrame, span: int) -> DataFrame:
    """(node, start, end) from the interval trees of the suffixes under each anchor hash."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gathered(batches)
        if t is None:
            return
        tree, out = Tree(t, span), []
        for who, best, depth, _, _ in tree.extensions():
            ok = best + depth >= span
            if ok.any():
                w = who[ok]
                out.append(np.stack([tree.node[w], tree.at[w] - best[ok], tree.at[w] + depth]))
        if out:
            found = np.concatenate(out, axis=1)
            yield batch_of(node=found[0], start=found[1], end=found[2])

    return open_contexts.repartition("hash").mapInArrow(scan, "node bigint, start bigint, end bigint")


def groups(docs: DataFrame, span: int = 200) -> DataFrame:
    """(repeat, length, doc_id, start): the maximal repeats of unlike contexts, with all their occurrences.

    A repeat is told as far as the contexts of one anchor reach, span bytes to the right and span - 32 to the left; a context that
    occurs several times stands for one occurrence, and so does a whole text with copies (its least id).
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gathered(batches)
        if t is None:
            return
        tree = Tree(t, span)
        for who, left, depth in tree.groups(span):
            one = who[np.lexsort((tree.at[who], tree.node[who]))[0]]
            name = _mixed(np.array([tree.node[one], tree.at[one], left, depth]).astype(np.uint64) * _FACTORS).sum()
            n = len(who)
            yield batch_of(repeat=np.full(n, name), length=np.full(n, left + depth), node=tree.node[who], start=tree.at[who] - left)

    docs = identified(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = written(classified(texts := docs.dropDuplicates(["node"]).select("node", "text"), span), "anchors")
    several, _ = open_anchors(rows)
    found = contexts(texts, several, span).repartition("hash").mapInArrow(scan, "repeat bigint, length bigint, node bigint, start bigint")
    names = docs.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    return found.join(names, "node").select("repeat", "length", "doc_id", "start")


def open_anchors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ANCHORS of the hashes with several contexts, and of those with over BLOCK."""
    going = rows.where("hash IS NOT NULL")
    counted = going.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    open_ = written(going.join(counted.hint("shuffle_hash"), "hash"), "open")  # one row a hash is hashed, and nothing sorted
    return open_.where(F.col("n") <= BLOCK), open_.where(F.col("n") > BLOCK)


def merged(cover: DataFrame) -> DataFrame:
    """(node, starts, ends): maximal runs of covered bytes, in order."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gathered(batches)
        if t is None:
            return
        node, start, end = (t.column(c).to_numpy() for c in ("node", "start", "end"))
        by = np.lexsort((start, node))
        node, start, end = node[by], start[by], end[by]
        cut = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        # ends only grow within a text: lift each text above the one before, then one running maximum serves all
        lift = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(node)))) * (int(end.max()) + 1)
        reach = np.maximum.accumulate(end + lift) - lift
        fresh = np.append(True, (node[1:] != node[:-1]) | (start[1:] > reach[:-1]))
        run = np.flatnonzero(fresh)
        ends = reach[np.append(run[1:], len(node)) - 1]
        owner = node[run]
        cut = np.append(np.flatnonzero(np.append(True, owner[1:] != owner[:-1])), len(owner))
        offsets = pa.array(cut.astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [pa.array(owner[cut[:-1]]), pa.ListArray.from_arrays(offsets, pa.array(start[run])), pa.ListArray.from_arrays(offsets, pa.array(ends))],
            names=["node", "starts", "ends"],
        )

    return cover.repartition("node").mapInArrow(merge, "node bigint, starts array<bigint>, ends array<bigint>")


def repeated_spans(docs: DataFrame, span: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs (doc_id, text, keep) with whole (every byte is covered), starts and ends of the covered runs."""
    docs = identified(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep))
    twice = copies(docs)
    flagged = docs.join(small(twice, BROADCAST_ROWS), F.col("node") == F.col("copy_node"), "left")
    texts = flagged.where(F.col("copy_node").isNull() | F.col("doc_id").eqNullSafe(F.col("first_id"))).select("node", "text")
    rows = written(classified(texts, span), "anchors")
    settled = rows.where("hash IS NULL").select("node", F.col("first").alias("start"), (F.col("last") + span).alias("end"))
    several, crowded = open_anchors(rows)
    found = settled.unionByName(covered(contexts(texts, several, span), span))
    if not crowded.isEmpty():
        found = found.unionByName(equal_strings(texts, crowded, span))
    cover = written(merged(found), "cover").withColumnRenamed("node", "cover_node")
    for t in (rows, several):
        discard(t)
    out = flagged.join(cover, F.col("node") == F.col("cover_node"), "left")
    whole = F.col("copy_node").isNotNull() & (F.octet_length("text") >= span)
    return out.select("doc_id", "text", *keep, whole.alias("whole"), "starts", "ends")


def kept_pieces(data: bytes, whole: bool, starts, ends) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, runs removed)."""
    if whole:
        return b"", len(data), 1
    if not starts:
        return data, 0, 0
    edges = [0, *(x for pair in zip(starts, ends) for x in pair), len(data)]
    rest = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
    return rest, len(data) - len(rest), len(starts)


def without_repeats(docs: DataFrame, span: int = 200, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, n_removed, keep): what is left of each text; a character that is cut is kept whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, removed = [], []
            for text, whole, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "whole", "starts", "ends"))):
                data = text.encode("utf-8")
                for k in range(len(starts or ())):
                    while starts[k] < ends[k] and data[starts[k]] & 0xC0 == 0x80:
                        starts[k] += 1
                    while ends[k] > starts[k] and ends[k] < len(data) and data[ends[k]] & 0xC0 == 0x80:
                        ends[k] -= 1
                rest, gone, _ = kept_pieces(data, whole, starts, ends)
                texts.append(rest.decode("utf-8"))
                removed.append(gone)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(removed, pa.int64()), *map(batch.column, keep)],
                names=["doc_id", "text", "n_removed", *keep],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return repeated_spans(docs, span, keep).mapInArrow(run, f"doc_id {kind}, text string, n_removed bigint{kinds}")


def op5_suffix_dedup(spark, sf_dir: str, span: int = 200) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text, whole, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("text", "whole", "starts", "ends"))):
                data = text.encode("utf-8")
                rest, gone, n = kept_pieces(data, whole, starts, ends)
                rows.append((len(data), gone, n, hashlib.sha256(rest).hexdigest()))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return repeated_spans(docs, span).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
