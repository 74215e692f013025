"""MinHash near-duplicates by a multi-index Hamming join.

A document is the set of its distinct five-word shingles. Equal sets form a class, and classes are
compared. A class gets a signature of 64 minima; the signature falls into 16 chunks of four symbols.
Two signatures that differ in at most 31 symbols agree, by pigeonhole, in some chunk up to one
symbol, so with each chunk and each of its symbols left out as a key (64 keys) every such pair shares
a key: none is lost. Symbols here are the full 64-bit minima. The stored signature has 8 bits of each, and a
pair within 31 of those only because unlike minima agree there (1 in 256 a symbol) has no certain key.
A pair at similarity 0.75 differs in more than 31 of 64 symbols with a chance of about 1 in 100,000.

A class is named by 64 bits of its set; a name that two unlike sets have (a second hash tells) is replaced
by one of both hashes. Its full set is made again from one of its texts, found by a hash of the text and
taken only if the set made from it has the class's name, whatever the ids of its rows.

Buckets are handled without writing out their pairs. One pass over a bucket gives each member its
nearest pivot (members in a fixed random order; those near a pivot follow it), and a spanning tree of
the pairs within reach. The nearest pivots over all buckets are confirmed on full sets, which joins
most of a large group in a linear number of tests. The spanning trees unite classes into regions: two
classes within reach of each other lie in one region. Regions that still hold several components are compared
block against block on full sets, pairs of one component left out, and give only links that join
components. So every pair within signature reach is in one confirmed component or has been tested.
A key of over BLOCK classes is found before anything is gathered, and is dealt out as pairs of its blocks.

Null and empty texts have no shingles and are linked with nothing. Rows with equal ids are rows of their own:
each goes by its own text. Rows with a null id are linked as others are; a null id never becomes a component's name unless
all ids there are null, and then all its rows are marked kept (one_of_each() keeps one of them). Other
columns are not read but for those asked for; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, slices, small, spread, table, written
from .toxicity import _M, _mixed, _powers, buffers

SYMBOLS, CHUNK = 64, 4
REACH = 2 * SYMBOLS // CHUNK - 1
#: A bucket member follows a pivot within this distance (the mean at similarity 0.69).
NEAR = 20
#: Classes of a key that are compared at once; a key of more is dealt out as pairs of such blocks.
BLOCK = 1 << 14
#: Classes of a region that are compared at once with as many others.
TILE = 1024
#: Candidate ids up to this many are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Classes that a task remembers to have made the full set of; more are made again.
MOST_DONE = 100_000

_SYMBOL = _mixed(np.arange(1, 257, dtype=np.uint64) * _M) | np.uint64(1)
_SYMBOL[65:91] = _SYMBOL[97:123]
_SYMBOL[[0x20, *range(0x09, 0x0E)]] = 0
_FACTORS = _mixed(np.arange(1001, 1001 + SYMBOLS, dtype=np.uint64) * _M) | np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles (repeated ones too), and the text of each, in order."""
    value = _SYMBOL[data]
    inside = value != 0
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    begin[edges] = inside[edges]
    at = np.flatnonzero(begin)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p, q = _powers(len(data))
    words = _mixed(np.add.reduceat(value * p[: len(data)], at) * q[at])
    doc = np.searchsorted(offsets, at, "right") - 1
    n = np.bincount(doc, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    out, docs = [], []
    if len(words) >= width:
        h = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            h = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + words[k : len(words) - width + 1 + k])
        same = doc[: len(h)] == doc[width - 1 :]
        out.append(h[same])
        docs.append(doc[: len(h)][same])
    for d in np.flatnonzero((n > 0) & (n < width)):  # short texts: the whole sequence
        h = np.uint64(n[d])
        for w in words[first[d] : first[d] + n[d]]:
            h = _mixed(np.atleast_1d(h * np.uint64(0xA0761D6478BD642F) + w))[0]
        out.append(np.atleast_1d(h))
        docs.append(np.array([d]))
    h, d = np.concatenate(out or [words[:0]]), np.concatenate(docs or [doc[:0]])
    order = np.argsort(d, kind="stable")
    return h[order], d[order]


def sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = buffers(column)
    with np.errstate(over="ignore"):
        h, doc = shingles(data, offsets)
    cuts = np.searchsorted(doc, np.arange(len(column) + 1))
    return [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def minima(s: np.ndarray) -> np.ndarray:
    low = np.full(SYMBOLS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for a in range(0, len(s), 1024):
        low = np.minimum(low, (s[a : a + 1024, None] * _FACTORS).min(0))
    return _mixed(low)


def keys_of(low: np.ndarray) -> np.ndarray:
    """One key for each chunk and each of its symbols left out."""
    parts = low.reshape(-1, CHUNK)
    place = np.arange(parts.size, dtype=np.uint64).reshape(parts.shape)
    h = _mixed((place + np.uint64(7)) * _M)
    for k in range(CHUNK):
        took = _mixed(h * np.uint64(0xD6E8FEB86659FD93) + parts[:, k : k + 1])
        h = np.where(np.arange(CHUNK)[None, :] == k, h, took)
    return h.reshape(-1)


def signed(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep, text_key, n_shingles, node, check, signature, keys); node is the class, null without shingles."""
    names = ["doc_id", *keep, "text_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ns, nodes, checks, signatures, keys = [], [], [], [], []
            for s in sets(batch.column("text")):
                ns.append(len(s))
                if not len(s):
                    for out in (nodes, checks, signatures, keys):
                        out.append(None)
                    continue
                low = minima(s)
                node, check = named(s)
                nodes.append(node)
                checks.append(check)
                signatures.append((low >> np.uint64(56)).astype(np.uint8).tobytes())
                keys.append(keys_of(low).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, names), *(pa.array(x, pa.int64()) for x in (ns, nodes, checks)), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=[*names, "n_shingles", "node", "check", "signature", "keys"],
            )

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in ("doc_id", *keep))
    keyed = docs.select("doc_id", *keep, F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, f"{kinds}text_key bigint, n_shingles bigint, node bigint, check bigint, signature binary, keys array<bigint>")


def named(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set of shingle hashes."""
    with np.errstate(over="ignore"):
        one = _mixed(s).sum() * np.uint64(3) + np.bitwise_xor.reduce(_mixed(s * _M)) + np.uint64(len(s))
        two = _mixed(s * _FACTORS[0]).sum() * np.uint64(5) + np.bitwise_xor.reduce(_mixed(s * _FACTORS[1]))
        node, check = _mixed(np.array([one, two])).view(np.int64)
    return int(node), int(check)


def gathered(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


def runs(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each run of equal keys, runs of one left out."""
    cuts = np.flatnonzero(np.diff(sorted_keys)) + 1
    begin, end = np.append(0, cuts), np.append(cuts, len(sorted_keys))
    many = end - begin > 1
    yield from zip(begin[many].tolist(), end[many].tolist())


def _order(nodes: np.ndarray) -> np.ndarray:
    """A fixed random order of classes, the same in every bucket."""
    return _mixed(nodes.astype(np.uint64) * _M)


def crowded(keyed: DataFrame) -> DataFrame | None:
    """(key, blocks) of the keys of over BLOCK classes, or None.

    A key of so many has at least its share of them in some task, so tasks name only what reaches that share.
    """
    share = max(1, -(-BLOCK // max(1, keyed.rdd.getNumPartitions())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [b.column("key").to_numpy() for b in batches]
        if keys:
            key, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key[n >= share])], names=["key"])

    suspects = written(keyed.select("key").mapInArrow(run, "key bigint").distinct(), "suspects")
    if suspects.isEmpty():
        return None
    counted = keyed.join(small(suspects, BROADCAST_ROWS), "key").groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    return written(counted.where("blocks > 1"), "crowded")


def buckets(nodes: DataFrame) -> DataFrame:
    """(bucket, node) of all keys that two classes or more share; buckets of equal members are one.

    A key's hash partition is read as two columns of longs; a crowded key gives a cell for each two of its blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gathered(batches)
        if t is None:
            return
        cell, node = t.column("cell").to_numpy(), t.column("node").to_numpy()
        rank = _order(node)
        by = np.lexsort((rank, cell))
        cell, node, rank = cell[by], node[by], rank[by]
        names, members = [], []
        for a, b in runs(cell):
            names.append(np.full(b - a, _mixed(np.array([rank[a:b].sum() + np.uint64(b - a)]))[0]))
            members.append(node[a:b])
        if names:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names).view(np.int64)), pa.array(np.concatenate(members))], names=["bucket", "node"])

    keyed = nodes.select("node", F.explode("keys").alias("key"))
    hot = crowded(keyed)
    cells = keyed.withColumnRenamed("key", "cell")
    if hot is not None and not hot.isEmpty():
        block = F.pmod(F.xxhash64("node"), F.col("blocks"))
        both = (
            keyed.join(small(hot, BROADCAST_ROWS), "key", "left")
            .withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))))
        )
        cell = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least(block, "other"), F.greatest(block, "other")))
        cells = both.select("node", cell.alias("cell"))
    return cells.repartition("cell").mapInArrow(run, "bucket bigint, node bigint").distinct()


def walked(members: DataFrame) -> DataFrame:
    """(a, b, apart): b follows pivot a at that distance; or, with no distance, both are in one region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gathered(batches)
        if t is None:
            return
        bucket, nodes, sizes = (t.column(c).to_numpy() for c in ("bucket", "node", "n_shingles"))
        signatures = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(-1, SYMBOLS)
        by = np.lexsort((_order(nodes), bucket))
        for a, b in runs(bucket[by]):
            i = by[a:b]
            node, n, sig = nodes[i], sizes[i], signatures[i]
            got: list[np.ndarray] = []
            alive = np.arange(len(i))
            while len(alive) > 1:
                p, rest = alive[0], alive[1:]
                apart = (sig[rest] != sig[p]).sum(1)
                near = (apart <= NEAR) & alike(n[rest], n[p])
                if near.any():
                    got.append(np.stack([np.full(near.sum(), node[p]), node[rest[near]], apart[near]]))
                alive = rest[~near]
            alive = np.arange(len(i))
            while len(alive) > 1:
                todo, alive = [alive[0]], alive[1:]
                root = todo[0]
                while todo and len(alive):
                    x = todo.pop()
                    near = alike(n[alive], n[x])
                    near[near] = (sig[alive[near]] != sig[x]).sum(1) <= REACH
                    if near.any():
                        found = alive[near]
                        got.append(np.stack([np.full(len(found), node[root]), node[found], np.full(len(found), -1)]))
                        todo += found.tolist()
                        alive = alive[~near]
            if got:
                x = np.concatenate(got, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[0]), pa.array(x[1]), pa.array(x[2], mask=x[2] < 0)], names=["a", "b", "apart"]
                )

    dealt = members.repartition("bucket").select("bucket", "node", "n_shingles", "signature")
    return dealt.mapInArrow(run, "a bigint, b bigint, apart bigint").distinct()


def alike(n: np.ndarray, m: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= 75 * np.maximum(n, m)


def joining(region_members: DataFrame, percent: int) -> DataFrame:
    """(a, b): confirmed links that join different components of a region.

    Rows are (node, n_shingles, signature, hashes, component, region, blocks); each two blocks of a region meet in one task.
    """
    dealt = (
        region_members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .withColumn("tile", F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other")))
        .withColumn("low", F.col("block") <= F.col("other"))
        .withColumn("alone", F.col("block") == F.col("other"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gathered(batches)
        if t is None:
            return
        tiles, nodes, sizes, comps, low, alone = (
            t.column(c).to_numpy() for c in ("tile", "node", "n_shingles", "component", "low", "alone")
        )
        by = np.argsort(tiles, kind="stable")
        for a, b in runs(tiles[by]):
            part = t.take(pa.array(by[a:b]))
            node, n, comp = nodes[by[a:b]], sizes[by[a:b]], comps[by[a:b]]
            sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), np.uint8).reshape(-1, SYMBOLS)
            hashes = [np.frombuffer(x, np.uint64) for x in part.column("hashes").to_pylist()]
            _, root = np.unique(comp, return_inverse=True)
            one = np.flatnonzero(low[by[a:b]])
            two = one if alone[by[a]] else np.flatnonzero(~low[by[a:b]])
            out = []
            for i in one:
                j = two[(root[two] != root[i]) & alike(n[two], n[i])]
                j = j[(sig[j] != sig[i]).sum(1) <= REACH] if len(j) else j
                if not len(j):
                    continue
                flat = np.concatenate([hashes[x] for x in j])
                at = np.minimum(np.searchsorted(hashes[i], flat), len(hashes[i]) - 1)
                starts = np.append(0, np.cumsum(n[j])[:-1])
                both = np.add.reduceat((hashes[i][at] == flat).astype(np.int64), starts)
                for x in j[100 * both >= percent * (n[i] + n[j] - both)]:
                    if root[x] != root[i]:
                        root[root == root[x]] = root[i]
                        out.append((node[i], node[x]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out]), pa.array([y for _, y in out])], names=["a", "b"])

    return dealt.repartition("tile").select("tile", "node", "n_shingles", "signature", "hashes", "component", "low", "alone").mapInArrow(run, "a bigint, b bigint")


def full_sets(docs: DataFrame, signed_docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes): the full set of each wanted class, made again from one text of the class."""
    one = signed_docs.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("text_key", "check")).alias("t"))
    one = written(one.select(F.col("t.text_key").alias("wanted_key"), F.col("t.check").alias("check"), "node"), "wanted")
    texts = docs.select("text").join(small(one, BROADCAST_ROWS), F.xxhash64("text") == F.col("wanted_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in slices(batches, "text"):
            nodes, checks = batch.column("node").to_pylist(), batch.column("check").to_pylist()
            todo, made = [i for i, n in enumerate(nodes) if n not in done], {}
            while todo:
                first = list({nodes[i]: i for i in reversed(todo)}.values())  # copies of a text: one
                for i, s in zip(first, sets(batch.column("text").take(pa.array(first, pa.int64())))):
                    if len(s) and named(s)[1] == checks[i]:  # else another text of the same hash
                        made[nodes[i]] = s.tobytes()
                todo = sorted(set(todo).difference(first, (i for i in todo if nodes[i] in made)))
            done = set(made) if len(done) > MOST_DONE else done | set(made)
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.int64()), pa.array(list(made.values()), pa.binary())], names=["node", "hashes"])

    return texts.select("node", "check", "text").mapInArrow(run, "node bigint, hashes binary").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, hashes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x").to_pylist(), batch.column("y").to_pylist()
            ok = []
            for s, t in zip(x, y):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = pairs.select("a", "b").join(hashes.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    two = one.join(hashes.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def told_apart(signed_docs: DataFrame) -> DataFrame:
    """signed_docs with another name for classes whose name unlike sets have."""
    sets_ = signed_docs.where("node IS NOT NULL").groupBy("node").agg(F.min("check").alias("low"), F.max("check").alias("high"))
    mixed = written(sets_.where("low <> high").select("node", F.lit(True).alias("mixed")), "mixed")
    if mixed.isEmpty():
        return signed_docs
    node = F.when(F.col("mixed"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return signed_docs.join(small(mixed, BROADCAST_ROWS), "node", "left").withColumn("node", node).select(*signed_docs.columns)


def classes(docs: DataFrame, percent: int = 75, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, keep, n_shingles, node) of every row, and (node, component) of every linked class."""
    signed_docs = told_apart(written(signed(docs, keep), "signed"))
    nodes = signed_docs.where("node IS NOT NULL").select("node", "n_shingles", "signature", "keys").dropDuplicates(["node"])
    nodes = written(nodes, "classes")
    signatures = nodes.select("node", "n_shingles", "signature")
    found = written(walked(buckets(nodes).join(signatures, "node")), "walked")
    ends = found.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    hashes = written(full_sets(docs, signed_docs, ends), "sets")
    pivots = found.where("apart IS NOT NULL").groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best"))
    links = written(confirmed(pivots.select(F.col("best.a").alias("a"), "b"), hashes, percent), "links")
    comps = components(links)

    regions = components(found.where("apart IS NULL")).withColumnRenamed("component", "region")
    placed = regions.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = (
        placed.groupBy("region")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / TILE).alias("blocks"))
        .where("low < high")
        .select("region", "blocks")
    )
    rows = placed.join(open_, "region").join(signatures, "node").join(hashes, "node")
    more = written(joining(rows, percent), "links")
    if not more.isEmpty():
        comps = components(links.unionByName(more))
    for t in (nodes, found, hashes, links, more):
        discard(t)
    return signed_docs.select("doc_id", *keep, "n_shingles", "node"), comps


def grouped(docs: DataFrame, percent: int = 75, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep, n_shingles, component) of every row; component is null without shingles."""
    rows, comps = classes(docs, percent, keep)
    return rows.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text)."""
    rows, comps = classes(docs, percent)
    # names are found for classes first, so that a class of many rows costs one row a task
    least = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    named_ = least.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = named_.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = written(named_.join(ids, "component").select("node", "component_id"), "names")
    joined = rows.join(by_class, "node", "left")
    name = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", name.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def one_of_each(docs: DataFrame, columns: tuple[str, ...], percent: int = 75) -> DataFrame:
    """Of docs, one row of each component (that of least id; a null id only if all are) and the rows without shingles; of equal rows, one."""
    marked = docs.select(*columns, F.xxhash64(*columns).alias("row_key"))
    rows = written(grouped(marked, percent, ("row_key",)), "grouped")
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")
    best = rows.where("component IS NOT NULL").groupBy("component").agg(F.min(own).alias("b")).select("b.doc_id", "b.row_key")
    chosen = best.unionByName(rows.where("component IS NULL").select("doc_id", "row_key")).distinct()
    chosen = chosen.select(F.col("doc_id").alias("chosen_id"), F.col("row_key").alias("chosen_key"))
    met = F.col("doc_id").eqNullSafe(F.col("chosen_id")) & (F.col("row_key") == F.col("chosen_key"))
    out = marked.join(chosen, met, "left_semi")
    twins = rows.groupBy("doc_id", "row_key").count().where("count > 1")
    twins = written(twins.select(F.col("doc_id").alias("chosen_id"), F.col("row_key").alias("chosen_key")), "twins")
    if twins.isEmpty():
        return out.select(*columns)
    twins = small(twins, BROADCAST_ROWS)
    return out.join(twins, met, "left_anti").unionByName(out.join(twins, met, "left_semi").dropDuplicates()).select(*columns)


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []::varchar[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS shingles FROM w),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
n AS (SELECT doc_id, len(shingles) AS n FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_ >= 75 * (na.n + nb.n - both_)),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id)
SELECT n.doc_id, n.n AS n_shingles, component_id, n.doc_id = component_id AS kept FROM n JOIN c ON c.doc_id = n.doc_id
"""
