"""Embedding near-duplicates by sorted projection passes.

Vectors are compared only with those of their label and length. Equal unit vectors form a class, and classes are
compared. A pass hashes each vector to the signs of 63 random projections (taken around the mean of its group, where the
group is among the MEANS largest), sorts a group by these signs as one long number, and verifies each vector against the WINDOW
before it; windows reach over the borders of partitions. Vectors travel as 16-bit numbers: what these leave undecided is
verified in double precision. Verified pairs of all passes are united into components, and the degree of a
vector is its exact number of links inside its component, counted in tiles of TILE rows.

Whether the passes were enough is measured in every group, not assumed, and does not depend on how rare links are: of one row in
PLANT (PLANTED of a group at most) a copy turned away to the least cosine of a link is sorted with the rest, and counts
only as found or not found beside its own row, the hardest link there can be. A group in which fewer than ENOUGH of its turned copies
were found, in all rounds so far, goes into another round of PASSES with other projections. Groups with fewer than EVIDENCE turned copies
are judged together with those of their length and size (in powers of two) as well; a group of which nothing is known is open. What is
still open after ROUNDS rounds is compared in tiles, all pairs. exact=True does so for every group at once. So recall is about ENOUGH or more
of links at the least cosine, and more above it.

Vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, link with
nothing; any other length of a vector, however large or small, is scaled out. Rows with equal ids are vectors of their own
and get one component through their id only if they are linked. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, same, small, table, united, written
from .near_dedup import gathered, runs

PASSES, SIGNS, WINDOW, TILE = 24, 63, 32, 4096
ROUNDS, ENOUGH = 4, 0.99
#: One row in so many has a turned copy, up to so many in a group; copies that judge a group alone.
PLANT, PLANTED, EVIDENCE = 8, 1024, 300
#: Groups whose mean is known to all tasks (one vector of whole numbers each).
MEANS = 256
#: Sums of products in another order differ by less.
CLOSE = 1e-9
BROADCAST_ROWS = 1 << 16
#: One in 16-bit numbers.
ONE = 32767


def scaled(x: Column) -> tuple[Column, Column]:
    """A vector over its greatest component, and whether it has a direction."""
    most = F.array_max(F.transform(x, F.abs))
    fine = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (most > 0)
    return F.transform(x, lambda v: v / most), F.coalesce(fine, F.lit(False))


def prepared(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(uid, vec_id, label, dim, unit, name, check) of the rows that can link, and (vec_id) of the others."""
    x, fine = scaled(F.col("embedding").cast("array<double>"))
    good = fine & F.col("label").isNotNull()
    rows = vectors.where(good).select("vec_id", F.col("label").cast("string").alias("label"), x.alias("x"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)))
    rows = rows.select(
        F.monotonically_increasing_id().alias("uid"), "vec_id", "label", F.size("x").alias("dim"), F.transform("x", lambda v: v / F.col("norm") + 0.0).alias("unit")
    )
    rows = rows.withColumns({"name": F.xxhash64("label", "dim", "unit"), "check": F.hash("label", "dim", "unit")})
    return rows, vectors.where(~good).select("vec_id")


def stacked(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def directions(dim: int, turn: int) -> np.ndarray:
    return np.random.default_rng([9, dim, turn]).standard_normal((dim, PASSES * SIGNS))


def means(nodes: DataFrame) -> dict[tuple[str, int], np.ndarray]:
    """The means of the largest groups, from whole numbers, so the same in any order of rows."""
    largest = nodes.groupBy("label", "dim").count().where("count > 1").orderBy(F.desc("count"), "label", "dim").limit(MEANS).drop("count")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for (label, dim), part in by_group(batch):
                x = np.rint(stacked(pa.chunked_array([part.column("unit")]), dim) * ONE).astype(np.int64)
                held[label, dim] = held.get((label, dim), 0) + np.append(x.sum(0), len(x))
        for (label, dim), x in held.items():
            k = np.arange(dim + 1)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(k)), pa.array(np.full(len(k), dim)), pa.array(k), pa.array(x)], names=["label", "dim", "k", "x"])

    sums = nodes.join(F.broadcast(largest), ["label", "dim"]).select("label", "dim", "unit").mapInArrow(run, "label string, dim bigint, k bigint, x bigint")
    out: dict[tuple[str, int], dict[int, int]] = {}
    for label, dim, k, x in sums.groupBy("label", "dim", "k").agg(F.sum("x")).collect():  # MEANS vectors at most
        out.setdefault((label, dim), {})[k] = x
    return {g: np.array([x[k] for k in range(g[1])]) / (ONE * x[g[1]]) for g, x in out.items()}


def by_group(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """((label, dim), rows) of each group of a batch, in order of rows."""
    label = batch.column("label").dictionary_encode()
    dim = batch.column("dim").to_numpy()
    code = label.indices.to_numpy().astype(np.int64) << np.int64(32) | dim
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[order])) + 1
    for i in np.split(order, cuts):
        if len(i):
            yield (label.dictionary[int(code[i[0]] >> 32)].as_py(), int(dim[i[0]])), batch.take(pa.array(i))


def passes(nodes: DataFrame, least: float, turn: int, centres: dict[tuple[str, int], np.ndarray]) -> DataFrame:
    """(a, b, sure) of nodes (uid, label, dim, unit): spanning pairs of what each window holds; not sure: still to be verified."""
    held = nodes.sparkSession.sparkContext.broadcast(centres)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (np.int64(1) << np.arange(SIGNS - 1, -1, -1)).astype(np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                for (label, dim), part in by_group(whole.slice(at, 2048)):
                    x = stacked(pa.chunked_array([part.column("unit")]), dim)
                    signs = ((x - held.value.get((label, dim), 0.0)) @ directions(dim, turn) > 0).reshape(len(x), PASSES, SIGNS)
                    short = np.rint(x * ONE).astype("<i2")
                    yield pa.RecordBatch.from_arrays(
                        [*map(part.column, ("uid", "label", "dim")), pa.array([v.tobytes() for v in short], pa.binary()), pa.array(list(signs @ weights), pa.list_(pa.int64()))],
                        names=["uid", "label", "dim", "short", "signs"],
                    )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows over sorted rows as they come; the first and last rows go on to the borders with the tasks beside."""
        here, head, carry = TaskContext.get().partitionId(), None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 8192):
                rows = pa.Table.from_batches([whole.slice(at, 8192)])
                if head is None or head.num_rows < WINDOW:
                    head = rows.slice(0, WINDOW) if head is None else pa.concat_tables([head, rows.slice(0, WINDOW - head.num_rows)])
                joined = rows if carry is None else pa.concat_tables([carry, rows])
                yield from in_windows(joined, least, 0 if carry is None else carry.num_rows)
                carry = joined.slice(max(0, joined.num_rows - WINDOW))
        if head is not None:
            yield bordered(head, here - 1, 1)
            yield bordered(carry, here, 0)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in same(batches, "border"):
            yield from in_windows(rows, least, rows.column("side").to_pylist().count(0))

    signed = nodes.select("uid", "label", "dim", "unit").mapInArrow(sign, "uid bigint, label string, dim int, short binary, signs array<bigint>")
    each = signed.select("uid", "label", "dim", "short", F.posexplode("signs").alias("pass", "sign"))
    order = ("pass", "label", "dim", "sign", "uid")  # with uid, so that equal signs can be dealt out too
    got = written(each.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(walk, WALKED), "walked")
    borders = got.where("border IS NOT NULL AND border >= 0").repartition("border").sortWithinPartitions("border", "side", *order)
    return got.where("a IS NOT NULL").select("a", "b", "sure").unionByName(borders.mapInArrow(meet, WALKED).where("a IS NOT NULL").select("a", "b", "sure"))


WALKED = "a bigint, b bigint, sure boolean, border bigint, side int, uid bigint, label string, dim int, short binary, pass int, sign bigint"


def walked_batch(n: int, **columns) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [f.split() for f in WALKED.split(", ")]
    arrays = [columns[name].cast(kinds[kind]) if name in columns else pa.nulls(n, kinds[kind]) for name, kind in fields]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def bordered(rows: pa.Table, border: int, side: int) -> pa.RecordBatch:
    n = rows.num_rows
    own = {c: rows.column(c).combine_chunks() for c in ("uid", "label", "dim", "short", "pass", "sign")}
    return walked_batch(n, border=pa.array(np.full(n, border)), side=pa.array(np.full(n, side)), **own)


def in_windows(rows: pa.Table, least: float, old: int) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sure) of sorted rows at most WINDOW apart, of one pass and group; pairs among the first old rows are known.

    Turned copies have negative numbers, ~uid of their row; they pair with that row alone, whatever the cosine.
    """
    uid, dims, turn, sign = (rows.column(c).to_numpy() for c in ("uid", "dim", "pass", "sign"))
    label = rows.column("label").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    group = label << np.int64(8) | turn
    short = rows.column("short").combine_chunks()
    for dim in np.unique(dims):
        i = np.flatnonzero(dims == dim)
        x = np.frombuffer(b"".join(short.take(pa.array(i)).to_pylist()), "<i2").reshape(-1, dim).astype(np.float32) / np.float32(ONE)
        # rounding moves a component by half a unit at most, so a product by no more than this
        slack = 2 * np.sqrt(dim) * 0.5 / ONE + dim * (0.5 / ONE) ** 2 + 1e-5
        of, fresh, own = group[i], i >= old, uid[i]
        ends: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for gap in range(1, min(WINDOW, len(i) - 1) + 1):
            both = (of[:-gap] == of[gap:]) & fresh[gap:]
            met = np.flatnonzero(both & (own[:-gap] == ~own[gap:]))
            if len(met):
                pair = own[met], own[met + gap]
                yield walked_batch(len(met), a=pa.array(np.minimum(*pair)), b=pa.array(np.maximum(*pair)), sure=pa.array(np.ones(len(met), bool)))
            p = np.flatnonzero(both & (own[:-gap] >= 0) & (own[gap:] >= 0))
            near = np.einsum("ij,ij->i", x[p], x[p + gap])
            hit = near >= least - slack
            ends.append((p[hit], p[hit] + gap, near[hit] >= least + slack))
        if not ends:
            continue
        p, q, sure = (np.concatenate(c) for c in zip(*ends))
        if not len(p):
            continue
        node, root = united(p[sure], q[sure]) if sure.any() else (p[:0], p[:0])
        at = np.arange(len(i))
        at[node] = root
        moved = node[node != root]
        open_ = ~sure & (at[p] != at[q])
        a, b = np.append(i[at[moved]], i[p[open_]]), np.append(i[moved], i[q[open_]])
        known = np.append(np.ones(len(moved), bool), np.zeros(open_.sum(), bool))
        yield walked_batch(len(a), a=pa.array(uid[a]), b=pa.array(uid[b]), sure=pa.array(known))


def verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """(a, b): the sure pairs, and the others that are links in double precision."""
    doubt = written(pairs.where("NOT sure").select("a", "b").distinct(), "doubt")
    sure = pairs.where("sure").select("a", "b")
    if doubt.isEmpty():
        return sure
    side = lambda c, x: nodes.select(F.col("uid").alias(c), F.col("unit").alias(x))
    both = doubt.join(side("a", "x"), "a").join(side("b", "y"), "b")
    dot = F.aggregate(F.zip_with("x", "y", lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v)
    return sure.unionByName(both.where(dot >= least).select("a", "b"))


def turned(nodes: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """(uid, label, dim, unit): copies of some rows of nodes at the cosine least, in directions of their own; uid is ~uid of the row."""
    share = F.least(F.lit(1.0 / PLANT), PLANTED / F.col("n"))
    chosen = nodes.join(sizes, ["label", "dim"]).where(F.pmod(F.xxhash64("uid", F.lit(11)), F.lit(1 << 30)) < share * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in by_group(batch):
                ids = part.column("uid").to_numpy()
                x = stacked(pa.chunked_array([part.column("unit")]), int(part.column("dim")[0].as_py()))
                away = np.stack([np.random.default_rng([13, i]).standard_normal(x.shape[1]) for i in ids.tolist()])
                away -= (away * x).sum(1, keepdims=True) * x
                away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
                y = least * x + np.sqrt(1 - least * least) * away
                yield pa.RecordBatch.from_arrays([pa.array(~ids), part.column("label"), part.column("dim"), pa.array(list(y), pa.list_(pa.float64()))], names=["uid", "label", "dim", "unit"])

    kind = nodes.schema["unit"].dataType.simpleString()
    return chosen.select("uid", "label", "dim", "unit").mapInArrow(run, f"uid bigint, label string, dim int, unit {kind}")


def open_groups(sizes: DataFrame, planted: DataFrame, found: DataFrame) -> DataFrame:
    """(label, dim) of the groups in which fewer than ENOUGH of the turned copies were found beside their rows."""
    met = planted.select("uid", "label", "dim").join(found.select("uid").distinct().withColumn("met", F.lit(1)), "uid", "left")
    counts = sizes.join(met.groupBy("label", "dim").agg(F.count("*").alias("m"), F.count("met").alias("k")), ["label", "dim"], "left")
    counts = counts.fillna(0, ["m", "k"]).withColumn("class", F.floor(F.log2("n")))
    like = counts.groupBy("dim", "class").agg(F.sum("m").alias("like_m"), F.sum("k").alias("like_k"))
    bad = lambda k, m: F.coalesce(F.col(k) < ENOUGH * F.col(m), F.lit(False)) | (F.col(m) == 0)
    alone, shared = (F.col("m") > 0) & bad("k", "m"), (F.col("m") < EVIDENCE) & bad("like_k", "like_m")
    # with at most half a window of rows, every pair lies in a window of every pass
    return counts.join(like, ["dim", "class"]).where((alone | shared) & (F.col("n") > WINDOW // 2)).select("label", "dim")


def tiles(rows: DataFrame, by: tuple[str, ...], least: float, size: int) -> DataFrame:
    """(uid, n, root): how many rows, copies counted, those of rows (uid, by, dim, unit, copies) link with in each tile, and the least row they connect to there."""
    sizes = rows.groupBy(*by).agg(F.ceil(F.count("*") / size).alias("blocks"))
    dealt = (
        rows.join(sizes, list(by))
        .withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        .withColumn("tile", F.xxhash64(*by, F.least("block", "other"), F.greatest("block", "other")))
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = gathered(batches)
        if t is None:
            return
        tile, uid, block, other, dims, copies = (t.column(c).to_numpy() for c in ("tile", "uid", "block", "other", "dim", "copies"))
        order = np.lexsort((uid, tile))
        for a, b in runs(tile[order]):
            i = order[a:b]
            x, w = stacked(t.column("unit").take(pa.array(i)), int(dims[i[0]])), copies[i]
            low = block[i] <= other[i]
            one, two = np.flatnonzero(low), np.flatnonzero(~low)
            alone = (block[i] == other[i]).all()  # a block with itself
            if alone:
                two = one
            n, root = np.zeros(len(i), np.int64), np.arange(len(i))
            for s in range(0, len(one), 512):
                near = x[one[s : s + 512]] @ x[two].T
                p, q = np.nonzero(near >= least - CLOSE)
                near = near[p, q]
                p, q = one[s + p], two[q]
                close = np.flatnonzero(near < least + CLOSE)
                near[close] = np.add.accumulate(x[p[close]] * x[q[close]], axis=1)[:, -1]  # in the order that verified() sums in
                p, q = p[near >= least], q[near >= least]
                if alone:
                    p, q = p[p != q], q[p != q]
                else:
                    n += np.bincount(q, w[p], len(i)).astype(np.int64)
                n += np.bincount(p, w[q], len(i)).astype(np.int64)
                node, to = united(np.append(np.arange(len(i)), p), np.append(root, q))
                root[node] = to
            found = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(uid[i[found]]), pa.array(n[found]), pa.array(uid[i[root[found]]])], names=["uid", "n", "root"])

    return dealt.repartition("tile").select("tile", "uid", "block", "other", "dim", "unit", "copies").mapInArrow(compare, "uid bigint, n bigint, root bigint")


def linked(nodes: DataFrame, least: float, exact: bool) -> DataFrame:
    """(a, b): pairs that span the components of nodes (uid, label, dim, unit, copies)."""
    by = ("label", "dim")
    all_pairs = lambda rows: tiles(rows, by, least, TILE).select(F.col("root").alias("a"), F.col("uid").alias("b"))
    if exact:
        return written(all_pairs(nodes), "links")
    sizes = written(nodes.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    planted = written(turned(nodes, sizes, least), "turned")
    centres, links, found, rows, copies = means(nodes), None, None, nodes.select("uid", *by, "unit"), planted
    for turn in range(ROUNDS):
        got = written(passes(rows.unionByName(copies), least, turn, centres), "passed")
        more = written(verified(got.where("a >= 0"), nodes, least), "links")
        links = more if links is None else written(links.unionByName(more), "links")
        met = written(got.where("a < 0").select(F.col("a").alias("uid")).distinct(), "met")
        found = met if found is None else found.unionByName(met)
        groups = written(open_groups(sizes, planted, found), "open")
        if groups.isEmpty():
            return links
        held = small(groups, BROADCAST_ROWS)
        rows, copies = (x.join(held, list(by), "left_semi") for x in (nodes.select("uid", *by, "unit"), planted))
    return written(links.unionByName(all_pairs(nodes.join(held, list(by), "left_semi"))), "links")


def near_vectors(vectors: DataFrame, least: float = 0.93, exact: bool = False) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors (vec_id, embedding, label)."""
    rows, rest = prepared(vectors)
    rows = written(rows, "vectors")
    key = ["label", "dim", "name", "check"]
    many = written(rows.groupBy(*key).agg(F.min("uid").alias("node"), F.count("*").alias("copies")).where("copies > 1"), "copies")
    nodes, light = rows.withColumn("copies", F.lit(1).cast("bigint")), rows.select("uid", "vec_id", F.col("uid").alias("node"))
    if not many.isEmpty():
        held = small(many, BROADCAST_ROWS)
        met = rows.join(held, key, "left")
        nodes = met.where("node IS NULL OR node = uid").withColumn("copies", F.coalesce("copies", F.lit(1).cast("bigint")))
        light = rows.select("uid", "vec_id", *key).join(held, key, "left").select("uid", "vec_id", F.coalesce("node", "uid").alias("node"))
    nodes = nodes.select("uid", "label", "dim", "unit", "copies")
    links = linked(nodes, least, exact)
    comps = components(links)
    members = nodes.join(comps, F.col("uid") == F.col("node")).select("uid", "component", "dim", "unit", "copies")
    degrees = written(tiles(members, ("component",), least, TILE).groupBy("uid").agg(F.sum("n").alias("n")), "degrees")
    discard(links)
    # names go by class first: a class of many copies costs one row a task
    classes = light.groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = classes.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    n = F.coalesce("n", F.lit(0).cast("bigint")) + F.col("copies") - 1
    known = classes.join(names, "component").join(degrees.withColumnRenamed("uid", "node"), "node", "left").select("node", "component_id", n.alias("n_links"))
    known = written(known.where("n_links > 0"), "names")
    zero = F.lit(0).cast("bigint")
    found = light.join(known, "node", "left")
    name = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = found.select("vec_id", F.coalesce("n_links", zero).alias("n_links"), name.alias("component_id"))
    out = out.unionByName(rest.select("vec_id", zero.alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op9_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
