"""A prefix trie of conversations, its subtree totals found by peeling leaves.

Turns become two 64-bit hashes at the scan, so texts are not shuffled. A conversation's places are found by a range sort
and counted offsets, prefixes are sums of hashes salted with their place, taken in blocks of BLOCK turns: no step holds a
conversation, however long. A node is a distinct prefix, named by its least member and its depth.

Nodes that follow each other with the same members are one run (what a radix tree holds as one node). Every run keeps a
counter of children that have not finished. A run whose counter is zero sends its totals (leaves, saved tokens) to its
parent, all messages of a round summed per parent before they are joined; a parent whose counter reaches zero is sent on in
the next round, until the root alone is left and finishes. Rounds follow the number of branchings on a path, not the number
of turns. Each round is written to the shared folder, so a lost executor costs one round.

Rows without conv_id are ignored; null role and text are empty. Turns of one conversation stand in order of turn (null
first), on equal turns of role, then of the hash of role and text; equal rows are turns of their own. Other columns are
ignored; an empty table gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, spread, table, written

#: Turns of a block of prefix sums.
BLOCK = 1024
#: Ids of a block of a node's ends.
END_IDS = 4096
#: Fixed value: the hash of nothing.
EMPTY = hashlib.sha256(b"").hexdigest()
_FIRST = Window.unboundedPreceding


def _order(*names: str) -> Window:
    return Window.partitionBy(*names)


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, i, t1, t2, n_chars): each turn with its place from 0, the hashes of (role, text) and its code points."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", role.alias("role"), *(F.xxhash64(F.lit(s), role, text).alias(f"t{s}") for s in (1, 2)), F.length(text).cast("bigint").alias("n_chars"),
    )
    by = ["conv_id", "turn", "role", "t1", "t2"]
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*by, "salt")
    parts = written(dealt.withColumn("part", F.spark_partition_id()).drop("salt"), "turns")
    inside = F.row_number().over(_order("conv_id", "part").orderBy("turn", "role", "t1", "t2")) - 1
    counts = parts.groupBy("conv_id", "part").count()
    before = F.sum("count").over(_order("conv_id").orderBy("part").rowsBetween(_FIRST, -1))
    starts = counts.select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = parts.withColumn("inside", inside).join(starts, ["conv_id", "part"])
    return placed.select("conv_id", (F.col("before") + F.col("inside")).alias("i"), "t1", "t2", "n_chars")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) in which each conversation begins with up to most - 1 turns of the first one of its group.

    Of conversation c the first h = crc32(c) % most turns give way to those of c - c % group. Returns (conv_id, depth from 1,
    t1, t2, n_chars) and (conv_id, length), the length 0 where nothing is left.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = sizes.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % group})
    there = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    shared = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = convs.join(there, "base", "left").withColumn("shared", shared)
    convs = written(convs.select("conv_id", "base", "h", "shared", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    first = turns.where(F.col("i") < most - 1).withColumnRenamed("conv_id", "base")
    lent = first.join(convs, "base").where("i < h").select("conv_id", (F.col("i") + 1).alias("depth"), "t1", "t2", "n_chars")
    own = turns.join(convs.select("conv_id", "h", "shared"), "conv_id").where("i >= h")
    own = own.select("conv_id", (F.col("i") - F.col("h") + F.col("shared") + 1).alias("depth"), "t1", "t2", "n_chars")
    return lent.unionByName(own), convs.select("conv_id", "length")


def _whole(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def running(rows: DataFrame, by: list[str], at: str, sums: dict[str, Column]) -> DataFrame:
    """rows with running sums by at (whole, dense in each group), itself included, in blocks of BLOCK places."""
    rows = rows.withColumn("block", F.floor(F.col(at) / BLOCK)).withColumns({f"{k}_each": v for k, v in sums.items()})
    totals = rows.groupBy(*by, "block").agg(*(F.sum(f"{k}_each").alias(f"{k}_all") for k in sums))
    before = _order(*by).orderBy("block").rowsBetween(_FIRST, -1)
    starts = totals.select(*by, "block", *(F.sum(f"{k}_all").over(before).alias(f"{k}_before") for k in sums))
    inside = _order(*by, "block").orderBy(at).rowsBetween(_FIRST, 0)
    rows = rows.withColumns({f"{k}_in": F.sum(f"{k}_each").over(inside) for k in sums}).join(starts, [*by, "block"])
    both = {k: F.coalesce(F.col(f"{k}_before"), F.lit(0)) + F.col(f"{k}_in") for k in sums}
    return rows.withColumns(both).drop("block", *(f"{k}_{x}" for k in sums for x in ("in", "before")))


def _key(seed: int, depth: Column, total: Column) -> Column:
    return F.xxhash64(depth, _whole(total)).alias(f"k{seed}")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, n_chars): the key of the prefix that ends with each turn, and that of the one before."""
    salted = {f"s{s}": _whole(F.xxhash64(f"t{s}", "depth")) for s in (1, 2)}
    rows, depth = running(turns, ["conv_id"], "depth", salted), F.col("depth").cast("bigint")
    keys = [_key(s, depth, F.col(f"s{s}")) for s in (1, 2)]
    parents = [_key(s, depth - 1, F.col(f"s{s}") - F.col(f"s{s}_each")).alias(f"p{s}") for s in (1, 2)]
    return rows.select("conv_id", depth.alias("depth"), *keys, *parents, "n_chars")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each key's ids, read in order: one hash is open at a time."""
    key, state = None, hashlib.sha256()
    for batch in batches:
        out: list[tuple] = []
        for *own, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if own != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = own, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["k1", "k2", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names=["k1", "k2", "ends_sha256"])


def ends(last: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of (k1, k2, conv_id): ids in ascending order, joined by commas, as blocks of END_IDS ids that are hashed in turn."""
    blocks = last.groupBy("k1", "k2", F.floor(F.col("conv_id") / END_IDS).alias("block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    joined = blocks.select("k1", "k2", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    dealt = joined.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block").select("k1", "k2", "ids")
    return dealt.mapInArrow(_digests, "k1 bigint, k2 bigint, ends_sha256 string")


RUN = ["conv_id", "n_convs"]


def peeled(runs: DataFrame) -> DataFrame:
    """(conv_id, n_convs, leaves, saved): the subtree totals of runs (conv_id, n_convs, up_conv, up_n, open, leaves, saved).

    open counts the children that have not sent yet; leaves and saved are a run's own at first.
    """
    done, now = [], written(runs, "peel")
    while True:
        finished, waiting = now.where("open = 0"), now.where("open > 0")
        done.append(finished.select(*RUN, "leaves", "saved"))
        if waiting.isEmpty():
            break
        sent = finished.groupBy(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs")).agg(
            F.count("*").alias("sent"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
        )
        met = waiting.join(sent, RUN, "left")
        add = lambda c, x, sign=1: (F.col(c) + sign * F.coalesce(F.col(x), F.lit(0))).alias(c)
        now = written(met.select(*RUN, "up_conv", "up_n", add("open", "sent", -1), add("leaves", "more_leaves"), add("saved", "more_saved")), "peel")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of turns (conv_id, depth from 1 without gaps, t1, t2, n_chars) of conversations (conv_id, length).

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node.
    """
    spark = turns.sparkSession
    rows = written(prefixes(turns), "prefixes")
    zero, none = F.lit(0).cast("bigint"), F.lit(0)
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(_key(1, zero, none), _key(2, zero, none), zero.alias("depth"), *RUN, *(F.lit(None).cast("bigint").alias(p) for p in ("p1", "p2")), zero.alias("own"))
    nodes = rows.groupBy("k1", "k2").agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        ((F.count("*") - 1) * F.min("n_chars")).alias("own"),
    )
    nodes = written(nodes.unionByName(root), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"))
    linked = nodes.join(children, ["k1", "k2"], "left").join(above, ["p1", "p2"], "left")
    linked = written(linked.select("k1", "k2", "depth", *RUN, "own", F.coalesce("n_children", F.lit(0)).alias("n_children"), "parent_conv_id", "parent_n"), "linked")
    kids = F.max_by("n_children", "depth")
    up = [F.min_by("parent_conv_id", "depth").alias("up_conv"), F.min_by("parent_n", "depth").alias("up_n")]
    runs = linked.groupBy(*RUN).agg(*up, kids.alias("open"), F.when(kids == 0, 1).otherwise(0).cast("bigint").alias("leaves"), F.sum("own").alias("saved"))
    totals = peeled(runs)
    last = rows.join(conversations, "conv_id").where("depth = length").select("k1", "k2", "conv_id")
    empty = conversations.where("length = 0").select(_key(1, zero, none), _key(2, zero, none), "conv_id")
    digests = ends(last.unionByName(empty))
    above_me = running(linked, RUN, "depth", {"so_far": F.col("own")})
    whole = above_me.join(totals, RUN).join(digests, ["k1", "k2"], "left")
    out = whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
        (F.col("saved") - F.col("so_far") + F.col("own")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    out = written(out, "trie")
    for own in (rows, nodes, linked):
        discard(own)
    return out


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are."""
    turns = ordered(conversations)
    members = turns.groupBy("conv_id").agg(F.count("*").alias("length"))
    return trie(turns.withColumn("depth", F.col("i") + 1).drop("i"), members)


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(written(ordered(spread(table(spark, sf_dir, "conversations"))), "ordered")))


#: crc32 as SQL, bit by bit, of the decimal text in {0}.
CRC32 = (
    "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda x: ascii(x)::BIGINT)), "
    "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"
)

ORACLE = f"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i,
        coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
sizes AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
convs AS (
    SELECT s.conv_id, s.h, s.base, least(s.h, coalesce(b.n, 0)) AS shared
    FROM (SELECT conv_id, conv_id - conv_id % 100 AS base, {CRC32.format("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM sizes) s
    LEFT JOIN sizes b ON b.conv_id = s.base),
made AS (
    SELECT c.conv_id, t.i + 1 AS depth, role, text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.i < c.h
    UNION ALL
    SELECT c.conv_id, t.i - c.h + c.shared + 1, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i >= c.h),
paths AS (
    SELECT conv_id, depth, length(text) AS n_chars,
        string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path
    FROM made
    UNION ALL SELECT conv_id, 0, 0, '' FROM sizes),
lengths AS (SELECT conv_id, max(depth) AS length FROM paths GROUP BY conv_id),
nodes AS (
    SELECT path, min(depth) AS depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(n_chars) AS own,
        sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
    FROM paths p JOIN lengths l ON l.conv_id = p.conv_id GROUP BY path),
tree AS (
    SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.path[1:length(k.path) - 64] = n.path) AS n_children
    FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:length(n.path) - 64]),
below AS (
    SELECT p.path, count(*) FILTER (WHERE d.n_children = 0) AS n_leaves, sum(d.own) AS saved_tokens
    FROM tree d JOIN paths p ON p.conv_id = d.conv_id AND p.depth <= d.depth GROUP BY p.path)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM tree JOIN below USING (path)
"""
