"""Exact top-k search over binary codes by incremental multi-index hashing.

A code (the signs of a vector, 64 bits) is cut into four segments of 16 bits (two of 32 for over MANY entries, as segments should
be about as long as the logarithm of their number). Equal codes are one entry with the ids that any
result can need. Queries are worked off in rounds of growing radius: an open query probes, segment by segment, the entries
whose segment differs from its own in r bits, and verifies what it meets by full Hamming distance. After
radius r every entry within 4 (r + 1) - 1 has been met, so a query closes as soon as its last wanted distance is at most
that; only open queries go into the next round. The first radii, which are PROBES probes together, make one round, and so do
the last ones, of which each has more probes than there are entries.

The index is dealt out by segment and its leading bits (as many as the number of entries asks for). A query goes only to
the cells whose leading bits differ from its own in j <= r bits and probes there the remaining r - j, in one sorted
array; it never meets the rest of the index. A cell that holds more than ENTRIES entries, or gets more than ASKS queries, is
split into blocks of so many.

Rows whose vector is null, empty, holds null or non-finite components, or whose length differs from code_bits are
neither queries nor results. Equal ids are rows of their own; a query does not find rows of its own
id. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import same, small, spread, table, written

CODE_BITS, MANY = 64, 1 << 24
#: What names a search: the query's code, and the id that it leaves out if it is not lone.
ASK = ["ask", "own", "lone"]
#: Entries of a cell, and queries that meet them at once.
ENTRIES, ASKS = 16_384, 16_384
#: Probes of a query in a segment that are worth a round.
PROBES = 1024
#: Pairs of a query and an entry that are verified at once.
MET = 1 << 21
BROADCAST_ROWS = 1 << 18
_masks: dict[tuple[int, int], np.ndarray] = {}


def masks(bits: int, radius: int) -> np.ndarray:
    """All numbers of so many bits of which radius are set."""
    if (bits, radius) not in _masks:
        ways = list(combinations(range(bits), radius))
        sets = np.array(ways, np.int64).reshape(len(ways), radius)
        _masks[bits, radius] = (np.int64(1) << sets).sum(1).astype(np.int64)
    return _masks[bits, radius]


def codes(vectors: DataFrame, code_bits: int = 64) -> DataFrame:
    """(vec_id, code): bit i is set where component i is above zero."""
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    bit = lambda v: F.when(v > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    code = F.aggregate(x, F.lit(0).cast("bigint"), lambda a, v: F.shiftleft(a, 1).bitwiseOR(bit(v)))
    return vectors.where(x.isNotNull() & (F.size(x) == code_bits) & fine).select("vec_id", code.alias("code"))


def rounds(bits: int, entries: int) -> Iterator[tuple[int, int]]:
    """(first, last) radius of each round."""
    low = probes = 0
    for radius in range(bits + 1):
        if comb(bits, radius) > entries and radius <= bits // 2:
            if radius > low:
                yield low, radius - 1
            yield radius, bits
            return
        if probes and probes + comb(bits, radius) > PROBES:
            yield low, radius - 1
            low, probes = radius, 0
        probes += comb(bits, radius)
    yield low, bits


def entries_of(data: DataFrame, k: int) -> DataFrame:
    """(code, ids): per distinct code the least ids, as many as a query can take and skip: of one id k, of all 2 k + 1."""
    per_id = F.row_number().over(Window.partitionBy("code", "vec_id").orderBy(F.lit(0)))
    per_code = F.row_number().over(Window.partitionBy("code").orderBy("vec_id"))
    few = data.withColumn("r", per_id).where(F.col("r") <= k).withColumn("r", per_code).where(F.col("r") <= 2 * k + 1)
    return few.groupBy("code").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def top_bits(entries: int, bits: int) -> int:
    """Leading bits of a segment that name a cell."""
    return min(bits, (entries // ENTRIES).bit_length())


class Cell:
    """The entries of one cell, sorted by the bits of their segment that do not name it."""

    def __init__(self, code: np.ndarray, ids: pa.ListArray, value: np.ndarray):
        order = np.argsort(value, kind="stable")
        self.code, self.value, self.ids = code[order], value[order], ids.take(pa.array(order))
        cuts = self.ids.offsets.to_numpy().astype(np.int64)
        self.flat, self.first, self.n = self.ids.values.to_numpy(), cuts[:-1], np.diff(cuts)

    def probe(self, ask: np.ndarray, own: np.ndarray, lone: np.ndarray, value: np.ndarray, bits: int, flips: tuple[int, int], want: int):
        """(query, entry, distance) of what the want nearest rows of each query need, among entries whose value differs from the query's in so many of bits.

        Where there are more such values than entries, the entries are gone through instead.
        """
        out, each = [], range(flips[0], flips[1] + 1)
        n_ways = sum(comb(bits, f) for f in each)
        whole = n_ways > len(self.code)
        ways = None if whole else np.concatenate([masks(bits, f) for f in each])
        step = max(1, MET // max(1, min(n_ways, len(self.code))))
        for at in range(0, len(ask), step):
            part = np.arange(at, min(at + step, len(ask)))
            if whole:
                apart = np.bitwise_count(value[part][:, None] ^ self.value[None, :])
                row, e = np.nonzero((apart >= flips[0]) & (apart <= flips[1]))
                out.append(self.verified(part[row], e, ask, own, lone, want))
                continue
            wanted = value[part][:, None] ^ ways[None, :]
            first = np.searchsorted(self.value, wanted, "left")
            n = np.searchsorted(self.value, wanted, "right") - first
            row, col = np.nonzero(n)
            times = n[row, col]
            ends = np.cumsum(times)
            begin = 0
            while begin < len(row):  # runs of probes that meet about MET entries
                stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + MET, "right")))
                r, c, t = row[begin:stop], col[begin:stop], times[begin:stop]
                e = np.repeat(first[r, c] - (np.cumsum(t) - t), t) + np.arange(t.sum())
                out.append(self.verified(part[np.repeat(r, t)], e, ask, own, lone, want))
                begin = stop
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return self.nearest(*(np.concatenate(x) for x in zip(*out)), own, lone, want)

    def verified(self, q: np.ndarray, e: np.ndarray, ask: np.ndarray, own: np.ndarray, lone: np.ndarray, want: int):
        apart = np.bitwise_count((ask[q] ^ self.code[e]).view(np.uint64)).astype(np.int64)
        return self.nearest(q, e, apart, own, lone, want)

    def nearest(self, q: np.ndarray, e: np.ndarray, d: np.ndarray, own: np.ndarray, lone: np.ndarray, want: int):
        """Of met entries those that fewer than want rows precede for sure: rows that are nearer, and the least rows of others as near."""
        n, least = self.n[e], self.flat[self.first[e]]
        for i in np.flatnonzero(~lone[q]):  # a repeated id: its rows do not count
            ids = self.flat[self.first[e[i]] : self.first[e[i]] + n[i]]
            ids = ids[ids != own[q[i]]]
            n[i], least[i] = len(ids), ids[0] if len(ids) else 0
        q, e, d, n, least = (x[n > 0] for x in (q, e, d, n, least))
        by = np.lexsort((least, d, q))
        q, e, d, n = q[by], e[by], d[by], n[by]
        if not len(q):
            return q, e, d
        before = np.cumsum(n) - n
        of_query, of_distance = np.append(True, q[1:] != q[:-1]), np.append(True, (q[1:] != q[:-1]) | (d[1:] != d[:-1]))
        start = lambda lead: np.maximum.accumulate(np.where(lead, np.arange(len(q)), 0))
        nearer = before[start(of_distance)] - before[start(of_query)]
        close = nearer + np.arange(len(q)) - start(of_distance) < want
        return q[close], e[close], d[close]


def met_in(cells: DataFrame, bits: int, top: int, radii: tuple[int, int], want: int) -> DataFrame:
    """(ASK, code, ids, distance): what the queries of cells meet at these radii."""
    rest = bits - top

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in same(batches, "cell"):
            code, asks, segment, own, lone, apart = (t.column(c).to_numpy() for c in ("code", "is_ask", "segment", "own", "lone", "apart"))
            e, q = np.flatnonzero(~asks), np.flatnonzero(asks)
            if not len(e) or not len(q):
                continue
            value = lambda x: (code[x] >> (bits * segment[x].astype(np.int64))) & np.int64((1 << rest) - 1)
            cell = Cell(code[e], t.column("ids").combine_chunks().take(pa.array(e)), value(e))
            for j in np.unique(apart[q]):
                i = q[apart[q] == j]
                flips = max(0, radii[0] - int(j)), min(rest, radii[1] - int(j))
                x, y, d = cell.probe(code[i], own[i], lone[i], value(i), rest, flips, want)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c[i[x]]) for c in (code, own, lone)), pa.array(cell.code[y]), cell.ids.take(pa.array(y)), pa.array(d)],
                    names=[*ASK, "code", "ids", "distance"],
                )

    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(run, "ask bigint, own bigint, lone boolean, code bigint, ids array<bigint>, distance bigint")


def placed(entries: DataFrame, asks: DataFrame, bits: int, top: int, radii: tuple[int, int]) -> DataFrame:
    """Both sides dealt to cells, (cell, is_ask, segment, code, own, lone, ids, apart); what is too much for a cell in blocks."""
    rest = bits - top
    lead = lambda c: F.expr(f"shiftrightunsigned({c}, segment * {bits} + {rest})").bitwiseAND(F.lit((1 << top) - 1).cast("bigint")) if top else F.lit(0).cast("bigint")
    segments = F.explode(F.array(*[F.lit(s) for s in range(CODE_BITS // bits)]))
    index = entries.withColumn("segment", segments).withColumn("value", lead("code"))
    flips = [(int(m), j) for j in range(max(0, radii[0] - rest), min(radii[1], top) + 1) for m in masks(top, j).tolist()]
    ways = F.array(*[F.struct(F.lit(m).cast("bigint").alias("mask"), F.lit(j).alias("apart")) for m, j in flips])
    each = asks.withColumn("segment", segments).withColumn("way", F.explode(ways))
    each = each.withColumn("value", lead("ask").bitwiseXOR(F.col("way.mask"))).withColumn("apart", F.col("way.apart"))
    cell = ["segment", "value"]
    sizes = index.groupBy(*cell).agg(F.ceil(F.count("*") / ENTRIES).alias("blocks")).join(
        each.groupBy(*cell).agg(F.ceil(F.count("*") / ASKS).alias("lots")), cell
    )
    if CODE_BITS // bits << top <= BROADCAST_ROWS:  # there are no more cells than this
        sizes = F.broadcast(sizes)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    name = F.xxhash64(*cell, "block", "lot").alias("cell")
    mine = index.join(sizes, cell).withColumn("block", F.pmod(F.xxhash64("code"), "blocks")).withColumn("lot", every("lots"))
    theirs = each.join(sizes, cell).withColumn("lot", F.pmod(F.xxhash64(*ASK), "lots")).withColumn("block", every("blocks"))
    none = F.lit(None)
    return mine.select(name, F.lit(False).alias("is_ask"), "segment", "code", F.lit(0).cast("bigint").alias("own"), F.lit(True).alias("lone"), "ids", F.lit(0).alias("apart")).unionByName(
        theirs.select(name, F.lit(True).alias("is_ask"), "segment", F.col("ask").alias("code"), "own", "lone", none.cast("array<bigint>").alias("ids"), "apart")
    )


def best_rows(met: DataFrame, want: int, reach: int, rows: int) -> DataFrame:
    """(ASK, code, ids, vec_id, distance, r, done): the want nearest rows of each query, those of its own id left out.

    A query is done when its rows are complete: the last wanted one is within reach, or there are no more rows.
    """
    own = Window.partitionBy(*ASK)
    ids = F.when(F.col("lone"), F.col("ids")).otherwise(F.filter("ids", lambda x: x != F.col("own")))
    once = met.repartition(*ASK).dropDuplicates([*ASK, "code"]).withColumn("others", ids).where(F.size("others") > 0)
    # an entry comes before each row of an entry that is further or has no lesser id: so many entries hold all wanted rows
    least = own.orderBy("distance", F.get("others", F.lit(0)), "code")
    few = once.withColumn("r", F.row_number().over(least)).where(F.col("r") <= want)
    rows_of = few.select(*ASK, "code", "ids", "distance", F.posexplode("others").alias("at", "vec_id"))
    ranked = rows_of.withColumn("r", F.row_number().over(own.orderBy("distance", "vec_id", "code", "at")))
    kept = ranked.where(F.col("r") <= want)
    n, last = F.count("*").over(own), F.max("distance").over(own)
    done = ((n >= want) & (last <= reach)) | (F.col("lone") & (n >= rows)) | F.lit(reach >= CODE_BITS)
    return kept.select(*ASK, "code", "ids", "vec_id", "distance", "r", done.alias("done"))


def search(data: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest of data (vec_id, code) for each of queries.

    Queries of one code are searched for once, one row further than k, as each leaves out its own row; queries of an id
    that several rows have are not lone, and are searched for with that id left out.
    """
    data = written(data, "codes")
    entries = written(entries_of(data, k), "entries")
    count, rows = entries.count(), data.count()
    bits = 16 if count <= MANY else 32
    top = top_bits(count, bits)
    several = data.groupBy("vec_id").count().where("count > 1").select(F.col("vec_id").alias("several_id"), F.lit(False).alias("lone"))
    met = queries.join(small(written(several, "several"), BROADCAST_ROWS), F.col("vec_id") == F.col("several_id"), "left")
    lone = F.coalesce("lone", F.lit(True))
    asked = written(met.select("vec_id", F.col("code").alias("ask"), F.when(lone, F.lit(0)).otherwise(F.col("vec_id")).cast("bigint").alias("own"), lone.alias("lone")), "asked")
    cores = data.sparkSession.sparkContext.defaultParallelism
    open_ = written(asked.select(*ASK).distinct().coalesce(cores), "open")
    want, held, found = k + 1, None, None
    for radii in rounds(bits, count):
        met = met_in(placed(entries, open_, bits, top, radii), bits, top, radii, want)
        met = met if held is None else met.unionByName(held)
        # after the last radius a query has met every row that there is
        reach = CODE_BITS if radii[1] == bits else CODE_BITS // bits * (radii[1] + 1) - 1
        best = written(best_rows(met, want, reach, rows), "best")
        closed = best.where("done")
        found = closed if found is None else found.unionByName(closed)
        held = best.where("NOT done").select(*ASK, "code", "ids", "distance")
        open_ = written(open_.join(closed.select(*ASK), ASK, "left_anti").coalesce(cores), "open")
        if open_.isEmpty():
            break
    lists = found.groupBy(*ASK).agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "distance"))).alias("rows"))  # k + 1 rows at most
    each = asked.select(F.col("vec_id").alias("query_id"), *ASK).join(lists, ASK)
    others = F.slice(F.filter("rows", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = each.select("query_id", F.posexplode(others).alias("at", "row"))
    return ranked.select("query_id", (F.col("at") + 1).cast("bigint").alias("rank"), "row.vec_id", "row.distance")


def op10_code_search(spark, sf_dir: str, k: int = 10) -> DataFrame:
    data = codes(spread(table(spark, sf_dir, "embeddings"))).where("vec_id IS NOT NULL")
    return search(data, data.where("vec_id % 20 = 0"), k)


ORACLE = """
WITH c AS (SELECT vec_id, list_reduce(list_transform(embedding, lambda v: CASE WHEN v > 0 THEN '1' ELSE '0' END), lambda a, b: a || b)::bit AS code
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) = 64),
d AS (SELECT q.vec_id AS query_id, x.vec_id, bit_count(xor(q.code, x.code))::bigint AS distance
  FROM c q JOIN c x ON q.vec_id <> x.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
