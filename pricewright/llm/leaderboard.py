"""Change feed of leaderboards: the ten best earning items of each nation, kept by treaps in the state of a stream.

Lines are cut into batches, written to the shared folder and fed in order to one streaming query, started anew for each on one
checkpoint. Its state is an order-statistic treap per nation and share of the items, keyed by (revenue falling, item_id):
an update deletes the item's old key and inserts the new one, the board is read off by visiting the first ten nodes in
order, and is compared with the one stored before. Priorities are a hash of the item, so a treap's shape follows from its keys
and the state keeps only those.

A nation has as many shares as its items need at SHARE_ITEMS each; the changes of FAN shares' boards go to a further stateful
query with a treap of their candidates, and so on until one is left, whose ranks make the feed. So no task holds or reads a
nation. Lines are summed per item and day inside each task before they are dealt, so a hot item is a few rows a task. Look-ups are
shuffle joins (never broadcast) that the engine splits where a key is hot; what reaches the driver is one row a batch.

Results of odd rows: null parts of the key are empty; an amount, or a price, that is not a number below 9e15 counts as null; lines whose vendor or
nation is unknown, or whose item has no row, are ignored but move the time of their batch; days before the first batch belong to
it; repeated lines count each time; of repeated vendors or items the least nation and the highest price count. Other
columns are ignored; without lines the feed is empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .common import scratch, table, written
from .conversation_trie import CRC32

#: The first day (2024-01-01 in days since 1970), the days of all batches, days of grace, places of a board.
FIRST_DAY, SPAN, GRACE, PLACES = 19723, 180, 3, 10
#: Items of a treap on average, and children of a merging one.
SHARE_ITEMS, FAN = 4096, 128
#: Rows that are summed at once.
HELD = 1 << 18
_HIGH, _LOW, _MASK = 1 << 63, 1 << 63, (1 << 64) - 1


class Treap:
    """Keys in order under random priorities, with subtree sizes; node 0 is none.

    A key holds (revenue falling, item rising) as one whole number.
    """

    def __init__(self, revenue: np.ndarray, items: np.ndarray):
        """From revenues and items in key order."""
        n = len(items)
        self.prio = [0, *priorities(items).tolist()]
        self.key = [0, *map(key_of, revenue.tolist(), items.tolist())]
        self.left, self.right, self.size, self.free = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1), []
        self.revenue = dict(zip(items.tolist(), revenue.tolist()))
        left, right, size, prio = self.left, self.right, self.size, self.prio
        spine: list[int] = []  # the right spine of what is built; a node is complete when it leaves it
        for t in range(1, n + 1):
            last = 0
            while spine and prio[spine[-1]] < prio[t]:
                last = spine.pop()
                size[last] = 1 + size[left[last]] + size[right[last]]
            left[t] = last
            if spine:
                right[spine[-1]] = t
            spine.append(t)
        for t in reversed(spine):
            size[t] = 1 + size[left[t]] + size[right[t]]
        self.root = spine[0] if spine else 0

    def put(self, item: int, revenue: int) -> None:
        """Delete the item's key, if it has one, and insert the new one."""
        old = self.revenue.get(item)
        if old is not None:
            if old == revenue:
                return
            prio = self._delete(key_of(old, item))
        else:
            prio = priority(item)
        self.revenue[item] = revenue
        self._insert(key_of(revenue, item), prio)

    def drop(self, item: int) -> None:
        old = self.revenue.pop(item, None)
        if old is not None:
            self._delete(key_of(old, item))

    def _hang(self, above: int, low: bool, node: int) -> None:
        if not above:
            self.root = node
        elif low:
            self.left[above] = node
        else:
            self.right[above] = node

    def _insert(self, x: int, p: int) -> None:
        key, prio, left, right, size = self.key, self.prio, self.left, self.right, self.size
        t, above, low = self.root, 0, False
        while t and prio[t] >= p:
            size[t] += 1
            above, low = t, x < key[t]
            t = left[t] if low else right[t]
        if self.free:
            n = self.free.pop()
            key[n], prio[n] = x, p
        else:
            n = len(key)
            for of, v in ((key, x), (prio, p), (left, 0), (right, 0), (size, 0)):
                of.append(v)
        left[n], right[n] = self._split(t, x)
        size[n] = 1 + size[left[n]] + size[right[n]]
        self._hang(above, low, n)

    def _split(self, t: int, x: int) -> tuple[int, int]:
        if not t:
            return 0, 0
        left, right, size = self.left, self.right, self.size
        if self.key[t] < x:
            a, b = self._split(right[t], x)
            right[t], out = a, (t, b)
        else:
            a, b = self._split(left[t], x)
            left[t], out = b, (a, t)
        size[t] = 1 + size[left[t]] + size[right[t]]
        return out

    def _delete(self, x: int) -> int:
        """Take out a key that is there; its priority."""
        key, left, right, size = self.key, self.left, self.right, self.size
        t, above, low = self.root, 0, False
        while (k := key[t]) != x:
            size[t] -= 1
            above, low = t, x < k
            t = left[t] if low else right[t]
        self._hang(above, low, self._merge(left[t], right[t]))
        self.free.append(t)
        return self.prio[t]

    def _merge(self, a: int, b: int) -> int:
        if not a or not b:
            return a or b
        left, right, size = self.left, self.right, self.size
        if self.prio[a] >= self.prio[b]:
            right[a], top = self._merge(right[a], b), a
        else:
            left[b], top = self._merge(a, left[b]), b
        size[top] = 1 + size[left[top]] + size[right[top]]
        return top

    def first(self, n: int) -> list[int]:
        """The items of the first n keys with a positive revenue."""
        out, path, t = [], [], self.root
        while (t or path) and len(out) < n:
            while t:
                path.append(t)
                t = self.left[t]
            t = path.pop()
            if self.key[t] >> 64 >= _HIGH:  # no revenue, and no more behind
                break
            out.append((self.key[t] & _MASK) - _LOW)
            t = self.right[t]
        return out

    def rank(self, item: int) -> int:
        """How many keys come before the item's."""
        x, t, n = key_of(self.revenue[item], item), self.root, 0
        while self.key[t] != x:
            if x < self.key[t]:
                t = self.left[t]
            else:
                n += 1 + self.size[self.left[t]]
                t = self.right[t]
        return n + self.size[self.left[t]]

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """(revenues, items) in key order."""
        items, revenue = np.array(list(self.revenue), np.int64), np.array(list(self.revenue.values()), np.int64)
        order = np.lexsort((items, -revenue))
        return revenue[order], items[order]


def key_of(revenue: int, item: int) -> int:
    return (_HIGH - revenue) << 64 | (item + _LOW)


def priorities(items: np.ndarray) -> np.ndarray:
    """A mix of each item's bits."""
    x = items.astype(np.uint64)
    with np.errstate(over="ignore"):
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x + np.uint64(0x9E3779B97F4A7C15) ^ (x >> np.uint64(shift))) * np.uint64(by)
        return (x ^ (x >> np.uint64(31))) >> np.uint64(8)


def priority(item: int) -> int:
    x = item & _MASK
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x + 0x9E3779B97F4A7C15 & _MASK) ^ x >> shift) * by & _MASK
    return (x ^ x >> 31) >> 8


def _planes(x: np.ndarray) -> bytes:
    """The differences of neighbours, byte by byte of all: small numbers leave runs of zeros."""
    d = np.diff(x, prepend=np.int64(0))
    return np.ascontiguousarray(((d << 1) ^ (d >> 63)).view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    z = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()
    return np.cumsum((z >> np.uint64(1)).view(np.int64) ^ -(z & np.uint64(1)).view(np.int64))


#: The state of a treap: its rows and its board, and the number of rows.
STATE = "keys binary, n bigint, board binary"
_CODEC = "zstd"


def loaded(state: GroupState) -> tuple[Treap, list[int]]:
    if not state.exists:
        return Treap(np.zeros(0, np.int64), np.zeros(0, np.int64)), []
    keys, n, board = state.get
    data = pa.Codec(_CODEC).decompress(bytes(keys), 16 * n, asbytes=True)
    return Treap(_from_planes(data[: 8 * n]), _from_planes(data[8 * n :])), np.frombuffer(bytes(board), np.int64).tolist()


def kept(state: GroupState, treap: Treap, board: list[int]) -> None:
    revenue, items = treap.rows()
    state.update((pa.Codec(_CODEC, 3).compress(_planes(revenue) + _planes(items), asbytes=True), len(items), np.array(board, np.int64).tobytes()))


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task with cents summed per nation, item and day."""
    held: list[pa.RecordBatch] = []

    def out() -> pa.RecordBatch:
        by = ["nation_id", "item_id", "day"]
        t = pa.Table.from_batches(held).group_by(by).aggregate([("cents", "sum")])
        return t.select([*by, "cents_sum"]).rename_columns([*by, "cents"]).combine_chunks().to_batches()[0]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) > HELD:
            held = [out()]
            if held[0].num_rows > HELD // 2:
                yield held.pop()
    if held:
        yield out()


def _gathered(frames: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(days, items, cents) in order of day and item, cents summed; frames are summed as they come, so repeats take no room."""
    none = np.zeros(0, np.int64)
    whole, new, rows = (none, none, none), [], 0

    def joined():
        day, item, cents = (np.concatenate(x) for x in zip(whole, *new))
        order = np.lexsort((item, day))
        day, item, cents = day[order], item[order], cents[order]
        at = np.flatnonzero(np.append(True, (np.diff(day) != 0) | (np.diff(item) != 0))) if len(day) else none
        return day[at], item[at], np.add.reduceat(cents, at) if len(at) else none

    for f in frames:
        new.append(tuple(f[c].to_numpy(np.int64) for c in ("day", "item_id", "cents")))
        rows += len(f)
        if rows > HELD:
            whole, new, rows = joined(), [], 0
    return joined()


def _days(day: np.ndarray) -> Iterator[tuple[int, slice]]:
    at = np.flatnonzero(np.append(True, np.diff(day) != 0)) if len(day) else []
    for a, b in zip(at, [*at[1:], len(day)]):
        yield int(day[a]), slice(int(a), int(b))


Rows = list[tuple]
#: Columns of what a treap tells the next one: stays says whether the item is still on its board.
TOLD = "nation_id int, share bigint, day bigint, item_id bigint, cents bigint, stays boolean"
CHANGES = "nation_id int, arrival_day bigint, item_id bigint, change string, old_rank int, new_rank int, revenue bigint"


def told(nation: int, up: int, day: int, before: list[int], now: list[int], touched: dict[int, int | None], treap: Treap, gone: dict[int, int]) -> Rows:
    """What a share's board tells the next one: entries, exits and new revenues."""
    has, had = set(now), set(before)
    out = [(nation, up, day, i, treap.revenue[i], True) for i in now if i not in had or i in touched]
    return out + [(nation, up, day, i, treap.revenue.get(i, gone.get(i)), False) for i in before if i not in has]


def ranked(nation: int, up: int, day: int, before: list[int], now: list[int], touched: dict[int, int | None], treap: Treap, gone: dict[int, int]) -> Rows:
    """The changes of rank of a nation's board."""
    old, new = ({i: k for k, i in enumerate(x, 1)} for x in (before, now))
    out = []
    for i in dict.fromkeys([*before, *now]):
        a, b = old.get(i), new.get(i)
        if a != b:
            change = "enter" if a is None else "exit" if b is None else "move"
            out.append((nation, day, i, change, a, b, treap.revenue.get(i, gone.get(i))))
    return out


def _frame(rows: Rows, schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return pd.DataFrame(rows, columns=names).astype({c: "Int32" for c in ("old_rank", "new_rank") if c in names})


def share_step(tell: Callable[..., Rows], schema: str, fan: int) -> Callable:
    """The stateful operator of a share: sums of cents per day and item come in."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nation, share = map(int, key)
        treap, board = loaded(state)
        days, items, cents = _gathered(frames)
        rows: Rows = []
        for day, part in _days(days):
            touched = {}
            for item, more in zip(items[part].tolist(), cents[part].tolist()):
                touched[item] = treap.revenue.get(item, 0) + more
                treap.put(item, touched[item])
            now = treap.first(PLACES)
            rows += tell(nation, share // fan, day, board, now, touched, treap, {})
            board = now
        kept(state, treap, board)
        if rows:
            yield _frame(rows, schema)

    return run


def merge_step(tell: Callable[..., Rows], schema: str, fan: int) -> Callable:
    """The stateful operator over the boards of fan shares: their changes come in, a treap holds their candidates."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        nation, share = map(int, key)
        treap, board = loaded(state)
        came = pd.concat(list(frames)).sort_values("day", kind="stable")  # at most PLACES in and out a day, of fan boards
        rows: Rows = []
        items, cents, stays = came["item_id"].tolist(), came["cents"].tolist(), came["stays"].tolist()
        for day, part in _days(came["day"].to_numpy(np.int64)):
            touched, gone = {}, {}
            for item, revenue, there in zip(items[part], cents[part], stays[part]):
                if there:
                    touched[item] = revenue
                    treap.put(item, revenue)
                else:
                    gone[item] = revenue
                    treap.drop(item)
            now = treap.first(PLACES)
            rows += tell(nation, share // fan, day, board, now, touched, treap, gone)
            board = now
        kept(state, treap, board)
        if rows:
            yield _frame(rows, schema)

    return run


def widths(shares: int, fan: int) -> list[int]:
    """Treaps of a nation, level by level, down to one."""
    out = [shares]
    while out[-1] > 1:
        out.append(-(-out[-1] // fan))
    return out


def told_by(rows: DataFrame, level: int, levels: list[int], fan: int = FAN) -> DataFrame:
    """The stream of a level's boards: TOLD, or CHANGES at the last one. Level 0 takes (nation_id, item_id, day, cents), the others TOLD.

    The rows of a day must come in one micro-batch, and days in order.
    """
    tell, schema = (ranked, CHANGES) if level == len(levels) - 1 else (told, TOLD)
    if not level:
        rows = rows.mapInArrow(summed, "nation_id int, item_id bigint, day bigint, cents bigint")
        rows = rows.withColumn("share", F.pmod(F.xxhash64("item_id"), F.lit(levels[0])))
    step = (merge_step if level else share_step)(tell, schema, fan)
    return rows.groupBy("nation_id", "share").applyInPandasWithState(step, schema, STATE, "append", GroupStateTimeout.NoTimeout)


def _rounded(c: Column) -> Column:
    """floor(100 c + 0.5) of a number of bounded size; null of others."""
    return F.when(F.abs(c) < 9e13, F.floor(100 * c + 0.5))


def batch_of(day: Column, batches: int = 10) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(batches), 1 + F.floor((day - FIRST_DAY) * batches / SPAN))).cast("int")


def prepared(lines: DataFrame, vendors: DataFrame, items: DataFrame) -> DataFrame:
    """Every line as (nation_id, item_id, cents, sent, day): the day it was shipped and the one on which it arrives; nation_id is null if it is ignored."""
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")))
    sign = F.when(F.col("flag") == "swapped", -1).otherwise(1)
    paid = _rounded(F.col("amount"))
    h, sent = F.col("h"), F.coalesce(F.unix_date(F.to_date("shipped_at")), (FIRST_DAY + F.col("h") % 150).cast("int"))
    day = F.col("sent") + (h % 7).cast("int") + F.when(h % 5 == 0, 20).otherwise(0)
    rows = lines.withColumn("h", F.crc32(text.cast("binary"))).withColumn("sent", sent).select(
        "item_id", "vendor_id", (sign * paid).alias("paid"), F.when(paid.isNull(), sign * F.col("quantity")).alias("pieces"), "sent", day.alias("day"),
    )
    # look-ups are shuffled, never broadcast, and each side is an exchange, so that the engine can split a hot key
    prices = written(items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.max(_rounded(F.col("price"))).alias("price")), "prices")
    nations = written(vendors.where("vendor_id IS NOT NULL").groupBy("vendor_id").agg(F.min("nation_id").cast("int").alias("nation_id")), "nations")
    priced = rows.join(prices.withColumn("sold", F.lit(True)).hint("shuffle_hash"), "item_id", "left")
    cents = F.coalesce("paid", F.col("pieces") * F.col("price"), F.lit(0)).cast("bigint")
    priced = priced.select("vendor_id", F.when(F.col("sold"), F.col("item_id")).alias("item_id"), cents.alias("cents"), "sent", "day")
    placed = priced.join(nations.hint("shuffle_hash"), "vendor_id", "left")
    return placed.select(F.when(F.col("item_id").isNotNull(), F.col("nation_id")).alias("nation_id"), "item_id", "cents", "sent", "day")


def feed(
    spark: SparkSession, lines: DataFrame, vendors: DataFrame, items: DataFrame, batches: int = 10, share_items: int = SHARE_ITEMS, fan: int = FAN, merge_every: int | None = None
) -> DataFrame:
    """The change feed of lines, cut into batches by the day on which they arrive; CHANGES with their batch.

    The query over the lines is started for each batch; those that merge boards after every merge_every batches, or once behind the last:
    a start of theirs reads what the shares have told since, at most two boards a share and day.
    """
    home = f"{scratch(spark)}/leaderboard-{uuid.uuid4().hex[:12]}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    disk = path(home).getFileSystem(spark._jsc.hadoopConfiguration())
    shares = items.count() // share_items + 1
    ready = prepared(lines, vendors, items).withColumn("batch", batch_of(F.col("day"), batches))
    ready.write.partitionBy("batch").option("compression", "zstd").parquet(f"{home}/cut")
    whole = spark.read.schema(ready.schema).parquet(f"{home}/cut")
    latest = dict(whole.groupBy("batch").agg(F.max("sent")).collect())  # a row a batch
    levels, known = widths(shares, fan), None
    for folder in ("feed", *(f"told-{level}" for level in range(len(levels)))):
        disk.mkdirs(path(f"{home}/{folder}"))
    told_schema = spark.createDataFrame([], TOLD).schema
    for batch in range(1, batches + 1):
        if batch in latest:
            disk.rename(path(f"{home}/cut/batch={batch}"), path(f"{home}/feed/{batch:04}"))
        came = spark.readStream.schema(ready.drop("batch").schema).option("recursiveFileLookup", True).parquet(f"{home}/feed")
        if known is not None:
            came = came.where(F.col("sent") + GRACE >= known)
        rows = came.where("nation_id IS NOT NULL").select("nation_id", "item_id", F.col("day").cast("bigint").alias("day"), "cents")
        # a query has one operator with state, so each level is a query on a checkpoint of its own
        for level in range(len(levels) if batch % (merge_every or batches) == 0 or batch == batches else 1):
            out = told_by(rows, level, levels, fan).writeStream.format("parquet").outputMode("append")
            out = out.option("checkpointLocation", f"{home}/state-{level}").trigger(availableNow=True)
            out.start(f"{home}/told-{level}").awaitTermination()
            rows = spark.readStream.schema(told_schema).parquet(f"{home}/told-{level}")
        if batch in latest:
            known = latest[batch] if known is None else max(known, latest[batch])
    disk.delete(path(f"{home}/feed"), True)
    schema = spark.createDataFrame([], CHANGES).schema
    return spark.read.schema(schema).parquet(f"{home}/told-{len(levels) - 1}").withColumn("batch", batch_of(F.col("arrival_day"), batches))


def op12_leaderboard(spark, sf_dir: str) -> DataFrame:
    return feed(spark, *(table(spark, sf_dir, t) for t in ("sale_lines", "vendors", "items")))


ORACLE = f"""
WITH keyed AS (
    SELECT *, {CRC32.format("concat(sale_id, ',', item_id, ',', vendor_id, ',', line_no)")} AS h FROM sale_lines),
dated AS (SELECT *, coalesce(date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)), {FIRST_DAY} + h % 150) AS s FROM keyed),
arrived AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM dated),
cut AS (SELECT *, greatest(1, least(10, 1 + CAST(floor((a - {FIRST_DAY}) * 10 / {SPAN}) AS BIGINT))) AS batch FROM arrived),
latest AS (SELECT batch, max(max(s)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM cut GROUP BY batch),
counted AS (
    SELECT v.nation_id, c.item_id, c.a, CASE WHEN c.flag = 'swapped' THEN -1 ELSE 1 END *
        coalesce(floor(100 * c.amount + 0.5), c.quantity * floor(100 * i.price + 0.5), 0) AS cents
    FROM cut c JOIN latest l USING (batch)
    JOIN (SELECT vendor_id, min(nation_id) AS nation_id FROM vendors GROUP BY vendor_id) v ON v.vendor_id = c.vendor_id
    JOIN (SELECT item_id, max(price) AS price FROM items GROUP BY item_id) i ON i.item_id = c.item_id
    WHERE v.nation_id IS NOT NULL AND (l.known IS NULL OR c.s + {GRACE} >= l.known)),
sums AS (SELECT nation_id, item_id, a, CAST(sum(cents) AS BIGINT) AS cents FROM counted GROUP BY ALL),
days AS (SELECT nation_id, a, row_number() OVER (PARTITION BY nation_id ORDER BY a) AS k FROM (SELECT DISTINCT nation_id, a FROM sums)),
known_items AS (SELECT nation_id, item_id, min(a) AS born FROM sums GROUP BY ALL),
running AS (
    SELECT d.nation_id, d.a, d.k, i.item_id, sum(coalesce(s.cents, 0)) OVER (PARTITION BY d.nation_id, i.item_id ORDER BY d.a) AS revenue
    FROM days d JOIN known_items i ON i.nation_id = d.nation_id AND i.born <= d.a
    LEFT JOIN sums s ON s.nation_id = d.nation_id AND s.item_id = i.item_id AND s.a = d.a),
places AS (
    SELECT *, CASE WHEN revenue > 0 THEN row_number() OVER (PARTITION BY nation_id, a ORDER BY revenue DESC, item_id) END AS place FROM running),
boards AS (SELECT nation_id, a, k, item_id, revenue, CASE WHEN place <= {PLACES} THEN place END AS place FROM places),
pairs AS (
    SELECT *, lag(place) OVER (PARTITION BY nation_id, item_id ORDER BY k) AS old FROM boards)
SELECT CAST(nation_id AS INTEGER) AS nation_id, CAST(a AS BIGINT) AS arrival_day, item_id,
    CAST(greatest(1, least(10, 1 + floor((a - {FIRST_DAY}) * 10 / {SPAN}))) AS INTEGER) AS batch,
    CASE WHEN old IS NULL THEN 'enter' WHEN place IS NULL THEN 'exit' ELSE 'move' END AS change,
    CAST(old AS INTEGER) AS old_rank, CAST(place AS INTEGER) AS new_rank, CAST(revenue AS BIGINT) AS revenue
FROM pairs WHERE place IS DISTINCT FROM old
"""
