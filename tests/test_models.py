"""The fold, the exact arithmetic and the stake search against independent models; streams against batches."""

import json
import random
import time
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pricewright.functions import udfs
from pricewright.operators import arbitrage, books, bucket_store, codec, feeds, health, migrations, replay, selection, stakes, state, store
from pricewright.plans import feed_queries
from pricewright.projection import Frames
from pricewright.streaming import live, live_store

SF = "/root/testdata/sf0.001"
DAY = 86_400_000_000


class Store:
    """The rules of the live store, as plainly as they can be put."""

    def __init__(self, tolerance):
        self.tolerance, self.held = tolerance, {}

    def put(self, key, q, observed):
        cents, status, effective, ingested = q
        if ingested > observed:
            return "future_ingestion"
        if effective > observed + self.tolerance:
            return "clock_skew_exceeded"
        old = self.held.get(key)
        if old:
            if effective < old[2] - self.tolerance:
                return "out_of_order"
            if old[:3] == (cents, status, effective):
                return "duplicate"
            if effective < old[2] and not ingested > old[3]:
                return "out_of_order"
        self.held[key] = q
        return "accepted_skewed" if effective > observed else "accepted"


@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from(["active", "suspended"]), st.integers(0, 30), st.integers(0, 30), st.integers(0, 30)), max_size=40), st.integers(0, 6))
@settings(max_examples=200, deadline=None)
def test_step_is_the_store(rows, tolerance):
    model, now = Store(tolerance), None
    for cents, status, effective, ingested, observed in rows:
        now, outcome = state.step(now, cents, status, effective, ingested, observed, tolerance)
        assert outcome == model.put("k", (cents, status, effective, ingested), observed)
        assert (now[1:] if now else None) == model.held.get("k")


def observations(spark):
    return Frames(spark, SF).stream


def test_fold_is_the_store(spark):
    model = Store(2 * DAY)
    rows = live.as_events(observations(spark)).orderBy("observed_us", "effective_us", "ingested_us", "quote_id").collect()
    expected = {}
    for r in rows:
        key = (r.provider_id, r.market_id, r.selection_id, r.transport_id)
        expected[r.quote_id] = model.put(key, (r.cents, r.status, r.effective_us, r.ingested_us), r.observed_us)
    got = {r.quote_id: r.outcome for r in state.fold(observations(spark), 2 * DAY).collect()}
    assert got == expected
    assert len(set(got.values())) > 1
    shuffled = state.fold(observations(spark).repartition(7, "cents"), 2 * DAY)
    assert {r.quote_id: r.outcome for r in shuffled.collect()} == expected


def test_stream_is_the_batch(spark, tmp_path):
    rows = live.as_events(observations(spark))
    # three files in order of observation are three micro-batches
    cuts = rows.approxQuantile("observed_us", [0.33, 0.66], 0.0)
    for k, part in enumerate([rows.where(F.col("observed_us") <= cuts[0]), rows.where((F.col("observed_us") > cuts[0]) & (F.col("observed_us") <= cuts[1])), rows.where(F.col("observed_us") > cuts[1])]):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        live.folded_stream(stream, 2 * DAY).writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    batch = {(r.quote_id, r.outcome, r.revision) for r in state.fold(observations(spark), 2 * DAY).collect()}
    assert {(r.quote_id, r.outcome, r.revision) for r in spark.table("folded").collect()} == batch


def test_live_store_is_the_batch_fold(spark, tmp_path):
    """In four starts on one checkpoint the stream tells what the batch operators tell of lives and suppressions."""
    events = live.as_events(observations(spark))
    home, window = f"file://{tmp_path}/store", 10 * DAY
    told = spark.read.parquet(live_store.in_starts(events, "observed_us", 4, home, lambda came: live_store.live(came, 2 * DAY, window)))
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    columns = [*state.KEY, "quote_id", "outcome", "revision", "life", "evicted_us"]
    assert rows(told.where("kind = 'observation'").select(*columns)) == rows(state.lives(events, 2 * DAY, window).select(*columns))
    last = live_store.held(spark, home, "version")
    still = last.where("off_us IS NOT NULL").select(*state.KEY, "off_us", (F.col("last_off_us") + window).alias("until_us"))
    closed = told.where("kind = 'suppressed'").select(*state.KEY, "from_us", "until_us")
    assert rows(closed.unionByName(still.withColumnRenamed("off_us", "from_us"))) == rows(state.suppressed(events.select(*state.KEY, "quote_id", "observed_us", "status"), window))
    # timers have evicted what nothing followed: no version that is alive is older than its window at the watermark
    ends = told.agg(F.max("observed_us")).scalar()
    assert last.where(F.col("alive") & (F.col("effective_us") + window < ends - DAY)).isEmpty() and not told.where("kind = 'evicted' AND observed_us IS NULL").isEmpty()


def test_a_book_in_three_files(spark, tmp_path):
    """The quotes of a book that come one by one make one opportunity; a conflict of one moment closes it, a newer price opens it again."""
    quotes = [(1, p, p, p * 10, 400) for p in range(3)] + [(1, 1, 1, 40, 390), (1, 1, 1, 41, 395), (2, 0, 0, 1, 400), (1, 1, 1, 42, 396), (1, 1, 1, 42, 397), (1, 1, 1, 43, 398)]
    df = spark.createDataFrame(quotes, "market_id bigint, provider_id bigint, selection_id bigint, at_us bigint, cents bigint")
    told = live_store.in_starts(df, "at_us", 44, f"file://{tmp_path}/books", lambda came: live_store.open_books(came, 3))
    got = [r.cents for r in spark.read.parquet(told).where("market_id = 1").orderBy("turn").collect()]
    assert got == [[], [], [400, 400, 400], [400, 390, 400], [400, 395, 400], [], [400, 398, 400]]


@pytest.mark.parametrize("shards", [1, 5])
def test_a_shard_of_the_live_store_holds_many_keys(spark, tmp_path, shards):
    """The state store is called once a shard and batch, not once a key: it has a row a shard, and tells what the batch fold tells."""
    window = 3 * DAY
    rows = [(p, m, 0 if m else None, 0, f"q{k:03}", 100 + k % 2, "suspended" if k % 5 == 4 else "active", (k + 9) * DAY // 3, (k + 9 - 7 * (k % 11 == 10)) * DAY // 3, (k + 9) * DAY // 3) for k in range(90) for p, m in [(k % 7, k % 3)] if p != 2 or not 20 < k < 70]
    df = spark.createDataFrame(rows, "provider_id bigint, market_id bigint, selection_id bigint, transport_id bigint, quote_id string, cents bigint, status string, observed_us bigint, effective_us bigint, ingested_us bigint")
    home = f"file://{tmp_path}/store"
    told = spark.read.parquet(live_store.in_starts(df, "observed_us", 5, home, lambda came: live_store.live(came, 2 * DAY, window, shards=shards)))
    columns = [*state.KEY, "quote_id", "outcome", "revision", "life", "evicted_us"]
    rows = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert rows(told.where("kind = 'observation'").select(*columns)) == rows(state.lives(df, 2 * DAY, window).select(*columns))
    stored = spark.read.format("statestore").option("path", f"{home}/state").option("stateVarName", "version")
    own = spark.conf.get(live_store.PROVIDER, None)
    spark.conf.set(live_store.PROVIDER, live_store.ROCKS)
    try:
        assert stored.load().count() <= shards
    finally:
        spark.conf.unset(live_store.PROVIDER) if own is None else spark.conf.set(live_store.PROVIDER, own)
    assert live_store.held(spark, home, "version").count() == df.select(*state.KEY).distinct().count() > 5


def test_books_of_a_shard(spark, tmp_path):
    """Many markets in few shards, over several starts: each batch tells the markets that it touches, as a fold of all quotes up to it would."""
    quotes = [(k * 7 % 13, k % 3, k * 5 % 3, k // 20 * 10 + k % 4, 300 + k * 11 % 90) for k in range(160)]
    df = spark.createDataFrame(quotes, "market_id bigint, provider_id bigint, selection_id bigint, at_us bigint, cents bigint")
    home = f"file://{tmp_path}/books"
    told = live_store.in_starts(df, "at_us", 4, home, lambda came: live_store.open_books(came, 3, 2))
    got = {(r.market_id, r.turn): r.cents for r in spark.read.parquet(told).collect()}
    low, high = min(q[3] for q in quotes), max(q[3] for q in quotes)
    slots, turns, expected = {}, {}, {}
    for start in range(4):
        came = [q for q in quotes if (q[3] - low) * 4 // (high - low + 1) == start]
        for m, p, s, at, cents in came:
            slots.setdefault((m, s, p), {}).setdefault(at, set()).add(cents)
        for m in {q[0] for q in came}:
            turns[m] = turns.get(m, 0) + 1
            best = {}
            for (own, s, _), by in slots.items():
                if own == m and len(last := by[max(by)]) == 1:
                    best[s] = max(best.get(s, 0), *last)
            expected[m, turns[m]] = [best[s] for s in sorted(best)] if len(best) == 3 else []
    assert got == expected and any(expected.values())
    assert live_store.held(spark, home, "slots").count() == len(slots)


def test_micro_batch_scan(spark):
    found = []
    cycle = live.scan_cycle(3, lambda df, epoch: found.append((epoch, df.count())))
    cycle(Frames(spark, SF).quotes, 5)
    assert found[0][0] == 5 and found[0][1] > 0


def test_scripted_stream(spark, tmp_path):
    from pricewright.sources.feed_source import scripted

    script = {"a": [{"events": {"e": {"x": 1}}}, {"error": "timeout"}, {"events": {"e": {"x": 2}}}], "b": [{"events": {"e": {"x": 3}}}]}
    query = scripted(spark, script, stream=True).writeStream.format("memory").queryName("scripted").option("checkpointLocation", str(tmp_path)).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.provider_id, r.poll, r.error) for r in spark.table("scripted").collect()}
    assert got == {("a", 0, None), ("a", 1, "timeout"), ("a", 2, None), ("b", 0, None)}


def test_prices():
    assert udfs.decimal60("-150", "american").startswith("1.6666666666") and len(udfs.decimal60("-150", "american")) == 61
    assert udfs.decimal60("40", "implied_probability") is None and udfs.decimal60("5/2", "fractional") == "3.5"
    assert [udfs.decimal60(x, "fractional") for x in ("5", "1/0", "-1/2", "a/b")] == [None] * 4
    # a fair pair with a price that has no finite decimals is no arbitrage
    assert udfs.exact_book_of([udfs.decimal60("-150", "american"), "2.50"])[2] is False
    assert udfs.exact_book_of(["3.00"] * 3)[2] is False and udfs.exact_book_of(["2.01", "2.01"])[2] is True
    assert udfs.alias_key_of(" Straße  ﬁ X ") == "strasse fi x" and udfs.alias_key_of("a\x00") is None


@pytest.mark.parametrize("seed", range(3))
def test_exact_test_by_fractions(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.choice([200, 201, 300, 333, 400, 505, 999]) for _ in range(rng.randint(2, 6))]) for i in range(300)]
    rows += [(1000, [300] * 3), (1001, [500] * 5), (1002, [99999999] * 6), (1003, [2000] * 15), (1004, [3000] * 30), (1005, [2999] + [3000] * 29), (1006, [3001] + [3000] * 29)]
    rows += [(2000 + k, [rng.randint(2900, 3100) for _ in range(30)]) for k in range(60)]
    df = spark.createDataFrame(rows, "i bigint, cents array<bigint>")
    got = {r.i: r.a for r in df.select("i", arbitrage.is_arbitrage(F.col("cents")).alias("a")).collect()}
    for i, cents in rows:
        expected = sum(Fraction(100, c) for c in cents) < 1
        assert got[i] == expected
    shares = {r.i: r.x for r in df.select("i", arbitrage.room(F.col("cents"), 10_200, 100).alias("x")).collect()}
    for i, cents in rows:
        total = sum(Fraction(102, c) for c in cents)
        assert shares[i] == (total < 1) - (total > 1)


def test_a_field_of_thirty_runners(spark):
    """Beyond 38 digits of a common denominator the book is still found, and the 60-digit margin agrees."""
    books = spark.createDataFrame([(k, [(s, c, f"q{s}") for s, c in enumerate(cents)]) for k, cents in enumerate(([4000] * 30, [3000] * 30, [2999] * 30, [3000] * 29 + [3001]))],
                                  "market_id bigint, outcomes array<struct<selection_id: bigint, cents: bigint, quote_id: string>>")
    got = {r.market_id: r for r in arbitrage.opportunities(arbitrage.evaluated(books), exact=True).collect()}
    assert sorted(got) == [0, 3] and abs(float(got[0].margin60) - 1 / 3) < 1e-15
    assert Decimal(got[3].margin60) > 0 and len(got[3].quote_ids) == 30
    at = arbitrage.evaluated(spark.createDataFrame([(0, [(s, 306, "q") for s in range(3)])], books.schema), 0.02)
    assert at.first().is_arbitrage  # a margin of exactly 0.02


def best_by_force(odds, bankroll):
    """The greatest guaranteed profit over all payouts in whole cents."""
    best = None
    for target in range(1, bankroll * 4):
        s = [-(-target * 100 // o) for o in odds]
        if sum(s) <= bankroll and min(x * o // 100 for x, o in zip(s, odds)) > sum(s):
            best = target
    return best


def test_stakes():
    rng = random.Random(4)
    plans = 0
    for _ in range(60):
        odds = [rng.randint(201, 520) for _ in range(rng.randint(2, 3))]
        bankroll = rng.randint(5, 150)
        got = stakes.search(odds, [1] * len(odds), [None] * len(odds), [1] * len(odds), bankroll)
        if got is None:
            assert sum(Fraction(100, o) for o in odds) >= 1 or best_by_force(odds, bankroll) is None or bankroll < 60
            continue
        plans += 1
        s, paid, profit = got
        assert sum(s) <= bankroll and profit == min(paid) - sum(s) > 0 and all(p <= x * o / 100 for p, x, o in zip(paid, s, odds))
    assert plans > 10
    assert stakes.search([201, 201], [1, 1], [None, None], [1, 1], 100) is None
    assert stakes.search([150, 350], [1, 1], [None, None], [1, 1], 25) is not None
    assert stakes.search([300, 300], [50, 1], [None, 10], [1, 1], 100) is None
    assert stakes.continuous_target([200, 400], [1, 1], [None, None], 75) == 100


def plans_by_force(odds, low, high, step, bankroll):
    """All payouts at or below the continuous one, greatest first: the first whose least stakes are safe."""
    top = stakes.continuous_target(odds, low, high, bankroll)
    for t in range(int(top) if top is not None else 0, 0, -1):
        s = [max(lo, -(-(-(-t * 100 // o)) // d) * d) for o, lo, d in zip(odds, low, step)]
        paid = [x * o // 100 for x, o in zip(s, odds)]
        if sum(s) <= bankroll and min(paid) > sum(s) and all(h is None or x <= h for x, h in zip(s, high)):
            return s, paid, min(paid) - sum(s)
    return None


def spent(odds, low, payout):
    return sum(max(Fraction(lo), payout * 100 / o) for o, lo in zip(odds, low))


@pytest.mark.parametrize("seed", range(3))
def test_stake_limits(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], []
    for i in range(120):
        m = rng.randint(2, 4)
        odds, step = [rng.randint(180 + 60 * m, 260 + 120 * m) for _ in range(m)], [rng.choice([1, 1, 5, 10]) for _ in range(m)]
        low = [d * rng.randint(1, 6) for d in step]
        high = [rng.choice([None, None, lo + d * rng.randint(0, 40)]) for lo, d in zip(low, step)]
        bankroll = rng.randint(10, 400)
        t = stakes.continuous_target(odds, low, high, bankroll)
        if t is None:
            assert sum(low) > bankroll
        else:
            caps = [Fraction(h * o, 100) for h, o in zip(high, odds) if h is not None]
            assert t in caps and spent(odds, low, t) <= bankroll or spent(odds, low, t) == bankroll and all(t <= c for c in caps)
        rows.append((i, odds, low, high, step, bankroll))
        expected.append(plans_by_force(odds, low, high, step, bankroll))
    df = spark.createDataFrame(rows, "i int, odds array<bigint>, low array<bigint>, high array<bigint>, step array<bigint>, bankroll bigint")
    plan = stakes.allocate(*[F.col(c) for c in ("odds", "bankroll", "low", "high", "step")])
    limit = F.transform("high", lambda h: F.coalesce(h, F.lit(stakes.UNLIMITED)))
    got = {r.i: r for r in df.select("i", plan.alias("p"), stakes.target(F.col("odds"), F.col("bankroll"), F.col("low"), limit).alias("t")).collect()}
    for (i, odds, low, high, _, bankroll), e in zip(rows, expected):
        p = got[i].p
        assert (None if p.profit is None else (list(p.stakes), list(p.payouts), p.profit)) == e
        t = stakes.continuous_target(odds, low, high, bankroll)
        assert got[i].t is None if t is None else abs(got[i].t - float(t)) < 1e-9 * float(t)
    assert sum(e is not None for e in expected) > 10


def test_order_does_not_matter(spark):
    quotes = Frames(spark, SF).quotes
    rows = lambda df: sorted(map(str, df.collect()))
    a, b = (rows(books.best_prices(q)) for q in (quotes, quotes.orderBy(F.desc("quote_id")).repartition(13)))
    assert a == b
    a, b = (rows(books.consolidate(q)) for q in (quotes, quotes.repartition(13, "cents")))
    assert a == b


def test_interval_ends(spark):
    grid = spark.createDataFrame([(t,) for t in (0, 10, 20, 30, 40)], "t bigint")
    signals = spark.createDataFrame([(1, 0), (1, 10), (1, 30), (2, 40), (3, 20)], "market_id bigint, t bigint")
    got = sorted(tuple(r) for r in replay.intervals(signals, grid).collect())
    assert got == [(1, 0, 20, False, 2), (1, 30, 40, False, 1), (2, 40, 40, True, 1), (3, 20, 30, False, 1)]


def test_store_rejects_a_clash(spark):
    old = spark.createDataFrame([("a", "1")], "id string, payload string")
    assert store.upsert(old, spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], "id string, payload string")).count() == 2
    with pytest.raises(Exception, match="another payload"):
        store.upsert(old, spark.createDataFrame([("a", "2"), ("c", "3")], "id string, payload string")).collect()


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_persist(spark, tmp_path, adaptive):
    path = str(tmp_path / "store")
    rows = lambda *x: spark.createDataFrame(list(x), "id string, payload string")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        store.persist(rows(("a", "1"), ("b", "2")), path)
        store.persist(rows(("a", "1"), ("c", "3")), path)
        with pytest.raises(Exception, match="another payload"):
            store.persist(rows(("d", "4"), ("b", "x")), path)
        with pytest.raises(Exception, match="another payload"):
            store.persist(rows(("b", "x")), path)  # a clash alone fails too
        with pytest.raises(Exception, match="another payload"):
            store.persist(rows(("e", "1"), ("e", "2")), path)  # and one inside the batch
        store.persist(rows(("a", "1")), path)  # nothing new
        assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("a", "1"), ("b", "2"), ("c", "3")]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_opportunities_are_stored_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "opportunities")
    make = lambda *x: spark.createDataFrame(list(x), "opportunity_id string, plan string, quote_ids array<string>, payload string")
    one, two = ("o1", "p", ["a", "b", "c"], "x"), ("o2", "p", ["d", "e"], "y")
    store.persist_opportunities(make(one), path)
    store.persist_opportunities(make(one, two), path)  # delivered again
    with pytest.raises(Exception, match="another payload"):
        store.persist_opportunities(make(("o3", "p", ["f"], "z"), ("o1", "p", ["a", "b", "X"], "x")), path)
    got = store.stored_opportunities(spark.read.parquet(path)).collect()
    assert sorted(map(tuple, got)) == [("o1", 3, True), ("o2", 2, True)] and spark.read.parquet(path).count() == 9


def test_poll_loop_and_progress(spark, tmp_path):
    log, seen = live.ProgressLog(), []
    spark.streams.addListener(log)
    try:
        source = str(tmp_path / "in")
        spark.range(30).write.parquet(source)
        stream = spark.readStream.schema("id bigint").parquet(source)
        query = live.poll_loop(stream, lambda batch, epoch: seen.append(batch.count()), 0.2, str(tmp_path / "a"))
        query.processAllAvailable()
        query.stop()
        live.drained(stream, lambda batch, epoch: seen.append(batch.count()), str(tmp_path / "b"))
        for _ in range(100):  # listeners hear of progress a little later
            if log.ended < 2:
                time.sleep(0.1)
    finally:
        spark.streams.removeListener(log)
    assert sum(seen) == 60 and sum(n for _, _, n in log.cycles) == 60


def test_lives_after_eviction(spark):
    key = (1, 2, 0, 1)
    events = [(0, 0), (20, 20), (60, 5), (61, 61), (62, 61), (200, 150), (201, 201)]  # (seen at, source)
    rows = [(*key, f"q{i}", 100 + i, "active", at, src, at) for i, (at, src) in enumerate(events)]
    df = spark.createDataFrame(rows, "provider_id bigint, market_id bigint, selection_id bigint, transport_id bigint, quote_id string, cents bigint, status string, observed_us bigint, effective_us bigint, ingested_us bigint")
    got = [(r.outcome, r.revision, r.life, r.evicted_us) for r in state.lives(df, 5, 30).orderBy("observed_us").collect()]
    assert got == [
        ("accepted", 1, 1, 30), ("accepted", 2, 1, 50), ("late_for_evicted", None, 2, None), ("accepted", 1, 2, 91), ("accepted", 2, 2, 91),
        ("late_for_evicted", None, 3, None), ("accepted", 1, 3, 231),
    ]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_poll_health_in_ranges(spark, width):
    rng = random.Random(width)
    polls = [(i, i % 3, rng.randint(0, 90), rng.randint(0, 2), rng.randint(0, 2) // 2 * rng.randint(0, 1), rng.random() < 0.2) for i in range(200)]
    got = {r.poll_id: r for r in health.poll_health(spark.createDataFrame(polls, "poll_id bigint, provider_id bigint, at bigint, snapshots bigint, issues bigint, throttled boolean"), width).collect()}
    for provider in range(3):
        failures, last = 0, None
        for i, _, at, snapshots, issues, throttled in sorted((p for p in polls if p[1] == provider), key=lambda p: (p[2], p[0])):
            if not throttled:
                failures = failures + 1 if issues else 0
            gap = at - last if snapshots and not throttled and last is not None else None
            last = at if snapshots and not throttled else last
            assert (got[i].failures, got[i].gap) == (failures, gap)


def test_feed_shapes_one_by_one(spark):
    """Each rule of each shape, as its own payload."""
    import json

    def payload(key, outcomes, sport="soccer_x", home="A", bookmaker="bm", **market):
        o = [{"name": n, "price": p, **({"point": x} if x is not None else {})} for n, p, x in outcomes]
        return json.dumps({"id": "e", "sport_key": sport, "home_team": home, "away_team": "B", "bookmakers": [{"key": bookmaker, "title": "T", "markets": [{"key": key, "outcomes": o, **market}]}]})

    two = lambda a, b, x=None, y=None: [(a, 2.0, x), (b, 2.1, y)]
    cases = [
        (payload("spreads", two("A", "B", 1.5, 1.5)), "unopposed_points"), (payload("spreads", two("B", "A", 1.5, -1.5)), None), (payload("totals", [("Over", 2.0, 2.5)]), "outcome_count"),
        (payload("btts", two("Yes", "Maybe")), "unexpected_outcome"), (payload("btts", two("no", "YES")), None), (payload("draw_no_bet", two("A", "C")), "unexpected_outcome"), (payload("draw_no_bet", two("A", "B")), None),
        (payload("h2h_s1", two("A", "C"), sport="tennis_x"), "unexpected_outcome"), (payload("h2h_s2", two("A", "B")), "wrong_sport"), (payload("h2h", []), "empty_outcomes"), (payload("h2h", two("A", "B", 1)), "unexpected_point"),
        (payload("totals", two("Over", "Under", 2.5, 3.5)), "unequal_points"), (payload("totals", two("Over", "Over", 2.5, 2.5)), "unexpected_outcome"), (payload("alternate", two("x", "y", 1)), "unsupported_pointed_market"),
        (payload("alternate", two("x", "y")), None), (payload("h2h", [("A", None, None)]), "malformed_outcome"), (payload("h2h", two("A", "B"), home="B"), "same_participants"), ("{", "malformed_payload"),
    ]
    for text, issue in cases:
        got = feeds.array_feed(spark.createDataFrame([(text,)], "payload string")).collect()
        assert got and {r.issue for r in got} == {issue}, text
    spread = feeds.array_feed(spark.createDataFrame([(cases[1][0],)], "payload string")).collect()
    assert {(r.name, float(r.line), float(r.handicap), r.provider_id, r.market_id, r.label) for r in spread} == {("B", -1.5, 1.5, "bookmaker:array:bm", "bm:spreads", "T spreads"), ("A", -1.5, -1.5, "bookmaker:array:bm", "bm:spreads", "T spreads")}
    basket = spark.createDataFrame([(payload("totals", two("Over", "Under", 160.5, 160.5), sport="basketball_x", sid="m7"),)], "payload string")
    assert feeds.array_feed(basket).collect() == [] and {r.market_id for r in feeds.array_feed(basket, full_event_bookmakers=("bm",)).collect()} == {"bm:m7"}


def test_sql_functions(spark):
    udfs.register(spark)
    r = spark.sql("SELECT alias_key(' Straße ') AS a, odds_to_decimal60('5/2', 'fractional') AS o, exact_book(array('2.01', '2.01')).is_arbitrage AS x").first()
    assert tuple(r) == ("strasse", "3.5", True)


def test_pages(spark):
    df = spark.range(10).withColumnRenamed("id", "event_id").withColumn("competition_id", F.lit(1))
    got = store.dispatch("/events", {"limit": "3", "offset": "8"}, {"/events": df}).collect()
    assert [r.event_id for r in got] == [8, 9] and not got[0].has_more and got[0].total == 10
    for bad in ({"x": "1"}, {"limit": "500"}):
        with pytest.raises(ValueError):
            store.dispatch("/events", bad, {"/events": df})
    with pytest.raises(LookupError):
        store.dispatch("/nothing", {}, {})


def test_margin_is_exact_decimal():
    implied, margin, _ = udfs.exact_book_of(["3.40", "3.60", "3.50"])
    assert abs(Decimal(implied) - Decimal("0.8576097105508870")) < Decimal("1e-15") and abs(Decimal(margin) - Decimal("0.16603")) < Decimal("1e-5")


def test_poll_cycles_drop_missed_ticks(spark):
    from pricewright.operators.feeds import cycles

    for seconds in ([12], [5], [3, 27, 10, 1], [60]):
        free, k, expected = 0, 0, []
        for tick in range(0, 60, 5):
            expected.append((tick, tick >= free))
            if tick >= free:
                free, k = tick + seconds[min(k, len(seconds) - 1)], k + 1
        data = spark.createDataFrame([(list(range(0, 60, 5)), seconds)], "ticks array<bigint>, seconds array<bigint>")
        assert [tuple(r) for r in data.select(F.inline(cycles(F.col("ticks"), F.col("seconds")))).collect()] == expected


def records(spark, *rows):
    return spark.createDataFrame([(i, p, at) for i, p, at in rows], "id string, payload string, at_us bigint")


def test_bucket_store_races_and_clashes(spark, tmp_path):
    """Of two batches of one version the second is refused where buckets meet and done again; others go on above."""
    path = f"file://{tmp_path}/store"
    one = bucket_store.BucketStore(spark, path, buckets=2)
    assert one.upsert({"quote": records(spark, *((f"a{k}", "x", k) for k in range(20)))}, audit="audit") == 1
    turns = []

    def meanwhile():
        turns.append(1)
        if len(turns) == 1:
            one.upsert({"quote": records(spark, ("b", "1", 5), ("c", "1", 5), ("d", "1", 5), ("e", "1", 5))}, audit="audit")

    two = bucket_store.BucketStore(spark, path, buckets=2, before_commit=meanwhile)
    with pytest.raises(bucket_store.Refused):
        two.try_upsert({"quote": records(spark, ("b", "1", 5), ("f", "2", 6), ("g", "2", 6), ("h", "2", 6))}, audit="audit")
    turns.clear()
    assert two.upsert({"quote": records(spark, ("b", "1", 5), ("f", "2", 6), ("g", "2", 6), ("h", "2", 6))}, audit="audit") >= 3
    ids = sorted(r.id for r in one.read("quote").collect())
    assert ids == sorted([f"a{k}" for k in range(20)] + list("bcdefgh")) and one.read("audit").count() == 27
    assert one.read("quote", version=1).count() == 20  # an older version stays readable
    version = one.version()
    with pytest.raises(Exception, match="another payload"):
        one.upsert({"quote": records(spark, ("i", "1", 1), ("b", "other", 5))}, audit="audit")
    with pytest.raises(Exception, match="another payload"):
        one.upsert({"quote": records(spark, ("j", "1", 1), ("j", "2", 1))})
    assert one.upsert({"quote": records(spark, ("b", "1", 5), ("b", "1", 5))}, audit="audit") == version == one.version()


def test_batches_of_other_buckets_both_commit(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store_ = bucket_store.BucketStore(spark, path, buckets=64)
    mine, other = records(spark, ("m", "1", 1)), records(spark, ("n", "1", 1))
    assert {r.bucket for r in store_._bucket(mine).collect()} != {r.bucket for r in store_._bucket(other).collect()}
    done = []
    late = bucket_store.BucketStore(spark, path, 64, lambda: done or done.append(store_.try_upsert({"quote": other})))
    assert late.try_upsert({"quote": mine}) == 2 and {r.id for r in store_.read("quote").collect()} == {"m", "n"}


def test_purge_rewrites_old_buckets_only(spark, tmp_path):
    store_ = bucket_store.BucketStore(spark, f"file://{tmp_path}/store", buckets=32)
    store_.upsert({"quote": records(spark, *((f"q{k}", "x", 10 if k == 7 else 1000 + k) for k in range(200)), ("none", "x", None))})
    before = store_.manifest()["tables"]["quote"]
    assert store_.purge("quote", 500, records(spark, ("q7", None, None))) == 0
    assert store_.purge("quote", 500, records(spark)) == 1
    after = store_.manifest()["tables"]["quote"]
    assert sum(before[b] != after.get(b) for b in before) == 1 and store_.read("quote").count() == 200
    touched = {b for b in before if before[b] != after.get(b)}
    assert len(store_.read("quote", touched).inputFiles()) < len(store_.read("quote").inputFiles()) / 8  # a plan over a bucket reads that bucket


def test_dealt_rows_are_shuffled_once_and_checked(spark, tmp_path):
    store_ = bucket_store.BucketStore(spark, f"file://{tmp_path}/store", buckets=4, head="#")
    quotes = spark.createDataFrame([(f"q{k % 70}", k) for k in range(100)], "quote_id string, at_us bigint")
    number = F.expr("row_number() OVER (PARTITION BY bucket, part, quote_id ORDER BY at_us)")
    rows = store_.dealt(quotes, F.col("quote_id")).select("bucket", "part", F.concat_ws("#", "quote_id", number).alias("id"), F.lit("x").alias("payload"), "at_us")
    fresh = store_._new("quote", rows, 0)
    assert fresh._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert store_.upsert({"quote": rows}) == 1 and store_.upsert({"quote": rows.drop("bucket", "part")}) == 1 == store_.upsert({"quote": rows})
    by = store_.manifest()["tables"]["quote"]
    at = {r.id: b for b in by for r in store_.read("quote", {b}).collect()}
    assert len(at) == 100 and all(at[f"q{k}#1"] == at[f"q{k}#2"] for k in range(30))
    # q0 and q1 are referenced by their heads, so all their records stay; of the others those from 50 on
    assert store_.purge("quote", 50, records(spark, ("q0", None, None), ("q0", None, None), ("q1", None, None), (None, None, None))) == 48
    left = {r.id: r.at_us for r in store_.read("quote").collect()}
    assert left == {f"q{k % 70}#{k // 70 + 1}": k for k in range(100) if k >= 50 or k % 70 < 2}
    with pytest.raises(Exception, match="dealt to another bucket"):
        store_.upsert({"other": rows.withColumn("part", F.pmod(F.col("part") + 1, F.lit(bucket_store.PARTS)).cast("int"))})
    with pytest.raises(ValueError, match="heads"):
        bucket_store.BucketStore(spark, store_.path, buckets=4).read("quote")


def test_many_small_batches_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bucket_store, "FOLDERS", 2)
    store_ = bucket_store.BucketStore(spark, f"file://{tmp_path}/store", buckets=1)
    for k in range(5):
        store_.upsert({"quote": records(spark, (f"q{k}", "x", k))}, audit="audit")
    assert len(store_.manifest()["tables"]["quote"]["0"]) <= 2 and sorted(r.id for r in store_.read("quote").collect()) == [f"q{k}" for k in range(5)]


def counted(spark, df):
    """df, and a counter of its rows that were computed."""
    seen = spark.sparkContext.accumulator(0)

    def each(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(each, df.schema), seen


def test_purge_deals_only_what_moves(spark, tmp_path, monkeypatch):
    store_ = bucket_store.BucketStore(spark, f"file://{tmp_path}/store", buckets=4)
    store_.upsert({"quote": records(spark, *((f"q{k}", str(k), k) for k in range(200)), ("none", "x", None))})
    inner, seen = bucket_store.BucketStore.dealt, []
    monkeypatch.setattr(bucket_store.BucketStore, "dealt", lambda self, rows, key=None: (seen.append(counted(spark, rows)), inner(self, seen[-1][0], key))[1])
    taken = lambda: sum(n.value for _, n in (seen.pop() for _ in range(len(seen))))
    rows = lambda: {r.id: (r.payload, r.at_us) for r in store_.read("quote").collect()}
    files = lambda b: len(store_.read("quote", {b}).inputFiles())
    # of the young rows none is dealt, of the old ones those that are referenced
    assert store_.purge("quote", 100, records(spark, ("q7", None, None), ("q8", None, None), ("q150", None, None))) == 98 and taken() == 2
    left = {f"q{k}": (str(k), k) for k in (7, 8, *range(100, 200))} | {"none": ("x", None)}
    assert rows() == left and store_.purge("quote", 100, records(spark, ("q7", None, None))) == 1 and taken() == 1
    del left["q8"]
    by = store_.manifest()["tables"]["quote"]
    assert rows() == left and sum(x["rows"] for own in by.values() for x in own.values()) == 102
    # a bucket of two folders is dealt as a whole and becomes one of no more files than parts
    store_.upsert({"quote": records(spark, ("n0", "x", 300))})
    taken()
    (twice,) = (b for b, own in store_.manifest()["tables"]["quote"].items() if len(own) == 2)
    dealt = sum(v[1] is None or v[1] >= 120 for i, v in rows().items() if i in {r.id for r in store_.read("quote", {twice}).collect()})
    assert store_.purge("quote", 120, records(spark)) == 21 and taken() == dealt > 0
    assert rows() == {i: v for i, v in left.items() if v[1] is None or v[1] >= 120} | {"n0": ("x", 300)}
    assert {len(own) for own in store_.manifest()["tables"]["quote"].values()} == {1} and files(twice) <= bucket_store.PARTS


def test_a_first_batch_is_computed_once(spark, tmp_path):
    store_ = bucket_store.BucketStore(spark, f"file://{tmp_path}/store", buckets=4)
    with pytest.raises(Exception, match="another payload"):
        store_.upsert({"quote": records(spark, ("a", "1", 1), ("a", "2", 1))})
    with pytest.raises(Exception, match="another payload"):
        store_.upsert({"quote": records(spark, ("a", None, 1), ("a", "2", 1))})
    batch, seen = counted(spark, records(spark, *((f"q{k}", None if k == 3 else "x", k) for k in range(30)), ("q3", None, 3), (None, "x", 1)))
    assert store_.upsert({"quote": batch}, audit="audit") == 1 and seen.value == 32
    assert store_.upsert({"quote": batch}, audit="audit") == 1 and store_.read("quote").count() == store_.read("audit").count() == 30


@pytest.mark.parametrize("name", ["snk_retention", "snk_retention_count"])
def test_quotes_of_a_purge_are_computed_twice(spark, monkeypatch, name):
    quotes, seen = counted(spark, Frames(spark, SF).quotes)
    monkeypatch.setattr(Frames, "quotes", quotes)
    assert feed_queries.C.queries[name](spark, SF).count()
    assert seen.value == 2 * Frames(spark, SF).table("lineitem").count()  # once to be stored, once for the opportunities


def test_opportunities_are_computed_once(spark, monkeypatch):
    inner, seen = feed_queries.stored_opportunities, []
    monkeypatch.setattr(feed_queries, "stored_opportunities", lambda f: (seen.append(counted(spark, inner(f))), seen[-1][0])[1])
    rows = feed_queries.C.queries["snk_opportunity"](spark, SF).count()
    assert rows and sum(n.value for _, n in seen) == rows


@pytest.mark.parametrize("block", [4096, 3])
def test_sweep_is_the_join(spark, monkeypatch, block):
    """Ranges of unchanged books, instant by instant, against books at each instant; also across the blocks of the grid."""
    monkeypatch.setattr(replay, "BLOCK", block)
    rng = random.Random(4)
    rows = [(rng.randrange(2), rng.randrange(3), rng.randrange(2), rng.randrange(2), str(k), rng.randrange(300) * 1_000_000, rng.choice([250, 300, 350, 400]), rng.choice(["active"] * 5 + ["off"])) for k in range(400)]
    df = spark.createDataFrame(rows, "provider_id bigint, selection_id bigint, transport_id bigint, market_id bigint, quote_id string, observed_us bigint, cents bigint, status string")
    df = df.withColumns({"effective_us": F.col("observed_us") - F.pmod(F.xxhash64("quote_id"), F.lit(5)) * 1_000_000, "revision": F.col("quote_id").cast("bigint")})
    ranges, at = replay.validity(df), replay.grid(df, 0, 7_000_000)
    expected = replay.detections(replay.as_of(ranges, at, 40_000_000), 3).select("t", "market_id", "implied_sum", "is_arbitrage").collect()
    segments = replay.priced(replay.swept(replay.indexed(ranges, at, 40_000_000).where("status = 'active'"), 3))
    got = replay.at_instants(segments, at).select("t", "market_id", "implied_sum", "is_arbitrage").collect()
    key = lambda r: (r.t, r.market_id, round(r.implied_sum, 9), r.is_arbitrage)
    assert sorted(map(key, got)) == sorted(map(key, expected)) and len(got) > 30
    signals = spark.createDataFrame([(r.market_id, r.t) for r in expected if r.is_arbitrage], "market_id bigint, t bigint")
    joined = replay.joined_intervals(segments.where("is_arbitrage"), at)
    rows_of = lambda d: sorted(map(tuple, d.select("market_id", "opened", "ended", "open_at_end", "n").collect()))
    assert rows_of(joined) == rows_of(replay.intervals(signals, at))


def test_nested_codec(spark):
    registry = {"a": {"x": "bigint", "b": "b", "many": ["b"]}, "b": {"s": "string", "d": "decimal(10,2)"}}
    b = lambda s="t", d=1.25, **more: {"schema": 3, "type": "b", "value": {"s": s, "d": d, **more}}
    a = lambda x=1, one=None, many=(): {"schema": 3, "type": "a", "value": {"x": x, "b": b() if one is None else one, "many": list(many)}}
    cases = [
        (json.dumps(a()), None), (json.dumps(a(many=[b(), b(None, None)])), None), (json.dumps(a(x=None)), None), ("", "malformed"), (None, "malformed"), ("null", "malformed"), ("{", "malformed"), ("7", "not_an_entity:$"),
        (json.dumps(b()), "unexpected_type:$"), (json.dumps({**a(), "extra": 1}), "not_an_entity:$"), (json.dumps({**a(), "schema": 4}), "unsupported_schema:$"), (json.dumps({**a(), "type": "c"}), "unknown_type:$"),
        (json.dumps(a(x="1")), "wrong_kind:$.x"), (json.dumps(a(one=b(5))), "wrong_kind:$.b.s"), (json.dumps(a(one=b(more=1))), "unexpected_keys:$.b"), (json.dumps(a(one=3)), "not_an_entity:$.b"),
        (json.dumps(a(many=[b(), b(d="x")])), "wrong_kind:$.many[].d"), (json.dumps({"schema": 3, "type": "a", "value": {"x": 1, "b": b(), "many": 4}}), "wrong_kind:$.many"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i bigint, t string").select("i", codec.decoded(F.col("t"), "a", registry).alias("d"))
    got = {r.i: r.d for r in df.collect()}
    assert [got[i].issue for i in range(len(cases))] == [x for _, x in cases]
    assert got[1].value.many[0].s == "t" and got[1].value.many[0].d == Decimal("1.25") and got[1].value.many[1].d is None and got[8].value is None
    again = df.where("d.issue IS NULL").select(codec.decoded(codec.encoded(F.col("d.value"), "a", registry), "a", registry).alias("e"), "d.value")
    assert all(r.e.issue is None and r.e.value == r.value for r in again.collect())


def test_migrations_are_applied_once(spark, tmp_path):
    root = f"file://{tmp_path}/records"
    spark.createDataFrame([("a", 1, 1)], "id string, provider_id bigint, version int").write.parquet(f"{root}/records")
    steps = migrations.Migrations(spark, root, migrations.STEPS)
    spark.createDataFrame([("b", 1, 7, 2)], "id string, provider_id bigint, transport_provider_id bigint, version int").write.mode("append").parquet(f"{root}/records")
    spark.createDataFrame([("c", 1, 8, 4, "s", 3)], "id string, provider_id bigint, transport_provider_id bigint, set_index int, subject_id string, version int").write.mode("append").parquet(f"{root}/records")
    first = migrations.Migrations(spark, root, {2: migrations.STEPS[2]})
    assert first.run() == [2] and steps.run() == [3] and steps.run() == [] and sorted(steps.applied()) == [2, 3]
    rows = {r.id: (r.provider_id, r.transport_provider_id, r.set_index, r.subject_id, r.version) for r in steps.current().collect()}
    assert rows == {"a": (1, 1, None, None, 3), "b": (1, 7, None, None, 3), "c": (1, 8, 4, "s", 3)}
    with pytest.raises(ValueError, match="applied as"):
        migrations.Migrations(spark, root, {2: ("other", migrations.STEPS[2][1])}).run()
    # a migration that comes second to the same number is refused
    late = migrations.Migrations(spark, f"file://{tmp_path}/race", {1: ("one", lambda df: df)})
    spark.range(3).write.parquet(f"{late.root}/records")
    other = migrations.Migrations(spark, late.root, {1: ("one", lambda df: df)})
    late.ledger.before_commit = lambda: other.applied() or other.run()
    with pytest.raises(bucket_store.Refused):
        late.run()
    assert late.current().count() == 3


def test_telemetry_counts_each_batch_once(spark, tmp_path):
    rows = spark.range(100).withColumn("kind", F.when(F.col("id") % 4 == 0, "bad").otherwise("ok"))
    told = live.Telemetry({"ok": F.col("kind") == "ok", "bad": F.col("kind") == "bad"})
    spark.streams.addListener(told)
    try:
        live_store.in_starts(rows, "id", 3, f"file://{tmp_path}/t", told.observed, lambda q: [told.take(p) for p in q.recentProgress] * 2)
    finally:
        spark.streams.removeListener(told)
    assert told.counters() == {"ok": 75, "bad": 25} and len(told.batches) >= 3


def test_selection_is_the_sorted_list(spark, monkeypatch):
    monkeypatch.setattr(selection, "PARTS", 4)
    rng = random.Random(6)
    rows = [(g, v) for g in range(4) for v in [rng.choice([5, -(2**61), 2**61, rng.randrange(-40, 40), None]) for _ in range([1, 2, 30, 101][g])]]
    df = spark.createDataFrame(rows, "g bigint, v bigint").repartition(3)
    n = F.col("n")
    got = selection.selected(df, ["g"], "v", {"a": F.lit(0), "b": F.floor(n / 2), "c": n - 1, "beyond": n}).collect()
    for r in got:
        own = sorted(v for g, v in rows if g == r.g and v is not None)
        rank = {"a": 0, "b": len(own) // 2, "c": len(own) - 1}[r.name]
        assert r.n == len(own) and r.value == own[rank] and r.before == rank - own.index(own[rank])
    assert len(got) == 3 * len({g for g, v in rows if v is not None})


def test_pages_by_seeking(spark):
    rng = random.Random(7)
    rows = [(rng.choice([None, *range(6)]), rng.randrange(30), k) for k in range(400)]
    df = spark.createDataFrame(rows, "a bigint, b bigint, c int")
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    for offset in (0, 3, 40, 61, 150, 333, 399, 400, 900):
        got = store.page(df, ("a", "b", "c"), offset, 20).collect()
        assert [(r.a, r.b, r.c) for r in got] == order[offset : offset + 20] and all(r.total == 400 and r.has_more == (offset + 20 < 400) for r in got)
    plan = store.page(df.where("a IS NOT NULL"), ("a", "b", "c"), 300, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Filter" in plan
