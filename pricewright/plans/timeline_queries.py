"""Scenario timelines: feed loss and recovery, the synthetic matrix, scripted feeds and micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arbitrage as A
from ..operators import books as B
from ..operators import feeds
from ..operators import state as S
from ..projection import QUOTES, Catalogue, Frames
from ..sources import feed_source as D
from ..streaming import live
from ..streaming import live_store as L

C = Catalogue()
SECOND = 1_000_000
#: Two providers; market 0 has three selections, market 1 two; selection 0 of market 0 is the target leg.
SLOTS = [(p, m, s) for p in (0, 1) for m, n in ((0, 3), (1, 2)) for s in range(n)]


def _cents(market: int, provider: int) -> int:
    return (320 if market == 0 else 210) + provider


def _rows(scenario: str, at: int, transport: int, target: str, source: int | None = None, move: int = 0):
    """Observations of one delivery: target is 'with', 'without' or 'only' the target leg."""
    for p, m, s in SLOTS:
        leg = (m, s) == (0, 0)
        if (leg and target == "without") or (not leg and target == "only"):
            continue
        yield scenario, transport, p, m, s, _cents(m, p) + (move if leg else 0), "active", at, at if source is None else source


SCENARIOS = ("essential", "redundant", "conflict")


def deliveries():
    """Observations of each scenario: feed 0 delivers all along, feed 1 once, and again at 40; a packet of it that left at 0 comes at 32."""
    out = []
    for name, target in (("essential", "without"), ("redundant", "with")):
        for t in (0, 10, 31, 40):
            out += _rows(name, t, 0, target)
        out += _rows(name, 0, 1, "only")
        out += _rows(name, 40, 1, "only")
    out += list(_rows("essential", 32, 1, "only", source=0))[:1]
    out += _rows("conflict", 0, 0, "with")
    out += _rows("conflict", 0, 1, "only")
    out += _rows("conflict", 1, 0, "with")
    out += _rows("conflict", 1, 1, "only", move=5)
    out += _rows("conflict", 2, 0, "with", move=7)
    return out


#: The phases of each scenario, as (scenario, second, phase, whether what has expired was evicted).
PHASES = [
    ("essential", 0, "healthy", 0), ("essential", 10, "silent_but_fresh", 0), ("essential", 31, "expired", 0), ("essential", 31, "evicted", 1),
    ("essential", 32, "late_stale_packet", 1), ("essential", 40, "recovered", 1), ("redundant", 0, "healthy", 0), ("redundant", 10, "silent_but_fresh", 0),
    ("redundant", 31, "expired", 0), ("redundant", 31, "evicted", 1), ("redundant", 40, "recovered", 1), ("conflict", 0, "healthy", 0),
    ("conflict", 1, "equal_time_conflict", 0), ("conflict", 2, "resolved", 0),
]

#: The documented counts of these scenarios.
EXPECTED = """SELECT scenario, at_s::bigint AS at_s, phase, stored::bigint AS stored, fresh::bigint AS fresh, stale::bigint AS stale, opportunities::bigint AS opportunities, conflicts::bigint AS conflicts, overlap_slots::bigint AS overlap_slots FROM (VALUES ('essential', 0, 'healthy', 10, 10, 0, 2, 0, 0), ('essential', 10, 'silent_but_fresh', 10, 10, 0, 2, 0, 0), ('essential', 31, 'expired', 10, 8, 2, 1, 0, 0),
 ('essential', 31, 'evicted', 8, 8, 0, 1, 0, 0), ('essential', 32, 'late_stale_packet', 9, 8, 1, 1, 0, 0), ('essential', 40, 'recovered', 10, 10, 0, 2, 0, 0),
 ('redundant', 0, 'healthy', 12, 10, 0, 2, 0, 2), ('redundant', 10, 'silent_but_fresh', 12, 10, 0, 2, 0, 0), ('redundant', 31, 'expired', 12, 10, 2, 2, 0, 0), ('redundant', 31, 'evicted', 10, 10, 0, 2, 0, 0),
 ('redundant', 40, 'recovered', 12, 10, 0, 2, 0, 2), ('conflict', 0, 'healthy', 12, 10, 0, 2, 0, 2), ('conflict', 1, 'equal_time_conflict', 12, 8, 0, 1, 2, 0), ('conflict', 2, 'resolved', 12, 10, 0, 2, 0, 0))
 t(scenario, at_s, phase, stored, fresh, stale, opportunities, conflicts, overlap_slots)"""


@C.add("bt_feed_recovery", EXPECTED)
def _(f: Frames):
    window = 30 * SECOND
    raw = f.spark.createDataFrame(deliveries(), "scenario string, transport_id bigint, provider_id bigint, market_id bigint, selection_id bigint, cents bigint, status string, at bigint, source bigint")
    phases = f.spark.createDataFrame(PHASES, "scenario string, at_s bigint, phase string, evicted bigint")
    # scenarios are told apart by their markets, so that one fold with eviction runs them all
    lot = F.array_position(F.array(*map(F.lit, SCENARIOS)), F.col("scenario")) * 100
    events = raw.select(
        "provider_id", (F.col("market_id") + lot).alias("market_id"), "selection_id", "transport_id", F.lit("q").alias("quote_id"), "cents", "status",
        (F.col("at") * SECOND).alias("observed_us"), (F.col("source") * SECOND).alias("effective_us"), (F.col("at") * SECOND).alias("ingested_us"),
    )
    folded = S.lives(events, 5 * SECOND, window).where("outcome LIKE 'accepted%' OR outcome = 'late_for_evicted'")
    folded = folded.withColumn("scenario", F.element_at(F.array(*map(F.lit, SCENARIOS)), (F.col("market_id") / 100).cast("int"))).withColumn("market_id", F.col("market_id") % 100)
    seen = folded.join(F.broadcast(phases), "scenario").where(F.col("observed_us") <= F.col("at_s") * SECOND)  # PHASES rows
    key = ["scenario", "phase", "at_s", "evicted", "transport_id", "provider_id", "market_id", "selection_id"]
    now = seen.groupBy(*key).agg(F.max(F.struct("observed_us", "effective_us", "cents", "status", "outcome")).alias("v")).select(*key, (F.col("v.effective_us") / SECOND).cast("bigint").alias("source"), "v.cents", "v.status", "v.outcome")
    now = now.withColumn("is_fresh", (F.col("at_s") - F.col("source")) * SECOND <= window)
    # an eviction takes what has expired; a late packet that came after it stays, as stale
    now = now.where("evicted = 0 OR is_fresh OR outcome = 'late_for_evicted'")
    stored = now.groupBy("scenario", "phase", "at_s").agg(F.count("*").alias("stored"), F.count_if(~F.col("is_fresh")).alias("stale"))
    live = now.where("is_fresh").withColumns({"effective_ts": F.timestamp_seconds("source"), "quote_id": F.concat_ws("-", "transport_id", "provider_id", "market_id", "selection_id")})
    slot = ("scenario", "phase", "at_s", "provider_id", "market_id", "selection_id")
    merged = B.consolidate(live, slot)
    counts = merged.groupBy("scenario", "phase", "at_s").agg(
        F.count_if(~F.col("conflict")).alias("fresh"), F.count_if("conflict").alias("conflicts"), F.count_if((F.col("n") > 1) & ~F.col("conflict")).alias("overlap_slots")
    )
    best = B.best_prices(merged.where("NOT conflict"), ("scenario", "phase", "at_s", "market_id", "selection_id"))
    need = F.when(F.col("market_id") == 0, 3).otherwise(2)
    book = best.groupBy("scenario", "phase", "at_s", "market_id").agg(F.collect_list("cents").alias("cents")).where(F.size("cents") == need)
    arbs = book.where(A.is_arbitrage(F.col("cents"))).groupBy("scenario", "phase", "at_s").agg(F.count("*").alias("opportunities"))
    by = ["scenario", "phase", "at_s"]
    out = stored.join(counts, by).join(arbs, by, "left")
    return out.select("scenario", "at_s", "phase", "stored", "fresh", "stale", F.coalesce("opportunities", F.lit(0)).alias("opportunities"), "conflicts", "overlap_slots")


#: The synthetic matrix: event, feed, prices, age in seconds, status.
MATRIX = [
    ("arb", "alpha", ["2.90", "3.60", "3.00"], 0, "active"), ("arb", "beta", ["3.40", "3.20", "3.50"], 0, "active"),
    ("noarb", "alpha", ["2.10", "3.30", "3.50"], 0, "active"), ("noarb", "beta", ["2.05", "3.25", "3.55"], 0, "active"),
    ("stale", "alpha", ["4.00", "4.00", "4.00"], 600, "active"), ("suspended", "alpha", ["4.20", "4.20", "4.20"], 0, "suspended"),
    ("malformed", "alpha", ["3.20", "not-a-price", "3.20"], 0, "active"),
]


def script() -> dict:
    feeds: dict[str, list[dict]] = {"gamma": [{"error": "timeout"}]}
    for event, feed, prices, age, status in MATRIX:
        polls = feeds.setdefault(feed, [{"events": {}}])
        polls[0]["events"][event] = {"prices": prices, "age": age, "status": status}
    return feeds


def matrix(f: Frames):
    """Scripted feeds through the whole path: parse, gate, best price, book, exact test."""
    polls = D.scripted(f.spark, script())
    p = polls.where("error IS NULL").select("provider_id", "event_id", F.from_json("payload", "prices array<string>, age bigint, status string").alias("p"))
    q = p.select("provider_id", "event_id", "p.age", "p.status", F.posexplode("p.prices").alias("selection_id", "price"))
    odds = F.col("price").try_cast("decimal(10,2)")
    issue = B.first_issue(("malformed_price", odds.isNull()), ("inactive_quote", F.col("status") != "active"), ("stale_quote", F.col("age") > 120))
    return q.withColumn("cents", (odds * 100).cast("bigint")).withColumn("issue", issue)


@C.add("src_synthetic_matrix", "SELECT 'arb' AS event_id, 340::bigint AS a, 360::bigint AS b, 350::bigint AS c, round(1 / 3.4 + 1 / 3.6 + 1 / 3.5, 9)::double AS implied_sum")
def _(f):
    best = matrix(f).where("issue IS NULL").groupBy("event_id", "selection_id").agg(F.max("cents").alias("cents"))
    book = best.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("selection_id", "cents"))).alias("o")).where(F.size("o") == 3)
    cents = F.transform("o", lambda x: x["cents"])
    won = book.withColumn("cents", cents).where(A.is_arbitrage(F.col("cents")))
    return won.select("event_id", *[F.get("cents", F.lit(k)).alias(n) for k, n in enumerate("abc")], F.round(A.reciprocal_sum(F.col("cents")), 9).alias("implied_sum"))


@C.add("src_fake", "SELECT provider_id, snapshots::bigint AS snapshots, failures::bigint AS failures FROM (VALUES ('alpha', 5, 0), ('beta', 2, 0), ('gamma', 0, 1)) t(provider_id, snapshots, failures)")
def _(f):
    polls = D.scripted(f.spark, script())
    return polls.groupBy("provider_id").agg(F.count("event_id").alias("snapshots"), F.count("error").alias("failures"))


@C.add("src_fetch_odds", "SELECT * FROM (VALUES ('beta', 'arb', NULL), ('beta', 'noarb', 'snapshot_ownership_mismatch')) t(provider_id, event_id, issue)")
def _(f):
    asked = f.spark.createDataFrame([("beta", "arb")], "provider_id string, event_id string")
    return D.owned(D.scripted(f.spark, script()).where("provider_id = 'beta' AND event_id IS NOT NULL").select("provider_id", "event_id"), asked)


@C.add("src_request", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'malformed_payload' END AS issue FROM events")
def _(f):
    i = F.col("event_id")
    text = F.when(i % 9 == 0, F.lit("{not json")).otherwise(F.to_json(F.struct(i.alias("id"))))
    got = f.table("events").select("event_id", F.from_json(text, "id bigint, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return got.select("event_id", F.when(F.col("r._corrupt").isNotNull(), "malformed_payload").alias("issue"))


@C.add("src_request_args", "SELECT 'ok' AS request, NULL::varchar AS issue UNION ALL SELECT 'blank', 'invalid_provider' UNION ALL SELECT 'range', 'invalid_time_range'")
def _(f):
    rows = [("ok", D.request_issue("p", 1, 2)), ("blank", D.request_issue(" ")), ("range", D.request_issue("p", 2, 2))]
    return f.spark.createDataFrame(rows, "request string, issue string")


@C.add("src_catalog_cache", """WITH RECURSIVE e AS (SELECT user_id % 20 AS key, event_id AS request, epoch_us(ts) AS tm FROM events),
  l AS (SELECT key, min(tm) AS tm FROM e GROUP BY 1 UNION ALL SELECT n.key, n.tm FROM (SELECT l.key, min(e.tm) AS tm FROM l JOIN e ON e.key = l.key AND e.tm >= l.tm + 86400000000 GROUP BY l.key, l.tm) n),
  f AS (SELECT key, tm, min(request) AS request FROM e GROUP BY 1, 2)
  SELECT e.request, l.tm IS NOT NULL AND f.request = e.request AS loaded FROM e LEFT JOIN l ON l.key = e.key AND l.tm = e.tm LEFT JOIN f ON f.key = e.key AND f.tm = e.tm""")
def _(f):
    # each key reads its catalogue anew after a day; of requests at one moment the least numbered one does
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    requests = f.table("events").select((F.col("user_id") % 20).alias("key"), at.alias("at"), F.col("event_id").alias("request"))
    return feeds.cached(requests, 86_400_000_000).select("request", "loaded")


@C.add("src_http", """WITH p AS (SELECT event_id % 4 AS provider_id, event_id % 9 = 0 AS broken, 101 + cast(round(value * 100) AS bigint) % 350 AS cents FROM events)
  SELECT provider_id, count_if(NOT broken)::bigint AS good, count_if(broken)::bigint AS malformed, coalesce(sum(CASE WHEN NOT broken THEN cents END), 0)::bigint AS cents FROM p GROUP BY 1""")
def _(f):
    # what a fetcher, which is outside the engine, would land: a folder of JSON lines a provider, some of them cut off; prices are read as exact decimals
    folder, i = D.landing(f.spark, "poll"), F.col("event_id")
    cents = F.lit(101) + F.round(F.col("value") * 100).cast("bigint") % 350
    whole = F.concat(F.lit('{"id": '), i, F.lit(', "price": '), (cents / 100).cast("decimal(10,2)"), F.lit("}"))
    lines = f.table("events").select((i % 4).alias("provider_id"), F.when(i % 9 == 0, F.substring(whole, 1, 8)).otherwise(whole).alias("value"))
    lines.write.partitionBy("provider_id").text(folder)
    got = D.landed(f.spark, folder, "id bigint, price decimal(18,6)").withColumn("provider_id", F.col("provider_id").cast("bigint"))
    sums = got.groupBy("provider_id").agg(F.count_if(F.col("id").isNotNull()).alias("good"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("malformed"), F.sum(F.col("price") * 100).alias("cents"))
    return sums.select("provider_id", "good", "malformed", F.coalesce(F.col("cents").cast("bigint"), F.lit(0)).alias("cents"))


@C.add("stm_poll_once", "SELECT * FROM (VALUES ('alpha', 'arb'), ('alpha', 'malformed'), ('alpha', 'noarb'), ('alpha', 'stale'), ('alpha', 'suspended'), ('beta', 'arb'), ('beta', 'noarb')) t(provider_id, event_id)")
def _(f):
    return D.scripted(f.spark, script()).where("event_id IS NOT NULL").select("provider_id", "event_id").orderBy("provider_id", "event_id")


@C.add("stm_poll_loop", "SELECT unnest(range(0, 60, 5))::bigint AS tick, unnest(range(0, 60, 5)) % 15 = 0 AS ran")
def _(f):
    # cycles of 12 seconds on ticks of 5: a tick that falls into a running cycle is dropped, never queued
    ticks = F.sequence(*(F.lit(x).cast("bigint") for x in (0, 55, 5)))
    return f.spark.range(1).select(F.inline(feeds.cycles(ticks, F.array(F.lit(12).cast("bigint")))))


@C.add("stm_telemetry", """WITH p AS (SELECT event_id % 4 AS provider_id, CASE event_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 429 WHEN 2 THEN 503 WHEN 3 THEN 401 ELSE 404 END AS code FROM events)
  SELECT provider_id, CASE code WHEN 429 THEN 'rate_limited' WHEN 503 THEN 'upstream' WHEN 401 THEN 'authentication' WHEN 404 THEN 'invalid_request' ELSE 'ok' END AS kind, code IN (429, 503) AS retryable, count(*) AS n FROM p GROUP BY ALL""")
def _(f):
    i = F.col("event_id")
    code = F.when(i % 5 == 0, 200).when(i % 5 == 1, 429).when(i % 5 == 2, 503).when(i % 5 == 3, 401).otherwise(404)
    failure = feeds.http_failure(F.col("code"), True)
    polls = f.table("events").select("event_id", (i % 4).alias("provider_id"), code.alias("code"))
    told = polls.select("event_id", "provider_id", F.coalesce(failure["kind"], F.lit("ok")).alias("kind"), failure["retryable"].alias("retryable"))
    # what each batch of the stream observes on its way, by provider and kind of failure, is summed by a listener
    kinds = {"ok": False, "rate_limited": True, "upstream": True, "authentication": False, "invalid_request": False}
    groups = {f"{p}:{k}": (F.col("provider_id") == p) & (F.col("kind") == k) for p in range(4) for k in kinds}
    groups["unnamed"] = ~F.coalesce(F.col("provider_id").isin(*range(4)) & F.col("kind").isin(*kinds), F.lit(False))
    telemetry = live.Telemetry(groups)
    f.spark.streams.addListener(telemetry)
    try:
        seen = lambda query: [telemetry.take(p) for p in query.recentProgress]  # noqa: E731  events may still be on their way
        L.in_starts(told, "event_id", 3, D.landing(f.spark, "telemetry"), telemetry.observed, seen)
    finally:
        f.spark.streams.removeListener(telemetry)
    counters = telemetry.counters()
    if counters.pop("unnamed"):
        raise RuntimeError("a provider or kind without a counter")
    rows = [(int(p), k, kinds[k], n) for name, n in counters.items() if n for p, k in [name.split(":")]]
    return f.spark.createDataFrame(rows, "provider_id bigint, kind string, retryable boolean, n bigint")


SCANNED = f"""WITH {QUOTES}, a AS (SELECT *, max(effective_ts) OVER (PARTITION BY provider_id, market_id, selection_id) AS top FROM quotes WHERE status = 'active'),
  c AS (SELECT provider_id, market_id, selection_id, any_value(cents) AS cents FROM a WHERE effective_ts = top GROUP BY 1, 2, 3 HAVING count(DISTINCT cents) = 1),
  b AS (SELECT market_id, selection_id, max(cents)::hugeint AS cents FROM c GROUP BY 1, 2),
  k AS (SELECT market_id, max(CASE WHEN selection_id = 0 THEN cents END) AS x, max(CASE WHEN selection_id = 1 THEN cents END) AS y, max(CASE WHEN selection_id = 2 THEN cents END) AS z FROM b GROUP BY 1 HAVING count(*) = 3)"""


@C.add("stm_scan_cycle", f"{SCANNED} SELECT market_id, round(100 / x::double + 100 / y::double + 100 / z::double, 9) AS implied_sum FROM k WHERE 100 * (x * y + y * z + x * z) < x * y * z")
def _(f):
    # quotes come in ten starts of a stream on one checkpoint; a batch re-prices the markets that it touches from what earlier ones left
    at = F.unix_micros(F.col("effective_ts").cast("timestamp"))
    active = f.quotes.where("status = 'active'").select("market_id", "provider_id", "selection_id", at.alias("at_us"), "cents")
    shards = L.shards_for(f.quotes.count())
    told = L.in_starts(active, "at_us", 10, D.landing(f.spark, "books"), lambda came: L.open_books(came, 3, shards))
    last = f.spark.read.schema(L.BOOK).parquet(told).groupBy("market_id").agg(F.max_by("cents", "turn").alias("cents")).where(F.size("cents") == 3)
    return last.where(A.is_arbitrage(F.col("cents"))).select("market_id", F.round(A.reciprocal_sum(F.col("cents")), 9).alias("implied_sum"))


@C.add("src_gate", "SELECT issue, n::bigint AS n FROM (VALUES ('inactive_quote', 3), ('malformed_price', 1), ('stale_quote', 3), ('eligible', 14)) t(issue, n)")
def _(f):
    return matrix(f).groupBy(F.coalesce("issue", F.lit("eligible")).alias("issue")).agg(F.count("*").alias("n"))


#: Eight polls of one three-way market by two feeds: (second, feed, source second, legs).
POLLS = [
    (0, 0, 0, (0, 1, 2)), (0, 1, 0, (0, 1, 2)), (10, 0, 10, (0, 2)), (10, 1, 10, (0, 2)), (31, 0, 31, (0, 2)), (32, 0, 12, (0,)),
    (40, 0, 40, (0, 2)), (40, 1, 40, (0, 1, 2)), (90, 0, 90, (0, 1, 2)), (90, 1, 90, (0, 1, 2)),
]


@C.add("bt_multi_poll", "SELECT at_s::bigint AS at_s, fresh::bigint AS fresh, stale::bigint AS stale, books FROM (VALUES (0, 6, 0, 1), (10, 6, 0, 1), (31, 4, 2, 0), (32, 4, 2, 0), (40, 5, 1, 1), (81, 0, 6, 0), (90, 6, 0, 1)) t(at_s, fresh, stale, books)")
def _(f):
    rows = [(p, feed, 0, s, "q", 320, "active", src, at) for at, feed, src, legs in POLLS for p in (feed,) for s in legs]
    raw = f.spark.createDataFrame(rows, "provider_id bigint, transport_id bigint, market_id bigint, selection_id bigint, quote_id string, cents bigint, status string, source bigint, at bigint")
    timed = raw.withColumns({"source_ts": F.timestamp_seconds("source"), "ingested_at": F.timestamp_seconds("at")})
    accepted = S.accepted_versions(S.fold(timed, 5 * SECOND))  # the late packet at 32 is rejected here
    phases = f.spark.createDataFrame([(t,) for t in (0, 10, 31, 32, 40, 81, 90)], "at_s bigint")
    seen = accepted.join(F.broadcast(phases), F.col("observed_us") <= F.col("at_s") * SECOND)  # seven phases by definition
    now = seen.groupBy("at_s", *S.KEY).agg(F.max(F.struct("revision", "effective_us")).alias("v"))
    now = now.withColumn("is_fresh", F.col("at_s") * SECOND - F.col("v.effective_us") <= 30 * SECOND)
    legs = now.groupBy("at_s", "selection_id").agg(F.count_if("is_fresh").alias("fresh"), F.count_if(~F.col("is_fresh")).alias("stale"))
    return legs.groupBy("at_s").agg(F.sum("fresh").alias("fresh"), F.sum("stale").alias("stale"), (F.count_if(F.col("fresh") > 0) == 3).cast("int").alias("books"))
