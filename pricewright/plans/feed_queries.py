"""Queries of feeds, the audit store, the read model, health and alerts."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import arbitrage as A
from ..operators import books as B
from ..operators import bucket_store as BS
from ..operators import codec as K
from ..operators import feeds as D
from ..operators import health as H
from ..operators import migrations as M
from ..operators import selection as SEL
from ..operators import store as T
from ..sources.feed_source import landing
from ..projection import AS_OF, EVENTS, QUOTES, STREAM, Catalogue, Frames
from .book_queries import RANKED, best, full_books
from .scalar_queries import BASE, KEYS, base

C = Catalogue()


# ---- feeds: payloads are made of the tables, written as JSON text and parsed again


#: One market a (event, provider), its kind by the provider; every rule of every shape is kept by some events and broken by others.
#: The cases are plain SQL that both engines read: market key, names, points, and the issue that the rules must find.
MARKET_KEYS = ("h2h", "totals", "btts", "spreads", "draw_no_bet", "h2h_s1", "h2h_s2", "alternate", "totals", "spreads")
SPORTS = ("soccer_x", "tennis_x", "basketball_x")
CASES = """CASE k WHEN 0 THEN CASE WHEN e % 7 = 0 THEN 'none' WHEN e % 7 = 1 THEN 'pointed' ELSE 'teams' END
  WHEN 1 THEN CASE e % 5 WHEN 1 THEN 'unequal' WHEN 2 THEN 'one' WHEN 3 THEN 'twice' WHEN 4 THEN 'lacking' ELSE 'overunder' END
  WHEN 2 THEN CASE e % 4 WHEN 1 THEN 'maybe' WHEN 2 THEN 'yesnopoint' ELSE 'yesno' END
  WHEN 3 THEN CASE e % 4 WHEN 1 THEN 'level' WHEN 2 THEN 'lackingteam' WHEN 3 THEN 'foreignopposed' ELSE 'opposed' END
  WHEN 4 THEN CASE e % 4 WHEN 1 THEN 'foreign' WHEN 2 THEN 'teamspoint' ELSE 'teams' END
  WHEN 5 THEN 'teams' WHEN 6 THEN CASE e % 2 WHEN 1 THEN 'foreign' ELSE 'teams' END
  WHEN 7 THEN CASE e % 2 WHEN 1 THEN 'pointed' ELSE 'teams' END WHEN 8 THEN 'overunder' ELSE 'opposed' END"""
NAMED_ONE = "CASE WHEN c IN ('none') THEN NULL WHEN c IN ('unequal', 'one', 'twice', 'lacking', 'overunder') THEN 'Over' WHEN c IN ('maybe', 'yesno', 'yesnopoint') THEN 'YES' ELSE 'Home' END"
NAMED_TWO = "CASE WHEN c IN ('none', 'one') THEN NULL WHEN c IN ('unequal', 'lacking', 'overunder') THEN 'under' WHEN c = 'twice' THEN 'Over' WHEN c = 'maybe' THEN 'Maybe' WHEN c IN ('yesno', 'yesnopoint') THEN 'No' WHEN c IN ('foreign', 'foreignopposed') THEN 'Other' ELSE 'Away' END"
POINT_ONE = "CASE WHEN c IN ('unequal', 'one', 'twice', 'lacking', 'overunder', 'yesnopoint', 'teamspoint', 'pointed') THEN 2.5 WHEN c IN ('opposed', 'foreignopposed', 'lackingteam') THEN -1.5 WHEN c = 'level' THEN 1.5 END"
POINT_TWO = "CASE WHEN c = 'unequal' THEN 3.5 WHEN c IN ('twice', 'overunder') THEN 2.5 WHEN c IN ('opposed', 'foreignopposed', 'level') THEN 1.5 END"
SHAPE_ISSUE = """CASE WHEN c = 'none' THEN 'empty_outcomes' WHEN k IN (5, 6) AND sp <> 1 THEN 'wrong_sport' WHEN k = 7 AND c = 'pointed' THEN 'unsupported_pointed_market' WHEN c IN ('pointed', 'yesnopoint', 'teamspoint') THEN 'unexpected_point'
  WHEN c IN ('lacking', 'lackingteam') THEN 'missing_point' WHEN c = 'unequal' THEN 'unequal_points' WHEN c = 'one' THEN 'outcome_count' WHEN c IN ('twice', 'maybe', 'foreign', 'foreignopposed') THEN 'unexpected_outcome' WHEN c = 'level' THEN 'unopposed_points' END"""


def array_payloads(f: Frames):
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    g = f.quotes.groupBy(F.col("event_id").alias("e"), F.col("provider_id").alias("k")).agg(F.max("cents").alias("hi"), F.min("cents").alias("lo")).withColumn("c", F.expr(CASES))
    price = lambda c: (F.col(c) / 100).cast("decimal(10,2)")
    one = lambda name, c, point, sid: F.struct(F.expr(name).alias("name"), price(c).alias("price"), sid.alias("sid"), F.expr(point).cast("decimal(18,6)").alias("point"))
    sid = F.when(F.col("hi") % 3 == 0, F.concat_ws("-", "e", "k"))
    both = F.array(one(NAMED_ONE, "hi", POINT_ONE, sid), one(NAMED_TWO, "lo", POINT_TWO, F.lit(None).cast("string")))
    m = F.struct(pick(MARKET_KEYS, F.col("k")).alias("key"), F.lit("2024-01-01T00:00:00Z").alias("last_update"), F.filter(both, lambda o: o["name"].isNotNull()).alias("outcomes"))
    b = g.groupBy("e").agg(F.collect_list(F.struct(F.col("k").cast("string").alias("key"), F.concat(F.lit("Bookmaker "), F.col("k").cast("string")).alias("title"), F.array(m).alias("markets"))).alias("bookmakers"))
    away = F.when(F.col("e") % 31 == 30, "Home").otherwise("Away")
    doc = F.struct(F.col("e").cast("string").alias("id"), pick(SPORTS, F.col("e") % 3).alias("sport_key"), F.lit("Home").alias("home_team"), away.alias("away_team"), "bookmakers")
    return b.select(F.when(F.col("e") % 37 == 36, F.substring(F.to_json(doc), 1, 20)).otherwise(F.to_json(doc)).alias("payload"))


@C.add(
    "src_array_feed",
    f"""WITH {QUOTES}, g0 AS (SELECT event_id AS e, provider_id AS k, max(cents) AS hi, min(cents) AS lo, event_id % 3 AS sp FROM quotes GROUP BY 1, 2), g AS (SELECT *, {CASES} AS c FROM g0),
    o AS (SELECT *, {SHAPE_ISSUE} AS issue, unnest([1, 2]) AS i, unnest([{NAMED_ONE}, {NAMED_TWO}]) AS name, unnest([{POINT_ONE}, {POINT_TWO}])::double AS point, unnest([hi, lo]) AS cents,
      {list(MARKET_KEYS)}[k + 1] AS market_key FROM g WHERE e % 31 <> 30 AND e % 37 <> 36 AND NOT (sp = 2 AND k IN (1, 3)))
    SELECT e::varchar AS event_id, 'bookmaker:array:' || k AS provider_id, k || ':' || market_key AS market_id, CASE WHEN name IS NOT NULL THEN CASE WHEN i = 1 AND hi % 3 = 0 THEN e || '-' || k ELSE k || ':' || market_key || ':' || name END END AS selection_id,
      CASE WHEN name IS NOT NULL THEN cents END AS cents, CASE WHEN issue IS NULL THEN CASE WHEN market_key = 'totals' THEN 2.5 WHEN market_key = 'spreads' THEN -1.5 WHEN market_key = 'draw_no_bet' THEN 0 END END::double AS line,
      CASE WHEN issue IS NULL THEN CASE WHEN market_key = 'spreads' THEN point WHEN market_key = 'draw_no_bet' THEN 0 END END::double AS handicap, CASE k WHEN 5 THEN 1 WHEN 6 THEN 2 END AS period_index, issue
    FROM o WHERE name IS NOT NULL OR c = 'none' AND i = 1
    UNION ALL SELECT CASE WHEN e % 37 <> 36 THEN e::varchar END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN e % 37 = 36 THEN 'malformed_payload' ELSE 'same_participants' END FROM (SELECT DISTINCT e FROM g) WHERE e % 31 = 30 OR e % 37 = 36""",
)
def _(f):
    got = D.array_feed(array_payloads(f), full_event_bookmakers=("8", "9"))
    wide = lambda c: F.col(c).cast("double").alias(c)
    return got.select("event_id", "provider_id", "market_id", "selection_id", (F.col("price") * 100).cast("bigint").alias("cents"), wide("line"), wide("handicap"), "period_index", "issue")


def map_payloads(f: Frames):
    """One fixture an event; bookmakers, markets and outcomes nested as maps, one quote (the best) at each leaf."""
    leaf = f.quotes.groupBy("event_id", "provider_id", "selection_id").agg(F.max("cents").alias("cents"), F.max("status").alias("status"), F.max("effective_ts").alias("ts"))
    player = F.create_map(F.lit("0"), F.struct((F.col("status") == "active").alias("active"), (F.col("cents") / 100).cast("decimal(10,2)").alias("price"), F.col("ts").cast("string").alias("changedAt")))
    o = F.struct(F.col("selection_id").cast("string"), F.struct(player.alias("players")))
    m = leaf.groupBy("event_id", "provider_id").agg(F.map_from_entries(F.collect_list(o)).alias("outcomes"))
    market = F.create_map(F.when(F.col("event_id") % 5 == 0, "9").otherwise("101"), F.struct(F.lit(True).alias("marketActive"), "outcomes"))
    book = F.struct(F.col("provider_id").cast("string"), F.struct(F.lit(True).alias("bookmakerIsActive"), (F.col("provider_id") == 7).alias("suspended"), market.alias("markets")))
    b = m.groupBy("event_id").agg(F.map_from_entries(F.collect_list(book)).alias("bookmakerOdds"))
    return b.select(F.to_json(F.struct(F.col("event_id").cast("string").alias("fixtureId"), (F.col("event_id") % 6 == 0).cast("int").alias("statusId"), "bookmakerOdds")).alias("payload"))


@C.add(
    "src_map_feed",
    f"""WITH {QUOTES}, l AS (SELECT event_id, provider_id, selection_id, max(cents) AS cents, max(status) AS status, max(effective_ts) AS ts FROM quotes GROUP BY 1, 2, 3),
    n AS (SELECT *, count(*) OVER (PARTITION BY event_id, provider_id) AS n FROM l)
    SELECT event_id::varchar AS event_id, 'bookmaker:' || provider_id AS bookmaker, selection_id::varchar AS outcome_id, cents, CASE WHEN status = 'active' AND provider_id <> 7 AND event_id % 6 <> 0 THEN 'active' ELSE 'suspended' END AS status,
    CASE WHEN event_id % 5 = 0 THEN 'unknown_market' WHEN n < 3 THEN 'outcome_set_mismatch' END AS issue FROM n""",
)
def _(f):
    catalogue = f.spark.createDataFrame([("101", ["0", "1", "2"])], "market_id string, outcome_ids array<string>")
    got = D.map_feed(map_payloads(f), catalogue)
    return got.select("event_id", "bookmaker", "outcome_id", (F.col("price") * 100).cast("bigint").alias("cents"), "status", "issue")


#: Catalogue rows of which each market takes one by its number: (market id or none: its own, sport, name, period, type, handicap, player prop, outcomes).
LISTED = (
    ("101", "football", "Full Time Result", "fulltime", "1x2", "0", False, "101=1,102=X,103=2"),
    (None, "football", "Full Time Result", "fulltime", "1x2", "0", False, "101=1,102=X,103=2"),
    (None, "football", "Over Under Full Time", "fulltime", "totals", "2.5", False, "1=Over,2=Under"),
    (None, "football", "Over Under Full Time", "fulltime", "totals", "0", False, "1=Over,2=Under"),
    (None, "football", "Asian Handicap", "fulltime", "handicap", "-1", False, "1=1,2=2"),
    (None, "football", "Both Teams To Score", "fulltime", "totals", "0", False, "1=Yes,2=No"),
    (None, "football", "Both Teams To Score", "fulltime", "totals", "0", True, "1=Yes,2=No"),
    (None, "tennis", "Match Winner", "match", "winner", "0", False, "1=1,2=2"),
    ("123", "tennis", "First Set Winner", "p1", "winner", "0", False, "1=1,2=2"),
    (None, "tennis", "First Set Winner", "p1", "winner", "0", False, "1=1,2=2"),
    ("125", "tennis", "Second Set Winner", "p2", "winner", "0", False, "1=1,2=2"),
    (None, "basketball", "Over Under (incl. overtime)", "fulltime", "totals", "160.5", False, "1=Over,2=Under"),
    (None, "basketball", "Over Under Full Time", "fulltime", "totals", "160.5", False, "1=Over,2=Under"),
    (None, "basketball", "Handicap (incl. overtime)", "fulltime", "handicap", "-4.5", False, "1=1,2=2"),
    ("101", "football", "Full Time Result", "p1", "1x2", "0", False, "101=1,102=X,103=2"),
    (None, "football", "Over Under Full Time", "fulltime", "totals", "2.5", False, "1=Over,2=Under,3=Exactly"),
)
SPORT_IDS = {"football": 10, "tennis": 11, "basketball": 12}


def listed(f):
    """(event_id, catalogue columns): the market of each event."""
    rows = [(k, m, s, SPORT_IDS[s], *rest) for k, (m, s, *rest) in enumerate(LISTED)]
    kinds = f.spark.createDataFrame(rows, "k bigint, own_id string, sport string, sport_id int, name string, period string, market_type string, handicap string, player_prop boolean, listed string")
    joined = f.events.select("event_id", (F.col("event_id") % len(LISTED)).alias("k")).join(F.broadcast(kinds), "k")  # LISTED rows
    return joined.select(
        "event_id", F.coalesce("own_id", F.concat(F.lit("9"), F.col("event_id").cast("string"))).alias("market_id"), "sport", "sport_id", "name", "period", "market_type",
        F.col("handicap").cast("decimal(18,6)").alias("handicap"), "player_prop", F.str_to_map("listed", F.lit(","), F.lit("=")).alias("outcomes"),
    )


@C.add("src_market_catalog", f"""WITH {EVENTS} SELECT '9' || event_id AS market_id, CASE WHEN event_id % 11 <> 3 THEN 'n' || event_id % 4 END AS name, CASE WHEN event_id % 5 = 0 THEN 'duplicate_market' WHEN event_id % 11 = 3 THEN 'incomplete_market' WHEN event_id % 13 = 4 THEN 'unclear_outcomes' END AS issue
  FROM dim_events WHERE event_id % 17 <> 2 UNION ALL SELECT NULL, NULL, 'malformed_payload' FROM dim_events WHERE event_id % 17 = 2 UNION ALL SELECT NULL, NULL, 'malformed_payload' FROM dim_events WHERE event_id % 17 = 2 AND event_id % 5 = 0""")
def _(f):
    i = F.col("event_id")
    names = F.array(*[F.struct(k.alias("outcomeId"), F.lit(n).alias("outcomeName")) for k, n in ((F.lit("1"), "Over"), (F.when(i % 13 == 4, "1").otherwise("2"), "Under"))])
    doc = F.to_json(F.struct(
        F.concat(F.lit("9"), i.cast("string")).alias("marketId"), F.lit(10).alias("sportId"), F.when(i % 11 != 3, F.concat(F.lit("n"), (i % 4).cast("string"))).alias("marketName"), F.lit(False).alias("playerProp"),
        F.lit(2.5).alias("handicap"), F.lit("fulltime").alias("period"), F.lit("totals").alias("marketType"), names.alias("outcomes"),
    ))
    text = F.when(i % 17 == 2, F.substring(doc, 1, 9)).otherwise(doc)
    times = F.when(i % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    got = D.market_catalogue(f.events.select(text.alias("payload"), F.explode(times).alias("copy")))
    return got.select("market_id", "name", "issue")


@C.add("src_market_supported", f"WITH {EVENTS} SELECT event_id, event_id % 16 IN (0, 2, 4, 5, 7, 8, 10, 11, 13) AS supported FROM dim_events")
def _(f):
    return listed(f).select("event_id", D.market_supported(F.col("sport")).alias("supported"))


@C.add("src_1x2_contract", f"WITH {EVENTS} SELECT event_id, event_id % 16 = 0 AS same FROM dim_events")
def _(f):
    return listed(f).select("event_id", D.three_way_contract().alias("same"))


GROUPS = "['Soccer', 'Tennis', 'Basketball', 'Cricket', 'Motorsport']"


def sport_records(f):
    groups = F.array(*[F.lit(x) for x in ("Soccer", "Tennis", "Basketball", "Cricket", "Motorsport")])
    return f.table("nation").select(F.col("n_nationkey").cast("bigint").alias("key"), F.element_at(groups, (F.col("n_nationkey") % 5 + 1).cast("int")).alias("group"))


def sport_map():
    return F.create_map(*[F.lit(x) for kv in (("Soccer", "football"), ("Tennis", "tennis"), ("Basketball", "basketball"), ("Motorsport", "motorsport")) for x in kv])


SPORT_SQL = "CASE n_nationkey % 5 WHEN 0 THEN 'football' WHEN 1 THEN 'tennis' WHEN 2 THEN 'basketball' WHEN 4 THEN 'motorsport' END"


@C.add("src_sports_array", f"SELECT n_nationkey::bigint AS key, {SPORT_SQL} AS sport FROM nation")
def _(f):
    return sport_records(f).select("key", F.try_element_at(sport_map(), F.col("group")).alias("sport"))


def slug_records(f):
    """Sport records of the map feed: one of soccer and one of tennis, whose id is missing; several of the others."""
    k = F.col("n_nationkey").cast("bigint")
    slug = F.when(k == 0, "soccer").when(k == 1, "tennis").when(k == 2, "basketball").when(k % 2 == 0, "motorsport").otherwise("cricket")
    return f.table("nation").select(k.alias("key"), slug.alias("slug"), F.when(k != 1, k.cast("int")).alias("sport_id"), F.when(k % 10 == 7, F.lit(" ")).otherwise(F.col("n_name")).alias("name"))


MAPPED = {"soccer": "football", "tennis": "tennis", "basketball": "basketball", "motorsport": "motorsport"}


@C.add("src_sports_slug", "SELECT n_nationkey::bigint AS key, CASE n_nationkey WHEN 0 THEN 'football' WHEN 1 THEN 'tennis' WHEN 2 THEN 'basketball' ELSE 'motorsport' END AS sport, CASE WHEN n_nationkey = 1 THEN 'incomplete' END AS issue FROM nation WHERE n_nationkey < 3 OR n_nationkey % 2 = 0")
def _(f):
    mapped = F.create_map(*[F.lit(x) for kv in MAPPED.items() for x in kv])
    lacking = F.col("sport_id").isNull() | (F.trim("name") == "")
    rows = slug_records(f).withColumn("sport", F.try_element_at(mapped, F.col("slug"))).where("sport IS NOT NULL")  # unknown slugs are passed over
    return rows.select("key", "sport", F.when(lacking, "incomplete").alias("issue"))


@C.add("src_supported_sports", "SELECT * FROM (VALUES ('football', 'resolved'), ('tennis', 'incomplete'), ('basketball', 'resolved'), ('motorsport', 'ambiguous')) t(sport, status)")
def _(f):
    return D.sport_status(slug_records(f), MAPPED)


@C.add("src_event_home_away", f"WITH {EVENTS} SELECT event_id, unnest(['home', 'away']) AS role, unnest([home_id, away_id]) AS participant_id FROM dim_events")
def _(f):
    sides = F.array(F.struct(F.lit("home").alias("role"), F.col("home_id").alias("id")), F.struct(F.lit("away").alias("role"), F.col("away_id").alias("id")))
    return f.events.select("event_id", F.explode(sides).alias("s")).select("event_id", "s.role", F.col("s.id").alias("participant_id"))


@C.add("src_event_participants", f"WITH {EVENTS} SELECT event_id, home_id AS participant1, away_id AS participant2, CASE event_id % 4 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'live' WHEN 2 THEN 'finished' END AS status, CASE WHEN event_id % 4 = 3 THEN 'undocumented_status' END AS issue FROM dim_events")
def _(f):
    k = F.col("event_id") % 4
    status = F.when(k == 0, "scheduled").when(k == 1, "live").when(k == 2, "finished")
    return f.events.select("event_id", F.col("home_id").alias("participant1"), F.col("away_id").alias("participant2"), status.alias("status"), F.when(status.isNull(), "undocumented_status").alias("issue"))


@C.add("src_selection_id", f"WITH {QUOTES} SELECT quote_id, selection_id, CASE WHEN cents % 3 = 0 THEN quote_id ELSE provider_id || ':h2h:' || CASE WHEN cents % 2 = 0 THEN 'x:' ELSE '' END || selection_id END AS sid FROM quotes")
def _(f):
    sid = D.selection_id(F.when(F.col("cents") % 3 == 0, F.col("quote_id")), F.col("provider_id"), F.lit("h2h"), F.when(F.col("cents") % 2 == 0, "x"), F.col("selection_id"))
    return f.quotes.select("quote_id", "selection_id", sid.alias("sid"))


@C.add("src_selection_ts", f"WITH {STREAM} SELECT quote_id, CASE WHEN quote_id::bigint % 2 = 0 THEN source_ts ELSE ingested_at END AS at FROM stream")
def _(f):
    return f.stream.select("quote_id", F.coalesce(F.when(F.col("quote_id").cast("bigint") % 2 == 0, F.col("source_ts")), F.col("ingested_at")).alias("at"))


@C.add("src_set_index", f"WITH {EVENTS} SELECT event_id, CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 END AS set_index FROM dim_events")
def _(f):
    k = F.col("event_id") % 4
    market = F.when(k == 0, "123").when(k == 1, "125").when(k == 2, "123").otherwise("7")
    name = F.when(k == 0, "First Set Winner").when(k == 1, "Second Set Winner").otherwise("Second Set Winner")
    return f.events.select("event_id", D.set_index(market, name).alias("set_index"))


@C.add("src_bookmaker_ns", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 0 THEN 'bookmaker:bet' || s_suppkey END AS bookmaker FROM supplier")
def _(f):
    k = F.col("s_suppkey")
    slug = F.when(k % 5 == 0, F.concat(F.lit("bet "), k.cast("string"))).otherwise(F.concat(F.lit(" Bet"), k.cast("string")))
    return f.table("supplier").select("s_suppkey", D.bookmaker_name(slug).alias("bookmaker"))


@C.add("src_suspend_live", f"WITH {QUOTES} SELECT quote_id, market_id, selection_id, CASE WHEN event_id % 3 > 0 THEN 'suspended' ELSE status END AS status FROM quotes")
def _(f):
    return f.quotes.select("quote_id", "market_id", "selection_id", D.suspended(F.col("status"), F.col("event_id") % 3).alias("status"))


@C.add("src_quota", f"WITH {EVENTS} SELECT event_id, greatest(100 - event_id % 130, 0) AS remaining FROM dim_events")
def _(f):
    i = F.col("event_id")
    sub = lambda id_, active, limit, used: F.struct(F.lit(id_).alias("id"), F.lit(active).alias("active"), F.lit(limit).cast("bigint").alias("limit"), used.alias("used"))
    subs = f.events.select("event_id", F.array(sub("old", False, 5, i), sub("now", True, 100, i % 130)).alias("subs"))
    pick = F.get(F.filter("subs", lambda s: s["active"]), F.lit(0))
    return subs.select("event_id", F.greatest(pick["limit"] - pick["used"], F.lit(0)).alias("remaining"))


@C.add("src_discover_competitions", f"WITH {EVENTS} SELECT competition_id, count(*) AS n FROM dim_events WHERE competition_id <> 3 GROUP BY 1 ORDER BY 1")
def _(f):
    return f.events.where("competition_id <> 3").groupBy("competition_id").agg(F.count("*").alias("n")).orderBy("competition_id")


@C.add("src_discover_events", f"WITH {EVENTS} SELECT event_id, scheduled_start FROM dim_events WHERE scheduled_start BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '2000-01-01' AND competition_id <> 3")
def _(f):
    lit = lambda s: F.lit(s).cast("timestamp_ntz")
    return f.events.where(F.col("scheduled_start").between(lit("1999-01-01"), lit("2000-01-01")) & (F.col("competition_id") != 3)).select("event_id", "scheduled_start").orderBy("event_id")


@C.add("src_ownership", f"""WITH {QUOTES}, a AS (SELECT DISTINCT provider_id AS p, event_id AS e FROM quotes) SELECT p AS asked_provider, e AS asked_event,
  CASE WHEN (p + e) % 7 = 0 THEN 'provider_mismatch' WHEN (p + e) % 5 = 0 THEN 'event_mismatch' END AS issue FROM a""")
def _(f):
    p, e = F.col("asked_provider"), F.col("asked_event")
    asked = f.quotes.select(F.col("provider_id").alias("asked_provider"), F.col("event_id").alias("asked_event")).distinct()
    got = asked.select(p, e, F.when((p + e) % 7 == 0, p + 1).otherwise(p).alias("provider_id"), F.when((p + e) % 5 == 0, e + 1).otherwise(e).alias("event_id"))
    return got.select("asked_provider", "asked_event", D.ownership().alias("issue"))


SWEEP = f"""WITH {EVENTS}, a AS (SELECT unnest(range(0, 10))::bigint AS p), c AS (SELECT p, competition_id FROM a, (SELECT DISTINCT competition_id FROM dim_events) WHERE p < 8),
  x AS (SELECT p, event_id AS e, competition_id, scheduled_start FROM a, dim_events WHERE p < 7 AND NOT (p % 2 = 0 AND competition_id = 3)),
  s AS (SELECT *, CASE WHEN (p + e) % 11 = 0 THEN 'timeout' WHEN (p + e) % 17 = 0 THEN 'provider_mismatch' WHEN (p + e) % 19 = 0 THEN 'event_mismatch' END AS issue FROM x WHERE (p + e) % 13 <> 0)
  SELECT p AS provider_id, 'fetch_odds' AS operation, e AS event_id, CASE WHEN issue IS NULL THEN scheduled_start END AS start, issue FROM s
  UNION ALL SELECT 9, 'supported_sports', NULL, NULL, 'authentication' UNION ALL SELECT 7, 'discover_competitions', NULL, NULL, 'upstream'
  UNION ALL SELECT p, 'discover_events', NULL, NULL, 'timeout' FROM a WHERE p < 7 AND p % 2 = 0 AND 3 IN (SELECT competition_id FROM dim_events)"""


@C.add("src_collect", SWEEP)
def _(f):
    p, e, text = F.col("provider_id"), F.col("event_id"), F.lit(None).cast("string")
    adapters = f.spark.range(10).select(F.col("id").alias("provider_id"), F.when(F.col("id") == 8, F.array(F.lit("tennis"))).otherwise(F.array(F.lit("football"))).alias("sports"), F.when(F.col("id") == 9, "authentication").alias("error"))
    found = f.events.select("competition_id").distinct().withColumn("provider_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))))
    competitions = found.withColumn("error", F.when(p == 7, "upstream"))
    events = competitions.drop("error").join(f.events.select("competition_id", "event_id", F.col("scheduled_start").alias("start")), "competition_id")
    events = events.withColumn("error", F.when((p % 2 == 0) & (F.col("competition_id") == 3), "timeout"))
    n = p + e
    snapshots = events.where(n % 13 != 0).select(
        p.alias("asked_provider"), e.alias("asked_event"), F.when(n % 17 == 0, p + 1).otherwise(p).alias("provider_id"), F.when(n % 19 == 0, e + 1).otherwise(e).alias("event_id"),
        F.when(n % 11 == 0, "timeout").otherwise(text).alias("error"),
    )
    return D.collected(adapters, competitions, events, snapshots, "football")


@C.add("src_history", f"WITH {STREAM} SELECT quote_id, provider_id, ingested_at FROM stream WHERE ingested_at >= TIMESTAMP '2024-01-10' AND ingested_at < TIMESTAMP '2024-01-20' AND provider_id IN (1, 2)")
def _(f):
    lit = lambda s: F.lit(s).cast("timestamp_ntz")
    kept = f.stream.where((F.col("ingested_at") >= lit("2024-01-10")) & (F.col("ingested_at") < lit("2024-01-20")) & F.col("provider_id").isin(1, 2))
    return kept.select("quote_id", "provider_id", "ingested_at").orderBy("ingested_at", "quote_id")


STATUSES = "[200, 400, 401, 403, 404, 409, 422, 429, 500, 503, 302]"


def polls(f):
    e = f.table("events")
    codes = F.array(*[F.lit(x) for x in (200, 400, 401, 403, 404, 409, 422, 429, 500, 503, 302)])
    return e.select(F.col("event_id").alias("poll_id"), (F.col("event_id") % 4).alias("provider_id"), "ts", F.element_at(codes, (F.col("event_id") % 11 + 1).cast("int")).alias("code"), "value")


@C.add("src_http_status", f"""WITH p AS (SELECT event_id AS poll_id, {STATUSES}[event_id % 11 + 1] AS code FROM events) SELECT poll_id,
  CASE WHEN code = 200 THEN NULL WHEN code = 401 THEN 'authentication' WHEN code = 403 THEN 'authorization' WHEN code = 429 THEN 'rate_limited' WHEN code = 400 THEN 'invalid_request' ELSE 'upstream' END AS strict,
  CASE WHEN code = 200 THEN NULL WHEN code = 401 THEN 'authentication' WHEN code = 403 THEN 'authorization' WHEN code = 429 THEN 'rate_limited' WHEN code IN (400, 404, 409, 422) THEN 'invalid_request' ELSE 'upstream' END AS lenient,
  code = 429 OR code >= 500 AS retryable FROM p""")
def _(f):
    p = polls(f)
    return p.select("poll_id", D.http_failure(F.col("code"), False)["kind"].alias("strict"), D.http_failure(F.col("code"), True)["kind"].alias("lenient"), D.http_failure(F.col("code"), True)["retryable"].alias("retryable"))


@C.add("src_rate_headers", "SELECT event_id AS poll_id, CASE WHEN event_id % 3 > 0 AND event_id % 5 > 0 THEN event_id % 100 + user_id END AS quota FROM events")
def _(f):
    left = F.when(F.col("event_id") % 3 > 0, (F.col("event_id") % 100).cast("string")).otherwise("n/a").try_cast("bigint")
    used = F.when(F.col("event_id") % 5 > 0, F.col("user_id").cast("string")).try_cast("bigint")
    return f.table("events").select(F.col("event_id").alias("poll_id"), F.when(left.isNotNull() & used.isNotNull(), left + used).alias("quota"))


@C.add("src_health", f"SELECT event_id AS poll_id, CASE WHEN event_id % 11 = 0 THEN 'healthy' WHEN event_id % 11 = 7 THEN 'degraded' ELSE 'unavailable' END AS state FROM events")
def _(f):
    kind = D.http_failure(F.col("code"), True)["kind"]
    return polls(f).select("poll_id", F.when(kind.isNull(), "healthy").when(kind.isin("rate_limited", "malformed"), "degraded").otherwise("unavailable").alias("state"))


@C.add("stm_rate_gate", "SELECT event_id AS poll_id, CASE WHEN event_id % 3 = 0 THEN greatest(event_id + event_id % 7 + 1, CASE WHEN event_id % 2 = 0 THEN event_id + 60 ELSE 0 END) WHEN event_id % 2 = 0 THEN event_id + 60 WHEN event_id % 5 = 0 THEN event_id + 5 END AS next_at FROM events")
def _(f):
    i = F.col("event_id")
    remaining = F.when((i % 2 == 0) | (i % 5 == 0), 0).otherwise(1)
    resets = F.when(i % 2 == 0, i + 60)
    return f.table("events").select(i.alias("poll_id"), D.next_allowed(i, F.when(i % 3 == 0, i % 7 + 1), remaining, resets).alias("next_at"))


@C.add("stm_retry", "SELECT event_id AS poll_id, round(greatest(least(4.0, least(4.0, 0.25 * pow(2.0, event_id % 8)) * (1 + 0.2 * (event_id % 11) / 10.0)), CASE WHEN event_id % 9 = 0 THEN 6.0 ELSE 0.0 END), 9) AS delay FROM events")
def _(f):
    i = F.col("event_id")
    return f.table("events").select(i.alias("poll_id"), F.round(D.retry_delay(i % 8 + 1, (i % 11) / 10, F.when(i % 9 == 0, F.lit(6.0))), 9).alias("delay"))


# ---- health, metrics, alerts

POLLS = """p AS (SELECT event_id AS poll_id, event_id % 4 AS provider_id, epoch_us(ts) AS tm, user_id % 3 AS snapshots, (value * 100)::bigint % 5 // 3 AS issues, event_type = 'error' AS throttled FROM events)"""


def poll_log(f):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return f.table("events").select(
        F.col("event_id").alias("poll_id"), (F.col("event_id") % 4).alias("provider_id"), at.alias("at"), (F.col("user_id") % 3).alias("snapshots"),
        F.floor((F.round(F.col("value") * 100).cast("bigint") % 5) / 3).alias("issues"), (F.col("event_type") == "error").alias("throttled"),
    )


HEALTH = f"""WITH {POLLS}, r AS (SELECT *, sum((NOT throttled AND issues = 0)::int) OVER w AS run, max(CASE WHEN snapshots > 0 AND NOT throttled THEN tm END) OVER (PARTITION BY provider_id ORDER BY tm, poll_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM p WINDOW w AS (PARTITION BY provider_id ORDER BY tm, poll_id ROWS UNBOUNDED PRECEDING)), h AS (SELECT *, sum((NOT throttled AND issues > 0)::int) OVER (PARTITION BY provider_id, run ORDER BY tm, poll_id ROWS UNBOUNDED PRECEDING)::bigint AS failures FROM r)"""


@C.add("win_consecutive_failures", f"""{HEALTH} SELECT poll_id, failures, CASE WHEN throttled THEN 'degraded' WHEN issues = 0 THEN 'healthy' WHEN snapshots > 0 THEN 'degraded' WHEN failures >= 3 THEN 'unavailable' ELSE 'degraded' END AS state FROM h""")
def _(f):
    return H.poll_health(poll_log(f)).select("poll_id", F.col("failures").cast("bigint").alias("failures"), "state")


@C.add("win_update_interval", f"{HEALTH} SELECT poll_id, CASE WHEN snapshots > 0 AND NOT throttled THEN tm - prev END AS gap FROM h")
def _(f):
    return H.poll_health(poll_log(f)).select("poll_id", "gap")


@C.add("win_latency_ring", f"WITH {POLLS} SELECT provider_id, poll_id FROM (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY poll_id DESC) AS r FROM p) WHERE r <= 256")
def _(f):
    return H.ring(poll_log(f), "provider_id", "poll_id").select("provider_id", "poll_id")


@C.add("agg_metrics_registry", f"WITH {POLLS} SELECT provider_id, count(*) AS requests, count_if(issues > 0)::bigint AS errors, count_if(throttled)::bigint AS throttled FROM p GROUP BY 1")
def _(f):
    return poll_log(f).groupBy("provider_id").agg(F.count("*").alias("requests"), F.count_if(F.col("issues") > 0).alias("errors"), F.count_if("throttled").alias("throttled"))


@C.add("agg_health", f"""WITH {POLLS}, l AS (SELECT provider_id, count_if(issues > 0)::bigint / count(*) AS ratio, max_by(throttled, (tm, poll_id)) AS off, max(tm) AS seen, max(snapshots) AS snapshots FROM p GROUP BY 1),
  st AS (SELECT provider_id, CASE WHEN off OR ratio >= 0.395 THEN 'degraded' ELSE 'healthy' END AS state FROM l),
  q AS (SELECT user_id, max(epoch_us(ts)) AS tm FROM events GROUP BY 1), v AS (SELECT count_if(tm < (SELECT max(tm) FROM q) - 864000000000)::bigint AS stale, count_if(tm >= (SELECT max(tm) FROM q) - 864000000000)::bigint AS active FROM q),
  d AS (SELECT count_if(state = 'degraded')::bigint AS degraded FROM st)
  SELECT provider_id::varchar AS part, state FROM st UNION ALL SELECT 'system', CASE WHEN stale + active > 0 AND stale / (stale + active) >= 0.5 THEN 'unhealthy' WHEN degraded > 0 THEN 'degraded' ELSE 'healthy' END FROM v, d""")
def _(f):
    log = poll_log(f)
    m = log.groupBy("provider_id").agg(F.count("*").alias("requests"), F.count_if(F.col("issues") > 0).alias("errors"), (~F.max_by("throttled", F.struct("at", "poll_id"))).alias("available"))
    states = H.provider_states(m, 0.395).select(F.col("provider_id").cast("string").alias("part"), "state")
    keys = f.table("events").groupBy("user_id").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("at"))
    newest = keys.agg(F.max("at").alias("newest")).scalar()
    old = F.col("at") < F.col("newest") - 10 * 86_400_000_000
    ages = keys.withColumn("newest", newest).agg(F.count_if(old).alias("stale"), F.count_if(~old).alias("active"))
    degraded = states.agg(F.count_if(F.col("state") == "degraded").alias("n")).scalar()
    whole = ages.select(F.lit("system").alias("part"), H.system_state(F.col("stale"), F.col("active"), F.lit(1.0), degraded).alias("state"))
    return states.unionByName(whole)


@C.add("agg_error_rate", f"WITH {POLLS} SELECT round(avg(CASE WHEN issues > 0 THEN 1.0 ELSE 0 END), 9) AS error_rate, max(tm) - min(tm) AS span_us FROM p")
def _(f):
    return poll_log(f).agg(F.round(F.avg(F.when(F.col("issues") > 0, 1.0).otherwise(0.0)), 9).alias("error_rate"), (F.max("at") - F.min("at")).alias("span_us"))


@C.add("agg_latency_percentiles", f"WITH {BASE} SELECT l_linenumber, median(total)::double AS median, quantile_disc(total, 0.95) AS p95, max(total) AS worst FROM b GROUP BY 1")
def _(f):
    return SEL.percentiles(base(f).select("l_linenumber", "total"), ["l_linenumber"], "total", {"p95": 0.95})


@C.add("agg_transport_snapshot", f"""WITH {QUOTES}, q AS (SELECT *, date_diff('day', effective_ts::date, DATE '{AS_OF[:10]}') AS age FROM quotes),
  c AS (SELECT transport_id, count_if(status = 'active')::bigint AS active, count_if(status <> 'active')::bigint AS suspended, max(effective_ts) AS newest FROM q GROUP BY 1)
  SELECT c.*, median, p95, worst FROM c LEFT JOIN (SELECT transport_id, median(age)::double AS median, quantile_disc(age, 0.95) AS p95, max(age) AS worst FROM q WHERE status = 'active' GROUP BY 1) USING (transport_id)""")
def _(f):
    # what a transport has, and the ages in days of its active quotes, found by rank
    live = F.col("status") == "active"
    counts = f.quotes.groupBy("transport_id").agg(F.count_if(live).alias("active"), F.count_if(~live).alias("suspended"), F.max("effective_ts").alias("newest"))
    age = F.date_diff(F.lit(AS_OF[:10]).cast("date"), F.to_date("effective_ts"))
    ages = SEL.percentiles(f.quotes.where(live).select("transport_id", age.alias("age")), ["transport_id"], "age", {"p95": 0.95})
    return counts.join(ages, "transport_id", "left")


@C.add("agg_operational_snapshot", f"""WITH {QUOTES}, a AS (SELECT market_id, provider_id, count(*) AS active, max(effective_ts) AS newest FROM quotes WHERE status = 'active' GROUP BY 1, 2),
  s AS (SELECT market_id, provider_id, count(*) AS suspended FROM quotes WHERE status <> 'active' GROUP BY 1, 2)
  SELECT coalesce(a.market_id, s.market_id) AS market_id, coalesce(a.provider_id, s.provider_id) AS provider_id, active, suspended, newest FROM a FULL JOIN s ON a.market_id = s.market_id AND a.provider_id = s.provider_id""")
def _(f):
    key = ["market_id", "provider_id"]
    a = f.quotes.where("status = 'active'").groupBy(*key).agg(F.count("*").alias("active"), F.max("effective_ts").alias("newest"))
    s = f.quotes.where("status <> 'active'").groupBy(*key).agg(F.count("*").alias("suspended"))
    return a.join(s, key, "full").select(*key, "active", "suspended", "newest")  # a feed may have only one of them in a market


@C.add("agg_marketbook_digest", f"{RANKED} SELECT market_id, sha256(a || ',' || b || ',' || c) AS digest FROM book")
def _(f):
    prices = F.array_join(F.transform("outcomes", lambda o: o["cents"].cast("string")), ",")
    return B.books(best(f), 3).select("market_id", F.sha2(prices.cast("binary"), 256).alias("digest"))


@C.add("win_alert_transitions", f"""WITH {STREAM}, h AS (SELECT market_id, quote_id, CASE WHEN status = 'active' THEN 'active' ELSE 'expired' END AS state, cents % 3 AS fp, lag(cents % 3) OVER w AS old, lag(status) OVER w AS was
  FROM stream WINDOW w AS (PARTITION BY market_id ORDER BY ingested_at)) SELECT market_id, quote_id, CASE WHEN old IS NULL THEN CASE WHEN state = 'expired' THEN 'expired' ELSE 'created' END
  WHEN state = 'expired' AND was = 'active' THEN 'expired' ELSE 'changed' END AS kind FROM h WHERE old IS NULL OR state = 'expired' AND was = 'active' OR fp <> old""")
def _(f):
    h = f.stream.select("market_id", F.col("market_id").alias("event_id"), "quote_id", F.col("ingested_at").alias("at"), F.when(F.col("status") == "active", "active").otherwise("expired").alias("state"), (F.col("cents") % 3).alias("fingerprint"))
    return H.alerts(h).select("market_id", "quote_id", "kind")


# ---- store, codec, read model


def stored_rows(f, where):
    return f.stream.where(where).select(F.col("quote_id").alias("id"), F.concat_ws(":", "cents", "status").alias("payload"))


@C.add("snk_upsert_quotes", f"WITH {STREAM} SELECT quote_id AS id, cents || ':' || status AS payload FROM stream")
def _(f):
    return two_batches(f).read("quote").select("id", "payload")


def two_batches(f):
    """A store of the stream's quotes, in two commits of batches that overlap in a third of them."""
    store = BS.BucketStore(f.spark, landing(f.spark, "store"), buckets=16)
    for part in ("cast(quote_id AS bigint) % 3 < 2", "cast(quote_id AS bigint) % 3 > 0"):
        store.upsert({"quote": stored_rows(f, part).withColumn("at_us", F.lit(None).cast("bigint"))}, audit="audit")
    return store


@C.add("snk_upsert_audit", f"WITH {STREAM} SELECT 'quote:' || quote_id AS id, '{{\"event\":\"quote_stored\",\"id\":\"' || quote_id || '\"}}' AS payload FROM stream")
def _(f):
    return two_batches(f).read("audit").select("id", "payload")


def stored_opportunities(f):
    return A.opportunities(full_books(f)).select(F.col("market_id").alias("opportunity_id"), "quote_ids")


def once(f, batch, name):
    """A batch that is read several times, written first, so that it is computed once."""
    path = landing(f.spark, name)
    batch.write.parquet(path)
    return f.spark.read.schema(batch.schema).parquet(path)


BRIDGE = f"{RANKED}, o AS (SELECT market_id AS opportunity_id, list(quote_id ORDER BY selection_id) AS quote_ids FROM best WHERE market_id IN (SELECT market_id FROM e WHERE arb) GROUP BY 1)"


@C.add("snk_opportunity", f"{BRIDGE} SELECT opportunity_id::varchar AS opportunity_id, len(quote_ids)::bigint AS legs, true AS audited FROM o")
def _(f):
    found = once(f, stored_opportunities(f).withColumns({"plan": F.lit("even"), "payload": F.array_join("quote_ids", ",")}), "found")
    store = BS.BucketStore(f.spark, landing(f.spark, "opportunities"), buckets=16)
    for _ in range(2):  # delivered again: nothing is added
        store.upsert(BS.opportunity_tables(found), audit="audit")
    own = lambda table, key, which="true": store.read(table).where(which).select(key.alias("opportunity_id"), F.lit(table).alias("kind"))
    part = lambda k: F.split_part("id", F.lit(":"), F.lit(k))
    told = own("opportunity", F.col("id")).unionByName(own("leg", part(1))).unionByName(own("audit", part(2), "id LIKE 'opportunity:%'"))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    counted = told.groupBy("opportunity_id").agg(n("opportunity").alias("n"), n("leg").alias("legs"), (n("audit") == 1).alias("audited"))
    return counted.where("n = 1").drop("n")


@C.add("snk_reconstruct", f"{BRIDGE} SELECT opportunity_id, array_to_string(quote_ids, ',') AS quote_ids, false AS incomplete FROM o")
def _(f):
    quotes = f.quotes.groupBy("quote_id").agg(F.max("cents").alias("cents"))
    return T.reconstruct(T.bridge(stored_opportunities(f)), quotes)


RETAIN = f"{BRIDGE}, u AS (SELECT DISTINCT unnest(quote_ids) AS quote_id FROM o) SELECT quote_id, market_id, selection_id FROM quotes WHERE effective_ts >= TIMESTAMP '1998-01-01' OR quote_id IN (SELECT quote_id FROM u)"


def purged(f):
    """A store of the quotes after a purge of those before 1998 that no opportunity refers to, and how many went."""
    store = BS.BucketStore(f.spark, landing(f.spark, "quotes"), buckets=16, head="#")
    at = F.unix_micros(F.col("effective_ts").cast("timestamp"))
    # a quote id may come more than once; each row is a record of its own, numbered where the store will have it
    order = Window.partitionBy("bucket", "part", "quote_id").orderBy("at_us", "market_id", "selection_id")
    rows = store.dealt(f.quotes.select("quote_id", "market_id", "selection_id", at.alias("at_us")), F.col("quote_id"))
    numbered = rows.withColumn("id", F.concat_ws("#", "quote_id", F.row_number().over(order)))
    store.upsert({"quote": numbered.select("bucket", "part", "id", F.concat_ws(":", "market_id", "selection_id").alias("payload"), "at_us")})
    cutoff = 883_612_800_000_000  # 1998-01-01
    return store, store.purge("quote", cutoff, T.bridge(stored_opportunities(f)).select(F.col("quote_id").alias("id")))


@C.add("snk_retention", RETAIN)
def _(f):
    part = lambda k: F.split_part("payload", F.lit(":"), F.lit(k)).cast("bigint")
    return purged(f)[0].read("quote").select(F.substring_index("id", "#", 1).alias("quote_id"), part(1).alias("market_id"), part(2).alias("selection_id"))


@C.add("snk_retention_count", f"SELECT (SELECT count(*) FROM lineitem) - count(*) AS gone FROM ({RETAIN})")
def _(f):
    return f.spark.range(1).select(F.lit(purged(f)[1]).cast("bigint").alias("gone"))


@C.add("join_anti_retention", f"{BRIDGE}, u AS (SELECT DISTINCT unnest(quote_ids) AS quote_id FROM o) SELECT quote_id, market_id, selection_id FROM quotes ANTI JOIN u USING (quote_id)")
def _(f):
    return f.quotes.join(T.bridge(stored_opportunities(f)).select("quote_id"), "quote_id", "left_anti").select("quote_id", "market_id", "selection_id")


@C.add("cod_migrate", f"WITH {STREAM} SELECT quote_id AS id, provider_id, CASE WHEN quote_id::bigint % 3 = 0 THEN provider_id ELSE transport_id END AS transport_provider_id, CASE WHEN quote_id::bigint % 3 = 2 THEN 1 END AS set_index, 3 AS version FROM stream")
def _(f):
    v = F.col("quote_id").cast("bigint") % 3 + 1
    old = f.stream.select(F.col("quote_id").alias("id"), "provider_id", F.when(v > 1, F.col("transport_id")).alias("transport_provider_id"), F.lit(1).alias("set_index"), F.lit(None).cast("string").alias("subject_id"), v.alias("version"))
    return T.migrated(old).drop("subject_id")


@C.add("snk_migrate", f"WITH {STREAM} SELECT quote_id AS id, provider_id, CASE WHEN quote_id::bigint % 3 = 0 THEN provider_id ELSE transport_id END AS transport_provider_id, CASE WHEN quote_id::bigint % 3 = 2 THEN 1 END AS set_index, NULL::varchar AS subject_id, 3 AS version FROM stream")
def _(f):
    # files of three versions, each with the columns that its version had; the second run finds everything applied
    root, v = landing(f.spark, "records"), F.col("quote_id").cast("bigint") % 3 + 1
    rows = f.stream.select(F.col("quote_id").alias("id"), "provider_id", F.col("transport_id").alias("transport_provider_id"), F.lit(1).alias("set_index"), F.lit(None).cast("string").alias("subject_id"), v.cast("int").alias("version"))
    for version, lacks in ((1, ("transport_provider_id", "set_index", "subject_id")), (2, ("set_index", "subject_id")), (3, ())):
        rows.where(F.col("version") == version).drop(*lacks).write.mode("append").parquet(f"{root}/records")
    steps = M.Migrations(f.spark, root, M.STEPS)
    if steps.run() != [2, 3] or steps.run():
        raise RuntimeError("migrations are applied once")
    return steps.current().select("id", "provider_id", "transport_provider_id", "set_index", "subject_id", "version")


@C.add("cod_encode", f"""WITH {STREAM} SELECT quote_id, '{{"schema":3,"type":"quote","value":{{"cents":' || cents || ',"market_id":' || market_id || ',"status":"' || status || '"}}}}' AS encoded FROM stream""")
def _(f):
    return f.stream.select("quote_id", T.encoded("quote", "status", "market_id", "cents").alias("encoded"))


@C.add("cod_decode", f"WITH {STREAM} SELECT quote_id, CASE WHEN quote_id::bigint % 5 > 0 THEN cents END AS cents, CASE quote_id::bigint % 5 WHEN 0 THEN 'unknown_type' END AS issue FROM stream")
def _(f):
    good, other = T.encoded("quote", "cents", "status"), T.encoded("note", "cents", "status")
    text = F.when(F.col("quote_id").cast("bigint") % 5 == 0, other).otherwise(good)
    got = f.stream.select("quote_id", T.decoded(text, "quote", "cents bigint, status string", ("cents", "status")).alias("d"))
    return got.select("quote_id", F.col("d.value.cents").alias("cents"), F.col("d.issue").alias("issue"))


#: Entities that refer to each other: a book has a market and legs, a leg has a selection.
ENTITIES = {
    "book": {"id": "bigint", "market": "market", "legs": ["leg"]},
    "market": {"id": "bigint", "status": "string"},
    "leg": {"cents": "bigint", "selection": "selection"},
    "selection": {"id": "bigint"},
}


def nested(f):
    """The stream's quotes as nested books, as texts in which every seventh kind is broken in its own way."""
    leg = lambda extra: F.struct((F.col("cents") + extra).alias("cents"), F.struct((F.col("selection_id") + extra).alias("id")).alias("selection"))
    book = F.struct(F.col("quote_id").cast("bigint").alias("id"), F.struct(F.col("market_id").alias("id"), "status").alias("market"), F.array(leg(0), leg(1)).alias("legs"))
    text, k = K.encoded(book, "book", ENTITIES), F.col("quote_id").cast("bigint") % 7
    broken = (
        F.when(k == 1, F.replace(text, F.lit('"type":"selection"'), F.lit('"type":"runner"'))).when(k == 2, F.replace(text, F.lit('"status":'), F.lit('"note":1,"status":')))
        .when(k == 3, F.regexp_replace(text, '"schema":3,"type":"leg"', '"schema":2,"type":"leg"')).when(k == 4, F.substring(text, 1, 40))
        .when(k == 5, F.regexp_replace(text, '"cents":[0-9]+', '"cents":"many"')).otherwise(text)
    )
    return f.stream.select("quote_id", broken.alias("text"))


@C.add("cod_nested", f"""WITH {STREAM}, k AS (SELECT *, quote_id::bigint % 7 AS k FROM stream) SELECT quote_id, CASE WHEN k IN (0, 6) THEN status END AS status, CASE WHEN k IN (0, 6) THEN 2 * cents + 1 END AS cents,
  CASE WHEN k IN (0, 6) THEN selection_id + 1 END AS last_selection, CASE k WHEN 1 THEN 'unknown_type:$.legs[].selection' WHEN 2 THEN 'unexpected_keys:$.market' WHEN 3 THEN 'unsupported_schema:$.legs[]' WHEN 4 THEN 'malformed' WHEN 5 THEN 'wrong_kind:$.legs[].cents' END AS issue FROM k""")
def _(f):
    got = nested(f).select("quote_id", K.decoded(F.col("text"), "book", ENTITIES).alias("d"))
    legs = F.col("d.value.legs")
    return got.select("quote_id", F.col("d.value.market.status").alias("status"), F.aggregate(legs, F.lit(0).cast("bigint"), lambda a, x: a + x["cents"]).alias("cents"), F.get(legs, F.lit(1))["selection"]["id"].alias("last_selection"), F.col("d.issue").alias("issue"))


@C.add("snk_rest_page", f"{RANKED} SELECT market_id, selection_id, cents, (SELECT count(*) FROM best) AS total, true AS has_more FROM best ORDER BY market_id, selection_id LIMIT 20 OFFSET 40")
def _(f):
    return T.page(best(f).select("market_id", "selection_id", "cents"), ("market_id", "selection_id"), 40, 20)


@C.add("snk_rest_filters", f"{RANKED} SELECT market_id, selection_id, cents FROM best WHERE provider_id = 3")
def _(f):
    return f.spark.sql("SELECT market_id, selection_id, cents FROM {best} WHERE provider_id = :p", args={"p": 3}, best=best(f))


@C.add("snk_rest_dispatch", f"WITH {EVENTS} SELECT event_id, competition_id, (SELECT count(*) FROM dim_events WHERE competition_id = 2) AS total FROM dim_events WHERE competition_id = 2 ORDER BY event_id LIMIT 30 OFFSET 10")
def _(f):
    views = {"/events": f.events.select("event_id", "competition_id")}
    return T.dispatch("/events", {"competition_id": "2", "offset": "10", "limit": "30"}, views).drop("has_more")


@C.add("snk_openapi")
def _(f):
    return f.spark.createDataFrame([(json.dumps(T.openapi("1"), sort_keys=True),)], "document string")


@C.add("snk_html", f"SELECT c_custkey, '<article><h2>' || c_name || '</h2><p>&lt;a &amp; b&gt;</p></article>' AS card FROM customer")
def _(f):
    return f.table("customer").select("c_custkey", T.card(F.col("c_name"), F.lit("<a & b>")).alias("card"))
