"""Queries of gates, consolidation, books, evaluation and exchange portfolios."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import arbitrage as A
from ..operators import books as B
from ..operators import feeds
from ..operators import gates as G
from ..projection import AS_OF, EVENTS, QUOTES, WINDOW_DAYS, Catalogue, Frames
from .scalar_queries import BASE, KEYS, base

C = Catalogue()


def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


def window():
    return F.expr(f"INTERVAL '{WINDOW_DAYS}' DAY")


def active(f: Frames):
    return f.quotes.where("status = 'active'")


def best(f: Frames):
    return B.best_prices(active(f))


def full_books(f: Frames):
    return A.evaluated(B.books(best(f), 3))


RANKED = f"""WITH {QUOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY market_id, selection_id
  ORDER BY cents DESC, effective_ts DESC, provider_id, quote_id) AS k FROM quotes WHERE status = 'active'), best AS (SELECT * FROM r WHERE k = 1),
  book AS (SELECT market_id, count(*) AS n, min(effective_ts) AS oldest, max(effective_ts) AS newest,
    max(CASE WHEN selection_id = 0 THEN cents END)::hugeint AS a, max(CASE WHEN selection_id = 1 THEN cents END)::hugeint AS b,
    max(CASE WHEN selection_id = 2 THEN cents END)::hugeint AS c FROM best GROUP BY 1 HAVING count(*) = 3),
  e AS (SELECT *, 100 / a::double + 100 / b::double + 100 / c::double AS s, 100 * (a * b + b * c + a * c) < a * b * c AS arb FROM book)"""


@C.add("agg_best_price", f"{RANKED} SELECT market_id, selection_id, cents, provider_id, quote_id, effective_ts FROM best")
def _(f):
    return best(f)


@C.add("srt_top1", f"{RANKED} SELECT market_id, max(cents) AS top FROM best GROUP BY 1")
def _(f):
    return best(f).groupBy("market_id").agg(F.max("cents").alias("top"))


@C.add("agg_book", f"{RANKED} SELECT market_id, a::bigint AS a, b::bigint AS b, c::bigint AS c FROM book")
def _(f):
    price = lambda k: F.get("outcomes", F.lit(k))["cents"]
    return B.books(best(f), 3).select("market_id", price(0).alias("a"), price(1).alias("b"), price(2).alias("c"))


@C.add("agg_freshness_envelope", f"{RANKED} SELECT market_id, oldest, newest, date_diff('day', oldest, TIMESTAMP '{AS_OF}') AS max_age_days FROM book")
def _(f):
    return B.books(best(f), 3).select("market_id", "oldest", "newest", F.date_diff(now(), F.col("oldest")).cast("bigint").alias("max_age_days"))


@C.add("agg_implied_sum", f"{RANKED} SELECT market_id, round(s, 9) AS implied_sum FROM e")
def _(f):
    return full_books(f).select("market_id", F.round("implied_sum", 9).alias("implied_sum"))


@C.add("agg_return_multiplier", f"{RANKED} SELECT market_id, round(1 / s, 9) AS multiplier FROM e")
def _(f):
    return full_books(f).select("market_id", F.round("return_multiplier", 9).alias("multiplier"))


@C.add("agg_margin", f"{RANKED} SELECT market_id, round(1 / s - 1, 9) AS margin FROM e")
def _(f):
    return full_books(f).select("market_id", F.round("margin", 9).alias("margin"))


@C.add("agg_is_arbitrage", f"{RANKED} SELECT market_id, round(s, 9) AS implied_sum, arb AS is_arbitrage FROM e")
def _(f):
    return full_books(f).select("market_id", F.round("implied_sum", 9).alias("implied_sum"), "is_arbitrage")


@C.add("agg_evaluate_market", f"{RANKED} SELECT market_id, round(s, 9) AS implied_sum, round(1 / s, 9) AS multiplier, round(1 / s - 1, 9) AS margin, arb AND 1 / s - 1 >= 0.02 AS is_arbitrage FROM e")
def _(f):
    got = A.evaluated(B.books(best(f), 3), 0.02)
    return got.select("market_id", F.round("implied_sum", 9).alias("implied_sum"), F.round("return_multiplier", 9).alias("multiplier"), F.round("margin", 9).alias("margin"), "is_arbitrage")


@C.add(
    "agg_opportunity",
    f"""{RANKED}, ids AS (SELECT market_id, string_agg(quote_id, ',' ORDER BY selection_id) AS quote_ids FROM best GROUP BY 1)
    SELECT market_id, quote_ids, round(s, 9) AS implied_sum, round(1 / s - 1, 9) AS margin FROM e JOIN ids USING (market_id) WHERE arb""",
)
def _(f):
    got = A.opportunities(full_books(f))
    return got.select("market_id", F.array_join("quote_ids", ",").alias("quote_ids"), F.round("implied_sum", 9).alias("implied_sum"), F.round("margin", 9).alias("margin"))


@C.add(
    "agg_refundable",
    f"""WITH {BASE} SELECT l_orderkey, l_linenumber, round(1 / (1 / (cents / 100.0)::double + 1 / (1 + (qty / 10.0)::double)) - 1, 9) AS decisive,
    1.0::double AS refund, round(least(1 / (1 / (cents / 100.0)::double + 1 / (1 + (qty / 10.0)::double)), 1.0), 9) AS worst, false AS strict FROM b""",
)
def _(f):
    r = A.refundable(F.col("cents") / 100, 1 + F.col("qty") / 10)
    got = base(f).select(*KEYS, r.alias("r"))
    return got.select(*KEYS, F.round("r.decisive_margin", 9).alias("decisive"), F.col("r.refund_multiplier").alias("refund"), F.round("r.worst", 9).alias("worst"), F.col("r.strict").alias("strict"))


GATED = f"""WITH {QUOTES}, {EVENTS}, n AS (SELECT *, count(*) OVER (PARTITION BY quote_id) AS n FROM quotes),
  g AS (SELECT n.*, CASE WHEN n > 1 THEN 'duplicate_quote_id' WHEN d.event_id IS NULL THEN 'unknown_event' WHEN provider_id = 9 THEN 'provider_filtered'
    WHEN status <> 'active' THEN 'inactive_quote' WHEN effective_ts > TIMESTAMP '{AS_OF}' THEN 'future_ingestion'
    WHEN TIMESTAMP '{AS_OF}' - effective_ts > INTERVAL {WINDOW_DAYS} DAY THEN 'stale_quote' END AS issue FROM n LEFT JOIN
    (SELECT event_id FROM dim_events WHERE event_id % 11 <> 0) d ON d.event_id = n.event_id)"""


def gated(f: Frames):
    known = f.events.where("event_id % 11 <> 0").select("event_id", F.lit(True).alias("known_event"))
    joined = f.quotes.join(known, "event_id", "left").withColumn("known_event", F.coalesce("known_event", F.lit(False)))
    return B.quote_issues(joined, now(), window(), F.col("provider_id") != 9)


@C.add("join_registry", f"{GATED} SELECT quote_id, market_id, selection_id, issue FROM g")
def _(f):
    return gated(f).select("quote_id", "market_id", "selection_id", "issue")


@C.add("agg_book_diagnostics", f"{GATED} SELECT market_id, issue, count(*) AS n, min(quote_id) AS first_quote FROM g WHERE issue IS NOT NULL GROUP BY 1, 2")
def _(f):
    return B.diagnostics_by_market(gated(f))


@C.add("agg_dup_quote_id", f"WITH {QUOTES} SELECT quote_id, count(*) AS n, min(market_id) AS first_market FROM quotes GROUP BY 1 HAVING count(*) > 1")
def _(f):
    return f.quotes.groupBy("quote_id").agg(F.count("*").alias("n"), F.min("market_id").alias("first_market")).where("n > 1")


@C.add("flt_fresh", f"""WITH {QUOTES} SELECT quote_id, market_id, selection_id, cents FROM quotes WHERE status = 'active' AND effective_ts <= TIMESTAMP '{AS_OF}'
  AND TIMESTAMP '{AS_OF}' - effective_ts <= INTERVAL {WINDOW_DAYS} DAY""")
def _(f):
    return active(f).where((F.col("effective_ts") <= now()) & (now() - F.col("effective_ts") <= window())).select("quote_id", "market_id", "selection_id", "cents")


@C.add("flt_prematch", f"WITH {EVENTS} SELECT event_id, CASE WHEN scheduled_start <= TIMESTAMP '{AS_OF}' THEN 'event_not_prematch' END AS issue FROM dim_events")
def _(f):
    return f.events.select("event_id", F.when(F.col("scheduled_start") <= now(), "event_not_prematch").alias("issue"))


@C.add("flt_provider_policy", f"WITH {QUOTES} SELECT quote_id, market_id, selection_id FROM quotes WHERE provider_id IN (1, 2, 3, 4) AND provider_id NOT IN (4)")
def _(f):
    include = f.spark.createDataFrame([(1,), (2,), (3,), (4,)], "provider_id bigint")
    exclude = f.spark.createDataFrame([(4,)], "provider_id bigint")
    kept = f.quotes.join(F.broadcast(include), "provider_id", "left_semi").join(F.broadcast(exclude), "provider_id", "left_anti")
    return kept.select("quote_id", "market_id", "selection_id")


@C.add(
    "agg_consolidate",
    f"""WITH {QUOTES}, m AS (SELECT *, max(effective_ts) OVER (PARTITION BY provider_id, market_id, selection_id) AS top FROM quotes),
    t AS (SELECT *, row_number() OVER (PARTITION BY provider_id, market_id, selection_id ORDER BY transport_id, quote_id, cents, status) AS k FROM m WHERE effective_ts = top)
    SELECT provider_id, market_id, selection_id, any_value(top) AS effective_ts, count(*) AS n, count(DISTINCT (cents, status)) > 1 AS conflict,
      max(CASE WHEN k = 1 THEN quote_id END) AS quote_id FROM t GROUP BY 1, 2, 3""",
)
def _(f):
    return B.consolidate(f.quotes).select("provider_id", "market_id", "selection_id", "effective_ts", "n", "conflict", "quote_id")


@C.add(
    "agg_overlap_telemetry",
    f"""WITH {QUOTES}, m AS (SELECT *, max(effective_ts) OVER (PARTITION BY provider_id, market_id, selection_id) AS top FROM quotes),
    t AS (SELECT provider_id, count(*) AS n, count(DISTINCT (cents, status)) AS v FROM m WHERE effective_ts = top GROUP BY provider_id, market_id, selection_id)
    SELECT provider_id, count_if(n > 1 AND v = 1)::bigint AS equivalent, count_if(v > 1)::bigint AS conflicts FROM t GROUP BY 1""",
)
def _(f):
    c = B.consolidate(f.quotes)
    return c.groupBy("provider_id").agg(F.count_if((F.col("n") > 1) & ~F.col("conflict")).alias("equivalent"), F.count_if("conflict").alias("conflicts"))


@C.add("agg_book_issues", f"""{RANKED}, h AS (SELECT market_id, count(*) AS n FROM best GROUP BY 1), m AS (SELECT DISTINCT market_id FROM quotes)
  SELECT market_id, CASE WHEN coalesce(n, 0) < 2 THEN 'insufficient_outcomes' ELSE 'incomplete_market' END AS issue FROM m LEFT JOIN h USING (market_id) WHERE coalesce(n, 0) < 3""")
def _(f):
    held = best(f).groupBy("market_id").agg(F.count("*").alias("n"))
    every = f.quotes.select("market_id").distinct()
    n = F.coalesce("n", F.lit(0))
    return every.join(held, "market_id", "left").where(n < 3).select("market_id", F.when(n < 2, "insufficient_outcomes").otherwise("incomplete_market").alias("issue"))


@C.add("agg_coverage", f"""{RANKED}, h AS (SELECT market_id, count(*) AS n FROM best GROUP BY 1), m AS (SELECT DISTINCT market_id FROM quotes)
  SELECT count_if(coalesce(n, 0) = 3)::bigint AS complete, count_if(coalesce(n, 0) < 3)::bigint AS incomplete, sum(3 - coalesce(n, 0))::bigint AS missing_legs FROM m LEFT JOIN h USING (market_id)""")
def _(f):
    held = best(f).groupBy("market_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return f.quotes.select("market_id").distinct().join(held, "market_id", "left").agg(
        F.count_if(n == 3).alias("complete"), F.count_if(n < 3).alias("incomplete"), F.sum(3 - n).alias("missing_legs")
    )


@C.add("set_missing_selections", f"""WITH {QUOTES}, h AS (SELECT market_id, list_sort(list(DISTINCT selection_id)) AS have FROM quotes WHERE status = 'active' AND provider_id < 3 GROUP BY 1)
  SELECT market_id, array_to_string(list_filter([0, 1, 2], lambda x: NOT list_contains(have, x)), ',') AS missing FROM h""")
def _(f):
    have = active(f).where("provider_id < 3").groupBy("market_id").agg(F.collect_set("selection_id").alias("have"))
    expected = F.array(*[F.lit(k).cast("bigint") for k in range(3)])
    return have.select("market_id", F.array_join(F.array_except(expected, "have").cast("array<string>"), ",").alias("missing"))


@C.add("set_overlap_policy", f"WITH {QUOTES} SELECT market_id, provider_id AS clash FROM quotes WHERE cents > 300 INTERSECT SELECT market_id, provider_id FROM quotes WHERE status = 'suspended'")
def _(f):
    # a policy may not both include and exclude a provider
    include = f.quotes.where("cents > 300").select("market_id", F.col("provider_id").alias("clash"))
    return include.intersect(f.quotes.where("status = 'suspended'").select("market_id", F.col("provider_id").alias("clash")))


@C.add("set_feed_union", f"WITH {QUOTES} SELECT transport_id, quote_id, cents FROM quotes")
def _(f):
    feed = lambda k: f.quotes.where(F.col("transport_id") == k).select("transport_id", "quote_id", "cents")
    return feed(0).unionByName(feed(1))


@C.add("set_enablement_diff", "SELECT 7::bigint AS transport_id, 'not_configured' AS issue UNION ALL SELECT 1, 'not_enabled'")
def _(f):
    ids = lambda *x: f.spark.createDataFrame([(v,) for v in x], "transport_id bigint")
    configured, enabled, required = f.quotes.select("transport_id").distinct(), ids(0, 7), ids(0, 1)
    return (
        enabled.join(configured, "transport_id", "left_anti").withColumn("issue", F.lit("not_configured"))
        .unionByName(required.join(enabled, "transport_id", "left_anti").withColumn("issue", F.lit("not_enabled")))
    )


@C.add("set_union_candidates", f"WITH {QUOTES} SELECT DISTINCT market_id, provider_id FROM quotes WHERE cents > 300 OR status = 'suspended'")
def _(f):
    pick = lambda c: f.quotes.where(c).select("market_id", "provider_id")
    return pick("cents > 300").unionByName(pick("status = 'suspended'")).distinct()


@C.add("src_enablement", f"WITH {QUOTES} SELECT transport_id, count(*) AS n FROM quotes WHERE transport_id IN (0, 5) GROUP BY 1")
def _(f):
    allow = f.spark.createDataFrame([(0,), (5,)], "transport_id bigint")
    return f.quotes.join(F.broadcast(allow), "transport_id", "left_semi").groupBy("transport_id").agg(F.count("*").alias("n"))


@C.add("srt_total_orders", f"{RANKED} SELECT market_id, selection_id, quote_id, row_number() OVER (ORDER BY market_id, selection_id) AS place FROM best")
def _(f):
    # the order is global: ranges are counted first, so no single task sorts everything
    rows = best(f).select("market_id", "selection_id", "quote_id")
    lot = F.floor(F.col("market_id") / 100)
    sizes = rows.groupBy(lot.alias("lot")).count()
    before = sizes.select("lot", F.coalesce(F.sum("count").over(Window.orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("lot").orderBy("market_id", "selection_id"))
    return rows.withColumn("lot", lot).join(before, "lot").select("market_id", "selection_id", "quote_id", (inside + F.col("before")).alias("place"))


@C.add("srt_page", f"{RANKED} SELECT market_id, selection_id, quote_id FROM best ORDER BY market_id, selection_id LIMIT 50 OFFSET 100")
def _(f):
    return best(f).select("market_id", "selection_id", "quote_id").orderBy("market_id", "selection_id").offset(100).limit(50)


@C.add("srt_lru_cache", f"""WITH {QUOTES}, n AS (SELECT *, row_number() OVER (PARTITION BY market_id ORDER BY quote_id, cents) AS i, cents % 7 AS k FROM quotes),
  p AS (SELECT *, lag(i) OVER (PARTITION BY market_id, k ORDER BY i) AS j FROM n), b AS (SELECT p.market_id, p.i, count(DISTINCT x.k) AS between_ FROM p JOIN n x ON x.market_id = p.market_id AND x.i > p.j AND x.i < p.i GROUP BY 1, 2)
  SELECT quote_id, p.market_id, selection_id, j IS NOT NULL AND coalesce(between_, 0) < 3 AS hit FROM p LEFT JOIN b ON b.market_id = p.market_id AND b.i = p.i""")
def _(f):
    # decisions of a market are kept for the three latest kinds of evidence: a kind is held if fewer than three others came since
    at = F.concat_ws(" ", "quote_id", "cents")
    accesses = f.quotes.select(F.col("market_id").alias("cache"), at.alias("at"), (F.col("cents") % 7).alias("key"), "quote_id", "market_id", "selection_id")
    return feeds.least_recent(accesses, 3).select("quote_id", "market_id", "selection_id", "hit")


SUPPORT = """b2 AS (SELECT *, ['football', 'basketball', 'tennis', 'motorsport'][qty % 4 + 1] AS sport,
  ['match_winner_2_way', 'match_winner_3_way', 'total_points', 'both_teams_to_score', 'set_winner', 'game_winner', 'outright_winner', 'handicap'][cents % 8 + 1] AS kind,
  ['regulation', 'full_event', 'set', 'game'][l_partkey % 4 + 1] AS period, CASE WHEN l_suppkey % 5 > 0 THEN (qty % 41 - 20) / 4.0 END AS line,
  l_linenumber % 4 AS idx, CASE WHEN l_linenumber % 2 = 0 THEN 'settlement_aware' ELSE 'generic' END AS purpose FROM b)"""


def support_rows(f):
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    return base(f).select(
        *KEYS,
        pick(("football", "basketball", "tennis", "motorsport"), F.col("qty") % 4).alias("sport"),
        pick(("match_winner_2_way", "match_winner_3_way", "total_points", "both_teams_to_score", "set_winner", "game_winner", "outright_winner", "handicap"), F.col("cents") % 8).alias("kind"),
        pick(("regulation", "full_event", "set", "game"), F.col("l_partkey") % 4).alias("period"),
        F.when(F.col("l_suppkey") % 5 > 0, ((F.col("qty") % 41 - 20) / 4).cast("decimal(10,4)")).alias("line"),
        (F.col("l_linenumber") % 4).alias("idx"),
        F.when(F.col("l_linenumber") % 2 == 0, "settlement_aware").otherwise("generic").alias("purpose"),
    )


HALF = "coalesce(abs(line * 4) % 4 = 2, false)"


@C.add(
    "flt_market_support",
    f"""WITH {BASE}, {SUPPORT} SELECT l_orderkey, l_linenumber, CASE WHEN kind LIKE 'match_winner%' THEN true
    WHEN kind = 'total_points' THEN {HALF} AND line > 0 AND (sport = 'football' AND period = 'regulation' OR sport = 'basketball' AND period = 'full_event')
    WHEN kind = 'both_teams_to_score' THEN sport = 'football' AND period = 'regulation'
    WHEN kind = 'set_winner' THEN sport = 'tennis' AND period = 'set' AND idx IN (1, 2)
    WHEN kind = 'handicap' THEN sport = 'football' AND period = 'regulation' AND ({HALF} OR coalesce(line = 0, false) AND purpose = 'settlement_aware')
      OR sport = 'basketball' AND period = 'full_event' AND {HALF} ELSE false END AS supported FROM b2""",
)
def _(f):
    s = G.market_support(*[F.col(c) for c in ("sport", "kind", "period", "line", "idx", "purpose")])
    return support_rows(f).select(*KEYS, s.alias("supported"))


@C.add("flt_market_scope", f"WITH {BASE}, {SUPPORT} SELECT sport, count(*) AS n FROM b2 WHERE kind LIKE 'match_winner%' GROUP BY 1")
def _(f):
    s = G.market_support(*[F.col(c) for c in ("sport", "kind", "period", "line", "idx", "purpose")])
    return support_rows(f).where(s & F.col("kind").startswith("match_winner")).groupBy("sport").agg(F.count("*").alias("n"))


@C.add(
    "flt_model_invariants",
    f"""WITH {BASE}, {SUPPORT} SELECT l_orderkey, l_linenumber, CASE WHEN kind IN ('total_points', 'handicap') AND line IS NULL THEN 'line_required'
    WHEN kind NOT IN ('total_points', 'handicap') AND line IS NOT NULL THEN 'line_unexpected' WHEN period IN ('set', 'game') AND idx < 1 THEN 'period_index_required'
    WHEN period NOT IN ('set', 'game') THEN 'period_index_unexpected' WHEN period = 'game' THEN 'set_index_required'
    WHEN kind = 'set_winner' AND period <> 'set' THEN 'set_period_required' WHEN kind = 'game_winner' AND period <> 'game' THEN 'game_period_required' END AS issue FROM b2""",
)
def _(f):
    none = F.lit(None)
    issue = G.market_issue(F.col("kind"), F.col("period"), F.col("line"), F.col("idx"), none.cast("int"), none.cast("string"))
    return support_rows(f).select(*KEYS, issue.alias("issue"))


@C.add(
    "flt_outright_gate",
    f"""WITH {BASE}, g AS (SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN cents % 2 = 1 THEN 'candidate set is incomplete' END, CASE WHEN cents % 3 = 1 THEN 'candidate set is dynamic' END,
    CASE WHEN cents % 5 = 1 THEN 'outcomes are not mutually exclusive' END, CASE WHEN cents % 7 = 1 THEN 'outcomes are not exhaustive' END,
    CASE WHEN qty % 2 = 1 THEN 'field/other outcome is present' END, CASE WHEN qty % 3 = 1 THEN 'ties can produce non-exclusive settlement' END,
    CASE WHEN qty % 5 = 1 THEN 'dead-heat settlement can split returns' END, CASE WHEN qty % 7 = 1 THEN 'withdrawal settlement rules are not proven equivalent' END,
    CASE WHEN qty % 11 = 1 THEN 'void settlement rules are not proven equivalent' END], lambda x: x IS NOT NULL) AS list FROM b)
    SELECT l_orderkey, l_linenumber, len(list) = 0 AS eligible, array_to_string(list, ';') AS blockers FROM g""",
)
def _(f):
    c, q = F.col("cents"), F.col("qty")
    flags = dict(zip((x[1] for x in G.OUTRIGHT), (c % 2 != 1, c % 3 != 1, c % 5 != 1, c % 7 != 1, q % 2 == 1, q % 3 == 1, q % 5 == 1, q % 7 != 1, q % 11 != 1)))
    got = base(f).withColumns(flags).withColumn("list", G.outright_blockers())
    return got.select(*KEYS, (F.size("list") == 0).alias("eligible"), F.array_join("list", ";").alias("blockers"))


def exchange_rows(f):
    c = F.col("cents")
    return base(f).select(
        *KEYS,
        "cents",
        F.when(c % 7 == 0, "suspended").otherwise("active").alias("status"),
        F.when(c % 5 > 0, F.when(F.col("l_partkey") % 2 == 0, "back").otherwise("lay")).alias("side"),
        F.when(c % 6 > 0, F.col("qty")).alias("available"),
        F.when(c % 8 > 0, (c % 3 + 2) / 100).alias("rate"),
        F.when(c % 9 > 0, "account").alias("scope"),
        (c % 10 > 0).alias("rules_verified"),
    )


@C.add(
    "flt_exchange_gate",
    f"""WITH {BASE}, g AS (SELECT l_orderkey, l_linenumber, list_filter([CASE WHEN cents % 7 = 0 THEN 'price is not active' END, CASE WHEN cents % 5 = 0 THEN 'BACK/LAY side identity is missing' END,
    CASE WHEN cents % 6 = 0 THEN 'matched liquidity is missing' END, CASE WHEN cents % 8 = 0 THEN 'commission rate is missing' END,
    CASE WHEN cents % 9 = 0 THEN 'commission scope/account-market provenance is missing' END, CASE WHEN cents % 10 = 0 THEN 'settlement-rule equivalence is not verified' END],
    lambda x: x IS NOT NULL) AS list FROM b) SELECT l_orderkey, l_linenumber, len(list) = 0 AS eligible, array_to_string(list, ';') AS blockers FROM g""",
)
def _(f):
    got = exchange_rows(f).withColumn("list", G.exchange_blockers())
    return got.select(*KEYS, (F.size("list") == 0).alias("eligible"), F.array_join("list", ";").alias("blockers"))


@C.add("flt_exchange_price_valid", f"WITH {BASE} SELECT l_orderkey, l_linenumber, cents - 150 > 100 AND (cents % 6 = 0 OR qty - 3 > 0) AS valid FROM b")
def _(f):
    c = F.col("cents")
    ok = G.exchange_price_valid((c - 150) / 100, F.when(c % 6 > 0, F.col("qty") - 3), (c % 3 + 2) / 100)
    return base(f).select(*KEYS, ok.alias("valid"))


@C.add("flt_exchange_legs", f"""WITH {BASE} SELECT l_orderkey, l_linenumber, CASE WHEN qty % 20 = 0 THEN 'stake_not_positive' WHEN qty % 20 > qty THEN 'stake_over_available' WHEN cents % 7 = 0 THEN 'inactive' END AS issue,
  CASE WHEN l_partkey % 2 = 1 THEN qty % 20 * (cents - 100) ELSE qty % 20 * 100 END AS liability FROM b""")
def _(f):
    stake, c = F.col("qty") % 20, F.col("cents")
    issue = B.first_issue(("stake_not_positive", stake <= 0), ("stake_over_available", stake > F.col("qty")), ("inactive", c % 7 == 0))
    liability = F.when(F.col("l_partkey") % 2 == 1, stake * (c - 100)).otherwise(stake * 100)
    return base(f).select(*KEYS, issue.alias("issue"), liability.alias("liability"))


@C.add("flt_stake_inputs", f"""WITH {BASE} SELECT l_orderkey, l_linenumber, CASE WHEN cents % 11 - 1 < 0 THEN 'negative_minimum' WHEN qty % 9 < cents % 11 - 1 THEN 'maximum_below_minimum' WHEN cents % 4 = 0 THEN 'increment_not_positive'
  WHEN cents % 4 = 3 THEN 'increment_off_quantum' END AS issue FROM b""")
def _(f):
    low, high, inc = F.col("cents") % 11 - 1, F.col("qty") % 9, F.col("cents") % 4
    issue = B.first_issue(
        ("negative_minimum", low < 0), ("maximum_below_minimum", high < low), ("increment_not_positive", inc == 0), ("increment_off_quantum", inc == 3)
    )
    return base(f).select(*KEYS, issue.alias("issue"))


@C.add("flt_dashboard", f"{RANKED} SELECT market_id, round(1 / s - 1, 9) AS roi FROM e WHERE arb AND 1 / s - 1 >= 0.05 AND market_id IN (SELECT market_id FROM best WHERE provider_id = 3)")
def _(f):
    got = A.opportunities(full_books(f)).where((F.col("margin") >= 0.05) & F.exists("outcomes", lambda o: o["provider_id"] == 3))
    return got.select("market_id", F.round("margin", 9).alias("roi"))


@C.add("flt_readiness", f"""WITH {BASE} SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN cents % 2 = 0 THEN 'credentials' END, CASE WHEN qty % 2 = 0 THEN 'terms' END, CASE WHEN qty - cents % 50 < 5 THEN 'quota' END], lambda x: x IS NOT NULL), ';') AS blockers FROM b""")
def _(f):
    list_ = G.blockers(("credentials", F.col("cents") % 2 == 0), ("terms", F.col("qty") % 2 == 0), ("quota", F.col("qty") - F.col("cents") % 50 < 5))
    return base(f).select(*KEYS, F.array_join(list_, ";").alias("blockers"))


@C.add("flt_attestation", f"""WITH {BASE}, a AS (SELECT l_orderkey, CASE WHEN cents % 4 > 0 THEN 'doc' || l_linenumber END AS source, CASE WHEN qty % 5 = 0 THEN 'no' WHEN qty % 5 < 4 THEN 'yes' END AS claim FROM b)
  SELECT l_orderkey, CASE WHEN count_if(source IS NOT NULL AND claim IS NOT NULL)::bigint < count(*) THEN 'incomplete' WHEN min(claim) <> max(claim) THEN 'conflict' ELSE 'complete' END AS review FROM a GROUP BY 1""")
def _(f):
    q = F.col("qty") % 5
    claims = base(f).select("l_orderkey", F.when(F.col("cents") % 4 > 0, F.concat(F.lit("doc"), F.col("l_linenumber").cast("string"))).alias("source"), F.when(q == 0, "no").when(q < 4, "yes").alias("claim"))
    return G.attested(claims, "l_orderkey")


RULES = """r AS (SELECT s_suppkey % 10 AS provider_id, ['back', 'lay'][s_suppkey % 2 + 1] AS side, TIMESTAMP '1992-01-01' + to_days((s_suppkey % 5)::int * 400) AS since, s_suppkey % 4 < 3 AS equivalent FROM supplier),
  t AS (SELECT provider_id, side, since, bool_and(equivalent) AS equivalent FROM r GROUP BY 1, 2, 3)"""


@C.add("flt_bookmaker_rules", f"""WITH {QUOTES}, {RULES}, q AS (SELECT *, CASE WHEN cents % 2 = 0 THEN 'back' ELSE 'lay' END AS side FROM quotes),
  m AS (SELECT q.provider_id, equivalent FROM q ASOF LEFT JOIN t ON t.provider_id = q.provider_id AND t.side = q.side AND t.since <= q.effective_ts)
  SELECT provider_id, count_if(equivalent IS NULL)::bigint AS open, count_if(equivalent)::bigint AS reviewed, count_if(NOT equivalent)::bigint AS refused FROM m GROUP BY 1""")
def _(f):
    k = F.col("s_suppkey")
    since = F.lit("1992-01-01").cast("timestamp_ntz") + F.make_dt_interval((k % 5).cast("int") * 400)
    rows = f.table("supplier").select((k % 10).alias("provider_id"), F.when(k % 2 == 0, "back").otherwise("lay").alias("side"), since.alias("since"), (k % 4 < 3).alias("equivalent"))
    rules = rows.groupBy("provider_id", "side", "since").agg(F.bool_and("equivalent").alias("equivalent"))
    quotes = f.quotes.select("provider_id", "effective_ts", F.when(F.col("cents") % 2 == 0, "back").otherwise("lay").alias("side"))
    return G.ruled(quotes, rules).groupBy("provider_id").agg(
        F.count_if(F.col("equivalent").isNull()).alias("open"), F.count_if("equivalent").alias("reviewed"), F.count_if(~F.col("equivalent")).alias("refused")
    )


@C.add("flt_event_window", f"WITH {EVENTS} SELECT event_id, scheduled_start FROM dim_events WHERE scheduled_start BETWEEN TIMESTAMP '2000-01-01' AND TIMESTAMP '{AS_OF}'")
def _(f):
    return f.events.where(F.col("scheduled_start").between(F.lit("2000-01-01").cast("timestamp_ntz"), now())).select("event_id", "scheduled_start")


LEGS = f"""{QUOTES}, legs AS (SELECT market_id, selection_id, CASE WHEN cents % 2 = 0 THEN 'back' ELSE 'lay' END AS side, cents, 1 + cents % 9 AS stake,
  CASE WHEN provider_id % 3 > 0 THEN provider_id % 3 END AS exchange_id, CASE WHEN provider_id % 3 > 0 THEN 'm' || (cents % 2) END AS scope, (2 + provider_id % 3) AS rate,
  transport_id, 20 + cents % 5 AS available FROM quotes WHERE status = 'active')"""


def legs(f):
    c, p = F.col("cents"), F.col("provider_id") % 3
    return active(f).select(
        "market_id", "selection_id", F.when(c % 2 == 0, "back").otherwise("lay").alias("side"),
        (c / 100).cast("decimal(10,2)").alias("price"), (1 + c % 9).cast("decimal(10,2)").alias("stake"),
        F.when(p > 0, p).alias("exchange_id"), F.when(p > 0, F.concat(F.lit("m"), (c % 2).cast("string"))).alias("scope"),
        ((2 + p) / 100).cast("decimal(4,2)").alias("rate"), "transport_id", (20 + c % 5).cast("decimal(10,2)").alias("available"),
    )


@C.add(
    "agg_exchange_scenarios",
    f"""WITH {LEGS}, w AS (SELECT DISTINCT market_id, selection_id AS winner FROM legs), p AS (SELECT market_id, winner, exchange_id, scope, max(rate) AS rate,
      sum(CASE WHEN side = 'back' THEN CASE WHEN selection_id = winner THEN stake * (cents - 100) ELSE -stake * 100 END
        ELSE CASE WHEN selection_id = winner THEN -stake * (cents - 100) ELSE stake * 100 END END) AS g FROM legs JOIN w USING (market_id) GROUP BY ALL)
    SELECT market_id, winner, sum(g)::bigint AS gross, sum(CASE WHEN exchange_id IS NOT NULL AND g > 0 THEN g * rate ELSE 0 END)::bigint AS commission FROM p GROUP BY 1, 2""",
)
def _(f):
    rows = legs(f)
    winners = rows.select("market_id", F.col("selection_id").alias("winner")).distinct()
    out = A.scenario_profit(rows, winners)
    return out.select("market_id", "winner", (F.col("gross") * 100).cast("bigint").alias("gross"), (F.col("commission") * 10000).cast("bigint").alias("commission"))


@C.add("agg_exchange_liquidity", f"""WITH {LEGS} SELECT market_id, selection_id, exchange_id, transport_id, side, cents, scope, sum(3 * stake)::bigint AS used, min(available) AS available FROM legs GROUP BY ALL HAVING sum(3 * stake) > min(available)""")
def _(f):
    out = A.liquidity_overuse(legs(f).withColumn("stake", F.col("stake") * 3))  # stakes of 3 to 27 against 20 to 24 available
    return out.select("market_id", "selection_id", "exchange_id", "transport_id", "side", (F.col("price") * 100).cast("bigint").alias("cents"), "scope", F.col("used").cast("bigint").alias("used"), F.col("limit").cast("bigint").alias("available"))


@C.add("agg_exchange_rate_conflict", f"WITH {QUOTES} SELECT market_id, provider_id % 3 AS exchange_id, 'm' AS scope, min(provider_id)::bigint AS low, max(provider_id)::bigint AS high FROM quotes GROUP BY 1, 2 HAVING min(provider_id) <> max(provider_id)")
def _(f):
    rows = f.quotes.select("market_id", (F.col("provider_id") % 3).alias("exchange_id"), F.lit("m").alias("scope"), F.col("provider_id").alias("rate"))
    return A.rate_conflicts(rows)
