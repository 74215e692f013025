"""Queries of identity resolution, event matching, registry integrity, stakes and lifecycle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import arbitrage as A
from ..operators import books as B
from ..operators import identity as I
from ..operators import stakes as K
from ..projection import EVENTS, QUOTES, Catalogue, Frames
from .book_queries import RANKED, best, full_books
from .scalar_queries import BASE, KEYS, base

C = Catalogue()

#: Alias rows from customer: generic for most, provider 1 shadows some, some aliases are shared by two ids.
ALIASES = """al AS (SELECT 'k' || (c_custkey // 2) AS alias, c_custkey AS canonical_id, CASE WHEN c_custkey % 5 = 0 THEN 1 END AS provider_id,
  CASE WHEN c_custkey % 3 = 0 THEN 'r' || (c_custkey % 2) END AS region, CASE WHEN c_custkey % 7 = 0 THEN 's1' END AS season FROM customer WHERE c_custkey % 11 <> 0),
  ks AS (SELECT c_custkey AS row_id, 'k' || (c_custkey * 3 // 4) AS alias, c_custkey % 2 AS provider_id, 'r' || (c_custkey % 2) AS region, 's2' AS season FROM customer)"""


def aliases(f):
    k = F.col("c_custkey")
    return f.table("customer").where("c_custkey % 11 <> 0").select(
        F.concat(F.lit("k"), F.floor(k / 2).cast("string")).alias("alias"), k.alias("canonical_id"), F.when(k % 5 == 0, F.lit(1)).cast("bigint").alias("provider_id"),
        F.when(k % 3 == 0, F.concat(F.lit("r"), (k % 2).cast("string"))).alias("region"), F.when(k % 7 == 0, "s1").alias("season"),
    )


def alias_keys(f):
    k = F.col("c_custkey")
    return f.table("customer").select(
        k.alias("row_id"), F.concat(F.lit("k"), F.floor(k * 3 / 4).cast("string")).alias("alias"), (k % 2).alias("provider_id"),
        F.concat(F.lit("r"), (k % 2).cast("string")).alias("region"), F.lit("s2").alias("season"),
    )


def alias_sql(conflict: str) -> str:
    return f"""WITH {ALIASES}, m AS (SELECT row_id, canonical_id, a.provider_id IS NOT NULL AS specific, {conflict} AS out FROM ks JOIN al a ON a.alias = ks.alias AND (a.provider_id IS NULL OR a.provider_id = ks.provider_id)),
    t AS (SELECT *, max(specific) OVER (PARTITION BY row_id) AS top FROM m), h AS (SELECT row_id, list(DISTINCT canonical_id) FILTER (NOT out) AS ids FROM t WHERE specific = top GROUP BY 1)
    SELECT ks.row_id, CASE WHEN h.row_id IS NULL THEN 'unknown' WHEN coalesce(len(ids), 0) = 0 THEN 'conflict' WHEN len(ids) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
    CASE WHEN len(ids) = 1 THEN ids[1] END AS canonical_id FROM ks LEFT JOIN h USING (row_id)"""


REGION, SEASON = "coalesce(a.region <> ks.region, false)", "coalesce(a.season <> ks.season, false)"


@C.add("join_alias_sport", alias_sql("false"))
def _(f):
    return I.resolve(alias_keys(f), aliases(f))


@C.add("join_alias_competition", alias_sql(f"({REGION} OR {SEASON})"))
def _(f):
    return I.resolve(alias_keys(f), aliases(f), ("region", "season"))


@C.add("join_alias_participant", alias_sql(REGION))
def _(f):
    return I.resolve(alias_keys(f), aliases(f), ("region",))


@C.add("join_alias_market", alias_sql(SEASON))
def _(f):
    return I.resolve(alias_keys(f), aliases(f), ("season",))


@C.add("join_identity_hooks", f"WITH {QUOTES}, mp AS (SELECT market_id AS s, market_id + 1000000 AS c FROM (SELECT DISTINCT market_id FROM quotes) WHERE market_id % 3 > 0) SELECT quote_id, selection_id, c AS canonical_market_id FROM quotes LEFT JOIN mp ON s = market_id")
def _(f):
    mapping = f.quotes.select("market_id").distinct().where("market_id % 3 > 0").withColumn("canonical_market_id", F.col("market_id") + 1_000_000)
    return f.quotes.join(mapping, "market_id", "left").select("quote_id", "selection_id", "canonical_market_id")


#: Source evidence: each event seen by a feed with a shifted kickoff, some with metadata, references or wrong teams.
EVIDENCE = """ev AS (SELECT event_id AS source_id, CASE WHEN event_id % 29 = 0 THEN 'curling' ELSE sport END AS sport, CASE WHEN event_id % 23 = 0 THEN 99 ELSE competition_id END AS competition_id,
  CASE WHEN event_id % 19 = 0 THEN 'x' ELSE array_to_string(list_sort([home_id::varchar, away_id::varchar]), '|') END AS participants,
  epoch_us(scheduled_start) + (event_id % 41) * 60000000 AS start_us, CASE WHEN event_id % 3 = 0 THEN 'final' END AS stage, CASE WHEN event_id % 4 = 0 THEN 'park' END AS venue, 'x' || event_id AS external_id FROM dim_events),
  ce AS (SELECT event_id, sport, competition_id, array_to_string(list_sort([home_id::varchar, away_id::varchar]), '|') AS participants, epoch_us(scheduled_start) AS start_us,
  CASE WHEN event_id % 6 = 0 THEN 'final' WHEN event_id % 6 = 3 THEN 'semi' END AS stage, CASE WHEN event_id % 8 = 0 THEN 'park' END AS venue,
  CASE WHEN event_id % 10 = 0 THEN 'x' || event_id WHEN event_id % 10 = 5 THEN 'y' END AS external_id FROM dim_events)"""


def evidence(f):
    i = F.col("event_id")
    us = F.unix_micros(F.col("scheduled_start").cast("timestamp"))
    return f.events.select(
        i.alias("source_id"), F.when(i % 29 == 0, "curling").otherwise(F.col("sport")).alias("sport"), F.when(i % 23 == 0, 99).otherwise(F.col("competition_id")).alias("competition_id"),
        F.when(i % 19 == 0, "x").otherwise(I.participant_key(F.col("home_id"), F.col("away_id"))).alias("participants"), (us + (i % 41) * 60_000_000).alias("start_us"),
        F.when(i % 3 == 0, "final").alias("stage"), F.when(i % 4 == 0, "park").alias("venue"), F.concat(F.lit("x"), i.cast("string")).alias("external_id"),
    )


def canonical(f):
    i = F.col("event_id")
    return f.events.select(
        "event_id", "sport", "competition_id", I.participant_key(F.col("home_id"), F.col("away_id")).alias("participants"), F.unix_micros(F.col("scheduled_start").cast("timestamp")).alias("start_us"),
        F.when(i % 6 == 0, "final").when(i % 6 == 3, "semi").alias("stage"), F.when(i % 8 == 0, "park").alias("venue"),
        F.when(i % 10 == 0, F.concat(F.lit("x"), i.cast("string"))).when(i % 10 == 5, "y").alias("external_id"),
    )


SCORED = f"""WITH {EVENTS}, {EVIDENCE}, m AS (SELECT source_id, event_id, abs(ev.start_us - ce.start_us) AS delta_us, coalesce(ce.external_id = ev.external_id, false) AS exact, ev.stage IS NOT NULL AND ce.stage IS NOT NULL AS st,
  ev.venue IS NOT NULL AND ce.venue IS NOT NULL AS ve, coalesce(ev.stage <> ce.stage, false) OR coalesce(ev.venue <> ce.venue, false) AS bad, ce.external_id AS ref
  FROM ev JOIN ce USING (sport, competition_id, participants)), w AS (SELECT *, CASE WHEN exact THEN 172800000000 ELSE 1800000000 END AS tol FROM m WHERE NOT bad AND (ref IS NULL OR exact)),
  sc AS (SELECT source_id, event_id, least(10000, 7000 + (2000 * (tol - delta_us)) // tol + st::int * 400 + ve::int * 300 + exact::int * 1000)::bigint AS points, delta_us FROM w WHERE delta_us <= tol),
  ok AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY points DESC, delta_us, event_id) AS r, max(points) OVER (PARTITION BY source_id) AS top FROM sc WHERE points >= 8500),
  d AS (SELECT source_id, count_if(top - points <= 250)::bigint AS near, max(CASE WHEN r = 1 THEN event_id END) AS event_id, max(top) AS points FROM ok GROUP BY 1),
  dec AS (SELECT ev.source_id, CASE WHEN d.source_id IS NULL THEN 'rejected' WHEN near > 1 THEN 'ambiguous' ELSE 'matched' END AS status,
    CASE WHEN near = 1 THEN event_id END AS event_id, CASE WHEN near = 1 THEN points END AS points FROM ev LEFT JOIN d USING (source_id))"""


@C.add("join_event_match", f"{SCORED} SELECT * FROM dec")
def _(f):
    e = evidence(f)
    return I.decisions(e, I.candidates(e, canonical(f)))


@C.add("srt_candidates", f"{SCORED} SELECT source_id, event_id, points, delta_us, row_number() OVER (PARTITION BY source_id ORDER BY points DESC, delta_us, event_id) AS place FROM sc")
def _(f):
    w = Window.partitionBy("source_id").orderBy(F.desc("points"), "delta_us", "event_id")
    return I.candidates(evidence(f), canonical(f)).withColumn("place", F.row_number().over(w).cast("bigint"))


@C.add("join_event_match_key", f"WITH {EVENTS}, {EVIDENCE} SELECT source_id, count(event_id) AS n FROM ev LEFT JOIN ce USING (sport, competition_id, participants) GROUP BY 1")
def _(f):
    met = evidence(f).join(canonical(f).select("sport", "competition_id", "participants", "event_id"), ["sport", "competition_id", "participants"], "left")
    return met.groupBy("source_id").agg(F.count("event_id").alias("n"))


@C.add("join_hard_filter_reason", f"""WITH {EVENTS}, {EVIDENCE} SELECT source_id, CASE WHEN sport NOT IN (SELECT sport FROM ce) THEN 'sport_mismatch' WHEN (sport, competition_id) NOT IN (SELECT (sport, competition_id) FROM ce) THEN 'competition_mismatch'
  WHEN (sport, competition_id, participants) NOT IN (SELECT (sport, competition_id, participants) FROM ce) THEN 'participant_mismatch' END AS reason FROM ev""")
def _(f):
    return I.missing_stage(evidence(f), canonical(f))


@C.add("join_event_match_exhaustive", f"""WITH {EVENTS}, {EVIDENCE}, x AS (SELECT * FROM ev) SELECT source_id, count_if(x.sport <> ce.sport)::bigint AS sport_mismatch,
  count_if(x.sport = ce.sport AND x.competition_id <> ce.competition_id)::bigint AS competition_mismatch, count_if(x.sport = ce.sport AND x.competition_id = ce.competition_id AND x.participants <> ce.participants)::bigint AS participant_mismatch FROM x, ce GROUP BY 1""")
def _(f):
    # every event is scored against every queried one; equal hard keys are counted first, so the rows that meet are groups
    queried = evidence(f).select("source_id", "sport", "competition_id", "participants")
    groups = canonical(f).groupBy("sport", "competition_id", "participants").agg(F.count("*").alias("n"))
    by_comp = groups.groupBy("sport", "competition_id").agg(F.sum("n").alias("nc"))
    by_sport = groups.groupBy("sport").agg(F.sum("n").alias("ns"))
    total = groups.agg(F.sum("n").alias("nt")).scalar()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = queried.join(by_sport, "sport", "left").join(by_comp, ["sport", "competition_id"], "left").join(groups, ["sport", "competition_id", "participants"], "left").withColumn("nt", total)
    return out.select("source_id", (F.col("nt") - zero("ns")).alias("sport_mismatch"), (zero("ns") - zero("nc")).alias("competition_mismatch"), (zero("nc") - zero("n")).alias("participant_mismatch"))


@C.add("join_matched_hooks", f"{SCORED} SELECT source_id, event_id FROM dec WHERE status = 'matched'")
def _(f):
    e = evidence(f)
    return I.decisions(e, I.candidates(e, canonical(f))).where("status = 'matched'").select("source_id", "event_id")


@C.add("win_ambiguity_margin", f"{SCORED} SELECT source_id, event_id, top - points AS behind FROM ok WHERE top - points <= 250")
def _(f):
    ok = I.candidates(evidence(f), canonical(f)).where(F.col("points") >= I.LEAST_POINTS)
    behind = F.max("points").over(Window.partitionBy("source_id")) - F.col("points")
    return ok.select("source_id", "event_id", behind.alias("behind")).where(F.col("behind") <= I.MARGIN_POINTS)


@C.add("join_event_evidence", f"""WITH {EVENTS}, r AS (SELECT event_id, home_id % 11 <> 0 AS h, away_id % 11 <> 0 AS a, competition_id <> 4 AS c, home_id, away_id FROM dim_events)
  SELECT event_id, CASE WHEN NOT c THEN 'unresolved_competition' WHEN NOT (h AND a) THEN 'unresolved_participant' END AS issue, CASE WHEN c AND h AND a THEN home_id || ',' || away_id END AS participants FROM r""")
def _(f):
    known = f.table("customer").where("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("pid"))
    sides = f.events.select("event_id", "competition_id", F.posexplode(F.array("home_id", "away_id")).alias("pos", "pid"))
    met = sides.join(known.withColumn("ok", F.lit(True)), "pid", "left")
    got = met.groupBy("event_id", "competition_id").agg(F.count("ok").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "pid"))).alias("p"))
    bad = F.when(F.col("competition_id") == 4, "unresolved_competition").when(F.col("n") < 2, "unresolved_participant")
    names = F.concat_ws(",", F.get("p", F.lit(0))["pid"], F.get("p", F.lit(1))["pid"])
    return got.select("event_id", bad.alias("issue"), F.when(bad.isNull(), names).alias("participants"))


#: Two feeds that list every event: the right one under shifted ids, some minutes later, some with the sides changed or one side unlike.
PAIRS = """l AS (SELECT event_id AS id, home_id % 50 AS h, away_id % 50 AS a, epoch_us(scheduled_start) AS t FROM dim_events),
  r AS (SELECT event_id + 1000000000 AS id, CASE WHEN event_id % 3 = 0 THEN away_id % 50 ELSE home_id % 50 END AS h, CASE WHEN event_id % 3 = 0 THEN home_id % 50 ELSE away_id % 50 END AS a, epoch_us(scheduled_start) + (event_id % 8) * 60000000 AS t FROM dim_events),
  m AS (SELECT l.id AS left_id, r.id AS right_id, l.h AS lh, l.a AS la, r.h AS rh, r.a AS ra FROM l JOIN r ON array_to_string(list_sort([l.h::varchar, l.a::varchar]), '|') = array_to_string(list_sort([r.h::varchar, r.a::varchar]), '|') AND abs(l.t - r.t) <= 300000000),
  u AS (SELECT * FROM m WHERE left_id IN (SELECT left_id FROM m GROUP BY 1 HAVING count(*) = 1) AND right_id IN (SELECT right_id FROM m GROUP BY 1 HAVING count(*) = 1))"""


def pair_sides(f):
    i, us = F.col("event_id"), F.unix_micros(F.col("scheduled_start").cast("timestamp"))
    h, a = F.col("home_id") % 50, F.col("away_id") % 50
    left = f.events.select(i.alias("id"), h.alias("h"), a.alias("a"), us.alias("start_us"))
    right = f.events.select((i + 1_000_000_000).alias("id"), F.when(i % 3 == 0, a).otherwise(h).alias("h"), F.when(i % 3 == 0, h).otherwise(a).alias("a"), (us + (i % 8) * 60_000_000).alias("start_us"))
    keyed = lambda df: df.withColumn("key", I.participant_key(F.col("h"), F.col("a")))
    return keyed(left), keyed(right)


@C.add("join_candidate_pairs", f"WITH {EVENTS}, {PAIRS} SELECT left_id, right_id FROM u")
def _(f):
    return I.unique_pairs(*pair_sides(f), 300_000_000)


@C.add("join_identity_review", f"WITH {EVENTS}, {PAIRS} SELECT left_id, right_id, CASE WHEN lh = la OR rh = ra THEN 'conflict' WHEN lh = rh AND la = ra THEN 'aligned' WHEN lh = ra AND la = rh THEN 'reversed' ELSE 'conflict' END AS orientation FROM u")
def _(f):
    left, right = pair_sides(f)
    side = lambda df, n: df.select(F.col("id").alias(f"{n}_id"), F.col("h").alias(f"{n}_h"), F.col("a").alias(f"{n}_a"))
    j = I.unique_pairs(left, right, 300_000_000).join(side(left, "left"), "left_id").join(side(right, "right"), "right_id")
    from ..functions.scalars import fixture_order

    return j.select("left_id", "right_id", fixture_order(*[F.col(c) for c in ("left_h", "left_a", "right_h", "right_a")]).alias("orientation"))


@C.add("join_official_anchor", f"""WITH {EVENTS}, {EVIDENCE}, c AS (SELECT competition_id, epoch_us(scheduled_start) AS start_us, count(*) AS n, min(event_id) AS event_id FROM dim_events GROUP BY 1, 2)
  SELECT source_id, CASE WHEN n = 1 THEN c.event_id END AS event_id, CASE WHEN n IS NULL THEN 'no_official_event' WHEN n > 1 THEN 'several_official_events' ELSE 'anchored' END AS status FROM ev LEFT JOIN c ON c.competition_id = ev.competition_id AND c.start_us = ev.start_us""")
def _(f):
    official = f.events.select("competition_id", F.unix_micros(F.col("scheduled_start").cast("timestamp")).alias("start_us"), "event_id")
    return I.anchored(evidence(f), official)


NORMAL = f"""WITH {QUOTES}, {EVENTS}, j AS (SELECT q.*, d.event_id AS known FROM quotes q LEFT JOIN (SELECT event_id FROM dim_events WHERE event_id % 13 <> 0) d USING (event_id))
  SELECT quote_id, market_id, selection_id, CASE WHEN known IS NULL THEN 'unknown_event' WHEN market_id % 17 = 0 THEN 'unknown_market' WHEN market_id % 7 = 0 AND provider_id % 2 = 0 THEN 'market_parameter_mismatch'
  WHEN cents % 19 = 0 THEN 'malformed_price' END AS issue FROM j"""


@C.add("join_normalize", NORMAL)
def _(f):
    known = f.events.where("event_id % 13 <> 0").select("event_id", F.lit(True).alias("known"))
    market = f.quotes.select("market_id").distinct().where("market_id % 17 <> 0").withColumn("line", F.when(F.col("market_id") % 7 != 0, F.lit(0.5)))
    j = f.quotes.withColumn("source_line", F.when((F.col("market_id") % 7 != 0) | (F.col("provider_id") % 2 == 0), F.lit(0.5)))
    j = j.join(known, "event_id", "left").join(market.withColumn("market_known", F.lit(True)), "market_id", "left")
    price = F.when(F.col("cents") % 19 == 0, F.lit("n/a")).otherwise((F.col("cents") / 100).cast("string"))
    from ..functions.scalars import odds_issue_and_price

    issue = B.first_issue(
        ("unknown_event", F.col("known").isNull()),
        ("unknown_market", F.col("market_known").isNull()),
        ("market_parameter_mismatch", ~F.col("line").eqNullSafe(F.col("source_line"))),
        ("malformed_price", odds_issue_and_price(price, F.lit("decimal"))["issue"].isNotNull()),
    )
    return j.select("quote_id", "market_id", "selection_id", issue.alias("issue"))


# ---- registry integrity

SEL = """mk AS (SELECT event_id AS market_id, home_id, away_id, event_id % 8 AS k FROM dim_events), sel AS (SELECT market_id, home_id, away_id, k, unnest(CASE WHEN k = 0 THEN ['over', 'under', 'over'] WHEN k = 1 THEN ['yes'] WHEN k = 2 THEN ['yes', 'no']
  WHEN k = 3 THEN ['home', 'away'] ELSE ['over', 'under'] END) AS kind FROM mk)"""


def selections(f):
    k = F.col("event_id") % 8
    lit = lambda *x: F.array(*map(F.lit, x))
    kinds = F.when(k == 0, lit("over", "under", "over")).when(k == 1, lit("yes")).when(k == 2, lit("yes", "no")).when(k == 3, lit("home", "away")).otherwise(lit("over", "under"))
    return f.events.select(F.col("event_id").alias("market_id"), F.explode(kinds).alias("kind"), F.when(F.col("event_id") % 31 == 0, F.lit(0.5)).alias("handicap"))


def outcome_sql(*kinds: str) -> str:
    each = " AND ".join(f"count_if(kind = '{k}')::bigint = 1" for k in kinds)
    return f"WITH {EVENTS}, {SEL} SELECT market_id, count(*) = {len(kinds)} AND market_id % 31 <> 0 AND {each} AS ok FROM sel GROUP BY 1"


for _name, _kinds in (("reg_totals", ("over", "under")), ("reg_btts", ("yes", "no")), ("reg_set_winner", ("home", "away")), ("reg_game_winner", ("home", "away"))):
    C.add(_name, outcome_sql(*_kinds))(lambda f, kinds=_kinds: I.exact_outcomes(selections(f), kinds))


@C.add("reg_unique_ids", f"WITH {QUOTES} SELECT quote_id, count(*) AS n FROM quotes GROUP BY 1 HAVING count(*) > 1")
def _(f):
    return I.repeated(f.quotes, "quote_id")


@C.add("reg_fk", f"WITH {QUOTES}, {EVENTS} SELECT event_id, count(*) AS n FROM quotes WHERE event_id NOT IN (SELECT event_id FROM dim_events WHERE event_id % 9 <> 0) GROUP BY 1")
def _(f):
    return I.orphans(f.quotes, f.events.where("event_id % 9 <> 0"), "event_id").groupBy("event_id").agg(F.count("*").alias("n"))


@C.add("reg_outright", f"WITH {QUOTES} SELECT market_id, count(*) AS n, count(DISTINCT provider_id) = count(*) AND count(*) >= 2 AS ok FROM quotes GROUP BY 1")
def _(f):
    per = f.quotes.groupBy("market_id", "provider_id").agg(F.count("*").alias("m"))
    g = per.groupBy("market_id").agg(F.sum("m").alias("n"), F.max("m").alias("most"))
    return g.select("market_id", "n", ((F.col("most") == 1) & (F.col("n") >= 2)).alias("ok"))


@C.add("reg_podium", f"WITH {EVENTS} SELECT event_id, event_id % 3 <> 2 AND event_id % 8 = 2 AS ok FROM dim_events")
def _(f):
    yes_no = I.exact_outcomes(selections(f).withColumn("handicap", F.lit(None).cast("double")), ("yes", "no"))
    k = F.col("event_id") % 3
    subject = f.events.select("event_id", F.when(k == 0, F.col("home_id")).when(k == 1, F.col("away_id")).otherwise(F.lit(-1)).alias("subject"), "home_id", "away_id")
    j = subject.join(yes_no.withColumnRenamed("market_id", "event_id"), "event_id")
    inside = (F.col("subject") == F.col("home_id")) | (F.col("subject") == F.col("away_id"))
    return j.select("event_id", (inside & F.col("ok")).alias("ok"))


H2H = """s AS (SELECT event_id, home_id, away_id, unnest(CASE event_id % 7 WHEN 0 THEN [home_id, home_id] WHEN 1 THEN [home_id, -1] WHEN 2 THEN [home_id] WHEN 3 THEN [home_id, away_id, -1] ELSE [away_id, home_id] END) AS pid FROM dim_events)"""


@C.add("reg_head_to_head", f"WITH {EVENTS}, {H2H} SELECT event_id, count(*) = 2 AND count(DISTINCT pid) = 2 AND bool_and(pid = home_id OR pid = away_id) AS ok FROM s GROUP BY 1")
def _(f):
    k, h, a, none = F.col("event_id") % 7, F.col("home_id"), F.col("away_id"), F.lit(-1).cast("bigint")
    sides = F.when(k == 0, F.array(h, h)).when(k == 1, F.array(h, none)).when(k == 2, F.array(h)).when(k == 3, F.array(h, a, none)).otherwise(F.array(a, h))
    picks = f.events.select(F.col("event_id").alias("market_id"), "event_id", F.explode(sides).alias("participant_id"))
    members = f.events.select("event_id", F.explode(F.array(h, a)).alias("participant_id")).distinct()
    return I.two_of_the_event(picks, members).withColumnRenamed("market_id", "event_id")


@C.add("reg_handicap", f"""WITH {EVENTS}, x AS (SELECT event_id, (event_id % 9 - 4) / 2.0 AS line, event_id % 5 AS k FROM dim_events),
  s AS (SELECT event_id, line, unnest(CASE WHEN k = 3 THEN ['home'] ELSE ['home', 'away'] END) AS side, unnest(CASE k WHEN 1 THEN [line, line] WHEN 2 THEN [line + 1, -line - 1] WHEN 3 THEN [line] WHEN 4 THEN [NULL, -line] ELSE [line, -line] END) AS h FROM x)
  SELECT event_id, count(*) = 2 AND count_if(side = 'home' AND h = line)::bigint = 1 AND count_if(side = 'away' AND h = -line)::bigint = 1 AS ok FROM s GROUP BY 1""")
def _(f):
    k, line = F.col("event_id") % 5, ((F.col("event_id") % 9 - 4) / 2).cast("decimal(10,2)")
    two = lambda one, other: F.array(F.struct(F.lit("home").alias("kind"), one.cast("decimal(10,2)").alias("handicap")), F.struct(F.lit("away").alias("kind"), other.cast("decimal(10,2)").alias("handicap")))
    rows = F.when(k == 1, two(line, line)).when(k == 2, two(line + 1, -line - 1)).when(k == 3, F.slice(two(line, line), 1, 1)).when(k == 4, two(F.lit(None), -line)).otherwise(two(line, -line))
    selections_ = f.events.select(F.col("event_id").alias("market_id"), line.alias("line"), F.explode(rows).alias("s")).select("market_id", "line", "s.kind", "s.handicap")
    return I.opposed_handicaps(selections_).withColumnRenamed("market_id", "event_id")


# ---- stakes and lifecycle


def plans(f, bankroll: int = 10_000):
    """Stake plans of the opportunities; each leg has its own least stake and step, and every third a greatest stake."""
    e = A.opportunities(full_books(f))
    cents = F.transform("outcomes", lambda o: o["cents"])
    limits = {
        "low": F.transform(cents, lambda c: c % 50 * 10), "high": F.transform(cents, lambda c: F.when(c % 3 == 0, F.lit(4_000) + c * 5)), "step": F.transform(cents, lambda c: F.lit(1) + c % 4 * 25),
    }
    e = e.withColumn("cents", cents).withColumns(limits)
    return e.withColumn("plan", K.allocate(F.col("cents"), F.lit(bankroll).cast("bigint"), *map(F.col, limits)))


@C.add("opt_effective_constraints", f"""WITH {BASE}, u AS (SELECT l_orderkey, l_linenumber, cents % 50 AS lo, total % 300 AS hi, 1 + qty % 7 AS inc FROM b), v AS (SELECT *, greatest(inc, ((lo + inc - 1) // inc) * inc) AS minimum, (hi // inc) * inc AS maximum FROM u)
  SELECT l_orderkey, l_linenumber, CASE WHEN maximum >= minimum THEN minimum END AS minimum, CASE WHEN maximum >= minimum THEN maximum END AS maximum FROM v""")
def _(f):
    got = base(f).select(*KEYS, K.effective_limits(F.col("cents") % 50, F.col("total") % 300, 1 + F.col("qty") % 7).alias("e"))
    return got.select(*KEYS, "e.minimum", "e.maximum")


@C.add("opt_continuous_target", f"{RANKED} SELECT market_id, round(10000 / s, 4) AS target FROM e WHERE arb")
def _(f):
    e = A.opportunities(full_books(f))
    return e.select("market_id", F.round(K.target(F.transform("outcomes", lambda o: o["cents"]), F.lit(10_000).cast("bigint")), 4).alias("target"))


def limited_sql(bankroll: int = 10_000) -> str:
    """The greatest common payout under limits: what it costs is the greatest of one line for each set of legs that follow it, the others at their minimum."""
    legs = ("a", "b", "c")
    low, high = (lambda x: f"({x} % 50 * 10)"), (lambda x: f"CASE WHEN {x} % 3 = 0 THEN (4000 + {x} * 5) * {x}::double / 100 END")
    lines = []
    for k in range(1, 8):
        follow, stay = [x for i, x in enumerate(legs) if k >> i & 1], [x for i, x in enumerate(legs) if not k >> i & 1]
        lines.append(f"({' - '.join([str(bankroll), *map(low, stay)])})::double / ({' + '.join(f'100 / {x}::double' for x in follow)})")
    bound = f"least({', '.join([*lines, *map(high, legs)])})"
    return f"{RANKED} SELECT market_id, CASE WHEN {' + '.join(map(low, legs))} <= {bankroll} THEN round({bound}, 4) END AS target FROM e WHERE arb"


@C.add("opt_limited_target", limited_sql())
def _(f):
    e = A.opportunities(full_books(f))
    cents = F.transform("outcomes", lambda o: o["cents"])
    low, high = F.transform(cents, lambda c: c % 50 * 10), F.transform(cents, lambda c: F.when(c % 3 == 0, F.lit(4_000) + c * 5))
    return e.select("market_id", F.round(K.target(cents, F.lit(10_000).cast("bigint"), low, high), 4).alias("target"))


@C.add("opt_discrete_search")
def _(f):
    return plans(f).select("market_id", F.col("plan.profit").alias("profit"), F.aggregate("plan.stakes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("staked"))


@C.add("opt_allocate")
def _(f):
    return plans(f).select("market_id", F.array_join(F.col("plan.stakes").cast("array<string>"), ",").alias("stakes"), F.array_join(F.col("plan.payouts").cast("array<string>"), ",").alias("payouts"), "plan.profit")


@C.add("opt_equal_stake", f"{RANKED} SELECT market_id, round(100 / (a::double / 100 * s), 6) AS s0, round(100 / (b::double / 100 * s), 6) AS s1, round(100 / (c::double / 100 * s), 6) AS s2 FROM e WHERE arb")
def _(f):
    e = A.opportunities(full_books(f))
    x = K.equal_payout(F.lit(100.0), F.transform("outcomes", lambda o: o["cents"].cast("double") / 100), F.col("implied_sum"))
    return e.select("market_id", *[F.round(F.get(x, F.lit(k)), 6).alias(f"s{k}") for k in range(3)])


@C.add("opt_net_profit", f"WITH {BASE} SELECT l_orderkey, l_linenumber, round(g - g * 0.05 - greatest(g - g * 0.05, 0) * 0.1, 6) AS net FROM (SELECT *, ((cents - 200) / 10.0)::double AS g FROM b)")
def _(f):
    g = (F.col("cents") - 200) / 10.0
    return base(f).select(*KEYS, F.round(K.net_profit(g, F.lit(0.05), F.lit(0.1)), 6).alias("net"))


@C.add("opt_revalidate", f"""{RANKED}, o AS (SELECT market_id, s, arb, 1 / s - 1 AS margin, oldest FROM e)
  SELECT market_id, CASE WHEN market_id % 19 = 0 THEN 'quote_set_changed' WHEN market_id % 17 = 0 THEN 'market_closed' WHEN oldest < TIMESTAMP '1996-01-01' THEN 'stale_quotes' WHEN NOT arb THEN 'no_longer_arbitrage'
  WHEN margin < 0.01 THEN 'odds_drift_exceeded' WHEN margin * 100 < 3 THEN 'minimum_profit' WHEN margin < 0.06 THEN 'minimum_roi' ELSE 'actionable' END AS reason FROM o""")
def _(f):
    e = full_books(f)
    m = F.col("margin")
    ladder = K.lifecycle(
        F.col("market_id") % 19 != 0, F.col("market_id") % 17 != 0, F.col("oldest") >= F.lit("1996-01-01").cast("timestamp_ntz"), F.col("is_arbitrage"),
        m < 0.01, F.lit(True), m * 100, m, 3, 0.06,
    )
    return e.select("market_id", ladder["reason"].alias("reason"))


@C.add("opt_demo_projection", "SELECT 0.857609710550887::double AS implied_sum, true AS is_arbitrage")
def _(f):
    demo = f.spark.createDataFrame([([340, 360, 350],)], "cents array<bigint>")
    return demo.select(F.round(A.reciprocal_sum(F.col("cents")), 15).alias("implied_sum"), A.is_arbitrage(F.col("cents")).alias("is_arbitrage"))
