"""Nested JSON feeds as rows: array-nested and map-nested odds, catalogues, discovery, polls."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARRAY_FEED = """id string, sport_key string, commence_time string, home_team string, away_team string, bookmakers array<struct<key: string, title: string,
 markets: array<struct<key: string, sid: string, last_update: string, outcomes: array<struct<name: string, price: decimal(18,6), sid: string, point: decimal(18,6), description: string>>>>>>"""

MAP_FEED = """fixtureId string, statusId int, bookmakerOdds map<string, struct<bookmakerIsActive: boolean, suspended: boolean, markets: map<string,
 struct<marketActive: boolean, outcomes: map<string, struct<players: map<string, struct<active: boolean, price: decimal(18,6), bookmakerOutcomeId: string, bookmakerChangedAt: string, changedAt: string>>>>>>>>"""

#: The shape of each known market of the array feed: its two labels (teams: the event's participants; none: any number of
#: any labels), what its points must be, the sport it is confined to, and its period index.
SHAPES = {
    "h2h": (None, "none", None, None),
    "totals": (("over", "under"), "equal", None, None),
    "spreads": ("teams", "opposite", None, None),
    "btts": (("no", "yes"), "none", None, None),
    "draw_no_bet": ("teams", "none", None, None),
    "h2h_s1": ("teams", "none", "tennis_", 1),
    "h2h_s2": ("teams", "none", "tennis_", 2),
}
#: Markets whose overtime rule a basketball feed does not tell.
OVERTIME = ("spreads", "totals")


def _shape_issue(shape: tuple, names: Column, points: Column, home: Column, away: Column, sport: Column) -> Column:
    """The first rule of a market's shape that its outcomes break."""
    labels, kind, prefix, _ = shape
    missing, present = F.exists(points, lambda p: p.isNull()), F.exists(points, lambda p: p.isNotNull())
    rules = []
    if prefix is not None:
        rules.append((~sport.startswith(prefix), "wrong_sport"))
    if kind == "none":
        rules.append((present, "unexpected_point"))
    else:
        rules.append((missing, "missing_point"))
    if kind == "equal":
        rules.append((F.array_min(points) != F.array_max(points), "unequal_points"))
    if labels is not None:
        rules.append((F.size(names) != 2, "outcome_count"))
        if labels == "teams":
            rules.append((F.array_sort(names) != F.array_sort(F.array(home, away)), "unexpected_outcome"))
        else:
            rules.append((F.array_sort(F.transform(names, F.lower)) != F.array(*map(F.lit, labels)), "unexpected_outcome"))
    if kind == "opposite":
        rules.append((F.get(points, F.lit(0)) != -F.get(points, F.lit(1)), "unopposed_points"))
    return _first(rules)


def _first(rules: list[tuple[Column, str]]) -> Column:
    return reduce(lambda out, r: F.when(r[0], r[1]) if out is None else out.when(r[0], r[1]), rules, None)


def array_feed(payloads: DataFrame, feed: str = "array", full_event_bookmakers: tuple[str, ...] = ()) -> DataFrame:
    """Outcomes of payload (json text): event_id, provider_id (the bookmaker in the feed's namespace), bookmaker, market_id, label, market_key, selection_id,
    name, price, line (of the market), handicap (of the outcome), period_index, source_ts, issue.

    Malformed JSON is one row with issue malformed_payload, an event whose participants do not differ one with same_participants. Every outcome of a
    market that breaks its shape carries the market's issue; a market without outcomes is one row. Basketball markets whose
    overtime rule is not told are left out but for the bookmakers named (in lower case).
    """
    p = payloads.select(F.from_json("payload", ARRAY_FEED, {"mode": "PERMISSIVE"}).alias("p"), "payload")
    bad = p.where("p.id IS NULL").select(F.lit("malformed_payload").alias("issue"))
    same = p.where("p.id IS NOT NULL AND NOT coalesce(p.home_team <> p.away_team, false)").select(F.col("p.id").alias("event_id"), F.lit("same_participants").alias("issue"))
    event = p.where("p.id IS NOT NULL AND p.home_team <> p.away_team")
    b = event.select(*[F.col(f"p.{c}").alias(n) for c, n in (("id", "event_id"), ("sport_key", "sport"), ("home_team", "home"), ("away_team", "away"))], F.explode("p.bookmakers").alias("b"))
    m = b.select("event_id", "sport", "home", "away", F.col("b.key").alias("bookmaker"), F.col("b.title").alias("title"), F.explode("b.markets").alias("m"))
    key, sport = F.col("m.key"), F.coalesce("sport", F.lit(""))
    untold = sport.startswith("basketball_") & key.isin(*OVERTIME) & ~F.lower("bookmaker").isin(*full_event_bookmakers)
    m = m.where(~F.coalesce(untold, F.lit(False)))
    names, points = F.transform("m.outcomes", lambda o: o["name"]), F.transform("m.outcomes", lambda o: o["point"])
    incomplete = F.exists("m.outcomes", lambda o: (F.coalesce(F.trim(o["name"]), F.lit("")) == "") | o["price"].isNull())
    shape = reduce(lambda out, kv: (F if out is None else out).when(key == kv[0], _shape_issue(kv[1], names, points, F.col("home"), F.col("away"), sport)), SHAPES.items(), None)
    other = F.when(~key.isin(*SHAPES) & F.exists(points, lambda x: x.isNotNull()), "unsupported_pointed_market")
    issue = F.when(F.coalesce(F.size("m.outcomes"), F.lit(0)) < 1, "empty_outcomes").otherwise(F.when(incomplete, "malformed_outcome").otherwise(F.coalesce(shape, other)))
    at_home = F.get(F.filter("m.outcomes", lambda o: o["name"] == F.col("home")), F.lit(0))["point"]
    line = F.when(key == "totals", F.get(points, F.lit(0))).when(key == "spreads", at_home).when(key == "draw_no_bet", F.lit(0).cast("decimal(18,6)"))
    index = reduce(lambda out, kv: (F if out is None else out).when(key == kv[0], kv[1][3]), [kv for kv in SHAPES.items() if kv[1][3]], None)
    m = m.withColumns({"issue": issue, "line": F.when(issue.isNull(), line), "period_index": index, "market_key": key})
    o = m.withColumn("o", F.explode_outer("m.outcomes"))
    handicap = F.when(F.col("issue").isNull(), F.when(F.col("market_key") == "spreads", F.col("o.point")).when(F.col("market_key") == "draw_no_bet", F.lit(0).cast("decimal(18,6)")))
    sid = F.when(F.col("o").isNotNull(), selection_id(F.col("o.sid"), F.col("bookmaker"), F.col("market_key"), F.col("o.description"), F.col("o.name")))
    rows = o.select(
        "event_id", F.concat(F.lit(f"bookmaker:{feed}:"), "bookmaker").alias("provider_id"), "bookmaker",
        F.concat_ws(":", "bookmaker", F.coalesce("m.sid", "market_key")).alias("market_id"), F.concat_ws(" ", F.coalesce("title", "bookmaker"), "market_key").alias("label"),
        "market_key", sid.alias("selection_id"), F.col("o.name").alias("name"), F.col("o.price").alias("price"), "line", handicap.alias("handicap"), "period_index",
        F.to_timestamp("m.last_update").alias("source_ts"), "issue",
    )
    return rows.unionByName(same, allowMissingColumns=True).unionByName(bad, allowMissingColumns=True)


#: The families of the map feed's markets that are taken: sport, market id (none: any), names, periods, type, what the handicap must
#: be, and the outcome labels.
FAMILIES = (
    ("football", None, ("over under full time",), ("fulltime",), "totals", "positive", ("over", "under")),
    ("football", None, ("asian handicap",), ("fulltime",), "handicap", "any", ("1", "2")),
    ("football", None, ("both teams to score",), ("fulltime",), "totals", "zero", ("no", "yes")),
    ("tennis", None, ("match winner", "winner"), ("fulltime", "match"), "winner", "zero", ("1", "2")),
    ("tennis", "123", ("first set winner",), ("p1",), "winner", "zero", ("1", "2")),
    ("tennis", "125", ("second set winner",), ("p2",), "winner", "zero", ("1", "2")),
    ("basketball", None, ("over under (incl. overtime)",), ("fulltime",), "totals", "positive", ("over", "under")),
    ("basketball", None, ("handicap (incl. overtime)",), ("fulltime",), "handicap", "any", ("1", "2")),
)
#: The one football three-way market that is taken, field by field, and its outcomes.
THREE_WAY = {"market_id": "101", "sport_id": 10, "name": "full time result", "period": "fulltime", "market_type": "1x2"}
THREE_WAY_OUTCOMES = (("101", "1"), ("102", "X"), ("103", "2"))


def three_way_contract() -> Column:
    """Whether a catalogue row (market_id, sport_id, name, period, market_type, handicap, player_prop, outcomes) is that market in every field."""
    same = reduce(lambda a, b: a & b, (F.lower("name") == v if c == "name" else F.col(c) == v for c, v in THREE_WAY.items()))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in THREE_WAY_OUTCOMES])
    outcomes = F.array_sort(F.map_entries("outcomes")) == pairs
    return F.coalesce(same & (F.col("handicap") == 0) & ~F.col("player_prop") & outcomes, F.lit(False))


def market_supported(sport: Column) -> Column:
    """Whether a catalogue row belongs to a family that is taken for the sport."""
    labels = F.array_sort(F.transform(F.map_values("outcomes"), F.lower))

    def fits(family: tuple) -> Column:
        of, market, names, periods, kind, handicap, wanted = family
        out = (sport == of) & F.lower("name").isin(*names) & F.col("period").isin(*periods) & (F.col("market_type") == kind)
        out = out & (labels == F.array(*map(F.lit, wanted)))
        if market is not None:
            out = out & (F.col("market_id") == market)
        return out if handicap == "any" else out & (F.col("handicap") > 0 if handicap == "positive" else F.col("handicap") == 0)

    taken = reduce(lambda a, b: a | b, map(fits, FAMILIES)) | ((sport == "football") & three_way_contract())
    return F.coalesce(~F.col("player_prop") & taken, F.lit(False))


CATALOGUE = "marketId string, sportId int, marketName string, playerProp boolean, handicap decimal(18,6), period string, marketType string, outcomes array<struct<outcomeId: string, outcomeName: string>>"


def market_catalogue(payloads: DataFrame) -> DataFrame:
    """One row a market id of payload (json text): the catalogue's columns and issue (malformed_payload, incomplete_market, duplicate_market)."""
    r = payloads.select(F.from_json("payload", CATALOGUE, {"mode": "PERMISSIVE"}).alias("r"))
    bad = r.where("r.marketId IS NULL").select(F.lit("malformed_payload").alias("issue"))
    row = F.struct(
        F.col("r.sportId").alias("sport_id"), F.col("r.marketName").alias("name"), F.col("r.playerProp").alias("player_prop"), F.col("r.handicap").alias("handicap"),
        F.col("r.period").alias("period"), F.col("r.marketType").alias("market_type"), F.transform("r.outcomes", lambda o: F.struct(o["outcomeId"].alias("key"), o["outcomeName"].alias("value"))).alias("pairs"),
    )
    once = r.where("r.marketId IS NOT NULL").groupBy(F.col("r.marketId").alias("market_id")).agg(F.count("*").alias("n"), F.min(row).alias("row"))
    lacking = reduce(lambda a, b: a | b, (F.col(f"row.{c}").isNull() for c in ("sport_id", "name", "player_prop", "handicap", "period", "market_type", "pairs")))
    keys = F.transform("row.pairs", lambda x: x["key"])
    unclear = F.exists(keys, lambda k: k.isNull()) | (F.size(F.array_distinct(keys)) != F.size(keys))
    issue = F.when(F.col("n") > 1, "duplicate_market").when(lacking, "incomplete_market").when(unclear, "unclear_outcomes")
    outcomes = F.map_from_entries("row.pairs")
    return once.select("market_id", "row.*", F.when(issue.isNull(), outcomes).alias("outcomes"), issue.alias("issue")).drop("pairs").unionByName(bad, allowMissingColumns=True)


def sport_status(records: DataFrame, sports: dict[str, str]) -> DataFrame:
    """(sport, status) of every sport that records (slug, sport_id, name) map to: resolved by exactly one complete record, else incomplete or ambiguous."""
    mapped = F.create_map(*[F.lit(x) for kv in sports.items() for x in kv])
    known = records.withColumn("sport", F.try_element_at(mapped, F.col("slug"))).where("sport IS NOT NULL")
    lacking = F.col("sport_id").isNull() | (F.coalesce(F.trim("name"), F.lit("")) == "")
    counted = known.groupBy("sport").agg(F.count("*").alias("n"), F.count_if(lacking).alias("lacking"))
    return counted.select("sport", F.when(F.col("lacking") > 0, "incomplete").when(F.col("n") > 1, "ambiguous").otherwise("resolved").alias("status"))


def ownership() -> Column:
    """What is wrong with a snapshot (provider_id, event_id) that was asked for as (asked_provider, asked_event)."""
    return F.when(~F.col("provider_id").eqNullSafe(F.col("asked_provider")), "provider_mismatch").when(~F.col("event_id").eqNullSafe(F.col("asked_event")), "event_mismatch")


def collected(adapters: DataFrame, competitions: DataFrame, events: DataFrame, snapshots: DataFrame, sport: str) -> DataFrame:
    """A sweep over all feeds: (provider_id, operation, event_id, start, issue), a row a snapshot taken (no issue) or a failure.

    adapters: provider_id, sports, error. competitions: provider_id, competition_id, error (of discovering a feed's competitions: any row of it).
    events: provider_id, competition_id, event_id, start, error (of a competition). snapshots: asked_provider, asked_event, provider_id, event_id, error; an
    event without a row has no snapshot. A failure takes out what lies below it and nothing beside it.
    """
    issue = lambda df, operation, event=None: df.where("error IS NOT NULL").select(
        "provider_id", F.lit(operation).alias("operation"), (F.lit(None) if event is None else F.col(event)).cast("bigint").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("start"), F.col("error").alias("issue")
    ).distinct()
    up = adapters.where("error IS NULL").where(F.array_contains("sports", sport)).select("provider_id")
    found = competitions.join(up, "provider_id", "left_semi")
    failed = found.where("error IS NOT NULL").select("provider_id").distinct()
    open_ = found.join(failed, "provider_id", "left_anti").select("provider_id", "competition_id")
    listed = events.join(open_, ["provider_id", "competition_id"], "left_semi")
    broken = listed.where("error IS NOT NULL").select("provider_id", "competition_id").distinct()
    asked = listed.join(broken, ["provider_id", "competition_id"], "left_anti").select(F.col("provider_id").alias("asked_provider"), F.col("event_id").alias("asked_event"), "start")
    got = asked.join(snapshots, ["asked_provider", "asked_event"])
    wrong = F.coalesce("error", ownership())
    taken = got.select(F.col("asked_provider").alias("provider_id"), F.lit("fetch_odds").alias("operation"), F.col("asked_event").alias("event_id"), F.when(wrong.isNull(), F.col("start")).alias("start"), wrong.alias("issue"))
    out = issue(adapters, "supported_sports").unionByName(issue(found, "discover_competitions")).unionByName(issue(listed, "discover_events")).unionByName(taken)
    return out.orderBy(F.col("issue").isNotNull(), "provider_id", "start", "operation", "event_id", "issue")


def cached(requests: DataFrame, ttl: int) -> DataFrame:
    """requests (key, at, ...) with loaded: whether the catalogue of the key is read anew, as ttl has passed since it was last read.

    Keys are dealt and sorted by time, and one pass holds one time, so a key of any length streams through.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for pdf in batches:
            loaded = []
            for k, at in zip(pdf["key"], pdf["at"]):
                if k != key or at >= last + ttl:
                    key, last = k, at
                    loaded.append(True)
                else:
                    loaded.append(False)
            yield pdf.assign(loaded=loaded)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema)
    return requests.repartition("key").sortWithinPartitions(*dict.fromkeys(["key", "at", *requests.columns])).mapInPandas(run, f"{kinds}, loaded boolean")


def least_recent(accesses: DataFrame, size: int) -> DataFrame:
    """accesses (cache, at, key, ...) with hit: whether a cache of so many entries, the least recently used leaving first, holds the key then.

    Caches are dealt and sorted by time; one pass holds one cache of at most size keys.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, held = None, {}
        for pdf in batches:
            hits = []
            for c, k in zip(pdf["cache"], pdf["key"]):
                if c != cache:
                    cache, held = c, {}
                hits.append(k in held)
                held.pop(k, None)
                held[k] = True
                if len(held) > size:
                    del held[next(iter(held))]
            yield pdf.assign(hit=hits)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in accesses.schema)
    return accesses.repartition("cache").sortWithinPartitions("cache", "at").mapInPandas(run, f"{kinds}, hit boolean")


def map_feed(payloads: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(event_id, bookmaker, market_id, outcome_id, price, status, changed_at, issue) of payload (json text).

    catalogue: market_id, outcome_ids (sorted array). A market whose outcome set is not the catalogue's is an issue; a
    fixture that is not before its start suspends everything.
    """
    p = payloads.select(F.from_json("payload", MAP_FEED).alias("p")).select(F.col("p.fixtureId").alias("event_id"), F.col("p.statusId").alias("status_id"), F.explode("p.bookmakerOdds").alias("bookmaker", "b"))
    m = p.select("event_id", "status_id", "bookmaker", "b", F.explode("b.markets").alias("market_id", "m"))
    known = m.join(catalogue, "market_id", "left")
    same = F.array_sort(F.map_keys("m.outcomes")) == F.col("outcome_ids")
    issue = F.when(F.col("outcome_ids").isNull(), "unknown_market").when(~same, "outcome_set_mismatch")
    o = known.withColumn("issue", issue).select("event_id", "status_id", "bookmaker", "b", "market_id", "m", "issue", F.explode("m.outcomes").alias("outcome_id", "o"))
    q = o.select("*", F.explode("o.players").alias("player", "q"))
    live = F.col("b.bookmakerIsActive") & ~F.col("b.suspended") & F.col("m.marketActive") & F.col("q.active")
    return q.select(
        "event_id", bookmaker_name(F.col("bookmaker")).alias("bookmaker"), "market_id", "outcome_id", F.col("q.price").alias("price"),
        suspended(F.when(live, "active").otherwise("suspended"), F.col("status_id")).alias("status"),
        F.coalesce("q.bookmakerChangedAt", "q.changedAt").alias("changed_at"), "issue",
    )


def selection_id(sid: Column, bookmaker: Column, market: Column, description: Column, name: Column) -> Column:
    return F.coalesce(sid, F.concat_ws(":", bookmaker, market, description, name))


def bookmaker_name(slug: Column) -> Column:
    """One name for a bookmaker over all feeds; null for an empty slug or one with white space inside."""
    t = F.lower(F.trim(slug))
    return F.when((t != "") & ~t.rlike(r"\s"), F.concat(F.lit("bookmaker:"), t))


def suspended(status: Column, status_id: Column) -> Column:
    return F.when(status_id != 0, "suspended").otherwise(status)


def set_index(market_id: Column, name: Column) -> Column:
    """Set number of the two documented tennis set markets (fixed values); null for others."""
    n = F.lower(name)
    return F.when((market_id == "123") & (n == "first set winner"), 1).when((market_id == "125") & (n == "second set winner"), 2)


def http_failure(status: Column, lenient: bool) -> Column:
    """struct(kind, retryable) of an HTTP status; the lenient feed takes more client errors as invalid requests."""
    invalid = status.isin(400, 404, 405, 409, 422) if lenient else status == 400
    kind = (
        F.when(status.between(200, 299), F.lit(None)).when(status == 401, "authentication").when(status == 403, "authorization")
        .when(status == 429, "rate_limited").when(invalid, "invalid_request").otherwise("upstream")
    )
    return F.struct(kind.alias("kind"), ((status == 429) | (status >= 500)).alias("retryable"))


def next_allowed(at: Column, retry_after: Column, remaining: Column, resets_at: Column, cooldown: int = 5) -> Column:
    """When a feed may be polled again (seconds), from its quota answer; null if at once."""
    retry = F.when(retry_after > 0, at + retry_after)
    reset = F.when((remaining == 0) & (resets_at > at), resets_at).when((remaining == 0) & retry_after.isNull(), at + cooldown)
    return F.greatest(retry, reset)


def retry_delay(attempt: Column, sample: Column, retry_after: Column, base: float = 0.25, most: float = 4.0, jitter: float = 0.2) -> Column:
    """Exponential backoff with jitter under a ceiling, at least what the server asks for."""
    plain = F.least(F.lit(most), base * F.pow(F.lit(2.0), attempt - 1))
    return F.greatest(F.least(F.lit(most), plain * (1 + jitter * sample)), F.coalesce(retry_after, F.lit(0.0)))


def cycles(ticks: Column, seconds: Column) -> Column:
    """(tick, ran) of each tick in order: one that falls into a running cycle is dropped; cycle k takes seconds[k], later ones the last of them."""
    start = F.struct(
        F.lit(0).cast("bigint").alias("done"), F.lit(None).cast("bigint").alias("free"), F.array().cast("array<struct<tick:bigint,ran:boolean>>").alias("seen")
    )

    def step(s: Column, tick: Column) -> Column:
        ran = s["free"].isNull() | (tick >= s["free"])
        took = F.get(seconds, F.least(s["done"], F.size(seconds) - 1).cast("int"))
        seen = F.concat(s["seen"], F.array(F.struct(tick.alias("tick"), F.coalesce(ran, F.lit(False)).alias("ran"))))
        return F.struct((s["done"] + ran.cast("bigint")).alias("done"), F.when(ran, tick + took).otherwise(s["free"]).alias("free"), seen.alias("seen"))

    return F.aggregate(ticks, start, step)["seen"]
