"""Queries of the scalar functions, each with SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import udfs
from ..projection import EVENTS, QUOTES, Catalogue, Frames

C = Catalogue()
KEYS = ("l_orderkey", "l_linenumber")

#: lineitem with whole cents and texts made of them; the same in both engines.
BASE = """b AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_shipdate, 101 + cast(round(l_extendedprice * 100) AS bigint) % 220 AS cents,
  cast(round(l_extendedprice * 100) AS bigint) AS total, cast(round(l_quantity) AS bigint) AS qty FROM lineitem)"""


def base(f: Frames):
    total = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return f.table("lineitem").select(
        *KEYS, "l_suppkey", "l_partkey", "l_shipdate", (F.lit(101) + total % 220).alias("cents"), total.alias("total"),
        F.round("l_quantity").cast("bigint").alias("qty"),
    )


def text(c):
    return c.cast("string")


@C.add(
    "fn_odds_convert",
    f"""WITH {BASE}, t AS (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN (cents // 100) || '.' || lpad((cents % 100)::varchar, 2, '0')
      WHEN 1 THEN (cents % 17) || '/' || (cents % 13) WHEN 2 THEN (cents - 200)::varchar ELSE '0.' || lpad((cents % 1000)::varchar, 3, '0') END AS price FROM b),
    o AS (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN price::double
      WHEN 1 THEN CASE WHEN cents % 17 > 0 AND cents % 13 > 0 THEN 1 + (cents % 17)::double / (cents % 13) END
      WHEN 2 THEN CASE WHEN cents > 200 THEN 1 + (cents - 200)::double / 100 WHEN cents < 200 THEN 1 + 100 / (200 - cents)::double END
      ELSE CASE WHEN price::double > 0 AND price::double < 1 THEN 1 / price::double END END AS raw FROM t)
    SELECT l_orderkey, l_linenumber, price, round(CASE WHEN raw > 1 THEN raw END, 9) AS odds,
      CASE WHEN raw > 1 THEN NULL ELSE 'malformed_price' END AS issue FROM o""",
)
def _(f: Frames):
    c = F.col("cents")
    kind = F.col("l_linenumber") % 4
    price = (
        F.when(kind == 0, F.concat(text(F.floor(c / 100)), F.lit("."), F.lpad(text(c % 100), 2, "0")))
        .when(kind == 1, F.concat(text(c % 17), F.lit("/"), text(c % 13)))
        .when(kind == 2, text(c - 200))
        .otherwise(F.concat(F.lit("0."), F.lpad(text(c % 1000), 3, "0")))
    )
    fmt = F.when(kind == 0, "decimal").when(kind == 1, "fractional").when(kind == 2, "american").otherwise("implied_probability")
    got = base(f).select(*KEYS, price.alias("price"), S.odds_issue_and_price(price, fmt).alias("o"))
    return got.select(*KEYS, "price", F.round("o.odds", 9).alias("odds"), F.col("o.issue").alias("issue"))


@C.add("fn_implied_prob", f"WITH {QUOTES} SELECT quote_id, round(1 / (cents / 100.0)::double, 9) AS implied FROM quotes")
def _(f):
    return f.quotes.select("quote_id", F.round(S.implied_probability(F.col("cents") / 100), 9).alias("implied"))


NAMES = "concat('  ', upper(c_name), '   ', c_mktsegment, ' ')"


@C.add("fn_alias_key", f"SELECT c_custkey, lower(regexp_replace(trim({NAMES}), '\\s+', ' ', 'g')) AS alias_key FROM customer")
def _(f):
    raw = F.concat(F.lit("  "), F.upper("c_name"), F.lit("   "), F.col("c_mktsegment"), F.lit(" "))
    return f.table("customer").select("c_custkey", S.alias_key_ascii(raw).alias("alias_key"))


@C.add("fn_alias_key_unicode", f"SELECT c_custkey, 'strasse fi ' || lower(c_name) AS alias_key FROM customer")
def _(f):
    raw = F.concat(F.lit("Straße ﬁ  "), F.col("c_name"))
    return f.table("customer").select("c_custkey", udfs.alias_key(raw).alias("alias_key"))


@C.add(
    "fn_text_norm",
    """SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_name END AS a, CASE WHEN length(repeat(c_name, (c_custkey % 20)::int)) BETWEEN 1 AND 256
    THEN repeat(c_name, (c_custkey % 20)::int) END AS b FROM customer""",
)
def _(f):
    odd = F.when(F.col("c_custkey") % 7 == 0, F.concat(F.col("c_name"), F.lit("\x01"))).otherwise(F.concat(F.lit("  "), F.col("c_name")))
    long = F.repeat("c_name", (F.col("c_custkey") % 20).cast("int"))
    return f.table("customer").select("c_custkey", S.bounded_text(odd).alias("a"), S.bounded_text(long).alias("b"))


@C.add("fn_source_text", "SELECT c_custkey, CASE WHEN length(repeat(c_name, 30)) <= 512 THEN repeat(c_name, 30) END AS source_id FROM customer")
def _(f):
    return f.table("customer").select("c_custkey", S.bounded_text(F.repeat("c_name", F.lit(30)), 512).alias("source_id"))


@C.add(
    "fn_currency",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' END AS currency FROM customer""",
)
def _(f):
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, " eur ").when(k == 1, "Usd").when(k == 2, "E1R").otherwise("EURO")
    return f.table("customer").select("c_custkey", S.currency(raw).alias("currency"))


@C.add("fn_utc", "SELECT event_id, ts - to_hours((event_id % 5)::int) AS utc FROM events")
def _(f):
    hours = (F.col("event_id") % 5).cast("string")
    local = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+0"), hours, F.lit(":00"))
    return f.table("events").select("event_id", F.to_utc_timestamp(S.iso_timestamp(local), F.current_timezone()).cast("timestamp_ntz").alias("utc"))


@C.add("fn_iso_ts", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN ts END AS parsed FROM events")
def _(f):
    zone = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "Z").otherwise("+00:00")
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone)
    return f.table("events").select("event_id", F.to_utc_timestamp(S.iso_timestamp(raw), F.current_timezone()).cast("timestamp_ntz").alias("parsed"))


@C.add(
    "fn_json_access",
    """SELECT event_id, user_id AS a, event_type AS b, user_id % 2 = 0 AS c, CASE WHEN event_id % 5 <> 0 THEN cast(round(value * 100) AS bigint) END AS d FROM events""",
)
def _(f):
    c = F.round(F.col("value") * 100).cast("bigint")
    doc = F.to_json(
        F.struct(F.col("user_id").alias("a"), F.col("event_type").alias("b"), (F.col("user_id") % 2 == 0).alias("c"),
                 F.when(F.col("event_id") % 5 == 0, F.lit("x")).otherwise(c.cast("string")).alias("d"))
    )
    v = F.parse_json(doc)
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    return f.table("events").select("event_id", get("$.a", "bigint").alias("a"), get("$.b", "string").alias("b"), get("$.c", "boolean").alias("c"), get("$.d", "bigint").alias("d"))


@C.add("fn_json_access_b", "SELECT event_id, CASE WHEN event_id % 4 < 2 THEN event_id % 90 END AS retry_after FROM events")
def _(f):
    k = F.col("event_id") % 4
    raw = F.when(k < 2, F.concat(F.lit(" "), (F.col("event_id") % 90).cast("string"))).when(k == 2, "soon").otherwise("-5")
    n = F.trim(raw).try_cast("bigint")
    return f.table("events").select("event_id", F.when(n >= 0, n).alias("retry_after"))


@C.add("fn_effective_ts", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN ts - INTERVAL 1 DAY ELSE ts END AS effective FROM events")
def _(f):
    source = F.when(F.col("event_id") % 2 == 0, F.expr("ts - INTERVAL '1' DAY"))
    return f.table("events").select("event_id", S.effective(source, F.col("ts")).alias("effective"))


@C.add(
    "fn_market_ts",
    "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN ts - INTERVAL 2 DAY WHEN event_id % 3 = 1 THEN ts - INTERVAL 1 DAY ELSE ts END AS market_ts FROM events",
)
def _(f):
    k = F.col("event_id") % 3
    return f.table("events").select(
        "event_id", F.coalesce(F.when(k == 0, F.expr("ts - INTERVAL '2' DAY")), F.when(k == 1, F.expr("ts - INTERVAL '1' DAY")), F.col("ts")).alias("market_ts")
    )


@C.add(
    "fn_quote_id",
    """SELECT event_id, (event_id % 2) || '|' || (event_id % 4) || '|' || user_id || '|' || user_id || '|' || (user_id % 3) || '|' ||
    strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00' AS quote_key FROM events""",
)
def _(f):
    e, u = F.col("event_id"), F.col("user_id")
    return f.table("events").select("event_id", S.quote_id(e % 2, e % 4, u, u, u % 3, F.col("ts")).alias("quote_key"))


@C.add("fn_status_map", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'suspended' WHEN 2 THEN 'closed' ELSE 'unknown' END AS status FROM events")
def _(f):
    k = F.col("event_id") % 4
    return f.table("events").select("event_id", S.status_of(F.when(k == 0, " Active").when(k == 1, "SUSPENDED").when(k == 2, "closed ").otherwise("halted")).alias("status"))


LINE = "(qty % 41 - 20) / 4.0"


def line():
    return ((F.col("qty") % 41 - 20) / 4).cast("decimal(10,4)")


@C.add("fn_line_parse", f"WITH {BASE} SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN ({LINE})::double END AS line FROM b")
def _(f):
    raw = F.when(F.col("l_linenumber") % 3 == 0, "n/a").otherwise(line().cast("string"))
    return base(f).select(*KEYS, raw.try_cast("decimal(10,4)").cast("double").alias("line"))


@C.add("fn_push_free_total", f"WITH {BASE} SELECT l_orderkey, l_linenumber, qty % 41 - 20 > 0 AND (qty % 41 - 20) % 4 = 2 AS ok FROM b")
def _(f):
    return base(f).select(*KEYS, S.is_half_total(line()).alias("ok"))


@C.add("fn_push_free_handicap", f"WITH {BASE} SELECT l_orderkey, l_linenumber, abs(qty % 41 - 20) % 4 = 2 AS ok FROM b")
def _(f):
    return base(f).select(*KEYS, S.is_half_line(line()).alias("ok"))


@C.add(
    "fn_ah_profile",
    f"""WITH {BASE}, u AS (SELECT *, qty % 41 - 20 AS k FROM b) SELECT l_orderkey, l_linenumber,
    CASE WHEN k % 4 = 0 THEN 'integer' WHEN k % 2 = 0 THEN 'half_goal' ELSE 'quarter' END AS line_class,
    CASE WHEN k % 2 = 0 THEN k / 4.0 ELSE floor(k / 2.0) / 2 + 0 END::double AS low, CASE WHEN k % 2 = 0 THEN k / 4.0 ELSE ceil(k / 2.0) / 2 + 0 END::double AS high FROM u""",
)
def _(f):
    parts = S.handicap_parts(line())
    return base(f).select(*KEYS, S.handicap_class(line()).alias("line_class"), (F.get(parts, F.lit(0))["line"] + 0.0).alias("low"), (F.element_at(parts, -1)["line"] + 0.0).alias("high"))


@C.add(
    "fn_ah_settle",
    f"""WITH {BASE}, u AS (SELECT *, qty % 41 - 20 AS k, l_partkey % 7 - 3 AS gd, cents / 100.0 AS odds FROM b),
    p AS (SELECT *, gd + CASE WHEN k % 2 = 0 THEN k / 4.0 ELSE floor(k / 2.0) / 2 END AS x, gd + CASE WHEN k % 2 = 0 THEN k / 4.0 ELSE ceil(k / 2.0) / 2 END AS y FROM u)
    SELECT l_orderkey, l_linenumber, CASE WHEN x > 0 AND y > 0 THEN 'win' WHEN x < 0 AND y < 0 THEN 'loss' WHEN x = 0 AND y = 0 THEN 'push'
      WHEN x = 0 OR y = 0 THEN CASE WHEN greatest(x, y) > 0 THEN 'half_win' ELSE 'half_loss' END END AS result,
      round(((CASE WHEN x > 0 THEN odds WHEN x = 0 THEN 1 ELSE 0 END + CASE WHEN y > 0 THEN odds WHEN y = 0 THEN 1 ELSE 0 END) / 2)::double, 6) AS multiplier FROM p""",
)
def _(f):
    got = base(f).withColumn("r", S.handicap_settlement(line(), F.col("l_partkey") % 7 - 3, F.col("cents") / 100))
    return got.select(*KEYS, F.col("r.result").alias("result"), F.round("r.multiplier", 6).alias("multiplier"))


GOALS = "l_partkey % 4 AS h, l_suppkey % 3 AS a"


@C.add("fn_1x2_winner", f"WITH {BASE}, g AS (SELECT *, {GOALS} FROM b) SELECT l_orderkey, l_linenumber, CASE WHEN h > a THEN 'home' WHEN a > h THEN 'away' ELSE 'draw' END AS winner FROM g")
def _(f):
    return base(f).select(*KEYS, S.winner_1x2(F.col("l_partkey") % 4, F.col("l_suppkey") % 3).alias("winner"))


@C.add(
    "fn_1x2_grade_check",
    f"""WITH {BASE}, g AS (SELECT *, {GOALS} FROM b) SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 5 = 0 THEN false
    ELSE CASE WHEN h > a THEN 0 WHEN h = a THEN 1 ELSE 2 END = cents % 3 END AS consistent FROM g""",
)
def _(f):
    won = F.col("cents") % 3
    grade = lambda k: F.when(won == k, "WIN").otherwise("LOSE")
    third = F.when(F.col("l_linenumber") % 5 == 0, "104").otherwise("103")
    grades = F.create_map(F.lit("101"), grade(0), F.lit("102"), grade(1), third, grade(2))
    return base(f).select(*KEYS, S.grades_consistent(grades, F.col("l_partkey") % 4, F.col("l_suppkey") % 3).alias("consistent"))


@C.add(
    "fn_1x2_labels",
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'home,draw,away' WHEN 1 THEN 'away,home,draw' END AS sides, CASE c_custkey % 4 WHEN 0 THEN 'home' WHEN 1 THEN 'draw' WHEN 2 THEN 'away' END AS side FROM customer",
)
def _(f):
    k, n = F.col("c_custkey") % 4, F.col("c_name")
    rival, other = F.lit("Rovers"), F.lit("other")
    labels = (
        F.when(k == 0, F.array(F.upper(n), F.lit("Draw "), rival))
        .when(k == 1, F.array(rival, n, F.lit("draw")))
        .when(k == 2, F.array(n, F.lit("draw"), other))
        .otherwise(F.array(n, n, F.lit("draw")))
    )
    sides = F.array_join(S.h2h_sides(n, rival, labels), ",")
    return f.table("customer").select("c_custkey", sides.alias("sides"), S.side_of_outcome((k + 101).cast("string")).alias("side"))


@C.add(
    "fn_fixture_order",
    "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'aligned' WHEN 1 THEN 'reversed' ELSE 'conflict' END AS alignment FROM customer",
)
def _(f):
    k, h, a = F.col("c_custkey") % 4, F.col("c_name"), F.lit("rival")
    one = F.when(k == 0, h).when(k == 1, a).otherwise(h)
    two = F.when(k == 0, a).when(k == 1, h).when(k == 2, h).otherwise(F.lit("x"))
    return f.table("customer").select("c_custkey", S.fixture_order(h, a, one, two).alias("alignment"))


@C.add("fn_team_key", "SELECT c_custkey, lower(replace(c_name, '#', ' ')) || ' united' AS team_key FROM customer")
def _(f):
    tail = F.when(F.col("c_custkey") % 2 == 0, " United FC").otherwise("-United")
    return f.table("customer").select("c_custkey", S.team_key(F.concat("c_name", tail)).alias("team_key"))


@C.add("fn_lay_liability", f"WITH {BASE} SELECT l_orderkey, l_linenumber, qty * (cents - 100) AS liability_cents FROM b")
def _(f):
    price = (F.col("cents") / 100).cast("decimal(10,2)")
    return base(f).select(*KEYS, (S.lay_liability(F.col("qty").cast("decimal(10,2)"), price) * 100).cast("bigint").alias("liability_cents"))


@C.add("fn_grid", f"WITH {BASE} SELECT l_orderkey, l_linenumber, total - total % 5 AS low, total + (5 - total % 5) % 5 AS high FROM b")
def _(f):
    value, step = (F.col("total") / 100).cast("decimal(16,2)"), F.lit("0.05").cast("decimal(4,2)")
    cents = lambda c: (c * 100).cast("bigint")
    return base(f).select(*KEYS, cents(S.floor_to_grid(value, step)).alias("low"), cents(S.ceil_to_grid(value, step)).alias("high"))


@C.add(
    "fn_time_score",
    f"WITH {BASE} SELECT l_orderkey, l_linenumber, (2000 * (1800000000 - least(total * 200, 1800000000))) // 1800000000 AS score FROM b",
)
def _(f):
    return base(f).select(*KEYS, S.time_score(F.col("total") * 200, F.lit(1_800_000_000).cast("bigint")).alias("score"))


@C.add("fn_comparison_key", "SELECT c_custkey, lower(c_name) || ' round' AS comparison_key FROM customer")
def _(f):
    return f.table("customer").select("c_custkey", S.alias_key_ascii(F.concat(F.upper("c_name"), F.lit(" \t Round "))).alias("comparison_key"))


@C.add("fn_sha_digest", f"WITH {QUOTES} SELECT market_id, sha256(string_agg(quote_id || ':' || cents, ';' ORDER BY quote_id, cents)) AS digest FROM quotes GROUP BY 1")
def _(f):
    row = F.concat_ws(":", "quote_id", "cents")
    rows = F.array_sort(F.collect_list(F.struct("quote_id", "cents", row.alias("row"))))
    return f.quotes.groupBy("market_id").agg(S.digest(F.array_join(F.transform(rows, lambda r: r["row"]), ";")).alias("digest"))
