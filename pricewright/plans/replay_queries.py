"""Queries of keyed state, windows and historical replay."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import replay as R
from ..operators import state as S
from ..projection import STREAM, STREAM_FRESH_DAYS, TOLERANCE_DAYS, Catalogue, Frames
from ..sources import feed_source as D
from ..streaming import live_store as L

C = Catalogue()
DAY = S.DAY_US
STEP = DAY // 2
FRESH = STREAM_FRESH_DAYS * DAY


def versions(f: Frames):
    """Every stream row as a version whose source clock is right."""
    us = F.unix_micros(F.col("ingested_at").cast("timestamp"))
    rows = f.stream.select(*S.KEY, "quote_id", us.alias("observed_us"), us.alias("effective_us"), "cents", "status")
    w = Window.partitionBy(*S.KEY).orderBy("observed_us", "quote_id")
    return rows.withColumn("revision", F.row_number().over(w))


V = f"""WITH {STREAM}, v0 AS (SELECT provider_id, market_id, selection_id, transport_id, quote_id, epoch_us(ingested_at) AS o, cents, status,
  row_number() OVER (PARTITION BY provider_id, market_id, selection_id, transport_id ORDER BY ingested_at, quote_id) AS revision,
  lead(epoch_us(ingested_at)) OVER (PARTITION BY provider_id, market_id, selection_id, transport_id ORDER BY ingested_at, quote_id) AS z FROM stream),
  v AS (SELECT * FROM v0 WHERE z IS NULL OR z > o)"""


def replay_sql(fresh: int, latency: str = "(VALUES (0)) l(latency)", by: str = "", tail: str = "") -> str:
    """CTEs up to e (latency, t, [provider_id,] market_id, arb, s)."""
    p = by and f"{by}, "
    return f"""{V}, lat AS (SELECT latency::bigint AS latency FROM {latency}),
    g AS (SELECT DISTINCT latency, ((o + latency + {STEP} - 1) // {STEP}) * {STEP} AS t FROM v0, lat),
    x AS (SELECT latency, t, v.* FROM v JOIN g ON o <= t AND t <= o + {fresh} AND (z IS NULL OR t < z)),
    c0 AS (SELECT *, max(o) OVER (PARTITION BY latency, t, provider_id, market_id, selection_id) AS top FROM x WHERE status = 'active'),
    c1 AS (SELECT latency, t, provider_id, market_id, selection_id, any_value(top) AS o, count(DISTINCT cents) AS d,
      arg_min(cents, (transport_id, quote_id)) AS cents, arg_min(quote_id, (transport_id, quote_id)) AS quote_id FROM c0 WHERE o = top GROUP BY 1, 2, 3, 4, 5),
    b AS (SELECT latency, t, {p}market_id, selection_id, max(cents) AS cents FROM c1 WHERE d = 1 GROUP BY ALL),
    k AS (SELECT latency, t, {p}market_id, count(*) AS n, max(CASE WHEN selection_id = 0 THEN cents END)::hugeint AS a,
      max(CASE WHEN selection_id = 1 THEN cents END)::hugeint AS bb, max(CASE WHEN selection_id = 2 THEN cents END)::hugeint AS c FROM b GROUP BY ALL HAVING count(*) = 3),
    e AS (SELECT *, 100 / a::double + 100 / bb::double + 100 / c::double AS s, 100 * (a * bb + bb * c + a * c) < a * bb * c AS arb FROM k){tail}"""


def instants(f):
    return R.grid(versions(f), 0, STEP)


def visible(f, fresh=FRESH):
    return R.as_of(R.validity(versions(f)), instants(f), fresh)


def segments(f, fresh=FRESH, by=("market_id",)):
    """The ranges of the grid in which a market's best prices stand, with what they come to."""
    spans = R.indexed(R.validity(versions(f)), instants(f), fresh).where("status = 'active'")
    return R.priced(R.swept(spans, 3, by))


@C.add("win_revision", f"{V} SELECT quote_id, revision FROM v0")
def _(f):
    return versions(f).select("quote_id", F.col("revision").cast("bigint").alias("revision"))


@C.add("win_validity_ranges", f"{V} SELECT quote_id, o AS observed_us, z AS valid_to_us FROM v")
def _(f):
    return R.validity(versions(f)).select("quote_id", "observed_us", "valid_to_us")


@C.add("bt_grid", f"{replay_sql(FRESH)} SELECT t FROM g")
def _(f):
    return instants(f)


@C.add("join_asof_replay", f"{replay_sql(FRESH)} SELECT t, quote_id, cents FROM x")
def _(f):
    return visible(f).select("t", "quote_id", "cents")


@C.add("bt_strict_quotes", f"{replay_sql(FRESH)} SELECT t, provider_id, market_id, selection_id, quote_id, cents FROM c1 WHERE d = 1")
def _(f):
    from ..operators.books import consolidate

    live = visible(f).where("status = 'active'").withColumnRenamed("effective_us", "effective_ts")
    got = consolidate(live, ("t", "provider_id", "market_id", "selection_id")).where("NOT conflict")
    return got.select("t", "provider_id", "market_id", "selection_id", "quote_id", "cents")


@C.add("bt_run", f"{replay_sql(FRESH)} SELECT t, market_id, round(s, 9) AS implied_sum, arb AS is_arbitrage FROM e")
def _(f):
    return R.at_instants(segments(f), instants(f)).select("t", "market_id", F.round("implied_sum", 9).alias("implied_sum"), "is_arbitrage")


@C.add("bt_detection", f"{replay_sql(FRESH)} SELECT t, market_id, round(1 / s - 1, 9) AS margin FROM e WHERE arb")
def _(f):
    return R.at_instants(segments(f).where("is_arbitrage"), instants(f)).select("t", "market_id", F.round("margin", 9).alias("margin"))


ISLANDS = """, n AS (SELECT t, row_number() OVER (ORDER BY t) AS i, lead(t) OVER (ORDER BY t) AS z FROM g),
  q AS (SELECT market_id, e.t, i, n.z, i - row_number() OVER (PARTITION BY market_id ORDER BY i) AS island FROM e JOIN n ON n.t = e.t WHERE arb)"""
ISLAND_ROWS = "SELECT market_id, min(t) AS opened, coalesce(arg_max(z, t), max(t)) AS ended, bool_or(z IS NULL) AS open_at_end, count(*) AS n FROM q GROUP BY market_id, island"


@C.add("win_opportunity_intervals", f"{replay_sql(FRESH, tail=ISLANDS)} {ISLAND_ROWS}")
def _(f):
    return R.joined_intervals(segments(f).where("is_arbitrage"), instants(f))


@C.add("bt_interval", f"{replay_sql(FRESH, tail=ISLANDS)}, w AS ({ISLAND_ROWS}) SELECT market_id, count(*) AS n, sum(ended - opened)::bigint AS total_us FROM w GROUP BY 1")
def _(f):
    return R.joined_intervals(segments(f).where("is_arbitrage"), instants(f)).groupBy("market_id").agg(F.count("*").alias("n"), F.sum(F.col("ended") - F.col("opened")).alias("total_us"))


def stale(f):
    arbs = lambda fresh: R.at_instants(segments(f, fresh).where("is_arbitrage"), instants(f)).select("t", "market_id")
    return arbs(3 * FRESH).join(arbs(FRESH), ["t", "market_id"], "left_anti")


def stale_sql(tail: str) -> str:
    wide, strict = replay_sql(3 * FRESH), replay_sql(FRESH)
    return f"WITH w AS ({wide} SELECT t, market_id FROM e WHERE arb), s AS ({strict} SELECT t, market_id FROM e WHERE arb), d AS (SELECT * FROM w ANTI JOIN s USING (t, market_id)) {tail}"


@C.add("bt_stale_false_positive", stale_sql("SELECT t, market_id FROM d"))
def _(f):
    return stale(f)


@C.add("bt_stale", stale_sql("SELECT market_id, count(*) AS n, min(t) AS first_t FROM d GROUP BY 1"))
def _(f):
    return stale(f).groupBy("market_id").agg(F.count("*").alias("n"), F.min("t").alias("first_t"))


@C.add("bt_provider_only", f"{replay_sql(FRESH, by='provider_id')} SELECT provider_id, count(*) AS books, count_if(arb)::bigint AS detections FROM e GROUP BY 1")
def _(f):
    return R.at_instants(segments(f, by=("provider_id", "market_id")), instants(f)).groupBy("provider_id").agg(F.count("*").alias("books"), F.count_if("is_arbitrage").alias("detections"))


LATENCIES = (0, 6 * 3_600_000_000, DAY)


@C.add("bt_latency_sensitivity", f"{replay_sql(FRESH, latency='(VALUES (0), (21600000000), (86400000000)) l(latency)')} SELECT latency, count(*) AS books, count_if(arb)::bigint AS detections FROM e GROUP BY 1")
def _(f):
    v = versions(f)
    t = F.ceil((F.col("observed_us") + F.col("latency")) / STEP) * STEP
    each = v.select("observed_us", F.explode(F.array(*[F.lit(x).cast("bigint") for x in LATENCIES])).alias("latency"))
    at = each.select("latency", t.cast("bigint").alias("t")).distinct()
    # what is seen at an instant does not depend on the latency: one sweep over the instants of all, which latencies then pick from
    grid = at.select("t").distinct()
    spans = R.indexed(R.validity(v), grid, FRESH).where("status = 'active'")
    ranges = R.priced(R.swept(spans, 3)).groupBy("low", "high").agg(F.count("*").alias("books"), F.count_if("is_arbitrage").alias("detections"))
    told = R.at_instants(ranges, grid).groupBy("t").agg(F.sum("books").alias("books"), F.sum("detections").alias("detections"))
    return told.join(at, "t").groupBy("latency").agg(F.sum("books").alias("books"), F.sum("detections").alias("detections"))


@C.add("bt_corpus", f"WITH {STREAM} SELECT ingested_at AS batch_time, count(*) AS n, count(DISTINCT (provider_id, market_id, selection_id, transport_id)) AS keys FROM stream GROUP BY 1")
def _(f):
    return f.stream.groupBy(F.col("ingested_at").alias("batch_time")).agg(F.count("*").alias("n"), F.countDistinct(*S.KEY).alias("keys"))


@C.add("agg_provider_counts", f"""{replay_sql(FRESH)}, w AS (SELECT *, row_number() OVER (PARTITION BY t, market_id, selection_id ORDER BY cents DESC, o DESC, provider_id, quote_id) AS r FROM c1 WHERE d = 1)
  SELECT p.provider_id, p.observed, coalesce(best, 0) AS best FROM (SELECT provider_id, count(*) AS observed FROM v0 GROUP BY 1) p LEFT JOIN (SELECT provider_id, count(*) AS best FROM w WHERE r = 1 GROUP BY 1) USING (provider_id)""")
def _(f):
    from ..operators.books import best_prices, consolidate

    live = visible(f).where("status = 'active'").withColumn("effective_ts", F.timestamp_micros("effective_us"))
    merged = consolidate(live, ("t", "provider_id", "market_id", "selection_id")).where("NOT conflict")
    best = best_prices(merged, ("t", "market_id", "selection_id")).groupBy("provider_id").agg(F.count("*").alias("best"))
    seen = versions(f).groupBy("provider_id").agg(F.count("*").alias("observed"))
    return seen.join(best, "provider_id", "left").select("provider_id", "observed", F.coalesce("best", F.lit(0)).alias("best"))


@C.add("agg_summary", f"{replay_sql(FRESH)} SELECT count(DISTINCT t) AS instants, count(*) AS books, count_if(arb)::bigint AS detections, round(max(1 / s - 1), 9) AS top_margin FROM e")
def _(f):
    return R.at_instants(segments(f), instants(f)).agg(
        F.countDistinct("t").alias("instants"), F.count("*").alias("books"), F.count_if("is_arbitrage").alias("detections"), F.round(F.max("margin"), 9).alias("top_margin")
    )


@C.add("agg_matching_quality", """WITH l AS (SELECT CASE WHEN event_id % 7 > 0 THEN user_id END AS e, CASE WHEN event_id % 5 > 0 THEN user_id - (event_id % 11 = 0)::int END AS p FROM events),
  c AS (SELECT count_if(p IS NOT NULL AND p IS NOT DISTINCT FROM e)::bigint AS tp, count_if(p IS NOT NULL AND p IS DISTINCT FROM e)::bigint AS fp, count_if(e IS NOT NULL AND p IS DISTINCT FROM e)::bigint AS fn FROM l)
  SELECT tp, fp, fn, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM c""")
def _(f):
    i, u = F.col("event_id"), F.col("user_id")
    labels = f.table("events").select(F.when(i % 7 > 0, u).alias("expected"), F.when(i % 5 > 0, u - F.when(i % 11 == 0, 1).otherwise(0)).alias("predicted"))
    got = R.quality(labels)
    return got.select("tp", "fp", "fn", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def folded(f):
    return S.fold(f.stream, TOLERANCE_DAYS * DAY)


# the fold has no SQL form: tests hold it against an independent model
@C.add("stm_quote_state")
def _(f):
    return folded(f)


@C.add("stm_late_data")
def _(f):
    return folded(f).groupBy("outcome").agg(F.count("*").alias("n"))


@C.add("stm_multisource_state")
def _(f):
    return S.current(folded(f))


@C.add("stm_clock_skew", f"""WITH {STREAM} SELECT quote_id, CASE WHEN k > 5 THEN 'clock_skew_exceeded' WHEN k > 0 THEN 'clock_skew_detected' END AS issue FROM (SELECT quote_id, quote_id::bigint % 13 - 4 AS k FROM stream)""")
def _(f):
    ahead = F.make_dt_interval(secs=(F.col("quote_id").cast("bigint") % 13 - 4).cast("decimal(18,6)"))
    shifted = f.stream.withColumn("effective", F.col("ingested_at") + ahead)
    gap = F.col("effective") - F.col("ingested_at")
    limit, zero = F.expr("INTERVAL '5' SECOND"), F.expr("INTERVAL '0' SECOND")
    return shifted.select("quote_id", F.when(gap > limit, "clock_skew_exceeded").when(gap > zero, "clock_skew_detected").alias("issue"))


LATEST = f"""{V}, m AS (SELECT * FROM v0 WHERE z IS NULL), n AS (SELECT max(o) AS now FROM v0)"""


@C.add("stm_evict", f"{LATEST} SELECT quote_id, CASE WHEN status <> 'active' THEN 'inactive_evicted' ELSE 'stale_evicted' END AS reason FROM m, n WHERE status <> 'active' OR now - o > {FRESH}")
def _(f):
    _, last = stored(f)
    now = last.agg(F.max("seen_us")).scalar()
    stale = ~F.col("alive") | (now - F.col("effective_us") > FRESH)
    reason = F.when(F.col("status") != "active", "inactive_evicted").when(stale, "stale_evicted")
    return last.select("quote_id", reason.alias("reason")).where("reason IS NOT NULL")


def stored(f: Frames, starts: int = 4):
    """What the live store tells of the stream's versions, fed in so many starts on one checkpoint, and the state it leaves."""
    home = D.landing(f.spark, "store")
    rows = versions(f).select(*S.KEY, "quote_id", "cents", "status", "observed_us", "effective_us", F.col("observed_us").alias("ingested_us"))
    shards = L.shards_for(f.stream.count())
    told = L.in_starts(rows, "observed_us", starts, home, lambda came: L.live(came, TOLERANCE_DAYS * DAY, FRESH, shards=shards))
    return f.spark.read.schema(L.TOLD).parquet(told), L.held(f.spark, home, "version")


@C.add("stm_invalidate", f"""WITH {STREAM}, o AS (SELECT transport_id, market_id, CASE WHEN quote_id::bigint % 3 > 0 THEN selection_id END AS selection_id, ingested_at FROM stream WHERE status <> 'active'),
  sel AS (SELECT DISTINCT market_id, selection_id FROM stream) SELECT DISTINCT transport_id, o.market_id, coalesce(o.selection_id, sel.selection_id) AS selection_id, ingested_at
  FROM o JOIN sel ON sel.market_id = o.market_id AND (o.selection_id IS NULL OR o.selection_id = sel.selection_id)""")
def _(f):
    rows = f.stream.withColumn("selection_id", F.when(F.col("quote_id").cast("bigint") % 3 > 0, F.col("selection_id")))
    return S.invalidations(rows, f.stream.select("market_id", "selection_id").distinct()).select("transport_id", "market_id", "selection_id", "ingested_at")


@C.add("stm_suppressed", f"""{V}, x AS (SELECT *, lag(status) OVER k AS was, min(CASE WHEN status = 'active' THEN o END) OVER (PARTITION BY provider_id, market_id, selection_id, transport_id ORDER BY o, quote_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS again,
  max(CASE WHEN status <> 'active' THEN o END) OVER (PARTITION BY provider_id, market_id, selection_id, transport_id) AS last FROM v0 WINDOW k AS (PARTITION BY provider_id, market_id, selection_id, transport_id ORDER BY o, quote_id))
  SELECT provider_id, market_id, selection_id, transport_id, o AS invalidated_us, coalesce(again, last + {FRESH}) AS until_us FROM x WHERE status <> 'active' AND (was IS NULL OR was = 'active')""")
def _(f):
    told, last = stored(f)
    closed = told.where("kind = 'suppressed'").select(*S.KEY, F.col("from_us").alias("invalidated_us"), "until_us")
    return closed.unionByName(last.where("off_us IS NOT NULL").select(*S.KEY, F.col("off_us").alias("invalidated_us"), (F.col("last_off_us") + FRESH).alias("until_us")))


# the stream, restarted between its parts, tells what the batch fold with eviction tells; tests hold both against each other
@C.add("stm_lives")
def _(f):
    told, _ = stored(f)
    return told.where("kind = 'observation'").select(*S.KEY, "quote_id", "outcome", "revision", "life", "evicted_us")


@C.add("agg_max_age", f"{LATEST} SELECT max(now - o) AS max_age_us, count_if(now - o > {FRESH})::bigint AS stale FROM m, n")
def _(f):
    v = versions(f)
    last = v.groupBy(*S.KEY).agg(F.max("effective_us").alias("effective_us"))
    top = v.agg(F.max("observed_us").alias("now")).scalar()
    age = F.col("now") - F.col("effective_us")
    return last.withColumn("now", top).agg(F.max(age).alias("max_age_us"), F.count_if(age > FRESH).alias("stale"))


@C.add("win_counterfactual_window", f"{replay_sql(3 * FRESH)} SELECT t, greatest({FRESH}, max(t - o) + 1) AS window_us FROM x GROUP BY 1")
def _(f):
    seen = visible(f, 3 * FRESH).groupBy("t").agg(F.max(F.col("t") - F.col("effective_us")).alias("age"))
    return seen.select("t", R.widened(F.lit(FRESH), F.col("age")).alias("window_us"))
