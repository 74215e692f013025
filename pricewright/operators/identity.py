"""Alias resolution, event matching and registry checks as joins and grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import time_score

MINUTE_US = 60_000_000
#: Points of an event match, its threshold and ambiguity margin, and its time tolerances.
BASE_POINTS, STAGE_POINTS, VENUE_POINTS, REFERENCE_POINTS = 7_000, 400, 300, 1_000
LEAST_POINTS, MARGIN_POINTS = 8_500, 250
TOLERANCE_US, REFERENCED_TOLERANCE_US = 30 * MINUTE_US, 48 * 60 * MINUTE_US


def resolve(keys: DataFrame, aliases: DataFrame, context: tuple[str, ...] = ()) -> DataFrame:
    """Status and canonical id of each key row (row_id, alias, provider_id, context...).

    aliases: alias, canonical_id, provider_id (null: any), context columns (null: any). Provider-specific rows
    shadow the generic ones; a context that is set on both sides and differs rules an alias out.
    resolved: exactly one id; ambiguous: several; conflict: only ruled-out ones; unknown: none.
    """
    a = aliases.select(
        "alias", "canonical_id", F.col("provider_id").alias("a_provider"), *[F.col(c).alias(f"a_{c}") for c in context]
    )
    met = keys.join(a, "alias", "left").where("a_provider IS NULL OR a_provider = provider_id")
    conflict = F.lit(False)
    for c in context:
        conflict = conflict | F.coalesce(F.col(c) != F.col(f"a_{c}"), F.lit(False))
    met = met.withColumn("specific", F.col("a_provider").isNotNull()).withColumn("out", conflict)
    top = Window.partitionBy("row_id")
    shown = met.withColumn("top", F.max(F.when(F.col("canonical_id").isNotNull(), F.col("specific"))).over(top))
    shown = shown.where(F.col("canonical_id").isNotNull() & (F.col("specific") == F.col("top")))
    # ids are compared by their least and greatest: no set is gathered
    fit = F.when(~F.col("out"), F.col("canonical_id"))
    held = shown.groupBy("row_id").agg(F.min(fit).alias("low"), F.max(fit).alias("high"), F.count("*").alias("n"))
    out = keys.select("row_id").distinct().join(held, "row_id", "left")
    status = (
        F.when(F.col("n").isNull(), "unknown").when(F.col("low").isNull(), "conflict").when(F.col("low") == F.col("high"), "resolved").otherwise("ambiguous")
    )
    return out.select("row_id", status.alias("status"), F.when(F.col("low") == F.col("high"), F.col("low")).alias("canonical_id"))


def participant_key(*ids: Column) -> Column:
    """Order-free key of participants."""
    return F.array_join(F.array_sort(F.array(*[i.cast("string") for i in ids])), "|")


def candidates(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Scored candidates: equal sport, competition and participant set, kickoff within tolerance, no conflicting metadata.

    evidence: source_id, sport, competition_id, participants, start_us, stage, venue, external_id.
    events: event_id, sport, competition_id, participants, start_us, stage, venue, external_id (this provider's, or null).
    """
    e = events.select("event_id", "sport", "competition_id", "participants", *[F.col(c).alias(f"e_{c}") for c in ("start_us", "stage", "venue", "external_id")])
    met = evidence.join(e, ["sport", "competition_id", "participants"])
    exact = F.coalesce(F.col("e_external_id") == F.col("external_id"), F.lit(False))
    tolerance = F.when(exact, F.lit(REFERENCED_TOLERANCE_US)).otherwise(F.lit(TOLERANCE_US)).cast("bigint")
    delta = F.abs(F.col("start_us") - F.col("e_start_us"))
    both = lambda c: F.col(c).isNotNull() & F.col(f"e_{c}").isNotNull()
    differs = lambda c: both(c) & (F.col(c) != F.col(f"e_{c}"))
    points = (
        F.lit(BASE_POINTS) + time_score(delta, tolerance)
        + F.when(both("stage"), STAGE_POINTS).otherwise(0) + F.when(both("venue"), VENUE_POINTS).otherwise(0) + F.when(exact, REFERENCE_POINTS).otherwise(0)
    )
    kept = met.where((F.col("e_external_id").isNull() | exact) & (delta <= tolerance) & ~differs("stage") & ~differs("venue"))
    return kept.select("source_id", "event_id", F.least(points, F.lit(10_000)).cast("bigint").alias("points"), delta.alias("delta_us"))


def decisions(evidence: DataFrame, scored: DataFrame) -> DataFrame:
    """matched, ambiguous or rejected per source event; the best candidate by (points, delta, id)."""
    ok = scored.where(F.col("points") >= LEAST_POINTS)
    order = F.struct((-F.col("points")).alias("p"), F.col("delta_us").alias("d"), F.col("event_id").alias("e"))
    best = ok.groupBy("source_id").agg(F.min(order).alias("b"), F.max("points").alias("top"))
    close = ok.join(best, "source_id").where(F.col("top") - F.col("points") <= MARGIN_POINTS).groupBy("source_id").agg(F.count("*").alias("near"))
    out = evidence.select("source_id").join(best, "source_id", "left").join(close, "source_id", "left")
    status = F.when(F.col("top").isNull(), "rejected").when(F.col("near") > 1, "ambiguous").otherwise("matched")
    matched = F.col("status") == "matched"
    return out.withColumn("status", status).select(
        "source_id", "status", F.when(matched, F.col("b.e")).alias("event_id"), F.when(matched, F.col("top")).alias("points")
    )


def missing_stage(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """Which hard filter fails first for source events without candidates: sport, competition or participant."""
    flag = lambda cols, name: events.select(*cols).distinct().withColumn(name, F.lit(True))
    out = (
        evidence.join(flag(["sport"], "s"), "sport", "left")
        .join(flag(["sport", "competition_id"], "c"), ["sport", "competition_id"], "left")
        .join(flag(["sport", "competition_id", "participants"], "p"), ["sport", "competition_id", "participants"], "left")
    )
    reason = F.when(F.col("s").isNull(), "sport_mismatch").when(F.col("c").isNull(), "competition_mismatch").when(F.col("p").isNull(), "participant_mismatch")
    return out.select("source_id", reason.alias("reason"))


def unique_pairs(left: DataFrame, right: DataFrame, within_us: int) -> DataFrame:
    """Pairs with one key and kickoffs within within_us that are the only ones of both their sides."""
    met = left.select(F.col("id").alias("left_id"), "key", F.col("start_us").alias("ls")).join(
        right.select(F.col("id").alias("right_id"), "key", F.col("start_us").alias("rs")), "key"
    ).where(F.abs(F.col("ls") - F.col("rs")) <= within_us)
    alone = lambda c: F.count("*").over(Window.partitionBy(c)) == 1
    return met.withColumn("l1", alone("left_id")).withColumn("r1", alone("right_id")).where("l1 AND r1").select("left_id", "right_id")


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    return child.join(parent.select(column).distinct(), column, "left_anti")


def exact_outcomes(selections: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """(market_id, ok): whether a market's selections are exactly the wanted kinds, each once, without a handicap."""
    hit = [F.count_if(F.col("kind") == k).alias(f"n{i}") for i, k in enumerate(wanted)]
    counted = selections.groupBy("market_id").agg(F.count("*").alias("n"), F.count("handicap").alias("h"), *hit)
    ok = (F.col("n") == len(wanted)) & (F.col("h") == 0)
    for i in range(len(wanted)):
        ok = ok & (F.col(f"n{i}") == 1)
    return counted.select("market_id", ok.alias("ok"))


def anchored(evidence: DataFrame, official: DataFrame) -> DataFrame:
    """(source_id, event_id, status): the one official event of the competition that starts at that moment, if it is one.

    official: competition_id, start_us, event_id. Least and count are enough: no list of events is gathered.
    """
    at = official.groupBy("competition_id", "start_us").agg(F.count("*").alias("n"), F.min("event_id").alias("event_id"))
    met = evidence.select("source_id", "competition_id", "start_us").join(at, ["competition_id", "start_us"], "left")
    status = F.when(F.col("n").isNull(), "no_official_event").when(F.col("n") > 1, "several_official_events").otherwise("anchored")
    return met.select("source_id", F.when(F.col("n") == 1, F.col("event_id")).alias("event_id"), status.alias("status"))


def two_of_the_event(picks: DataFrame, members: DataFrame) -> DataFrame:
    """(market_id, ok): whether a head-to-head market's picks (market_id, event_id, participant_id) are two different members (event_id, participant_id) of its event."""
    met = picks.join(members.withColumn("member", F.lit(True)), ["event_id", "participant_id"], "left")
    counted = met.groupBy("market_id").agg(F.count("*").alias("n"), F.min("participant_id").alias("low"), F.max("participant_id").alias("high"), F.count("member").alias("members"))
    return counted.select("market_id", ((F.col("n") == 2) & (F.col("low") != F.col("high")) & (F.col("members") == 2)).alias("ok"))


def opposed_handicaps(selections: DataFrame) -> DataFrame:
    """(market_id, ok): whether a market's selections (market_id, line, kind, handicap) are home at its line and away at the opposite one, each once."""
    home, away = (F.col("kind") == "home") & (F.col("handicap") == F.col("line")), (F.col("kind") == "away") & (F.col("handicap") == -F.col("line"))
    counted = selections.groupBy("market_id").agg(F.count("*").alias("n"), F.count_if(home).alias("home"), F.count_if(away).alias("away"))
    return counted.select("market_id", ((F.col("n") == 2) & (F.col("home") == 1) & (F.col("away") == 1)).alias("ok"))
