"""Predicates over rows: what may enter a computation, and why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import is_half_line, is_half_total


def market_support(sport: Column, kind: Column, period: Column, line: Column, index: Column, purpose: Column) -> Column:
    """Whether a market family is supported; null conditions count as not met."""
    half_total, half = F.coalesce(is_half_total(line), F.lit(False)), F.coalesce(is_half_line(line), F.lit(False))
    football, basketball = sport == "football", sport == "basketball"
    regulation, full = period == "regulation", period == "full_event"
    refund = (purpose == "settlement_aware") & F.coalesce(line == 0, F.lit(False))
    return F.coalesce(
        F.when(kind.isin("match_winner_2_way", "match_winner_3_way"), True)
        .when(kind == "total_points", (football & regulation & half_total) | (basketball & full & half_total))
        .when(kind == "both_teams_to_score", football & regulation)
        .when(kind == "set_winner", (sport == "tennis") & (period == "set") & index.isin(1, 2))
        .when(kind == "handicap", (football & regulation & (half | refund)) | (basketball & full & half))
        .otherwise(False),
        F.lit(False),
    )


def blockers(*rules: tuple[str, Column]) -> Column:
    """The texts of the rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, t) for t, c in rules]))


#: The blockers of outright arithmetic in their order, and the flag value that blocks.
OUTRIGHT = (
    ("candidate set is incomplete", "candidate_set_complete", False),
    ("candidate set is dynamic", "candidate_set_static", False),
    ("outcomes are not mutually exclusive", "mutually_exclusive", False),
    ("outcomes are not exhaustive", "exhaustive", False),
    ("field/other outcome is present", "has_field_or_other", True),
    ("ties can produce non-exclusive settlement", "ties_possible", True),
    ("dead-heat settlement can split returns", "dead_heat_possible", True),
    ("withdrawal settlement rules are not proven equivalent", "withdrawal_rules_equivalent", False),
    ("void settlement rules are not proven equivalent", "void_rules_equivalent", False),
)


def outright_blockers() -> Column:
    return blockers(*((text, F.col(flag) == F.lit(bad)) for text, flag, bad in OUTRIGHT))


#: The blockers of an exchange price in their order, each with the condition that blocks.
EXCHANGE = (
    ("price is not active", "status <> 'active'"),
    ("BACK/LAY side identity is missing", "side IS NULL"),
    ("matched liquidity is missing", "available IS NULL"),
    ("commission rate is missing", "rate IS NULL"),
    ("commission scope/account-market provenance is missing", "scope IS NULL"),
    ("settlement-rule equivalence is not verified", "NOT rules_verified"),
)


def exchange_blockers() -> Column:
    return blockers(*((text, F.expr(condition)) for text, condition in EXCHANGE))


def exchange_price_valid(price: Column, available: Column, rate: Column) -> Column:
    return (price > 1) & F.coalesce(available > 0, F.lit(True)) & F.coalesce((rate >= 0) & (rate < 1), F.lit(True))


def attested(claims: DataFrame, key: str) -> DataFrame:
    """(key, review) of claims (key, source, claim): incomplete if a claim lacks its source or what it says, conflict if claims differ, else complete."""
    whole = F.count_if(F.col("source").isNotNull() & F.col("claim").isNotNull())
    counted = claims.groupBy(key).agg(whole.alias("whole"), F.count("*").alias("n"), F.min("claim").alias("low"), F.max("claim").alias("high"))
    return counted.select(key, F.when(F.col("whole") < F.col("n"), "incomplete").when(F.col("low") != F.col("high"), "conflict").otherwise("complete").alias("review"))


def ruled(quotes: DataFrame, rules: DataFrame) -> DataFrame:
    """quotes (provider_id, side, effective_ts, ...) with equivalent: what the latest rule says that was in force; null without one.

    rules: provider_id, side, since, equivalent. A provider's few rules are gathered into one row, so a quote meets one row.
    """
    listed = rules.groupBy("provider_id", "side").agg(F.array_sort(F.collect_list(F.struct("since", "equivalent"))).alias("rules"))
    met = quotes.join(listed, ["provider_id", "side"], "left")
    inforce = F.filter("rules", lambda r: r["since"] <= F.col("effective_ts"))
    return met.withColumn("equivalent", F.get(inforce, F.size(inforce) - 1)["equivalent"]).drop("rules")


def market_issue(kind: Column, period: Column, line: Column, index: Column, set_index: Column, subject: Column) -> Column:
    """First broken invariant of a market row."""
    lined, indexed = kind.isin("total_points", "handicap"), period.isin("set", "game", "period", "quarter")
    return (
        F.when(lined & line.isNull(), "line_required")
        .when(~lined & line.isNotNull(), "line_unexpected")
        .when(indexed & (index.isNull() | (index < 1)), "period_index_required")
        .when(~indexed & index.isNotNull(), "period_index_unexpected")
        .when((period == "game") & (set_index.isNull() | (set_index < 1)), "set_index_required")
        .when((period != "game") & set_index.isNotNull(), "set_index_unexpected")
        .when((kind == "set_winner") & (period != "set"), "set_period_required")
        .when((kind == "game_winner") & (period != "game"), "game_period_required")
        .when((kind == "podium_finish") != subject.isNotNull(), "subject_mismatch")
    )
