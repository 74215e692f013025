"""Consolidation, best prices and complete books.

All work is grouped aggregation with map-side partial results: no operator gathers the quotes of a
market, so a market of any size costs one small row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOT = ("provider_id", "event_id", "market_id", "selection_id")


def first_issue(*rules: tuple[str, Column]) -> Column:
    """The code of the first rule whose condition holds, else null; a null condition does not hold."""
    out = None
    for code, condition in rules:
        out = F.when(condition, code) if out is None else out.when(condition, code)
    return out


def quote_issues(quotes: DataFrame, as_of: Column, window: Column, allowed: Column | None = None) -> DataFrame:
    """quotes with issue: the ordered gate of the book builder, null for an eligible quote.

    Rows may carry known_event, known_market, known_selection, event_matches, selection_matches (booleans)
    from a registry join; absent ones are taken as true.
    """
    has = lambda c: F.col(c) if c in quotes.columns else F.lit(True)
    counted = quotes.withColumn("_n", F.count("*").over(Window.partitionBy("quote_id")))
    age = as_of - F.col("effective_ts")
    issue = first_issue(
        ("duplicate_quote_id", F.col("_n") > 1),
        ("unknown_event", ~has("known_event")),
        ("unknown_market", ~has("known_market")),
        ("unknown_selection", ~has("known_selection")),
        ("quote_event_mismatch", ~has("event_matches")),
        ("quote_selection_mismatch", ~has("selection_matches")),
        ("provider_filtered", ~(F.lit(True) if allowed is None else allowed)),
        ("inactive_quote", F.col("status") != "active"),
        ("future_ingestion", (F.col("ingested_at") if "ingested_at" in quotes.columns else F.col("effective_ts")) > as_of),
        ("future_quote", F.col("effective_ts") > as_of),
        ("stale_quote", age > window),
    )
    return counted.withColumn("issue", issue).drop("_n")


def best_prices(quotes: DataFrame, by: tuple[str, ...] = ("market_id", "selection_id")) -> DataFrame:
    """Per group the highest price, then the newest, then the least provider and id: one partial aggregate."""
    rank = F.struct(
        (-F.col("cents")).alias("price"),
        (-F.unix_micros(F.col("effective_ts").cast("timestamp"))).alias("age"),
        F.col("provider_id").alias("provider_id"),
        F.col("quote_id").alias("quote_id"),
        F.col("effective_ts").alias("effective_ts"),
    )
    best = quotes.groupBy(*by).agg(F.min(rank).alias("b"))
    return best.select(*by, (-F.col("b.price")).alias("cents"), "b.provider_id", "b.quote_id", "b.effective_ts")


def books(best: DataFrame, expected: int, by: tuple[str, ...] = ("market_id",)) -> DataFrame:
    """Markets in which every expected selection has a best quote, with prices in order of selection."""
    rows = F.array_sort(F.collect_list(F.struct("selection_id", "cents", "quote_id", "provider_id", "effective_ts")))
    book = best.groupBy(*by).agg(
        rows.alias("outcomes"),  # one row a selection: bounded by the market's outcomes
        F.min("effective_ts").alias("oldest"),
        F.max("effective_ts").alias("newest"),
    )
    return book.where(F.size("outcomes") == expected)


def consolidate(quotes: DataFrame, slot: tuple[str, ...] = SLOT, newest: str = "effective_ts") -> DataFrame:
    """Per slot the newest observations; equal ones survive as the first by transport, unequal ones are a conflict.

    Returns slot, newest, n (observations at that time), conflict, and the surviving transport_id, quote_id, cents, status.
    """
    at = quotes.groupBy(*slot, newest).agg(
        F.count("*").alias("n"),
        F.min(F.struct("transport_id", "quote_id", "cents", "status")).alias("one"),
        F.min(F.struct("cents", "status")).alias("low"),
        F.max(F.struct("cents", "status")).alias("high"),
    )
    last = at.groupBy(*slot).agg(F.max(F.struct(newest, "n", "one", (F.col("low") != F.col("high")).alias("conflict"))).alias("m"))
    return last.select(
        *slot, F.col(f"m.{newest}").alias(newest), "m.n", "m.conflict", "m.one.transport_id", "m.one.quote_id", "m.one.cents", "m.one.status"
    )


def diagnostics_by_market(issues: DataFrame) -> DataFrame:
    return issues.where("issue IS NOT NULL").groupBy("market_id", "issue").agg(F.count("*").alias("n"), F.min("quote_id").alias("first_quote"))
