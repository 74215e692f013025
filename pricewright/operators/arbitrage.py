"""Exact reciprocal-sum tests, market metrics, refundable pairs and exchange portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.udfs import exact_book

#: Digits to a limb of the exact comparison: a remainder times BASE stays a long.
DIGITS = 6
BASE = 10**DIGITS


def reciprocal_sum(cents: Column, scale: int = 100) -> Column:
    """Sum of scale / price in double precision, for reports."""
    return F.aggregate(cents, F.lit(0.0), lambda a, p: a + scale / p.cast("double"))


def room(cents: Column, top: int = 100, bottom: int = 1) -> Column:
    """1, 0 or -1 as the sum of top / (bottom * price) is below, equal to or above one; exact for any number of prices.

    Each reciprocal is divided out limb by limb, and only the gap that is left to one is carried: a gap of as many
    last places as there are prices decides for good. Unlike one, a sum differs from it by at least the product of
    the prices' inverse, so after that many places an open gap means equal. Prices are whole and positive.
    """
    # three prices whose products are longs, the common case, are compared as they are
    most = min(int((9e18 / bottom) ** (1 / 3)), int((3e18 / top) ** 0.5))
    a, b, c = (F.get(cents, F.lit(k)).cast("bigint") for k in range(3))
    gap = F.lit(bottom).cast("bigint") * a * b * c - F.lit(top).cast("bigint") * (a * b + b * c + a * c)
    return F.when((F.size(cents) == 3) & (F.array_max(cents) < most), F.signum(gap.cast("double")).cast("int")).otherwise(_room(cents, top, bottom))


def _room(cents: Column, top: int, bottom: int) -> Column:
    n = F.size(cents)
    rest = lambda p: F.lit(bottom).cast("bigint") * p.cast("bigint")
    digits = F.aggregate(cents, F.lit(0.0), lambda a, p: a + F.log10(rest(p).cast("double"))) + F.log10(F.greatest(n, F.lit(1)).cast("double"))
    zero = F.struct(F.lit(1).cast("bigint").alias("gap"), F.transform(cents, lambda p: F.lit(top).cast("bigint")).alias("left"))

    def step(s: Column, _: Column) -> Column:
        pairs = F.arrays_zip(s["left"].alias("r"), cents.alias("p"))
        taken = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, x: a + F.call_function("div", x["r"] * BASE, rest(x["p"])))
        after = F.transform(pairs, lambda x: (x["r"] * BASE) % rest(x["p"]))
        return F.when((s["gap"] <= 0) | (s["gap"] >= n), s).otherwise(F.struct((s["gap"] * BASE - taken).alias("gap"), after.alias("left")))

    def told(s: Column) -> Column:
        over = (s["gap"] < 0) | ((s["gap"] == 0) & F.exists(s["left"], lambda r: r > 0))
        return F.when(s["gap"] >= n, 1).when(over, -1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.ceil(digits / DIGITS) + 1), zero, step, told)


def is_arbitrage(cents: Column, scale: int = 100) -> Column:
    """Whether the reciprocals sum to less than one, exactly."""
    return room(cents, scale) > 0


def evaluated(books: DataFrame, least_margin: float = 0.0) -> DataFrame:
    """books with implied_sum, return_multiplier, margin and is_arbitrage (a margin of least_margin, four decimals, exactly tested)."""
    cents = F.transform("outcomes", lambda o: o["cents"])
    won = is_arbitrage(cents)
    if least_margin > 0:
        won = won & (room(cents, 100 * (10_000 + round(least_margin * 10_000)), 10_000) >= 0)
    return (
        books.withColumn("implied_sum", reciprocal_sum(cents))
        .withColumn("return_multiplier", 1 / F.col("implied_sum"))
        .withColumn("margin", 1 / F.col("implied_sum") - 1)
        .withColumn("is_arbitrage", won)
    )


def opportunities(evaluated_books: DataFrame, exact: bool = False) -> DataFrame:
    """The books that are arbitrages; exact adds implied60 and margin60, 60-digit texts (an Arrow UDF over these few rows)."""
    found = evaluated_books.where("is_arbitrage").withColumn("quote_ids", F.transform("outcomes", lambda o: o["quote_id"]))
    if not exact:
        return found
    prices = F.transform("outcomes", lambda o: (o["cents"].cast("decimal(20,0)") / 100).cast("decimal(22,2)").cast("string"))
    both = exact_book(prices)
    return found.withColumn("exact", both).withColumns({"implied60": F.col("exact.implied"), "margin60": F.col("exact.margin")}).drop("exact")


def refundable(odds_a: Column, odds_b: Column) -> Column:
    """struct(decisive_margin, refund_multiplier, worst, strict): two-way market whose stakes come back on a draw."""
    decisive = 1 / (1 / odds_a + 1 / odds_b)
    return F.struct(
        (decisive - 1).alias("decisive_margin"),
        F.lit(1.0).alias("refund_multiplier"),
        F.least(decisive, F.lit(1.0)).alias("worst"),
        F.lit(False).alias("strict"),
    )


def scenario_profit(legs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Per (market_id, winner) gross, commission and net of bookmaker and exchange legs.

    legs: market_id, selection_id, side (back or lay), price, stake, exchange_id (null at bookmakers), scope, rate.
    outcomes: market_id, winner; a market's few outcomes meet its legs by an equi-join on the market.
    Commission is taken once per (exchange, scope), from a positive net only.
    """
    won = F.col("selection_id") == F.col("winner")
    profit = F.when(
        F.col("side") == "back", F.when(won, F.col("stake") * (F.col("price") - 1)).otherwise(-F.col("stake"))
    ).otherwise(F.when(won, -F.col("stake") * (F.col("price") - 1)).otherwise(F.col("stake")))
    net = legs.join(outcomes, "market_id").groupBy("market_id", "winner", "exchange_id", "scope").agg(
        F.sum(profit).alias("gross"), F.max("rate").alias("rate")
    )
    commission = F.when(F.col("exchange_id").isNotNull() & (F.col("gross") > 0), F.col("gross") * F.col("rate")).otherwise(0)
    return (
        net.groupBy("market_id", "winner")
        .agg(F.sum("gross").alias("gross"), F.sum(commission).alias("commission"))
        .withColumn("net", F.col("gross") - F.col("commission"))
    )


def liquidity_overuse(legs: DataFrame) -> DataFrame:
    """Price levels whose summed stakes exceed the least availability seen."""
    level = ("market_id", "selection_id", "exchange_id", "transport_id", "side", "price", "scope")
    return legs.groupBy(*level).agg(F.sum("stake").alias("used"), F.min("available").alias("limit")).where("used > limit")


def rate_conflicts(legs: DataFrame) -> DataFrame:
    """(exchange, scope) with more than one commission rate: least and greatest suffice, no distinct count."""
    return (
        legs.groupBy("market_id", "exchange_id", "scope").agg(F.min("rate").alias("low"), F.max("rate").alias("high")).where("low <> high")
    )
