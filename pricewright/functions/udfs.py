"""The few functions that need more than native columns: Unicode keys and 60-digit arithmetic, as Arrow UDFs."""

from __future__ import annotations

import unicodedata
from decimal import ROUND_HALF_EVEN, Context, Decimal, DecimalException, InvalidOperation
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CONTEXT = Context(prec=60, rounding=ROUND_HALF_EVEN)
ONE, HUNDRED = Decimal(1), Decimal(100)


def alias_key_of(text: str | None) -> str | None:
    """NFKC, casefold, white space collapsed; null if empty, over 512 characters or with control characters."""
    if text is None:
        return None
    key = " ".join(unicodedata.normalize("NFKC", text).casefold().split())
    if not key or len(key) > 512 or any(ord(c) < 32 for c in key):
        return None
    return key


def decimal60(price: str | None, fmt: str | None) -> str | None:
    """Decimal odds over 1 to 60 digits, as text; null for what cannot be a price."""
    try:
        raw = (price or "").strip()
        if fmt == "decimal":
            odds = Decimal(raw)
        elif fmt == "fractional":
            top, bottom = (Decimal(x.strip()) for x in raw.split("/"))
            if not (top > 0 and bottom > 0):
                return None
            odds = CONTEXT.add(ONE, CONTEXT.divide(top, bottom))
        elif fmt == "american":
            line = Decimal(raw)
            if not line.is_finite() or line == 0:
                return None
            odds = CONTEXT.add(ONE, CONTEXT.divide(line, HUNDRED) if line > 0 else CONTEXT.divide(HUNDRED, -line))
        elif fmt == "implied_probability":
            p = Decimal(raw)
            if not 0 < p < 1:
                return None
            odds = CONTEXT.divide(ONE, p)
        else:
            return None
        return str(odds) if odds.is_finite() and odds > 1 else None
    except (InvalidOperation, DecimalException, ValueError):
        return None


def exact_book_of(prices: list[str] | None) -> tuple[str, str, bool] | None:
    """(sum of reciprocals, margin, arbitrage) of one price per outcome: 60 digits, the test itself exact."""
    try:
        odds = [Decimal(p) for p in prices or ()]
    except InvalidOperation:
        return None
    if len(odds) < 2 or any(not o.is_finite() or o <= 1 for o in odds):
        return None
    total = sum((1 / Fraction(o) for o in odds), Fraction(0))
    implied = CONTEXT.divide(Decimal(total.numerator), Decimal(total.denominator))
    margin = CONTEXT.subtract(CONTEXT.divide(Decimal(total.denominator), Decimal(total.numerator)), ONE)
    return str(implied), str(margin), total < 1 and margin > 0


def _alias_keys(text: pd.Series) -> pd.Series:
    return text.map(alias_key_of)


def _decimals60(price: pd.Series, fmt: pd.Series) -> pd.Series:
    return pd.Series([decimal60(p, f) for p, f in zip(price, fmt)], dtype=object)


def _exact_books(prices: pd.Series) -> pd.DataFrame:
    rows = [exact_book_of(None if p is None else list(p)) or (None, None, None) for p in prices]
    return pd.DataFrame(rows, columns=["implied", "margin", "is_arbitrage"])


def alias_key(text: Column) -> Column:
    return F.pandas_udf(_alias_keys, "string")(text)


def odds_to_decimal60(price: Column, fmt: Column) -> Column:
    return F.pandas_udf(_decimals60, "string")(price, fmt)


def exact_book(prices: Column) -> Column:
    """struct(implied, margin, is_arbitrage) of an array of price texts."""
    return F.pandas_udf(_exact_books, "implied string, margin string, is_arbitrage boolean")(prices)


def register(spark: SparkSession) -> None:
    """The functions under their names in SQL."""
    spark.udf.register("alias_key", F.pandas_udf(_alias_keys, "string"))
    spark.udf.register("odds_to_decimal60", F.pandas_udf(_decimals60, "string"))
    spark.udf.register("exact_book", F.pandas_udf(_exact_books, "implied string, margin string, is_arbitrage boolean"))
