"""Exact selection by rank from whole-numbered values: percentiles and page borders without sorting, or gathering, a group.

The values of a group are counted in PARTS ranges of equal width, each rank's range is found from the running counts and is counted again in finer
ranges, until a range is one value: at most seven passes over 64-bit values, two over a million. A pass moves one row a range, task and rank asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.feed_source import landing

PARTS = 1024


def _kept(df: DataFrame) -> DataFrame:
    """Written and read again, so a pass does not repeat those before it."""
    path = landing(df.sparkSession, "selection")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def selected(rows: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(by, name, n, value, before): per group and named rank (a column over n, the group's count, from 0) the value at that rank.

    before is how many rows of the value come first. value is whole-numbered, within 2^62 of zero; null values are left out, and a rank beyond the
    group's last row gives no row.
    """
    rows = rows.select(*by, F.col(value).cast("bigint").alias("v")).where("v IS NOT NULL")
    group = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), r.cast("bigint").alias("rank")) for k, r in ranks.items()]))
    open_ = _kept(group.where("n > 0").withColumn("r", each).select(*by, "n", "low", "high", "r.name", "r.rank").where("rank >= 0 AND rank < n"))
    key = [*by, "name"]
    while open_.where("low < high").limit(1).count():
        width = (F.expr("(high - low) div {}".format(PARTS)) + 1).alias("width")
        asked = open_.select(*key, "low", "high", width)
        met = rows.join(asked, by) if by else rows.crossJoin(F.broadcast(asked))  # without groups, a row a rank
        cells = met.where("v >= low AND v <= high").groupBy(*key, F.expr("(v - low) div width").alias("cell")).agg(F.count("*").alias("m"))
        upto = F.sum("m").over(Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        found = cells.withColumn("upto", upto).join(open_.select(*key, "rank"), key).where("upto > rank")
        found = found.groupBy(*key).agg(F.min(F.struct("cell", "m", "upto")).alias("f"))
        finer = open_.withColumn("width", width).join(found, key)
        low = F.col("low") + F.col("f.cell") * F.col("width")
        open_ = _kept(finer.select(*by, "n", low.alias("low"), F.least("high", low + F.col("width") - 1).alias("high"), "name", (F.col("rank") - F.col("f.upto") + F.col("f.m")).alias("rank")))
    return open_.select(*by, "name", "n", F.col("low").alias("value"), F.col("rank").alias("before"))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the median (the mean of the middle values), the discrete percentiles of shares and the worst value."""
    n = F.col("n")
    # a share with its decimals as whole numbers: the first rank that reaches it
    ranks = {k: F.ceil(n * round(p * 10_000) / 10_000) - 1 for k, p in shares.items()}
    ranks |= {"mid_low": F.floor((n - 1) / 2), "mid_high": F.floor(n / 2), "worst": n - 1}
    got = selected(rows, by, value, ranks).groupBy(*by).agg(*(F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in ranks))
    return got.select(*by, ((F.col("mid_low") + F.col("mid_high")) / 2).alias("median"), *shares, "worst")


def sought(df: DataFrame, order: tuple[str, ...], offset: int) -> tuple[DataFrame, int]:
    """df without what certainly comes before place offset in order (whole-numbered columns), and how many rows are still to be skipped.

    A border is a value of the first column; where many rows share it, one of the next column too.
    """
    same, border, rest = df, None, offset
    for k, name in enumerate(order):
        got = selected(same, [], name, {"at": F.lit(rest)}).first()
        if got is None:
            return df.limit(0), 0
        here = F.col(name) == got["value"]
        behind = F.col(name) > got["value"]
        tied = [F.col(c) == v for c, v in border or []]
        beyond = behind if not tied else _all(tied) & behind
        seek = beyond if k == 0 else seek | beyond
        border, rest, same = [*(border or []), (name, got["value"])], int(got["before"]), same.where(here)
        if rest == 0:
            break
    return df.where(seek | _all([F.col(c) == v for c, v in border])), rest


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
