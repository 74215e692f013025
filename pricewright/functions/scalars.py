"""Scalar functions as native column expressions.

Every function takes and returns columns. Malformed input gives null (or an issue code), never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(28,12)"


def odds_issue_and_price(price: Column, fmt: Column) -> Column:
    """struct(odds double, issue): a decimal, fractional, american or implied_probability price as decimal odds over 1."""
    text = F.trim(price)
    number = text.try_cast("double")
    parts = F.split(text, "/")
    num, den = F.trim(F.get(parts, F.lit(0))).try_cast("double"), F.trim(F.get(parts, F.lit(1))).try_cast("double")
    fraction = F.when((F.size(parts) == 2) & (num > 0) & (den > 0), 1 + num / F.nullif(den, F.lit(0.0)))
    american = F.when(number > 0, 1 + number / 100).when(number < 0, 1 + 100 / F.nullif(-number, F.lit(0.0)))
    implied = F.when((number > 0) & (number < 1), 1 / F.nullif(number, F.lit(0.0)))
    odds = (
        F.when(fmt == "decimal", number)
        .when(fmt == "fractional", fraction)
        .when(fmt == "american", american)
        .when(fmt == "implied_probability", implied)
    )
    ok = (odds > 1) & ~F.isnan(odds) & (odds < float("inf"))
    return F.struct(F.when(ok, odds).alias("odds"), F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise("malformed_price").alias("issue"))


def implied_probability(price: Column) -> Column:
    return 1 / price.cast("double")


def alias_key_ascii(text: Column) -> Column:
    """Comparison key of ASCII text: trimmed, white space collapsed, lower case; null over 512 characters or with control characters."""
    key = F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))
    bad = (F.length(key) == 0) | (F.length(key) > 512) | text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")
    return F.when(~bad, key)


def bounded_text(text: Column, longest: int = 256) -> Column:
    """Trimmed text, null if empty, over long, or with control characters other than tab."""
    t = F.trim(text)
    return F.when((F.length(t) > 0) & (F.length(t) <= longest) & ~t.rlike(r"[\x00-\x08\x0a-\x1f]"), t)


def currency(text: Column) -> Column:
    t = F.upper(F.trim(text))
    return F.when(t.rlike("^[A-Z]{3}$"), t)


def iso_timestamp(text: Column) -> Column:
    """UTC time of ISO-8601 text with a zone; null without one."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(text))


def status_of(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("active", "suspended", "closed"), t).otherwise("unknown")


def iso_text(ts: Column) -> Column:
    """ISO form with +00:00; the fraction is left out where it is zero."""
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00")
    )


def quote_id(transport: Column, provider: Column, event: Column, market: Column, selection: Column, effective: Column) -> Column:
    return F.concat_ws("|", transport, provider, event, market, selection, iso_text(effective))


def is_half_line(line: Column) -> Column:
    """Signed x.5 line: no push is possible."""
    return F.pmod(line * 2, F.lit(2)) == 1


def is_half_total(line: Column) -> Column:
    return (line > 0) & is_half_line(line)


def handicap_class(line: Column) -> Column:
    units = F.pmod(line * 4, F.lit(4))
    return (
        F.when(units == 0, "integer").when(units == 2, "half_goal").when((units == 1) | (units == 3), "quarter").otherwise("unsupported")
    )


def handicap_parts(line: Column) -> Column:
    """array of (line, stake fraction); a quarter line is two half stakes on its neighbours."""
    whole = F.array(F.struct(line.cast("double").alias("line"), F.lit(1.0).alias("stake")))
    twice = line.cast("double") * 2
    split = F.array(
        F.struct((F.floor(twice) / 2).alias("line"), F.lit(0.5).alias("stake")),
        F.struct((F.ceil(twice) / 2).alias("line"), F.lit(0.5).alias("stake")),
    )
    kind = handicap_class(line)
    return F.when(kind == "quarter", split).when(kind != "unsupported", whole)


def handicap_settlement(line: Column, goal_difference: Column, odds: Column) -> Column:
    """struct(result, multiplier) of one selection from its goal difference."""
    # a line is at most two half stakes, on itself twice or on its neighbours: plain arithmetic, no arrays to go through
    twice = line.cast("double") * 2
    kind = handicap_class(line)
    quarter = kind == "quarter"
    low = goal_difference + F.when(quarter, F.floor(twice) / 2).otherwise(line.cast("double"))
    high = goal_difference + F.when(quarter, F.ceil(twice) / 2).otherwise(line.cast("double"))
    paid = lambda x: F.when(x > 0, odds).when(x == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    multiplier = F.when(quarter, 0.5 * paid(low) + 0.5 * paid(high)).when(kind != "unsupported", 1.0 * paid(low))
    won, lost, pushed = (low > 0) | (high > 0), (low < 0) | (high < 0), (low == 0) | (high == 0)
    result = (
        F.when(won & pushed, "half_win").when(lost & pushed, "half_loss").when(won, "win").when(lost, "loss").when(pushed, "push")
    )
    return F.struct(F.when(kind != "unsupported", result).alias("result"), multiplier.alias("multiplier"))


def winner_1x2(home: Column, away: Column) -> Column:
    return F.when((home < 0) | (away < 0), F.lit(None)).when(home > away, "home").when(away > home, "away").otherwise("draw")


#: Outcome ids of the one documented three-way contract: fixed values.
SIDE_OF_OUTCOME = {"101": "home", "102": "draw", "103": "away"}


def side_of_outcome(outcome_id: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SIDE_OF_OUTCOME.items() for x in kv]), outcome_id)


def grades_consistent(grades: Column, home: Column, away: Column) -> Column:
    """Whether a map of outcome id to WIN / LOSE is complete and agrees with a verified score."""
    complete = F.array_sort(F.map_keys(grades)) == F.array(*[F.lit(k) for k in sorted(SIDE_OF_OUTCOME)])
    agrees = F.forall(
        F.map_entries(grades),
        lambda e: e["value"] == F.when(side_of_outcome(e["key"]) == winner_1x2(home, away), "WIN").otherwise("LOSE"),
    )
    return F.coalesce(complete & agrees, F.lit(False))


def h2h_sides(home: Column, away: Column, labels: Column) -> Column:
    """Sides of three labels that are exactly home, draw and away; null otherwise."""
    h, a = F.lower(F.trim(home)), F.lower(F.trim(away))
    low = F.transform(labels, lambda x: F.lower(F.trim(x)))
    fine = (h != "") & (a != "") & (h != a) & (h != "draw") & (a != "draw") & (F.size(labels) == 3)
    exact = F.array_sort(low) == F.array_sort(F.array(h, F.lit("draw"), a))
    return F.when(fine & exact, F.transform(low, lambda x: F.when(x == h, "home").when(x == "draw", "draw").otherwise("away")))


def fixture_order(ref_home: Column, ref_away: Column, one: Column, two: Column) -> Column:
    return (
        F.when((ref_home == ref_away) | (one == two), "conflict")
        .when((one == ref_home) & (two == ref_away), "aligned")
        .when((one == ref_away) & (two == ref_home), "reversed")
        .otherwise("conflict")
    )


def team_key(name: Column) -> Column:
    """Letters-and-digits tokens in lower case, without a closing fc or cf."""
    tokens = F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))
    last = F.get(tokens, F.size(tokens) - 1)
    kept = F.when(last.isin("fc", "cf"), F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)
    return F.array_join(kept, " ")


def lay_liability(stake: Column, price: Column) -> Column:
    return stake * (price - 1)


def floor_to_grid(value: Column, step: Column) -> Column:
    return F.floor(value / step) * step


def ceil_to_grid(value: Column, step: Column) -> Column:
    return F.ceil(value / step) * step


def time_score(delta_us: Column, tolerance_us: Column) -> Column:
    """2000 at no difference down to 0 at the tolerance, in whole steps."""
    short = F.least(delta_us, tolerance_us)
    return F.floor(2000 * (tolerance_us - short) / tolerance_us).cast("bigint")


def effective(source: Column, ingested: Column) -> Column:
    return F.coalesce(source, ingested)


def digest(df_group_text: Column) -> Column:
    """SHA-256 of an ordered text."""
    return F.sha2(df_group_text.cast("binary"), 256)
