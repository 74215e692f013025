"""Secret scan over a trigram inverted index, in DataFrame operations only.

Each rule's regex is parsed on the driver into a Boolean query over the trigrams that every match must
contain. One pass over the texts finds a document's postings, the trigrams that any rule asks for, as
a bit set; the bit sets are intersected with each rule's query, and only documents that satisfy a query
are verified with its regex. A rule without mandatory trigrams (bare hex runs) scans every text. In a single scan the postings
stay beside their text, so no text is shuffled; index() writes them as rows (trigram, document) for scans to
come, which intersect the stored postings and read no trigram again.

Null texts count as empty (no spans). Rows with the same id are rows of their own; with a stored index a null id is joined
null-safely, and rows of one id share the union of their postings, which only adds candidates: each row is verified on its own
text. Other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, spread, table, written

_parser = re._parser
#: Up to this many alternatives of a piece of a regex are written out as strings.
MAX_STRINGS = 8
#: Trigrams to a word of a document's bit set.
BITS = 60
#: Gathered postings of up to this many documents (24 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 16


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: The contract's three kinds, in its order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE = (
    Rule("hosted", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)


def _strings(items) -> set[str] | None:
    """All strings a parsed piece can match, lower-cased, or None where there are too many."""
    out = {""}
    for op, arg in items:
        name = str(op)
        if name == "LITERAL":
            here = {chr(arg).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
            here = {chr(a).lower() for _, a in arg}
        elif name == "SUBPATTERN":
            here = _strings(arg[3])
        elif name == "BRANCH":
            parts = [_strings(x) for x in arg[1]]
            here = None if None in parts else set().union(*parts)
        elif name == "MAX_REPEAT" and arg[1] <= 2:
            one = _strings(arg[2])
            here = None if one is None else {"".join(c) for n in range(arg[0], arg[1] + 1) for c in _power(one, n)}
        else:
            return None
        if here is None or len(out) * len(here) > MAX_STRINGS:
            return None
        out = {a + b for a in out for b in here}
    return out


def _power(one: set[str], n: int) -> list[tuple[str, ...]]:
    return reduce(lambda got, _: [(*g, s) for g in got for s in one], range(n), [()])


def trigram_query(regex: str):
    """True, or ("and" | "or", parts), or a trigram: what any match's lower-cased text satisfies."""
    return _query(_parser.parse(regex))


def _any_of(strings: set[str]):
    ways = []
    for s in strings:
        if len(s) < 3:
            return True
        ways.append(("and", tuple(sorted({s[i : i + 3] for i in range(len(s) - 2)}))))
    return ("or", tuple(sorted(ways)))


def _query(items):
    clauses, run = [], {""}

    def flush():
        nonlocal run
        if (q := _any_of(run)) is not True:
            clauses.append(q)
        run = {""}

    for item in items:
        here = _strings([item])
        if here is not None and len(run) * len(here) <= MAX_STRINGS:
            run = {a + b for a in run for b in here}
            continue
        flush()
        if here is not None:
            run = here
            continue
        op, arg = str(item[0]), item[1]
        if op == "SUBPATTERN":
            q = _query(arg[3])
        elif op == "BRANCH":
            parts = tuple(_query(x) for x in arg[1])
            q = True if True in parts else ("or", parts)
        elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            q = _query(arg[2])
        else:
            q = True
        if q is not True:
            clauses.append(q)
    flush()
    return ("and", tuple(clauses)) if clauses else True


def _trigrams(q) -> set[str]:
    if q is True:
        return set()
    return {q} if isinstance(q, str) else set().union(*map(_trigrams, q[1]))


def _holds(q, ids: dict[str, int]) -> Column:
    if q is True:
        return F.lit(True)
    if isinstance(q, str):
        return F.col(f"held{ids[q] // BITS}").bitwiseAND(F.lit(1 << ids[q] % BITS).cast("bigint")) != 0
    join = (lambda a, b: a & b) if q[0] == "and" else (lambda a, b: a | b)
    return reduce(join, (_holds(x, ids) for x in q[1]))


def numbers(rules: tuple[Rule, ...]) -> dict[str, int]:
    """A number for each trigram that any rule asks for."""
    return {t: i for i, t in enumerate(sorted(set().union(*(_trigrams(trigram_query(r.regex)) for r in rules))))}


def held(docs: DataFrame, trigrams: dict[str, int]) -> DataFrame:
    """docs with its postings, held0, held1, ...: a bit for each of the given trigrams that occurs in the text, letters in lower case."""
    low = docs.withColumn("low_text", F.lower("text"))
    words: list[list[Column]] = [[] for _ in range(len(trigrams) // BITS + 1)]
    for t, i in trigrams.items():
        bit = F.lit(1 << i % BITS).cast("bigint")
        words[i // BITS].append(F.when(F.contains("low_text", F.lit(t)), bit).otherwise(F.lit(0).cast("bigint")))
    sums = {f"held{w}": reduce(lambda a, b: a.bitwiseOR(b), x, F.lit(0).cast("bigint")) for w, x in enumerate(words)}
    return low.withColumns(sums).drop("low_text")


def index(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """The inverted index for these rules, (trigram, doc_id), written to the shared folder."""
    ids = numbers(rules)
    bits = F.array_compact(F.array(*[F.when(F.col(f"held{i // BITS}").bitwiseAND(F.lit(1 << i % BITS).cast("bigint")) != 0, F.lit(t)) for t, i in ids.items()]))
    return written(held(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ids).select(F.explode(bits).alias("trigram"), "doc_id").distinct(), "postings")


def gathered_postings(stored: DataFrame, trigrams: dict[str, int]) -> DataFrame:
    """(doc_id, held0, ...) from stored postings."""
    place = F.try_element_at(F.create_map(*[F.lit(x) for t, i in trigrams.items() for x in (t, i)]), "trigram") if trigrams else F.lit(None).cast("int")
    rows = stored.withColumn("place", place).where("place IS NOT NULL")
    bit = F.expr(f"shiftleft(1L, place % {BITS})")
    words = range(len(trigrams) // BITS + 1)
    return rows.groupBy("doc_id").agg(*[F.coalesce(F.bit_or(F.when(F.floor(F.col("place") / BITS) == w, bit)), F.lit(0)).alias(f"held{w}") for w in words])


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """All kept matches of a rule as structs (start, kind, end), in code points, leftmost and not overlapping."""
    parts = F.split(text, rule.regex, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    value = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
    each = F.arrays_zip(
        F.transform(parts, F.length).alias("gap"),
        F.transform(whole, F.length).alias("n"),
        F.transform(value, F.length).alias("v"),
    )
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        start = acc["at"] + m["gap"]
        end = start + F.coalesce(m["n"], F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"))
        return F.struct(
            end.alias("at"),
            F.when(m["v"] >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(each, zero, step)["out"]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, keep: tuple[str, ...] = (), stored: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text, keep) with found: array of (start, kind number in rules, end), sorted.

    stored: postings that index() wrote for rules that ask for these trigrams at least; none: they are found in the same pass.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *keep)
    ids = numbers(rules)
    if stored is None:
        with_postings = held(docs, ids)
    else:
        postings = written(gathered_postings(stored, ids), "gathered").withColumnRenamed("doc_id", "hit_id")
        with_postings = docs.join(small(postings, BROADCAST_ROWS), docs.doc_id.eqNullSafe(F.col("hit_id")), "left")
        with_postings = with_postings.withColumns({f"held{w}": F.coalesce(f"held{w}", F.lit(0)) for w in range(len(ids) // BITS + 1)})
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = []
    for k, rule in enumerate(rules):
        asked = _holds(trigram_query(rule.regex), ids)
        found.append(F.when(asked & F.col("text").rlike(rule.regex), spans_of(F.col("text"), rule, k)).otherwise(none))
    return with_postings.select("doc_id", "text", *keep, F.sort_array(F.concat(*found)).alias("found"))


def listed(found: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(found, one))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, keep) with each found span replaced by its kind in angle brackets; overlaps become one."""
    kinds = F.array(*[F.lit(f"<{r.kind}>") for r in rules])
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(
                fresh,
                F.concat(
                    acc["out"],
                    F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]),
                    F.element_at(kinds, s["kind"] + 1),
                ),
            ).otherwise(acc["out"]).alias("out"),
        )

    got = F.aggregate("found", zero, step)
    clean = F.when(F.size("found") == 0, F.col("text")).otherwise(
        F.concat(got["out"], F.substr(F.col("text"), got["at"] + 1))
    )
    return scan(docs, rules, keep).select("doc_id", clean.alias("text"), *keep)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    rules = BASE + MORE
    found = scan(spread(table(spark, sf_dir, "documents")), rules)
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE)],
        F.sha2(listed(base, rules).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("found"), rules).alias("spans"),
    )


def oracle_op8() -> str:
    """The same by plain regex over every text."""
    rules, q = BASE + MORE, lambda s: "'" + s.replace("'", "''") + "'"
    lists = []
    for k, r in enumerate(rules):
        rx = q(r.regex.replace(r"\x20", " "))
        lists.append(
            f"""list_filter(list_transform(range(1, len(regexp_extract_all(text, {rx})) + 1), lambda i: {{
            'start': coalesce(list_sum(list_transform(string_split_regex(text, {rx})[1:i], lambda p: length(p))), 0)
                + coalesce(list_sum(list_transform(regexp_extract_all(text, {rx})[1:i-1], lambda p: length(p))), 0),
            'kind': {k}, 'name': '{r.kind}', 'n': length(regexp_extract_all(text, {rx})[i]),
            'v': length(regexp_extract_all(text, {rx}, {r.group})[i])}}), lambda s: s.v >= {r.least})"""
        )
    joined = "list_concat(" + lists[0]
    for one in lists[1:]:
        joined += ", " + one
    joined += ")"
    text = "list_aggregate(list_transform({0}, lambda s: s.name || ':' || (s.start::bigint)::varchar || ':' || ((s.start + s.n)::bigint)::varchar), 'string_agg', ',')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    f AS (SELECT doc_id, list_sort({joined}) AS found FROM d)
    SELECT doc_id,
      len(list_filter(found, lambda s: s.kind = 0)) AS n_assign,
      len(list_filter(found, lambda s: s.kind = 1)) AS n_access,
      len(list_filter(found, lambda s: s.kind = 2)) AS n_hex,
      sha256(coalesce({text.format("list_filter(found, lambda s: s.kind < 3)")}, '')) AS base_sha256,
      coalesce({text.format("found")}, '') AS spans
    FROM f"""
