"""Audit store on Parquet: insert-if-absent, bridge rows, retention, schema versions; and a canonical codec."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import sought


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """stored plus the new rows of incoming; the whole batch fails if a stored id comes with another payload.

    Repeated equal rows of a batch are one row.
    """
    return stored.select(key, payload).unionByName(new_rows(stored, incoming, key, payload))


def new_rows(stored: DataFrame, incoming: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """The rows of incoming that stored lacks; reading them fails if an id of theirs has another payload, in the store or among them.

    The test sits on the rows that it is about, so no side that happens to be empty can take it out of the plan.
    """
    own = F.struct(F.col(payload).alias("p"))  # a struct, so that a null payload counts as one
    new = incoming.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(own).alias("low"), F.max(own).alias("high"))
    met = new.join(stored.select(key, F.struct(F.col(payload).alias("p")).alias("old")), key, "left")
    same = (F.col("low") == F.col("high")) & (F.col("old").isNull() | (F.col("old") == F.col("low")))
    tested = F.assert_true(same, F.concat(F.lit("an id is stored with another payload: "), F.col(key).cast("string")))
    return met.where(F.when(tested.isNull(), F.col("old").isNull())).select(key, F.col("low.p").alias(payload))


def persist(incoming: DataFrame, path: str, key: str = "id", payload: str = "payload") -> None:
    """Insert-if-absent into a Parquet store: one append a batch, all or nothing by the commit of the write.

    For foreachBatch: lambda batch, epoch: persist(batch, path). A batch that is delivered again adds nothing.
    """
    spark = incoming.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    schema = incoming.select(key, payload).schema
    stored = spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)
    new_rows(stored, incoming, key, payload).write.mode("append").parquet(path)


def persist_opportunities(found: DataFrame, path: str) -> None:
    """Opportunities (opportunity_id, plan, quote_ids, payload) with bridge and audit rows, all or nothing.

    The three kinds are rows of one table, so one commit makes all of them visible or none; a batch that is delivered again
    adds nothing, and an opportunity that is stored with another payload fails the whole batch. kind tells them apart.
    """
    audit = F.to_json(F.struct(F.lit("opportunity_stored").alias("event"), F.col("opportunity_id").cast("string").alias("id")))
    leg = F.struct("ordinal", "quote_id")
    parts = (
        found.select(F.concat(F.lit("opportunity:"), F.col("opportunity_id").cast("string")).alias("id"), F.to_json(F.struct("payload", "plan")).alias("payload")),
        bridge(found).select(F.concat_ws(":", F.lit("leg"), F.col("opportunity_id").cast("string"), "ordinal").alias("id"), F.to_json(leg).alias("payload")),
        found.select(F.concat(F.lit("audit:"), F.col("opportunity_id").cast("string")).alias("id"), audit.alias("payload")),
    )
    persist(parts[0].unionByName(parts[1]).unionByName(parts[2]), path)


def stored_opportunities(path_rows: DataFrame) -> DataFrame:
    """(opportunity_id, legs, audited) of the rows that persist_opportunities wrote."""
    kind, own = F.split_part("id", F.lit(":"), F.lit(1)), F.split_part("id", F.lit(":"), F.lit(2))
    rows = path_rows.select(kind.alias("kind"), own.alias("opportunity_id"))
    counted = rows.groupBy("opportunity_id").agg(F.count_if(F.col("kind") == "opportunity").alias("n"), F.count_if(F.col("kind") == "leg").alias("legs"), F.count_if(F.col("kind") == "audit").alias("audits"))
    return counted.where("n = 1").select("opportunity_id", "legs", (F.col("audits") == 1).alias("audited"))


def bridge(opportunities: DataFrame) -> DataFrame:
    """(opportunity_id, ordinal, quote_id): the ordered quote set of each opportunity."""
    return opportunities.select("opportunity_id", F.posexplode("quote_ids").alias("ordinal", "quote_id"))


def reconstruct(bridge_rows: DataFrame, quotes: DataFrame) -> DataFrame:
    """Evidence of each opportunity in stored order; incomplete is set where a quote is gone."""
    rows = bridge_rows.join(quotes, "quote_id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "quote_id", "cents")))
    out = rows.groupBy("opportunity_id").agg(ordered.alias("legs"), F.count_if(F.col("cents").isNull()).alias("gone"))
    return out.select("opportunity_id", F.array_join(F.transform("legs", lambda x: x["quote_id"]), ",").alias("quote_ids"), (F.col("gone") > 0).alias("incomplete"))


def retained(quotes: DataFrame, bridge_rows: DataFrame, cutoff: Column, at: str) -> DataFrame:
    """quotes without those before cutoff that no opportunity refers to."""
    old = quotes.where(F.col(at) < cutoff).join(bridge_rows.select("quote_id").distinct(), "quote_id", "left_semi")
    return quotes.where(F.col(at) >= cutoff).unionByName(old)


def migrated(records: DataFrame) -> DataFrame:
    """Records of any version (1 to 3) in the columns of version 3: version 1 lacks the transport, 2 two market fields."""
    return records.select(
        "id", "provider_id", F.coalesce("transport_provider_id", "provider_id").alias("transport_provider_id"),
        F.when(F.col("version") >= 3, F.col("set_index")).alias("set_index"),
        F.when(F.col("version") >= 3, F.col("subject_id")).alias("subject_id"), F.lit(3).alias("version"),
    )


def encoded(tag: str, *fields: str) -> Column:
    """Deterministic tagged JSON: fields in sorted order, no spaces, the schema version in front."""
    body = F.struct(*[F.col(c).alias(c) for c in sorted(fields)])
    return F.to_json(F.struct(F.lit(3).alias("schema"), F.lit(tag).alias("type"), body.alias("value")), {"ignoreNullFields": "false"})


def decoded(text: Column, tag: str, schema: str, fields: tuple[str, ...]) -> Column:
    """struct(value, issue): the value only if the tag is known and the keys are exactly the fields."""
    keys = F.array_sort(F.json_object_keys(F.get_json_object(text, "$.value")))
    exact = keys == F.array(*[F.lit(c) for c in sorted(fields)])
    issue = (
        F.when(F.get_json_object(text, "$.schema") != "3", "unsupported_schema").when(F.coalesce(F.get_json_object(text, "$.type") != tag, F.lit(True)), "unknown_type")
        .when(~F.coalesce(exact, F.lit(False)), "unexpected_keys")
    )
    value = F.from_json(F.get_json_object(text, "$.value"), schema)
    return F.struct(F.when(issue.isNull(), value).alias("value"), issue.alias("issue"))


def page(df: DataFrame, order: tuple[str, ...], offset: int, limit: int) -> DataFrame:
    """A page of at most 200 rows with total and has_more; rows in order, nulls first.

    Where the order is of whole numbers, the page's border is found by counting ranges and rows before it are not sorted or carried: the border is
    a filter, which the scan takes where it can.
    """
    if not (offset >= 0 and 1 <= limit <= 200):
        raise ValueError("a page has an offset of 0 or more and 1 to 200 rows")
    total = df.agg(F.count("*").alias("total")).scalar()
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    rest = offset
    if offset and all(kinds[c] in ("int", "bigint") for c in order):
        empty = df.where(F.col(order[0]).isNull()).count()  # these come first, and are no value
        whole = all(not df.where(F.col(c).isNull()).limit(1).count() for c in order[1:])
        if whole and offset >= empty:
            df, rest = sought(df.where(F.col(order[0]).isNotNull()), order, offset - empty)
    rows = df.orderBy(*order).offset(rest).limit(limit)
    return rows.withColumn("total", total).withColumn("has_more", F.col("total") > offset + limit)


#: Read model: route to (view columns that may be filtered by equality).
ROUTES = {
    "/events": ("event_id", "competition_id"),
    "/odds": ("market_id", "provider_id"),
    "/opportunities": ("market_id",),
}


def dispatch(path: str, parameters: dict[str, str], views: dict[str, DataFrame]) -> DataFrame:
    """The page a GET asks for; unknown routes and parameters are errors."""
    if path not in ROUTES:
        raise LookupError(f"no route {path}")
    known = {"offset", "limit", *ROUTES[path]}
    if unknown := set(parameters) - known:
        raise ValueError(f"unknown parameters: {sorted(unknown)}")
    df = views[path]
    for name in ROUTES[path]:
        if name in parameters:
            df = df.where(F.col(name).cast("string") == parameters[name])
    return page(df, tuple(ROUTES[path][:1]), int(parameters.get("offset", 0)), int(parameters.get("limit", 50)))


def openapi(version: str) -> dict:
    paths = {
        p: {"get": {"parameters": [{"name": n, "in": "query", "schema": {"type": "string"}} for n in (*names, "offset", "limit")], "responses": {"200": {"description": "page"}}}}
        for p, names in ROUTES.items()
    }
    return {"openapi": "3.1.0", "info": {"title": "read model", "version": version}, "paths": paths}


def card(title: Column, body: Column) -> Column:
    """An escaped HTML card."""
    def safe(c: Column) -> Column:
        for raw, out in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(raw), F.lit(out))
        return c

    return F.concat(F.lit("<article><h2>"), safe(title), F.lit("</h2><p>"), safe(body), F.lit("</p></article>"))
