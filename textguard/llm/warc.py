"""Resolution of not-modified revisit records in web archives.

A revisit holds a 304 answer without a body. It is resolved to the latest earlier full
response with the same canonical URL, if the validators agree: entity tags (compared
without the weakness mark) if both have one, else the modification dates if both have
one. The answer's headers then replace those of the response, but for the ones that
describe a body (`BODY_HEADERS`).

The as-of join is two windows. Times are cut into spans of about equal numbers of
records; within a URL and span the latest response so far is a running value, and over a
URL's spans, of which there are at most `spans`, the last response of the spans before is
another. A URL with a third of all records is so worked on by as many tasks as it has
spans. Bodies are not moved: records carry headers, and results the response's id.

Records are ordered by time, then id; records of one time and URL share a task. A record
without URL or time is never found and finds nothing (`no_response`). Null headers are
no headers. Repeated rows are resolved one by one, to the greatest id among ties. Only
the named columns are read; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers of a 304 answer that must not replace a stored response's. Fixed values.
BODY_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
TRACKING = "^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www, default port and user; path without trailing slashes;
    parameters sorted, without those for tracking; no scheme and no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^(?i)https?://", "")
    host = F.lower(F.regexp_extract(bare, "^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "^www[0-9]*\\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(params), "&")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def lowered(headers: Column) -> Column:
    """Headers with names in lower case; of names that differ in case only, the last one."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.coalesce(F.map_from_entries(last), F.create_map().cast("map<string,string>"))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored response's headers, updated by those of the not-modified answer."""
    allowed = F.map_filter(fresh, lambda name, _: ~name.isin(*BODY_HEADERS))
    kept = F.map_filter(stored, lambda name, _: ~F.map_contains_key(allowed, name))
    return F.map_concat(kept, allowed)


def _outcome(stored: Column, fresh: Column) -> Column:
    def tag(headers: Column) -> Column:
        return F.regexp_replace(headers["etag"], "^W/", "")

    tags, dates = tag(stored) == tag(fresh), stored["last-modified"] == fresh["last-modified"]
    return F.when(tags, "resolved").when(~tags, "changed").when(dates, "resolved").when(~dates, "changed").otherwise("unverified")


def resolve_revisits(records: DataFrame, record: str = "record_id", url: str = "url", time: str = "ts",
                     kind: str = "type", headers: str = "headers", spans: int = 256) -> DataFrame:
    """One row per revisit: record_id, canonical_url, outcome (resolved, changed, unverified,
    no_response), refers_to (the response's id, if there is one), headers (merged, if resolved)."""
    rows = records.select(
        F.col(record).alias("record"), canonical_url(F.col(url)).alias("url"), F.col(time).alias("ts"),
        F.col(kind).alias("kind"), lowered(F.col(headers)).alias("headers"))
    rows = rows.where(F.col("kind").isin("response", "revisit"))
    position = rows.select(F.col("ts").cast("double").alias("ts"))
    cuts = position.agg(F.percentile_approx("ts", [k / spans for k in range(1, spans)], 10_000)).first()[0] or []
    cuts = F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]).cast("array<double>")
    rows = rows.withColumn("span", F.size(F.filter(cuts, lambda c: c <= F.col("ts").cast("double"))))
    known = F.col("url").isNotNull() & F.col("ts").isNotNull()
    response = F.when(F.col("kind") == "response", F.struct("ts", "record", "headers"))
    order = Window.partitionBy("url", "span").orderBy("ts", "record")
    timed = rows.where(known)
    within = timed.withColumn("found", F.last(response, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    last = timed.where("kind = 'response'").groupBy("url", "span").agg(
        F.max_by(F.struct("record", "headers"), F.struct("ts", "record")).alias("last"))
    # every span with a record of the URL, so that each finds what the spans before it left
    seen = timed.groupBy("url", "span").agg(F.lit(1).alias("one")).join(last, ["url", "span"], "left")
    carried = seen.select("url", "span", F.last("last", ignorenulls=True).over(
        Window.partitionBy("url").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    revisits = within.where("kind = 'revisit'").join(carried, ["url", "span"]).select(
        "record", "url", F.col("headers").alias("fresh"),
        F.when(F.col("found").isNotNull(), F.struct("found.record", "found.headers")).otherwise(F.col("carried")).alias("stored"))
    lost = rows.where(~known & (F.col("kind") == "revisit")).select(
        "record", "url", F.col("headers").alias("fresh")).withColumn("stored", F.lit(None).cast(revisits.schema["stored"].dataType))
    whole = revisits.unionByName(lost).withColumn(
        "outcome", F.when(F.col("stored").isNull(), "no_response").otherwise(_outcome(F.col("stored.headers"), F.col("fresh"))))
    return whole.select(
        F.col("record").alias("record_id"), F.col("url").alias("canonical_url"), "outcome",
        F.col("stored.record").alias("refers_to"),
        F.when(F.col("outcome") == "resolved", merged_headers(F.col("stored.headers"), F.col("fresh"))).alias("headers"))


def header_text(headers: Column) -> Column:
    """Headers as lines `name: value`, by name."""
    pairs = F.array_sort(F.map_entries(headers))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
