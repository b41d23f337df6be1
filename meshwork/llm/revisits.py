"""Not-modified revisits of a web archive, resolved to full responses. DataFrame functions only.

A revisit record says that a URL was asked for again and had not changed. It is joined, by
canonical URL, to the latest full response that is strictly earlier (ties of time go to the
largest record id). Its validators must not contradict the response's: the entity tags if both
have one (compared weakly), else the modification dates, else the payload digests. The resolved
record has the response's headers, updated by those of the revisit that a not-modified answer may
change.

The as-of join is skew-safe: time is cut into slices of about equal numbers of records, so a URL
with a third of all records is spread over as many groups as there are slices. A window finds
earlier responses within (URL, slice); of each such group only the last response goes on to a
second window, which has at most one row per slice and URL.

Records: record_id, url, ts (long), kind ('response' or 'revisit'), etag, last_modified, digest,
headers (array<struct<name, value>>). A null url, ts or kind never matches ('no earlier
response'); null validators are absent; null headers count as none; header names are compared in
lower case, and lines of one name stay together, in their order. Repeated records are resolved one by one. An
empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Headers that a not-modified answer may update; query parameters that only track.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "warning")
TRACKING = "^(utm_[a-z]*|ref|fbclid|gclid)(=|$)"

HEADERS = "array<struct<name:string,value:string>>"


def canonical(url: Column) -> Column:
    """Host in lower case without www and default ports, path without closing slashes, and the sorted
    query without tracking parameters; no scheme, no fragment. Null if there is no scheme and host."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), ":(80|443)$", ""), "^www[0-9]*[.]", "")
    path = F.regexp_replace(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, "^[^?#]*[?]([^#]*)", 1)
    asks = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))), "&")
    return F.when(host != "", F.concat(host, path, F.when(asks != "", F.concat(F.lit("?"), asks)).otherwise("")))


def merged_headers(old: Column, new: Column) -> Column:
    """The old lines with lower-case names; permitted new ones replace all old lines of their name, or are added.
    By name, lines of one name in their order."""
    line = lambda h, i: F.struct(F.lower(F.trim(h["name"])).alias("name"), i.alias("i"), h["value"].alias("value"))
    low = lambda headers: F.filter(F.transform(F.coalesce(headers, F.array().cast(HEADERS)), line), lambda h: h["name"].isNotNull())
    allowed = F.filter(low(new), lambda h: h["name"].isin(*PERMITTED))
    updated = F.transform(allowed, lambda h: h["name"])
    kept = F.filter(low(old), lambda h: ~F.array_contains(updated, h["name"]))
    return F.transform(F.array_sort(F.concat(kept, allowed)), lambda h: F.struct(h["name"].alias("name"), h["value"].alias("value")))


def resolve(records: DataFrame, slices: int | None = None) -> DataFrame:
    """One row per revisit: record_id, canonical_url, response_id, response_ts, outcome ('resolved',
    'validators differ', 'no earlier response'), headers (merged, of resolved ones)."""
    n = slices or int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = [F.struct(F.col("ts"), F.col("record_id"), F.col("etag"), F.col("last_modified"), F.col("digest"), F.col("headers").cast(HEADERS).alias("headers"))]
    rows = records.select("record_id", canonical(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), "kind", "etag", "last_modified", "digest", F.col("headers").cast(HEADERS).alias("headers"))
    # The cuts are one number a slice; any cuts give the same result.
    cuts = sorted({int(x) for x in rows.where("ts is not null").approxQuantile("ts", [k / n for k in range(1, n)], 0.25 / n)}) if n > 1 else []
    cut = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<bigint>")
    joinable = rows.where("canonical_url is not null and ts is not null and kind in ('response', 'revisit')")
    sliced = joinable.withColumn("slice", F.size(F.filter(cut, lambda c: c <= F.col("ts")))).withColumn("full", F.when(F.col("kind") == "response", fields[0]))
    # Of one moment, revisits come first, so that a response is strictly earlier than what sees it.
    before = Window.partitionBy("canonical_url", "slice").orderBy("ts", F.col("full").isNotNull(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    local = sliced.withColumn("near", F.last("full", ignorenulls=True).over(before)).where("kind = 'revisit'")
    tails = sliced.groupBy("canonical_url", "slice").agg(F.max("full").alias("tail"))
    earlier = Window.partitionBy("canonical_url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("canonical_url", "slice", F.last("tail", ignorenulls=True).over(earlier).alias("far")).where("far is not null")
    found = local.join(carried, ["canonical_url", "slice"], "left").withColumn("hit", F.coalesce("near", "far"))
    odd = rows.where("kind = 'revisit' and (canonical_url is null or ts is null)")
    found = found.select("record_id", "canonical_url", "etag", "last_modified", "digest", "headers", "hit")
    found = found.unionByName(odd.select("record_id", "canonical_url", "etag", "last_modified", "digest", "headers"), allowMissingColumns=True)
    weak = lambda c: F.regexp_replace(F.trim(c), "^W/", "")
    agrees = F.coalesce(weak(F.col("etag")) == weak(F.col("hit.etag")), F.col("last_modified") == F.col("hit.last_modified"), F.col("digest") == F.col("hit.digest"), F.lit(True))
    outcome = F.when(F.col("hit").isNull(), "no earlier response").when(agrees, "resolved").otherwise("validators differ")
    return found.select(
        "record_id",
        "canonical_url",
        F.col("hit.record_id").alias("response_id"),
        F.col("hit.ts").alias("response_ts"),
        outcome.alias("outcome"),
        F.when(outcome == "resolved", merged_headers(F.col("hit.headers"), F.col("headers"))).alias("headers"),
    )


def records_of(pages: DataFrame) -> DataFrame:
    """Archive records made of the pages: each was fetched whole, at a time that follows its number, and
    asked for again later, under a variant of its URL; every eleventh repeat has another entity tag."""
    digest = F.md5(F.coalesce("html", F.lit("")))
    etag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    base = pages.select("page_id", F.col("url"), etag.alias("tag"), digest.alias("digest"), F.length("html").cast("string").alias("size"), (F.col("page_id") * 1000).alias("at"))
    full = base.select((F.col("page_id") * 2).alias("record_id"), "url", F.col("at").alias("ts"), F.lit("response").alias("kind"), F.col("tag").alias("etag"), F.lit(None).cast("string").alias("last_modified"), "digest",
                       F.array(header("Date", F.col("at").cast("string")), header("ETag", F.col("tag")), header("Content-Type", F.lit("text/html")), header("Content-Length", F.col("size"))).alias("headers"))
    tag = F.when(F.col("page_id") % 11 == 0, F.lit('"other"')).when(F.col("page_id") % 3 == 0, F.concat(F.lit("W/"), F.col("tag"))).when(F.col("page_id") % 3 == 1, F.col("tag"))
    ts = F.col("at") + 500 + F.col("page_id") % 7 * 40000
    again = base.select((F.col("page_id") * 2 + 1).alias("record_id"), F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#again")).alias("url"), ts.alias("ts"), F.lit("revisit").alias("kind"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"), "digest",
                        F.array(header("Date", ts.cast("string")), header("Cache-Control", F.lit("max-age=60")), header("Content-Length", F.lit("0"))).alias("headers"))
    return full.unionByName(again)


def digest(resolved: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("headers", lambda h: F.concat_ws("=", h["name"], h["value"])), ";")
    return resolved.select("record_id", "canonical_url", "response_id", "outcome", F.coalesce(text, F.lit("")).alias("headers"))


#: digest(resolve(records_of(pages))), by a plain join.
ORACLE_SQL = r"""
WITH base AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS digest, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag,
         CAST(length(html) AS VARCHAR) AS size, page_id * 1000 AS at_ts FROM pages
), records AS (
  SELECT page_id * 2 AS record_id, url, at_ts AS ts, 'response' AS kind, tag AS etag, digest,
         at_ts AS date_value, tag AS etag_value, size AS length_value FROM base
  UNION ALL
  SELECT page_id * 2 + 1, regexp_replace(url, '#.*$', '') || '#again', at_ts + 500 + page_id % 7 * 40000, 'revisit',
         CASE WHEN page_id % 11 = 0 THEN '"other"' WHEN page_id % 3 = 0 THEN 'W/' || tag WHEN page_id % 3 = 1 THEN tag END, digest,
         at_ts + 500 + page_id % 7 * 40000, NULL, NULL FROM base
), parts AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), ':(80|443)$', ''), '^www[0-9]*[.]', '') AS host,
         regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'),
           lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]*|ref|fbclid|gclid)(=|$)'))), '&') AS asks
  FROM records
), named AS (
  SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN asks <> '' THEN '?' || asks ELSE '' END END AS canonical_url FROM parts
), joined AS (
  SELECT v.record_id, v.canonical_url, v.etag, v.digest, v.date_value, r.record_id AS response_id, r.etag AS r_etag, r.digest AS r_digest,
         r.etag_value, r.length_value,
         row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC NULLS LAST, r.record_id DESC) AS k
  FROM (SELECT * FROM named WHERE kind = 'revisit') v
  LEFT JOIN (SELECT * FROM named WHERE kind = 'response') r ON r.canonical_url = v.canonical_url AND r.ts < v.ts
), judged AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no earlier response'
    WHEN coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(r_etag, '^W/', ''), digest = r_digest, true) THEN 'resolved'
    ELSE 'validators differ' END AS outcome FROM joined WHERE k = 1
)
SELECT record_id, canonical_url, response_id, outcome, CASE WHEN outcome = 'resolved' THEN
  'cache-control=max-age=60;content-length=' || length_value || ';content-type=text/html;date=' || CAST(date_value AS VARCHAR) || ';etag=' || etag_value ELSE '' END AS headers
FROM judged
"""
