"""URL filter by a temporal list join.

List entries are dated: from `effective` on, an entry blocks or allows a host, a
domain with its hosts, or a path prefix, and a lift ends what is in force for that
value. Consecutive entries of one value become validity intervals, and every capture
is held against the intervals that contain its fetch time: an as-of join.

Each capture spreads to the keys it can match (its host, every parent domain, every
path prefix down to the depth of the deepest listed path) and is equi-joined with the intervals on (key, month):
intervals are cut at the months that have captures, so that a key with a long history of entries is not
scanned whole for each of its captures. Intervals are broadcast up to a checked
size; beyond it the join shuffles and adaptive execution splits a hot host.

The most specific active entry decides: path before host before domain, then the
longer value, then the earlier list name.

Hosts of captures and entries are cleaned alike: lower case, without user, port, trailing
dots and a leading www label.

Defined cases: a capture whose url is null or has no host, or whose fetch time is
null, matches nothing; entries with a null kind, value, action or date are ignored;
of several entries for one value on one date a block counts before an allow before a
lift; repeated entries count once; an empty list leaves every capture `none`; repeated
captures count once and have one row, as have several fetches of one page at one time; very
long URLs are ordinary ones; of entries that tie the earlier list, then the smaller value decides; other columns of either table are ignored.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import save, sized

ENTRY = "list string, kind string, value string, action string, effective date"

#: The default list: name, kind, value, action, effective date.
ENTRIES = [
    ("spam", "host", "spam-farm.example.org", "block", "2023-06-01"),
    ("spam", "host", "spam-farm.example.org", "lift", "2024-03-10"),
    ("spam", "host", "spam-farm.example.org", "block", "2024-05-20"),
    ("spam", "domain", "cheap-pills.example.com", "block", "2024-02-01"),
    ("spam", "domain", "cheap-pills.example.com", "lift", "2024-11-15"),
    ("adult", "host", "blog.tionble.example.com", "block", "2024-04-01"),
    ("adult", "host", "blog.tionble.example.com", "allow", "2024-06-15"),
    ("adult", "path", "ththon.example.com/en", "block", "2024-01-15"),
    ("adult", "path", "ththon.example.com/en", "lift", "2024-09-01"),
    ("takedown", "domain", "ththth.example.net", "block", "2023-12-01"),
    ("takedown", "host", "m.ththth.example.net", "allow", "2024-07-01"),
    ("takedown", "path", "tionsh.example.net/es", "block", "2024-03-01"),
    ("takedown", "path", "tionsh.example.net/fr", "block", "2024-08-01"),
    ("takedown", "domain", "example.org", "block", "2024-12-20"),
    ("partners", "domain", "ththre.example.org", "allow", "2022-01-01"),
    ("partners", "host", "blog.ththre.example.org", "lift", "2024-02-02"),
]


def entries(spark, rows=ENTRIES) -> DataFrame:
    return spark.createDataFrame([(*r[:4], dt.date.fromisoformat(r[4])) for r in rows], ENTRY)


def clean_host(authority: Column) -> Column:
    """The host of an authority in lower case, without user, port, trailing dots and a leading www label."""
    host = F.regexp_replace(F.lower(authority), r"^.*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"\.+$", "")
    return F.regexp_replace(host, r"^www\d*\.([^.]+\..*)$", "$1")


def host_of(url: Column) -> Column:
    return clean_host(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: p != "")


def clean_value(kind: Column, value: Column) -> Column:
    """The value of a list entry as captures are matched: its host cleaned like theirs, its path without empty segments."""
    host = clean_host(F.substring_index(value, "/", 1))
    return F.when(kind == "path", F.array_join(F.concat(F.array(host), segments(F.lower(F.regexp_replace(value, r"^[^/]*", "")))), "/")).otherwise(host)


def intervals(listed: DataFrame, last: Column | None = None) -> DataFrame:
    """key, list, kind, value, action, valid_from, valid_to (exclusive; null while in force): block and allow only."""
    from pyspark.sql import Window

    ok = listed.select("list", "kind", clean_value(F.col("kind"), F.col("value")).alias("value"), "action", F.col("effective").cast("date").alias("effective")).where("kind IS NOT NULL AND value IS NOT NULL AND action IN ('block', 'allow', 'lift') AND effective IS NOT NULL")
    one = ok.groupBy("list", "kind", "value", "effective").agg(F.min_by("action", F.expr("CASE action WHEN 'block' THEN 0 WHEN 'allow' THEN 1 ELSE 2 END")).alias("action"))
    w = Window.partitionBy("list", "kind", "value").orderBy("effective")
    cut = one.withColumns({"valid_from": F.col("effective"), "valid_to": F.lead("effective").over(w)})
    return cut.where("action <> 'lift'").select(F.concat_ws(":", "kind", "value").alias("key"), "list", "kind", "value", "action", "valid_from", "valid_to")


def keys_of(host: Column, path: Column, deepest: int) -> Column:
    """All keys that a capture can match, where no listed path has more than `deepest` segments."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = segments(path)
    depth = F.least(F.size(parts), F.lit(deepest))
    prefixes = F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(F.lit("path:"), host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    none = F.array().cast("array<string>")
    return F.when(host == "", none).otherwise(F.concat(F.array(F.concat(F.lit("host:"), host)), domains, F.when(depth > 0, prefixes).otherwise(none)))

def by_month(spans: DataFrame, days: DataFrame) -> DataFrame:
    """The intervals, one row for each month that has captures, of which the calendar has 120,000 at most."""
    there = save(days.select(F.trunc("day", "month").alias("month")).where("month IS NOT NULL").distinct(), "months")
    within = (F.col("month") >= F.trunc("valid_from", "month")) & (F.col("valid_to").isNull() | (F.col("month") < F.col("valid_to")))
    return spans.join(F.broadcast(there), within)


def evaluate(captures: DataFrame, listed: DataFrame) -> DataFrame:
    """capture_id, url, fetched of captures with n_active, verdict (block, allow, none), list and value of the deciding entry."""
    spans = intervals(listed)
    day = F.col("fetched").cast("date")
    months = save(by_month(spans, captures.select(day.alias("day"))), "intervals")
    deepest = months.where("kind = 'path'").agg(F.max(F.size(F.split("value", "/")) - 1).alias("n")).first().n or 0
    rows = captures.select("capture_id", "url", day.alias("day"), "fetched").distinct()
    host = F.coalesce(host_of(F.col("url")), F.lit(""))
    spread = rows.withColumn("key", F.explode_outer(keys_of(host, F.coalesce(path_of(F.col("url")), F.lit("")), deepest))).withColumn("month", F.trunc("day", "month"))
    hit = spread.join(sized(months), ["key", "month"], "left").withColumn("active", F.col("valid_from").isNotNull() & (F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
    rank = F.when(F.col("kind") == "path", 0).when(F.col("kind") == "host", 1).otherwise(2)
    best = F.min(F.when(F.col("active"), F.struct(rank.alias("rank"), (-F.length("value")).alias("size"), F.col("list"), F.col("value"), F.col("action"))))
    out = hit.groupBy("capture_id", "url", "fetched").agg(F.count(F.when(F.col("active"), 1)).alias("n_active"), best.alias("best"))
    return out.select("capture_id", "url", "fetched", "n_active", F.coalesce("best.action", F.lit("none")).alias("verdict"), F.col("best.list").alias("list"), F.col("best.value").alias("value"))


def fetch_day(page_id: Column) -> Column:
    """pages have no fetch time: a day of 2024 that follows from the page_id."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(page_id * 7919, F.lit(366)).cast("int"))


def report(pages: DataFrame) -> DataFrame:
    """One row per distinct (page_id, url): page_id, fetched, n_active, verdict, list, value."""
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", fetch_day(F.col("page_id")).alias("fetched"))
    return evaluate(captures, entries(pages.sparkSession)).select(F.col("capture_id").alias("page_id"), "fetched", "n_active", "verdict", "list", "value")


def keep_allowed(captures: DataFrame, listed: DataFrame) -> DataFrame:
    """The captures that no active entry blocks."""
    blocked = evaluate(captures, listed).where("verdict = 'block'").select("capture_id", "url", "fetched")
    return captures.join(blocked, ["capture_id", "url", "fetched"], "left_anti")


def report_sql() -> str:
    values = ", ".join(str(r) for r in ENTRIES)
    return f"""
WITH e(list, kind, value, action, effective) AS (VALUES {values}),
i AS (SELECT *, CAST(effective AS DATE) AS valid_from, lead(CAST(effective AS DATE)) OVER (PARTITION BY list, kind, value ORDER BY effective) AS valid_to FROM e),
p AS (SELECT DISTINCT page_id, url, DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INT) AS fetched, contains(url, '://') AS ok,
    string_split(split_part(split_part(split_part(lower(url), '://', 2), '?', 1), '#', 1), '/') AS parts FROM pages),
a AS (SELECT *, rtrim(split_part(list_last(string_split(parts[1], '@')), ':', 1), '.') AS name FROM p),
q AS (SELECT *, CASE WHEN NOT ok THEN '' WHEN regexp_matches(name, '^www[0-9]*[.][^.]+[.]') THEN name[strpos(name, '.') + 1 :] ELSE name END AS host FROM a),
f AS (SELECT *, host || '/' || array_to_string(list_filter(parts[2:], lambda x: x <> ''), '/') || '/' AS full_path FROM q),
h AS (SELECT f.page_id, f.url, f.fetched, i.list, i.kind, i.value, i.action,
    CASE i.kind WHEN 'path' THEN 0 WHEN 'host' THEN 1 ELSE 2 END AS r
    FROM f LEFT JOIN i ON i.action <> 'lift' AND i.valid_from <= f.fetched AND (i.valid_to IS NULL OR f.fetched < i.valid_to) AND f.host <> ''
    AND ((i.kind = 'host' AND f.host = i.value) OR (i.kind = 'domain' AND (f.host = i.value OR ends_with(f.host, '.' || i.value))) OR (i.kind = 'path' AND starts_with(f.full_path, i.value || '/')))),
n AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY r, -length(value), list, value, action) AS k, count(list) OVER (PARTITION BY page_id, url) AS n_active FROM h)
SELECT page_id, fetched, n_active, coalesce(action, 'none') AS verdict, list, value FROM n WHERE k = 1
"""
