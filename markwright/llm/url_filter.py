"""URL filters as a temporal list join (operator 8), DataFrame functions only.

Dated list entries (pattern, category, day, action ``add`` or ``remove``) become
validity intervals [valid_from, valid_to): each event holds until the next one
of its pattern and category. A pattern is a host, a domain (it covers its sub-hosts) or a
host with a path prefix; it is brought to the form of a capture's keys (host in
lower case without a dot at its end, no empty path parts, no slash at the end) and
reported in that form. A capture has one key for each domain suffix of its
host and each leading part of its path, as deep as the deepest pattern of the
list; the as-of join takes the intervals of those keys that hold on the fetch day, and the most specific pattern decides
(then the category that sorts first).

Events are pre-aggregated to one per (pattern, category, day) - a remove
wins over an add of the same day - so a pattern has at most one row a day. Hot
hosts: the join splits by key and AQE splits a skewed side. User information
and port of a url aren't part of its host. Null or host-less
urls and null days match nothing and are kept unblocked. Repeated captures
give a row each; null capture ids keep their rows; extra columns are ignored.
An empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bare(host: Column) -> Column:
    """A host in lower case, without the dot of the root at its end."""
    return F.regexp_replace(F.lower(host), r"\.+$", "")


def host_of(url: Column) -> Column:
    return bare(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)*([^/?#:@]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def canonical(pattern: Column) -> Column:
    """A list pattern in the form of the captures' keys; paths keep their case."""
    parts = F.split(F.trim(pattern), "/")
    path = F.array_remove(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "")
    return F.array_join(F.concat(F.array(bare(parts[0])), path), "/")


def intervals(entries: DataFrame) -> DataFrame:
    """pattern, category, valid_from, valid_to (null: still valid) of a list's ``add`` events."""
    daily = entries.withColumn("pattern", canonical(F.col("pattern"))).where("pattern is not null and pattern <> '' and day is not null").groupBy("pattern", "category", "day").agg(F.max(F.when(F.col("action") == "add", 0).otherwise(1)).alias("removed"))
    own = Window.partitionBy("pattern", "category").orderBy("day")  # at most one row a day
    return daily.withColumn("valid_to", F.lead("day").over(own)).where("removed = 0").select("pattern", "category", F.col("day").alias("valid_from"), "valid_to")


def keys(host: Column, path: Column, depth: Column) -> Column:
    """Domain suffixes of two labels or more, and the host with each of the first ``depth`` parts of its path."""
    labels = F.split(host, r"\.")
    parts = F.array_remove(F.split(path, "/"), "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.when(
        (F.size(parts) > 0) & (depth > 0), F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(parts), depth), F.lit(1))), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    ).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(suffixes, prefixes))).otherwise(F.array().cast("array<string>"))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, fetch_day, blocked, n_matches, pattern, category, valid_from for every row of ``captures`` (page_id, url, fetch_day)."""
    base = captures.select(F.col("page_id").cast("long").alias("page_id"), "url", "fetch_day").withColumn("host", host_of(F.col("url")))
    # Rows that agree in all columns are evaluated once and counted back out.
    base = base.groupBy("page_id", "url", "fetch_day", "host").agg(F.count("*").alias("__copies"))
    deepest = entries.agg(F.coalesce(F.max(F.size(F.split(canonical(F.col("pattern")), "/")) - 1), F.lit(0)).alias("__depth"))
    keyed = base.crossJoin(F.broadcast(deepest)).select("page_id", "url", "fetch_day", F.explode(keys(F.col("host"), path_of(F.col("url")), F.col("__depth"))).alias("pattern"))
    found = keyed.join(intervals(entries), "pattern").where((F.col("fetch_day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetch_day") < F.col("valid_to"))))
    best = found.groupBy("page_id", "url", "fetch_day").agg(F.count("*").alias("n_matches"), F.min(F.struct(-F.length("pattern"), "pattern", "category", "valid_from")).alias("best"))
    best = best.select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("fetch_day").alias("f"), "n_matches", "best")
    both = base.join(best, F.expr("page_id <=> p and url <=> u and fetch_day <=> f"), "left")
    both = both.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy"))
    return both.select(
        "page_id", "host", "fetch_day", F.col("best").isNotNull().alias("blocked"), F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), "best.pattern", "best.category", "best.valid_from"
    )


DAYS = 360


def captures_of(pages: DataFrame) -> DataFrame:
    """``pages`` has no fetch times; the day of the period is the id modulo its length."""
    return pages.select("page_id", "url", F.pmod(F.col("page_id"), F.lit(DAYS)).cast("int").alias("fetch_day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts, domains and first path parts that occur in ``pages``; days follow from the MD5 of each pattern."""
    host, part = host_of(F.col("url")), F.regexp_extract(path_of(F.col("url")), r"^/([^/]+)", 1)
    seen = pages.select(host.alias("host"), part.alias("part")).where("host <> ''").distinct()
    domain = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    patterns = (
        seen.select(F.col("host").alias("pattern"), F.lit("host").alias("category"))
        .union(seen.where(domain != "").select(domain, F.lit("domain")))
        .union(seen.where("part <> ''").select(F.concat("host", F.lit("/"), "part"), F.lit("path")))
        .distinct()
    )
    code = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("int")
    dated = patterns.withColumn("code", code).where("code % 3 < 2")  # two thirds of the patterns are ever listed
    first = (F.col("code") % 200).cast("int")
    return dated.select(
        "pattern",
        "category",
        F.explode(
            F.array(
                F.struct(first.alias("day"), F.lit("add").alias("action")),
                F.struct((first + 20 + F.col("code") % 50).cast("int").alias("day"), F.lit("remove").alias("action")),
                F.struct((first + 100 + F.col("code") % 40).cast("int").alias("day"), F.lit("add").alias("action")),
            )
        ).alias("e"),
    ).select("pattern", "category", "e.day", "e.action")


ORACLE = r"""
WITH c AS (
  SELECT page_id, url, CAST(page_id % 360 AS INT) AS fetch_day,
    rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)*([^/?#:@]*)', 1)), '.') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
seen AS (SELECT DISTINCT host, regexp_extract(path, '^/([^/]+)', 1) AS part FROM c WHERE host <> ''),
patterns AS (
  SELECT host AS pattern, 'host' AS category FROM seen
  UNION SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1), 'domain' FROM seen WHERE regexp_extract(host, '([^.]+\.[^.]+)$', 1) <> ''
  UNION SELECT host || '/' || part, 'path' FROM seen WHERE part <> ''),
coded AS (SELECT *, CAST('0x' || substr(md5(pattern), 1, 6) AS INT) AS code FROM patterns),
iv AS (
  SELECT pattern, category, CAST(code % 200 AS INT) AS valid_from, CAST(code % 200 + 20 + code % 50 AS INT) AS valid_to FROM coded WHERE code % 3 < 2
  UNION ALL SELECT pattern, category, CAST(code % 200 + 100 + code % 40 AS INT), NULL FROM coded WHERE code % 3 < 2),
m AS (
  SELECT c.page_id, iv.*, row_number() OVER (PARTITION BY c.page_id ORDER BY length(pattern) DESC, pattern, category, valid_from) AS rn,
    count(*) OVER (PARTITION BY c.page_id) AS n
  FROM c JOIN iv ON c.fetch_day >= iv.valid_from AND (iv.valid_to IS NULL OR c.fetch_day < iv.valid_to)
   AND (iv.category = 'host' AND (c.host = iv.pattern OR c.host LIKE '%.' || iv.pattern)
     OR iv.category = 'domain' AND (c.host = iv.pattern OR c.host LIKE '%.' || iv.pattern)
     OR iv.category = 'path' AND (c.host || '/' || array_to_string(list_filter(string_split(c.path, '/'), lambda x: x <> ''), '/') || '/') LIKE iv.pattern || '/%'))
SELECT c.page_id, c.host, c.fetch_day, m.page_id IS NOT NULL AS blocked, CAST(coalesce(m.n, 0) AS BIGINT) AS n_matches, m.pattern, m.category, m.valid_from
FROM c LEFT JOIN m ON c.page_id = m.page_id AND m.rn = 1
"""
