"""URL filters by a temporal list join.

List entries are dated events: from ``effective`` on, an entry (kind, pattern,
category) is on the list ("add") or off it ("drop"). ``validity`` turns the events
of each entry into half-open intervals with ``lead``; of events at one instant the
drop wins. ``filter_urls`` derives a capture's keys - its host, every parent
domain, every path prefix - and joins them to the intervals by key, keeping those
that hold at the fetch time: an as-of join, as the intervals of one entry never
overlap.

Only DataFrame functions. Verdicts are made once for each distinct (url, fetch
time), so a hot host or a URL fetched by a third of all rows is aggregated before
anything is joined, and the way back to the captures is an equi-join whose skewed
side AQE may split. Catalyst broadcasts the list only where its size is below
spark.sql.autoBroadcastJoinThreshold; larger lists are shuffled by key.

A pattern's host is compared without case, a prefix's path with it.

Defined results: a null or host-less URL, or a null time, matches nothing (not
blocked, no hits, ``categories`` empty); events with a null in pattern, kind,
action or date are ignored; repeated captures each get their row; an empty list
blocks nothing, no captures give no rows; repeated events count once; a very long URL has a key for each of its path's
slashes; extra columns of the captures are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def url_keys(url: Column) -> Column:
    """``host:h``, ``domain:`` with h and each parent, ``prefix:`` h plus the path up to each slash and whole."""
    host, path = url_host(url), F.regexp_extract(url, PATH, 1)
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    n, m = F.size(labels), F.size(parts)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, n), ".")))
    upto = lambda i: F.array_join(F.slice(parts, 1, i), "/")
    borders = F.when(m > 1, F.transform(F.sequence(F.lit(1), m - 1), lambda i: F.concat(F.lit("prefix:"), host, upto(i), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.array(F.concat(F.lit("host:"), host)), domains, borders, F.array(F.concat(F.lit("prefix:"), host, path)))
    return F.when(host != "", F.array_distinct(keys))


def validity(events: DataFrame) -> DataFrame:
    """(key, category, valid_from, valid_to) from (kind, pattern, category, action, effective); open intervals end in null."""
    # hosts have no case, paths do
    host = F.substring_index("pattern", "/", 1)
    host_lowered = F.concat(F.lower(host), F.substr(F.col("pattern"), F.length(host) + 1))
    e = events.where("kind is not null and pattern is not null and action is not null and effective is not null").select(
        F.concat("kind", F.lit(":"), host_lowered).alias("key"), F.coalesce("category", F.lit("")).alias("category"), "effective", F.when(F.col("action") == "add", 1).otherwise(0).alias("on")
    )
    e = e.groupBy("key", "category", "effective").agg(F.min("on").alias("on"))
    w = Window.partitionBy("key", "category").orderBy("effective")
    return e.withColumn("valid_to", F.lead("effective").over(w)).where("on = 1").select("key", "category", F.col("effective").alias("valid_from"), "valid_to")


def filter_urls(captures: DataFrame, events: DataFrame, id_col: str, url_col: str, time_col: str) -> DataFrame:
    """(id, host, blocked, n_hits, categories) for every capture: categories sorted and comma-joined."""
    caps = captures.select(captures[id_col].alias(id_col), captures[url_col].alias("_url"), captures[time_col].alias("_at"))
    keys = caps.select("_url", "_at").distinct().where("_url is not null and _at is not null").select("_url", "_at", F.explode(url_keys(F.col("_url"))).alias("key"))
    hits = (
        keys.join(validity(events), "key")
        .where("valid_from <= _at and (valid_to is null or _at < valid_to)")
        .groupBy("_url", "_at")
        .agg(F.count(F.lit(1)).alias("n_hits"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    )
    return caps.join(hits, ["_url", "_at"], "left").select(
        id_col,
        F.coalesce(url_host(F.col("_url")), F.lit("")).alias("host"),
        F.col("n_hits").isNotNull().alias("blocked"),
        F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"),
        F.coalesce("categories", F.lit("")).alias("categories"),
    )
