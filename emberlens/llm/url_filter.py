"""URL filters by a temporal list join.

A list is a log of dated entries: a key was added or removed. Entries become validity intervals, and an as-of join evaluates every
capture against the entries that were active when it was fetched. All DataFrame functions.

A key is a host ("bad.example.com"), a domain above it ("example.com"), or a host with a path ("example.com/x").
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

FAR = "9999-12-31 00:00:00"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and trailing dot; empty for null or for what isn't a URL."""
    return F.lower(F.rtrim(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(".")))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """The list keys a URL can match: host with path, host, and each domain above the host."""
    labels = F.split(host_of(url), r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.array_distinct(F.filter(F.concat(domains, F.array(F.concat(host_of(url), path_of(url)))), lambda k: k != ""))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(key, action 'add' | 'remove', listed_at timestamp, category) -> (key, category, valid_from, valid_to): half-open intervals.

    An entry holds until the key's next one of its category; only 'add' gives an interval, the last one without an end. Of several entries for a
    key, category and time, 'add' wins. They are merged before the window, so a key has at most a row for each listed time.
    Entries with a null key, action or time are ignored; a null category is a category.
    """
    clean = entries.where("key IS NOT NULL AND action IS NOT NULL AND listed_at IS NOT NULL")
    merged = clean.groupBy("key", "category", "listed_at").agg(F.min("action").alias("action"))  # 'add' < 'remove'
    ahead = W.partitionBy("key", "category").orderBy("listed_at")
    spans = merged.withColumn("valid_to", F.coalesce(F.lead("listed_at").over(ahead), F.lit(FAR).cast("timestamp")))
    return spans.where("action = 'add'").select("key", "category", F.col("listed_at").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, url, fetched_at) x list entries -> page_id, url, fetched_at, host, blocked, hits, category, matched_key.

    blocked: whether any of the URL's keys was listed at the fetch. hits: how many (key, category) intervals held. category and matched_key: the
    longest such key's (ties: the first category, null last). Every capture comes back, null and unreadable URLs and null fetch times as not blocked.
    Captures alike in all three columns are one row; other columns are ignored.

    Each capture meets only the intervals of its own keys; a host with a third of all captures is a skewed equi-join, which Spark
    splits, and what it yields is summed by capture before the next shuffle.
    """
    c = captures.select("page_id", "url", "fetched_at")
    asked = c.withColumn("key", F.explode_outer(keys_of(F.col("url"))))
    i = validity_intervals(entries)
    joined = asked.join(i, (asked["key"] == i["key"]) & (asked["fetched_at"] >= i["valid_from"]) & (asked["fetched_at"] < i["valid_to"]), "left").select(
        "page_id", "url", "fetched_at", i["key"].alias("hit"), "category"
    )
    ranked = F.when(F.col("hit").isNotNull(), F.struct((-F.length("hit")).alias("n"), F.col("hit").alias("key"), F.col("category").isNull().alias("none"), F.col("category").alias("category")))
    out = joined.groupBy("page_id", "url", "fetched_at").agg(F.count("hit").alias("hits"), F.min(ranked).alias("best"))
    return out.select("page_id", "url", "fetched_at", host_of(F.col("url")).alias("host"), (F.col("hits") > 0).alias("blocked"), "hits", F.col("best.category").alias("category"), F.col("best.key").alias("matched_key"))
