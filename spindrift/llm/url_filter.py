"""URL filters whose lists change over time.

Dated list events (an entry is added or removed) become validity intervals, one per stay on the list.
A capture is matched as of its fetch time: an entry covers a capture if it names the capture's host or a
parent domain of it, and the capture was fetched within one of the entry's intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm._shared import Scratch, need

HOST = r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and trailing dots; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"\.+$", "")


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two labels at least (a host of one label: itself)."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    return F.when(F.coalesce(host, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), ".")))


def intervals(events: DataFrame) -> DataFrame:
    """entry, since, until (null: still listed) from events (entry, added boolean, at).

    Of several events of an entry at one time, a removal holds.  Adding a listed entry, or removing one that isn't,
    changes nothing.  Events with a null are left out.
    """
    e = need(events, "entry", "added", "at").dropna()
    e = e.groupBy("entry", "at").agg(F.min("added").alias("added"))
    order = Window.partitionBy("entry").orderBy("at")
    changes = e.withColumn("was", F.lag("added").over(order)).filter(F.col("added") != F.coalesce("was", F.lit(False)))
    return changes.withColumn("until", F.lead("at").over(order)).filter("added").select("entry", F.col("at").alias("since"), "until")


def filter_captures(captures: DataFrame, events: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """id, host, fetched_at, n_matches, matched (the longest matching entry), blocked for every row.

    A null or malformed URL has an empty host (null URL: null host) and matches nothing, as does a null time.  Repeated rows
    each give a row; other columns are left out.  Only hosts and times are moved, not pages.  The as-of join is one
    window over list entries and captures in order of time, each distinct host and time once, so that a hot host is as many rows as it
    has fetch times; the list is never broadcast for it.
    """
    scratch = Scratch(captures.sparkSession, "urls")
    slim = need(captures, id_col, url_col, time_col).select(F.col(f"`{id_col}`").alias("id"), host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{time_col}`").alias("fetched_at"))
    slim = scratch.write(slim.withColumn("uid", F.monotonically_increasing_id()), "captures")
    # captures that differ in neither host nor time are asked for once
    asked = slim.filter("host <> '' AND fetched_at IS NOT NULL").groupBy("host", "fetched_at").agg(F.count(F.lit(1)).alias("_n")).select("host", "fetched_at")
    keys = asked.select("host", "fetched_at", F.explode(suffixes(F.col("host"))).alias("entry"))
    listed = intervals(events).select("entry", F.col("since").cast(slim.schema["fetched_at"].dataType).alias("at"), F.col("until").cast(slim.schema["fetched_at"].dataType).alias("until"))
    kind = asked.schema["host"].dataType.simpleString()
    both = keys.select("entry", F.col("fetched_at").alias("at"), F.col("host"), F.lit(None).cast(listed.schema["until"].dataType).alias("until"), F.lit(1).alias("side"))
    both = both.unionByName(listed.select("entry", "at", F.lit(None).cast(kind).alias("host"), "until", F.lit(0).alias("side")))
    # the stay that began last, at the fetch time or before it, holds if it hasn't ended
    before = Window.partitionBy("entry").orderBy("at", "side")
    last = F.last(F.when(F.col("side") == 0, F.struct(F.col("at").alias("since"), "until")), ignorenulls=True).over(before)
    hits = both.withColumn("stay", last).filter("side = 1 AND stay IS NOT NULL AND (stay.until IS NULL OR at < stay.until)")
    found = hits.groupBy("host", "at").agg(F.count(F.lit(1)).alias("n_matches"), F.max(F.struct(F.length("entry"), "entry")).alias("m")).select("host", F.col("at").alias("fetched_at"), "n_matches", "m.entry")
    out = slim.join(found, ["host", "fetched_at"], "left")
    return out.select(F.col("id").alias(id_col), "host", "fetched_at", F.coalesce("n_matches", F.lit(0)).cast("bigint").alias("n_matches"), F.col("entry").alias("matched"), F.col("entry").isNotNull().alias("blocked"))
