"""URL filtering by dated lists, evaluated as of the time of each fetch.

List entries are dated events: on a day an entry is put on a list with an action, or taken off.  Per entry
they become validity intervals [from, to) in days, disjoint by construction.  A capture is judged by the
entries of its host and parent domains that are active on the day it was fetched; the longest domain
decides, and among equals blocking wins.

The as-of join is an equi-join.  An interval is cut into aligned blocks of 1, 16, 256 and 4096 days, at
most 30 a level, and a (host, day) looks up its one block on each level: no pair of a capture with an
interval that does not hold is ever made.  Captures are first reduced to distinct (host, day), which
combines before the shuffle, so a host with a third of all captures costs one row a day; the verdict
returns to the captures by an equi-join whose hot side Spark can split.

Column expressions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (1, 16, 256, 4096)
#: Days after 1970-01-01 at which open intervals end.
FOREVER = 65_536
BLOCK, ALLOW, OFF = "block", "allow", "off"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port and final dot; null if there is none."""
    authority = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", "")
    return F.nullif(F.lower(F.regexp_replace(host, r"\.$", "")), F.lit(""))


def domains_of(host: Column) -> Column:
    """A host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Rows (domain, action, from_day, to_day) from dated entries (domain, listed_on date, action).

    Of several events of a domain on one day blocking counts before allowing before taking off.  An event
    holds until the next day on which the domain has one.  Rows with a null are ignored.
    """
    rank = F.when(F.col("action") == BLOCK, 0).when(F.col("action") == ALLOW, 1).otherwise(2)
    daily = (entries.select(F.lower("domain").alias("domain"), F.unix_date("listed_on").alias("from_day"), "action")
             .where("domain is not null and from_day is not null and action is not null")
             .groupBy("domain", "from_day").agg(F.min_by("action", F.struct(rank, "action")).alias("action")))
    # A domain has one row a day: bounded by the days of the lists.
    following = F.lead("from_day").over(Window.partitionBy("domain").orderBy("from_day"))
    return (daily.withColumn("to_day", F.coalesce(following, F.lit(FOREVER)))
            .where(F.col("action") != OFF).select("domain", "action", "from_day", "to_day"))


def interval_blocks(intervals: DataFrame) -> DataFrame:
    """Rows (domain, action, level, block) that tile each interval exactly, the larger blocks in the middle."""
    start, end = F.col("from_day"), F.col("to_day")
    rows = []
    for level, size in enumerate(LEVELS):
        wider = LEVELS[level + 1] if level + 1 < len(LEVELS) else None
        # Aligned ends at this level, kept inside the interval; what the wider level covers is left to it.
        lo, hi = F.ceil(start / size), F.floor(end / size)
        if wider is None:
            spans = [(lo, hi)]
        else:
            ratio = wider // size
            wide_lo, wide_hi = F.ceil(start / wider) * ratio, F.floor(end / wider) * ratio
            inside = wide_lo < wide_hi
            spans = [(lo, F.when(inside, wide_lo).otherwise(hi)), (F.when(inside, wide_hi).otherwise(hi), hi)]
        for a, b in spans:
            rows.append(F.when(a < b, F.transform(F.sequence(a, F.greatest(a, b - 1)), lambda k: F.struct(
                F.lit(level).alias("level"), k.cast("long").alias("block")))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>")))
    return intervals.select("domain", "action", F.explode(F.concat(*rows)).alias("x")).select("domain", "action", "x.*")


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """captures with host, matched_domain, matched_action and allowed.

    A capture with no active entry is allowed.  A null or relative URL has no host and is allowed; so is
    one without a fetch time, for nothing is known to be active then.  Repeated rows stay.  Empty captures
    give no rows, empty entries allow all.  Existing columns of the added names are replaced.
    """
    given = captures.drop("host", "matched_domain", "matched_action", "allowed")
    given = given.withColumn("host", host_of(F.col(url))).withColumn("__day", F.unix_date(F.to_date(fetched)))
    asked = given.where("host is not null and __day is not null").select("host", "__day").distinct()
    blocks = F.array(*(F.struct(F.lit(level).alias("level"), F.floor(F.col("__day") / size).alias("block")) for level, size in enumerate(LEVELS)))
    looked = asked.select("host", "__day", F.explode(domains_of(F.col("host"))).alias("domain")).withColumn("x", F.explode(blocks)).select(
        "host", "__day", "domain", "x.*")
    held = looked.join(interval_blocks(validity_intervals(entries)), ["domain", "level", "block"])
    verdict = held.groupBy("host", "__day").agg(
        F.max(F.struct(F.length("domain").alias("n"), (F.col("action") == BLOCK).alias("blocks"), "domain", "action")).alias("__best"))
    out = given.join(verdict, ["host", "__day"], "left")
    return out.select(*(c for c in given.columns if c != "__day"), F.col("__best.domain").alias("matched_domain"),
                      F.col("__best.action").alias("matched_action"),
                      (F.coalesce(F.col("__best.action"), F.lit(ALLOW)) != BLOCK).alias("allowed"))
