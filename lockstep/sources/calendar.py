"""Exchange-session calendar as a fixed-size dimension.

The horizon is fixed (16 801 days), so both views may always be broadcast.  Every
as-of or offset question about sessions becomes an equi-join on a day or on the
session ordinal ``ix``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lockstep.constants import CALENDAR_END, CALENDAR_ID, CALENDAR_START

# Unscheduled full-day closures.
ONE_OFF_CLOSURES = (
    "1994-04-27", "2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14",
    "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09",
)
MONDAY, THURSDAY, FRIDAY, SATURDAY, SUNDAY = 2, 5, 6, 7, 1


def _easter(year: Column) -> Column:
    """Gregorian Easter Sunday by the anonymous integer algorithm."""
    def div(a, b):
        return F.floor(a / b).cast("int")

    a = year % 19
    b, c = div(year, 100), year % 100
    d, e = div(b, 4), b % 4
    g = div(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = div(a + 11 * h + 19 * m, 433)
    month = div(h + m - 7 * n + 90, 25)
    day = (h + m - 7 * n + 33 * month + 19) % 32
    return F.make_date(year, month, day)


def _holiday(day: Column) -> Column:
    y, m, d, dow = F.year(day), F.month(day), F.dayofmonth(day), F.dayofweek(day)

    def observed(month: int, date: int) -> Column:
        shifted = (F.when(d == date - 1, dow == FRIDAY).when(d == date + 1, dow == MONDAY)
                   .otherwise(d == date))
        return (m == month) & shifted

    def nth(month: int, weekday: int, first: int) -> Column:
        return (m == month) & (dow == weekday) & d.between(first, first + 6)

    new_year = (m == 1) & ((d == 1) | ((d == 2) & (dow == MONDAY)))
    return (
        new_year | (nth(1, MONDAY, 15) & (y >= 1998)) | nth(2, MONDAY, 15)
        | (day == F.date_sub(_easter(y), 2)) | nth(5, MONDAY, 25)
        | (observed(6, 19) & (y >= 2022)) | observed(7, 4) | nth(9, MONDAY, 1)
        | nth(11, THURSDAY, 22) | observed(12, 25)
        | day.isin(*[F.to_date(F.lit(x)) for x in ONE_OFF_CLOSURES])
    )


_memo: dict[tuple[str, str], DataFrame] = {}


def calendar_days(spark: SparkSession, closures: DataFrame | None = None) -> DataFrame:
    """Every calendar day with its session ordinals.

    ``ix`` is set on sessions only; ``next_ix``/``prev_ix`` point to the session on
    or after / on or before the day.  ``closures(day)`` adds caller-known closures.
    """
    key = (spark.sparkContext.applicationId, "days")
    if closures is None and key in _memo:
        return _memo[key]
    span = (CALENDAR_END - CALENDAR_START).days + 1
    days = (spark.range(0, span, 1, 1)
            .select(F.date_add(F.lit(CALENDAR_START), F.col("id").cast("int")).alias("day")))
    is_open = ~F.dayofweek("day").isin(SATURDAY, SUNDAY) & ~_holiday(F.col("day"))
    days = days.select("day", is_open.alias("is_session"), F.lit(CALENDAR_ID).alias("calendar_id"))
    if closures is not None:
        # At most one row for each day of the horizon.
        inside = F.col("day").between(F.lit(CALENDAR_START), F.lit(CALENDAR_END))
        extra = F.broadcast(closures.where(inside).select("day", F.lit(True).alias("_closed")).distinct())
        days = (days.join(extra, "day", "left")
                .withColumn("is_session", F.col("is_session") & F.col("_closed").isNull())
                .drop("_closed"))
    opened = F.sum(F.col("is_session").cast("int")).over(
        Window.partitionBy("calendar_id").orderBy("day")).cast("int")
    result = days.withColumn("prev_ix", opened).select(
        "day", "is_session",
        F.when(F.col("is_session"), F.col("prev_ix")).alias("ix"),
        (F.col("prev_ix") + F.when(F.col("is_session"), 0).otherwise(1)).alias("next_ix"),
        "prev_ix")
    if closures is None:
        result = _memo[key] = result.persist()
    return result


def sessions(spark: SparkSession, closures: DataFrame | None = None) -> DataFrame:
    """``(ix, session)`` for every session of the horizon."""
    return (calendar_days(spark, closures).where("is_session")
            .select("ix", F.col("day").alias("session")))


def horizon_reason(day: Column) -> Column:
    """Why a date cannot be aligned, null where it can; no date at all is no fault."""
    outside = ~day.between(F.lit(CALENDAR_START), F.lit(CALENDAR_END))
    return F.when(outside, F.concat(F.lit("date "), day.cast("string"),
                                    F.lit(f" is outside {CALENDAR_ID} range {CALENDAR_START} to {CALENDAR_END}")))


def split_by_horizon(df: DataFrame, *days: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose dates all lie inside the horizon, and the rejected ones with ``reason``.

    One bad row costs itself, not the job.
    """
    reason = F.coalesce(*[horizon_reason(F.col(d)) for d in days])
    told = df.withColumn("reason", reason)
    return told.where("reason is null").drop("reason"), told.where("reason is not null")


def in_horizon(day: Column) -> Column:
    """The day itself, or an error naming the bounds when it lies outside them."""
    reason = horizon_reason(day)
    return F.when(reason.isNull(), day).otherwise(F.raise_error(reason))
