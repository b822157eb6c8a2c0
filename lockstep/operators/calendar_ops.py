"""Session alignment and offsets as broadcast equi-joins on the calendar dimension."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.constants import CALENDAR_ID, CALENDAR_PROVIDER, CALENDAR_VERSION
from lockstep.sources.calendar import calendar_days, in_horizon, sessions


def with_session_index(df: DataFrame, day: str, prefix: str, strict: bool = False) -> DataFrame:
    """Append ``{prefix}ix``, ``{prefix}next_ix`` and ``{prefix}prev_ix`` of a date column.

    A date outside the horizon has none, like a missing one (``split_by_horizon`` names
    the reason); with ``strict`` it stops the job.
    """
    dim = F.broadcast(calendar_days(df.sparkSession).select(
        F.col("day").alias("_cal_day"), F.col("ix").alias(f"{prefix}ix"),
        F.col("next_ix").alias(f"{prefix}next_ix"), F.col("prev_ix").alias(f"{prefix}prev_ix")))
    return df.join(dim, (in_horizon(F.col(day)) if strict else F.col(day)) == F.col("_cal_day"), "left").drop("_cal_day")


def with_session_at(df: DataFrame, index: Column, output: str) -> DataFrame:
    """Append the session date at a session ordinal (null outside the horizon)."""
    dim = F.broadcast(sessions(df.sparkSession).select(
        F.col("ix").alias("_at"), F.col("session").alias(output)))
    return df.join(dim, index == F.col("_at"), "left").drop("_at")


def is_session(df: DataFrame, day: str, output: str = "is_session") -> DataFrame:
    df = with_session_index(df, day, "_c_")
    return df.withColumn(output, F.col("_c_ix").isNotNull()).drop("_c_ix", "_c_next_ix", "_c_prev_ix")


def session_on_or_after(df: DataFrame, day: str, output: str) -> DataFrame:
    df = with_session_index(df, day, "_c_")
    return with_session_at(df, F.col("_c_next_ix"), output).drop("_c_ix", "_c_next_ix", "_c_prev_ix")


def session_on_or_before(df: DataFrame, day: str, output: str) -> DataFrame:
    df = with_session_index(df, day, "_c_")
    return with_session_at(df, F.col("_c_prev_ix"), output).drop("_c_ix", "_c_next_ix", "_c_prev_ix")


def session_offset(df: DataFrame, day: str, offset: int, output: str) -> DataFrame:
    """Session ``offset`` sessions away; an origin that is no session is an error."""
    df = with_session_index(df, day, "_c_")
    origin = F.coalesce(F.col("_c_ix"), F.when(F.col(day).isNotNull(), F.raise_error(
        F.concat(F.col(day).cast("string"), F.lit(f" is not an {CALENDAR_ID} session"))).cast("int")))
    df = df.withColumn("_c_ix", origin)
    return (with_session_at(df, F.col("_c_ix") + F.lit(offset), output)
            .drop("_c_ix", "_c_next_ix", "_c_prev_ix"))


def sessions_in_range(df: DataFrame, start: str, end: str, output: str = "session") -> DataFrame:
    """One row per session between two date columns; inverted ranges give none."""
    df = with_session_index(with_session_index(df, start, "_s_"), end, "_e_")
    first, last = F.col("_s_next_ix"), F.col("_e_prev_ix")
    walk = F.explode(F.when((F.col(start) <= F.col(end)) & (first <= last), F.sequence(first, last)))
    keep = [c for c in df.columns if not c.startswith(("_s_", "_e_"))]
    return with_session_at(df.select(*keep, walk.alias("ix")), F.col("ix"), output)


def session_walk(df: DataFrame, start_ix: str, end_ix: str) -> DataFrame:
    """Inclusive sessions between two ordinals, in either direction."""
    return df.withColumn("ix", F.explode(F.sequence(start_ix, end_ix)))


def resolve_event_session(df: DataFrame, event_date: str = "event_date") -> DataFrame:
    """Event session on or after the event date, with calendar provenance."""
    df = with_session_index(df, event_date, "_v_").withColumnRenamed("_v_next_ix", "event_ix")
    return with_session_at(df, F.col("event_ix"), "event_session").drop("_v_ix", "_v_prev_ix") \
        .withColumns(provenance())


def resolve_observation_session(df: DataFrame, offset: Column, event_date: str = "event_date") -> DataFrame:
    """Event session plus the observation session ``offset`` sessions away."""
    df = resolve_event_session(df, event_date).withColumn("obs_ix", F.col("event_ix") + offset)
    return with_session_at(df, F.col("obs_ix"), "observation_session")


def provenance() -> dict[str, Column]:
    return {"calendar_id": F.lit(CALENDAR_ID), "calendar_provider": F.lit(CALENDAR_PROVIDER),
            "calendar_version": F.lit(CALENDAR_VERSION)}


def quarters_between(df: DataFrame, start: str, end: str) -> DataFrame:
    """One row per calendar quarter touched by a date range (for index-file pruning)."""
    month = F.explode(F.when(F.col(start) <= F.col(end), F.sequence(
        F.trunc(start, "quarter"), F.trunc(end, "quarter"), F.expr("interval 3 months"))))
    return (df.withColumn("_q", month)
            .withColumns({"year": F.year("_q"), "quarter": F.quarter("_q")}).drop("_q"))
