"""Window diagnostics and the T-5 readiness audit."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.functions.day_bits import day_at, day_number, day_words, has
from lockstep.operators.calendar_ops import provenance, with_session_at, with_session_index
from lockstep.operators.coverage import latest_attempts, selected_rows, told_days, window_sessions
from lockstep.operators.events import CLEAN, cohort_predicate, selected_primary

CATEGORIES = ("present", "future", "known_no_data", "provider_error", "attempted", "unattempted")


#: What the latest attempt at a missing day makes of it; no attempt at all is the last category.
ANSWERS = {"known_no_data": ("no_data",), "provider_error": ("error",), "attempted": ("success", "partial")}


def _answered_words(missing: DataFrame, attempts: DataFrame) -> DataFrame:
    """Missing days by the latest attempt at them, as words: one row a security and one set a category."""
    days = with_session_index(missing.select("security_id", day_at(F.col("_day")).alias("session")), "session", "")
    latest = with_session_at(latest_attempts(attempts, days), F.col("ix"), "session")
    return day_words(latest, ["security_id"], {
        f"_{name}": F.when(F.col("latest_status").isin(*statuses), F.col("session")) for name, statuses in ANSWERS.items()})


def classified_windows(windows: DataFrame, prices: DataFrame, attempts: DataFrame, provider: str, as_of_date) -> DataFrame:
    """Distinct windows with ``session_classifications``: each session and its category.

    Bars of any provider count; attempts only of the configured one.  The latest attempt
    decides, and it is found once per distinct missing day, not once per window.
    """
    rows = window_sessions(windows, prices)
    missing = told_days(rows, ["security_id"], "missing").distinct()
    answered = _answered_words(missing, attempts.where(F.col("provider") == provider)).withColumnRenamed("security_id", "_security")
    rows = rows.join(answered, F.col("security_id") == F.col("_security"), "left")

    def category(day):
        told = F.when(~F.array_contains("missing", day), "present").when(day > day_number(F.lit(as_of_date)), "future")
        for name in ANSWERS:
            told = told.when(has(F.col(f"_{name}"), day), name)
        return told.otherwise("unattempted")

    # 21 sessions a window.
    entries = F.transform("sessions", lambda d: F.struct(day_at(d).alias("session"), category(d).alias("classification")))
    return rows.select("security_id", "obs_ix", entries.alias("session_classifications"))


def classified_days(windows: DataFrame, prices: DataFrame, attempts: DataFrame, provider: str, as_of_date) -> DataFrame:
    """``classified_windows`` with one row a session."""
    rows = classified_windows(windows, prices, attempts, provider, as_of_date)
    return rows.select("security_id", "obs_ix", F.explode_outer("session_classifications").alias("_e")).where("_e is not null").select(
        "security_id", "obs_ix", F.col("_e.session").alias("session"), F.col("_e.classification").alias("category"))


def diagnose_windows(windows: DataFrame, prices: DataFrame, attempts: DataFrame, provider: str, as_of_date) -> DataFrame:
    """Counts, session lists and status of each distinct ``(security_id, obs_ix)`` window."""
    rows = classified_windows(windows, prices, attempts, provider, as_of_date)
    count = lambda name: F.size(F.filter("session_classifications", lambda e: e["classification"] == name)).cast("long")
    counts = {f"{c}_count": count(c) for c in CATEGORIES}
    rows = rows.withColumns(counts | {"required_count": F.size("session_classifications").cast("long")})
    rows = rows.withColumn("missing_count", F.col("required_count") - F.col("present_count"))
    kinds = sum((F.col(f"{c}_count") > 0).cast("int") for c in CATEGORIES if c != "present")
    status = (F.when(F.col("missing_count") == 0, "complete")
              .when(F.col("future_count") == F.col("missing_count"), "not_reached")
              .when(kinds > 1, "mixed_attempt_history").when(F.col("known_no_data_count") > 0, "known_no_data")
              .when(F.col("provider_error_count") > 0, "provider_error")
              .when(F.col("unattempted_count") > 0, "unattempted_missing").otherwise("mixed_attempt_history"))
    return rows.withColumn("status", status)


def sessions_of(category: str):
    """Sessions of one category out of ``session_classifications``."""
    return F.transform(F.filter("session_classifications", lambda e: e["classification"] == category),
                       lambda e: e["session"])


def t5_audit(ipos: DataFrame, companies: DataFrame, lockups: DataFrame, securities: DataFrame, prices: DataFrame,
             attempts: DataFrame, *, provider: str, as_of_date, primary_lockup_only: bool = True,
             ticker=None, ipo_id=None, lockup_id=None, **status) -> DataFrame:
    """One row per agreement and primary security with its readiness.

    Undated agreements keep a row with readiness ``no_known_event_date``.
    """
    status = status or CLEAN
    rows = selected_rows(ipos, companies, lockups, securities).where(cohort_predicate(
        ticker=ticker, ipo_id=ipo_id, lockup_id=lockup_id, **status,
        primary=selected_primary() if primary_lockup_only else None))
    df = with_session_index(rows.select("ipo_id", "lockup_id", "security_id", "ticker", "company_name",
                                        "event_date", "event_date_source"), "event_date", "_c_")
    df = df.withColumn("event_ix", F.col("_c_next_ix")).withColumn("obs_ix", F.col("event_ix") - 5) \
        .drop("_c_ix", "_c_next_ix", "_c_prev_ix")
    windows = diagnose_windows(df.where("obs_ix is not null"), prices, attempts, provider, as_of_date)
    df = df.join(windows, ["security_id", "obs_ix"], "left")
    for index, name in ((F.col("event_ix"), "event_session"), (F.col("obs_ix"), "t5_session"),
                        (F.col("obs_ix") - 20, "required_start")):
        df = with_session_at(df, index, name)
    reached = F.col("t5_session") <= F.lit(as_of_date)
    retryable = F.col("unattempted_count") + F.col("attempted_count")
    readiness = (F.when(F.col("event_date").isNull(), "no_known_event_date")
                 .when(F.col("missing_count") == 0, "complete").when(~reached, "not_reached")
                 .when(F.col("provider_error_count") > 0, "provider_error").when(retryable > 0, "backfill_candidate")
                 .when(F.col("known_no_data_count") == F.col("missing_count"), "provider_exhausted")
                 .otherwise("mixed_incomplete"))
    return df.withColumns({
        "readiness": readiness, "reached": reached, "retryable_count": retryable,
        "reached_window_contains_future_session": reached & (F.col("future_count") > 0),
        "configured_provider": F.lit(provider), "as_of_date": F.lit(as_of_date), **provenance()})


def t5_summary(audit: DataFrame) -> DataFrame:
    """The twenty totals of the audit."""
    dated = F.col("readiness") != "no_known_event_date"

    def total(column, name):
        return F.coalesce(F.sum(column), F.lit(0)).alias(name)

    def windows(readiness):
        return F.count_if(F.col("readiness") == readiness)

    return audit.agg(
        F.count(F.lit(1)).alias("selected_lockups"), F.count_if(dated).alias("audited_windows"),
        F.count_if(~dated).alias("skipped_no_event_date"), F.count_if("reached").alias("reached_t5_windows"),
        windows("not_reached").alias("not_reached_t5_windows"), windows("complete").alias("complete_windows"),
        F.count_if(F.col("reached") & (F.col("readiness") != "complete")).alias("incomplete_reached_windows"),
        total("required_count", "total_required_sessions"), total("present_count", "total_present_sessions"),
        total("missing_count", "total_missing_sessions"), total("known_no_data_count", "known_no_data_sessions"),
        total("provider_error_count", "provider_error_sessions"), total("attempted_count", "attempted_missing_sessions"),
        total("unattempted_count", "unattempted_retryable_sessions"), total("retryable_count", "retryable_sessions"),
        total("future_count", "future_not_reached_sessions"),
        windows("provider_exhausted").alias("provider_exhausted_windows"),
        windows("provider_error").alias("provider_error_windows"),
        windows("backfill_candidate").alias("backfill_candidate_windows"),
        windows("mixed_incomplete").alias("mixed_incomplete_windows"))
