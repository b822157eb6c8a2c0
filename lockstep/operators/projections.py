"""Read-only research projections as DataFrames."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.constants import (FROZEN, LEGACY_STRICT, LIFECYCLE, SHADOW, STRICT, STORED_BAR_VERSION, Hypothesis)
from lockstep.operators.calendar_ops import provenance, with_session_at, with_session_index
from lockstep.operators.events import CLEAN, cohort_predicate, promoted_primary, with_event_date


def matches_text(text: str) -> Column:
    """Case-insensitive substring of the issuer name or ticker."""
    needle = F.lit(text.strip().lower())
    return F.contains(F.lower("name"), needle) | F.coalesce(F.contains(F.lower("ticker"), needle), F.lit(False))


def result_label() -> Column:
    """Outcome of a mature signal relative to the frozen target group."""
    mature = (F.col("signal_status") == "matured") & F.col("realized_outcome_value").isNotNull()
    target, bearish = F.col("interaction_group") == "high_high", F.col("realized_outcome_value") < 0
    label = F.when(target & bearish, "bearish_hit").when(target, "no_bearish_hit") \
        .when(bearish, "bearish_non_target").otherwise("non_target")
    return F.when(mature, label)


_MODES = (STRICT, LEGACY_STRICT, SHADOW, LIFECYCLE)
SIGNAL_FIELDS = ("signal_id", "security_id", "evaluation_mode", "observation_date", "required_observation_date",
                 "event_trade_date", "feature1_value", "feature2_value", "interaction_group", "is_high_high",
                 "signal_status", "unavailable_reason", "realized_outcome_value", "outcome_observation_date",
                 "bearish_mfe_20d", "bearish_mae_20d", "created_at")


def signal_roles(signals: DataFrame, hypothesis: Hypothesis = FROZEN) -> DataFrame:
    """Per lock-up the strict, shadow and lifecycle row: by mode order, then id."""
    order = F.array_position(F.array(*[F.lit(m) for m in _MODES]), F.col("evaluation_mode"))
    rank, row = F.struct(order.alias("m"), F.col("signal_id")), F.struct(*SIGNAL_FIELDS)

    def role(*modes):
        # Rows outside the role have a null ordering key, which min_by ignores.
        return F.min_by(row, F.when(F.col("evaluation_mode").isin(*modes), rank))

    rows = signals.where((F.col("hypothesis_id") == hypothesis.hypothesis_id)
                         & (F.col("hypothesis_version") == hypothesis.version))
    return rows.groupBy("lockup_id").agg(role(STRICT, LEGACY_STRICT).alias("strict_signal"),
                                         role(SHADOW).alias("shadow_signal"), role(LIFECYCLE).alias("lifecycle_row"))


def signal_listing(signals: DataFrame, ipos: DataFrame, companies: DataFrame, *, mode: str = STRICT, status=None,
                   interaction_group=None, ticker=None) -> DataFrame:
    from lockstep.operators.prospective import persisted_modes
    rows = (signals.where(F.col("evaluation_mode").isin(*persisted_modes(mode)))
            .join(ipos.select("ipo_id", "company_id"), "ipo_id")
            .join(companies.select("company_id", "ticker", F.col("name").alias("company_name")), "company_id"))
    if status:
        rows = rows.where(F.col("signal_status") == status)
    if interaction_group:
        rows = rows.where(F.col("interaction_group") == interaction_group)
    if ticker:
        rows = rows.where(cohort_predicate(ticker=ticker))
    return rows.withColumn("signal_locked_at", F.col("created_at")).orderBy(
        F.col("observation_date").desc_nulls_last(), "event_date", "ticker", "lockup_id")


def clean_cohort(lockups: DataFrame, ipos: DataFrame, companies: DataFrame) -> DataFrame:
    """Classified, priced operating offerings with a dated primary agreement."""
    return (with_event_date(lockups).join(ipos, "ipo_id")
            .join(companies.select("company_id", "ticker", F.col("name").alias("company_name")), "company_id")
            .where(cohort_predicate(**CLEAN, primary=promoted_primary()))
            .select("lockup_id", "ipo_id", "company_id", "ticker", "company_name", "ipo_date", "event_date",
                    "primary_lockup_expiration_date"))


def _tracked(cohort: DataFrame, signals: DataFrame, snapshots: DataFrame, hypothesis: Hypothesis,
             version: str) -> DataFrame:
    """Cohort with its signal roles, its snapshot at the frozen offset and the calendar T-5."""
    fields = ("security_id", "observation_date", "event_trade_date", hypothesis.feature1, hypothesis.feature2)
    snap = (snapshots.where((F.col("observation_offset") == hypothesis.observation_offset)
                            & (F.col("snapshot_version") == version))
            .groupBy("lockup_id").agg(F.min_by(F.struct(*fields), "security_id").alias("snapshot")))
    df = cohort.join(signal_roles(signals, hypothesis), "lockup_id", "left").join(snap, "lockup_id", "left")
    df = with_session_index(df, "event_date", "_c_")
    df = with_session_at(df, F.col("_c_next_ix") + hypothesis.observation_offset, "calendar_t5")
    return df.drop("_c_ix", "_c_next_ix", "_c_prev_ix")


def upcoming_lockups(cohort: DataFrame, signals: DataFrame, snapshots: DataFrame, securities: DataFrame,
                     readiness: DataFrame, *, today, hypothesis: Hypothesis = FROZEN,
                     version: str = STORED_BAR_VERSION) -> DataFrame:
    """Prospective monitoring rows; snapshot-only rows of the discovery period are left out.

    Stored signal evidence wins over snapshots, and snapshots over the calendar.
    """
    df = _tracked(cohort, signals, snapshots, hypothesis, version)
    df = df.withColumn("s", F.coalesce("strict_signal", "shadow_signal", "lifecycle_row"))
    has, snap = F.col("s").isNotNull(), F.col("snapshot").isNotNull()
    df = df.where(~(F.col("s").isNull() & snap & (F.col("snapshot.observation_date") <= F.lit(hypothesis.cutoff))))
    mode = F.col("s.evaluation_mode")
    genuine = has & mode.isin(STRICT, LEGACY_STRICT, SHADOW)
    required = F.when(genuine, F.coalesce("s.required_observation_date", "s.observation_date", "calendar_t5")) \
        .otherwise(F.coalesce("s.required_observation_date", "calendar_t5"))
    df = df.withColumn("required_t5_date", required)
    waiting = F.col("required_t5_date") > F.lit(today)
    timing = (F.when(mode == SHADOW, "shadow_signal_frozen")
              .when(F.col("s.signal_status") == "unavailable", "observation_before_prospective_start")
              .when(has, "signal_frozen").when(snap, "t5_snapshot_available").when(waiting, "waiting_for_t5")
              .otherwise("waiting_for_market_data"))
    mature = F.when(F.col("s.signal_status") == "matured", F.col("s.realized_outcome_value"))
    df = df.join(securities.withColumnRenamed("security_id", "_primary_security"), "company_id", "left")

    def feature(signal, name):
        return F.coalesce(F.when(genuine, F.col(f"s.{signal}")), F.col(f"snapshot.{name}"))

    out = df.select(
        "ipo_id", "lockup_id", "ticker", "company_name", "ipo_date", F.col("event_date").alias("lockup_event_date"),
        F.when(has, F.col("s.security_id")).otherwise(F.coalesce("snapshot.security_id", "_primary_security"))
        .alias("security_id"),
        F.when(has, F.col("s.event_trade_date")).otherwise(F.col("snapshot.event_trade_date")).alias("event_trade_date"),
        F.when(has, F.col("s.signal_status")).otherwise(
            F.when(waiting, "pending_observation").otherwise("waiting_for_market_data")).alias("m8_status"),
        mode.alias("evaluation_mode"),
        F.when(mode.isin(STRICT, LEGACY_STRICT), "strict").when(mode == SHADOW, "shadow").alias("prospective_track"),
        F.col("s.unavailable_reason").alias("unavailable_reason"), snap.alias("has_minus5_snapshot"),
        F.col("snapshot.observation_date").alias("stored_t5_snapshot_date"), "required_t5_date",
        timing.alias("t5_timing_status"), feature("feature1_value", hypothesis.feature1).alias("return_20d_at_minus5"),
        feature("feature2_value", hypothesis.feature2).alias("realized_vol_20d_at_minus5"),
        F.col("s.interaction_group").alias("interaction_group"),
        F.coalesce("s.is_high_high", F.lit(False)).alias("is_high_high"), mature.alias("post_event_20d_return"),
        F.col("s.outcome_observation_date").alias("outcome_observation_date"),
        F.col("s.bearish_mfe_20d").alias("bearish_mfe_20d"), F.col("s.bearish_mae_20d").alias("bearish_mae_20d"),
        F.col("s.created_at").alias("signal_locked_at"), F.col("s.signal_status").alias("signal_status"),
        F.col("s.realized_outcome_value").alias("realized_outcome_value"),
        F.datediff("event_date", F.lit(today)).alias("calendar_days_to_event"))
    ready = readiness.where("required_count is not null").groupBy("lockup_id").agg(
        F.max_by(F.struct("readiness", "present_count", "missing_count"), "security_id").alias("_r"))
    return (out.withColumns({"result": result_label(), **provenance()}).drop("signal_status", "realized_outcome_value")
            .join(ready, "lockup_id", "left")
            .select("*", F.col("_r.readiness").alias("t5_readiness"), F.col("_r.present_count").alias("t5_present_count"),
                    F.col("_r.missing_count").alias("t5_missing_count")).drop("_r")
            .orderBy("required_t5_date", "lockup_event_date", F.coalesce("ticker", F.lit("")), "lockup_id"))


def research_summary(cohort: DataFrame, signals: DataFrame, snapshots: DataFrame, prices: DataFrame, *, today,
                     hypothesis: Hypothesis = FROZEN, version: str = STORED_BAR_VERSION) -> DataFrame:
    """Counts that partition the clean cohort, plus strict-signal counts."""
    from lockstep.operators.outcomes import side_by_side
    df = _tracked(cohort, signals, snapshots, hypothesis, version)
    strict, shadow, life = (F.col(c).isNotNull() for c in ("strict_signal", "shadow_signal", "lifecycle_row"))
    category = (F.when(strict, "prospective_signals")
                .when(~shadow & life & (F.col("lifecycle_row.signal_status") == "unavailable"), "missed_t5_window")
                .when(F.col("snapshot.observation_date") <= F.lit(hypothesis.cutoff), "historical_unavailable")
                .when(F.col("calendar_t5") > F.lit(today), "pending_observation").otherwise("waiting_for_market_data"))
    df = df.withColumn("_k", category)
    status, high = F.col("strict_signal.signal_status"), F.col("strict_signal.is_high_high")
    counts = df.agg(
        F.count(F.lit(1)).alias("eligible_lockups"),
        *[F.count_if(F.col("_k") == k).alias(k) for k in ("historical_unavailable", "missed_t5_window",
          "pending_observation", "waiting_for_market_data", "prospective_signals")],
        F.count_if(shadow).alias("shadow_signals"), F.count_if(status == "awaiting_event").alias("awaiting_event"),
        F.count_if(status == "awaiting_outcome").alias("awaiting_outcome"),
        F.count_if(status == "matured").alias("matured_signals"), F.count_if(high).alias("high_high_signals"),
        F.count_if(high & (status == "matured")).alias("high_high_matured"))
    return side_by_side([counts, prices.agg(F.max("trade_date").alias("latest_market_date"))])


def historical_reference(dataset: DataFrame, hypothesis: Hypothesis = FROZEN) -> dict[str, DataFrame]:
    """What the discovery sample says about a hypothesis, as one row set for each part.

    ``ols`` with the sample size, the four ``groups``, sign-stability ``flags`` and
    coefficient ``ranges`` of the leave-one-out runs.
    """
    from lockstep.operators import statistics as st
    known = dataset.where(F.col("observation_date") <= F.lit(hypothesis.cutoff))
    names = hypothesis.feature1, hypothesis.feature2, hypothesis.outcome
    cases = st.complete_cases(known, *names, hypothesis.observation_offset)
    full, runs = st.ols(cases, *names), st.leave_one_out(cases, *names)
    return {"ols": full, "groups": st.interaction_cells(known, *names, hypothesis.observation_offset),
            "flags": st.robustness_flags(runs, full), "ranges": st.run_ranges(runs, full)}


def candidate_list(ipos: DataFrame, companies: DataFrame, filings: DataFrame, documents: DataFrame, facts: DataFrame,
                   summaries: DataFrame, outcomes: DataFrame, *, text: str | None = None, limit: int | None = None) -> DataFrame:
    """Newest candidates with counts and lookups; a limit, if given, cuts before anything is attached."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive")
    rows = ipos.join(companies.select("company_id", "cik", "name", "ticker", "exchange"), "company_id")
    if text:
        rows = rows.where(matches_text(text))
    page = rows if limit is None else rows.orderBy(
        F.col("first_filing_date").desc_nulls_last(), "name", "ipo_id").limit(limit)
    filed = filings.groupBy("company_id").agg(F.count(F.lit(1)).alias("filing_count"))
    final = filings.select(F.col("filing_id").alias("final_prospectus_filing_id"),
                           F.col("filed_at").alias("final_prospectus_filed_at"),
                           F.col("accession_number").alias("final_prospectus_accession"))
    cached = documents.where(F.col("fetch_status") == "success").select(
        F.col("filing_id").alias("final_prospectus_filing_id"), F.col("sha256").alias("document_sha256"))
    known = facts.groupBy("ipo_id").agg(F.count(F.lit(1)).alias("fact_count"))
    event = outcomes.select(F.col("ipo_id"), F.col("lockup_id").alias("primary_lockup_id"), "event_status",
                            "post_20d_return")
    event = event.groupBy("ipo_id", "primary_lockup_id").agg(
        F.min("event_status").alias("event_status"), F.min("post_20d_return").alias("post_20d_return"))
    summary = summaries.select("ipo_id", "latest_close", F.col("return_from_ipo_price").alias("summary_return"))
    out = (page.join(filed, "company_id", "left").join(final, "final_prospectus_filing_id", "left")
           .join(cached, "final_prospectus_filing_id", "left").join(known, "ipo_id", "left")
           .join(summary, "ipo_id", "left").join(event, ["ipo_id", "primary_lockup_id"], "left"))
    return out.withColumns({"filing_count": F.coalesce("filing_count", F.lit(0)),
                            "fact_count": F.coalesce("fact_count", F.lit(0)),
                            "document_cached": F.col("document_sha256").isNotNull()}) \
        .orderBy(F.col("first_filing_date").desc_nulls_last(), "name", "ipo_id")


def candidate_detail(ipo_id: int, ipos: DataFrame, companies: DataFrame, filings: DataFrame, facts: DataFrame,
                     lockups: DataFrame) -> dict[str, DataFrame]:
    """Sections of one candidate as separate row sets, so no section is nested into one row."""
    head = ipos.where(F.col("ipo_id") == ipo_id).join(companies, "company_id")
    return {
        "ipo": head,
        "filings": filings.join(head.select("company_id"), "company_id", "left_semi").orderBy(F.desc("filed_at")),
        "facts": facts.where(F.col("ipo_id") == ipo_id),
        "lockups": lockups.where(F.col("ipo_id") == ipo_id).orderBy("lockup_id")}


def snapshot_trajectory(snapshots: DataFrame, ipos: DataFrame, ipo_id: int | None = None,
                        version: str | None = None) -> DataFrame:
    """Snapshots of the primary agreement in offset order; the lineage is an explicit choice."""
    rows = snapshots.join(ipos.select("ipo_id", "primary_lockup_id"), "ipo_id") \
        .where(F.col("lockup_id") == F.col("primary_lockup_id"))
    if ipo_id is not None:
        rows = rows.where(F.col("ipo_id") == ipo_id)
    if version is not None:
        rows = rows.where(F.col("snapshot_version") == version)
    return rows.select("ipo_id", "observation_offset", "observation_date", "data_cutoff_date",
                       "trading_sessions_to_event", "close", "return_from_ipo_price", "return_5d", "return_10d",
                       "return_20d", "return_40d", "drawdown_from_post_ipo_high", "position_in_post_ipo_range",
                       "avg_volume_20d", "realized_vol_20d", "available_history_sessions") \
        .orderBy("ipo_id", "observation_offset")


def run_rollup(runs: DataFrame, stages: DataFrame) -> DataFrame:
    """Succeeded and failed stage counts, status and duration per run."""
    counts = stages.groupBy("run_id").agg(
        F.count_if(F.col("status") == "succeeded").alias("stages_succeeded"),
        F.count_if(F.col("status") == "failed").alias("stages_failed"))
    return runs.join(counts, "run_id", "left").withColumns({
        "stages_succeeded": F.coalesce("stages_succeeded", F.lit(0)),
        "stages_failed": F.coalesce("stages_failed", F.lit(0)),
        "duration_seconds": F.unix_micros("finished_at") / 1e6 - F.unix_micros("started_at") / 1e6})


def run_status(runs: DataFrame, name: str, prices: DataFrame) -> DataFrame:
    """Last run, last successful run and latest market date of one job."""
    from lockstep.operators.outcomes import side_by_side
    order = F.struct("started_at", "run_id")
    won = F.when(F.col("status") == "succeeded", order)
    last = runs.where(F.col("run_name") == name).agg(
        F.max_by("run_id", order).alias("last_run_id"), F.max_by("status", order).alias("last_run_status"),
        F.max_by("run_id", won).alias("last_successful_run_id"))
    return side_by_side([last, prices.agg(F.max("trade_date").alias("latest_market_date"))])
