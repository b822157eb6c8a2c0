"""Immutable prospective signals: admission, locking, later outcome attachment, evaluation."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.constants import (FROZEN, GROUPS, LEGACY_STRICT, LIFECYCLE, SCORECARD, SHADOW, STRICT,
                                Hypothesis, Scorecard)
from lockstep.functions.numeric import side
from lockstep.functions.order_stats import medians
from lockstep.operators.calendar_ops import provenance, with_session_at, with_session_index
from lockstep.operators.events import CLEAN, cohort_predicate, selected_primary, with_event_date
from lockstep.operators.snapshots import session_windows

BEFORE_START = "observation_before_prospective_start"


def persisted_modes(mode: str) -> tuple[str, ...]:
    """Strict evidence also covers rows stored under its old name."""
    return (STRICT, LEGACY_STRICT) if mode == STRICT else (mode,)


def candidate_events(lockups: DataFrame, ipos: DataFrame, companies: DataFrame, *, primary_lockup_only=True,
                     ticker=None, ipo_id=None, limit=None, **status) -> DataFrame:
    status = status or CLEAN
    rows = (with_event_date(lockups).join(ipos, "ipo_id")
            .join(companies.select("company_id", "ticker"), "company_id")
            .where(cohort_predicate(ticker=ticker, ipo_id=ipo_id, **status,
                                    primary=selected_primary() if primary_lockup_only else None)))
    if limit is not None:
        rows = rows.orderBy("ipo_id", "lockup_id").limit(limit)
    return rows.select("lockup_id", "ipo_id", "company_id", "ticker", "event_date")


def first_signal(signals: DataFrame, hypothesis: Hypothesis, modes) -> DataFrame:
    """Lowest-id stored row per lock-up among the given modes."""
    fields = ("signal_id", "security_id", "observation_date", "realized_outcome_value", "signal_status", "evaluation_mode")
    return (signals.where((F.col("hypothesis_id") == hypothesis.hypothesis_id)
                          & (F.col("hypothesis_version") == hypothesis.version)
                          & F.col("evaluation_mode").isin(*modes))
            .groupBy("lockup_id").agg(F.min_by(F.struct(*fields), "signal_id").alias("_s"))
            .select("lockup_id", *[F.col(f"_s.{c}").alias(f"existing_{c}") for c in fields]))


def decide(candidates: DataFrame, signals: DataFrame, snapshots_v2: DataFrame, outcomes: DataFrame, bars: DataFrame,
           securities: DataFrame, *, mode: str = STRICT, hypothesis: Hypothesis = FROZEN, as_of: dt.date,
           now_utc: dt.datetime) -> DataFrame:
    """One row per candidate with the ``action`` of this run and everything the action needs.

    A stored signal decides alone: admission, calendar and snapshots are consulted only
    for lock-ups without one.
    """
    if mode == LEGACY_STRICT:
        mode = STRICT
    if mode not in (STRICT, SHADOW):
        raise ValueError("unknown evaluation mode")
    if now_utc.tzinfo is None or now_utc.utcoffset() != dt.timedelta(0):
        raise ValueError("now_utc must be a timezone-aware UTC datetime")
    strict = mode == STRICT
    df = with_session_index(candidates, "event_date", "_c_").withColumns({
        "event_ix": F.col("_c_next_ix"), "ix": F.col("_c_next_ix") + hypothesis.observation_offset}) \
        .drop("_c_ix", "_c_next_ix", "_c_prev_ix")
    df = with_session_at(df, F.col("event_ix"), "event_session")
    df = with_session_at(df, F.col("ix"), "canonical_observation")
    snaps = snapshots_v2.where(F.col("observation_offset") == hypothesis.observation_offset)
    fields = ("observation_date", "snapshot_status", hypothesis.feature1, hypothesis.feature2)
    snaps = snaps.groupBy("lockup_id").agg(F.min_by(F.struct(*fields), "security_id").alias("_v2"))
    df = (df.join(first_signal(signals, hypothesis, persisted_modes(mode)), "lockup_id", "left")
          .join(signals.where(F.col("evaluation_mode") == LIFECYCLE)
                .where((F.col("hypothesis_id") == hypothesis.hypothesis_id)
                       & (F.col("hypothesis_version") == hypothesis.version))
                .select("lockup_id", F.lit(True).alias("has_lifecycle")).distinct(), "lockup_id", "left")
          .join(snaps, "lockup_id", "left").join(securities, "company_id", "left"))
    old = F.col("existing_signal_id").isNotNull()
    snapshot = F.col("_v2").isNotNull()
    observed = F.when(old, F.col("existing_observation_date"))
    if strict:
        observed = observed.when(snapshot, F.col("_v2.observation_date"))
    df = df.withColumns({"observation_date": observed.otherwise(F.col("canonical_observation")),
                         "calendar_mismatch": F.coalesce(
                             F.col("_v2.observation_date") != F.col("canonical_observation"), F.lit(False))})
    cutoff, today, locked = F.lit(hypothesis.cutoff), F.lit(as_of), F.lit(now_utc.date())
    obs, evt = F.col("observation_date"), F.col("event_session")
    if strict:
        value1, value2 = F.col(f"_v2.{hypothesis.feature1}"), F.col(f"_v2.{hypothesis.feature2}")
        complete = snapshot & (F.col("_v2.observation_date") == obs) & (F.col("_v2.snapshot_status") == "complete")
        steps = [
            (~(obs > cutoff), F.when((obs <= cutoff) & (evt > cutoff), "lifecycle_unavailable").otherwise("not_eligible")),
            (obs > today, F.lit("pending_observation")),
            (F.col("security_id").isNull() | ~F.coalesce(complete, F.lit(False)) | value1.isNull() | value2.isNull(),
             F.lit("waiting_for_market_data"))]
    else:
        probes = df.where(~old & F.col("security_id").isNotNull() & F.col("ix").isNotNull()).select("security_id", "ix")
        windows = session_windows(bars, probes).select(
            "security_id", "ix", F.col("close").alias("_t5"), "present_21",
            F.col(hypothesis.feature1).alias("_f1"), F.col(hypothesis.feature2).alias("_f2"))
        df = df.join(windows, ["security_id", "ix"], "left")
        value1, value2 = F.col("_f1"), F.col("_f2")
        steps = [
            (~((obs <= cutoff) & (cutoff < evt)), F.lit("not_eligible")),
            (today >= evt, F.lit("missed_lock_window")),
            (F.col("security_id").isNull() | F.col("_t5").isNull(), F.lit("missing_t5_market_data")),
            ((F.col("present_21") < 21) | value1.isNull() | value2.isNull(), F.lit("incomplete_feature_window")),
            (locked >= evt, F.lit("missed_lock_window"))]
    action = F.when(F.col("event_date").isNull(), "no_event_date").when(old, "existing")
    for test, name in steps:
        action = action.when(test, name)
    df = df.withColumn("action", action.otherwise("create"))
    created = F.col("action") == "create"
    side1 = side(value1, F.lit(hypothesis.feature1_threshold))
    side2 = side(value2, F.lit(hypothesis.feature2_threshold))
    df = df.withColumns({
        "feature1_value": F.when(created, F.round(value1, 10)), "feature2_value": F.when(created, F.round(value2, 10)),
        "feature1_side": F.when(created, side1), "feature2_side": F.when(created, side2),
        "signal_security_id": F.coalesce("existing_security_id", "security_id"),
        "evaluation_mode": F.lit(mode)})
    result = outcomes.select("lockup_id", F.col("security_id").alias("signal_security_id"),
                             F.col(hypothesis.outcome).alias("outcome_value"),
                             F.col("bearish_mfe_20d").alias("outcome_mfe"), F.col("bearish_mae_20d").alias("outcome_mae"),
                             F.when(F.col("event_trade_date").isNull(), F.col("as_of_date"))
                             .otherwise(F.coalesce("outcome_20_date", "as_of_date")).alias("outcome_date"))
    df = df.join(result, ["lockup_id", "signal_security_id"], "left")
    live = F.col("action").isin("create", "existing")
    status = (F.when(~live, F.lit(None).cast("string"))
              .when(F.col("existing_realized_outcome_value").isNotNull(), "already_matured")
              .when(today < evt, "awaiting_event").when(F.col("outcome_value").isNull(), "awaiting_outcome")
              .otherwise("matured"))
    return df.withColumn("next_status", status).drop("_v2", "_t5", "present_21", "_f1", "_f2", "company_id")


def signal_columns(mode: Column, hypothesis: Hypothesis) -> dict[str, Column]:
    """Registry and calendar fields every stored row carries."""
    return {"hypothesis_id": F.lit(hypothesis.hypothesis_id), "hypothesis_version": F.lit(hypothesis.version),
            "evaluation_mode": mode, "observation_offset": F.lit(hypothesis.observation_offset),
            "required_observation_date": F.col("observation_date"),
            "feature1_name": F.lit(hypothesis.feature1), "feature2_name": F.lit(hypothesis.feature2),
            "feature1_threshold": F.lit(hypothesis.feature1_threshold),
            "feature2_threshold": F.lit(hypothesis.feature2_threshold),
            "signal_id": F.xxhash64(F.lit(hypothesis.hypothesis_id), F.lit(hypothesis.version), mode,
                                    F.col("lockup_id")), **provenance()}


def new_signals(decisions: DataFrame, hypothesis: Hypothesis, now_utc: dt.datetime) -> DataFrame:
    """Rows to append; ``created_at`` is the lock and is written here only."""
    rows = decisions.where(F.col("action") == "create")
    group = F.concat_ws("_", "feature1_side", "feature2_side")
    return rows.select("lockup_id", "ipo_id", F.col("signal_security_id").alias("security_id"), "event_date",
                       F.col("event_session").alias("event_trade_date"), "observation_date", "feature1_value",
                       "feature2_value", "feature1_side", "feature2_side", group.alias("interaction_group"),
                       (group == "high_high").alias("is_high_high"), F.lit("signal_created").alias("signal_status"),
                       F.lit(now_utc).alias("created_at"), "evaluation_mode") \
        .withColumns(signal_columns(F.col("evaluation_mode"), hypothesis))


def lifecycle_rows(decisions: DataFrame, hypothesis: Hypothesis, now_utc: dt.datetime) -> DataFrame:
    """Audit rows of events observed too early, appended once."""
    rows = decisions.where((F.col("action") == "lifecycle_unavailable") & F.col("has_lifecycle").isNull())
    return rows.select("lockup_id", "ipo_id", "security_id", "event_date", "observation_date",
                       F.lit(False).alias("is_high_high"), F.lit("unavailable").alias("signal_status"),
                       F.lit(BEFORE_START).alias("unavailable_reason"), F.lit(now_utc).alias("created_at")) \
        .withColumns(signal_columns(F.lit(LIFECYCLE), hypothesis))


OUTCOME = ("realized_outcome_name", "realized_outcome_value", "bearish_mfe_20d", "bearish_mae_20d",
           "outcome_observation_date", "outcome_attached_at")


def _state_changes() -> Column:
    """Decisions that move a signal: to another status, or to its outcome."""
    step = F.col("next_status")
    return step.isin("awaiting_event", "awaiting_outcome", "matured") & (
        (step == "matured") | ~step.eqNullSafe(F.col("existing_signal_status")))


def takes_effect() -> Column:
    """Decisions after which the stored signals differ: locks, audit rows and state changes."""
    audit = (F.col("action") == "lifecycle_unavailable") & F.col("has_lifecycle").isNull()
    return (F.col("action") == "create") | audit | F.coalesce(_state_changes(), F.lit(False))


def state_changes(decisions: DataFrame, hypothesis: Hypothesis, now_utc: dt.datetime) -> DataFrame:
    """Rows for the state log, one for each signal whose status or outcome changes in this run."""
    key = F.coalesce("existing_signal_id", F.xxhash64(
        F.lit(hypothesis.hypothesis_id), F.lit(hypothesis.version), F.col("evaluation_mode"), F.col("lockup_id")))
    attach = F.col("next_status") == "matured"
    values = dict(zip(OUTCOME, (F.lit(hypothesis.outcome), F.col("outcome_value"), F.col("outcome_mfe"),
                                F.col("outcome_mae"), F.col("outcome_date"), F.lit(now_utc).cast("timestamp"))))
    return decisions.where(_state_changes()).select(
        key.alias("signal_id"), F.col("next_status").alias("signal_status"),
        *[F.when(attach, value).alias(name) for name, value in values.items()])


def latest_states(states: DataFrame) -> DataFrame:
    """Per signal the status of the latest run and, as ``_o``, the outcome attached first."""
    attached = F.when(F.col("realized_outcome_value").isNotNull(), F.col("outcome_attached_at"))
    return states.groupBy("signal_id").agg(
        F.max("run").alias("run"), F.max_by("signal_status", "run").alias("signal_status"),
        F.min_by(F.struct(*OUTCOME), attached).alias("_o"))


def current_signals(locks: DataFrame, states: DataFrame) -> DataFrame:
    """Locks with their latest state; an outcome that is there already stays."""
    latest = latest_states(states).select("signal_id", F.col("signal_status").alias("_status"), "_o")
    attach = F.col("realized_outcome_value").isNull() & F.col("_o").isNotNull()
    value = "realized_outcome_value"
    out = locks.join(latest, "signal_id", "left").withColumn("signal_status", F.coalesce("_status", "signal_status"))
    # The value decides for the others, so it comes last.
    for name in [c for c in OUTCOME if c != value] + [value]:
        out = out.withColumn(name, F.when(attach, F.col(f"_o.{name}")).otherwise(F.col(name)))
    return out.drop("_status", "_o")


def advance_signals(signals: DataFrame, decisions: DataFrame, hypothesis: Hypothesis, now_utc: dt.datetime) -> DataFrame:
    """Stored and new signals with their next status; an outcome attaches once and then stays.

    The whole table as one frame; ``plans.signal_log`` keeps it by appending what changes.
    """
    fresh = new_signals(decisions, hypothesis, now_utc)
    added = lifecycle_rows(decisions, hypothesis, now_utc)
    rows = signals.unionByName(fresh, allowMissingColumns=True).unionByName(added, allowMissingColumns=True)
    return current_signals(rows, state_changes(decisions, hypothesis, now_utc).withColumn("run", F.lit("")))


def prospective_report(decisions: DataFrame, dry_run: bool = False, rejected: DataFrame | None = None) -> DataFrame:
    """Run counters from the decisions alone, so a dry run needs no writes.

    ``rejected`` are the agreements set aside before (``split_by_horizon``): they count
    as seen and as errors.
    """
    def of(name):
        return F.count_if(F.col("action") == name)

    action, nxt = F.col("action"), F.col("next_status")
    # A dry run stops before a new signal's status is looked at.
    followed = (action == "existing") if dry_run else action.isin("existing", "create")
    eligible = ~action.isin("no_event_date", "lifecycle_unavailable", "not_eligible")  # null for a rejected row
    zero = F.lit(0).cast("long")
    attach = F.count_if(followed & (nxt == "matured"))
    already = F.count_if(nxt == "already_matured")
    lifecycle_known = F.count_if((action == "lifecycle_unavailable") & F.coalesce("has_lifecycle", F.lit(False)))
    failed = decisions.limit(0).select("ipo_id") if rejected is None else rejected.select("ipo_id")
    told = decisions.withColumn("_error", F.lit(False)).unionByName(failed.withColumn("_error", F.lit(True)), allowMissingColumns=True)
    return told.agg(
        F.count_distinct("ipo_id").alias("ipos_seen"), F.count(F.lit(1)).alias("lockups_seen"),
        F.count_if("_error").alias("errors"),
        F.count_if(eligible).alias("eligible_events"), of("pending_observation").alias("pending_observation"),
        of("waiting_for_market_data").alias("waiting_for_market_data"),
        (zero if dry_run else of("create")).alias("signals_created"),
        (of("create") if dry_run else zero).alias("signals_would_create"), of("existing").alias("signals_existing"),
        F.count_if(followed & (nxt == "awaiting_event")).alias("awaiting_event"),
        F.count_if(followed & (nxt == "awaiting_outcome")).alias("awaiting_outcome"),
        (zero if dry_run else attach).alias("outcomes_attached"),
        (attach if dry_run else zero).alias("outcomes_would_attach"),
        (already if dry_run else already + attach).alias("matured"), (already + lifecycle_known).alias("already_current"),
        F.count_if(action.isin("no_event_date", "lifecycle_unavailable")).alias("unavailable"),
        of("lifecycle_unavailable").alias("unavailable_observation_before_cutoff"),
        F.count_if(F.col("calendar_mismatch")).alias("calendar_snapshot_mismatches"),
        of("missing_t5_market_data").alias("missing_t5_market_data"),
        of("incomplete_feature_window").alias("incomplete_feature_window"),
        of("missed_lock_window").alias("missed_lock_window"))


def preview(decisions: DataFrame) -> DataFrame:
    """The signals this run locks (or would lock)."""
    return decisions.where(F.col("action") == "create").select(
        "ticker", "lockup_id", F.col("observation_date").alias("canonical_t5"), "event_session", "feature1_value",
        "feature2_value", F.concat_ws("_", "feature1_side", "feature2_side").alias("interaction_group"),
        F.col("evaluation_mode").alias("eligibility_reason"))


def normalise_legacy_modes(signals: DataFrame) -> DataFrame:
    """Rename legacy rows to strict unless a strict row for the same identity exists."""
    key = ["hypothesis_id", "hypothesis_version", "lockup_id"]
    strict = signals.where(F.col("evaluation_mode") == STRICT).select(*key, F.lit(True).alias("_strict")).distinct()
    rename = (F.col("evaluation_mode") == LEGACY_STRICT) & F.col("_strict").isNull()
    return signals.join(strict, key, "left").withColumn(
        "evaluation_mode", F.when(rename, STRICT).otherwise(F.col("evaluation_mode"))).drop("_strict")


def is_bearish(value: Column) -> Column:
    return F.coalesce(value < 0, F.lit(False))


def _population(signals: DataFrame, mode: str, hypothesis: Hypothesis) -> DataFrame:
    return signals.where((F.col("hypothesis_id") == hypothesis.hypothesis_id)
                         & F.col("evaluation_mode").isin(*persisted_modes(mode))
                         & (F.col("signal_status") != "unavailable"))


def evaluation_totals(signals: DataFrame, mode: str, hypothesis: Hypothesis = FROZEN) -> DataFrame:
    value = F.col("realized_outcome_value")
    bearish = is_bearish(value)
    return _population(signals, mode, hypothesis).agg(
        F.count(F.lit(1)).alias("total_signals"), F.count(value).alias("matured_signals"),
        F.count_if(value.isNull()).alias("pending_signals"),
        F.count_if(bearish & (F.col("interaction_group") == "high_high")).alias("target_bearish_hits"),
        F.count_if(bearish).alias("bearish_outcomes"))


def evaluation_groups(signals: DataFrame, mode: str, hypothesis: Hypothesis = FROZEN) -> DataFrame:
    """The four groups of matured signals; empty groups stay."""
    from lockstep.operators.statistics import outcome_stats
    rows = _population(signals, mode, hypothesis).where("realized_outcome_value is not null") \
        .withColumnRenamed("realized_outcome_value", "y")
    key = ["interaction_group"]
    stats = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_events"), *outcome_stats("y"))
    middle = medians(rows, key, {"y": "median_outcome", "bearish_mfe_20d": "median_bearish_mfe",
                                 "bearish_mae_20d": "median_bearish_mae"})
    names = signals.sparkSession.createDataFrame([(g,) for g in GROUPS], "interaction_group string")
    out = names.join(stats.join(middle, key, "left"), key, "left").drop("le_5pct_count", "le_10pct_count", "le_20pct_count")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_events", "bearish_hit_count")})


def scorecard_rows(signals: DataFrame, ipos: DataFrame, companies: DataFrame, mode: str = STRICT,
                   hypothesis: Hypothesis = FROZEN, spec: Scorecard = SCORECARD) -> DataFrame:
    """Observation rows of one evaluated population (clean, primary, one mode)."""
    if mode not in (STRICT, SHADOW):
        raise ValueError("evaluation_mode must be strict_prospective or shadow_prospective")
    scope = ipos.where(cohort_predicate(**CLEAN)).select("ipo_id", "company_id", "primary_lockup_id")
    value = F.col("realized_outcome_value")
    return (_population(signals, mode, hypothesis).where(F.col("hypothesis_version") == hypothesis.version)
            .join(scope, "ipo_id").where(F.col("lockup_id") == F.col("primary_lockup_id"))
            .join(companies.select("company_id", "ticker"), "company_id")
            .select("signal_id", "ticker", "company_id", "ipo_id", "lockup_id", "event_date", "observation_date",
                    F.col("created_at").alias("signal_locked_at"), F.lit(mode).alias("evaluation_mode"),
                    F.col("evaluation_mode").alias("persisted_evaluation_mode"), "interaction_group",
                    F.col("feature1_value").alias("return_20d"), F.col("feature2_value").alias("realized_vol_20d"),
                    "signal_status", value.alias("post_20d_return"), F.when(value.isNotNull(), value < 0).alias("bearish_hit"),
                    (F.col("interaction_group") == spec.target_group).alias("is_target_group")))


def scorecard(rows: DataFrame, mode: str = STRICT, spec: Scorecard = SCORECARD) -> DataFrame:
    """Population, primary and continuous outcomes and interpretation readiness in one row."""
    y, target = F.col("post_20d_return"), F.coalesce("is_target_group", F.lit(False))
    matured, hit = y.isNotNull(), is_bearish(y)
    base = rows.withColumn("evaluation_mode", F.lit(mode))
    one = base.groupBy("evaluation_mode").agg(
        F.count(F.lit(1)).alias("total_signals"), F.count_if(~matured).alias("pending_signals"),
        F.count_if(matured).alias("matured_signals"), F.count_if(target).alias("target_signals"),
        F.count_if(target & matured).alias("matured_target_signals"), F.count_if(hit).alias("bearish_outcomes"),
        F.count_if(matured & ~hit).alias("non_bearish_outcomes"), F.count_if(target & hit).alias("target_bearish_hits"),
        F.count_if(target & matured & ~hit).alias("target_non_bearish_outcomes"), F.avg(y).alias("mean_outcome"),
        F.avg(F.when(target, y)).alias("target_mean_outcome"), F.avg(F.when(~target, y)).alias("non_target_mean_outcome"))
    middle = medians(base.withColumns({"_all": y, "_target": F.when(target, y), "_other": F.when(~target, y)}),
                     ["evaluation_mode"], {"_all": "median_outcome", "_target": "target_median_outcome",
                                           "_other": "non_target_median_outcome"})
    strict = mode == STRICT
    ready = F.lit(strict) & (F.col("matured_signals") >= spec.minimum_matured)
    target_ready = F.lit(strict) & (F.col("matured_target_signals") >= spec.minimum_matured_target)
    return one.join(middle, "evaluation_mode", "left").withColumns({
        "evaluation_id": F.lit(spec.evaluation_id),
        "bearish_outcome_rate": F.try_divide("bearish_outcomes", "matured_signals"),
        "target_bearish_hit_rate": F.try_divide("target_bearish_hits", "matured_target_signals"),
        "target_minus_non_target_median": F.col("target_median_outcome") - F.col("non_target_median_outcome"),
        "matured_threshold_satisfied": ready, "target_threshold_satisfied": target_ready,
        "interpretation_status": F.when(ready & target_ready, "provisional_interpretation_ready")
            .otherwise("descriptive_only")})


def scorecard_groups(rows: DataFrame) -> DataFrame:
    y = F.col("post_20d_return")
    stats = rows.groupBy("interaction_group").agg(
        F.count(F.lit(1)).alias("total_signals"), F.count(y).alias("matured_signals"),
        F.count_if(is_bearish(y)).alias("bearish_outcomes"), F.avg(y).alias("mean_outcome"))
    middle = medians(rows, ["interaction_group"], {"post_20d_return": "median_outcome"})
    names = rows.sparkSession.createDataFrame([(g,) for g in GROUPS], "interaction_group string")
    out = names.join(stats, "interaction_group", "left").join(middle, "interaction_group", "left")
    counts = ("total_signals", "matured_signals", "bearish_outcomes")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}).withColumn(
        "bearish_rate", F.try_divide("bearish_outcomes", "matured_signals"))
