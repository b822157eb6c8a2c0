"""Audits that compare stored sessions with the calendar, and the two snapshot lineages."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.constants import (FROZEN, PARITY_ATOL, PARITY_RTOL, SESSION_VERSION, STORED_BAR_VERSION,
                                Hypothesis)
from lockstep.functions.day_bits import day_at, day_number, has, session_words
from lockstep.functions.numeric import side, within_tolerance
from lockstep.functions.total_order import with_position
from lockstep.operators.calendar_ops import provenance, with_session_at, with_session_index
from lockstep.operators.coverage import presence, spread, with_window_sessions
from lockstep.operators.events import numbered_bars, with_event_date

# Features stored by both lineages, and pair classes in report order.
AUDITED = (
    "close", "return_5d", "return_10d", "return_20d", "return_40d",
    "realized_vol_5d", "realized_vol_20d", "realized_vol_40d",
    "avg_volume_5d", "avg_volume_20d", "avg_volume_40d",
    "avg_dollar_volume_5d", "avg_dollar_volume_20d", "volume_ratio_5d_to_20d",
    "post_ipo_high_to_date", "post_ipo_low_to_date", "drawdown_from_post_ipo_high",
    "position_in_post_ipo_range", "ipo_gain_retention")
RANGE_FEATURES = AUDITED[-5:]
# What the audit takes of a snapshot, and what its order reads.
STORED = ("ipo_id", "lockup_id", "security_id", "snapshot_version", "observation_offset", "event_trade_date",
          "observation_date", "return_20d", "realized_vol_20d")
ORDER = ("ticker", "lockup_id", "observation_offset", "snapshot_version", "security_id")
SESSION_MISMATCHES = ("event_session_mismatch", "observation_session_mismatch_sparse_history",
                      "observation_session_mismatch_unexplained", "event_and_observation_mismatch")


def session_parity(snapshots: DataFrame, lockups: DataFrame, companies: DataFrame, bars: DataFrame) -> DataFrame:
    """Stored event and observation sessions against calendar ones, per snapshot.

    ``snapshots`` is already limited to the audited cohort and carries ``company_id``.
    """
    stored = snapshots.select(
        "ipo_id", "lockup_id", "security_id", "company_id", "snapshot_version", "observation_offset",
        F.col("event_trade_date").alias("stored_event_trade_date"),
        F.col("observation_date").alias("stored_observation_date"), "return_20d", "realized_vol_20d")
    dated = with_event_date(lockups).select("lockup_id", "event_date", "event_date_source")
    df = stored.join(dated, "lockup_id").join(
        companies.select("company_id", "ticker", F.col("name").alias("company_name")), "company_id")
    df = with_session_index(df, "event_date", "_c_").withColumns({
        "event_ix": F.col("_c_next_ix"), "obs_ix": F.col("_c_next_ix") + F.col("observation_offset")}) \
        .drop("_c_ix", "_c_next_ix", "_c_prev_ix")
    df = with_session_at(df, F.col("event_ix"), "canonical_event_trade_date")
    df = with_session_at(df, F.col("obs_ix"), "canonical_observation_date")

    # Sessions between observation and event: bit tests in the row of each distinct window.
    opened = session_words(bars.sparkSession)
    stored_days = presence(bars).select(F.col("security_id").alias("_security"), "stored")
    walk = spread(df.where("canonical_observation_date is not null and canonical_event_trade_date is not null").select(
        "security_id", "event_ix", "obs_ix", "canonical_observation_date", "canonical_event_trade_date"))
    walk = walk.join(stored_days, F.col("security_id") == F.col("_security"), "left")
    ends = [day_number(F.col("canonical_observation_date")), day_number(F.col("canonical_event_trade_date"))]
    days = F.sequence(F.least(*ends), F.greatest(*ends))
    walk = walk.withColumn("_days", F.filter(days, lambda d: has(opened, d)))
    dates = lambda keep: F.transform(F.filter("_days", keep), day_at)
    walk = walk.withColumn("_lacking", F.filter("_days", lambda d: ~has(F.col("stored"), d)))
    # Counts beside the lists: a reader that takes no list moves none.
    windows = walk.select(
        "security_id", "event_ix", "obs_ix", dates(lambda d: F.lit(True)).alias("expected_sessions"),
        dates(lambda d: has(F.col("stored"), d)).alias("stored_sessions_in_expected_window"),
        F.transform("_lacking", day_at).alias("missing_expected_sessions"),
        F.size("_days").alias("_expected"), F.size("_lacking").alias("_missing"),
        F.array_contains("_lacking", ends[1]).alias("_event_missing"))
    df = df.join(windows, ["security_id", "event_ix", "obs_ix"], "left")

    ordinals = numbered_bars(bars).select("security_id", "trade_date", "bn")
    for name, column in (("_event_bn", "stored_event_trade_date"), ("_obs_bn", "stored_observation_date")):
        df = df.join(ordinals.withColumnsRenamed({"trade_date": column, "bn": name}),
                     ["security_id", column], "left")
    reproduced = F.coalesce(F.col("_obs_bn") == F.col("_event_bn") + F.col("observation_offset"), F.lit(False))
    event_match = F.coalesce(F.col("stored_event_trade_date") == F.col("canonical_event_trade_date"), F.lit(False))
    obs_match = F.coalesce(F.col("stored_observation_date") == F.col("canonical_observation_date"), F.lit(False))
    lacking = (F.col("event_date").isNull() | F.col("stored_event_trade_date").isNull()
               | F.col("stored_observation_date").isNull() | F.col("observation_offset").isNull())
    df = df.withColumns({"event_session_match": event_match, "observation_session_match": obs_match,
                         "old_bar_offset_reproduced": reproduced}).drop("_event_bn", "_obs_bn")
    gaps = F.coalesce("_missing", F.lit(0)) > 0
    mismatch = (F.when(lacking, "missing_required_fields")
                .when(F.col("event_session_match") & F.col("observation_session_match"), "exact_match")
                .when(~F.col("event_session_match") & ~F.col("observation_session_match"),
                      "event_and_observation_mismatch")
                .when(~F.col("event_session_match"), "event_session_mismatch")
                .when(gaps & F.col("old_bar_offset_reproduced"), "observation_session_mismatch_sparse_history")
                .otherwise("observation_session_mismatch_unexplained"))
    df = df.withColumn("mismatch_type", mismatch)
    event_missing = F.coalesce("_event_missing", F.lit(False))
    sparse = (~F.col("mismatch_type").isin("exact_match", "missing_required_fields")
              & F.col("old_bar_offset_reproduced") & gaps
              & F.when(~F.col("event_session_match"), event_missing)
              .otherwise(F.col("mismatch_type") == "observation_session_mismatch_sparse_history"))
    return df.withColumns({
        "sparse_data_related": sparse,
        "expected_session_count": F.coalesce("_expected", F.lit(0)),
        "missing_expected_session_count": F.coalesce("_missing", F.lit(0))}).drop("_expected", "_missing", "_event_missing")


def mismatches(audit: DataFrame) -> DataFrame:
    return audit.where(F.col("mismatch_type") != "exact_match")


def audit_order(audit: DataFrame) -> DataFrame:
    return audit.orderBy(F.coalesce("ticker", F.lit("")), "lockup_id", "observation_offset", "snapshot_version")


def audit_positions(audit: DataFrame) -> DataFrame:
    """``position`` of every row in audit order."""
    return with_position(audit, [F.coalesce("ticker", F.lit("")), F.col("lockup_id"), F.col("observation_offset"),
                                 F.col("snapshot_version"), F.coalesce("security_id", F.lit(-1))])


def session_parity_summary(audit: DataFrame) -> DataFrame:
    def of(kind):
        return F.count_if(F.col("mismatch_type") == kind)

    return audit.agg(
        F.count(F.lit(1)).alias("snapshots_seen"), of("exact_match").alias("exact_matches"),
        of("event_session_mismatch").alias("event_session_mismatches"),
        F.count_if(F.col("mismatch_type").startswith("observation_session")).alias("observation_session_mismatches"),
        of("observation_session_mismatch_sparse_history").alias("observation_sparse_history_cases"),
        of("observation_session_mismatch_unexplained").alias("unexplained_mismatches"),
        of("event_and_observation_mismatch").alias("event_and_observation_mismatches"),
        of("missing_required_fields").alias("missing_required_fields"),
        F.count_if(F.col("mismatch_type").isin(*SESSION_MISMATCHES)).alias("total_session_mismatches"),
        F.count_if("sparse_data_related").alias("sparse_data_related_mismatches")).withColumns(provenance())


def session_parity_by_offset(audit: DataFrame) -> DataFrame:
    return audit.groupBy("observation_offset", "mismatch_type").agg(F.count(F.lit(1)).alias("snapshots"))


def discovery_events(audit: DataFrame, outcomes: DataFrame, hypothesis: Hypothesis = FROZEN) -> DataFrame:
    """First complete feature/outcome row per event at the frozen offset (v1)."""
    have = outcomes.where(F.col(hypothesis.outcome).isNotNull()).select("lockup_id", "security_id")
    rows = audit.where((F.col("snapshot_version") == STORED_BAR_VERSION)
                       & (F.col("observation_offset") == hypothesis.observation_offset)
                       & F.col("return_20d").isNotNull() & F.col("realized_vol_20d").isNotNull())
    rows = rows.join(have, ["lockup_id", "security_id"], "left_semi")
    first = rows.groupBy("lockup_id").agg(F.min("security_id").alias("security_id"))
    return rows.join(first, ["lockup_id", "security_id"], "left_semi")


def discovery_impact(audit: DataFrame, outcomes: DataFrame, prices: DataFrame,
                     hypothesis: Hypothesis = FROZEN) -> DataFrame:
    """How many discovery events sit on a wrong session, and how many could be recomputed."""
    events = discovery_events(audit, outcomes, hypothesis)
    rows = with_window_sessions(events, prices).withColumn("_complete", (F.size("sessions") > 0) & (F.size("missing") == 0))
    wrong = F.col("mismatch_type") != "exact_match"
    out = rows.agg(F.count(F.lit(1)).alias("events"), F.count_if(wrong).alias("with_mismatch"),
                   F.count_if(wrong & F.col("_complete")).alias("recomputable"))
    return out.withColumns({
        "with_exact_match": F.col("events") - F.col("with_mismatch"),
        "mismatch_rate": F.coalesce(F.try_divide("with_mismatch", "events"), F.lit(0.0)),
        "not_recomputable": F.col("with_mismatch") - F.col("recomputable")})


# --------------------------------------------------------------- lineage comparison
_IDENTITY = ("observation_date", "event_trade_date")
_V2_ONLY = ("snapshot_status", "unavailable_reason", "expected_history_sessions", "missing_history_sessions",
            "calendar_id", "calendar_provider", "calendar_version")
PAIR_KEY = ["lockup_id", "security_id", "observation_offset"]


def pair_columns(features=AUDITED) -> tuple[list[str], list[str]]:
    """Columns of the first and of the second lineage that pairs with these features take."""
    before = [*PAIR_KEY, "snapshot_version", *_IDENTITY, *features]
    return before, [*before, *_V2_ONLY]


def _feature_state(name: str, identity: Column, atol: float, rtol: float) -> Column:
    a, b = F.col(f"v1_{name}"), F.col(f"v2_{name}")
    full = (F.col("v2_snapshot_status") == "complete") if name in RANGE_FEATURES else b.isNotNull()
    return (F.when(a.isNull() & b.isNull(), "both_null").when(a.isNull(), "v1_null_v2_value")
            .when(b.isNull(), F.when(full, "v1_value_v2_null").otherwise("v1_value_v2_null_incomplete_history"))
            .when(within_tolerance(a, b, atol, rtol), "match")
            .when(identity & full, "numeric_mismatch_complete_history").otherwise("numeric_mismatch_other"))


def lineage_pairs(v1: DataFrame, v2: DataFrame, *, atol: float = PARITY_ATOL, rtol: float = PARITY_RTOL,
                  features=AUDITED) -> DataFrame:
    """Full outer pairing with one ``features`` entry per audited feature and a class per pair.

    With fewer ``features`` the class is that by those alone.
    """
    left = v1.where(F.col("snapshot_version") == STORED_BAR_VERSION).select(
        *PAIR_KEY, F.lit(True).alias("in_v1"), *[F.col(c).alias(f"v1_{c}") for c in (*_IDENTITY, *features)])
    right = v2.where(F.col("snapshot_version") == SESSION_VERSION).select(
        *PAIR_KEY, F.lit(True).alias("in_v2"),
        *[F.col(c).alias(f"v2_{c}") for c in (*_IDENTITY, *features, *_V2_ONLY)])
    df = left.join(right, PAIR_KEY, "full_outer")
    both = F.col("in_v1").isNotNull() & F.col("in_v2").isNotNull()
    df = df.withColumns({
        "observation_date_match": F.when(both, F.col("v1_observation_date").eqNullSafe(F.col("v2_observation_date"))),
        "event_trade_date_match": F.when(both, F.col("v1_event_trade_date").eqNullSafe(F.col("v2_event_trade_date")))})
    identity = F.col("observation_date_match") & F.col("event_trade_date_match")
    df = df.withColumn("exact_identity_match", identity)
    entries = F.array(*[F.struct(
        F.lit(n).alias("feature"), F.col(f"v1_{n}").alias("v1"), F.col(f"v2_{n}").alias("v2"),
        _feature_state(n, F.col("exact_identity_match"), atol, rtol).alias("state")) for n in features])
    df = df.withColumn("features", F.when(both, entries.cast(
        "array<struct<feature:string,v1:double,v2:double,state:string>>")))
    broken = F.exists("features", lambda f: f["state"] == "numeric_mismatch_complete_history")
    differs = F.exists("features", lambda f: ~f["state"].isin("match", "both_null"))
    reason, status = F.col("v2_unavailable_reason"), F.col("v2_snapshot_status")
    classification = (
        F.when(F.col("in_v1").isNull(), "no_v1_snapshot").when(F.col("in_v2").isNull(), "no_v2_snapshot")
        .when(~F.col("observation_date_match"), "observation_session_mismatch")
        .when(~F.col("event_trade_date_match"), "event_session_mismatch")
        .when(reason == "observation_not_reached", "v2_observation_not_reached")
        .when(reason == "missing_observation_bar", "v2_missing_observation_bar")
        .when(broken, "numeric_feature_mismatch_complete_history")
        .when(differs, "sparse_history_feature_mismatch")
        .when((status == "partial") & (reason == "missing_feature_history"), "v2_partial_missing_feature_history")
        .otherwise("exact_match"))
    return df.withColumn("classification", classification).select(
        *PAIR_KEY, *[f"v1_{c}" for c in _IDENTITY], *[f"v2_{c}" for c in (*_IDENTITY, *_V2_ONLY)],
        "observation_date_match", "event_trade_date_match", "exact_identity_match", "classification", "features")


def lineage_summary(pairs: DataFrame) -> DataFrame:
    def of(kind):
        return F.count_if(F.col("classification") == kind)

    status, comparable = F.col("v2_snapshot_status"), F.col("features").isNotNull()
    agree = F.forall("features", lambda f: f["state"].isin("match", "both_null"))
    return pairs.agg(
        F.count(F.lit(1)).alias("rows_seen"), F.count_if(comparable).alias("comparable_pairs"),
        F.count_if("exact_identity_match").alias("exact_identity_matches"),
        F.count_if(~F.col("observation_date_match")).alias("observation_date_mismatches"),
        F.count_if(~F.col("event_trade_date_match")).alias("event_trade_date_mismatches"),
        *[F.count_if(status == s).alias(f"v2_{s}") for s in ("complete", "partial", "unavailable")],
        F.count_if(agree).alias("exact_feature_matches"),
        of("sparse_history_feature_mismatch").alias("explained_sparse_history_mismatches"),
        of("numeric_feature_mismatch_complete_history").alias("unexplained_complete_history_mismatches"),
        of("no_v1_snapshot").alias("no_v1_snapshot"), of("no_v2_snapshot").alias("no_v2_snapshot"),
        F.coalesce(F.sum("v2_expected_history_sessions"), F.lit(0)).alias("expected_history_sessions"),
        F.coalesce(F.sum("v2_missing_history_sessions"), F.lit(0)).alias("missing_history_sessions"))


def feature_parity(pairs: DataFrame) -> DataFrame:
    """Eight counters per audited feature."""
    rows = pairs.select(F.explode("features").alias("f")).select("f.*")
    state = F.col("state")
    return rows.groupBy("feature").agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(state == "match").alias("matched"),
        F.count_if(~state.isin("match", "both_null")).alias("mismatched"),
        F.count_if(state == "both_null").alias("both_null"),
        F.count_if(state == "v1_null_v2_value").alias("v1_null_v2_value"),
        F.count_if(state.startswith("v1_value_v2_null")).alias("v1_value_v2_null"),
        F.count_if(state == "numeric_mismatch_complete_history").alias("numeric_mismatch_complete_history"),
        F.count_if(state.isin("v1_value_v2_null_incomplete_history", "numeric_mismatch_other"))
        .alias("incomplete_history_mismatch"))


def completeness_by_offset(pairs: DataFrame) -> DataFrame:
    return pairs.where("v2_snapshot_status is not null").groupBy(
        "observation_offset", F.col("v2_snapshot_status").alias("snapshot_status")).agg(
        F.count(F.lit(1)).alias("snapshots"))


def mismatch_examples(pairs: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs that differ, in key order; the first ``limit`` of them if one is given."""
    found = pairs.where(F.col("classification") != "exact_match").orderBy(*PAIR_KEY)
    return found if limit is None else found.limit(limit)


def discovery_features(pairs: DataFrame, dataset: DataFrame, hypothesis: Hypothesis = FROZEN) -> DataFrame:
    """The hypothesis features of discovery members, with each lineage's threshold side."""
    members = dataset.where((F.col("observation_offset") == hypothesis.observation_offset)
                            & (F.col("observation_date") <= F.lit(hypothesis.cutoff))
                            & F.col(hypothesis.feature1).isNotNull() & F.col(hypothesis.feature2).isNotNull()
                            & F.col(hypothesis.outcome).isNotNull()).select("lockup_id", "security_id")
    rows = pairs.where(F.col("observation_offset") == hypothesis.observation_offset) \
        .join(members, ["lockup_id", "security_id"], "left_semi")
    threshold = F.when(F.col("f.feature") == hypothesis.feature1, hypothesis.feature1_threshold) \
        .when(F.col("f.feature") == hypothesis.feature2, hypothesis.feature2_threshold)
    return rows.select("lockup_id", "security_id", "exact_identity_match", "v2_snapshot_status",
                       F.explode("features").alias("f")) \
        .where(F.col("f.feature").isin(hypothesis.feature1, hypothesis.feature2)) \
        .select("lockup_id", "security_id", "exact_identity_match", "v2_snapshot_status", "f.*",
                threshold.alias("threshold")) \
        .withColumns({"v1_side": side(F.col("v1"), F.col("threshold")),
                      "v2_side": side(F.col("v2"), F.col("threshold"))})


def threshold_crossings(features: DataFrame) -> DataFrame:
    return features.where(F.col("v1_side") != F.col("v2_side"))


def discovery_feature_counts(features: DataFrame) -> DataFrame:
    state = F.col("state")
    return features.groupBy("feature").agg(
        F.count_if(state.isin("match", "both_null")).alias("matches_v1"),
        F.count_if(state == "numeric_mismatch_complete_history").alias("differs_complete_canonical_data"),
        F.count_if(~state.isin("match", "both_null", "numeric_mismatch_complete_history"))
        .alias("differs_missing_canonical_data"),
        F.count_if(F.col("v1_side") != F.col("v2_side")).alias("threshold_crossings"))
