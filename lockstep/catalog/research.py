"""Parity, dataset and statistics queries."""
from __future__ import annotations

import dataclasses

import datetime as dt
from dataclasses import replace

from pyspark.sql import functions as F

from lockstep.catalog import register
from lockstep.constants import FROZEN
from lockstep.functions.numeric import rounded
from lockstep.operators import dataset as ds
from lockstep.operators import parity as pa
from lockstep.operators import statistics as st
from lockstep.plans import daily
from lockstep.plans.stored import stored

# The stored tables end in 2001, so the cutoff moves with them; thresholds stay.
HYPOTHESIS = replace(FROZEN, cutoff=dt.date(2000, 6, 30))
F1, F2, Y, OFFSET = "return_20d", "realized_vol_20d", "post_20d_return", -5


# ------------------------------------------------------------------ parity
session_audit = daily.session_audit


@register("n1_session_parity", """
 SELECT lockup_id, observation_offset, event_trade_date AS stored_event_trade_date, cevt AS canonical_event_trade_date, observation_date AS stored_observation_date, cobs AS canonical_observation_date,
  expected AS expected_session_count, expected - have AS missing_expected_session_count, reproduced AS old_bar_offset_reproduced FROM sessp""")
def parity_rows(w):
    return session_audit(w).select(
        "lockup_id", "observation_offset", "stored_event_trade_date", "canonical_event_trade_date",
        "stored_observation_date", "canonical_observation_date", "expected_session_count",
        "missing_expected_session_count", "old_bar_offset_reproduced")


@register("n2_mismatch_class", "SELECT lockup_id, observation_offset, mismatch_type FROM sessp")
def mismatch_class(w):
    return session_audit(w).select("lockup_id", "observation_offset", "mismatch_type")


@register("n3_mismatch_rows", "SELECT mismatch_type, count(*) AS n FROM sessp WHERE mismatch_type <> 'exact_match' GROUP BY 1")
def mismatch_rows(w):
    return pa.mismatches(session_audit(w)).groupBy("mismatch_type").agg(F.count(F.lit(1)).alias("n"))


_SPARSE = """mismatch_type <> 'exact_match' AND reproduced AND have < expected AND CASE WHEN event_trade_date <> cevt THEN event_missing
 ELSE mismatch_type = 'observation_session_mismatch_sparse_history' END"""


@register("n4_sparse_evidence", f"SELECT lockup_id, observation_offset, {_SPARSE} AS sparse_data_related FROM sessp")
def sparse(w):
    return session_audit(w).select("lockup_id", "observation_offset", "sparse_data_related")


@register("n5_audit_order", """
 SELECT lockup_id, observation_offset, row_number() OVER (ORDER BY coalesce(ticker, ''), lockup_id, observation_offset) AS position
 FROM sessp JOIN lock USING (lockup_id) JOIN ipo USING (ipo_id) JOIN comp USING (company_id)""")
def ordered(w):
    return pa.audit_positions(daily.audit_keys(w)).select("lockup_id", "observation_offset", "position")


@register("n6_parity_summary", f"""
 SELECT count(*) AS snapshots_seen, count(*) FILTER (mismatch_type = 'exact_match') AS exact_matches, count(*) FILTER (mismatch_type = 'event_session_mismatch') AS event_session_mismatches,
  count(*) FILTER (mismatch_type LIKE 'observation_session%') AS observation_session_mismatches, count(*) FILTER (mismatch_type = 'observation_session_mismatch_sparse_history') AS observation_sparse_history_cases,
  count(*) FILTER (mismatch_type = 'observation_session_mismatch_unexplained') AS unexplained_mismatches, count(*) FILTER (mismatch_type = 'event_and_observation_mismatch') AS event_and_observation_mismatches,
  count(*) FILTER (mismatch_type = 'missing_required_fields') AS missing_required_fields, count(*) FILTER (mismatch_type <> 'exact_match') AS total_session_mismatches, count(*) FILTER ({_SPARSE}) AS sparse_data_related_mismatches,
  'XNYS' AS calendar_id, 'rules' AS calendar_provider, '1' AS calendar_version FROM sessp""")
def parity_summary(w):
    return pa.session_parity_summary(session_audit(w))


@register("n6_parity_by_offset", "SELECT observation_offset, mismatch_type, count(*) AS snapshots FROM sessp GROUP BY ALL")
def parity_by_offset(w):
    return pa.session_parity_by_offset(session_audit(w))


@register("n7_discovery_impact", """
 SELECT count(*) AS events, count(*) FILTER (m <> 'exact_match') AS with_mismatch, count(*) FILTER (m <> 'exact_match' AND full21) AS recomputable,
  count(*) FILTER (m = 'exact_match') AS with_exact_match, count(*) FILTER (m <> 'exact_match') / count(*) AS mismatch_rate, count(*) FILTER (m <> 'exact_match' AND NOT full21) AS not_recomputable FROM (
 SELECT mismatch_type AS m, (SELECT count(*) FROM sbar b WHERE b.security_id = p.security_id AND b.ix BETWEEN obs_ix - 20 AND obs_ix) = 21 AS full21
 FROM sessp p JOIN outc o ON o.lockup_id = p.lockup_id AND o.security_id = p.security_id WHERE observation_offset = -5 AND return_20d IS NOT NULL AND realized_vol_20d IS NOT NULL AND post_20d_return IS NOT NULL)""")
def discovery_impact(w):
    return pa.discovery_impact(session_audit(w, OFFSET), daily.outcomes(w, ("lockup_id", "security_id", Y)), daily.daily_prices(w), HYPOTHESIS)


pairs_of = daily.lineage_pairs


@register("n8_numeric_match", "SELECT feature, count(*) AS matched FROM featpairs WHERE (x IS NULL AND y IS NULL) OR abs(x - y) <= 1e-9 + 1e-7 * abs(x) GROUP BY 1")
def numeric_match(w):
    rows = pairs_of(w).select(F.explode("features").alias("f")).select("f.*")
    return rows.where(F.col("state").isin("match", "both_null")).groupBy("feature").agg(F.count(F.lit(1)).alias("matched"))


@register("n9_version_pairs", "SELECT lockup_id, security_id, observation_offset, CASE WHEN in1 AND in2 THEN same_obs AND same_evt END AS exact_identity_match FROM pairs")
def version_pairs(w):
    return pairs_of(w, ()).select("lockup_id", "security_id", "observation_offset", "exact_identity_match")


@register("n10_feature_parity", """
 SELECT feature, count(*) AS compared, count(*) FILTER (state = 'match') AS matched, count(*) FILTER (state NOT IN ('match','both_null')) AS mismatched, count(*) FILTER (state = 'both_null') AS both_null,
  count(*) FILTER (state = 'v1_null_v2_value') AS v1_null_v2_value, count(*) FILTER (state LIKE 'v1_value_v2_null%') AS v1_value_v2_null,
  count(*) FILTER (state = 'numeric_mismatch_complete_history') AS numeric_mismatch_complete_history,
  count(*) FILTER (state IN ('v1_value_v2_null_incomplete_history','numeric_mismatch_other')) AS incomplete_history_mismatch FROM featpairs GROUP BY 1""")
def feature_parity(w):
    return pa.feature_parity(pairs_of(w))


@register("n11_pair_class", "SELECT lockup_id, security_id, observation_offset, classification FROM classed")
def pair_class(w):
    return pairs_of(w).select("lockup_id", "security_id", "observation_offset", "classification")


@register("n12_lineage_summary", """
 SELECT count(*) AS rows_seen, count(*) FILTER (in1 AND in2) AS comparable_pairs, count(*) FILTER (same_obs AND same_evt) AS exact_identity_matches, count(*) FILTER (NOT same_obs) AS observation_date_mismatches,
  count(*) FILTER (NOT same_evt) AS event_trade_date_mismatches, count(*) FILTER (st = 'complete') AS v2_complete, count(*) FILTER (st = 'partial') AS v2_partial, count(*) FILTER (st = 'unavailable') AS v2_unavailable,
  count(*) FILTER (NOT differs) AS exact_feature_matches, count(*) FILTER (classification = 'sparse_history_feature_mismatch') AS explained_sparse_history_mismatches,
  count(*) FILTER (classification = 'numeric_feature_mismatch_complete_history') AS unexplained_complete_history_mismatches, count(*) FILTER (NOT in1) AS no_v1_snapshot, count(*) FILTER (NOT in2) AS no_v2_snapshot,
  sum(eh)::BIGINT AS expected_history_sessions, sum(mh)::BIGINT AS missing_history_sessions FROM classed""")
def lineage_summary(w):
    return pa.lineage_summary(pairs_of(w))


@register("n12_completeness_by_offset", "SELECT observation_offset, snapshot_status, count(*) AS snapshots FROM snap2 GROUP BY ALL")
def completeness(w):
    return pa.completeness_by_offset(pairs_of(w, ()))


@register("n12_mismatch_examples", """
 SELECT lockup_id, security_id, observation_offset, classification FROM classed WHERE classification <> 'exact_match'""")
def examples(w):
    return pa.mismatch_examples(pairs_of(w)).select("lockup_id", "security_id", "observation_offset", "classification")


def _discovery(w):
    features = HYPOTHESIS.feature1, HYPOTHESIS.feature2
    members = all_events(w, "security_id", "observation_date", *features, Y, offset=OFFSET)
    return pa.discovery_features(pairs_of(w, features, OFFSET), members, HYPOTHESIS)


_MEMBERS = f"""(SELECT f.*, CASE feature WHEN 'return_20d' THEN {HYPOTHESIS.feature1_threshold} ELSE {HYPOTHESIS.feature2_threshold} END AS t FROM featpairs f JOIN ds USING (lockup_id, security_id, observation_offset)
 WHERE observation_offset = -5 AND feature IN ('return_20d','realized_vol_20d') AND ds.observation_date <= DATE '2000-06-30' AND ds.return_20d IS NOT NULL AND ds.realized_vol_20d IS NOT NULL AND ds.post_20d_return IS NOT NULL)"""


@register("n13_threshold_crossings", f"""
 SELECT lockup_id, feature, round(x, 6) AS v1, round(y, 6) AS v2, CASE WHEN x <= t THEN 'low' ELSE 'high' END AS v1_side, CASE WHEN y <= t THEN 'low' ELSE 'high' END AS v2_side
 FROM {_MEMBERS} WHERE y IS NOT NULL AND (x <= t) <> (y <= t)""")
def crossings(w):
    return rounded(pa.threshold_crossings(_discovery(w)).select("lockup_id", "feature", "v1", "v2", "v1_side", "v2_side"))


@register("n13_discovery_counts", f"""
 SELECT feature, count(*) FILTER (state IN ('match','both_null')) AS matches_v1, count(*) FILTER (state = 'numeric_mismatch_complete_history') AS differs_complete_canonical_data,
  count(*) FILTER (state NOT IN ('match','both_null','numeric_mismatch_complete_history')) AS differs_missing_canonical_data, count(*) FILTER (y IS NOT NULL AND (x <= t) <> (y <= t)) AS threshold_crossings FROM {_MEMBERS} GROUP BY 1""")
def discovery_counts(w):
    return pa.discovery_feature_counts(_discovery(w))


@register("n14_cohort_limit", """
 SELECT lockup_id, count(*) AS snapshots FROM (SELECT lockup_id FROM snap1 UNION ALL SELECT lockup_id FROM snap2) WHERE lockup_id IN (
  SELECT lockup_id FROM (SELECT lockup_id, event_date FROM snap1 UNION ALL SELECT lockup_id, event_date FROM snap2) GROUP BY 1 ORDER BY min(event_date), lockup_id LIMIT 30) GROUP BY 1""")
def cohort_limit(w):
    from lockstep.operators.events import event_level_limit
    keep = ("lockup_id", "event_date", "observation_offset")
    rows = daily.snapshots_v1(w).select(*keep).unionByName(daily.snapshots_v2(w).select(*keep))
    return event_level_limit(rows, 30, order=[]).groupBy("lockup_id").agg(F.count(F.lit(1)).alias("snapshots"))


# ------------------------------------------------------------------ dataset
MFE, MAE = st.excursion_columns(Y)


def all_events(w, *columns, offset=None):
    """The dataset, or the given columns of it under its key, at one offset if that is given."""
    return daily.dataset(w, primary_lockup_only=False, columns=("lockup_id", "observation_offset", *columns) if columns else None, offset=offset)


def primary_events(w, *columns, offset=None):
    return daily.dataset(w, columns=("lockup_id", "observation_offset", *columns) if columns else None, offset=offset)


def assembled(w):
    """The assembly itself, over stored snapshots and outcomes."""
    return ds.backtest_dataset(daily.snapshots_v1(w), daily.outcomes(w), w.ipos(), w.companies(),
                               primary_lockup_only=False)


_NUM = ("close", "return_20d", "realized_vol_20d", "avg_volume_20d", "post_20d_return", "bearish_mfe_20d", "event_volume_ratio")


@register("o1_dataset", f"""
 SELECT ipo_id, lockup_id, security_id, company_name, ticker, observation_offset, event_status, event_trade_date, {', '.join(f'round({c}, 6) AS {c}' for c in _NUM)},
  shares_outstanding_post_ipo, lockup_expiration_date, outcome_version FROM ds""")
def dataset(w):
    return rounded(assembled(w).select("ipo_id", "lockup_id", "security_id", "company_name", "ticker", "observation_offset", "event_status",
                                        "event_trade_date", *_NUM, "shares_outstanding_post_ipo", "lockup_expiration_date", "outcome_version"))


@register("o2_first_row", "SELECT lockup_id, observation_offset, min(security_id) AS security_id FROM ds GROUP BY 1, 2")
def first_row(w):
    return assembled(w).select("lockup_id", "observation_offset", "security_id")


@register("o3_column_families", """
 SELECT observation_offset, count(*) AS rows, 77 AS columns, count(close) AS with_close, count(realized_vol_20d) AS with_volatility, count(ipo_price) AS with_price,
  count(post_20d_return) AS with_outcome, count(bearish_mfe_20d) AS with_excursion FROM ds WHERE is_primary_event GROUP BY 1""")
def families(w):
    """Per offset the values that a column of each family has."""
    held = {"with_close": "close", "with_volatility": "realized_vol_20d", "with_price": "ipo_price", "with_outcome": "post_20d_return",
            "with_excursion": "bearish_mfe_20d"}
    rows = primary_events(w, *held.values())
    return rows.groupBy("observation_offset").agg(F.count(F.lit(1)).alias("rows"), F.lit(len(ds.CSV_COLUMNS)).alias("columns"),
                                                  *[F.count(column).alias(name) for name, column in held.items()])


@register("o4_event_identity", "SELECT lockup_id, observation_offset, event_date, event_trade_date, event_date_source, data_cutoff_date FROM ds")
def identity(w):
    return assembled(w).select("lockup_id", "observation_offset", "event_date", "event_trade_date", "event_date_source", "data_cutoff_date")


@register("o5_availability", """
 SELECT lockup_id, observation_offset, ipo_price IS NOT NULL AS has_ipo_price, available_history_sessions >= 21 AS has_20d_history, available_history_sessions >= 41 AS has_40d_history,
  post_5d_return IS NOT NULL AS has_post_5d, post_10d_return IS NOT NULL AS has_post_10d, post_20d_return IS NOT NULL AS has_post_20d, post_40d_return IS NOT NULL AS has_post_40d FROM ds""")
def availability(w):
    return assembled(w).select("lockup_id", "observation_offset", *ds.AVAILABILITY)


@register("a9_backtest_csv_rows", """
 SELECT lockup_id, observation_offset, observation_date, round(close, 6) AS close, round(post_20d_return, 6) AS post_20d_return FROM ds WHERE is_primary_event""")
def csv_rows(w):
    rows = primary_events(w).select(*ds.CSV_COLUMNS)
    return rounded(rows.select("lockup_id", "observation_offset", "observation_date", "close", "post_20d_return"))


@register("a10_parity_csv_rows", """
 SELECT lockup_id, observation_offset, expected - have AS missing_sessions, CASE WHEN expected = have THEN 2 ELSE (expected - have) * 13 + 1 END::BIGINT AS json_chars, expected = have AS empty FROM sessp""")
def parity_csv(w):
    """Every row's array as JSON text: brackets, and eleven or twelve characters and a comma for each date."""
    from lockstep.sources.tables import flat_report
    rows = session_audit(w).select("lockup_id", "observation_offset", F.col("missing_expected_session_count").cast("long").alias("missing_sessions"),
                                   F.col("missing_expected_sessions").alias("missing"))
    text = F.col("missing")
    return flat_report(rows).select("lockup_id", "observation_offset", "missing_sessions", F.length(text).cast("long").alias("json_chars"), (text == "[]").alias("empty"))


@register("a11_json_report", """
 SELECT '{"status":"' || event_status || '","events":' || n || ',"first":"' || d || '"}' AS value FROM (SELECT event_status, count(*) AS n, min(event_date) AS d FROM outc GROUP BY 1)""")
def json_rows(w):
    from lockstep.sources.tables import json_report
    rows = daily.outcomes(w).groupBy(F.col("event_status").alias("status")).agg(
        F.count(F.lit(1)).alias("events"), F.min("event_date").alias("first"))
    return json_report(rows)


# ------------------------------------------------------------------ statistics
_VALID = f"(SELECT *, {F1} AS x, {Y} AS y FROM ds WHERE {F1} IS NOT NULL AND {Y} IS NOT NULL)"
_RANKED = f"""(SELECT *, rank() OVER (PARTITION BY observation_offset ORDER BY x) + (count(*) OVER (PARTITION BY observation_offset, x) - 1) / 2 AS rx,
  rank() OVER (PARTITION BY observation_offset ORDER BY y) + (count(*) OVER (PARTITION BY observation_offset, y) - 1) / 2 AS ry FROM {_VALID})"""
_STATS = """round(avg(y), 6) AS mean_outcome, round(median(y), 6) AS median_outcome, count(*) FILTER (y < 0) AS bearish_hit_count, round(count(*) FILTER (y < 0) / nullif(count(y), 0), 6) AS bearish_hit_rate,
 count(*) FILTER (y <= -.05) AS le_5pct_count, round(count(*) FILTER (y <= -.05) / nullif(count(y), 0), 6) AS le_5pct_rate, count(*) FILTER (y <= -.10) AS le_10pct_count, round(count(*) FILTER (y <= -.10) / nullif(count(y), 0), 6) AS le_10pct_rate,
 count(*) FILTER (y <= -.20) AS le_20pct_count, round(count(*) FILTER (y <= -.20) / nullif(count(y), 0), 6) AS le_20pct_rate"""
_MF = "round(median(bearish_mfe_20d), 6) AS median_bearish_mfe, round(median(bearish_mae_20d), 6) AS median_bearish_mae"


@register("p1_average_ranks", f"SELECT lockup_id, observation_offset, rx FROM {_RANKED}")
def ranks(w):
    from lockstep.functions.order_stats import average_ranks
    valid = all_events(w, F1, Y).where(F.col(F1).isNotNull() & F.col(Y).isNotNull()).select("lockup_id", "observation_offset", F1)
    return average_ranks(valid, ["observation_offset"], F1, "rx").drop(F1)


@register("p2_spearman", f"SELECT observation_offset, count(*) AS n, round(corr(rx, ry), 6) AS spearman_rho FROM {_RANKED} GROUP BY 1")
def rho(w):
    return rounded(st.spearman(all_events(w, F1, Y), ["observation_offset"], F1, Y).drop("p_value"))


# Complementary error function: series below 2, continued fraction above.
_ERFC = """CASE WHEN u < 2 THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 31), lambda k: power(-1, k) * power(u, 2 * k + 1) / (factorial(k::INTEGER)::DOUBLE * (2 * k + 1))))
 ELSE exp(-u * u) / (u * sqrt(pi())) / list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(0, 60), lambda k: (60 - k)::DOUBLE)), lambda f, k: 1 + k / (2 * u * u) / f) END"""


@register("p3_spearman_p_value", f"""
 SELECT observation_offset, n, round(spearman_rho, 6) AS spearman_rho, round(CASE WHEN abs(spearman_rho) >= 1 - 1e-12 THEN 0 ELSE {_ERFC} END, 6) AS p_value FROM (
 SELECT *, abs(spearman_rho) * sqrt((n - 2) / greatest(1e-15, 1 - spearman_rho * spearman_rho)) / sqrt(2) AS u FROM (
 SELECT observation_offset, count(*) AS n, corr(rx, ry) AS spearman_rho FROM {_RANKED} GROUP BY 1))""")
def p_value(w):
    return rounded(st.spearman(all_events(w, F1, Y), ["observation_offset"], F1, Y))


@register("p4_outcome_stats", f"SELECT observation_offset, {_STATS} FROM {_VALID} GROUP BY 1")
def outcome_stats(w):
    valid = all_events(w, F1, Y).where(F.col(F1).isNotNull() & F.col(Y).isNotNull())
    from lockstep.functions.order_stats import medians
    rows = valid.groupBy("observation_offset").agg(*st.outcome_stats(Y)).join(
        medians(valid, ["observation_offset"], {Y: "median_outcome"}), "observation_offset")
    return rounded(rows)


@register("p5_group_summary", f"SELECT event_date_source, count(DISTINCT lockup_id) AS n_events, count(*) AS n_observations, round(median(x), 6) AS median_feature, {_STATS}, {_MF} FROM {_VALID} GROUP BY 1")
def group_summary(w):
    valid = all_events(w, F1, Y, MFE, MAE, "event_date_source").where(F.col(F1).isNotNull() & F.col(Y).isNotNull())
    return rounded(st.group_summary(valid, ["event_date_source"], {F1: "median_feature"}, Y))


@register("p6_median_split", f"""
 SELECT observation_offset, CASE WHEN x <= m THEN 'feature_lte_median' ELSE 'feature_gt_median' END AS half, count(DISTINCT lockup_id) AS n_events, count(*) AS n_observations, round(median(x), 6) AS median_feature, {_STATS}, {_MF}
 FROM {_VALID} JOIN (SELECT observation_offset, median(x) AS m FROM {_VALID} GROUP BY 1) USING (observation_offset) GROUP BY 1, 2""")
def split(w):
    return rounded(st.median_split(all_events(w, F1, Y, MFE, MAE), F1, Y))


@register("p7_feature_analysis", f"""
 SELECT observation_offset, count(DISTINCT lockup_id) AS n_events, count(*) AS n_observations, {_STATS}, round(median(x), 6) AS feature_median, {_MF}, round(avg(x), 6) AS feature_mean, count(*) AS n,
  round(corr(rx, ry), 6) AS spearman_rho FROM {_RANKED} GROUP BY 1""")
def analysis(w):
    return rounded(st.feature_analysis(all_events(w, F1, Y, MFE, MAE), F1, Y).drop("p_value"))


@register("p8_complete_cases", f"""
 SELECT count(*) AS n_input_rows, count(*) FILTER ({F1} IS NOT NULL AND {F2} IS NOT NULL AND {Y} IS NOT NULL) AS n_valid_rows,
  count(*) FILTER ({F1} IS NULL OR {F2} IS NULL OR {Y} IS NULL) AS n_excluded_missing FROM ds WHERE observation_offset = -5""")
def cases(w):
    return st.selection_counts(all_events(w, F1, F2, Y, offset=OFFSET), F1, F2, Y, OFFSET)


_CASES = f"(SELECT *, {F1} AS x1, {F2} AS x2, {Y} AS y FROM ds WHERE observation_offset = -5 AND {F1} IS NOT NULL AND {F2} IS NOT NULL AND {Y} IS NOT NULL)"
_PRIMARY = _CASES.replace("WHERE observation_offset", "WHERE is_primary_event AND observation_offset")


CELLS_SQL = f"""
 SELECT g AS cell, count(DISTINCT lockup_id) AS n_events, count(lockup_id) AS n_observations, round(median(x1), 6) AS feature1_median, round(median(x2), 6) AS feature2_median, {_STATS}, {_MF}
 FROM (SELECT unnest(['low_low','low_high','high_low','high_high']) AS g) LEFT JOIN (
  SELECT *, CASE WHEN x1 <= m1 THEN 'low' ELSE 'high' END || '_' || CASE WHEN x2 <= m2 THEN 'low' ELSE 'high' END AS c FROM {_CASES}, (SELECT median(x1) AS m1, median(x2) AS m2 FROM {_CASES})) ON c = g GROUP BY 1"""


@register("p9_interaction_cells", CELLS_SQL)
def cells(w):
    return rounded(st.interaction_cells(all_events(w, F1, F2, Y, MFE, MAE, offset=OFFSET), F1, F2, Y, OFFSET))


_FIT = """(SELECT *, my - b1*m1 - b2*m2 AS b0 FROM (SELECT *, (s1y*s22 - s2y*s12)/det AS b1, (s2y*s11 - s1y*s12)/det AS b2 FROM (SELECT *, s11*s22 - s12*s12 AS det FROM (
 SELECT {key} count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS s11, var_pop(x2) AS s22, var_pop(y) AS syy, covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y FROM {rows} {group}))))"""


OLS_SQL = f"""
 SELECT -5 AS observation_offset, n, 'ok' AS status, round(b0, 6) AS intercept, round(b1, 6) AS feature1_coefficient, round(b2, 6) AS feature2_coefficient, CASE WHEN b1 > 0 THEN 'positive' ELSE 'negative' END AS feature1_coefficient_sign,
  CASE WHEN b2 > 0 THEN 'positive' ELSE 'negative' END AS feature2_coefficient_sign, round((b1*s1y + b2*s2y)/syy, 6) AS r_squared, round(b1*sqrt(s11/syy), 6) AS standardized_beta_feature1,
  round(b2*sqrt(s22/syy), 6) AS standardized_beta_feature2 FROM {_FIT.format(key='', rows=_CASES, group='')}"""


@register("p10_ols", OLS_SQL)
def ols(w):
    rows = st.complete_cases(all_events(w, F1, F2, Y, offset=OFFSET), F1, F2, Y, OFFSET)
    return rounded(st.ols(rows, F1, F2, Y).select("observation_offset", *st.FIT_COLUMNS))


_LOO = f"(SELECT a.lockup_id AS k, b.* FROM {_PRIMARY} a JOIN {_PRIMARY} b ON a.lockup_id <> b.lockup_id)"
_LOOFIT = _FIT.format(key="k,", rows=_LOO, group="GROUP BY k")


def _primary_cases(w):
    return st.complete_cases(primary_events(w, F1, F2, Y, MFE, MAE, offset=OFFSET), F1, F2, Y, OFFSET)


@register("p11_leave_one_out_fits", f"""
 SELECT -5 AS observation_offset, k AS excluded_lockup_id, n, 'ok' AS status, round(b0, 6) AS intercept, round(b1, 6) AS feature1_coefficient, round(b2, 6) AS feature2_coefficient, round((b1*s1y + b2*s2y)/syy, 6) AS r_squared,
  round(b1*sqrt(s11/syy), 6) AS standardized_beta_feature1, round(b2*sqrt(s22/syy), 6) AS standardized_beta_feature2 FROM {_LOOFIT}""")
def loo_fits(w):
    return rounded(st.leave_one_out_fits(_primary_cases(w), F1, F2, Y))


_WITHOUT = f"""(SELECT k, n, t1/n AS m1, t2/n AS m2, ty/n AS my, t11/n - t1*t1/n/n AS s11, t22/n - t2*t2/n/n AS s22, tyy/n - ty*ty/n/n AS syy, t12/n - t1*t2/n/n AS s12, t1y/n - t1*ty/n/n AS s1y, t2y/n - t2*ty/n/n AS s2y FROM (
 SELECT lockup_id AS k, cnt - 1 AS n, a1 - c1 AS t1, a2 - c2 AS t2, ay - cy AS ty, a11 - c1*c1 AS t11, a22 - c2*c2 AS t22, ayy - cy*cy AS tyy, a12 - c1*c2 AS t12, a1y - c1*cy AS t1y, a2y - c2*cy AS t2y FROM (
 SELECT c.*, x1 - g1 AS c1, x2 - g2 AS c2, y - gy AS cy, cnt, a1, a2, ay, a11, a22, ayy, a12, a1y, a2y, g1, g2, gy FROM {_CASES} c, (
  SELECT count(*) AS cnt, sum(x1-g1) AS a1, sum(x2-g2) AS a2, sum(y-gy) AS ay, sum((x1-g1)*(x1-g1)) AS a11, sum((x2-g2)*(x2-g2)) AS a22, sum((y-gy)*(y-gy)) AS ayy, sum((x1-g1)*(x2-g2)) AS a12, sum((x1-g1)*(y-gy)) AS a1y,
   sum((x2-g2)*(y-gy)) AS a2y, any_value(g1) AS g1, any_value(g2) AS g2, any_value(gy) AS gy FROM {_CASES}, (SELECT avg(x1) AS g1, avg(x2) AS g2, avg(y) AS gy FROM {_CASES})))))"""


@register("p11_leave_one_out_all", f"""
 SELECT k AS excluded_lockup_id, n, round(b1, 6) AS feature1_coefficient, round(b2, 6) AS feature2_coefficient, round((b1*s1y + b2*s2y)/syy, 6) AS r_squared FROM (
 SELECT *, (s1y*s22 - s2y*s12)/(s11*s22 - s12*s12) AS b1, (s2y*s11 - s1y*s12)/(s11*s22 - s12*s12) AS b2 FROM {_WITHOUT})""")
def loo_fits_all(w):
    """All events, not only the primary ones; the SQL takes each event out of the centred sums."""
    rows = st.complete_cases(all_events(w, F1, F2, Y, offset=OFFSET), F1, F2, Y, OFFSET)
    return rounded(st.leave_one_out_fits(rows, F1, F2, Y).select(
        "excluded_lockup_id", "n", "feature1_coefficient", "feature2_coefficient", "r_squared"))


_LOOCELL = f"""(SELECT a.k, count(y) AS n, count(*) FILTER (y < 0) / nullif(count(y), 0) AS hit, avg(y) AS mean, median(y) AS med, count(*) FILTER (y <= -.05) / nullif(count(y), 0) AS r5,
  count(*) FILTER (y <= -.10) / nullif(count(y), 0) AS r10, count(*) FILTER (y <= -.20) / nullif(count(y), 0) AS r20, median(bearish_mfe_20d) AS mfe, median(bearish_mae_20d) AS mae
 FROM (SELECT k, median(x1) AS m1, median(x2) AS m2 FROM {_LOO} GROUP BY 1) a LEFT JOIN {_LOO} b ON b.k = a.k AND x1 > m1 AND x2 > m2 GROUP BY 1)"""


@register("p12_leave_one_out_cell", f"""
 SELECT -5 AS observation_offset, k AS excluded_lockup_id, n AS n_high_high, round(hit, 6) AS bearish_hit_rate, round(mean, 6) AS mean_outcome, round(med, 6) AS median_outcome, round(r5, 6) AS le_5pct_rate, round(r10, 6) AS le_10pct_rate,
  round(r20, 6) AS le_20pct_rate, round(mfe, 6) AS median_bearish_mfe, round(mae, 6) AS median_bearish_mae FROM {_LOOCELL}""")
def loo_cell(w):
    return rounded(st.leave_one_out_cell(_primary_cases(w), F1, F2, Y))


def _runs(w):
    rows = _primary_cases(w)
    runs = stored(w.spark, w.path, "leave_one_out", lambda: st.leave_one_out(rows, F1, F2, Y))
    return runs, st.ols(rows, F1, F2, Y)


_RUN = {"feature1_coefficient": "b1", "feature2_coefficient": "b2", "standardized_beta_feature1": "b1*sqrt(s11/syy)",
        "standardized_beta_feature2": "b2*sqrt(s22/syy)", "r_squared": "(b1*s1y + b2*s2y)/syy"}
_CELL = {"n_high_high": "n", "bearish_hit_rate": "hit", "mean_outcome": "mean", "median_outcome": "med", "le_20pct_rate": "r20",
         "median_bearish_mfe": "mfe", "median_bearish_mae": "mae"}
_FULL = _FIT.format(key="", rows=_PRIMARY, group="")
_RANGES = " UNION ALL ".join(
    [f"SELECT '{f}' AS field, {e}::DOUBLE AS v, (SELECT {e} FROM {_FULL}) AS ref FROM {_LOOFIT}" for f, e in _RUN.items()]
    + [f"SELECT '{f}', {e}::DOUBLE, NULL FROM {_LOOCELL} WHERE n > 0" for f, e in _CELL.items()])


RANGES_SQL = f"""
 SELECT -5 AS observation_offset, field, round(max(ref), 6) AS full_sample_value, round(min(v), 6) AS min, round(max(v), 6) AS max, round(median(v), 6) AS median, round(avg(v), 6) AS mean,
  CASE WHEN field IN ('feature1_coefficient','feature2_coefficient') THEN count(*) FILTER (sign(v) <> sign(ref)) END AS sign_flip_count FROM ({_RANGES}) GROUP BY field"""


@register("p13_run_ranges", RANGES_SQL)
def ranges(w):
    return rounded(st.run_ranges(*_runs(w)))


FLAGS_SQL = f"""
 SELECT -5 AS observation_offset, count(*) AS total_runs, count(*) AS successful_runs, 0::BIGINT AS failed_runs, count(*) FILTER (c.n = 0) AS empty_high_high_runs, count(*) FILTER (sign(f.b1) <> sign(g.b1)) = 0 AS feature1_sign_stable,
  count(*) FILTER (sign(f.b2) <> sign(g.b2)) = 0 AS feature2_sign_stable, bool_and(coalesce(med < 0, FALSE)) AS high_high_median_outcome_always_negative, round(min(hit), 6) AS high_high_bearish_hit_rate_min
 FROM {_LOOFIT} f JOIN {_LOOCELL} c ON c.k = f.k, {_FULL} g"""


@register("p13_robustness_flags", FLAGS_SQL)
def flags(w):
    return rounded(st.robustness_flags(*_runs(w)))


_SCORED = f"""(SELECT lockup_id, y AS actual_outcome, p AS predicted_outcome, y - p AS residual, h AS leverage, (y-p)/sqrt(mse*(1-h)) AS standardized_residual, (y-p)*(y-p)/(3*mse)*h/((1-h)*(1-h)) AS cooks_distance FROM (
 SELECT *, sum((y-p)*(y-p)) OVER () / (n-3) AS mse FROM (SELECT r.lockup_id, r.y, f.n, b0 + b1*x1 + b2*x2 AS p, 1/f.n + (s22*(x1-m1)*(x1-m1) - 2*s12*(x1-m1)*(x2-m2) + s11*(x2-m2)*(x2-m2))/(det*f.n) AS h
  FROM {_CASES} r, {_FIT.format(key='', rows=_CASES, group='')} f)))"""
_INFL = ("actual_outcome", "predicted_outcome", "residual", "leverage", "standardized_residual", "cooks_distance")


@register("p14_influence", f"SELECT lockup_id, {', '.join(f'round({c}, 6) AS {c}' for c in _INFL)} FROM {_SCORED}")
def influence(w):
    rows = st.complete_cases(all_events(w, F1, F2, Y, "ticker", offset=OFFSET), F1, F2, Y, OFFSET)
    return rounded(st.influence(rows, F1, F2, Y).select("lockup_id", *_INFL))


@register("p14_top_influence", f"SELECT lockup_id, round(cooks_distance, 6) AS cooks_distance FROM {_SCORED} ORDER BY cooks_distance DESC, lockup_id LIMIT 5")
def top(w):
    rows = st.complete_cases(all_events(w, F1, F2, Y, "ticker", offset=OFFSET), F1, F2, Y, OFFSET)
    return rounded(st.top_influence(st.influence(rows, F1, F2, Y)).select("lockup_id", "cooks_distance"))


@register("p15_frozen_lookup", f"""
 SELECT CASE n WHEN 0 THEN '{HYPOTHESIS.hypothesis_id}' END AS hypothesis_id, n AS analysis, count(*) AS events FROM {_CASES}, (SELECT unnest([0, 1]) AS n) GROUP BY ALL""")
def lookup(w):
    """Two analyses of the same offset: the registered one, and one with its features the other way round."""
    other = dataclasses.replace(HYPOTHESIS, hypothesis_id="other outcome", outcome="bearish_mfe_20d")
    rows = st.complete_cases(all_events(w, F1, F2, Y, offset=OFFSET), F1, F2, Y, OFFSET)
    analyses = F.array(*(F.struct(F.lit(n).alias("analysis"), F.lit(a).alias("feature1"), F.lit(b).alias("feature2"), F.lit(Y).alias("outcome"))
                         for n, (a, b) in enumerate(((F1, F2), (F2, F1)))))
    named = st.with_hypothesis(rows.select("lockup_id", "observation_offset", F.explode(analyses).alias("a")).select("lockup_id", "observation_offset", "a.*"),
                               (HYPOTHESIS, other))
    return named.groupBy("hypothesis_id", "analysis").agg(F.count(F.lit(1)).alias("events"))


@register("p16_persistence", """
 SELECT lockup_id, CASE WHEN greatest(a,b,c,d) < 0 THEN 'persistent_negative' WHEN least(a,b,c,d) > 0 THEN 'persistent_positive' WHEN d > 0 AND least(a,b,c) < 0 THEN 'negative_then_reversed'
  WHEN d < 0 AND greatest(a,b,c) > 0 THEN 'positive_then_reversed' ELSE 'mixed' END AS category FROM (
 SELECT lockup_id, max(return_20d) FILTER (observation_offset = -20) AS a, max(return_20d) FILTER (observation_offset = -10) AS b, max(return_20d) FILTER (observation_offset = -5) AS c,
  max(return_20d) FILTER (observation_offset = -1) AS d FROM ds GROUP BY 1) WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND d IS NOT NULL""")
def persistence(w):
    return st.signal_persistence(all_events(w), F1)
