"""Prospective-signal, projection and options queries."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lockstep.catalog import register, research
from lockstep.catalog.coverage import audit
from lockstep.catalog.research import HYPOTHESIS
from lockstep.constants import SHADOW, STRICT
from lockstep.functions.numeric import rounded
from lockstep.operators import events as ev
from lockstep.operators import options as op
from lockstep.operators import projections as pj
from lockstep.operators import prospective as pr
from lockstep.operators import statistics as st
from lockstep.plans import daily
from lockstep.plans import signal_log as lg
from lockstep.plans.stored import table_folder
from lockstep.verification import CTES, MATERIALIZED

AS_OF = dt.date(2001, 6, 29)
NOW = dt.datetime(2000, 6, 30, 22, 0, tzinfo=dt.timezone.utc)
# When the stored signals were taken over.
EARLIER = dt.datetime(2000, 1, 1, tzinfo=dt.timezone.utc)
# Shadow signals are locked shortly after the cutoff.
SHADOW_AS_OF = dt.date(2000, 6, 30)
_CUT = "DATE '2000-06-30'"

CTES["sig"] = """
 SELECT lockup_id AS signal_id, lockup_id, ipo_id, ipo_id AS security_id, event_date, event_date AS event_trade_date, event_date - 7 AS observation_date, ['strict_prospective','prospective','shadow_prospective','lifecycle_tracking'][m + 1] AS evaluation_mode,
  (lockup_id % 100) / 1000.0::DOUBLE AS feature1_value, (lockup_id % 200) / 100.0::DOUBLE AS feature2_value, ['low_low','low_high','high_low','high_high'][lockup_id // 20 % 4 + 1] AS interaction_group,
  CASE WHEN m = 3 THEN 'unavailable' WHEN lockup_id % 10 = 0 THEN 'matured' ELSE 'awaiting_event' END AS signal_status, CASE WHEN lockup_id % 10 = 0 AND m <> 3 THEN (lockup_id % 41 - 20) / 100.0 END::DOUBLE AS y,
  CASE WHEN lockup_id % 10 = 0 AND m <> 3 THEN (lockup_id % 13) / 100.0 END::DOUBLE AS mfe, CASE WHEN lockup_id % 10 = 0 AND m <> 3 THEN (lockup_id % 17) / 100.0 END::DOUBLE AS mae
 FROM (SELECT *, lockup_id // 5 % 4 AS m FROM lock WHERE event_date IS NOT NULL)
"""
_CAND = """(SELECT lock.lockup_id, lock.ipo_id, company_id, ticker, lock.event_date FROM lock JOIN ipo USING (ipo_id) JOIN comp USING (company_id)
 WHERE classification_status = 'classified' AND candidate_type = 'operating_company_ipo' AND offering_status = 'priced')"""


def _decision_sql(modes, steps, values, as_of):
    return f"""
 SELECT *, CASE WHEN event_date IS NULL THEN 'no_event_date' WHEN sid IS NOT NULL THEN 'existing' {steps} ELSE 'create' END AS action FROM (
 SELECT c.*, es.session AS evt, os.session AS cobs, s.signal_id AS sid, s.observation_date AS sobs, s.security_id AS ssec, s.y AS sy, v.observation_date AS vobs, v.snapshot_status AS vst, p.security_id, l.lockup_id IS NOT NULL AS life,
  {values}, DATE '{as_of}' AS today
 FROM {_CAND} c LEFT JOIN cal ON day = c.event_date LEFT JOIN ses es ON es.ix = next_ix LEFT JOIN ses os ON os.ix = next_ix - 5
 LEFT JOIN (SELECT lockup_id, arg_min(sig, signal_id) AS z, unnest(z) FROM sig WHERE evaluation_mode IN ({modes}) GROUP BY 1) s ON s.lockup_id = c.lockup_id
 LEFT JOIN (SELECT DISTINCT lockup_id FROM sig WHERE evaluation_mode = 'lifecycle_tracking') l ON l.lockup_id = c.lockup_id
 LEFT JOIN (SELECT * FROM snap2 WHERE observation_offset = -5) v ON v.lockup_id = c.lockup_id LEFT JOIN prim p ON p.company_id = c.company_id
 LEFT JOIN win2 w ON w.security_id = p.security_id AND w.ix = next_ix - 5)"""


CTES["dstrict"] = _decision_sql("'strict_prospective','prospective'", f"""
 WHEN coalesce(vobs, cobs) <= {_CUT} THEN CASE WHEN evt > {_CUT} THEN 'lifecycle_unavailable' ELSE 'not_eligible' END WHEN coalesce(vobs, cobs) > today THEN 'pending_observation'
 WHEN security_id IS NULL OR vst IS DISTINCT FROM 'complete' OR v1 IS NULL OR v2 IS NULL THEN 'waiting_for_market_data'""",
                                "v.return_20d AS v1, v.realized_vol_20d AS v2", "2001-06-29")
CTES["dshadow"] = _decision_sql("'shadow_prospective'", f"""
 WHEN NOT (cobs <= {_CUT} AND {_CUT} < evt) THEN 'not_eligible' WHEN today >= evt THEN 'missed_lock_window' WHEN security_id IS NULL OR t5 IS NULL THEN 'missing_t5_market_data'
 WHEN present_21 < 21 OR v1 IS NULL OR v2 IS NULL THEN 'incomplete_feature_window' WHEN DATE '2000-06-30' >= evt THEN 'missed_lock_window'""",
                                "w.close AS t5, w.present_21, CASE WHEN w.c20 THEN r20 END AS v1, CASE WHEN w.c20 THEN sd20 END AS v2", "2000-06-30")
CTES["dnext"] = """
 SELECT d.*, o.post_20d_return AS oy, o.outcome_20_date, o.as_of_date, CASE WHEN action NOT IN ('create','existing') THEN NULL WHEN sy IS NOT NULL THEN 'already_matured' WHEN today < evt THEN 'awaiting_event'
  WHEN o.post_20d_return IS NULL THEN 'awaiting_outcome' ELSE 'matured' END AS nxt FROM dstrict d LEFT JOIN outc o ON o.lockup_id = d.lockup_id AND o.security_id = coalesce(d.ssec, d.security_id)
"""
MATERIALIZED.update({"sig", "dstrict", "dshadow", "dnext"})


def decisions(w, mode=STRICT, signals=None):
    cohort = pr.candidate_events(w.lockups(), w.ipos(), w.companies(), primary_lockup_only=False)
    snapshots = daily.snapshots_v2(w, ("lockup_id", "security_id", "observation_offset", "observation_date", "snapshot_status",
                                       HYPOTHESIS.feature1, HYPOTHESIS.feature2), HYPOTHESIS.observation_offset)
    outcomes = daily.outcomes(w, ("lockup_id", "security_id", HYPOTHESIS.outcome, "bearish_mfe_20d", "bearish_mae_20d",
                                  "event_trade_date", "as_of_date", "outcome_20_date"))
    return pr.decide(cohort, w.signals(HYPOTHESIS) if signals is None else signals, snapshots, outcomes, daily.bars(w),
                     ev.primary_security(w.securities()), mode=mode, hypothesis=HYPOTHESIS,
                     as_of=AS_OF if mode == STRICT else SHADOW_AS_OF, now_utc=NOW)


@register("q1_candidate_events", f"SELECT lockup_id, ipo_id, ticker, event_date FROM {_CAND}")
def candidates(w):
    return pr.candidate_events(w.lockups(), w.ipos(), w.companies(), primary_lockup_only=False).drop("company_id")


@register("q2_existing_signal", "SELECT lockup_id, min(signal_id) AS existing_signal_id FROM sig WHERE evaluation_mode IN ('strict_prospective','prospective') GROUP BY 1")
def existing(w):
    from lockstep.operators.prospective import first_signal, persisted_modes
    return first_signal(w.signals(HYPOTHESIS), HYPOTHESIS, persisted_modes(STRICT)).select("lockup_id", "existing_signal_id")


@register("q3_observation_identity", "SELECT lockup_id, coalesce(sobs, vobs, cobs) AS observation_date, coalesce(vobs <> cobs, FALSE) AS calendar_mismatch FROM dstrict")
def identity(w):
    return decisions(w).select("lockup_id", "observation_date", "calendar_mismatch")


@register("q4_strict_actions", "SELECT lockup_id, action FROM dstrict")
def strict_actions(w):
    return decisions(w).select("lockup_id", "action")


@register("q5_shadow_actions", "SELECT lockup_id, action FROM dshadow")
def shadow_actions(w):
    return decisions(w, SHADOW).select("lockup_id", "action")


@register("q6_lifecycle_rows", "SELECT lockup_id, coalesce(vobs, cobs) AS observation_date, 'unavailable' AS signal_status FROM dstrict WHERE action = 'lifecycle_unavailable' AND NOT life")
def lifecycle(w):
    return pr.lifecycle_rows(decisions(w), HYPOTHESIS, NOW).select("lockup_id", "observation_date", "signal_status")


@register("q7_waiting_states", "SELECT action, count(*) AS n FROM dstrict GROUP BY 1")
def waiting(w):
    return decisions(w).groupBy("action").agg(F.count(F.lit(1)).alias("n"))


_SIDES = f"CASE WHEN v1 <= {HYPOTHESIS.feature1_threshold} THEN 'low' ELSE 'high' END || '_' || CASE WHEN v2 <= {HYPOTHESIS.feature2_threshold} THEN 'low' ELSE 'high' END"


@register("q8_strict_features", "SELECT lockup_id, round(v1, 6) AS feature1_value, round(v2, 6) AS feature2_value FROM dstrict WHERE action = 'create'")
def strict_features(w):
    return rounded(decisions(w).where("action = 'create'").select("lockup_id", "feature1_value", "feature2_value"))


@register("q9_shadow_features", "SELECT lockup_id, round(round(v1, 10), 6) AS feature1_value, round(round(v2, 10), 6) AS feature2_value FROM dshadow WHERE action = 'create'")
def shadow_features(w):
    return rounded(decisions(w, SHADOW).where("action = 'create'").select("lockup_id", "feature1_value", "feature2_value"))


@register("q10_threshold_groups", f"SELECT {_SIDES} AS interaction_group, count(*) AS n FROM dshadow WHERE action = 'create' GROUP BY 1")
def groups(w):
    return pr.preview(decisions(w, SHADOW)).groupBy("interaction_group").agg(F.count(F.lit(1)).alias("n"))


@register("q11_immutable_insert", f"SELECT lockup_id, security_id, cobs AS observation_date, {_SIDES} AS interaction_group, 'signal_created' AS signal_status FROM dshadow WHERE action = 'create'")
def insert(w):
    return pr.new_signals(decisions(w, SHADOW), HYPOTHESIS, NOW).select(
        "lockup_id", "security_id", "observation_date", "interaction_group", "signal_status")


@register("q12_status_advance", "SELECT lockup_id, nxt AS next_status FROM dnext")
def status_advance(w):
    return decisions(w).select("lockup_id", "next_status")


_CHANGE = "nxt = 'matured' OR (nxt IN ('awaiting_event','awaiting_outcome') AND nxt IS DISTINCT FROM s.signal_status)"
_ADVANCED = f"""
 SELECT s.lockup_id, s.evaluation_mode, coalesce(d.nxt, s.signal_status) AS signal_status, round(coalesce(s.y, CASE WHEN d.nxt = 'matured' THEN d.oy END), 6) AS realized_outcome_value, coalesce(({_CHANGE})::INT, 0)::BIGINT AS n_changes
 FROM sig s LEFT JOIN (SELECT * FROM dnext WHERE nxt IN ('awaiting_event','awaiting_outcome','matured')) d ON d.sid = s.signal_id
 UNION ALL SELECT lockup_id, 'strict_prospective', nxt, round(CASE WHEN nxt = 'matured' THEN oy END, 6), 1 FROM dnext WHERE action = 'create'
 UNION ALL SELECT lockup_id, 'lifecycle_tracking', 'unavailable', NULL, 0 FROM dstrict WHERE action = 'lifecycle_unavailable' AND NOT life"""


@register("q13_outcome_attach", f"SELECT lockup_id, evaluation_mode, signal_status, realized_outcome_value FROM ({_ADVANCED})")
def attach(w):
    rows = pr.advance_signals(w.signals(HYPOTHESIS), decisions(w), HYPOTHESIS, NOW)
    return rounded(rows.select("lockup_id", "evaluation_mode", "signal_status", "realized_outcome_value"))


@register("q13_signal_log", _ADVANCED)
def signal_log(w):
    """The same advance on disk: stored signals are the first run, this one appends what it changes."""
    root = table_folder(w.spark, w.path, "signal_log")
    lg.publish(w.spark, root, lg.run_name(EARLIER), w.signals(HYPOTHESIS))
    run = lg.run_name(NOW)
    before = lg.read_signals(w.spark, root, before=run)
    lg.append_decisions(w.spark, root, decisions(w, signals=before), HYPOTHESIS, NOW)
    changes = lg.read_changes(w.spark, root, run).groupBy("signal_id").agg(F.count(F.lit(1)).alias("n_changes"))
    rows = lg.read_signals(w.spark, root).join(changes, "signal_id", "left")
    return rounded(rows.select("lockup_id", "evaluation_mode", "signal_status", "realized_outcome_value",
                               F.coalesce("n_changes", F.lit(0)).alias("n_changes")))


@register("q14_outcome_date", "SELECT lockup_id, coalesce(outcome_20_date, as_of_date) AS outcome_date FROM dnext WHERE nxt = 'matured'")
def outcome_date(w):
    return decisions(w).where("next_status = 'matured'").select("lockup_id", "outcome_date")


@register("q15_dry_run_report", """
 SELECT count(DISTINCT ipo_id) AS ipos_seen, count(*) AS lockups_seen, 0::BIGINT AS errors, count(*) FILTER (action NOT IN ('no_event_date','lifecycle_unavailable','not_eligible')) AS eligible_events,
  count(*) FILTER (action = 'pending_observation') AS pending_observation, count(*) FILTER (action = 'waiting_for_market_data') AS waiting_for_market_data, 0::BIGINT AS signals_created,
  count(*) FILTER (action = 'create') AS signals_would_create, count(*) FILTER (action = 'existing') AS signals_existing, count(*) FILTER (action = 'existing' AND nxt = 'awaiting_event') AS awaiting_event,
  count(*) FILTER (action = 'existing' AND nxt = 'awaiting_outcome') AS awaiting_outcome, 0::BIGINT AS outcomes_attached, count(*) FILTER (action = 'existing' AND nxt = 'matured') AS outcomes_would_attach,
  count(*) FILTER (nxt = 'already_matured') AS matured, count(*) FILTER (nxt = 'already_matured' OR (action = 'lifecycle_unavailable' AND life)) AS already_current,
  count(*) FILTER (action IN ('no_event_date','lifecycle_unavailable')) AS unavailable, count(*) FILTER (action = 'lifecycle_unavailable') AS unavailable_observation_before_cutoff,
  0::BIGINT AS calendar_snapshot_mismatches, 0::BIGINT AS missing_t5_market_data, 0::BIGINT AS incomplete_feature_window, 0::BIGINT AS missed_lock_window FROM dnext""")
def dry_run(w):
    return pr.prospective_report(decisions(w), dry_run=True)


@register("q16_legacy_modes", """
 SELECT evaluation_mode, count(*) AS n FROM (
  SELECT CASE WHEN evaluation_mode = 'prospective' AND lockup_id % 3 <> 0 THEN 'strict_prospective' ELSE evaluation_mode END AS evaluation_mode FROM sig
  UNION ALL SELECT 'strict_prospective' FROM sig WHERE evaluation_mode = 'prospective' AND lockup_id % 3 = 0) GROUP BY 1""")
def legacy(w):
    """A third of the legacy rows have a strict row beside them and keep their name."""
    signals = w.signals(HYPOTHESIS)
    beside = signals.where((F.col("evaluation_mode") == "prospective") & (F.col("lockup_id") % 3 == 0)).withColumn("evaluation_mode", F.lit(STRICT))
    return pr.normalise_legacy_modes(signals.unionByName(beside)).groupBy("evaluation_mode").agg(F.count(F.lit(1)).alias("n"))


_EVAL = "(SELECT * FROM sig WHERE evaluation_mode IN ('strict_prospective','prospective') AND signal_status <> 'unavailable')"


@register("q17_evaluation_totals", f"""
 SELECT count(*) AS total_signals, count(y) AS matured_signals, count(*) - count(y) AS pending_signals, count(*) FILTER (y < 0 AND interaction_group = 'high_high') AS target_bearish_hits, count(*) FILTER (y < 0) AS bearish_outcomes FROM {_EVAL}""")
def totals(w):
    return pr.evaluation_totals(w.signals(HYPOTHESIS), STRICT, HYPOTHESIS)


@register("q17_evaluation_groups", f"""
 SELECT g AS interaction_group, count(y) AS n_events, round(avg(y), 6) AS mean_outcome, count(*) FILTER (y < 0) AS bearish_hit_count, round(count(*) FILTER (y < 0) / nullif(count(y), 0), 6) AS bearish_hit_rate,
  round(count(*) FILTER (y <= -.05) / nullif(count(y), 0), 6) AS le_5pct_rate, round(count(*) FILTER (y <= -.1) / nullif(count(y), 0), 6) AS le_10pct_rate, round(count(*) FILTER (y <= -.2) / nullif(count(y), 0), 6) AS le_20pct_rate,
  round(median(y), 6) AS median_outcome, round(median(mfe), 6) AS median_bearish_mfe, round(median(mae), 6) AS median_bearish_mae
 FROM (SELECT unnest(['low_low','low_high','high_low','high_high']) AS g) LEFT JOIN (SELECT * FROM {_EVAL} WHERE y IS NOT NULL) ON interaction_group = g GROUP BY 1""")
def evaluation_groups(w):
    return rounded(pr.evaluation_groups(w.signals(HYPOTHESIS), STRICT, HYPOTHESIS))


@register("q18_bearish_rule", "SELECT lockup_id, coalesce(y < 0, FALSE) AS bearish FROM sig")
def bearish(w):
    return w.signals(HYPOTHESIS).select("lockup_id", pr.is_bearish(F.col("realized_outcome_value")).alias("bearish"))


def _card_signals(w):
    """Signals of primary agreements: the agreement id is moved to its offering's primary one."""
    primary = w.ipos().select("ipo_id", "primary_lockup_id")
    return w.signals(HYPOTHESIS).join(primary, "ipo_id").withColumn("lockup_id", F.col("primary_lockup_id")).drop("primary_lockup_id")


def _card_sql(modes):
    return f"""(SELECT s.*, interaction_group = 'high_high' AS t FROM sig s JOIN ipo USING (ipo_id) WHERE evaluation_mode IN ({modes}) AND signal_status <> 'unavailable' AND primary_lockup_id IS NOT NULL
     AND classification_status = 'classified' AND candidate_type = 'operating_company_ipo' AND offering_status = 'priced')"""


for _mode, _modes in ((STRICT, "'strict_prospective','prospective'"), (SHADOW, "'shadow_prospective'")):
    _ok = "TRUE" if _mode == STRICT else "FALSE"

    @register("q19_scorecard_strict" if _mode == STRICT else "q20_scorecard_shadow", f"""
     SELECT *, 'm9a_prospective_eval_v1' AS evaluation_id, bearish_outcomes / nullif(matured_signals, 0) AS bearish_outcome_rate, target_bearish_hits / nullif(matured_target_signals, 0) AS target_bearish_hit_rate,
      round(target_median_outcome - non_target_median_outcome, 6) AS target_minus_non_target_median, {_ok} AND matured_signals >= 20 AS matured_threshold_satisfied, {_ok} AND matured_target_signals >= 5 AS target_threshold_satisfied,
      CASE WHEN {_ok} AND matured_signals >= 20 AND matured_target_signals >= 5 THEN 'provisional_interpretation_ready' ELSE 'descriptive_only' END AS interpretation_status FROM (
     SELECT '{_mode}' AS evaluation_mode, count(*) AS total_signals, count(*) - count(y) AS pending_signals, count(y) AS matured_signals, count(*) FILTER (t) AS target_signals, count(y) FILTER (t) AS matured_target_signals,
      count(*) FILTER (y < 0) AS bearish_outcomes, count(*) FILTER (y >= 0) AS non_bearish_outcomes, count(*) FILTER (t AND y < 0) AS target_bearish_hits, count(*) FILTER (t AND y >= 0) AS target_non_bearish_outcomes,
      round(avg(y), 6) AS mean_outcome, round(avg(y) FILTER (t), 6) AS target_mean_outcome, round(avg(y) FILTER (NOT t), 6) AS non_target_mean_outcome, round(median(y), 6) AS median_outcome,
      round(median(y) FILTER (t), 6) AS target_median_outcome, round(median(y) FILTER (NOT t), 6) AS non_target_median_outcome FROM {_card_sql(_modes)})""")
    def card(w, mode=_mode):
        rows = pr.scorecard_rows(_card_signals(w), w.ipos(), w.companies(), mode, HYPOTHESIS)
        return rounded(pr.scorecard(rows, mode))


@register("q19_scorecard_groups", f"""
 SELECT g AS interaction_group, count(signal_id) AS total_signals, count(y) AS matured_signals, count(*) FILTER (y < 0) AS bearish_outcomes, round(avg(y), 6) AS mean_outcome, round(median(y), 6) AS median_outcome,
  round(count(*) FILTER (y < 0) / nullif(count(y), 0), 6) AS bearish_rate FROM (SELECT unnest(['low_low','low_high','high_low','high_high']) AS g) LEFT JOIN {_card_sql("'strict_prospective','prospective'")} ON interaction_group = g GROUP BY 1""")
def card_groups(w):
    return rounded(pr.scorecard_groups(pr.scorecard_rows(_card_signals(w), w.ipos(), w.companies(), STRICT, HYPOTHESIS)))


# ------------------------------------------------------------------ projections
@register("r1_hypothesis_metadata", f"""
 SELECT '{HYPOTHESIS.hypothesis_id}' AS hypothesis_id, 'return_20d' AS feature1, 'realized_vol_20d' AS feature2, count(*) AS signals FROM sig""")
def metadata(w):
    from lockstep.operators.statistics import frozen_hypothesis
    registry = F.broadcast(frozen_hypothesis(w.spark, (HYPOTHESIS,)))
    rows = w.signals(HYPOTHESIS).groupBy("hypothesis_id").agg(F.count(F.lit(1)).alias("signals"))
    return rows.join(registry, "hypothesis_id").select("hypothesis_id", "feature1", "feature2", "signals")


@register("r2_result_label", """
 SELECT lockup_id, CASE WHEN signal_status = 'matured' AND y IS NOT NULL THEN CASE WHEN interaction_group = 'high_high' THEN CASE WHEN y < 0 THEN 'bearish_hit' ELSE 'no_bearish_hit' END
  WHEN y < 0 THEN 'bearish_non_target' ELSE 'non_target' END END AS result FROM sig""")
def labels(w):
    return w.signals(HYPOTHESIS).select("lockup_id", pj.result_label().alias("result"))


_ROLES = """(SELECT ipo_id, min(k) FILTER (m < 2) AS strict_id, min(k) FILTER (m = 2) AS shadow_id, min(k) FILTER (m = 3) AS lifecycle_id FROM (
 SELECT ipo_id, m, m::BIGINT * 1000000000 + signal_id AS k FROM (SELECT *, CASE evaluation_mode WHEN 'strict_prospective' THEN 0 WHEN 'prospective' THEN 1 WHEN 'shadow_prospective' THEN 2 ELSE 3 END AS m FROM sig)) GROUP BY 1)"""


@register("r3_signal_roles", f"SELECT ipo_id, strict_id % 1000000000 AS strict_id, shadow_id % 1000000000 AS shadow_id, lifecycle_id % 1000000000 AS lifecycle_id FROM {_ROLES}")
def roles(w):
    by_offering = w.signals(HYPOTHESIS).withColumn("lockup_id", F.col("ipo_id"))
    return pj.signal_roles(by_offering, HYPOTHESIS).select(
        F.col("lockup_id").alias("ipo_id"), F.col("strict_signal.signal_id").alias("strict_id"),
        F.col("shadow_signal.signal_id").alias("shadow_id"), F.col("lifecycle_row.signal_id").alias("lifecycle_id"))


@register("r4_signal_listing", """
 SELECT lockup_id, ticker, observation_date, interaction_group FROM sig JOIN ipo USING (ipo_id) JOIN comp USING (company_id)
 WHERE evaluation_mode IN ('strict_prospective','prospective') AND signal_status = 'matured'""")
def listing(w):
    rows = pj.signal_listing(w.signals(HYPOTHESIS), w.ipos(), w.companies(), status="matured")
    return rows.select("lockup_id", "ticker", "observation_date", "interaction_group")


def _cohort(w):
    return pj.clean_cohort(w.lockups(), w.ipos(), w.companies())


_COHORT = """(SELECT lock.lockup_id, lock.ipo_id, company_id, ticker, lock.event_date FROM lock JOIN ipo USING (ipo_id) JOIN comp USING (company_id) WHERE lock.lockup_id = primary_lockup_id AND primary_lockup_expiration_date IS NOT NULL
 AND classification_status = 'classified' AND candidate_type = 'operating_company_ipo' AND offering_status = 'priced')"""
def _early(w):
    from dataclasses import replace
    return replace(HYPOTHESIS, cutoff=dt.date(1995, 3, 31))


_TRACKED = f"""(SELECT c.*, s.signal_id AS sid, s.evaluation_mode AS mode, s.signal_status AS sst, s.observation_date AS sobs, s.interaction_group AS grp, s.y, s.feature1_value AS f1, v.observation_date AS vobs, v.return_20d AS vr, t.session AS t5
 FROM {_COHORT} c JOIN cal ON day = c.event_date JOIN ses t ON t.ix = next_ix - 5 LEFT JOIN sig s ON s.lockup_id = c.lockup_id LEFT JOIN (SELECT * FROM snap1 WHERE observation_offset = -5) v ON v.lockup_id = c.lockup_id)"""


@register("r5_upcoming_lockups", f"""
 SELECT lockup_id, coalesce(sobs, t5) AS required_t5_date, CASE WHEN sid IS NOT NULL THEN sst WHEN t5 > DATE '1995-04-28' THEN 'pending_observation' ELSE 'waiting_for_market_data' END AS m8_status,
  CASE WHEN mode = 'shadow_prospective' THEN 'shadow_signal_frozen' WHEN sst = 'unavailable' THEN 'observation_before_prospective_start' WHEN sid IS NOT NULL THEN 'signal_frozen' WHEN vobs IS NOT NULL THEN 't5_snapshot_available'
   WHEN t5 > DATE '1995-04-28' THEN 'waiting_for_t5' ELSE 'waiting_for_market_data' END AS t5_timing_status,
  round(coalesce(CASE WHEN mode <> 'lifecycle_tracking' THEN f1 END, vr), 6) AS return_20d_at_minus5, grp AS interaction_group, event_date - DATE '1995-04-28' AS calendar_days_to_event
 FROM {_TRACKED} WHERE NOT (sid IS NULL AND vobs IS NOT NULL AND vobs <= DATE '1995-03-31')""")
def upcoming(w):
    rows = pj.upcoming_lockups(_cohort(w), w.signals(HYPOTHESIS), daily.snapshots_v1(w), ev.primary_security(w.securities()),
                               audit(w), today=dt.date(1995, 4, 28), hypothesis=_early(w))
    return rounded(rows.select("lockup_id", "required_t5_date", "m8_status", "t5_timing_status", "return_20d_at_minus5",
                               "interaction_group", "calendar_days_to_event"))


@register("r6_research_summary", f"""
 SELECT count(*) AS eligible_lockups, count(*) FILTER (k = 'h') AS historical_unavailable, count(*) FILTER (k = 'm') AS missed_t5_window, count(*) FILTER (k = 'p') AS pending_observation, count(*) FILTER (k = 'w') AS waiting_for_market_data,
  count(*) FILTER (k = 's') AS prospective_signals, count(*) FILTER (mode = 'shadow_prospective') AS shadow_signals, count(*) FILTER (k = 's' AND sst = 'awaiting_event') AS awaiting_event, 0::BIGINT AS awaiting_outcome,
  count(*) FILTER (k = 's' AND sst = 'matured') AS matured_signals, count(*) FILTER (k = 's' AND grp = 'high_high') AS high_high_signals, count(*) FILTER (k = 's' AND grp = 'high_high' AND sst = 'matured') AS high_high_matured,
  (SELECT max(trade_date) FROM prices) AS latest_market_date FROM (
 SELECT *, CASE WHEN mode IN ('strict_prospective','prospective') THEN 's' WHEN mode = 'lifecycle_tracking' THEN 'm' WHEN vobs <= DATE '1995-03-31' THEN 'h' WHEN t5 > DATE '1995-04-28' THEN 'p' ELSE 'w' END AS k FROM {_TRACKED})""")
def research_summary(w):
    return pj.research_summary(_cohort(w), w.signals(HYPOTHESIS), daily.snapshots_v1(w), daily.daily_prices(w),
                               today=dt.date(1995, 4, 28), hypothesis=_early(w))


@register("r7_historical_reference", """
 SELECT count(*) AS events, round(avg(post_20d_return), 6) AS mean_outcome, round(median(return_20d), 6) AS median_feature FROM ds
 WHERE is_primary_event AND observation_offset = -5 AND observation_date <= DATE '2000-06-30' AND return_20d IS NOT NULL AND realized_vol_20d IS NOT NULL AND post_20d_return IS NOT NULL""")
def historical(w):
    from lockstep.functions.order_stats import medians
    from lockstep.operators.statistics import complete_cases
    rows = complete_cases(daily.dataset(w).where(F.col("observation_date") <= F.lit(HYPOTHESIS.cutoff)), HYPOTHESIS.feature1,
                          HYPOTHESIS.feature2, HYPOTHESIS.outcome, HYPOTHESIS.observation_offset)
    one = rows.groupBy("observation_offset").agg(F.count(F.lit(1)).alias("events"), F.avg("post_20d_return").alias("mean_outcome"))
    return rounded(one.join(medians(rows, ["observation_offset"], {"return_20d": "median_feature"}), "observation_offset").drop("observation_offset"))


def _reference(w, part):
    rows = research.primary_events(w, "observation_date", research.F1, research.F2, research.Y, research.MFE, research.MAE, offset=research.OFFSET)
    return pj.historical_reference(rows, HYPOTHESIS)[part]


def _of_reference(sql):
    """The same statistics over the primary events known at the cutoff."""
    return sql.replace("FROM ds WHERE is_primary_event AND", "FROM ds WHERE").replace(
        "FROM ds WHERE", f"FROM ds WHERE is_primary_event AND observation_date <= {_CUT} AND")


@register("r7_reference_ols", _of_reference(research.OLS_SQL))
def reference_ols(w):
    return rounded(_reference(w, "ols").select("observation_offset", *st.FIT_COLUMNS))


@register("r7_reference_groups", _of_reference(research.CELLS_SQL))
def reference_groups(w):
    return rounded(_reference(w, "groups"))


@register("r7_reference_flags", _of_reference(research.FLAGS_SQL))
def reference_flags(w):
    return rounded(_reference(w, "flags"))


@register("r7_reference_ranges", _of_reference(research.RANGES_SQL))
def reference_ranges(w):
    return rounded(_reference(w, "ranges"))


@register("r8_t5_payload", f"""
 SELECT lockup_id, CASE WHEN n = 21 THEN 'complete' ELSE 'incomplete' END AS window_state, n AS present FROM (
 SELECT t.lockup_id, CASE WHEN p.security_id IS NOT NULL THEN (SELECT count(*) FROM sbar b JOIN cal c ON b.ix BETWEEN c.next_ix - 25 AND c.next_ix - 5 WHERE c.day = t.event_date AND b.security_id = p.security_id) END AS n
 FROM {_TRACKED} t LEFT JOIN (SELECT company_id, max(security_id) AS security_id FROM sec WHERE is_primary GROUP BY 1) p USING (company_id) WHERE NOT (sid IS NULL AND vobs IS NOT NULL AND vobs <= DATE '1995-03-31'))""")
def t5_payload(w):
    rows = pj.upcoming_lockups(_cohort(w), w.signals(HYPOTHESIS), daily.snapshots_v1(w), ev.primary_security(w.securities()),
                               audit(w), today=dt.date(1995, 4, 28), hypothesis=_early(w))
    state = F.when(F.col("t5_readiness") == "complete", "complete").otherwise("incomplete")
    return rows.select("lockup_id", state.alias("window_state"), F.col("t5_present_count").alias("present"))


def _facts(w):
    from lockstep.operators.offering_text import offering_facts
    return offering_facts(w.offering_documents())


@register("r9_candidate_list", """
 SELECT company_id + 10 AS ipo_id, name, (SELECT count(*) FROM filing f WHERE f.company_id = i.company_id) AS filing_count FROM cand JOIN issuer i USING (company_id)""")
def candidate_list(w):
    from lockstep.operators.market_summary import market_summary
    documents = w.filings().where(F.col("filing_id") % 2 == 0).select(
        "filing_id", F.lit("success").alias("fetch_status"), F.sha2("accession_number", 256).alias("sha256"))
    summaries = market_summary(w.ipos(), w.securities(), daily.daily_prices(w), "primary").dropDuplicates(["ipo_id"])
    ipos = w.candidates().withColumn("primary_lockup_id", F.lit(None).cast("long"))
    rows = pj.candidate_list(ipos, w.issuers(), w.filings(), documents, _facts(w).select("ipo_id"), summaries, daily.outcomes(w))
    return rows.select("ipo_id", "name", "filing_count")


def _detail(w, section, ipo=50):
    return pj.candidate_detail(ipo, w.candidates(), w.issuers(), w.filings(), _facts(w), w.lockups())[section]


@register("r10_candidate_detail", "SELECT accession_number, form_type, filed_at FROM filing WHERE company_id = 40")
def detail(w):
    return _detail(w, "filings").select("accession_number", "form_type", "filed_at")


@register("r10_candidate_head", "SELECT company_id + 10 AS ipo_id, name FROM cand JOIN issuer i USING (company_id) WHERE company_id = 40")
def detail_head(w):
    return _detail(w, "ipo").select("ipo_id", "name")


@register("r10_candidate_facts", """
 SELECT o_orderkey AS filing_id, (9000000 + o_orderkey)::DOUBLE AS value FROM orders WHERE o_orderkey % 700 = 50""")
def detail_facts(w):
    return _detail(w, "facts").where("field_name = 'shares_outstanding_post_ipo'").select("filing_id", F.col("value").cast("double").alias("value"))


@register("r10_candidate_lockups", "SELECT lockup_id, holder_group FROM lock WHERE ipo_id = 110")
def detail_lockups(w):
    return _detail(w, "lockups", 110).select("lockup_id", "holder_group")


@register("r11_snapshot_trajectory", """
 SELECT s.ipo_id, observation_offset, observation_date, round(close, 6) AS close, round(return_20d, 6) AS return_20d FROM snap1 s JOIN ipo ON ipo.ipo_id = s.ipo_id AND s.lockup_id = primary_lockup_id""")
def trajectory(w):
    rows = pj.snapshot_trajectory(daily.snapshots_v1(w), w.ipos(), version="1")
    return rounded(rows.select("ipo_id", "observation_offset", "observation_date", "close", "return_20d"))


_RUNS = "(SELECT user_id || '-' || CAST(ts AS DATE) AS run_id, 'daily-' || user_id % 10 AS run_name, min(ts) AS started_at, max(ts) AS finished_at, CASE WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'succeeded' END AS status FROM events GROUP BY 1, 2)"


@register("r12_run_status", f"""
 SELECT arg_max(run_id, (started_at, run_id)) AS last_run_id, arg_max(status, (started_at, run_id)) AS last_run_status, arg_max(run_id, (started_at, run_id)) FILTER (status = 'succeeded') AS last_successful_run_id,
  (SELECT max(trade_date) FROM prices) AS latest_market_date FROM {_RUNS} WHERE run_name = 'daily-4'""")
def run_status(w):
    return pj.run_status(w.runs(), "daily-4", daily.daily_prices(w))


@register("r13_run_rollup", f"""
 SELECT run_id, status, (SELECT count(*) FROM events e WHERE user_id || '-' || CAST(ts AS DATE) = run_id AND event_type IN ('view','click','purchase')) AS stages_succeeded,
  (SELECT count(*) FROM events e WHERE user_id || '-' || CAST(ts AS DATE) = run_id AND event_type = 'error') AS stages_failed, round(epoch(finished_at - started_at), 3) AS duration_seconds FROM {_RUNS}""")
def rollup(w):
    rows = pj.run_rollup(w.runs(), w.stages())
    return rows.select("run_id", "status", "stages_succeeded", "stages_failed", F.round("duration_seconds", 3).alias("duration_seconds"))


# ------------------------------------------------------------------ options
S_AS_OF = dt.date(2000, 3, 31)
CTES["pool"] = f"""
 SELECT c.*, next_ix AS event_ix, e.session AS event_session, t.session AS t5_date, EXISTS (SELECT 1 FROM sig WHERE sig.lockup_id = c.lockup_id) AS is_signal_name
 FROM {_CAND} c JOIN cal ON day = c.event_date JOIN ses e ON e.ix = next_ix JOIN ses t ON t.ix = next_ix - 5 WHERE t.session <= DATE '2000-03-31' AND ticker IS NOT NULL
"""
CTES["contract"] = """
 SELECT 'T' || CASE WHEN p_partkey % 2 = 0 THEN 1 + p_partkey % 3 ELSE 100 + p_partkey % 25 END AS underlying_ticker, CASE WHEN p_partkey % 17 <> 0 THEN 'P' || p_partkey || '-' || n END AS contract_symbol,
  CASE WHEN p_partkey % 19 <> 0 THEN DATE '1995-02-01' + CAST(p_partkey * 7 % 2400 + n * 30 AS INT) END AS expires, CAST(15 + p_partkey % 10 AS VARCHAR) AS strike FROM part, (SELECT unnest([0,1,2]) AS n)
"""
CTES["qsum"] = """
 SELECT 'P' || l_partkey || '-' || (l_linenumber % 3) AS contract_symbol, CAST(l_shipdate AS DATE) AS quote_date, bool_or(l_returnflag <> 'R') AS bid_available, bool_or(l_linestatus = 'O') AS ask_available, bool_or(l_quantity > 25) AS has_bid_size FROM lineitem GROUP BY 1, 2
"""
CTES["chosen"] = """
 SELECT p.*, count(contract_symbol) FILTER (expires >= t5_date) AS put_contracts_found, arg_min(contract_symbol, expires || strike || contract_symbol) FILTER (expires >= t5_date AND contract_symbol IS NOT NULL) AS symbol,
  min(expires) FILTER (expires >= t5_date AND contract_symbol IS NOT NULL) AS expires, count(c.underlying_ticker) AS listed FROM pool p LEFT JOIN contract c ON c.underlying_ticker = p.ticker GROUP BY ALL
"""
CTES["grid"] = """
 SELECT lockup_id, label, s.session AS date, CASE WHEN s.session > DATE '2000-03-31' THEN 'not_reached' WHEN s.session > expires THEN 'contract_expired' WHEN q.contract_symbol IS NULL THEN 'no_quotes' WHEN bid_available AND ask_available THEN 'complete_bid_ask' ELSE 'partial_fields' END AS status
 FROM chosen, (SELECT unnest(['event','plus_1','plus_5','plus_10','plus_20']) AS label, unnest([0,1,5,10,20]) AS k) JOIN ses s ON s.ix = event_ix + k LEFT JOIN qsum q ON q.contract_symbol = symbol AND q.quote_date = s.session WHERE symbol IS NOT NULL
"""
MATERIALIZED.update({"pool", "contract", "qsum", "chosen", "grid"})


def pool(w):
    cohort = pr.candidate_events(w.lockups(), w.ipos(), w.companies(), primary_lockup_only=False).where("ticker is not null")
    return op.sample_pool(cohort, w.signals(HYPOTHESIS), S_AS_OF)


@register("s1_sample_selection", """
 WITH lead1 AS (SELECT lockup_id, 0 AS turn FROM pool WHERE is_signal_name ORDER BY event_date, ticker, lockup_id LIMIT 1),
 rest AS (SELECT *, row_number() OVER (ORDER BY event_date, ticker, lockup_id) AS a, row_number() OVER (ORDER BY event_date DESC, ticker DESC, lockup_id DESC) AS d FROM pool WHERE lockup_id NOT IN (SELECT lockup_id FROM lead1))
 SELECT lockup_id FROM (SELECT lockup_id, turn FROM lead1 UNION ALL SELECT lockup_id, least(2*a - 1, 2*d) FROM rest) ORDER BY turn LIMIT 12""".replace("\n WITH lead1 AS (", "SELECT * FROM (WITH lead1 AS (") + ")")
def sample(w):
    return op.select_sample(pool(w), 12).select("lockup_id")


@register("s2_contract_selection", """
 SELECT lockup_id, put_contracts_found, symbol AS contract_symbol, expires AS contract_expiration, CASE WHEN put_contracts_found > 0 THEN 'historical_contracts_found' WHEN listed > 0 THEN 'malformed_contract_metadata' ELSE 'no_contracts' END AS contract_discovery_status FROM chosen""")
def contract_choice(w):
    return op.select_contracts(pool(w), w.contracts()).select(
        "lockup_id", "put_contracts_found", "contract_symbol", "contract_expiration", "contract_discovery_status")


@register("s3_quote_dates", "SELECT quote_date, count(*) AS contracts FROM qsum GROUP BY 1")
def quote_dates(w):
    return op.quote_summary(w.quotes()).groupBy("quote_date").agg(F.count(F.lit(1)).alias("contracts"))


@register("s4_quote_fields", "SELECT contract_symbol, quote_date, bid_available, ask_available, has_bid_size, CASE WHEN bid_available AND ask_available THEN 'complete_bid_ask' ELSE 'partial_fields' END AS quote_field_status FROM qsum")
def quote_fields(w):
    return op.quote_summary(w.quotes())


def _selected(w):
    return op.select_contracts(pool(w), w.contracts())


@register("s5_follow_up_grid", "SELECT lockup_id, label, date, status FROM grid")
def follow_up(w):
    return op.follow_up_grid(_selected(w), op.quote_summary(w.quotes()), S_AS_OF).select("lockup_id", "label", "date", "status")


_NAMES = """(SELECT c.lockup_id, put_contracts_found > 0 AS found, q.bid_available AS b, q.ask_available AS a, CASE WHEN put_contracts_found = 0 OR symbol IS NULL THEN 'not_attempted' WHEN r > 0 AND f = r THEN 'historical_quotes_available' WHEN f > 0 THEN 'partially_available'
  WHEN r > 0 THEN 'unavailable' ELSE 'contract_expired' END AS later FROM chosen c LEFT JOIN qsum q ON q.contract_symbol = symbol AND q.quote_date = t5_date
  LEFT JOIN (SELECT lockup_id, count(*) FILTER (status NOT IN ('not_reached','contract_expired')) AS r, count(*) FILTER (status = 'complete_bid_ask') AS f FROM grid GROUP BY 1) g ON g.lockup_id = c.lockup_id)"""


def _names(w):
    selected, summary = _selected(w), op.quote_summary(w.quotes())
    return op.name_results(selected, summary, op.follow_up_grid(selected, summary, S_AS_OF))


@register("s6_name_results", f"SELECT lockup_id, b AS historical_bid_available, a AS historical_ask_available, later AS later_valuation_status FROM {_NAMES}")
def names(w):
    return _names(w).select("lockup_id", "historical_bid_available", "historical_ask_available", "later_valuation_status")


@register("s7_feasibility", f"""
 SELECT count(*) AS sample_size, CASE WHEN bool_and(found) THEN TRUE WHEN bool_or(found) THEN NULL ELSE FALSE END AS historical_contract_discovery_supported, CASE WHEN bool_or(coalesce(a AND b, FALSE)) THEN NULL ELSE FALSE END AS historical_bid_ask_supported,
  CASE WHEN bool_or(later = 'historical_quotes_available') THEN NULL ELSE FALSE END AS historical_followup_valuation_supported,
  CASE WHEN bool_or(found AND (coalesce(a, FALSE) OR coalesce(b, FALSE) OR later = 'partially_available')) THEN 'historical_backtest_partially_feasible' ELSE 'provider_not_suitable' END AS classification FROM {_NAMES}""")
def feasibility(w):
    return op.feasibility(_names(w))
