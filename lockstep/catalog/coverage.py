"""Coverage, attempt-provenance and readiness queries."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lockstep.catalog import register
from lockstep.operators import coverage as cv
from lockstep.operators import readiness as rd

AS_OF = dt.date(2001, 6, 29)
AS_OF_SQL = "DATE '2001-06-29'"
PROVIDER = "primary"

_ROWS = """(SELECT lock.*, ipo.* EXCLUDE (ipo_id), sec.security_id, sec.ticker, sec.provider_symbol FROM lock JOIN ipo USING (ipo_id) JOIN sec USING (company_id) WHERE is_primary)"""
_RANGES = f"""(SELECT DISTINCT security_id, a.session AS start_date, b.session AS end_date FROM {_ROWS} JOIN cal ON day = event_date
 JOIN ses a ON a.ix = next_ix - 80 JOIN ses b ON b.ix = next_ix)"""
# Each session of each range with stored/missing flags.
_DAYS = f"""(SELECT r.security_id, start_date, end_date, d.session AS day, d.ix, p.trade_date IS NOT NULL AS stored, d.session <= {AS_OF_SQL} AS past,
  EXISTS (SELECT 1 FROM att WHERE att.security_id = r.security_id AND provider = 'primary' AND status = 'no_data' AND d.session BETWEEN requested_start_date AND requested_end_date) AS silent
 FROM {_RANGES} r JOIN ses d ON d.session BETWEEN start_date AND end_date LEFT JOIN prices p ON p.security_id = r.security_id AND p.trade_date = d.session)"""
KEYS = "security_id, start_date, end_date"


def rows(w):
    return cv.selected_rows(w.ipos(), w.companies(), w.lockups(), w.securities())


def ranges(w):
    return cv.plan_lockup_coverage(rows(w)).select(*cv.RANGE).distinct()


def text(array):
    return F.array_join(F.transform(array, lambda d: d.cast("string")), ",")


@register("l1_range_coverage", f"""
 SELECT {KEYS}, count(*) AS expected_session_count, count(*) FILTER (stored) AS stored_expected_session_count,
  coalesce(string_agg(CAST(day AS VARCHAR), ',' ORDER BY day) FILTER (NOT stored AND past), '') AS fetchable,
  count(*) FILTER (NOT stored AND NOT past) AS future,
  (SELECT count(*) FROM prices p WHERE p.security_id = d.security_id AND trade_date BETWEEN d.start_date AND d.end_date AND trade_date NOT IN (SELECT session FROM ses)) AS non_sessions
 FROM {_DAYS} d GROUP BY ALL""")
def range_coverage(w):
    df = cv.coverage(ranges(w), w.daily_prices(), AS_OF)
    return df.select(*cv.RANGE, "expected_session_count", "stored_expected_session_count",
                     text("fetchable_missing_sessions").alias("fetchable"),
                     F.size("future_missing_sessions").alias("future"),
                     F.size("non_session_stored_dates").alias("non_sessions"))


@register("l2_coverage_ratio", f"""
 SELECT {KEYS}, round(count(*) FILTER (stored) / count(*), 6) AS coverage_ratio, count(*) FILTER (NOT stored) = 0 AS coverage_complete FROM {_DAYS} GROUP BY ALL""")
def ratio(w):
    df = cv.coverage(ranges(w), w.daily_prices(), AS_OF)
    return df.select(*cv.RANGE, F.round("coverage_ratio", 6).alias("coverage_ratio"), "coverage_complete")


@register("l3_lockup_plan", f"""
 SELECT lockup_id, security_id, e.session AS event_session, s.session AS earliest_snapshot_session, f.session AS earliest_feature_session
 FROM {_ROWS} JOIN cal ON day = event_date JOIN ses e ON e.ix = next_ix JOIN ses s ON s.ix = next_ix - 60 JOIN ses f ON f.ix = next_ix - 80""")
def plan(w):
    return cv.plan_lockup_coverage(rows(w)).select(
        "lockup_id", "security_id", "event_session", "earliest_snapshot_session", "earliest_feature_session")


_WINDOWS = f"(SELECT DISTINCT security_id, next_ix - 5 AS obs_ix FROM {_ROWS} JOIN cal ON day = event_date)"


def windows(w):
    df = cv.plan_lockup_coverage(rows(w))
    return df.select("security_id", (F.col("event_ix") - 5).alias("obs_ix"))


@register("l4_feature_window", f"""
 SELECT w.security_id, obs_ix, count(*) AS required_count, count(p.trade_date) AS present_count, count(*) = count(p.trade_date) AS complete
 FROM {_WINDOWS} w JOIN ses s ON s.ix BETWEEN obs_ix - 20 AND obs_ix LEFT JOIN prices p ON p.security_id = w.security_id AND p.trade_date = s.session GROUP BY 1, 2""")
def feature_window(w):
    return cv.feature_window_coverage(windows(w), w.daily_prices()).drop("missing_sessions")


@register("l5_gap_islands", f"""
 SELECT {KEYS}, min(day) AS range_start, max(day) AS range_end, count(*) AS sessions FROM (
  SELECT *, ix - row_number() OVER (PARTITION BY {KEYS} ORDER BY ix) AS g FROM {_DAYS} WHERE NOT stored AND past) GROUP BY {KEYS}, g""")
def gap_islands(w):
    return cv.run_rows(cv.planned(ranges(w), w.daily_prices(), w.attempts(), PROVIDER, AS_OF, retry_known_no_data=True), "planned")


@register("l6_known_no_data", f"SELECT DISTINCT security_id, ix FROM {_DAYS} WHERE NOT stored AND past AND silent")
def silent(w):
    days = cv.coverage_days(ranges(w), w.daily_prices(), AS_OF).where("fetchable")
    return cv.known_no_data(w.attempts(), PROVIDER, days)


@register("l7_attempt_validation", """
 SELECT status, count(*) AS attempts FROM att WHERE requested_start_date <= requested_end_date AND status IN ('success','no_data','partial','error') GROUP BY 1""")
def validation(w):
    return cv.validate_attempts(w.attempts()).groupBy("status").agg(F.count(F.lit(1)).alias("attempts"))


@register("l8_reconcile", """
 SELECT DISTINCT security_id, provider, requested_start_date, requested_end_date, status FROM att a WHERE NOT EXISTS (
  SELECT 1 FROM att b WHERE b.attempt_id % 3 = 0 AND b.security_id = a.security_id AND b.provider = a.provider AND b.requested_start_date = a.requested_start_date
   AND b.requested_end_date = a.requested_end_date AND b.status = a.status)""")
def reconcile(w):
    stored = w.attempts().where(F.col("attempt_id") % 3 == 0)
    return cv.reconcile_attempts(stored, w.attempts()).select(*cv.ATTEMPT_IDENTITY)


@register("l8_resolve_tickers", """
 SELECT c_custkey, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END AS resolution, CASE WHEN n = 1 THEN s END AS security_id
 FROM (SELECT c_custkey, 'T' || (c_custkey % 1200) AS t FROM customer) LEFT JOIN (
  SELECT ticker, count(*) AS n, min(security_id) AS s FROM (SELECT ticker, security_id FROM sec UNION ALL SELECT ticker, security_id + 1 FROM sec WHERE security_id % 4 = 0) GROUP BY 1) ON ticker = t""")
def tickers(w):
    asked = w.table("customer").select("c_custkey", F.concat(F.lit(" t"), (F.col("c_custkey") % 1200).cast("string")).alias("ticker"))
    doubled = w.securities().where(F.col("security_id") % 4 == 0).withColumn("security_id", F.col("security_id") + 1)
    found = cv.resolve_tickers(asked, w.securities().unionByName(doubled))
    return found.select("c_custkey", "resolution", "security_id")


_STATE = f"""(SELECT {KEYS}, count(*) FILTER (NOT stored) AS missing_sessions, count(*) FILTER (NOT stored AND past) AS fetchable_sessions,
  count(*) FILTER (NOT stored AND past AND silent) AS known_no_data_sessions FROM {_DAYS} GROUP BY ALL)"""


def _runs(condition, name):
    return f"""(SELECT {KEYS}, count(*) AS {name} FROM (SELECT DISTINCT {KEYS}, g FROM (
     SELECT *, ix - row_number() OVER (PARTITION BY {KEYS} ORDER BY ix) AS g FROM {_DAYS} WHERE {condition})) GROUP BY ALL)"""


@register("l9_backfill_plan", f"""
 SELECT {KEYS}, missing_sessions, fetchable_sessions, known_no_data_sessions, coalesce(p, 0) AS planned_ranges, coalesce(q, 0) AS request_ranges, coalesce(k, 0) AS skipped_ranges,
  CASE WHEN p IS NULL AND missing_sessions = 0 THEN 'complete' WHEN p IS NULL THEN 'future_sessions_only' WHEN q IS NULL THEN 'known_no_data' ELSE 'missing_sessions' END AS status
 FROM {_STATE} LEFT JOIN {_runs('NOT stored AND past', 'p')} USING ({KEYS}) LEFT JOIN {_runs('NOT stored AND past AND NOT silent', 'q')} USING ({KEYS})
 LEFT JOIN {_runs('NOT stored AND past AND silent', 'k')} USING ({KEYS})""")
def backfill(w):
    return cv.backfill_plan(ranges(w), w.daily_prices(), w.attempts(), w.securities(), PROVIDER, AS_OF)


def year_ranges(w):
    """One explicit range per security: its whole first calendar years."""
    return cv.explicit_tasks(w.securities(), dt.date(1995, 1, 3), dt.date(1998, 12, 31))


def _delivery(w):
    """Responses to the planned requests: two of three requested days, odd ones one day late."""
    plan = cv.planned(year_ranges(w), w.daily_prices(), w.attempts(), PROVIDER, AS_OF)
    asked = cv.request_ranges(plan)
    answer = asked.where(F.dayofmonth("range_start") % 3 != 0).withColumn(
        "trade_date", F.explode(F.sequence("range_start", "range_end")))
    late = answer.where(F.dayofmonth("trade_date") % 4 != 0)
    bars = late.select("security_id", "range_start", "range_end", "trade_date", F.lit(1.0).alias("close"))
    return plan, bars


_YEAR_DAYS = f"""(SELECT s.security_id, d.session AS day, d.ix, p.trade_date IS NOT NULL AS stored,
  EXISTS (SELECT 1 FROM att WHERE att.security_id = s.security_id AND provider = 'primary' AND status = 'no_data' AND d.session BETWEEN requested_start_date AND requested_end_date) AS silent
 FROM sec s JOIN ses d ON d.session BETWEEN DATE '1995-01-03' AND DATE '1998-12-31' LEFT JOIN prices p ON p.security_id = s.security_id AND p.trade_date = d.session)"""
_REQUESTS = f"""(SELECT security_id, min(day) AS range_start, max(day) AS range_end, count(*) AS sessions,
  count(*) FILTER (dayofmonth(day) % 4 <> 0) AS answered FROM (
  SELECT *, ix - row_number() OVER (PARTITION BY security_id ORDER BY ix) AS g FROM {_YEAR_DAYS} WHERE NOT stored AND NOT silent) GROUP BY security_id, g)"""


@register("l10_apply_delivery", f"""
 SELECT security_id, range_start, range_end, CASE WHEN dayofmonth(range_start) % 3 <> 0 THEN n ELSE 0 END AS bars_returned,
  CASE WHEN dayofmonth(range_start) % 3 <> 0 THEN answered ELSE 0 END AS bars_created,
  CASE WHEN dayofmonth(range_start) % 3 = 0 OR n = 0 THEN 'no_data' WHEN answered = sessions THEN 'success' ELSE 'partial' END AS status FROM (
 SELECT *, (SELECT count(*) FROM cal WHERE day BETWEEN range_start AND range_end AND dayofmonth(day) % 4 <> 0) AS n FROM {_REQUESTS})""")
def delivery(w):
    plan, bars = _delivery(w)
    _, attempts = cv.apply_delivery(plan, bars, w.daily_prices(), PROVIDER)
    return attempts.select("security_id", "range_start", "range_end", "bars_returned", "bars_created", "status")


@register("l10_final_status", f"""
 SELECT security_id, DATE '1995-01-03' AS start_date, DATE '1998-12-31' AS end_date, m AS missing_before, CASE WHEN m = got THEN 'complete'
  WHEN empty > 0 AND created = 0 THEN 'provider_no_data' WHEN created > 0 THEN 'partially_backfilled' ELSE 'missing_sessions' END AS status FROM (
 SELECT d.security_id, count(*) FILTER (NOT stored) AS m, count(*) FILTER (NOT stored AND dayofmonth(r.range_start) % 3 <> 0 AND dayofmonth(d.day) % 4 <> 0) AS got
  FROM {_YEAR_DAYS} d LEFT JOIN {_REQUESTS} r ON r.security_id = d.security_id AND d.day BETWEEN r.range_start AND r.range_end GROUP BY 1)
 LEFT JOIN (SELECT security_id, sum(CASE WHEN dayofmonth(range_start) % 3 <> 0 THEN answered ELSE 0 END) AS created,
  count(*) FILTER (dayofmonth(range_start) % 3 = 0 OR n = 0) AS empty FROM (
  SELECT *, (SELECT count(*) FROM cal WHERE day BETWEEN range_start AND range_end AND dayofmonth(day) % 4 <> 0) AS n FROM {_REQUESTS}) GROUP BY 1) USING (security_id)""")
def final_status(w):
    plan, bars = _delivery(w)
    accepted, attempts = cv.apply_delivery(plan, bars, w.daily_prices(), PROVIDER)
    after = w.daily_prices().select("security_id", "trade_date", "provider").unionByName(
        accepted.select("security_id", "trade_date", F.lit(PROVIDER).alias("provider")))
    before = plan.select(*cv.RANGE, F.size("missing").cast("long").alias("missing_before"))
    done = cv.delivery_status(plan, cv.coverage(year_ranges(w), after, AS_OF), attempts)
    return done.join(before, cv.RANGE, "left").select(*cv.RANGE, "missing_before", "status")


@register("l11_coverage_summary", f"""
 SELECT (SELECT count(*) FROM {_ROWS}) AS lockups_selected, (SELECT count(*) FROM {_ROWS} WHERE event_date IS NULL) AS lockups_skipped_no_event_date,
  count(*) AS securities_seen, count(*) FILTER (m = 0) AS securities_complete, count(*) FILTER (f > 0) AS securities_with_gaps,
  count(*) FILTER (m > f AND f = 0) AS securities_future_sessions_only, sum(e)::BIGINT AS expected_sessions, sum(e - m)::BIGINT AS stored_expected_sessions,
  sum(m)::BIGINT AS missing_sessions_total, sum(f)::BIGINT AS fetchable_missing_sessions, sum(m - f)::BIGINT AS future_missing_sessions, count(*) AS lockups_plannable
 FROM (SELECT security_id, a.session AS start_date, b.session AS end_date FROM {_ROWS} JOIN cal ON day = event_date JOIN ses a ON a.ix = next_ix - 80 JOIN ses b ON b.ix = next_ix)
 JOIN (SELECT {KEYS}, count(*) AS e, count(*) FILTER (NOT stored) AS m, count(*) FILTER (NOT stored AND past) AS f FROM {_DAYS} GROUP BY ALL) USING ({KEYS})""")
def summary(w):
    return cv.coverage_summary(rows(w), w.daily_prices(), AS_OF)


_CLASSED = f"""(SELECT w.security_id, obs_ix, s.ix, s.session, CASE WHEN p.trade_date IS NOT NULL THEN 'present' WHEN s.session > {AS_OF_SQL} THEN 'future'
  WHEN st = 'no_data' THEN 'known_no_data' WHEN st = 'error' THEN 'provider_error' WHEN st IS NOT NULL THEN 'attempted' ELSE 'unattempted' END AS category
 FROM {_WINDOWS} w JOIN ses s ON s.ix BETWEEN obs_ix - 20 AND obs_ix LEFT JOIN prices p ON p.security_id = w.security_id AND p.trade_date = s.session
 LEFT JOIN (SELECT a.security_id, d.session, arg_max(status, (attempted_at, attempt_id)) AS st FROM att a JOIN ses d ON d.session BETWEEN requested_start_date AND requested_end_date
  WHERE provider = 'primary' GROUP BY 1, 2) l ON l.security_id = w.security_id AND l.session = s.session)"""


@register("m1_latest_attempt", """
 SELECT a.security_id, d.ix, arg_max(status, (attempted_at, attempt_id)) AS latest_status FROM att a JOIN ses d ON d.session BETWEEN requested_start_date AND requested_end_date
 WHERE provider = 'primary' AND (a.security_id, d.session) IN (SELECT (security_id, trade_date) FROM prices) GROUP BY 1, 2""")
def latest_attempt(w):
    from lockstep.operators.calendar_ops import with_session_index
    days = with_session_index(w.daily_prices().select("security_id", "trade_date"), "trade_date", "")
    attempts = w.attempts().where(F.col("provider") == PROVIDER)
    return cv.latest_attempts(attempts, days.where("ix is not null").select("security_id", "ix"))


@register("m2_day_categories", f"SELECT category, count(*) AS days, count(DISTINCT security_id) AS securities FROM {_CLASSED} GROUP BY 1")
def categories(w):
    days = rd.classified_days(windows(w), w.daily_prices(), w.attempts(), PROVIDER, AS_OF)
    return days.groupBy("category").agg(F.count(F.lit(1)).alias("days"), F.count_distinct("security_id").alias("securities"))


_COUNTS = ", ".join(f"count(*) FILTER (category = '{c}') AS {c}_count" for c in rd.CATEGORIES)
_STATUS = """CASE WHEN missing_count = 0 THEN 'complete' WHEN future_count = missing_count THEN 'not_reached'
 WHEN (future_count > 0)::INT + (known_no_data_count > 0)::INT + (provider_error_count > 0)::INT + (attempted_count > 0)::INT + (unattempted_count > 0)::INT > 1 THEN 'mixed_attempt_history'
 WHEN known_no_data_count > 0 THEN 'known_no_data' WHEN provider_error_count > 0 THEN 'provider_error' WHEN unattempted_count > 0 THEN 'unattempted_missing' ELSE 'mixed_attempt_history' END"""
_DIAG = f"""(SELECT *, {_STATUS} AS status FROM (SELECT security_id, obs_ix, count(*) AS required_count, count(*) FILTER (category <> 'present') AS missing_count, {_COUNTS},
  string_agg(category, ',' ORDER BY ix) AS listing FROM {_CLASSED} GROUP BY 1, 2))"""


@register("m3_window_status", f"SELECT security_id, obs_ix, status, missing_count, {', '.join(c + '_count' for c in rd.CATEGORIES)} FROM {_DIAG}")
def window_status(w):
    df = rd.diagnose_windows(windows(w), w.daily_prices(), w.attempts(), PROVIDER, AS_OF)
    return df.select("security_id", "obs_ix", "status", "missing_count", *[f"{c}_count" for c in rd.CATEGORIES])


@register("m4_batched_windows", f"SELECT status, count(*) AS windows, sum(missing_count)::BIGINT AS missing FROM {_DIAG} GROUP BY 1")
def batched(w):
    df = rd.diagnose_windows(windows(w), w.daily_prices(), w.attempts(), PROVIDER, AS_OF)
    return df.groupBy("status").agg(F.count(F.lit(1)).alias("windows"), F.sum("missing_count").alias("missing"))


def audit(w, **kwargs):
    return rd.t5_audit(w.ipos(), w.companies(), w.lockups(), w.securities(), w.daily_prices(), w.attempts(),
                       provider=PROVIDER, as_of_date=AS_OF, **kwargs)


_READY = """CASE WHEN event_date IS NULL THEN 'no_known_event_date' WHEN missing_count = 0 THEN 'complete' WHEN t.session > {as_of} THEN 'not_reached'
 WHEN provider_error_count > 0 THEN 'provider_error' WHEN unattempted_count + attempted_count > 0 THEN 'backfill_candidate'
 WHEN known_no_data_count = missing_count THEN 'provider_exhausted' ELSE 'mixed_incomplete' END""".format(as_of=AS_OF_SQL)
_AUDIT = f"""(SELECT r.lockup_id, r.security_id, r.event_date, t.session AS t5_session, {_READY} AS readiness, coalesce(t.session <= {AS_OF_SQL}, NULL) AS reached, d.* EXCLUDE (security_id, obs_ix)
 FROM {_ROWS} r LEFT JOIN cal ON day = event_date LEFT JOIN ses t ON t.ix = next_ix - 5 LEFT JOIN {_DIAG} d ON d.security_id = r.security_id AND d.obs_ix = next_ix - 5)"""


@register("m5_readiness", f"SELECT readiness, count(*) AS windows FROM {_AUDIT} GROUP BY 1")
def readiness(w):
    rows_ = audit(w, primary_lockup_only=False, classification_status=None)
    return rows_.groupBy("readiness").agg(F.count(F.lit(1)).alias("windows"))


@register("m6_t5_detail", f"SELECT lockup_id, security_id, t5_session, readiness, status, listing FROM {_AUDIT}")
def detail(w):
    rows_ = audit(w, primary_lockup_only=False, classification_status=None)
    listing = F.array_join(F.transform("session_classifications", lambda e: e["classification"]), ",")
    return rows_.select("lockup_id", "security_id", "t5_session", "readiness", "status", listing.alias("listing"))


@register("m7_t5_summary", f"""
 SELECT count(*) AS selected_lockups, count(event_date) AS audited_windows, count(*) FILTER (event_date IS NULL) AS skipped_no_event_date, count(*) FILTER (reached) AS reached_t5_windows,
  count(*) FILTER (readiness = 'not_reached') AS not_reached_t5_windows, count(*) FILTER (readiness = 'complete') AS complete_windows,
  count(*) FILTER (reached AND readiness <> 'complete') AS incomplete_reached_windows, sum(required_count)::BIGINT AS total_required_sessions, sum(present_count)::BIGINT AS total_present_sessions,
  sum(missing_count)::BIGINT AS total_missing_sessions, sum(known_no_data_count)::BIGINT AS known_no_data_sessions, sum(provider_error_count)::BIGINT AS provider_error_sessions,
  sum(attempted_count)::BIGINT AS attempted_missing_sessions, sum(unattempted_count)::BIGINT AS unattempted_retryable_sessions, sum(attempted_count + unattempted_count)::BIGINT AS retryable_sessions,
  sum(future_count)::BIGINT AS future_not_reached_sessions, count(*) FILTER (readiness = 'provider_exhausted') AS provider_exhausted_windows,
  count(*) FILTER (readiness = 'provider_error') AS provider_error_windows, count(*) FILTER (readiness = 'backfill_candidate') AS backfill_candidate_windows,
  count(*) FILTER (readiness = 'mixed_incomplete') AS mixed_incomplete_windows FROM {_AUDIT}""")
def audit_summary(w):
    return rd.t5_summary(audit(w, primary_lockup_only=False, classification_status=None))
