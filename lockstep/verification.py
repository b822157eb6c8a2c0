"""Independent SQL for the registered queries, in DuckDB's dialect.

``CTES`` holds the shared building blocks; ``sql(body)`` prefixes a body with the
blocks it mentions.  The formulations differ on purpose from the Spark plans: range
joins, scaffolds and correlated filters instead of probes and frames.
"""
from __future__ import annotations

import re

CTES: dict[str, str] = {}

# ---------------------------------------------------------------- calendar
CTES["cal_years"] = """
 SELECT y, make_date(y, m, d) AS easter FROM (
  SELECT y, (h + l - 7*mm + 114) // 31 AS m, (h + l - 7*mm + 114) % 31 + 1 AS d FROM (
   SELECT *, (a + 11*h + 22*l) // 451 AS mm FROM (
    SELECT *, (32 + 2*e + 2*i - h - k) % 7 AS l FROM (
     SELECT *, (19*a + b - d4 - g + 15) % 30 AS h FROM (
      SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c, (y // 100) // 4 AS d4, (y // 100) % 4 AS e,
       (y // 100 - (y // 100 + 8) // 25 + 1) // 3 AS g, (y % 100) // 4 AS i, (y % 100) % 4 AS k
      FROM (SELECT CAST(unnest(range(1990, 2036)) AS INT) AS y))))))
"""
CTES["cal"] = """
 SELECT day, open AS is_session, CASE WHEN open THEN cum END AS ix, cum AS prev_ix,
  cum + CASE WHEN open THEN 0 ELSE 1 END AS next_ix
 FROM (SELECT day, open, CAST(sum(CASE WHEN open THEN 1 ELSE 0 END) OVER (ORDER BY day) AS INT) AS cum FROM (
  SELECT day, NOT (w IN (0, 6) OR (m = 1 AND (d = 1 OR (d = 2 AND w = 1)))
   OR (m = 1 AND w = 1 AND d BETWEEN 15 AND 21 AND y >= 1998) OR (m = 2 AND w = 1 AND d BETWEEN 15 AND 21)
   OR day = easter - 2 OR (m = 5 AND w = 1 AND d >= 25)
   OR (y >= 2022 AND m = 6 AND (d = 19 OR (d = 18 AND w = 5) OR (d = 20 AND w = 1)))
   OR (m = 7 AND (d = 4 OR (d = 3 AND w = 5) OR (d = 5 AND w = 1)))
   OR (m = 9 AND w = 1 AND d <= 7) OR (m = 11 AND w = 4 AND d BETWEEN 22 AND 28)
   OR (m = 12 AND (d = 25 OR (d = 24 AND w = 5) OR (d = 26 AND w = 1)))
   OR day IN ('1994-04-27','2001-09-11','2001-09-12','2001-09-13','2001-09-14','2004-06-11','2007-01-02',
              '2012-10-29','2012-10-30','2018-12-05','2025-01-09')) AS open
  FROM (SELECT *, dayofweek(day) AS w, month(day) AS m, dayofmonth(day) AS d, year(day) AS y
        FROM (SELECT CAST(unnest(generate_series(DATE '1990-01-01', DATE '2035-12-31', INTERVAL 1 DAY)) AS DATE) AS day))
  JOIN cal_years USING (y)))
"""
CTES["ses"] = "SELECT ix, day AS session FROM cal WHERE is_session"

# ---------------------------------------------------------------- domain views
CTES["prices"] = """
 SELECT security_id, trade_date, (lo + (n*7 + volume) % (hi-lo+1))/100.0::DOUBLE AS open, hi/100.0::DOUBLE AS high,
  lo/100.0::DOUBLE AS low, (lo + total % (hi-lo+1))/100.0::DOUBLE AS close, volume,
  CASE WHEN security_id % 10 = 3 THEN 'secondary' ELSE 'primary' END AS provider
 FROM (SELECT security_id, trade_date, min(cents) AS lo, max(cents) AS hi, CAST(sum(cents) AS BIGINT) AS total,
   CAST(sum(size) AS BIGINT) AS volume, count(*) AS n
  FROM (SELECT unnest([1 + l_partkey % 3, 100 + l_partkey % 25, 1000 + l_suppkey]) AS security_id,
    CAST(l_shipdate AS DATE) + 1 AS trade_date,
    2000 + CAST(round(l_discount*100) AS BIGINT)*20 + CAST(l_quantity AS BIGINT)*2 AS cents,
    CAST(l_quantity AS BIGINT) AS size FROM lineitem) GROUP BY ALL)
"""
CTES["numbered"] = """
 SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY trade_date) AS bn,
  count(*) OVER (PARTITION BY security_id) AS stored,
  max(trade_date) OVER (PARTITION BY security_id) AS latest FROM prices
"""
CTES["sec"] = """
 SELECT security_id, CASE WHEN security_id >= 1000 AND security_id % 10 = 9 THEN security_id - 1 ELSE security_id END AS company_id,
  'T' || security_id AS ticker, CASE WHEN security_id % 2 = 0 THEN 'NYSE' ELSE 'NASDAQ' END AS exchange,
  'sec_company' AS source, CASE WHEN security_id % 14 <> 0 THEN 'T' || security_id END AS provider_symbol,
  security_id % 13 <> 5 AS is_primary
 FROM (SELECT DISTINCT unnest([1 + p_partkey % 3, 100 + p_partkey % 25]) AS security_id FROM part
       UNION ALL SELECT 1000 + s_suppkey FROM supplier)
"""
CTES["comp"] = """
 SELECT DISTINCT company_id, lpad(CAST(company_id AS VARCHAR), 10, '0') AS cik, 'Company ' || company_id AS name,
  CASE WHEN company_id % 19 <> 0 THEN 'T' || company_id END AS ticker,
  CASE WHEN company_id % 2 = 0 THEN 'NYSE' ELSE 'NASDAQ' END AS exchange FROM sec
"""
CTES["lock"] = """
 SELECT *, coalesce(stated_expiration_date, calculated_expiration_date) AS event_date,
  CASE WHEN stated_expiration_date IS NOT NULL THEN 'stated' WHEN calculated_expiration_date IS NOT NULL THEN 'calculated' END AS event_date_source
 FROM (SELECT o_orderkey AS lockup_id, CASE WHEN s >= 1000 AND s % 10 = 9 THEN s - 1 ELSE s END AS ipo_id, o_orderkey AS filing_id,
   CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN CAST(o_orderdate AS DATE) END AS stated_expiration_date,
   CASE WHEN substr(o_orderpriority,1,1) IN ('2','3','4') THEN CAST(o_orderdate AS DATE) + 180 END AS calculated_expiration_date,
   CASE WHEN o_orderkey % 5 = 0 THEN 90 ELSE 180 END AS duration_days,
   ['existing_stockholders','pre_ipo_investors','selling_stockholders','directors_officers','employees','unknown'][o_orderkey % 6 + 1] AS holder_group,
   CASE WHEN o_orderstatus = 'P' THEN 'company_lockup' ELSE 'underwriter_lockup' END AS lockup_type,
   [0.97,0.92,0.82][o_orderkey % 3 + 1]::DOUBLE AS confidence, 1000000 + o_orderkey % 1000 * 100 AS shares_locked
  FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN 1 + o_custkey % 3 WHEN o_orderkey % 4 = 1 THEN 100 + o_custkey % 25
        ELSE 1000 + o_custkey // 15 END AS s FROM orders))
"""
CTES["ipo"] = """
 SELECT ipo_id, company_id, listed - 90 AS first_filing_date, CASE WHEN ipo_id % 23 <> 0 THEN listed END AS ipo_date,
  CASE WHEN ipo_id % 7 = 0 THEN NULL WHEN ipo_id % 11 = 0 THEN 0.0 ELSE 20 + ipo_id % 5 * 0.5 END::DOUBLE AS ipo_price,
  ps::DOUBLE AS primary_shares, ss::DOUBLE AS secondary_shares,
  CASE WHEN ipo_id % 17 = 0 THEN 0 ELSE ps + coalesce(ss, 0) END::DOUBLE AS shares_offered, (ps*20)::DOUBLE AS deal_size,
  (5000000 + ipo_id % 100 * 10000)::DOUBLE AS shares_outstanding_post_ipo,
  CASE WHEN ipo_id % 9 = 4 THEN 'needs_review' ELSE 'classified' END AS classification_status,
  CASE WHEN ipo_id % 8 = 5 THEN 'spac' ELSE 'operating_company_ipo' END AS candidate_type,
  CASE WHEN ipo_id % 10 = 7 THEN 'filed' ELSE 'priced' END AS offering_status,
  CASE WHEN ipo_id % 12 <> 0 THEN fl END AS primary_lockup_id,
  CASE WHEN ipo_id % 12 <> 0 AND ipo_id % 15 <> 0 THEN fd END AS primary_lockup_expiration_date
 FROM (SELECT company_id AS ipo_id, company_id, DATE '1995-01-02' + CAST(company_id % 60 AS INT) AS listed,
   1000000 + company_id % 13 * 1000 AS ps, CASE WHEN company_id % 6 <> 0 THEN company_id % 4 * 250000 END AS ss FROM comp)
 LEFT JOIN (SELECT ipo_id, min(lockup_id) AS fl, arg_min(event_date, lockup_id) AS fd FROM lock WHERE event_date IS NOT NULL GROUP BY 1) USING (ipo_id)
"""
CTES["prim"] = "SELECT company_id, min(security_id) AS security_id FROM sec WHERE is_primary GROUP BY 1"
CTES["att"] = """
 SELECT event_id AS attempt_id, CASE WHEN event_id % 4 = 0 THEN 1 + user_id % 3 WHEN event_id % 4 = 1 THEN 100 + user_id % 25
   ELSE 1000 + user_id * 2 // 3 END AS security_id, CASE WHEN event_id % 6 = 0 THEN 'secondary' ELSE 'primary' END AS provider,
  DATE '1995-01-02' + CAST(event_id * 37 % 2450 AS INT) AS requested_start_date,
  DATE '1995-01-02' + CAST(event_id * 37 % 2450 AS INT) + CAST(event_id % 30 AS INT) AS requested_end_date,
  CASE event_type WHEN 'view' THEN 'success' WHEN 'click' THEN 'partial' WHEN 'error' THEN 'error' ELSE 'no_data' END AS status,
  ts AS attempted_at, CAST(floor(value) AS INT) AS bars_returned FROM events
"""
CTES["issuer"] = """
 SELECT c_custkey AS company_id, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik,
  c_name || CASE c_custkey % 11 WHEN 3 THEN ' Acquisition Corp' WHEN 7 THEN ' Growth Fund' ELSE ' Inc' END AS name,
  CASE WHEN c_custkey % 5 <> 0 THEN 'c' || c_custkey END AS ticker, CASE WHEN c_custkey % 2 = 0 THEN 'NYSE' END AS exchange FROM customer
"""
CTES["filing"] = """
 SELECT *, 'edgar/data/' || company_id || '/' || accession_number || '.txt' AS filing_path FROM (
  SELECT o_orderkey AS filing_id, o_custkey AS company_id,
   ['S-1','S-1/A','EFFECT','424B4','8-A12B','10-Q','F-1','RW','8-K','424B4','s-1','10-K'][o_orderkey % 12 + 1] AS form_type,
   CAST(o_orderdate AS DATE) AS filed_at,
   lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-' || strftime(o_orderdate, '%y') || '-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') AS accession_number
  FROM orders)
"""
CTES["cand"] = """
 SELECT company_id + 10 AS ipo_id, company_id,
  CASE WHEN company_id % 4 = 1 THEN DATE '1996-01-01' + CAST(company_id % 900 AS INT) END AS first_filing_date,
  CASE WHEN company_id % 3 = 0 THEN 'priced' ELSE 'unknown' END AS offering_status FROM issuer
"""

# ---------------------------------------------------------------- events and lineages
CTES["ev"] = """
 SELECT ipo_id, lockup_id, security_id, event_date, event_date_source, ipo_date, ipo_price, primary_shares,
  secondary_shares, shares_offered, deal_size, duration_days AS lockup_duration_days,
  holder_group AS lockup_holder_group, lockup_type, confidence AS lockup_confidence
 FROM lock JOIN ipo USING (ipo_id) JOIN prim USING (company_id) WHERE event_date IS NOT NULL
"""
CTES["aligned"] = """
 SELECT p.security_id, p.event_date, b.bn AS event_bn, b.trade_date AS event_trade_date, b.stored, b.latest
 FROM (SELECT DISTINCT security_id, event_date FROM ev) p ASOF LEFT JOIN numbered b
  ON b.security_id = p.security_id AND b.trade_date >= p.event_date
"""
_r = ",\n".join(f"close / nullif(lag(close, {n}) OVER w, 0) - 1 AS return_{n}d" for n in (5, 10, 20, 40))
_v = ",\n".join(
    f"CASE WHEN bn >= {n} THEN avg(volume) OVER (w ROWS {n-1} PRECEDING) END AS avg_volume_{n}d, "
    f"CASE WHEN bn > {n} THEN stddev_samp(r) OVER (w ROWS {n-1} PRECEDING) * sqrt(252) END AS realized_vol_{n}d"
    for n in (5, 20, 40))
CTES["feat"] = f"""
 SELECT *, avg_volume_5d / nullif(avg_volume_20d, 0) AS volume_ratio_5d_to_20d,
  avg_down_day_volume_20d / nullif(avg_up_day_volume_20d, 0) AS down_up_volume_ratio_20d FROM (
 SELECT *, max(high) OVER (w ROWS UNBOUNDED PRECEDING) AS post_ipo_high_to_date,
  min(low) OVER (w ROWS UNBOUNDED PRECEDING) AS post_ipo_low_to_date, {_r}, {_v},
  CASE WHEN bn >= 5 THEN avg(close*volume) OVER (w ROWS 4 PRECEDING) END AS avg_dollar_volume_5d,
  CASE WHEN bn >= 20 THEN avg(close*volume) OVER (w ROWS 19 PRECEDING) END AS avg_dollar_volume_20d,
  CASE WHEN bn >= 21 THEN avg(CASE WHEN close > pc THEN volume END) OVER (w ROWS 19 PRECEDING) END AS avg_up_day_volume_20d,
  CASE WHEN bn >= 21 THEN avg(CASE WHEN close < pc THEN volume END) OVER (w ROWS 19 PRECEDING) END AS avg_down_day_volume_20d,
  CASE WHEN bn >= 21 THEN avg((high-low)/nullif(pc,0)) OVER (w ROWS 19 PRECEDING) END AS avg_daily_range_20d
 FROM (SELECT *, close/nullif(pc,0) - 1 AS r FROM (SELECT *, lag(close) OVER (PARTITION BY security_id ORDER BY trade_date) AS pc FROM numbered))
 WINDOW w AS (PARTITION BY security_id ORDER BY trade_date))
"""
RELATIVE = """
 round(close/nullif(ipo_price,0)-1,10) AS return_from_ipo_price,
 round(close/nullif(post_ipo_high_to_date,0)-1,10) AS drawdown_from_post_ipo_high,
 round((close-post_ipo_low_to_date)/nullif(post_ipo_high_to_date-post_ipo_low_to_date,0),10) AS position_in_post_ipo_range,
 CASE WHEN post_ipo_high_to_date > ipo_price THEN round((close-ipo_price)/(post_ipo_high_to_date-ipo_price),10) END AS ipo_gain_retention,
 round(secondary_shares/nullif(shares_offered,0),10) AS secondary_share_fraction
"""
PRICE = ("return_5d", "return_10d", "return_20d", "return_40d", "realized_vol_5d", "realized_vol_20d",
         "realized_vol_40d", "avg_daily_range_20d", "volume_ratio_5d_to_20d", "down_up_volume_ratio_20d")
VOLUME = ("avg_volume_5d", "avg_volume_20d", "avg_volume_40d", "avg_dollar_volume_5d",
          "avg_dollar_volume_20d", "avg_up_day_volume_20d", "avg_down_day_volume_20d")
_stored = ", ".join([f"round({c},10) AS {c}" for c in PRICE] + [f"round({c},4) AS {c}" for c in VOLUME])
CTES["snap1"] = f"""
 SELECT ev.*, a.event_trade_date, k AS observation_offset, f.trade_date AS observation_date, close,
  post_ipo_high_to_date, post_ipo_low_to_date, {_stored}, {RELATIVE}, f.trade_date AS data_cutoff_date,
  abs(k) AS trading_sessions_to_event, f.trade_date - ipo_date AS days_since_ipo,
  f.bn - 1 AS trading_sessions_since_first_trade, f.bn AS available_history_sessions, '1' AS snapshot_version
 FROM ev JOIN aligned a ON a.security_id = ev.security_id AND a.event_date = ev.event_date,
  (SELECT unnest([-60,-40,-20,-10,-5,-1]) AS k) JOIN feat f ON f.security_id = ev.security_id AND f.bn = event_bn + k
"""
_post = ", ".join([f"round(lead(close,{n}) OVER w/nullif(close,0)-1,10) AS post_{n}d_return" for n in (1, 5, 10, 20, 40)]
                  + [f"round(close/nullif(lag(close,{n}) OVER w,0)-1,10) AS pre_{n}d_return" for n in (20, 10, 5, 1)])
_mfe = ", ".join(
    f"CASE WHEN stored-bn >= {n} THEN round(greatest(0.0,(close-min(low) OVER (w ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING))/close),10) END AS bearish_mfe_{n}d, "
    f"CASE WHEN stored-bn >= {n} THEN round(greatest(0.0,(max(high) OVER (w ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)-close)/close),10) END AS bearish_mae_{n}d"
    for n in (5, 10, 20, 40))
_pv = ", ".join(
    f"CASE WHEN stored-bn >= {n} THEN round(avg(volume) OVER (w ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)/nullif(base,0),10) END AS post_{n}d_avg_volume_ratio"
    for n in (5, 10))
CTES["outbar"] = f"""
 SELECT security_id, bn, stored-bn AS max_post_event_session_available, open AS event_open, high AS event_high, low AS event_low,
  close AS event_close, volume AS event_volume, pc AS previous_close, round(open/pc-1,10) AS event_gap_return,
  round(close/open-1,10) AS event_intraday_return, round(close/pc-1,10) AS event_close_return, {_post}, {_mfe},
  round(base,4) AS baseline_avg_volume, round(volume/nullif(base,0),10) AS event_volume_ratio, {_pv},
  lead(trade_date, 20) OVER w AS outcome_20_date
 FROM (SELECT *, lag(close) OVER (PARTITION BY security_id ORDER BY bn) AS pc, CASE WHEN bn >= 21 THEN
   avg(volume) OVER (PARTITION BY security_id ORDER BY bn ROWS BETWEEN 20 PRECEDING AND 6 PRECEDING) END AS base FROM numbered)
 WINDOW w AS (PARTITION BY security_id ORDER BY bn)
"""
CTES["outc"] = """
 SELECT ev.ipo_id, ev.lockup_id, ev.security_id, ev.event_date, ev.event_date_source, a.event_trade_date, l.latest AS as_of_date,
  CASE WHEN a.event_bn IS NULL THEN 'upcoming' WHEN max_post_event_session_available = 0 THEN 'event_today'
   WHEN max_post_event_session_available >= 40 THEN 'complete' ELSE 'post_event_incomplete' END AS event_status,
  o.* EXCLUDE (security_id, bn), '1' AS outcome_version
 FROM ev JOIN aligned a ON a.security_id = ev.security_id AND a.event_date = ev.event_date
 JOIN (SELECT security_id, max(trade_date) AS latest FROM prices GROUP BY 1) l ON l.security_id = ev.security_id
 LEFT JOIN outbar o ON o.security_id = ev.security_id AND o.bn = a.event_bn
"""
# v2 by scaffold: every distinct observation is joined to its 41 sessions.
CTES["obs2"] = """
 SELECT ev.*, k AS observation_offset, c.next_ix AS event_ix, c.next_ix + k AS ix
 FROM ev JOIN cal c ON c.day = ev.event_date, (SELECT unnest([-60,-40,-20,-10,-5,-1]) AS k)
"""
CTES["sbar"] = """
 SELECT p.security_id, c.ix, p.* EXCLUDE (security_id), lag(close) OVER (PARTITION BY security_id ORDER BY c.ix) AS pc
 FROM prices p JOIN cal c ON c.day = p.trade_date WHERE c.is_session
"""
CTES["first2"] = """
 SELECT security_id, min(trade_date) AS first_date, max(trade_date) AS latest FROM prices GROUP BY 1
"""
_w2 = []
for n in (5, 10, 20, 40):
    _w2.append(f"count(*) FILTER (age <= {n}) = {n+1} AS c{n}, max(close) FILTER (age = 0) / max(close) FILTER (age = {n}) - 1 AS r{n}")
    _w2.append(f"count(*) FILTER (age < {n}) = {n} AS n{n}, avg(volume) FILTER (age < {n}) AS av{n}, "
               f"stddev_samp(close/nullif(pc,0)-1) FILTER (age < {n}) * sqrt(252) AS sd{n}, avg(close*volume) FILTER (age < {n}) AS dv{n}")
CTES["win2"] = f"""
 SELECT o.security_id, o.ix, count(b.ix) AS present, count(*) FILTER (age <= 20) AS present_21,
  max(close) FILTER (age = 0) AS close, {', '.join(_w2)},
  count(*) FILTER (age <= 20) = 21 AS c21, avg(volume) FILTER (age < 20 AND close > pc) AS up20,
  avg(volume) FILTER (age < 20 AND close < pc) AS dn20, avg((high-low)/nullif(pc,0)) FILTER (age < 20) AS rg20
 FROM (SELECT DISTINCT security_id, ix FROM obs2) o
 LEFT JOIN (SELECT *, 0 AS z FROM sbar) b ON b.security_id = o.security_id AND b.ix BETWEEN o.ix - 40 AND o.ix,
 LATERAL (SELECT o.ix - b.ix AS age) GROUP BY 1, 2
"""
CTES["since2"] = """
 SELECT o.security_id, o.ix, fc.is_session AS first_ok, fc.ix AS first_ix, cu.n AS bars_since, cu.hi, cu.lo, f.latest
 FROM (SELECT DISTINCT security_id, ix FROM obs2) o LEFT JOIN first2 f ON f.security_id = o.security_id
 LEFT JOIN cal fc ON fc.day = f.first_date
 ASOF LEFT JOIN (SELECT security_id, ix, row_number() OVER w AS n, max(high) OVER w AS hi, min(low) OVER w AS lo FROM sbar
  WINDOW w AS (PARTITION BY security_id ORDER BY ix)) cu ON cu.security_id = o.security_id AND cu.ix <= o.ix
"""
_f2 = ", ".join(
    [f"CASE WHEN ok AND c{n} THEN round(r{n},10) END AS return_{n}d" for n in (5, 10, 20, 40)]
    + [f"CASE WHEN ok AND c{n} THEN round(sd{n},10) END AS realized_vol_{n}d, CASE WHEN ok AND n{n} THEN round(av{n},4) END AS avg_volume_{n}d" for n in (5, 20, 40)]
    + [f"CASE WHEN ok AND n{n} THEN round(dv{n},4) END AS avg_dollar_volume_{n}d" for n in (5, 20)])
CTES["snap2"] = f"""
 SELECT * EXCLUDE (close, hi, lo), {RELATIVE} FROM (
 SELECT o.* EXCLUDE (event_ix, ix), es.session AS event_trade_date, os.session AS observation_date, hs.session AS expected_history_start_date,
  os.session AS expected_history_end_date, 41 AS expected_history_sessions, w.present AS available_history_sessions,
  41 - w.present AS missing_history_sessions, least(os.session, coalesce(latest, DATE '0001-01-01')) AS data_cutoff_date,
  abs(observation_offset) AS trading_sessions_to_event, os.session - ipo_date AS days_since_ipo,
  CASE WHEN ok AND first_ok THEN o.ix - first_ix END AS trading_sessions_since_first_trade,
  CASE WHEN ok THEN w.close END AS close, CASE WHEN ok AND rc THEN hi END AS post_ipo_high_to_date, CASE WHEN ok AND rc THEN lo END AS post_ipo_low_to_date,
  hi, lo, {_f2},
  CASE WHEN ok AND c21 THEN round(up20,4) END AS avg_up_day_volume_20d, CASE WHEN ok AND c21 THEN round(dn20,4) END AS avg_down_day_volume_20d,
  CASE WHEN ok AND c21 THEN round(rg20,10) END AS avg_daily_range_20d,
  CASE WHEN ok AND n5 AND n20 THEN round(av5/nullif(av20,0),10) END AS volume_ratio_5d_to_20d,
  CASE WHEN ok AND c21 THEN round(dn20/nullif(up20,0),10) END AS down_up_volume_ratio_20d,
  CASE WHEN NOT ok THEN 'unavailable' WHEN rc AND c5 AND c10 AND c20 AND c40 THEN 'complete' ELSE 'partial' END AS snapshot_status,
  CASE WHEN os.session > coalesce(latest, DATE '0001-01-01') THEN 'observation_not_reached' WHEN NOT ok THEN 'missing_observation_bar'
   WHEN NOT (rc AND c5 AND c10 AND c20 AND c40) THEN 'missing_feature_history' END AS unavailable_reason,
  'XNYS' AS calendar_id, 'rules' AS calendar_provider, '1' AS calendar_version, '2' AS snapshot_version
 FROM obs2 o JOIN (SELECT *, coalesce(first_ok AND bars_since = ix - first_ix + 1, FALSE) AS rc FROM since2) s ON s.security_id = o.security_id AND s.ix = o.ix
 JOIN win2 w ON w.security_id = o.security_id AND w.ix = o.ix
 JOIN ses es ON es.ix = o.event_ix JOIN ses os ON os.ix = o.ix JOIN ses hs ON hs.ix = o.ix - 40,
 LATERAL (SELECT coalesce(os.session <= coalesce(latest, DATE '0001-01-01') AND w.close IS NOT NULL, FALSE) AS ok)),
 LATERAL (SELECT close AS _c)
"""
CTES["snap2"] = CTES["snap2"].replace("* EXCLUDE (close, hi, lo), ", "* EXCLUDE (hi, lo, _c), ")

# ---------------------------------------------------------------- backtest dataset
CTES["ds"] = """
 SELECT s.*, c.name AS company_name, c.ticker, i.primary_lockup_id, i.primary_lockup_expiration_date AS lockup_expiration_date, i.shares_outstanding_post_ipo,
  o.* EXCLUDE (ipo_id, lockup_id, security_id, event_date, event_date_source, event_trade_date), s.lockup_id = i.primary_lockup_id AND i.primary_lockup_expiration_date IS NOT NULL AS is_primary_event
 FROM snap1 s JOIN ipo i ON i.ipo_id = s.ipo_id JOIN comp c ON c.company_id = i.company_id LEFT JOIN outc o ON o.lockup_id = s.lockup_id AND o.security_id = s.security_id
 WHERE classification_status = 'classified' AND candidate_type = 'operating_company_ipo' AND offering_status = 'priced'
"""
CTES["pairs"] = """
 SELECT coalesce(a.lockup_id, b.lockup_id) AS lockup_id, coalesce(a.security_id, b.security_id) AS security_id, coalesce(a.observation_offset, b.observation_offset) AS observation_offset,
  a.lockup_id IS NOT NULL AS in1, b.lockup_id IS NOT NULL AS in2, a.observation_date = b.observation_date AS same_obs, a.event_trade_date = b.event_trade_date AS same_evt,
  b.snapshot_status AS st, b.unavailable_reason AS rs, b.expected_history_sessions AS eh, b.missing_history_sessions AS mh, a, b
 FROM snap1 a FULL JOIN snap2 b ON a.lockup_id = b.lockup_id AND a.security_id = b.security_id AND a.observation_offset = b.observation_offset
"""
_AUDITED = ("close", "return_5d", "return_10d", "return_20d", "return_40d", "realized_vol_5d", "realized_vol_20d",
            "realized_vol_40d", "avg_volume_5d", "avg_volume_20d", "avg_volume_40d", "avg_dollar_volume_5d",
            "avg_dollar_volume_20d", "volume_ratio_5d_to_20d", "post_ipo_high_to_date", "post_ipo_low_to_date",
            "drawdown_from_post_ipo_high", "position_in_post_ipo_range", "ipo_gain_retention")
CTES["featpairs"] = """
 SELECT *, CASE WHEN x IS NULL AND y IS NULL THEN 'both_null' WHEN x IS NULL THEN 'v1_null_v2_value'
  WHEN y IS NULL THEN CASE WHEN ranged AND st = 'complete' THEN 'v1_value_v2_null' ELSE 'v1_value_v2_null_incomplete_history' END
  WHEN abs(x - y) <= 1e-9 + 1e-7 * abs(x) THEN 'match'
  WHEN same_obs AND same_evt AND (NOT ranged OR st = 'complete') THEN 'numeric_mismatch_complete_history' ELSE 'numeric_mismatch_other' END AS state FROM (
 """ + " UNION ALL ".join(
    f"SELECT lockup_id, security_id, observation_offset, same_obs, same_evt, st, '{c}' AS feature, a.{c}::DOUBLE AS x, b.{c}::DOUBLE AS y, {str(i >= 14).upper()} AS ranged FROM pairs WHERE in1 AND in2"
    for i, c in enumerate(_AUDITED)) + ")"
CTES["classed"] = """
 SELECT p.* EXCLUDE (a, b), CASE WHEN NOT in1 THEN 'no_v1_snapshot' WHEN NOT in2 THEN 'no_v2_snapshot' WHEN NOT same_obs THEN 'observation_session_mismatch' WHEN NOT same_evt THEN 'event_session_mismatch'
  WHEN rs = 'observation_not_reached' THEN 'v2_observation_not_reached' WHEN rs = 'missing_observation_bar' THEN 'v2_missing_observation_bar'
  WHEN broken THEN 'numeric_feature_mismatch_complete_history' WHEN differs THEN 'sparse_history_feature_mismatch' WHEN st = 'partial' THEN 'v2_partial_missing_feature_history' ELSE 'exact_match' END AS classification, differs
 FROM pairs p LEFT JOIN (SELECT lockup_id, security_id, observation_offset, bool_or(state = 'numeric_mismatch_complete_history') AS broken, bool_or(state NOT IN ('match', 'both_null')) AS differs
  FROM featpairs GROUP BY 1, 2, 3) f ON f.lockup_id = p.lockup_id AND f.security_id = p.security_id AND f.observation_offset = p.observation_offset
"""
CTES["sess"] = """
 SELECT s.lockup_id, s.security_id, s.observation_offset, s.event_trade_date, s.observation_date, s.return_20d, s.realized_vol_20d, e.session AS cevt, o.session AS cobs, c.next_ix + s.observation_offset AS obs_ix,
  (SELECT count(*) FROM sbar b WHERE b.security_id = s.security_id AND b.ix BETWEEN c.next_ix + s.observation_offset AND c.next_ix) AS have,
  abs(s.observation_offset) + 1 AS expected, coalesce(ob.bn = eb.bn + s.observation_offset, FALSE) AS reproduced, xb.trade_date IS NULL AS event_missing
 FROM snap1 s JOIN cal c ON c.day = s.event_date JOIN ses e ON e.ix = c.next_ix JOIN ses o ON o.ix = c.next_ix + s.observation_offset
 LEFT JOIN numbered ob ON ob.security_id = s.security_id AND ob.trade_date = s.observation_date LEFT JOIN numbered eb ON eb.security_id = s.security_id AND eb.trade_date = s.event_trade_date
 LEFT JOIN prices xb ON xb.security_id = s.security_id AND xb.trade_date = e.session
"""
CTES["sessp"] = """
 SELECT *, CASE WHEN event_trade_date = cevt AND observation_date = cobs THEN 'exact_match' WHEN event_trade_date <> cevt AND observation_date <> cobs THEN 'event_and_observation_mismatch'
  WHEN event_trade_date <> cevt THEN 'event_session_mismatch' WHEN have < expected AND reproduced THEN 'observation_session_mismatch_sparse_history' ELSE 'observation_session_mismatch_unexplained' END AS mismatch_type FROM sess
"""

MATERIALIZED = {"ds", "pairs", "featpairs", "classed", "sess", "cal", "prices", "numbered", "lock", "ipo", "ev", "aligned", "feat", "outbar", "obs2", "sbar", "win2",
                "since2", "snap1", "snap2", "outc"}


def sql(body: str) -> str:
    """Prefix ``body`` with every building block it needs, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"[a-z_]\w*", text):
            if word in CTES and word not in order and CTES[word] is not text:
                visit(CTES[word])
                if word not in order:
                    order.append(word)

    visit(body)
    blocks = [f"{name} AS {'MATERIALIZED ' if name in MATERIALIZED else ''}({CTES[name].strip()})" for name in order]
    return f"WITH {', '.join(blocks)}\n{body}" if blocks else body
