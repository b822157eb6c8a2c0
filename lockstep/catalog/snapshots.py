"""Snapshot, outcome and market-summary queries, one per feature family."""
from __future__ import annotations

from pyspark.sql import functions as F

from lockstep.catalog import register
from lockstep.catalog.sessions import events_of
from lockstep.functions.numeric import rounded
from lockstep.operators import market_summary as ms
from lockstep.operators import outcomes as oc
from lockstep.operators import snapshots as sn

KEY = ("lockup_id", "observation_offset")

V1_FAMILIES = {
    "f1_returns": ("return_5d", "return_10d", "return_20d", "return_40d"),
    "f2_average_volume": ("avg_volume_5d", "avg_volume_20d", "avg_volume_40d"),
    "f3_realized_volatility": ("realized_vol_5d", "realized_vol_20d", "realized_vol_40d"),
    "f4_dollar_volume": ("avg_dollar_volume_5d", "avg_dollar_volume_20d"),
    "f5_volume_ratio": ("volume_ratio_5d_to_20d",),
    "f6_up_down_volume": ("avg_up_day_volume_20d", "avg_down_day_volume_20d"),
    "f7_down_up_ratio": ("down_up_volume_ratio_20d",),
    "f8_daily_range": ("avg_daily_range_20d",),
    "f9_running_range": ("post_ipo_high_to_date", "post_ipo_low_to_date"),
    "f10_drawdown": ("drawdown_from_post_ipo_high",),
    "f11_range_position": ("position_in_post_ipo_range",),
    "f12_return_from_price": ("return_from_ipo_price", "close"),
    "f13_gain_retention": ("ipo_gain_retention",),
    "f14_secondary_fraction": ("secondary_share_fraction",),
    "f15_ages": ("days_since_ipo", "trading_sessions_since_first_trade", "available_history_sessions",
                 "trading_sessions_to_event"),
    "f16_identity": ("security_id", "event_date", "event_date_source", "event_trade_date",
                     "observation_date", "data_cutoff_date", "lockup_duration_days",
                     "lockup_holder_group", "lockup_type", "lockup_confidence", "ipo_price",
                     "primary_shares", "deal_size"),
}
V2_FAMILIES = {
    "g1_session_windows": ("return_5d", "return_10d", "return_20d", "return_40d", "realized_vol_20d"),
    "g2_history_sessions": ("expected_history_sessions", "available_history_sessions",
                            "missing_history_sessions", "expected_history_start_date",
                            "expected_history_end_date"),
    "g3_status": ("snapshot_status", "unavailable_reason"),
    "g4_unavailable_rows": ("snapshot_status", "close", "days_since_ipo"),
    "g5_range_completeness": ("post_ipo_high_to_date", "post_ipo_low_to_date",
                              "drawdown_from_post_ipo_high", "position_in_post_ipo_range",
                              "ipo_gain_retention", "return_from_ipo_price"),
    "g6_session_age": ("trading_sessions_since_first_trade",),
    "g7_window_features": ("avg_volume_5d", "avg_volume_20d", "avg_volume_40d",
                           "avg_dollar_volume_5d", "avg_dollar_volume_20d", "realized_vol_5d",
                           "realized_vol_40d", "volume_ratio_5d_to_20d", "avg_up_day_volume_20d",
                           "avg_down_day_volume_20d", "down_up_volume_ratio_20d",
                           "avg_daily_range_20d"),
    "g9_provenance": ("calendar_id", "calendar_provider", "calendar_version", "data_cutoff_date",
                      "observation_date", "event_trade_date", "snapshot_version"),
}
H_FAMILIES = {
    "h1_status": ("event_status", "max_post_event_session_available", "event_trade_date", "as_of_date"),
    "h2_event_bar": ("event_open", "event_high", "event_low", "event_close", "event_volume", "previous_close"),
    "h3_event_returns": ("event_gap_return", "event_intraday_return", "event_close_return"),
    "h4_pre_returns": ("pre_20d_return", "pre_10d_return", "pre_5d_return", "pre_1d_return"),
    "h5_post_returns": ("post_1d_return", "post_5d_return", "post_10d_return", "post_20d_return",
                        "post_40d_return"),
    "h6_bearish_mfe": ("bearish_mfe_5d", "bearish_mfe_10d", "bearish_mfe_20d", "bearish_mfe_40d"),
    "h7_bearish_mae": ("bearish_mae_5d", "bearish_mae_10d", "bearish_mae_20d", "bearish_mae_40d"),
    "h8_baseline_volume": ("baseline_avg_volume",),
    "h9_event_volume_ratio": ("event_volume_ratio",),
    "h10_post_volume_ratio": ("post_5d_avg_volume_ratio", "post_10d_avg_volume_ratio"),
}
_NUMERIC_TEXT = {"event_date_source", "lockup_holder_group", "lockup_type", "snapshot_status",
                 "unavailable_reason", "calendar_id", "calendar_provider", "calendar_version",
                 "snapshot_version", "event_status"}


def _sql_columns(names):
    def one(c):
        if c.endswith(("_date", "_id")) or c in _NUMERIC_TEXT or "sessions" in c or c.startswith("days") \
                or c in ("lockup_duration_days", "event_volume", "observation_offset",
                         "max_post_event_session_available"):
            return c
        return f"round({c}, 6) AS {c}"
    return ", ".join(one(c) for c in names)


def stored_bar(w):
    return sn.stored_bar_snapshots(events_of(w), w.bars())


def by_session(w):
    return sn.session_snapshots(events_of(w), w.bars())


def outcomes(w):
    return oc.event_outcomes(events_of(w), w.bars())


def _family(source, name, key, columns, table):
    @register(name, f"SELECT {_sql_columns(key + columns)} FROM {table}")
    def build(w):
        return rounded(source(w).select(*key, *columns))
    return build


for _name, _columns in V1_FAMILIES.items():
    _family(stored_bar, _name, KEY, _columns, "snap1")
for _name, _columns in V2_FAMILIES.items():
    _family(by_session, _name, KEY, _columns, "snap2")
for _name, _columns in H_FAMILIES.items():
    _family(outcomes, _name, ("lockup_id",), _columns, "outc")


@register("f17_materialise_counts", """
 SELECT observation_offset, count(*) AS snapshots, count(DISTINCT lockup_id) AS lockups, min(observation_date) AS first_date FROM snap1 GROUP BY 1""")
def materialise(w):
    return stored_bar(w).groupBy("observation_offset").agg(
        F.count(F.lit(1)).alias("snapshots"), F.count_distinct("lockup_id").alias("lockups"),
        F.min("observation_date").alias("first_date"))


@register("f18_drop_stale", """
 SELECT snapshot_version, count(*) AS kept FROM (
  SELECT lockup_id, security_id, CASE WHEN lockup_id % 2 = 0 THEN '1' ELSE '2' END AS snapshot_version FROM ev) s
 WHERE snapshot_version = '2' OR NOT EXISTS (SELECT 1 FROM ev e JOIN aligned a ON a.security_id = e.security_id AND a.event_date = e.event_date
  WHERE a.event_bn IS NULL AND e.lockup_id = s.lockup_id) GROUP BY 1""")
def stale(w):
    events = events_of(w)
    stored = events.select("lockup_id", "security_id", F.when(F.col("lockup_id") % 2 == 0, "1")
                           .otherwise("2").alias("snapshot_version"))
    return sn.drop_stale(stored, events, w.bars()).groupBy("snapshot_version").agg(
        F.count(F.lit(1)).alias("kept"))


@register("f19_snapshot_upsert", """
 SELECT coalesce(s.lockup_id, e.lockup_id) AS lockup_id, coalesce(s.observation_offset, -20) AS observation_offset,
  CASE WHEN s.lockup_id IS NULL THEN -1.0 ELSE s.return_20d END AS return_20d, CASE WHEN e.lockup_id IS NOT NULL THEN 'kept' END AS note,
  s.lockup_id IS NOT NULL AND e.lockup_id IS NULL AS created
 FROM snap1 s FULL JOIN ev e ON s.lockup_id = e.lockup_id AND s.security_id = e.security_id AND s.observation_offset = -20""")
def upsert(w):
    """Stored rows of one offset with a column the fresh rows lack, updated by all offsets."""
    fresh = stored_bar(w).select(*sn.SNAPSHOT_KEY, "return_20d")
    old = events_of(w).select("lockup_id", "security_id", F.lit(-20).alias("observation_offset"),
                              F.lit("1").alias("snapshot_version"), F.lit(-1.0).alias("return_20d"), F.lit("kept").alias("note"))
    return sn.merge_by_key(old, fresh, sn.SNAPSHOT_KEY).select(
        "lockup_id", "observation_offset", F.col("return_20d").cast("double").alias("return_20d"), "note", F.col("note").isNull().alias("created"))


@register("f19_upsert_counts", """
 SELECT count(*) FILTER (observation_offset <> -20) AS created, count(*) FILTER (observation_offset = -20) AS updated FROM snap1""")
def upsert_counts(w):
    fresh = stored_bar(w).select(*sn.SNAPSHOT_KEY)
    old = events_of(w).select("lockup_id", "security_id", F.lit(-20).alias("observation_offset"), F.lit("1").alias("snapshot_version"))
    return sn.merge_counts(old, fresh, sn.SNAPSHOT_KEY)


@register("f20_analysis_report", """
 SELECT count(DISTINCT ipo_id) AS ipos_seen, count(*) AS lockups_seen,
  (SELECT count(*) FROM outc WHERE event_trade_date IS NOT NULL) AS events_aligned, (SELECT count(*) FROM snap1) AS snapshots_created,
  0::BIGINT AS snapshots_updated, (SELECT count(*) FROM outc) AS outcomes_created, 0::BIGINT AS outcomes_updated,
  (SELECT count(*) FROM outc WHERE event_status = 'upcoming') AS upcoming,
  (SELECT count(*) FROM outc WHERE event_status NOT IN ('upcoming', 'complete')) AS incomplete,
  (SELECT count(*) FROM outc WHERE event_status = 'complete') AS complete,
  count(*) FILTER (event_date IS NOT NULL AND NOT EXISTS (SELECT 1 FROM prim JOIN (SELECT DISTINCT security_id FROM prices) USING (security_id) WHERE prim.company_id = ipo.company_id)) AS no_market_history,
  count(*) FILTER (event_date IS NULL) AS errors FROM lock JOIN ipo USING (ipo_id)""")
def report(w):
    from lockstep.operators import events as ev
    events, bars = events_of(w), w.bars()
    cohort = ev.with_event_date(w.lockups()).join(w.ipos().select("ipo_id", "company_id"), "ipo_id")
    return oc.analysis_report(cohort, ev.primary_security(w.securities()), bars,
                              sn.stored_bar_snapshots(events, bars), oc.event_outcomes(events, bars))


@register("g8_feature_history_flag", """
 SELECT observation_offset, snapshot_status, count(*) AS n FROM snap2 GROUP BY ALL""")
def history_flag(w):
    return by_session(w).groupBy("observation_offset", "snapshot_status").agg(F.count(F.lit(1)).alias("n"))


@register("g10_as_of_default", """
 SELECT count(*) FILTER (unavailable_reason = 'observation_not_reached') AS not_reached, min(data_cutoff_date) AS first_cutoff,
  max(data_cutoff_date) AS last_cutoff FROM snap2""")
def as_of_default(w):
    return by_session(w).agg(
        F.count_if(F.col("unavailable_reason") == "observation_not_reached").alias("not_reached"),
        F.min("data_cutoff_date").alias("first_cutoff"), F.max("data_cutoff_date").alias("last_cutoff"))


@register("h11_outcome_upsert", """
 SELECT (SELECT count(*) FROM outc WHERE lockup_id % 3 <> 0) AS created, (SELECT count(*) FROM outc WHERE lockup_id % 3 = 0) AS updated""")
def outcome_upsert(w):
    fresh = outcomes(w).select(*oc.OUTCOME_KEY)
    return sn.merge_counts(fresh.where(F.col("lockup_id") % 3 == 0), fresh, oc.OUTCOME_KEY)


@register("i1_first_latest_high", """
 SELECT ipo_id, security_id, f AS first_trade_date, l AS latest_trade_date, round(fo,6) AS first_day_open, round(fc,6) AS first_day_close,
  round(lc,6) AS latest_close, round(hi,6) AS post_ipo_high FROM ipo JOIN sec USING (company_id) JOIN (
  SELECT security_id, min(trade_date) AS f, max(trade_date) AS l, arg_min(open, trade_date) AS fo, arg_min(close, trade_date) AS fc,
   arg_max(close, trade_date) AS lc, max(high) AS hi FROM prices WHERE provider = 'primary' GROUP BY 1) USING (security_id) WHERE is_primary""")
def first_latest_high(w):
    df = ms.market_summary(w.ipos(), w.securities(), w.daily_prices(), "primary")
    money = ("first_day_open", "first_day_close", "latest_close", "post_ipo_high")
    return df.select("ipo_id", "security_id", "first_trade_date", "latest_trade_date",
                     *[F.round(F.col(c).cast("double"), 6).alias(c) for c in money])


@register("i2_relative_returns", """
 SELECT ipo_id, security_id, round((fc - p)/p, 6) AS first_day_close_return_vs_ipo_price, round((lc - p)/p, 6) AS return_from_ipo_price,
  round((lc - hi)/hi, 6) AS drawdown_from_post_ipo_high FROM (SELECT *, nullif(ipo_price, 0) AS p FROM ipo) JOIN sec USING (company_id) JOIN (
  SELECT security_id, arg_min(close, trade_date) AS fc, arg_max(close, trade_date) AS lc, max(high) AS hi FROM prices
  WHERE provider = 'primary' GROUP BY 1) USING (security_id) WHERE is_primary""")
def relative_returns(w):
    df = ms.market_summary(w.ipos(), w.securities(), w.daily_prices(), "primary")
    names = ("first_day_close_return_vs_ipo_price", "return_from_ipo_price", "drawdown_from_post_ipo_high")
    return df.select("ipo_id", "security_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in names])


@register("i3_summary_report", """
 SELECT count(*) AS ipos_seen, count(d.security_id) AS summaries_recomputed, count(*) - count(d.security_id) AS no_stored_bars
 FROM ipo JOIN sec USING (company_id) LEFT JOIN (SELECT DISTINCT security_id FROM prices WHERE provider = 'primary') d USING (security_id) WHERE is_primary""")
def summary_report(w):
    return ms.summary_report(w.ipos(), w.securities(), w.daily_prices(), "primary")
