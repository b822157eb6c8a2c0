"""Backtest dataset assembled from stored snapshots and outcomes."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockstep.constants import STORED_BAR_VERSION
from lockstep.operators.events import CLEAN, cohort_predicate, event_level_limit, promoted_primary

# Column families in export order.
IDENTITY = ("ipo_id", "lockup_id", "security_id", "company_name", "ticker")
FEATURES = (
    "observation_offset", "observation_date", "close", "return_from_ipo_price",
    "return_5d", "return_10d", "return_20d", "return_40d",
    "drawdown_from_post_ipo_high", "position_in_post_ipo_range", "ipo_gain_retention",
    "avg_volume_5d", "avg_volume_20d", "avg_volume_40d", "volume_ratio_5d_to_20d",
    "avg_dollar_volume_5d", "avg_dollar_volume_20d", "down_up_volume_ratio_20d",
    "realized_vol_5d", "realized_vol_20d", "realized_vol_40d", "avg_daily_range_20d",
    "available_history_sessions", "trading_sessions_to_event", "days_since_ipo",
    "lockup_duration_days", "lockup_holder_group", "lockup_type", "lockup_confidence",
    "ipo_price", "primary_shares", "secondary_shares", "shares_offered", "deal_size",
    "secondary_share_fraction", "shares_outstanding_post_ipo", "ipo_date", "lockup_expiration_date")
OUTCOMES = (
    "event_date", "event_trade_date", "event_status", "max_post_event_session_available",
    "event_gap_return", "event_intraday_return", "event_close_return",
    "post_1d_return", "post_5d_return", "post_10d_return", "post_20d_return", "post_40d_return",
    "bearish_mfe_5d", "bearish_mae_5d", "bearish_mfe_10d", "bearish_mae_10d",
    "bearish_mfe_20d", "bearish_mae_20d", "bearish_mfe_40d", "bearish_mae_40d",
    "event_volume_ratio", "post_5d_avg_volume_ratio", "post_10d_avg_volume_ratio")
PROVENANCE = ("snapshot_version", "outcome_version", "event_date_source", "data_cutoff_date")
AVAILABILITY = ("has_ipo_price", "has_20d_history", "has_40d_history",
                "has_post_5d", "has_post_10d", "has_post_20d", "has_post_40d")
CSV_COLUMNS = IDENTITY + FEATURES + OUTCOMES + PROVENANCE + AVAILABILITY
# Columns of the offering, and of the stored value behind each availability flag.
OFFERED = ("company_name", "ticker", "ipo_date", "shares_outstanding_post_ipo", "lockup_expiration_date")
FLAG_SOURCES = {"has_ipo_price": "ipo_price", "has_20d_history": "available_history_sessions",
                "has_40d_history": "available_history_sessions",
                **{f"has_post_{h}d": f"post_{h}d_return" for h in (5, 10, 20, 40)}}


def input_columns(columns) -> tuple[list[str], list[str]]:
    """Columns of the snapshots and of the outcomes that the given columns of the dataset take."""
    wanted = set(columns) | {FLAG_SOURCES[c] for c in columns if c in FLAG_SOURCES}
    own = (*FEATURES, "event_trade_date", "event_date_source", "data_cutoff_date")
    keys = ("ipo_id", "lockup_id", "security_id", "event_date", "observation_offset", "snapshot_version")
    before = [*keys, *[c for c in own if c in wanted and c not in (*keys, *OFFERED)]]
    after = ["lockup_id", "security_id", *[c for c in (*OUTCOMES, "outcome_version") if c in wanted]]
    return before, after


def backtest_dataset(snapshots: DataFrame, outcomes: DataFrame, ipos: DataFrame, companies: DataFrame, *,
                     primary_lockup_only: bool = True, ticker=None, ipo_id=None, limit=None,
                     version: str = STORED_BAR_VERSION, columns=CSV_COLUMNS, **status) -> DataFrame:
    """Repeated-measure rows keyed by (lock-up, offset); filters run before the event limit.

    For some of the ``columns``, the inputs need those that ``input_columns`` names.
    """
    status = status or CLEAN
    offering = ipos.select("ipo_id", "company_id", "classification_status", "candidate_type", "offering_status",
                           "primary_lockup_id", "primary_lockup_expiration_date", "shares_outstanding_post_ipo",
                           F.col("ipo_date").alias("_ipo_date"))
    named = companies.select("company_id", F.col("name").alias("company_name"), "ticker")
    # Offerings and issuers first: the snapshots, which are many more, are dealt once.
    rows = (snapshots.where(F.col("snapshot_version") == version).drop("ipo_date")
            .join(offering.join(named, "company_id"), "ipo_id")
            .where(cohort_predicate(ticker=ticker, ipo_id=ipo_id, **status,
                                    primary=promoted_primary() if primary_lockup_only else None)))
    if limit is not None:
        rows = event_level_limit(rows, limit, order=["ipo_id"])
    # Several securities may carry the same event; the lowest security id wins.
    first = Window.partitionBy("lockup_id", "observation_offset").orderBy("event_date", "ipo_id", "security_id")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    after = outcomes.drop("ipo_id", "event_date_source").withColumnsRenamed(
        {"event_date": "_event_date", "event_trade_date": "_event_trade_date"})
    rows = rows.join(after, ["lockup_id", "security_id"], "left")
    history = F.col("available_history_sessions")
    made = {
        "ipo_date": lambda: F.col("_ipo_date"), "lockup_expiration_date": lambda: F.col("primary_lockup_expiration_date"),
        "event_date": lambda: F.coalesce("_event_date", "event_date"),
        "event_trade_date": lambda: F.coalesce("_event_trade_date", "event_trade_date"),
        "has_ipo_price": lambda: F.col("ipo_price").isNotNull(),
        "has_20d_history": lambda: history >= 21, "has_40d_history": lambda: history >= 41,
        **{f"has_post_{h}d": lambda h=h: F.col(f"post_{h}d_return").isNotNull() for h in (5, 10, 20, 40)}}
    return rows.select(*[made[c]().alias(c) if c in made else F.col(c) for c in columns])
