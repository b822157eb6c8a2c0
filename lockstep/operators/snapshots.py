"""Pre-event snapshots in both lineages, and the key-merge that stores them."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockstep.constants import (CALENDAR_ID, CALENDAR_PROVIDER, CALENDAR_VERSION, SESSION_VERSION,
                                SNAPSHOT_OFFSETS, STORED_BAR_VERSION)
from lockstep.functions.numeric import growth, persisted
from lockstep.operators.bar_features import (PRICE_FEATURES, VOLUME_FEATURES, YEAR,
                                             derived_columns, observation_rows)
from lockstep.operators.calendar_ops import with_session_at, with_session_index
from lockstep.operators.events import align_to_bars, with_event_date
from lockstep.sources.calendar import calendar_days

OFFERING_COLUMNS = ("ipo_price", "primary_shares", "secondary_shares", "shares_offered", "deal_size")
# Scale at which each derived column is stored.
STORED_SCALE = {
    **{name: 10 for name in PRICE_FEATURES if name.startswith(("return", "realized", "avg_daily"))},
    **{name: 10 for name in ("volume_ratio_5d_to_20d", "down_up_volume_ratio_20d",
                             "return_from_ipo_price", "drawdown_from_post_ipo_high",
                             "position_in_post_ipo_range", "ipo_gain_retention",
                             "secondary_share_fraction")},
    **{name: 4 for name in VOLUME_FEATURES if name.startswith("avg_")},
    **{name: 8 for name in ("close", "post_ipo_high_to_date", "post_ipo_low_to_date")},
}
SNAPSHOT_KEY = ("lockup_id", "security_id", "observation_offset", "snapshot_version")


def event_rows(lockups: DataFrame, ipos: DataFrame, securities: DataFrame) -> DataFrame:
    """One row per dated agreement with its security and the attributes copied to snapshots."""
    dated = with_event_date(lockups).where("event_date is not null")
    # Offerings and securities first: the agreements, which are many more, are dealt once.
    offered = ipos.select("ipo_id", "company_id", "ipo_date", *OFFERING_COLUMNS).join(securities, "company_id")
    return (
        dated.join(offered, "ipo_id")
        .select("ipo_id", "lockup_id", "security_id", "event_date", "event_date_source",
                "ipo_date", *OFFERING_COLUMNS,
                F.col("duration_days").alias("lockup_duration_days"),
                F.col("holder_group").alias("lockup_holder_group"), "lockup_type",
                F.col("confidence").alias("lockup_confidence")))


def _price_relative(close: Column, high: Column, low: Column) -> dict[str, Column]:
    price = F.col("ipo_price").cast("double")
    return {
        "return_from_ipo_price": growth(close, price),
        "drawdown_from_post_ipo_high": growth(close, high),
        "position_in_post_ipo_range": F.try_divide(close - low, high - low),
        "ipo_gain_retention": F.when(high > price, F.try_divide(close - price, high - price)),
        "secondary_share_fraction": F.try_divide(
            F.col("secondary_shares").cast("double"), F.col("shares_offered").cast("double")),
    }


def stored_bar_snapshots(events: DataFrame, bars: DataFrame, offsets=SNAPSHOT_OFFSETS) -> DataFrame:
    """v1: windows count stored bars; only offsets whose bar exists give a row."""
    core = observation_rows(bars, events.select("security_id", "event_date"), offsets)
    close, high, low = F.col("close"), F.col("post_ipo_high_to_date"), F.col("post_ipo_low_to_date")
    rows = events.join(core, ["security_id", "event_date"])
    out = rows.withColumns({
        **_price_relative(close, high, low),
        "data_cutoff_date": F.col("observation_date"),
        "trading_sessions_to_event": F.abs("observation_offset"),
        "days_since_ipo": F.datediff("observation_date", "ipo_date"),
        "trading_sessions_since_first_trade": F.col("bn") - 1,
        "available_history_sessions": F.col("bn"),
        "snapshot_version": F.lit(STORED_BAR_VERSION),
    }).drop("bn")
    return persisted(out, STORED_SCALE)


def _frame(first: int, last: int):
    return Window.partitionBy("security_id").orderBy("ix").rangeBetween(first, last)


def session_windows(bars: DataFrame, probes: DataFrame) -> DataFrame:
    """Exact session windows ending at each distinct ``(security_id, ix)`` probe.

    RANGE frames over the session ordinal count sessions, not rows, so a missing bar
    can never be replaced by an older one.  Probes travel with the bars through one
    exchange; bars on non-sessions only matter for the first and last stored date.
    """
    days = F.broadcast(calendar_days(bars.sparkSession).select(
        F.col("day").alias("trade_date"), F.col("ix").alias("_ix"), "prev_ix"))
    priced = bars.join(days, "trade_date").select(
        "security_id", F.coalesce("_ix", "prev_ix").alias("ix"), "trade_date",
        *[F.when(F.col("_ix").isNotNull(), F.col(c)).alias(c) for c in ("high", "low", "close", "volume")],
        F.col("_ix").isNotNull().cast("int").alias("_kind"))
    wanted = (probes.select("security_id", "ix").distinct()
              .withColumn("_kind", F.lit(2)))
    both = priced.unionByName(wanted, allowMissingColumns=True)

    ordered = Window.partitionBy("security_id").orderBy("ix", "_kind")
    whole = Window.partitionBy("security_id")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    stage = both.withColumns({
        "previous_close": F.last("close", ignorenulls=True).over(before),
        "first_date": F.min("trade_date").over(whole),
        "latest_bar": F.max("trade_date").over(whole),
        "first_ix": F.min(F.when(F.col("_kind") < 2, F.col("ix"))).over(whole),
    })
    # The earliest stored date is a session when no non-session row carries it.
    stage = stage.withColumn("first_is_session", F.max(
        F.when(F.col("trade_date") == F.col("first_date"), F.col("_kind") == 1)).over(whole))
    stage = stage.withColumn("_r", growth(F.col("close"), F.col("previous_close")))

    c, v, previous = F.col("close"), F.col("volume"), F.col("previous_close")
    since_first = _frame(Window.unboundedPreceding, 0)
    out: dict[str, Column] = {
        "_here": F.max(c).over(_frame(0, 0)),
        "_bars_since_first": F.count(c).over(since_first),
        "_high": F.max("high").over(since_first), "_low": F.min("low").over(since_first),
        "present_41": F.count(c).over(_frame(-40, 0)),
        "present_21": F.count(c).over(_frame(-20, 0)),
    }
    for n in (5, 10, 20, 40):
        closes = F.count(c).over(_frame(-n, 0)) == n + 1
        volumes = F.count(c).over(_frame(1 - n, 0)) == n
        out[f"_closes_{n}"] = closes
        out[f"return_{n}d"] = F.when(closes, growth(F.max(c).over(_frame(0, 0)),
                                                    F.max(c).over(_frame(-n, -n))))
        if n != 10:
            out[f"realized_vol_{n}d"] = F.when(
                closes, F.stddev_samp("_r").over(_frame(1 - n, 0)) * F.lit(YEAR))
            out[f"avg_volume_{n}d"] = F.when(volumes, F.avg(v).over(_frame(1 - n, 0)))
    for n in (5, 20):
        out[f"avg_dollar_volume_{n}d"] = F.when(
            F.count(c).over(_frame(1 - n, 0)) == n, F.avg(c * v).over(_frame(1 - n, 0)))
    sample, last20 = F.count(c).over(_frame(-20, 0)) == 21, _frame(-19, 0)
    out["avg_up_day_volume_20d"] = F.when(sample, F.avg(F.when(c > previous, v)).over(last20))
    out["avg_down_day_volume_20d"] = F.when(sample, F.avg(F.when(c < previous, v)).over(last20))
    out["avg_daily_range_20d"] = F.when(
        sample, F.avg(F.try_divide(F.col("high") - F.col("low"), previous)).over(last20))
    windows = stage.withColumns(out).where("_kind = 2").withColumns(derived_columns())
    first_ok = F.coalesce("first_is_session", F.lit(False))
    complete = first_ok & (F.col("_bars_since_first") == F.col("ix") - F.col("first_ix") + 1)
    return windows.select(
        "security_id", "ix", "latest_bar", "present_41", "present_21", F.col("_here").alias("close"),
        first_ok.alias("first_is_session"), "first_ix", complete.alias("range_complete"),
        F.when(complete, F.col("_high")).alias("post_ipo_high_to_date"),
        F.when(complete, F.col("_low")).alias("post_ipo_low_to_date"),
        (complete & F.col("_closes_5") & F.col("_closes_10") & F.col("_closes_20")
         & F.col("_closes_40")).alias("history_complete"),
        *[c for c in (*PRICE_FEATURES, *VOLUME_FEATURES)
          if c not in ("close", "post_ipo_high_to_date", "post_ipo_low_to_date")])


def session_snapshots(events: DataFrame, bars: DataFrame, *, as_of_date=None,
                      offsets=SNAPSHOT_OFFSETS) -> DataFrame:
    """v2: every event gives one row per offset, with an explicit completeness status."""
    grid = with_session_index(events, "event_date", "_e_") \
        .withColumn("event_ix", F.col("_e_next_ix")) \
        .drop("_e_ix", "_e_next_ix", "_e_prev_ix") \
        .withColumn("observation_offset", F.explode(F.array(*[F.lit(k) for k in offsets]))) \
        .withColumn("ix", F.col("event_ix") + F.col("observation_offset"))
    windows = session_windows(bars, grid.select("security_id", "ix"))
    rows = grid.join(windows, ["security_id", "ix"])
    rows = with_session_at(rows, F.col("event_ix"), "event_trade_date")
    rows = with_session_at(rows, F.col("ix"), "observation_date")
    rows = with_session_at(rows, F.col("ix") - 40, "expected_history_start_date")
    # Without any stored bar nothing has been observed yet.
    as_of = (F.lit(as_of_date) if as_of_date is not None
             else F.coalesce("latest_bar", F.to_date(F.lit("0001-01-01"))))
    reason = (F.when(F.col("observation_date") > as_of, "observation_not_reached")
              .when(F.col("close").isNull(), "missing_observation_bar"))
    rows = rows.withColumns({"_as_of": as_of, "_reason": reason})
    available = F.col("_reason").isNull()
    features = [c for c in (*PRICE_FEATURES, *VOLUME_FEATURES)]
    rows = rows.withColumns({c: F.when(available, F.col(c)) for c in features})
    relative = _price_relative(F.col("close"), F.col("post_ipo_high_to_date"),
                               F.col("post_ipo_low_to_date"))
    out = rows.withColumns({
        **relative,
        "data_cutoff_date": F.least("observation_date", "_as_of"),
        "trading_sessions_to_event": F.abs("observation_offset"),
        "days_since_ipo": F.datediff("observation_date", "ipo_date"),
        "trading_sessions_since_first_trade":
            F.when(available & F.col("first_is_session"), F.col("ix") - F.col("first_ix")),
        "expected_history_end_date": F.col("observation_date"),
        "expected_history_sessions": F.lit(41),
        "available_history_sessions": F.col("present_41").cast("int"),
        "missing_history_sessions": (F.lit(41) - F.col("present_41")).cast("int"),
        "snapshot_status": F.when(~available, "unavailable")
            .when(F.col("history_complete"), "complete").otherwise("partial"),
        "unavailable_reason": F.when(~available, F.col("_reason"))
            .when(~F.col("history_complete"), "missing_feature_history"),
        "calendar_id": F.lit(CALENDAR_ID), "calendar_provider": F.lit(CALENDAR_PROVIDER),
        "calendar_version": F.lit(CALENDAR_VERSION),
        "snapshot_version": F.lit(SESSION_VERSION),
    }).drop("ix", "event_ix", "latest_bar", "present_41", "present_21", "first_is_session", "first_ix",
            "range_complete", "history_complete", "_as_of", "_reason")
    return persisted(out, STORED_SCALE)


def merge_by_key(stored: DataFrame, fresh: DataFrame, key) -> DataFrame:
    """Upsert by rewrite, in the stored table's columns.

    A fresh row replaces the values it supplies, nulls included; columns it was not
    given keep the stored value, and are null in new rows.  Columns unknown to the
    stored table are dropped.  Of fresh rows with one key the greatest counts, column
    by column in stored order.  Untouched rows stay.
    """
    key = list(key)
    given = [c for c in stored.columns if c in fresh.columns and c not in key]
    latest = fresh.groupBy(*key).agg(F.max(F.struct(F.lit(True).alias("_given"), *given)).alias("_new"))
    merged = stored.join(latest, key, "full_outer")
    return merged.select(*[
        F.when(F.col("_new._given"), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c)
        for c in stored.columns])


def merge_counts(stored: DataFrame, fresh: DataFrame, key) -> DataFrame:
    """``created`` and ``updated`` row counts of the same upsert."""
    key = list(key)
    known = stored.select(*key, F.lit(True).alias("_known"))
    hit = fresh.select(*key).join(known, key, "left")
    return hit.agg(F.count_if(F.col("_known").isNull()).alias("created"),
                   F.count_if("_known").alias("updated"))


def drop_stale(stored: DataFrame, events: DataFrame, bars: DataFrame) -> DataFrame:
    """Remove v1 rows of events whose event bar is unknown."""
    unknown = align_to_bars(events, bars).where("event_bn is null")
    stale = events.join(unknown, ["security_id", "event_date"], "left_semi") \
        .select("lockup_id", "security_id")
    stored_bar = F.col("snapshot_version") == STORED_BAR_VERSION
    return stored.where(~stored_bar).unionByName(
        stored.where(stored_bar).join(stale, ["lockup_id", "security_id"], "left_anti"))
