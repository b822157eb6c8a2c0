"""Per-bar features of the stored-bar lineage: one exchange, window frames in bars."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockstep.constants import SNAPSHOT_OFFSETS, TRADING_DAYS_PER_YEAR
from lockstep.functions.numeric import growth

YEAR = math.sqrt(TRADING_DAYS_PER_YEAR)
PRICE_FEATURES = (
    "close", "post_ipo_high_to_date", "post_ipo_low_to_date",
    "return_5d", "return_10d", "return_20d", "return_40d",
    "realized_vol_5d", "realized_vol_20d", "realized_vol_40d",
    "avg_daily_range_20d")
VOLUME_FEATURES = (
    "avg_volume_5d", "avg_volume_20d", "avg_volume_40d",
    "avg_dollar_volume_5d", "avg_dollar_volume_20d", "volume_ratio_5d_to_20d",
    "avg_up_day_volume_20d", "avg_down_day_volume_20d", "down_up_volume_ratio_20d")


def by_bar():
    return Window.partitionBy("security_id").orderBy("trade_date")


def rows(first: int, last: int):
    return by_bar().rowsBetween(first, last)


def dated_bars(bars: DataFrame, probes: DataFrame) -> DataFrame:
    """Number the bars and hang on each the event dates that align to it, in one exchange.

    Distinct event dates travel through the same exchange as the bars.  A date aligns to
    the first bar on or after it, so it shares the number of the next bar: ``event_dates``
    of a bar are the dates with its number (at most the days since the bar before).
    Dates after the last bar stay as rows of their own, ``is_bar`` false, behind all bars.
    """
    dates = probes.where(F.col("event_date").isNotNull()).select("security_id", "event_date").distinct()
    both = (bars.select("security_id", "trade_date", "open", "high", "low", "close", "volume",
                        F.lit(1).alias("_bar"))
            .unionByName(dates.select("security_id", F.col("event_date").alias("trade_date"),
                                      F.lit(0).alias("_bar")), allowMissingColumns=True))
    running = Window.partitionBy("security_id").orderBy("trade_date", "_bar")
    same = Window.partitionBy("security_id", "_next")
    seen = both.withColumn("bn", F.sum("_bar").over(running).cast("int")) \
        .withColumn("_next", F.col("bn") + 1 - F.col("_bar"))
    seen = seen.withColumns({
        "event_dates": F.collect_list(F.when(F.col("_bar") == 0, F.col("trade_date"))).over(same),
        "_met": F.max("_bar").over(same)})
    return (seen.where("_bar = 1 or _met = 0").withColumn("is_bar", F.col("_bar") == 1)
            .drop("_bar", "_next", "_met"))


def feature_columns() -> dict[str, Column]:
    """Look-back features of each bar; every frame ends at the current row."""
    c, v, bn = F.col("close"), F.col("volume"), F.col("bn")
    previous, r = F.col("previous_close"), F.col("_r")
    out: dict[str, Column] = {
        "post_ipo_high_to_date": F.max("high").over(rows(Window.unboundedPreceding, 0)),
        "post_ipo_low_to_date": F.min("low").over(rows(Window.unboundedPreceding, 0)),
    }
    for n in (5, 10, 20, 40):
        out[f"return_{n}d"] = growth(c, F.lag("close", n).over(by_bar()))
    for n in (5, 20, 40):
        out[f"avg_volume_{n}d"] = F.when(bn >= n, F.avg(v).over(rows(1 - n, 0)))
        out[f"realized_vol_{n}d"] = F.when(
            bn >= n + 1, F.stddev_samp(r).over(rows(1 - n, 0)) * F.lit(YEAR))
    for n in (5, 20):
        out[f"avg_dollar_volume_{n}d"] = F.when(bn >= n, F.avg(c * v).over(rows(1 - n, 0)))
    last20 = rows(-19, 0)
    enough = bn >= 21
    out["avg_up_day_volume_20d"] = F.when(enough, F.avg(F.when(c > previous, v)).over(last20))
    out["avg_down_day_volume_20d"] = F.when(enough, F.avg(F.when(c < previous, v)).over(last20))
    out["avg_daily_range_20d"] = F.when(
        enough, F.avg(F.try_divide(F.col("high") - F.col("low"), previous)).over(last20))
    return out


def derived_columns() -> dict[str, Column]:
    return {
        "volume_ratio_5d_to_20d": F.try_divide("avg_volume_5d", "avg_volume_20d"),
        "down_up_volume_ratio_20d": F.try_divide("avg_down_day_volume_20d", "avg_up_day_volume_20d"),
    }


def with_bar_features(numbered: DataFrame) -> DataFrame:
    base = numbered.withColumn("previous_close", F.lag("close").over(by_bar()))
    base = base.withColumn("_r", growth(F.col("close"), F.col("previous_close")))
    return base.withColumns(feature_columns()).withColumns(derived_columns()).drop("_r")


def observation_rows(bars: DataFrame, probes: DataFrame, offsets=SNAPSHOT_OFFSETS) -> DataFrame:
    """Feature rows at the requested stored-bar offsets before every event bar.

    A bar looks ahead to the event dates of the bars it serves inside the same window, so
    only needed rows leave the stage, already under the dates they are wanted for.
    Key: ``security_id, event_date, observation_offset``.
    """
    feats = with_bar_features(dated_bars(bars, probes).where("is_bar"))

    def wanted(k):
        trade_date = F.lead("trade_date", -k).over(by_bar())
        return F.transform(F.lead("event_dates", -k).over(by_bar()), lambda d: F.struct(
            d.alias("event_date"), trade_date.alias("event_trade_date"), F.lit(k).alias("observation_offset")))

    served = F.flatten(F.filter(F.array(*[wanted(k) for k in offsets]), lambda a: F.size(a) > 0))
    return (feats.withColumn("_served", served).where(F.size("_served") > 0)
            .select("*", F.explode("_served").alias("_e"))
            .withColumnRenamed("trade_date", "observation_date")
            .select("security_id", "_e.*", "observation_date", "bn", *PRICE_FEATURES, *VOLUME_FEATURES))


def outcome_columns() -> dict[str, Column]:
    """Event-centred measurements of each bar; look-ahead is allowed here only."""
    c, bn = F.col("close"), F.col("bn")
    after = F.col("max_post_event_session_available")
    previous, baseline = F.col("previous_close"), F.col("baseline_avg_volume")
    out = {
        "event_gap_return": growth(F.col("open"), previous),
        "event_intraday_return": growth(c, F.col("open")),
        "event_close_return": growth(c, previous),
        "event_volume_ratio": F.try_divide(F.col("volume"), baseline),
    }
    for n in (20, 10, 5, 1):
        out[f"pre_{n}d_return"] = growth(c, F.lag("close", n).over(by_bar()))
    for n in (1, 5, 10, 20, 40):
        out[f"post_{n}d_return"] = growth(F.lead("close", n).over(by_bar()), c)
    for n in (5, 10, 20, 40):
        drop = F.try_divide(c - F.min("low").over(rows(1, n)), c)
        rise = F.try_divide(F.max("high").over(rows(1, n)) - c, c)
        out[f"bearish_mfe_{n}d"] = F.when((after >= n) & (c != 0), F.greatest(F.lit(0.0), drop))
        out[f"bearish_mae_{n}d"] = F.when((after >= n) & (c != 0), F.greatest(F.lit(0.0), rise))
    for n in (5, 10):
        out[f"post_{n}d_avg_volume_ratio"] = F.when(
            after >= n, F.try_divide(F.avg("volume").over(rows(1, n)), baseline))
    return out


def event_bar_rows(bars: DataFrame, probes: DataFrame) -> DataFrame:
    """Outcome row of every event date of a security with bars.  Key: ``security_id, event_date``.

    Dates after the last bar keep null measurements; they lie behind all bars, so no
    frame of a bar reads a value from them.
    """
    is_bar = F.col("is_bar")
    whole = Window.partitionBy("security_id")
    base = dated_bars(bars, probes).withColumn("bar_date", F.when(is_bar, F.col("trade_date")))
    base = base.withColumns({
        "previous_close": F.when(is_bar, F.lag("close").over(by_bar())),
        "as_of_date": F.max("bar_date").over(whole),
        "max_post_event_session_available": F.when(is_bar, (F.count("bar_date").over(whole) - F.col("bn")).cast("int")),
        "baseline_avg_volume": F.when(is_bar & (F.col("bn") >= 21), F.avg("volume").over(rows(-20, -6))),
        # The frozen +20 observation: the 21st stored bar counting the event bar.
        "outcome_20_date": F.lead("bar_date", 20).over(by_bar()),
    })
    return (base.withColumns(outcome_columns()).where((F.size("event_dates") > 0) & F.col("as_of_date").isNotNull())
            .select("*", F.explode("event_dates").alias("event_date"))
            # Several dates after the last bar share one number: each row answers for its own.
            .where(is_bar | (F.col("event_date") == F.col("trade_date")))
            .withColumnsRenamed({"bar_date": "event_trade_date", "open": "event_open", "high": "event_high",
                                 "low": "event_low", "close": "event_close", "volume": "event_volume"})
            .drop("is_bar", "trade_date", "event_dates", "bn"))
