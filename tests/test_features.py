import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from lockstep.operators import events as ev
from lockstep.operators import market_summary as ms
from lockstep.operators import outcomes as oc
from lockstep.operators import snapshots as sn
from lockstep.sources.calendar import sessions

D = dt.date
BAR = "security_id long, trade_date date, open double, high double, low double, close double, volume long"
EVENT = ("ipo_id long, lockup_id long, security_id long, event_date date, event_date_source string, ipo_date date, "
         "ipo_price double, primary_shares double, secondary_shares double, shares_offered double, deal_size double, "
         "lockup_duration_days int, lockup_holder_group string, lockup_type string, lockup_confidence double")


def bars_of(spark, dates, closes, volumes, security=1):
    rows = [(security, d, c, c + 1, c - 1, c, v) for d, c, v in zip(dates, map(float, closes), volumes)]
    return spark.createDataFrame(rows, BAR)


def event_of(spark, day, price=10.0, lockup=7):
    row = (1, lockup, 1, day, "stated", D(2023, 12, 1), price, 80.0, 20.0, 100.0, 5.0, 180, "x", "y", 0.9)
    return spark.createDataFrame([row], EVENT)


def nyse_days(spark, start, n):
    rows = sessions(spark).where(F.col("session") >= F.lit(start)).orderBy("session").limit(n).collect()
    return [r["session"] for r in rows]


def test_snapshot_golden_and_no_look_ahead(spark, weekdays):
    dates = weekdays(D(2024, 1, 2), 22)
    closes, volumes = list(range(10, 32)), list(range(100, 122))
    event = event_of(spark, dates[21])
    row = sn.stored_bar_snapshots(event, bars_of(spark, dates, closes, volumes), (-1,)).first()
    assert row["return_20d"] == pytest.approx(2.0)
    assert row["return_40d"] is None
    assert row["avg_volume_5d"] == pytest.approx(118)
    assert row["secondary_share_fraction"] == pytest.approx(0.2)
    assert row["available_history_sessions"] == 21
    changes = [closes[i] / closes[i - 1] - 1 for i in range(1, 21)]
    assert row["realized_vol_20d"] == pytest.approx(statistics.stdev(changes) * math.sqrt(252), abs=1e-9)
    wild = sn.stored_bar_snapshots(event, bars_of(spark, dates, closes[:-1] + [9e6], volumes), (-1,)).first()
    assert wild.asDict() == row.asDict()


def test_outcome_golden(spark, weekdays):
    dates = weekdays(D(2024, 1, 2), 61)
    rows = [(1, d, 20.0 + i * 0.1, 25.0 + i * .1, 19.0, 21.0 + i * 0.05, 300 if i == 25 else 100)
            for i, d in enumerate(dates)]
    out = oc.event_outcomes(event_of(spark, dates[25]), spark.createDataFrame(rows, BAR)).first()
    assert out["event_volume_ratio"] == pytest.approx(3)
    assert out["event_status"] == "post_event_incomplete"
    assert out["max_post_event_session_available"] == 35
    assert out["post_1d_return"] == pytest.approx(rows[26][5] / rows[25][5] - 1, abs=1e-9)
    assert out["post_40d_return"] is None
    assert out["bearish_mfe_5d"] == pytest.approx((rows[25][5] - 19.0) / rows[25][5], abs=1e-9)


def test_event_statuses(spark, weekdays):
    dates = weekdays(D(2024, 1, 2), 5)
    bars = bars_of(spark, dates, [1] * 5, [1] * 5)
    assert oc.event_outcomes(event_of(spark, D(2025, 1, 2)), bars).first()["event_status"] == "upcoming"
    assert oc.event_outcomes(event_of(spark, dates[4]), bars).first()["event_status"] == "event_today"


def test_alignment_never_goes_backwards(spark):
    bars = bars_of(spark, [D(2024, 1, 2), D(2024, 1, 8)], [1, 2], [1, 1])
    probes = spark.createDataFrame([(1, D(2024, 1, 3)), (1, D(2024, 1, 2)), (1, D(2024, 1, 9))],
                                   "security_id long, event_date date")
    got = {r["event_date"]: (r["event_trade_date"], r["event_bn"]) for r in ev.align_to_bars(probes, bars).collect()}
    assert got == {D(2024, 1, 2): (D(2024, 1, 2), 1), D(2024, 1, 3): (D(2024, 1, 8), 2), D(2024, 1, 9): (None, None)}


def test_one_bar_per_day_prefers_a_provider(spark):
    rows = [(1, D(2024, 1, 2), 1.0, 1.0, 1.0, c, 5, p) for c, p in ((2.0, "b"), (1.0, "a"), (3.0, "c"))]
    prices = spark.createDataFrame(rows, BAR + ", provider string")
    assert ev.one_bar_per_day(prices, ["c", "b"]).first()["close"] == 3.0
    assert ev.one_bar_per_day(prices).first()["close"] == 1.0


def test_session_lineage_complete_partial_unavailable(spark):
    dates = nyse_days(spark, D(2024, 1, 2), 120)
    event = event_of(spark, dates[100])
    full = bars_of(spark, dates, range(100, 220), [10] * 120)
    rows = {r["observation_offset"]: r for r in sn.session_snapshots(event, full).collect()}
    assert len(rows) == 6
    assert rows[-5]["snapshot_status"] == "complete" and rows[-5]["available_history_sessions"] == 41
    assert rows[-60]["snapshot_status"] == "partial" or rows[-60]["snapshot_status"] == "complete"
    gap = full.where(F.col("trade_date") != F.lit(dates[90]))
    rows = {r["observation_offset"]: r for r in sn.session_snapshots(event, gap).collect()}
    assert rows[-10]["unavailable_reason"] == "missing_observation_bar" and rows[-10]["close"] is None
    assert rows[-5]["snapshot_status"] == "partial" and rows[-5]["return_5d"] is None
    assert rows[-1]["return_5d"] is not None and rows[-1]["post_ipo_high_to_date"] is None
    early = {r["observation_offset"]: r for r in sn.session_snapshots(event, full, as_of_date=dates[97]).collect()}
    assert early[-1]["unavailable_reason"] == "observation_not_reached"
    # Editing bars after the observation changes nothing at or before it.
    edited = full.withColumn("close", F.when(F.col("trade_date") > F.lit(dates[95]), 9e5).otherwise(F.col("close")))
    again = {r["observation_offset"]: r for r in sn.session_snapshots(event, edited).collect()}
    original = {r["observation_offset"]: r for r in sn.session_snapshots(event, full).collect()}
    assert again[-5] == original[-5]


def test_event_without_bars_still_has_six_session_rows(spark):
    none = bars_of(spark, [D(2024, 1, 2)], [1], [1], security=99)
    rows = sn.session_snapshots(event_of(spark, D(2024, 3, 1)), none).collect()
    assert len(rows) == 6 and {r["unavailable_reason"] for r in rows} == {"observation_not_reached"}


def test_snapshot_upsert_is_idempotent(spark, weekdays):
    dates = weekdays(D(2024, 1, 2), 80)
    fresh = sn.stored_bar_snapshots(event_of(spark, dates[70]), bars_of(spark, dates, range(10, 90), [5] * 80))
    once = sn.merge_by_key(fresh, fresh, sn.SNAPSHOT_KEY).select(*fresh.columns)
    assert sorted(map(str, once.collect())) == sorted(map(str, fresh.collect()))
    assert sn.merge_counts(fresh, fresh, sn.SNAPSHOT_KEY).first().asDict() == {"created": 0, "updated": fresh.count()}


def test_market_summary_golden(spark):
    prices = spark.createDataFrame(
        [(1, D(2024, 1, 2), 11.0, 13.0, 10.0, 12.0, 1, "p"), (1, D(2024, 1, 3), 12.0, 15.0, 11.0, 11.0, 1, "p")],
        BAR + ", provider string")
    ipos = spark.createDataFrame([(1, 1, 10.0)], "ipo_id long, company_id long, ipo_price double")
    secs = spark.createDataFrame([(1, 1, True, "sec_company")],
                                 "security_id long, company_id long, is_primary boolean, source string")
    row = ms.market_summary(ipos, secs, prices, "p").first()
    assert float(row["first_day_close_return_vs_ipo_price"]) == 0.2
    assert float(row["return_from_ipo_price"]) == 0.1
    assert float(row["drawdown_from_post_ipo_high"]) == round(-4 / 15, 10)
    assert ms.summary_report(ipos, secs, prices, "other").first()["no_stored_bars"] == 1


def test_merge_by_key_keeps_what_it_was_not_given(spark):
    from lockstep.operators.snapshots import merge_by_key
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, note string, x double")
    new = spark.createDataFrame([(2, 5.0, "q"), (2, 4.0, "q"), (3, None, "q")], "k int, x double, other string")
    rows = sorted(merge_by_key(old, new, ["k"]).collect(), key=lambda r: r["k"])
    assert [tuple(r) for r in rows] == [(1, "a", 1.0), (2, "b", 5.0), (3, None, None)]
