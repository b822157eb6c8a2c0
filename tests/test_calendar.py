import datetime as dt

import pytest
from pyspark.sql import functions as F

from lockstep.operators import calendar_ops as cal
from lockstep.sources.calendar import calendar_days, sessions, split_by_horizon

D = dt.date


def days(spark, values, name="day"):
    return spark.createDataFrame([(v,) for v in values], f"{name} date")


def test_session_counts_per_year(spark):
    rows = sessions(spark).groupBy(F.year("session").alias("y")).count().collect()
    counts = {r["y"]: r["count"] for r in rows}
    assert sum(counts.values()) == 11577
    expected = {1997: 253, 2001: 248, 2004: 252, 2007: 251, 2012: 250, 2018: 251, 2022: 251, 2023: 250,
                2024: 252, 2025: 250, 2026: 251}
    assert {y: counts[y] for y in expected} == expected


def test_forward_alignment(spark):
    golden = {D(2024, 3, 9): D(2024, 3, 11), D(2024, 3, 10): D(2024, 3, 11), D(2024, 1, 15): D(2024, 1, 16),
              D(2024, 3, 29): D(2024, 4, 1), D(2024, 7, 4): D(2024, 7, 5), D(2024, 11, 28): D(2024, 11, 29),
              D(2024, 12, 25): D(2024, 12, 26), D(2025, 1, 1): D(2025, 1, 2)}
    out = cal.session_on_or_after(days(spark, golden), "day", "s").collect()
    assert {r["day"]: r["s"] for r in out} == golden


def test_t5_resolution(spark):
    golden = {D(2024, 3, 11): D(2024, 3, 4), D(2024, 7, 8): D(2024, 6, 28), D(2025, 1, 3): D(2024, 12, 26)}
    out = cal.resolve_observation_session(days(spark, golden, "event_date"), F.lit(-5)).collect()
    assert {r["event_date"]: r["observation_session"] for r in out} == golden


@pytest.mark.parametrize("bad", [D(1989, 12, 31), D(2036, 1, 1)])
def test_horizon_guard_names_bounds(spark, bad):
    with pytest.raises(Exception, match="1990-01-01"):
        cal.with_session_index(spark.createDataFrame([(bad,)], "day date"), "day", "", strict=True).collect()


def test_a_bad_date_costs_itself_only(spark):
    df = spark.createDataFrame([(1, D(2024, 1, 2)), (2, D(1989, 12, 31)), (3, None), (4, D(2036, 1, 1))], "id int, day date")
    good, rejected = split_by_horizon(df, "day")
    assert sorted(r["id"] for r in cal.session_on_or_after(good, "day", "session").collect()) == [1, 3]
    assert {r["id"]: r["reason"][:15] for r in rejected.collect()} == {2: "date 1989-12-31", 4: "date 2036-01-01"}
    assert {r["id"]: r["session"] for r in cal.session_on_or_after(df, "day", "session").collect()} == {1: D(2024, 1, 2), 2: None, 3: None, 4: None}


def test_offset_from_non_session_is_an_error(spark):
    with pytest.raises(Exception, match="not an XNYS session"):
        cal.session_offset(days(spark, [D(2024, 3, 9)]), "day", -1, "s").collect()


def test_range_and_inverted_range(spark):
    df = spark.createDataFrame([(1, D(2025, 1, 4), D(2025, 1, 12)), (2, D(2025, 1, 12), D(2025, 1, 4))],
                               "id int, a date, b date")
    out = [(r["id"], r["session"]) for r in cal.sessions_in_range(df, "a", "b").orderBy("session").collect()]
    assert out == [(1, D(2025, 1, d)) for d in (6, 7, 8, 10)]


def test_caller_closures_shift_sessions(spark):
    extra = days(spark, [D(2024, 3, 11)])
    row = calendar_days(spark, extra).where("day = '2024-03-11'").first()
    assert row["ix"] is None and row["is_session"] is False


def test_quarters(spark):
    df = spark.createDataFrame([(D(2023, 11, 30), D(2024, 5, 1))], "a date, b date")
    out = [(r["year"], r["quarter"]) for r in cal.quarters_between(df, "a", "b").collect()]
    assert out == [(2023, 4), (2024, 1), (2024, 2)]
