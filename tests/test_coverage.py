import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lockstep.operators import coverage as cv
from lockstep.operators import readiness as rd
from lockstep.sources.calendar import sessions

D = dt.date
PRICE = "security_id long, trade_date date, provider string"
ATTEMPT = ("attempt_id long, security_id long, provider string, requested_start_date date, requested_end_date date, "
           "status string, attempted_at timestamp")


def prices(spark, days, security=1):
    return spark.createDataFrame([(security, d, "p") for d in days], PRICE)


def span(spark, a, b):
    return spark.createDataFrame([(1, a, b)], "security_id long, start_date date, end_date date")


def test_coverage_golden(spark):
    df = cv.coverage(span(spark, D(2025, 1, 4), D(2025, 1, 12)),
                     prices(spark, [D(2025, 1, d) for d in (7, 8, 10, 11)]), D(2025, 1, 31))
    row = df.first()
    assert row["missing_sessions"] == [D(2025, 1, 6)] and row["non_session_stored_dates"] == [D(2025, 1, 11)]
    assert row["expected_session_count"] == 4 and row["coverage_ratio"] == 0.75
    empty = cv.coverage(span(spark, D(2025, 1, 4), D(2025, 1, 5)), prices(spark, []), D(2025, 1, 31)).first()
    assert empty["coverage_ratio"] == 1.0 and empty["coverage_complete"]


def test_future_sessions_are_not_fetchable(spark):
    row = cv.coverage(span(spark, D(2025, 1, 6), D(2025, 1, 10)), prices(spark, []), D(2025, 1, 7)).first()
    assert row["fetchable_missing_sessions"] == [D(2025, 1, 6), D(2025, 1, 7)]
    assert row["future_missing_sessions"] == [D(2025, 1, 8), D(2025, 1, 10)]


def test_lockup_plan_golden(spark):
    rows = spark.createDataFrame([(1, 1, D(2025, 1, 11))], "lockup_id long, security_id long, event_date date")
    row = cv.plan_lockup_coverage(rows).first()
    assert row["event_session"] == D(2025, 1, 13)
    ix = {r["session"]: r["ix"] for r in sessions(spark).collect()}
    assert ix[row["event_session"]] - ix[row["earliest_snapshot_session"]] == 60
    assert ix[row["event_session"]] - ix[row["start_date"]] == 80


def test_islands_bridge_closures(spark):
    # 9 January 2025 was closed, so the 8th and 10th are adjacent sessions.
    plan = cv.planned(span(spark, D(2025, 1, 2), D(2025, 1, 14)), prices(spark, [D(2025, 1, 7), D(2025, 1, 13)]),
                      spark.createDataFrame([], ATTEMPT), "p", D(2025, 2, 1))
    got = sorted((r["range_start"], r["range_end"], r["sessions"]) for r in cv.request_ranges(plan).collect())
    assert got == [(D(2025, 1, 2), D(2025, 1, 6), 3), (D(2025, 1, 8), D(2025, 1, 10), 2), (D(2025, 1, 14), D(2025, 1, 14), 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_latest_attempts_match_range_join(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(120):
        a = D(2023, 1, 1) + dt.timedelta(days=rng.randint(0, 500))
        rows.append((i, rng.choice([1, 1, 1, 2]), "p", a, a + dt.timedelta(days=rng.choice([0, 1, 3, 40, 400])),
                     rng.choice(cv.ATTEMPT_STATUSES), dt.datetime(2024, 1, 1, 0, 0, rng.randint(0, 20))))
    attempts = spark.createDataFrame(rows, ATTEMPT)
    days = sessions(spark).where("session between '2023-01-01' and '2025-06-30'").withColumn(
        "security_id", F.explode(F.array(F.lit(1).cast("long"), F.lit(2).cast("long"))))
    got = {(r["security_id"], r["ix"]): r["latest_status"] for r in cv.latest_attempts(attempts, days).collect()}
    want = {}
    for r in days.collect():
        hits = [(x[6], x[0], x[5]) for x in rows if x[1] == r["security_id"] and x[3] <= r["session"] <= x[4]]
        if hits:
            want[(r["security_id"], r["ix"])] = max(hits)[2]
    assert got == want and len(want) > 500


def window(spark, as_of, stored, attempts):
    rows = sessions(spark).where("session <= '2025-02-28'").orderBy(F.desc("ix")).limit(21).collect()
    days = sorted(r["session"] for r in rows)
    keep = prices(spark, [d for i, d in enumerate(days) if i not in stored])
    made = [(i, 1, "p", days[a], days[b], s, dt.datetime(2025, 3, 1, 0, 0, i)) for i, (a, b, s) in enumerate(attempts)]
    win = spark.createDataFrame([(1, max(r["ix"] for r in rows))], "security_id long, obs_ix int")
    return rd.diagnose_windows(win, keep, spark.createDataFrame(made, ATTEMPT), "p", as_of).first()


@pytest.mark.parametrize("missing,attempts,status", [
    ((), (), "complete"), ((3,), (), "unattempted_missing"), ((3,), ((2, 4, "no_data"),), "known_no_data"),
    ((3,), ((2, 4, "no_data"), (3, 3, "error")), "provider_error"), ((3,), ((3, 3, "success"),), "mixed_attempt_history"),
    ((3, 5, 7, 9, 11), ((3, 3, "no_data"), (5, 5, "error"), (7, 7, "partial")), "mixed_attempt_history")])
def test_window_status(spark, missing, attempts, status):
    row = window(spark, D(2025, 3, 10), missing, attempts)
    assert row["status"] == status and row["missing_count"] == len(missing)


def test_not_reached_window(spark):
    row = window(spark, D(2025, 2, 26), (19, 20), ())
    assert row["status"] == "not_reached"


def test_reconcile_is_idempotent_and_validates(spark):
    rows = [(1, 1, "p", D(2024, 1, 2), D(2024, 1, 3), "no_data", dt.datetime(2024, 1, 4)),
            (2, 1, "p", D(2024, 1, 3), D(2024, 1, 2), "no_data", dt.datetime(2024, 1, 4)),
            (3, 1, "p", D(2024, 1, 2), D(2024, 1, 3), "bogus", dt.datetime(2024, 1, 4))]
    incoming = spark.createDataFrame(rows, ATTEMPT)
    first = cv.reconcile_attempts(incoming.where("false"), incoming)
    assert [r["attempt_id"] for r in first.collect()] == [1]
    assert cv.reconcile_attempts(first, incoming).count() == 0


def test_delivery_completes_a_gap(spark):
    ranges = span(spark, D(2025, 1, 6), D(2025, 1, 10))
    stored = prices(spark, [D(2025, 1, 7)])
    attempts = spark.createDataFrame([], ATTEMPT)
    days = cv.planned(ranges, stored, attempts, "p", D(2025, 2, 1))
    delivered = spark.createDataFrame(
        [(1, D(2025, 1, 6), D(2025, 1, 6), D(2025, 1, 6)), (1, D(2025, 1, 8), D(2025, 1, 10), D(2025, 1, 8)),
         (1, D(2025, 1, 8), D(2025, 1, 10), D(2025, 1, 11))],
        "security_id long, range_start date, range_end date, trade_date date")
    accepted, made = cv.apply_delivery(days, delivered, stored, "p")
    assert sorted(r["trade_date"] for r in accepted.collect()) == [D(2025, 1, 6), D(2025, 1, 8)]
    assert {r["range_start"]: (r["status"], r["bars_created"]) for r in made.collect()} == {
        D(2025, 1, 6): ("success", 1), D(2025, 1, 8): ("partial", 1)}
    after = stored.unionByName(accepted.select("security_id", "trade_date", F.lit("p").alias("provider")))
    done = cv.delivery_status(days, cv.coverage(ranges, after, D(2025, 2, 1)), made).first()
    assert done["status"] == "partially_backfilled"
