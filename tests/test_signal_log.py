import datetime as dt

import pytest
from pyspark.sql import functions as F

from lockstep.constants import FROZEN
from lockstep.operators import prospective as pr
from lockstep.plans import signal_log as lg
from tests.test_research import D, SIGNAL, decide, signal

T = [dt.datetime(2026, 9, d, 20, 0, tzinfo=dt.timezone.utc) for d in (1, 2, 3, 4)]
EVENTS = [(1, D(2026, 8, 28)), (2, D(2026, 8, 31)), (7, D(2026, 8, 28))]
SNAPS = [(2, D(2026, 8, 24), "complete")]
OUTCOMES = [(1, 1, D(2026, 8, 28), D(2026, 12, 1), D(2026, 9, 28), -0.2, 0.3, 0.1)]


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def run(spark, root, now, outcomes=()):
    stored = lg.read_signals(spark, root, before=lg.run_name(now))
    decisions = decide(spark, EVENTS, signals=[tuple(r) for r in stored.select(*names(spark)).collect()],
                       snapshots=SNAPS, outcomes=outcomes)
    return lg.append_decisions(spark, root, decisions, FROZEN, now), decisions


def names(spark):
    return spark.createDataFrame([], SIGNAL).columns


STATE = ("lockup_id", "evaluation_mode", "signal_status", "realized_outcome_value", "bearish_mfe_20d")


def test_runs_append_only_what_changes(spark, tmp_path):
    root = str(tmp_path)
    old = spark.createDataFrame([signal(1, "prospective", "signal_created", obs=D(2020, 1, 2))], SIGNAL)
    assert lg.publish(spark, root, lg.run_name(T[0]), old)
    done, decisions = run(spark, root, T[1])
    assert done
    first = lg.read_signals(spark, root)
    assert rows(first, *STATE) == rows(pr.advance_signals(old, decisions, FROZEN, T[1]), *STATE)
    assert {r["lockup_id"]: r["signal_status"] for r in first.collect()} == {
        1: "awaiting_outcome", 2: "awaiting_outcome", 7: "unavailable"}
    # Nothing new: the next run publishes no row.
    assert run(spark, root, T[2])[0]
    assert lg.read_changes(spark, root, lg.run_name(T[2])).count() == 0
    assert rows(lg.read_signals(spark, root), *STATE) == rows(first, *STATE)
    # An outcome arrives for one signal: one state row; the lock keeps its fields.
    assert run(spark, root, T[3], OUTCOMES)[0]
    assert lg.read_changes(spark, root, lg.run_name(T[3])).count() == 1
    one = lg.read_signals(spark, root).where("lockup_id = 1").first()
    assert (one["signal_status"], one["realized_outcome_value"], one["bearish_mfe_20d"]) == ("matured", -0.2, 0.3)
    assert one["created_at"] == dt.datetime(2026, 8, 1) and one["observation_date"] == D(2020, 1, 2)
    # Earlier states can still be read.
    assert rows(lg.read_signals(spark, root, before=lg.run_name(T[3])), *STATE) == rows(first, *STATE)


def test_repeated_broken_and_late_runs(spark, tmp_path):
    root = str(tmp_path)
    assert lg.read_signals(spark, root).count() == 0 and lg.fold_states(spark, root) is None
    assert run(spark, root, T[1])[0]
    want = rows(lg.read_signals(spark, root), *STATE)
    assert len(want) == 3
    assert not run(spark, root, T[1])[0]
    # A run that stopped before its manifest row left files that nobody reads, and can be done again.
    lost = f"run={lg.run_name(T[2])}/attempt=a0"
    spark.read.parquet(f"{root}/locks").drop("run", "attempt").withColumn("signal_id", F.lit(99)).write.parquet(f"{root}/locks/{lost}")
    assert rows(lg.read_signals(spark, root), *STATE) == want
    assert run(spark, root, T[2])[0]
    assert rows(lg.read_signals(spark, root), *STATE) == want
    with pytest.raises(ValueError):
        run(spark, root, T[0])


def test_fold_keeps_every_state_and_the_first_outcome(spark, tmp_path):
    root = str(tmp_path)

    def states(*tuples):
        return spark.createDataFrame(list(tuples), lg.STATE_SCHEMA)

    none = (None,) * 6
    lg.publish(spark, root, lg.run_name(T[0]), spark.createDataFrame([signal(i, "prospective", lockup=i) for i in (1, 2, 3)], SIGNAL))
    lg.publish(spark, root, lg.run_name(T[1]), spark.createDataFrame([], lg.LOCK_SCHEMA), states(
        (1, "matured", "y", -0.2, 0.3, 0.1, D(2026, 9, 28), T[1]), (2, "awaiting_outcome", *none)))
    want = [(1, "prospective", "matured", -0.2, 0.3), (2, "prospective", "awaiting_outcome", None, None),
            (3, "prospective", "awaiting_event", None, None)]
    assert rows(lg.read_signals(spark, root), *STATE) == want
    assert lg.fold_states(spark, root) == lg.run_name(T[1])
    assert rows(lg.read_signals(spark, root), *STATE) == want
    # A second outcome for the same signal changes its status row, never the outcome.
    lg.publish(spark, root, lg.run_name(T[2]), spark.createDataFrame([], lg.LOCK_SCHEMA), states(
        (1, "matured", "y", 0.9, 0.0, 0.0, D(2026, 10, 1), T[2])))
    assert rows(lg.read_signals(spark, root), *STATE) == want
    assert lg.fold_states(spark, root) == lg.run_name(T[2])
    assert rows(lg.read_signals(spark, root), *STATE) == want
    # Runs before a fold are read from the log.
    assert {r[2] for r in rows(lg.read_signals(spark, root, before=lg.run_name(T[1])), *STATE)} == {"awaiting_event"}


def test_two_locks_of_one_signal_count_once(spark, tmp_path):
    root = str(tmp_path)
    a, b = signal(5, "prospective", group="high_high"), signal(5, "prospective", group="low_low")
    lg.publish(spark, root, lg.run_name(T[0]), spark.createDataFrame([a], SIGNAL))
    lg.publish(spark, root, lg.run_name(T[1]), spark.createDataFrame([b], SIGNAL))
    assert [r["interaction_group"] for r in lg.read_signals(spark, root).collect()] == ["high_high"]
