"""Signals on disk: locks are appended once and never rewritten, states are a log.

``locks`` holds a signal as it was locked, ``states`` one row for each later change of
status or outcome.  Both are partitioned by run and attempt; a run becomes visible
through one manifest row written after both, so a run that stopped half-way is never
read, and a run that is repeated after it was published changes nothing.  The name of a
run is the time of its lock, so names sort by time and ``before`` reads the signals as
an earlier run saw them.

The current signals are merged on read: of locks of one signal the earliest run counts
(two runs at the same time may both lock an event), of its states the latest status and
the first outcome.  ``fold_states`` writes that merge of all runs up to one; a reader
starts from the last fold and adds later runs only, so what is read stays in proportion
to the signals, not to the number of runs.
"""
from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.constants import Hypothesis
from lockstep.operators.prospective import (OUTCOME, current_signals, latest_states, lifecycle_rows, new_signals,
                                            state_changes, takes_effect)

LOCK_SCHEMA = """signal_id long, hypothesis_id string, hypothesis_version string, evaluation_mode string, ipo_id long,
    lockup_id long, security_id long, observation_offset int, observation_date date, required_observation_date date,
    event_date date, event_trade_date date, feature1_name string, feature2_name string, feature1_value double,
    feature2_value double, feature1_threshold double, feature2_threshold double, feature1_side string,
    feature2_side string, interaction_group string, is_high_high boolean, signal_status string,
    unavailable_reason string, realized_outcome_name string, realized_outcome_value double, bearish_mfe_20d double,
    bearish_mae_20d double, outcome_observation_date date, outcome_attached_at timestamp, created_at timestamp,
    calendar_id string, calendar_version string, calendar_provider string"""
STATE_SCHEMA = """signal_id long, signal_status string, realized_outcome_name string, realized_outcome_value double,
    bearish_mfe_20d double, bearish_mae_20d double, outcome_observation_date date, outcome_attached_at timestamp"""
PLACE = "run string, attempt string"


def run_name(now_utc: dt.datetime) -> str:
    if now_utc.tzinfo is None or now_utc.utcoffset() != dt.timedelta(0):
        raise ValueError("now_utc must be a timezone-aware UTC datetime")
    return now_utc.strftime("r%Y%m%dT%H%M%S%f")


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def published(spark: SparkSession, root: str) -> DataFrame:
    """``run, attempt`` of the visible runs; of two attempts of one run the least name counts."""
    return _read(spark, f"{root}/manifest", PLACE).groupBy("run").agg(F.min("attempt").alias("attempt"))


def _fitted(rows: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in its types; absent ones are null, others are left out."""
    fields = rows.sparkSession.createDataFrame([], schema).schema.fields
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in fields])


def publish(spark: SparkSession, root: str, run: str, locks: DataFrame, states: DataFrame | None = None) -> bool:
    """Append one run; false, and nothing written, if the run is there already."""
    runs = published(spark, root).agg(F.max("run").alias("last"), F.bool_or(F.col("run") == run).alias("there")).first()
    if runs["there"]:
        return False
    if runs["last"] is not None and runs["last"] > run:
        raise ValueError(f"run {run} is older than the published run {runs['last']}")
    attempt = f"a{uuid.uuid4().hex}"
    place = f"run={run}/attempt={attempt}"
    _fitted(locks, LOCK_SCHEMA).write.parquet(f"{root}/locks/{place}")
    if states is not None:
        _fitted(states, STATE_SCHEMA).write.parquet(f"{root}/states/{place}")
    spark.createDataFrame([(run, attempt)], PLACE).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    return True


def _visible(spark: SparkSession, root: str, name: str, schema: str, before: str | None, after: str | None = None) -> DataFrame:
    rows = _read(spark, f"{root}/{name}", f"{schema}, {PLACE}")
    if before is not None:
        rows = rows.where(F.col("run") < before)
    if after is not None:
        rows = rows.where(F.col("run") > after)
    return rows.join(published(spark, root), ["run", "attempt"], "left_semi")


def _states(spark: SparkSession, root: str, before: str | None) -> DataFrame:
    folds = _read(spark, f"{root}/folds", "upto string, folder string")
    if before is not None:
        folds = folds.where(F.col("upto") < before)
    last = folds.agg(F.max(F.struct("upto", "folder")).alias("f")).select("f.*").first()
    log = _visible(spark, root, "states", STATE_SCHEMA, before, last["upto"]).drop("attempt")
    if last["upto"] is None:
        return log
    return log.unionByName(spark.read.schema(f"{STATE_SCHEMA}, run string").parquet(last["folder"]))


def read_signals(spark: SparkSession, root: str, before: str | None = None) -> DataFrame:
    """One row a signal with its present state, or with that before the run ``before``."""
    locks = _visible(spark, root, "locks", LOCK_SCHEMA, before)
    fields = [c for c in locks.columns if c not in ("signal_id", "run", "attempt")]
    first = locks.groupBy("signal_id").agg(F.min_by(F.struct(*fields), "run").alias("_l")).select("signal_id", "_l.*")
    return current_signals(first, _states(spark, root, before))


def read_changes(spark: SparkSession, root: str, run: str) -> DataFrame:
    """The state rows one run appended."""
    return _visible(spark, root, "states", STATE_SCHEMA, None).where(F.col("run") == run).drop("run", "attempt")


def append_decisions(spark: SparkSession, root: str, decisions: DataFrame, hypothesis: Hypothesis,
                     now_utc: dt.datetime) -> bool:
    """Lock what a run creates and log what it changes; signals it leaves as they are cost nothing.

    ``decisions`` come from ``read_signals(..., before=run_name(now_utc))``.  Those with
    an effect are written first, so locks and states are taken from one evaluation.
    """
    run = run_name(now_utc)
    if not published(spark, root).where(F.col("run") == run).isEmpty():
        return False
    folder = f"{root}/effects/{run}-{uuid.uuid4().hex}"
    decisions.where(takes_effect()).write.parquet(folder)
    effects = spark.read.schema(decisions.schema).parquet(folder)
    locks = new_signals(effects, hypothesis, now_utc).unionByName(
        lifecycle_rows(effects, hypothesis, now_utc), allowMissingColumns=True)
    return publish(spark, root, run, locks, state_changes(effects, hypothesis, now_utc))


def fold_states(spark: SparkSession, root: str) -> str | None:
    """Write the merge of all states published so far; returns the last run it holds."""
    upto = published(spark, root).agg(F.max("run")).first()[0]
    if upto is None:
        return None
    folder = f"{root}/folded/{uuid.uuid4().hex}"
    # A run published while this one reads is later than ``upto`` and stays in the log.
    rows = latest_states(_states(spark, root, None).where(F.col("run") <= upto))
    rows.select("signal_id", "run", "signal_status", *[F.col(f"_o.{c}").alias(c) for c in OUTCOME]).write.parquet(folder)
    spark.createDataFrame([(upto, folder)], "upto string, folder string").coalesce(1) \
        .write.mode("append").parquet(f"{root}/folds")
    return upto
