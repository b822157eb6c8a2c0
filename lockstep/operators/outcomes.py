"""Post-event outcomes over stored bars, and the analysis report."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lockstep.constants import OUTCOME_VERSION
from lockstep.functions.numeric import persisted
from lockstep.operators.bar_features import event_bar_rows

RATIOS = (
    "event_gap_return", "event_intraday_return", "event_close_return",
    "pre_20d_return", "pre_10d_return", "pre_5d_return", "pre_1d_return",
    "post_1d_return", "post_5d_return", "post_10d_return", "post_20d_return", "post_40d_return",
    "bearish_mfe_5d", "bearish_mae_5d", "bearish_mfe_10d", "bearish_mae_10d",
    "bearish_mfe_20d", "bearish_mae_20d", "bearish_mfe_40d", "bearish_mae_40d",
    "event_volume_ratio", "post_5d_avg_volume_ratio", "post_10d_avg_volume_ratio")
OUTCOME_KEY = ("lockup_id", "security_id", "outcome_version")


def event_outcomes(events: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per event with stored history; ``upcoming`` until its event bar exists."""
    core = event_bar_rows(bars, events.select("security_id", "event_date"))
    after = F.col("max_post_event_session_available")
    rows = (events.select("ipo_id", "lockup_id", "security_id", "event_date", "event_date_source")
            .join(core, ["security_id", "event_date"]))
    out = rows.withColumns({
        "event_status": F.when(F.col("event_trade_date").isNull(), "upcoming").when(after == 0, "event_today")
            .when(after >= 40, "complete").otherwise("post_event_incomplete"),
        "outcome_version": F.lit(OUTCOME_VERSION)})
    return persisted(out, {**{name: 10 for name in RATIOS}, "baseline_avg_volume": 4})


def analysis_report(cohort: DataFrame, securities: DataFrame, bars: DataFrame,
                    snapshots: DataFrame, outcomes: DataFrame, *,
                    stored_snapshots: DataFrame | None = None,
                    stored_outcomes: DataFrame | None = None) -> DataFrame:
    """One row of run counters; created/updated follow the key match with stored rows."""
    priced = bars.select("security_id").distinct().withColumn("_priced", F.lit(True))
    seen = (cohort.join(securities, "company_id", "left").join(priced, "security_id", "left")
            .agg(F.count_distinct("ipo_id").alias("ipos_seen"), F.count("lockup_id").alias("lockups_seen"),
                 F.count_if(F.col("event_date").isNull()).alias("errors"),
                 F.count_if(F.col("event_date").isNotNull() & F.col("_priced").isNull())
                 .alias("no_market_history")))
    def known(fresh, stored, key):
        # Rows of the table that is there already; a first run has none.
        if stored is None:
            return fresh.withColumn("_known", F.lit(None).cast("boolean"))
        return fresh.join(stored.select(*key, F.lit(True).alias("_known")).distinct(), list(key), "left")

    def merged(name):
        return [F.count_if(F.col("_known").isNull()).alias(f"{name}_created"), F.count_if("_known").alias(f"{name}_updated")]

    from lockstep.operators.snapshots import SNAPSHOT_KEY
    told = known(outcomes, stored_outcomes, OUTCOME_KEY).agg(
        F.count_if(F.col("event_trade_date").isNotNull()).alias("events_aligned"),
        F.count_if(F.col("event_status") == "upcoming").alias("upcoming"),
        F.count_if(F.col("event_status") == "complete").alias("complete"),
        F.count_if(~F.col("event_status").isin("upcoming", "complete")).alias("incomplete"), *merged("outcomes"))
    rows = side_by_side([seen, told, known(snapshots, stored_snapshots, SNAPSHOT_KEY).agg(*merged("snapshots"))])
    order = ["snapshots_created", "snapshots_updated", "outcomes_created", "outcomes_updated"]
    return rows.select(*[c for c in rows.columns if c not in order], *order)


def side_by_side(parts: list[DataFrame]) -> DataFrame:
    """One-row aggregates as one row: each part is planned once, and only their single rows meet."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])
