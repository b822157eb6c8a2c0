import datetime as dt
import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lockstep.constants import FROZEN, SHADOW, STRICT
from lockstep.operators import classification as cl
from lockstep.operators import ingest as ing
from lockstep.operators import options as op
from lockstep.operators import parity as pa
from lockstep.operators import projections as pj
from lockstep.operators import prospective as pr
from lockstep.sources import filings, tables
from lockstep.sources.calendar import sessions

D = dt.date
NOW = dt.datetime(2026, 9, 1, 20, 0, tzinfo=dt.timezone.utc)
SIGNAL = ("signal_id long, hypothesis_id string, hypothesis_version string, evaluation_mode string, ipo_id long, lockup_id long, "
          "security_id long, observation_date date, required_observation_date date, event_date date, event_trade_date date, "
          "feature1_value double, feature2_value double, interaction_group string, is_high_high boolean, signal_status string, "
          "unavailable_reason string, realized_outcome_name string, realized_outcome_value double, bearish_mfe_20d double, "
          "bearish_mae_20d double, outcome_observation_date date, outcome_attached_at timestamp, created_at timestamp")


def signal(i, mode, status="awaiting_event", group="high_high", value=None, obs=D(2026, 8, 1), lockup=None):
    return (i, FROZEN.hypothesis_id, FROZEN.version, mode, 1, lockup or i, 1, obs, obs, D(2026, 9, 9), D(2026, 9, 9), 0.1, 0.9,
            group, group == "high_high", status, None, None, value, None, None, None, None, dt.datetime(2026, 8, 1))


def decide(spark, events, signals=(), snapshots=(), mode=STRICT, as_of=D(2026, 9, 1), bars=(), outcomes=()):
    candidates = spark.createDataFrame([(k, 1, 1, "T", d) for k, d in events],
                                       "lockup_id long, ipo_id long, company_id long, ticker string, event_date date")
    snaps = spark.createDataFrame([(k, 1, -5, o, s, 0.1, 0.9) for k, o, s in snapshots],
                                  "lockup_id long, security_id long, observation_offset int, observation_date date, snapshot_status string, "
                                  "return_20d double, realized_vol_20d double")
    out = spark.createDataFrame(list(outcomes), "lockup_id long, security_id long, event_trade_date date, as_of_date date, "
                                "outcome_20_date date, post_20d_return double, bearish_mfe_20d double, bearish_mae_20d double")
    prices = spark.createDataFrame(list(bars), "security_id long, trade_date date, open double, high double, low double, close double, volume long")
    secs = spark.createDataFrame([(1, 1)], "company_id long, security_id long")
    return pr.decide(candidates, spark.createDataFrame(list(signals), SIGNAL), snaps, out, prices, secs, mode=mode, as_of=as_of, now_utc=NOW)


def actions(df):
    return {r["lockup_id"]: r["action"] for r in df.collect()}


def test_cutoff_is_exclusive_and_states_follow(spark):
    # T-5 of 2026-08-28 is 2026-08-21 (historical); of 2026-08-31 it is 2026-08-24.
    events = [(1, D(2026, 8, 28)), (2, D(2026, 8, 31)), (3, D(2026, 12, 1)), (4, None), (5, D(2026, 8, 31))]
    snaps = [(2, D(2026, 8, 24), "complete"), (5, D(2026, 8, 24), "partial")]
    got = actions(decide(spark, events, snapshots=snaps))
    assert got == {1: "lifecycle_unavailable", 2: "create", 3: "pending_observation", 4: "no_event_date",
                   5: "waiting_for_market_data"}
    on_cutoff = actions(decide(spark, [(2, D(2026, 8, 31))], snapshots=[(2, FROZEN.cutoff, "complete")]))
    assert on_cutoff == {2: "lifecycle_unavailable"}


def test_existing_signal_bypasses_admission_and_keeps_its_lock(spark):
    old = signal(1, "prospective", obs=D(2020, 1, 2))
    df = decide(spark, [(1, D(2026, 8, 28))], signals=[old], outcomes=[
        (1, 1, D(2026, 8, 28), D(2026, 12, 1), D(2026, 9, 28), -0.2, 0.3, 0.1)])
    row = df.first()
    assert row["action"] == "existing" and row["observation_date"] == D(2020, 1, 2) and row["next_status"] == "matured"
    stored = spark.createDataFrame([old], SIGNAL)
    after = pr.advance_signals(stored, df, FROZEN, NOW).first()
    assert after["realized_outcome_value"] == -0.2 and after["outcome_observation_date"] == D(2026, 9, 28)
    assert after["created_at"] == dt.datetime(2026, 8, 1) and after["feature1_value"] == 0.1
    again = decide(spark, [(1, D(2026, 8, 28))], signals=[tuple(after[c] for c in [f.name for f in stored.schema])])
    assert again.first()["next_status"] == "already_matured"
    report = pr.prospective_report(df, dry_run=True).first()
    assert (report["outcomes_would_attach"], report["outcomes_attached"]) == (1, 0)


def test_shadow_locks_before_the_event_only(spark):
    days = [r["session"] for r in sessions(spark).where("session between '2026-06-01' and '2026-08-21'").orderBy("ix").collect()]
    bars = [(1, d, 10.0, 11.0, 9.0, 10.0 + i % 3, 5) for i, d in enumerate(days)]
    event = [(1, D(2026, 8, 27))]
    as_of = D(2026, 8, 24)
    assert actions(decide(spark, event, mode=SHADOW, as_of=D(2026, 8, 27), bars=bars)) == {1: "missed_lock_window"}
    early = dt.datetime(2026, 8, 24, tzinfo=dt.timezone.utc)
    late = decide(spark, event, mode=SHADOW, as_of=as_of, bars=bars)
    assert actions(late) == {1: "missed_lock_window"}  # the lock timestamp lies after the event
    assert early.date() < D(2026, 8, 27)
    assert actions(decide(spark, [(1, D(2026, 9, 2))], mode=SHADOW, as_of=as_of, bars=bars)) == {1: "not_eligible"}


def test_legacy_rows_are_renamed_unless_strict_exists(spark):
    rows = [signal(1, "prospective", lockup=5), signal(2, STRICT, lockup=6), signal(3, "prospective", lockup=6)]
    got = {r["signal_id"]: r["evaluation_mode"] for r in pr.normalise_legacy_modes(spark.createDataFrame(rows, SIGNAL)).collect()}
    assert got == {1: STRICT, 2: STRICT, 3: "prospective"}


@pytest.mark.parametrize("matured,target,ready", [(20, 5, True), (19, 5, False), (20, 4, False)])
def test_scorecard_readiness(spark, matured, target, ready):
    rows = [signal(i + 1, STRICT, "matured", "high_high" if i < target else "low_low", -0.1 if i % 2 else 0.1, lockup=9)
            for i in range(matured)]
    ipos = spark.createDataFrame([(1, 1, 9, "classified", "operating_company_ipo", "priced")],
                                 "ipo_id long, company_id long, primary_lockup_id long, classification_status string, "
                                 "candidate_type string, offering_status string")
    companies = spark.createDataFrame([(1, "T")], "company_id long, ticker string")
    card = pr.scorecard(pr.scorecard_rows(spark.createDataFrame(rows, SIGNAL), ipos, companies)).first()
    assert (card["interpretation_status"] == "provisional_interpretation_ready") is ready
    assert card["matured_signals"] == matured and card["matured_target_signals"] == target


def test_signal_roles_and_labels(spark):
    rows = [signal(4, "prospective", lockup=1), signal(5, STRICT, "matured", value=-0.1, lockup=1), signal(3, SHADOW, lockup=1)]
    df = spark.createDataFrame(rows, SIGNAL)
    role = pj.signal_roles(df).first()
    assert role["strict_signal"]["signal_id"] == 5 and role["shadow_signal"]["signal_id"] == 3 and role["lifecycle_row"] is None
    got = {r["signal_id"]: r["r"] for r in df.select("signal_id", pj.result_label().alias("r")).collect()}
    assert got == {3: None, 4: None, 5: "bearish_hit"}


def test_lineage_classes(spark):
    names = pa.AUDITED
    base = "lockup_id long, security_id long, observation_offset int, snapshot_version string, observation_date date, event_trade_date date, "
    schema1 = base + ", ".join(f"{n} double" for n in names)
    schema2 = schema1 + (", snapshot_status string, unavailable_reason string, expected_history_sessions int, "
                         "missing_history_sessions int, calendar_id string, calendar_provider string, calendar_version string")
    ok = (1.0,) * len(names)
    day, other = D(2024, 1, 5), D(2024, 1, 8)
    tail = ("complete", None, 41, 0, "XNYS", "rules", "1")
    v1 = [(k, 1, -5, "1", day, day, *ok) for k in (1, 2, 3, 4, 5, 6)]
    v2 = [(1, 1, -5, "2", day, day, *ok, *tail), (2, 1, -5, "2", other, day, *ok, *tail), (3, 1, -5, "2", day, other, *ok, *tail),
          (4, 1, -5, "2", day, day, *((2.0,) + ok[1:]), *tail),
          (5, 1, -5, "2", day, day, *((None,) * len(names)), "unavailable", "missing_observation_bar", 41, 1, "XNYS", "rules", "1"),
          (7, 1, -5, "2", day, day, *ok, *tail)]
    pairs = pa.lineage_pairs(spark.createDataFrame(v1, schema1), spark.createDataFrame(v2, schema2))
    assert {r["lockup_id"]: r["classification"] for r in pairs.collect()} == {
        1: "exact_match", 2: "observation_session_mismatch", 3: "event_session_mismatch",
        4: "numeric_feature_mismatch_complete_history", 5: "v2_missing_observation_bar", 6: "no_v2_snapshot", 7: "no_v1_snapshot"}


def test_classification_golden(spark):
    ipos = spark.createDataFrame([(1, 1, D(2024, 1, 2)), (2, 2, None), (3, 3, D(2024, 1, 2))], "ipo_id long, company_id long, first_filing_date date")
    names = spark.createDataFrame([(1, "Widget Inc"), (2, "Nobody"), (3, "Big Acquisition Corp")], "company_id long, name string")
    rows = [(1, 1, "S-1", D(2024, 1, 2), "a"), (2, 1, "EFFECT", D(2024, 2, 1), "b"), (3, 1, "424B4", D(2024, 2, 5), "d"),
            (4, 1, "424B4", D(2024, 2, 5), "c"), (5, 1, "RW", D(2024, 3, 1), "e"), (6, 3, "8-A12B", D(2024, 1, 9), "f"), (7, 3, "10-K", D(2023, 1, 9), "g")]
    got = {r["ipo_id"]: r for r in cl.classify(ipos, names, spark.createDataFrame(
        rows, "filing_id long, company_id long, form_type string, filed_at date, accession_number string")).collect()}
    assert (got[1]["candidate_type"], got[1]["offering_status"], got[1]["final_prospectus_filing_id"]) == ("operating_company_ipo", "priced", 4)
    assert got[2]["classification_reason"] == cl.NO_ANCHOR and got[2]["offering_status"] == "unknown"
    assert got[3]["classification_status"] == "needs_review" and "(10-K)" in got[3]["classification_reason"]


def test_completed_session_golden(spark):
    golden = {"2026-08-28 22:01:00": D(2026, 8, 28), "2026-08-28 21:59:00": D(2026, 8, 27), "2026-08-29 16:00:00": D(2026, 8, 28),
              "2026-09-07 23:00:00": D(2026, 9, 4)}
    df = spark.createDataFrame([(k,) for k in golden], "k string").withColumn("ts", F.to_timestamp("k"))
    got = {r["k"]: r["completed_session"] for r in ing.latest_completed_session(df, "ts").collect()}
    assert got == golden
    with pytest.raises(ValueError, match="timezone-aware"):
        ing.latest_completed_session(df.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "ts")


def test_index_lines_and_submissions(spark):
    lines = ["Description: Master Index", "CIK|Company Name|Form Type|Date Filed|Filename", "--------",
             "123|Widget Inc|S-1|2024-01-05|edgar/data/123/0000000123-24-000001.txt", "123|Widget Inc|8-K|2024-01-05|x.txt", "a|b"]
    row = filings.parse_index(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [(r["cik"], r["accession_number"]) for r in row] == [("0000000123", "0000000123-24-000001")]
    good = {"name": " Widget ", "tickers": ["WID"], "exchanges": ["NYSE"], "filings": {"recent": {
        "accessionNumber": ["0000000123-24-000001", "bad", "0000000123-24-000003", "0000000123-24-000004"],
        "filingDate": ["2024-01-05", "2024-01-05", "nope", "2024-01-06"], "form": ["8-K", "8-K", "8-K", "S-1"], "primaryDocument": [""]}}}
    docs = spark.createDataFrame([("0000000123", json.dumps(good)), ("9", json.dumps({"name": "x", "filings": {}}))], "cik string, payload string")
    parsed = filings.parse_submissions(docs)
    assert {r["cik"]: r["malformed"] for r in parsed.collect()} == {"0000000123": False, "9": True}
    found = filings.submission_filings(parsed).collect()
    assert [r["filing_path"] for r in found] == ["edgar/data/123/000000012324000001/000000012324000001-index.html"]


def test_bar_merge_modes(spark):
    schema = "security_id long, trade_date date, provider string, close double"
    stored = spark.createDataFrame([(1, D(2024, 1, 2), "p", 1.0)], schema)
    fetched = spark.createDataFrame([(1, D(2024, 1, 2), "p", 9.0), (1, D(2024, 1, 3), "p", 2.0)], schema)
    keep = sorted(r["close"] for r in ing.merge_bars(stored, fetched).collect())
    replaced = sorted(r["close"] for r in ing.merge_bars(stored, fetched, refresh=True).collect())
    assert keep == [1.0, 2.0] and replaced == [2.0, 9.0]


@pytest.mark.parametrize("rows,label", [
    ([], "provider_not_suitable"), ([("historical_contracts_found", True, True, "x", None, None)], "historical_backtest_feasible"),
    ([("historical_contracts_found", True, False, "x", None, None)], "historical_backtest_partially_feasible"),
    ([("no_contracts", None, None, "x", "current_chain_available", None)], "prospective_collection_only"),
    ([("no_contracts", None, None, "x", None, "authentication_failure")], "provider_entitlement_unknown")])
def test_feasibility_classes(spark, rows, label):
    names = spark.createDataFrame(rows, "contract_discovery_status string, historical_bid_available boolean, historical_ask_available boolean, "
                                        "later_valuation_status string, current_chain_status string, error_category string")
    assert op.feasibility(names).first()["classification"] == label


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, D(2024, 1, 2), [D(2024, 1, 3)])], "id int, day date, days array<date>")
    tables.write_parity_csv(df, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert "id,day,days" in text and "2024-01-02" in text and "2024-01-03" in text
    tables.write_json_report(df, str(tmp_path / "json"))
    line = "".join(p.read_text() for p in (tmp_path / "json").glob("part-*"))
    assert json.loads(line) == {"id": 1, "day": "2024-01-02", "days": ["2024-01-03"]}
    path = tables.write_version(df.drop("days"), str(tmp_path), "t", "2")
    assert spark.read.parquet(path).count() == 1


def test_frozen_hypothesis_is_untouched():
    assert (FROZEN.feature1_threshold, FROZEN.feature2_threshold, FROZEN.cutoff) == (0.0332778702, 0.8446461455, D(2026, 8, 23))
    assert replace(FROZEN, cutoff=D(2000, 1, 1)).hypothesis_id == FROZEN.hypothesis_id


def test_derived_tables_follow_their_source(spark, tmp_path):
    from lockstep.plans.stored import stored
    source, made = str(tmp_path / "in"), []

    def value(n):
        made.append(n)
        return spark.createDataFrame([(n,)], "n int")

    value(1).write.parquet(source)
    assert stored(spark, source, "t", lambda: value(10)).first()["n"] == 10
    assert stored(spark, source, "t", lambda: value(11)).first()["n"] == 10
    value(2).write.mode("overwrite").parquet(source)
    assert stored(spark, source, "t", lambda: value(12)).first()["n"] == 12
    assert made == [1, 10, 2, 12]
