import datetime as dt
import json

from lockstep.streaming.bars import ingest_bar_files, stored_bars


def respond(folder, name, security, *bars):
    items = [{"t": int(dt.datetime(*d, tzinfo=dt.timezone.utc).timestamp() * 1000), "o": c, "h": c, "l": c, "c": c, "v": 5} for d, c in bars]
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps({"security_id": security, "payload": json.dumps({"results": items})}))


def test_files_merge_once_and_rerun_changes_nothing(spark, tmp_path):
    incoming, root, checkpoint = tmp_path / "in", str(tmp_path / "tables"), str(tmp_path / "check")

    def run(refresh=False):
        ingest_bar_files(spark, str(incoming), root, checkpoint, provider="p", refresh=refresh).awaitTermination(60)
        return sorted((r["security_id"], r["trade_date"], float(r["close"])) for r in stored_bars(spark, root).collect())

    respond(incoming, "a.json", 1, ((2024, 1, 2), 1.5), ((2024, 1, 3), 2.5))
    first = run()
    assert first == [(1, dt.date(2024, 1, 2), 1.5), (1, dt.date(2024, 1, 3), 2.5)]
    respond(incoming, "b.json", 1, ((2024, 1, 3), 9.0), ((2024, 1, 4), 3.0))
    second = run()
    assert second == first + [(1, dt.date(2024, 1, 4), 3.0)]
    assert run() == second


def test_another_checkpoint_over_the_same_table_loses_nothing(spark, tmp_path):
    incoming, root = tmp_path / "in", str(tmp_path / "tables")

    def run(checkpoint):
        ingest_bar_files(spark, str(incoming), root, str(tmp_path / checkpoint), provider="p").awaitTermination(60)
        return sorted((r["security_id"], r["trade_date"], float(r["close"])) for r in stored_bars(spark, root).collect())

    respond(incoming, "a.json", 1, ((2024, 1, 2), 1.5), ((2024, 3, 4), 2.5))
    first = run("one")
    respond(incoming, "b.json", 2, ((2024, 3, 5), 7.0), ((2024, 3, 5), 6.0))
    both = run("two")
    assert both == first + [(2, dt.date(2024, 3, 5), 7.0)]
    months = {p.name: sorted(x.name for x in p.iterdir() if x.is_dir()) for p in (tmp_path / "tables/daily_prices/data").iterdir()}
    respond(incoming, "c.json", 3, ((2024, 1, 9), 1.0))
    assert run("two") == both + [(3, dt.date(2024, 1, 9), 1.0)]
    newest = {p.name for p in (tmp_path / "tables/daily_prices/data").iterdir()} - set(months)
    assert [sorted(x.name for x in (tmp_path / "tables/daily_prices/data" / v).iterdir() if x.is_dir()) for v in newest] == [["month=2024-01"]]
