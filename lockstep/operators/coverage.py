"""Calendar coverage of stored bars, gap islands and attempt provenance."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockstep.functions.day_bits import SPAN, day_at, day_number, day_words, has, runs, session_words
from lockstep.operators.calendar_ops import with_session_at, with_session_index
from lockstep.operators.events import with_event_date

RANGE = ["security_id", "start_date", "end_date"]
# Session ordinals stay below 2**14 over the whole horizon.
_LEVELS = 15
ATTEMPT_STATUSES = ("success", "no_data", "partial", "error")


def selected_rows(ipos: DataFrame, companies: DataFrame, lockups: DataFrame, securities: DataFrame) -> DataFrame:
    """Offering x issuer x every agreement x every primary security (fan-out is wanted)."""
    scope = securities.where("is_primary").select("company_id", "security_id", "ticker", "provider_symbol")
    return (with_event_date(lockups).join(ipos, "ipo_id")
            .join(companies.select("company_id", F.col("name").alias("company_name")), "company_id")
            .join(scope, "company_id"))


def explicit_tasks(rows: DataFrame, start_date, end_date) -> DataFrame:
    """One task per security for an explicit range, however many agreements selected it."""
    return (rows.select("security_id").distinct()
            .withColumns({"start_date": F.lit(start_date), "end_date": F.lit(end_date)}))


def plan_lockup_coverage(rows: DataFrame) -> DataFrame:
    """Event session, its -60 snapshot session and the 20 sessions before that, of dated agreements."""
    return _planned_rows(rows.where("event_date is not null"))


def _planned_rows(rows: DataFrame) -> DataFrame:
    df = with_session_index(rows, "event_date", "_c_")
    df = df.withColumn("event_ix", F.col("_c_next_ix")).drop("_c_ix", "_c_next_ix", "_c_prev_ix")
    df = with_session_at(df, F.col("event_ix"), "event_session")
    df = with_session_at(df, F.col("event_ix") - 60, "earliest_snapshot_session")
    df = with_session_at(df, F.col("event_ix") - 80, "earliest_feature_session")
    return df.withColumns({"start_date": F.col("earliest_feature_session"), "end_date": F.col("event_session")})


def derived_tasks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Agreement-scoped tasks, and the undated agreements that cannot be planned."""
    skipped = rows.where("event_date is null").select("ipo_id", "lockup_id", "security_id").withColumn(
        "status", F.lit("no_known_event_date"))
    return plan_lockup_coverage(rows), skipped


def presence(prices: DataFrame) -> DataFrame:
    """Stored days of each security, as words of a bitmap: one row a security."""
    return day_words(prices, ["security_id"], {"stored": F.col("trade_date")})


def spread(rows: DataFrame) -> DataFrame:
    """Distinct rows of a security dealt by it to all tasks: few bytes, but much work in each.

    A security has at most one row a day of the horizon and kind of range, so none is hot.
    """
    return rows.distinct().repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "security_id")


def range_days(ranges: DataFrame, prices: DataFrame, as_of_date) -> DataFrame:
    """One row per distinct range with arrays of day numbers: sessions, missing, fetchable and extra.

    Ranges meet the one row of their security and test bits; no range is expanded by
    day.  ``extra`` are stored days without a session.  Days outside the horizon are in
    no range.
    """
    opened = session_words(ranges.sparkSession)
    first, last = F.greatest(day_number(F.col("start_date")), F.lit(0)), F.least(day_number(F.col("end_date")), F.lit(SPAN - 1))
    # Named days before the join: sides that share a column only by name stay apart.
    stored = presence(prices).select(F.col("security_id").alias("_security"), "stored")
    rows = (spread(ranges.select(*RANGE)).join(stored, F.col("security_id") == F.col("_security"), "left").drop("_security")
            .withColumn("days", F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))))
    rows = rows.withColumns({
        "sessions": F.filter("days", lambda d: has(opened, d)),
        "extra": F.filter("days", lambda d: has(F.col("stored"), d) & ~has(opened, d))}).drop("days")
    rows = rows.withColumn("missing", F.filter("sessions", lambda d: ~has(F.col("stored"), d)))
    return rows.withColumn("fetchable", F.filter("missing", lambda d: d <= day_number(F.lit(as_of_date))))


def told_days(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row per day number of an array column.

    The outer form: an inferred "array is not empty" filter would be pushed below the
    expressions the array comes from, and compute them anew for every element.
    """
    return rows.select(*keys, F.explode_outer(name).alias("_day")).where("_day is not null")


def coverage_days(ranges: DataFrame, prices: DataFrame, as_of_date) -> DataFrame:
    """The missing sessions of each distinct range as rows, with ``ix`` and whether they are fetchable."""
    rows = told_days(range_days(ranges, prices, as_of_date), RANGE, "missing")
    rows = rows.select(*RANGE, day_at(F.col("_day")).alias("day"))
    days = with_session_index(rows, "day", "").drop("next_ix", "prev_ix")
    return days.withColumn("fetchable", F.col("day") <= F.lit(as_of_date))


def coverage(ranges: DataFrame, prices: DataFrame, as_of_date, *, provider: str | None = None) -> DataFrame:
    """One row per range with session lists, counts and the coverage ratio."""
    if provider is not None:
        prices = prices.where(F.col("provider") == provider)
    rows = range_days(ranges, prices, as_of_date)
    dates = lambda name: F.transform(name, day_at)
    expected, missing = F.size("sessions").cast("long"), F.size("missing").cast("long")
    out = rows.select(
        *RANGE, day_at(F.get("sessions", F.lit(0))).alias("canonical_start_session"),
        day_at(F.get("sessions", F.size("sessions") - 1)).alias("canonical_end_session"),
        expected.alias("expected_session_count"), (expected - missing).alias("stored_expected_session_count"),
        missing.alias("missing_session_count"), dates("sessions").alias("expected_sessions"), dates("missing").alias("missing_sessions"),
        dates("fetchable").alias("fetchable_missing_sessions"),
        dates(F.slice("missing", F.size("fetchable") + 1, F.size("missing"))).alias("future_missing_sessions"),
        dates("extra").alias("non_session_stored_dates"))
    return out.withColumns({
        "coverage_complete": F.col("missing_session_count") == 0,
        "coverage_ratio": F.coalesce(F.try_divide("stored_expected_session_count", "expected_session_count"),
                                     F.lit(1.0))})


def coverage_summary(selected: DataFrame, prices: DataFrame, as_of_date) -> DataFrame:
    """Totals over the tasks of selected rows, in one pass; a range shared by several tasks counts once per task."""
    rows = _planned_rows(selected)
    days = range_days(rows.where("start_date is not null"), prices, as_of_date)
    size = lambda name: F.size(name).cast("long")
    days = days.select(*RANGE, size("sessions").alias("_expected"), size("missing").alias("_missing"), size("fetchable").alias("_gaps"))
    future = F.col("_missing") - F.col("_gaps")
    total = lambda column: F.coalesce(F.sum(column), F.lit(0).cast("long"))
    return rows.join(days, RANGE, "left").agg(
        F.count(F.lit(1)).alias("lockups_selected"),
        F.count_if(F.col("event_date").isNull()).alias("lockups_skipped_no_event_date"),
        F.count("_expected").alias("securities_seen"), F.count_if(F.col("_missing") == 0).alias("securities_complete"),
        F.count_if(F.col("_gaps") > 0).alias("securities_with_gaps"),
        F.count_if((future > 0) & (F.col("_gaps") == 0)).alias("securities_future_sessions_only"),
        total("_expected").alias("expected_sessions"), total(F.col("_expected") - F.col("_missing")).alias("stored_expected_sessions"),
        total("_missing").alias("missing_sessions_total"), total("_gaps").alias("fetchable_missing_sessions"),
        total(future).alias("future_missing_sessions"), F.count("event_date").alias("lockups_plannable"))


def feature_window_coverage(windows: DataFrame, prices: DataFrame) -> DataFrame:
    """Presence in the 21 sessions ending at each ``(security_id, obs_ix)``."""
    rows = window_sessions(windows, prices)
    required, missing = F.size("sessions").cast("long"), F.size("missing").cast("long")
    return rows.select("security_id", "obs_ix", required.alias("required_count"), (required - missing).alias("present_count"),
                       F.transform("missing", day_at).alias("missing_sessions"),
                       ((missing == 0) & (required > 0)).alias("complete"))


def window_sessions(windows: DataFrame, prices: DataFrame) -> DataFrame:
    """``with_window_sessions`` of each distinct window."""
    return with_window_sessions(spread(windows.select("security_id", "obs_ix")), prices)


def with_window_sessions(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Append the 21 sessions ending at ``obs_ix``, and those without a bar of any provider, as arrays of day numbers."""
    opened = session_words(rows.sparkSession)
    rows = with_session_at(rows, F.col("obs_ix"), "_end")
    # A window that starts before the horizon has the sessions the horizon has; one that ends after it has none there.
    rows = with_session_at(rows, F.greatest(F.col("obs_ix") - 20, F.lit(1)), "_start")
    stored = presence(prices).select(F.col("security_id").alias("_security"), "stored")
    rows = rows.join(stored, F.col("security_id") == F.col("_security"), "left").drop("_security")
    days = F.sequence(day_number(F.col("_start")), day_number(F.col("_end")))
    rows = rows.withColumn("sessions", F.filter(F.coalesce(days, F.array().cast("array<int>")), lambda d: has(opened, d)))
    return rows.withColumn("missing", F.filter("sessions", lambda d: ~has(F.col("stored"), d))).drop("_start", "_end", "stored")


def _cover_nodes(first: Column, last: Column) -> Column:
    """Blocks of 2**level sessions that tile [first, last] exactly (at most two per level)."""
    nodes = []
    for level in range(_LEVELS):
        size = 1 << level
        low = F.shiftright(first + F.lit(size - 1), level)
        high = F.shiftright(last + 1, level)
        for keep, block in (((low % 2) == 1, low), ((high % 2) == 1, high - 1)):
            nodes.append(F.when((low < high) & keep, F.struct(F.lit(level).alias("level"), block.alias("block"))))
    return F.filter(F.array(*nodes), lambda n: n.isNotNull())


def latest_attempts(attempts: DataFrame, days: DataFrame) -> DataFrame:
    """Status of the latest attempt whose range covers each ``(security_id, ix)``.

    A range join would pair every attempt with every day it covers.  Instead each
    range becomes a few aligned blocks, attempts combine per block before the shuffle,
    and a day looks up the blocks that contain it, one for each level that occurs.
    """
    ranged = with_session_index(with_session_index(attempts, "requested_start_date", "_s_"),
                                "requested_end_date", "_e_")
    first, last = F.col("_s_next_ix"), F.col("_e_prev_ix")
    best = F.struct("attempted_at", "attempt_id", "status")
    blocks = (ranged.where(first <= last)
              .select("security_id", best.alias("_a"), F.explode_outer(_cover_nodes(first, last)).alias("n"))
            .where("n is not null")
              .groupBy("security_id", "n.level", "n.block").agg(F.max("_a").alias("_a")))
    # Only levels a security's attempts have, and only securities with attempts: a few rows a day.
    levels = blocks.groupBy("security_id").agg(F.collect_set("level").alias("levels"))
    lookups = (days.select("security_id", "ix").join(levels, "security_id")
               .select("security_id", "ix", F.explode("levels").alias("level"))
               .withColumn("block", F.expr("shiftright(ix, level)")))
    return (lookups.join(blocks, ["security_id", "level", "block"])
            .groupBy("security_id", "ix").agg(F.max("_a").alias("_a"))
            .select("security_id", "ix", F.col("_a.status").alias("latest_status")))


def known_no_data(attempts: DataFrame, provider: str, days: DataFrame) -> DataFrame:
    """Distinct ``(security_id, ix)`` inside any no-data range of the provider."""
    silent = attempts.where((F.col("provider") == provider) & (F.col("status") == "no_data"))
    return latest_attempts(silent, days.select("security_id", "ix").distinct()).drop("latest_status")


def validate_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts with a known status and an ordered range."""
    return attempts.where(F.col("status").isin(*ATTEMPT_STATUSES)
                          & (F.col("requested_start_date") <= F.col("requested_end_date")))


ATTEMPT_IDENTITY = ["security_id", "provider", "requested_start_date", "requested_end_date", "status"]


def reconcile_attempts(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Valid incoming attempts without an equivalent stored one; stored rows stay untouched."""
    fresh = validate_attempts(incoming).dropDuplicates(ATTEMPT_IDENTITY)
    return fresh.join(stored.select(*ATTEMPT_IDENTITY), ATTEMPT_IDENTITY, "left_anti")


def resolve_tickers(requests: DataFrame, securities: DataFrame) -> DataFrame:
    """Security per requested ticker; ``resolution`` tells unknown and ambiguous ones apart."""
    found = securities.groupBy(F.upper(F.trim("ticker")).alias("_t")).agg(
        F.count(F.lit(1)).alias("_n"), F.min("security_id").alias("security_id"))
    out = requests.join(found, F.upper(F.trim(requests["ticker"])) == F.col("_t"), "left")
    return out.withColumns({
        "resolution": F.when(F.col("_n").isNull(), "unknown").when(F.col("_n") > 1, "ambiguous").otherwise("ok"),
        "security_id": F.when(F.col("_n") == 1, F.col("security_id"))}).drop("_t", "_n")


def silent_words(attempts: DataFrame, provider: str) -> DataFrame:
    """Days inside any no-data range of the provider, as words: one row a security.

    A security's ranges first become disjoint ones, which together have a bit a day at most.
    """
    start, end = F.col("requested_start_date"), F.col("requested_end_date")
    asked = attempts.where((F.col("provider") == provider) & (F.col("status") == "no_data") & (start <= end)).groupBy(
        "security_id", F.greatest(day_number(start), F.lit(0)).alias("_first")).agg(F.max(F.least(day_number(end), F.lit(SPAN - 1))).alias("_last"))
    # One row a security and first day: bounded by the horizon.
    order = Window.partitionBy("security_id").orderBy("_first")
    before = F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parted = asked.withColumn("_from", F.greatest("_first", F.coalesce(before + 1, F.lit(0)))).where("_from <= _last")
    days = parted.select("security_id", F.explode(F.sequence("_from", "_last")).alias("_day"))
    return day_words(days, ["security_id"], {"silent": day_at(F.col("_day"))})


def planned(ranges: DataFrame, prices: DataFrame, attempts: DataFrame, provider: str, as_of_date, *,
            retry_known_no_data: bool = False) -> DataFrame:
    """``range_days`` with the days already answered empty (``silent`` words) and the requests as runs of days."""
    rows = range_days(ranges, prices, as_of_date)
    if retry_known_no_data:
        rows = rows.withColumn("silent", F.lit(None).cast("array<bigint>"))
    else:
        known = silent_words(attempts, provider).select(F.col("security_id").alias("_security"), "silent")
        rows = rows.join(known, F.col("security_id") == F.col("_security"), "left").drop("_security")
    last = day_number(F.lit(as_of_date))
    fetchable = lambda d: ~has(F.col("stored"), d) & (d <= last)
    return rows.withColumns({
        "planned": runs(F.col("sessions"), fetchable),
        "requests": runs(F.col("sessions"), lambda d: fetchable(d) & ~has(F.col("silent"), d)),
        "skipped": runs(F.col("sessions"), lambda d: fetchable(d) & has(F.col("silent"), d))})


def run_rows(rows: DataFrame, name: str) -> DataFrame:
    """The runs of a ``planned`` column as request ranges; closures between sessions do not split."""
    return rows.select(*RANGE, F.explode_outer(name).alias("_run")).where("_run is not null").select(
        *RANGE, day_at(F.col("_run.first")).alias("range_start"), day_at(F.col("_run.last")).alias("range_end"),
        F.col("_run.size").alias("sessions"))


def request_ranges(plan: DataFrame) -> DataFrame:
    return run_rows(plan, "requests")


def backfill_plan(ranges: DataFrame, prices: DataFrame, attempts: DataFrame, securities: DataFrame,
                  provider: str, as_of_date, *, retry_known_no_data: bool = False) -> DataFrame:
    """Dry-run status and range counts of each repair range."""
    rows = planned(ranges, prices, attempts, provider, as_of_date, retry_known_no_data=retry_known_no_data)
    count = lambda name: F.size(name).cast("long")
    out = rows.select(
        *RANGE, count("missing").alias("missing_sessions"), count("fetchable").alias("fetchable_sessions"),
        F.coalesce(F.aggregate("skipped", F.lit(0).cast("long"), lambda n, r: n + r["size"]), F.lit(0)).alias("known_no_data_sessions"),
        count("planned").alias("planned_ranges"), count("requests").alias("request_ranges"), count("skipped").alias("skipped_ranges"))
    symbols = securities.select("security_id", F.coalesce("provider_symbol", "ticker").alias("_symbol"))
    status = (F.when((F.col("planned_ranges") == 0) & (F.col("missing_sessions") == 0), "complete")
              .when(F.col("planned_ranges") == 0, "future_sessions_only")
              .when(F.col("request_ranges") == 0, "known_no_data")
              .when(F.coalesce("_symbol", F.lit("")) == "", "no_security_symbol")
              .otherwise("missing_sessions"))
    return out.join(symbols, "security_id", "left").withColumn("status", status).drop("_symbol")


REQUEST = ["security_id", "range_start", "range_end"]


def apply_delivery(plan: DataFrame, delivered: DataFrame, prices: DataFrame, provider: str,
                   failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted bars, and one attempt row per request, from delivered provider bars.

    ``plan`` are the rows of ``planned``.  ``delivered`` carries the request key (``security_id, range_start, range_end``)
    and bar columns.  Only fetchable sessions are accepted.
    """
    requests = request_ranges(plan)
    # Days to be delivered, once a security: what is asked for has to be told day by day.
    asked = told_days(plan, ["security_id", "silent"], "fetchable").select(
        "security_id", day_at(F.col("_day")).alias("trade_date"), (~has(F.col("silent"), F.col("_day"))).alias("_wanted"))
    asked = asked.groupBy("security_id", "trade_date").agg(F.max("_wanted").alias("_wanted"))
    known = prices.where(F.col("provider") == provider).select(
        "security_id", "trade_date", F.lit(True).alias("_stored"))
    accepted = (delivered.join(asked, ["security_id", "trade_date"])
                .join(known, ["security_id", "trade_date"], "left"))
    inside = F.col("trade_date").between(F.col("range_start"), F.col("range_end"))
    taken = accepted.groupBy(*REQUEST).agg(
        F.count_if(F.col("_stored").isNull()).alias("bars_created"), F.count_if("_stored").alias("bars_updated"),
        F.count_if(F.col("_wanted") & inside).alias("_covered"))
    answered = delivered.groupBy(*REQUEST).agg(F.count(F.lit(1)).alias("bars_returned"))
    out = requests.select(*REQUEST, "sessions").distinct().join(answered, REQUEST, "left").join(taken, REQUEST, "left")
    if failed is not None:
        out = out.join(failed.select(*REQUEST, "error_message"), REQUEST, "left")
    else:
        out = out.withColumn("error_message", F.lit(None).cast("string"))
    numbers = ("bars_returned", "bars_created", "bars_updated", "_covered")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in numbers})
    status = (F.when(F.col("error_message").isNotNull(), "error").when(F.col("bars_returned") == 0, "no_data")
              .when(F.col("_covered") == F.col("sessions"), "success").otherwise("partial"))
    attempts = out.withColumns({"status": status, "provider": F.lit(provider)}).drop("_covered", "sessions")
    return accepted.drop("_stored", "_wanted"), attempts


def delivery_status(plan: DataFrame, covered_after: DataFrame, attempts: DataFrame) -> DataFrame:
    """Final status of each range after its delivery was applied.

    ``plan`` are the rows the requests were made from: a request belongs to the range
    whose gap it is, so attempts come to their ranges by equal keys.
    """
    requests = request_ranges(plan).select(*RANGE, "range_start", "range_end").distinct()
    per_range = (requests.join(attempts, REQUEST, "left").groupBy(*RANGE).agg(
        F.count_if(F.col("status") == "error").alias("provider_errors"),
        F.count_if(F.col("status") == "no_data").alias("provider_no_data"),
        F.coalesce(F.sum("bars_created"), F.lit(0)).alias("bars_created"),
        F.coalesce(F.sum("bars_updated"), F.lit(0)).alias("bars_updated")))
    rows = covered_after.join(per_range, RANGE, "left")
    status = (F.when(F.col("coverage_complete"), "complete")
              .when((F.size("fetchable_missing_sessions") == 0) & (F.size("future_missing_sessions") > 0),
                    "future_sessions_only")
              .when(F.col("provider_errors") > 0, "provider_error")
              .when((F.col("provider_no_data") > 0) & (F.col("bars_created") == 0), "provider_no_data")
              .when((F.col("bars_created") > 0) | (F.col("bars_updated") > 0), "partially_backfilled")
              .otherwise("missing_sessions"))
    return rows.withColumn("status", status)
