"""Idempotent ingest merges: issuers, filings, candidates, securities and bars."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lockstep.functions.total_order import with_position
from lockstep.operators.calendar_ops import with_session_at, with_session_index


def upsert_companies(stored: DataFrame, filings: DataFrame) -> DataFrame:
    """``cik, name, created``: new issuers, and the latest usable name of known ones."""
    order = F.struct("filed_at", "accession_number")
    usable = F.when(F.length("company_name") > 2, F.col("company_name"))
    incoming = filings.groupBy("cik").agg(
        F.min_by("company_name", order).alias("_first"),
        F.max_by(usable, F.when(usable.isNotNull(), order)).alias("_last"))
    merged = stored.select("cik", F.col("name").alias("_stored"), F.lit(True).alias("_known")) \
        .join(incoming, "cik", "full_outer")
    return merged.select(
        "cik", F.coalesce("_last", "_stored", "_first").alias("name"),
        F.col("_known").isNull().alias("created"))


def insert_filings(stored: DataFrame, filings: DataFrame) -> DataFrame:
    """Filings whose accession is unknown; the first of several equal ones wins."""
    fields = [c for c in filings.columns if c != "accession_number"]
    order = F.struct("filed_at", "cik", "filing_path")
    first = filings.groupBy("accession_number").agg(F.min_by(F.struct(*fields), order).alias("_f"))
    return first.select("accession_number", "_f.*").join(
        stored.select("accession_number"), "accession_number", "left_anti")


def upsert_candidates(stored: DataFrame, filings: DataFrame) -> DataFrame:
    """One candidate per issuer with its earliest registration date."""
    incoming = filings.groupBy("cik").agg(F.min("filed_at").alias("_new"))
    known = stored.select("cik", F.col("first_filing_date").alias("_old"), F.lit(True).alias("_known"))
    return known.join(incoming, "cik", "full_outer").select(
        "cik", F.least("_old", "_new").alias("first_filing_date"), F.col("_known").isNull().alias("created"))


def ingest_counts(companies: DataFrame, stored_filings: DataFrame, candidates: DataFrame,
                  filings: DataFrame) -> DataFrame:
    """Seen and created counters of one registration ingest."""
    from lockstep.operators.outcomes import side_by_side
    incoming = filings.select("cik").distinct()

    def created(stored, key, rows, name):
        return rows.join(stored.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias(name))

    return side_by_side([
        filings.agg(F.count(F.lit(1)).alias("candidate_filings_seen")),
        created(companies, "cik", incoming, "companies_created"),
        created(stored_filings, "accession_number", filings.select("accession_number").distinct(),
                "filings_created"),
        created(candidates, "cik", incoming, "ipo_candidates_created")])


def enrich_companies(companies: DataFrame, parsed: DataFrame) -> DataFrame:
    """Overwrite issuer attributes only by non-null, different values."""
    fresh = parsed.where("not malformed").select(
        "cik", *[F.col(c).alias(f"_{c}") for c in ("name", "ticker", "exchange")])
    joined = companies.join(fresh, "cik", "left")
    changed = F.lit(False)
    for c in ("name", "ticker", "exchange"):
        changed = changed | (F.col(f"_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")))
    return joined.withColumn("changed", changed).withColumns(
        {c: F.coalesce(f"_{c}", c) for c in ("name", "ticker", "exchange")}) \
        .drop("_name", "_ticker", "_exchange")


def append_submission_filings(stored: DataFrame, rows: DataFrame) -> DataFrame:
    fields = [c for c in rows.columns if c != "accession_number"]
    first = rows.groupBy("accession_number").agg(
        F.min_by(F.struct(*fields), F.struct("cik", "filed_at", "filing_path")).alias("_f"))
    return first.select("accession_number", "_f.*", F.lit("sec_submissions").alias("source")).join(
        stored.select("accession_number"), "accession_number", "left_anti")


def enrichment_counts(companies: DataFrame, parsed: DataFrame, stored_filings: DataFrame) -> DataFrame:
    from lockstep.operators.outcomes import side_by_side
    from lockstep.sources.filings import submission_filings
    rows = submission_filings(parsed)
    return side_by_side([
        enrich_companies(companies, parsed).agg(
            F.count(F.lit(1)).alias("companies_seen"), F.count_if(F.col("changed")).alias("companies_updated")),
        rows.agg(F.count(F.lit(1)).alias("filings_seen")),
        append_submission_filings(stored_filings, rows).agg(F.count(F.lit(1)).alias("filings_created")),
        parsed.agg(F.count_if(F.col("malformed")).alias("errors"))])


def initialise_securities(companies: DataFrame, securities: DataFrame) -> DataFrame:
    """Primary securities still missing, one per issuer with a usable ticker."""
    ticker = F.nullif(F.upper(F.trim("ticker")), F.lit(""))
    wanted = companies.select("company_id", ticker.alias("ticker"), "exchange").where("ticker is not null")
    known = securities.where(F.col("source") == "sec_company").select("company_id", "ticker")
    return wanted.join(known, ["company_id", "ticker"], "left_anti").withColumns({
        "is_primary": F.lit(True), "source": F.lit("sec_company"), "provider_symbol": F.col("ticker")})


def latest_completed_session(instants: DataFrame, column: str, output: str = "completed_session",
                             close_hour: int = 18) -> DataFrame:
    """Latest session whose 18:00 New York cutoff has passed; input must carry a zone."""
    if dict(instants.dtypes)[column] != "timestamp":
        raise ValueError("now must be a timezone-aware timestamp")
    local = F.from_utc_timestamp(column, "America/New_York")
    df = instants.withColumns({"_day": F.to_date(local), "_hour": F.hour(local)})
    df = with_session_index(df, "_day", "_c_")
    ready = F.when(F.col("_c_ix").isNull() | (F.col("_hour") >= close_hour), F.col("_c_prev_ix")) \
        .otherwise(F.col("_c_ix") - 1)
    return with_session_at(df.withColumn("_ready", ready), F.col("_ready"), output) \
        .drop("_day", "_hour", "_c_ix", "_c_next_ix", "_c_prev_ix", "_ready")


def fetch_plan(offerings: DataFrame, prices: DataFrame, provider: str, end_date, *, lookback_days: int,
               refresh: bool = False, refresh_days: int = 7) -> DataFrame:
    """Date range to request per security; ``skipped_current`` when nothing is due.

    ``offerings`` carries ``ipo_id, ipo_date, security_id``.
    """
    if lookback_days < 1 or refresh_days < 1:
        raise ValueError("market history lookback and refresh windows must be positive")
    latest = prices.where(F.col("provider") == provider).groupBy("security_id").agg(
        F.max("trade_date").alias("latest_stored"))
    end = F.lit(end_date)
    initial = F.coalesce("ipo_date", F.date_sub(end, lookback_days - 1))
    start = (F.greatest(initial, F.date_sub(end, refresh_days - 1)) if refresh
             else F.coalesce(F.date_add("latest_stored", 1), initial))
    return offerings.join(latest, "security_id", "left").withColumn("start_date", start).withColumns({
        "end_date": end, "skipped_current": F.col("start_date") > end})


def merge_bars(stored: DataFrame, fetched: DataFrame, *, refresh: bool = False) -> DataFrame:
    """Bars keyed by (security, date, provider): insert if absent, overwrite only on refresh."""
    key = ["security_id", "trade_date", "provider"]
    fields = [c for c in stored.columns if c not in key]
    both = stored.select(*key, *fields, F.lit(0 if not refresh else 1).alias("_rank")).unionByName(
        fetched.select(*key, *fields, F.lit(1 if not refresh else 0).alias("_rank")))
    # Preferred row per key; the rank filter is pushed into the map side of the window.
    best = Window.partitionBy(*key).orderBy("_rank")
    return both.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n", "_rank")


def ingest_report(plan: DataFrame, fetched: DataFrame, stored: DataFrame, *, refresh: bool = False,
                  failed: DataFrame | None = None, created: DataFrame | None = None,
                  missing: DataFrame | None = None) -> DataFrame:
    """Counters of one market-history run over planned requests and their responses.

    Requests, bars and failures are rows of one tagged table that is added up by security
    and then over all, so every source is read once.
    """
    from lockstep.operators.outcomes import side_by_side
    key = ["security_id", "trade_date", "provider"]
    due = (~F.col("skipped_current")).cast("long")
    bars = fetched.select(*key).join(stored.select(*key, F.lit(True).alias("_known")), key, "left")
    tagged = plan.select("security_id", F.lit(1).cast("long").alias("asked"), due.alias("due")).unionByName(
        bars.select("security_id", F.lit(1).cast("long").alias("bars"), F.when(F.col("_known"), 1).cast("long").alias("known")),
        allowMissingColumns=True)
    failures = failed.select("security_id") if failed is not None else plan.limit(0).select("security_id")
    tagged = tagged.unionByName(failures.withColumn("failed", F.lit(1).cast("long")), allowMissingColumns=True)
    names = ["asked", "due", "bars", "known", "failed"]
    by_security = tagged.groupBy("security_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    total = lambda column: F.coalesce(F.sum(column), F.lit(0)).cast("long")
    zero = F.lit(0).cast("long")
    errors = total(F.when(F.col("failed") > 0, F.col("due")))
    totals = by_security.agg(
        total("asked").alias("securities_seen"), total(F.col("asked") - F.col("due")).alias("skipped_current"),
        total("bars").alias("bars_fetched"), total(F.col("bars") - F.col("known")).alias("bars_created"),
        (total("known") if refresh else zero).alias("bars_updated"),
        total(F.when((F.col("bars") == 0) & (F.col("failed") == 0), F.col("due"))).alias("provider_no_data"),
        errors.alias("provider_errors"), errors.alias("errors"))
    counted = [rows.agg(F.count(F.lit(1)).alias(name)) for rows, name in (
        (created, "securities_created"), (missing, "symbols_missing")) if rows is not None]
    out = side_by_side([totals, *counted])
    for name in ("securities_created", "symbols_missing"):
        out = out if name in out.columns else out.withColumn(name, zero)
    return out.select("securities_seen", "skipped_current", "securities_created", "symbols_missing", "bars_fetched", "bars_created",
                      "bars_updated", "provider_no_data", "provider_errors", "errors")


def ingest_positions(offerings: DataFrame) -> DataFrame:
    """``position`` of every offering in ingest order, without ordering them all in one task."""
    priced = F.when(F.col("offering_status").isNull(), 0).when(F.col("offering_status") == "priced", 1).otherwise(2)
    newest = F.coalesce(-F.unix_date("first_filing_date"), F.lit(-(1 << 30)))
    return with_position(offerings, [priced, newest, F.col("ipo_id")])


def ingest_order(offerings: DataFrame) -> DataFrame:
    """Priced offerings first, then the newest registration; unknown dates lead."""
    return offerings.orderBy((F.col("offering_status") == "priced").desc_nulls_first(),
                             F.col("first_filing_date").desc_nulls_first(), "ipo_id")
