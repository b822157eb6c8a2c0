"""Event dates, cohorts and alignment of events to stored bars."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockstep.functions.numeric import all_of


def event_date() -> Column:
    return F.coalesce("stated_expiration_date", "calculated_expiration_date")


def event_source() -> Column:
    return (F.when(F.col("stated_expiration_date").isNotNull(), "stated")
            .when(F.col("calculated_expiration_date").isNotNull(), "calculated"))


def with_event_date(lockups: DataFrame) -> DataFrame:
    """The stated date wins over the calculated one; the source is kept."""
    return lockups.withColumns({"event_date": event_date(), "event_date_source": event_source()})


def promoted_primary() -> Column:
    """Primary agreement selected *and* dated on the offering."""
    return ((F.col("lockup_id") == F.col("primary_lockup_id"))
            & F.col("primary_lockup_expiration_date").isNotNull())


def selected_primary() -> Column:
    """Primary agreement selected; its date is not looked at."""
    return F.col("lockup_id") == F.col("primary_lockup_id")


def cohort_predicate(*, classification_status=None, candidate_type=None, offering_status=None,
                     ticker=None, ipo_id=None, lockup_id=None, ticker_column="ticker",
                     primary: Column | None = None) -> Column:
    """AND of the given cohort filters; it always runs before any limit."""
    tests = [F.col(name) == value for name, value in (
        ("classification_status", classification_status), ("candidate_type", candidate_type),
        ("offering_status", offering_status), ("ipo_id", ipo_id), ("lockup_id", lockup_id))
        if value is not None]
    if ticker:
        tests.append(F.upper(F.trim(ticker_column)) == ticker.strip().upper())
    if primary is not None:
        tests.append(primary)
    return all_of(tests)


CLEAN = dict(classification_status="classified", candidate_type="operating_company_ipo",
             offering_status="priced")


def analysis_cohort(lockups: DataFrame, ipos: DataFrame, companies: DataFrame, *,
                    lockup_id=None, ipo_id=None, ticker=None, primary_lockup_only=False,
                    **status) -> DataFrame:
    """Lock-ups to analyse; an explicit ``lockup_id`` overrides primary and status filters."""
    rows = (lockups.join(ipos, "ipo_id")
            .join(companies.select("company_id", "ticker", F.col("name").alias("company_name")),
                  "company_id"))
    if lockup_id is not None:
        keep = cohort_predicate(lockup_id=lockup_id, ipo_id=ipo_id, ticker=ticker)
    else:
        keep = cohort_predicate(
            ipo_id=ipo_id, ticker=ticker, **status,
            primary=promoted_primary() if primary_lockup_only else selected_primary())
    return rows.where(keep)


def primary_security(securities: DataFrame) -> DataFrame:
    """Lowest primary security id per company."""
    return (securities.where("is_primary").groupBy("company_id")
            .agg(F.min("security_id").alias("security_id")))


def event_level_limit(rows: DataFrame, limit: int, *, order: list[str]) -> DataFrame:
    """Keep every row of the first ``limit`` events, ordered by earliest event date."""
    chosen = (rows.groupBy("lockup_id", *order).agg(F.min("event_date").alias("_first"))
              .orderBy("_first", *order, "lockup_id").limit(limit).select("lockup_id"))
    return rows.join(chosen, "lockup_id", "left_semi")


def one_bar_per_day(prices: DataFrame, providers: list[str] | None = None) -> DataFrame:
    """One bar per (security, day), by provider preference and then provider name.

    This bounds every per-security window by the calendar horizon, however many raw
    rows a security has.  The grouping combines on the map side.
    """
    rank = F.lit(0)
    for position, name in enumerate(providers or []):
        rank = F.when(F.col("provider") == name, position - len(providers)).otherwise(rank)
    fields = ["open", "high", "low", "close", "volume"]
    best = F.min_by(F.struct("provider", *fields), F.struct(rank.alias("r"), F.col("provider")))
    return (prices.groupBy("security_id", "trade_date").agg(best.alias("_b"))
            .select("security_id", "trade_date", *[
                F.col(f"_b.{c}").cast("double").alias(c) if c != "volume" else
                F.col("_b.volume").alias(c) for c in fields]))


def align_to_bars(probes: DataFrame, bars: DataFrame) -> DataFrame:
    """As-of-forward: the first stored bar on or after each (security, event date).

    Events are first reduced to distinct dates, so a security contributes at most
    one horizon of probes and one of bars to its window, whatever its popularity.
    Returns ``security_id, event_date, event_bn, event_trade_date, bars_stored,
    latest_bar``; unaligned probes keep null bar columns.
    """
    dates = probes.where(F.col("event_date").isNotNull()).select("security_id", "event_date").distinct()
    both = (bars.select("security_id", F.col("trade_date").alias("_d"), F.lit(1).alias("_bar"))
            .unionByName(dates.select("security_id", F.col("event_date").alias("_d"),
                                      F.lit(0).alias("_bar"))))
    ordered = Window.partitionBy("security_id").orderBy("_d", "_bar")
    backwards = Window.partitionBy("security_id").orderBy(F.desc("_d"), F.desc("_bar"))
    whole = Window.partitionBy("security_id")
    on_bar = F.when(F.col("_bar") == 1, F.col("_d"))
    stage = both.withColumns({
        "_before": F.sum("_bar").over(ordered),
        "bars_stored": F.sum("_bar").over(whole),
        "latest_bar": F.max(on_bar).over(whole),
        # Walking backwards, the smallest bar date seen so far is the next bar.
        "event_trade_date": F.min(on_bar).over(backwards),
    })
    return (stage.where("_bar = 0").select(
        "security_id", F.col("_d").alias("event_date"),
        F.when(F.col("event_trade_date").isNotNull(), F.col("_before") + 1).alias("event_bn"),
        "event_trade_date", "bars_stored", "latest_bar"))


def numbered_bars(bars: DataFrame) -> DataFrame:
    """Stored-bar ordinal ``bn`` within each security."""
    return bars.withColumn("bn", F.row_number().over(
        Window.partitionBy("security_id").orderBy("trade_date")))


def stored_bar_offset(aligned: DataFrame, bars: DataFrame, offsets) -> DataFrame:
    """The bar ``k`` stored bars away from the aligned event bar; absent if out of range."""
    grid = aligned.withColumn("bar_offset", F.explode(F.array(*[F.lit(k) for k in offsets])))
    target = numbered_bars(bars).select("security_id", F.col("bn").alias("_bn"),
                                        F.col("trade_date").alias("bar_date"),
                                        F.col("close").alias("bar_close"))
    return grid.withColumn("_bn", F.col("event_bn") + F.col("bar_offset")) \
        .join(target, ["security_id", "_bn"]).drop("_bn")


def history_as_of(bars: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Bars on or before a per-security cutoff date: the look-ahead guard.

    Of several cutoffs of a security the latest counts, so a bar never appears twice.
    """
    latest = cutoffs.groupBy("security_id").agg(F.max("cutoff_date").alias("cutoff_date"))
    return bars.join(latest, "security_id").where(F.col("trade_date") <= F.col("cutoff_date"))
