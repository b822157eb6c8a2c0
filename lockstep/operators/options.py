"""Feasibility of historical option data, from contract and quote tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockstep.operators.calendar_ops import with_session_at, with_session_index

# Optional quote fields, follow-up sessions, blocking error categories.
OPTIONAL_FIELDS = ("bid_size", "ask_size", "last_price", "volume", "open_interest", "implied_volatility", "greeks")
FOLLOW_UPS = (("event", 0), ("plus_1", 1), ("plus_5", 5), ("plus_10", 10), ("plus_20", 20))
BLOCKED = ("authentication_failure", "entitlement_plan_restriction")


def sample_pool(cohort: DataFrame, signals: DataFrame, as_of_date) -> DataFrame:
    """Cohort rows whose T-5 session is reached, flagged when any signal exists."""
    known = signals.select("lockup_id", F.lit(True).alias("_known")).distinct()
    df = with_session_index(cohort.where("event_date is not null"), "event_date", "_c_") \
        .withColumn("event_ix", F.col("_c_next_ix")).drop("_c_ix", "_c_next_ix", "_c_prev_ix")
    df = with_session_at(df, F.col("event_ix"), "event_session")
    df = with_session_at(df, F.col("event_ix") - 5, "t5_date")
    return (df.where(F.col("t5_date") <= F.lit(as_of_date)).join(known, "lockup_id", "left")
            .withColumn("is_signal_name", F.col("_known").isNotNull()).drop("_known"))


def select_sample(pool: DataFrame, limit: int, *, tickers: tuple[str, ...] = ()) -> DataFrame:
    """One signalled name first, then oldest and newest in turn; explicit tickers keep their order.

    Only the ``limit`` rows at either end can be chosen, so both ends are top-n sorts.
    """
    key = ["event_date", "ticker", "lockup_id"]
    if tickers:
        named = pool.where(F.upper("ticker").isin(*[t.upper() for t in tickers]))
        return named.orderBy(F.desc("is_signal_name"), *key).limit(limit)
    # One more than can be chosen from either end, for the lead may be among them.
    last = [F.desc(c) for c in key]
    few = (pool.where("is_signal_name").orderBy(*key).limit(1)
           .unionByName(pool.orderBy(*key).limit(limit + 1)).unionByName(pool.orderBy(*last).limit(limit + 1))
           .dropDuplicates(["lockup_id"]))
    # At most 2 * limit + 3 rows from here on, so one small window numbers them.
    lead = F.col("is_signal_name") & (F.row_number().over(Window.partitionBy("is_signal_name").orderBy(*key)) == 1)
    few = few.withColumn("_lead", lead)
    turn = F.least(2 * F.row_number().over(Window.partitionBy("_lead").orderBy(*key)) - 1,
                   2 * F.row_number().over(Window.partitionBy("_lead").orderBy(*last)))
    chosen = few.withColumn("_turn", F.when(F.col("_lead"), 0).otherwise(turn))
    return chosen.orderBy("_turn").limit(limit).drop("_turn", "_lead")


def select_contracts(sample: DataFrame, contracts: DataFrame) -> DataFrame:
    """Earliest live put per name: by expiration, then strike as text, then symbol.

    A name needs the first expiration on or after its T-5 date and the number of live
    contracts.  Both come from one backward pass over the distinct expirations and
    distinct T-5 dates of an underlying, so names and contracts are never paired.
    """
    expires = F.try_to_date("expiration_date", "yyyy-MM-dd")
    live = contracts.withColumn("_d", expires).where(
        F.col("_d").isNotNull() & (F.coalesce("contract_symbol", F.lit("")) != ""))
    strike = F.coalesce(F.col("strike_price").cast("string"), F.lit(""))
    live = live.groupBy("underlying_ticker", "_d").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct(strike.alias("k"), F.col("contract_symbol"))).alias("_b"))
    live = live.select("underlying_ticker", "_d", F.lit(0).alias("_kind"), "_n",
                       F.struct("_d", "_b.k", "_b.contract_symbol").alias("_b"))
    probes = sample.select(F.col("ticker").alias("underlying_ticker"), F.col("t5_date").alias("_d")).distinct() \
        .withColumn("_kind", F.lit(1))
    backwards = Window.partitionBy("underlying_ticker").orderBy(F.desc("_d"), "_kind")
    seen = live.unionByName(probes, allowMissingColumns=True).withColumns({
        "put_contracts_found": F.sum("_n").over(backwards), "_best": F.min("_b").over(backwards)})
    found = seen.where("_kind = 1").select(F.col("underlying_ticker").alias("ticker"), F.col("_d").alias("t5_date"),
                                           "put_contracts_found", "_best")
    listed = contracts.groupBy(F.col("underlying_ticker").alias("ticker")).agg(F.count(F.lit(1)).alias("_listed"))
    status = (F.when(F.col("put_contracts_found") > 0, "historical_contracts_found")
              .when(F.col("_listed") > 0, "malformed_contract_metadata").otherwise("no_contracts"))
    out = sample.join(found, ["ticker", "t5_date"], "left").join(listed, "ticker", "left").withColumns({
        "put_contracts_found": F.coalesce("put_contracts_found", F.lit(0)),
        "contract_discovery_status": status, "contract_symbol": F.col("_best.contract_symbol"),
        "contract_expiration": F.col("_best._d")}).drop("_listed", "_best")
    out = with_session_at(out, F.col("event_ix") + 20, "_plus_20")
    return out.withColumn("expired_before_plus20", F.col("contract_expiration") < F.col("_plus_20")).drop("_plus_20")


def quote_day() -> Column:
    """UTC date of the first numeric nanosecond timestamp."""
    stamp = F.coalesce("sip_timestamp", "participant_timestamp", "timestamp")
    return F.to_date(F.timestamp_micros(F.floor(stamp / 1000).cast("long")))


def quote_summary(quotes: DataFrame) -> DataFrame:
    """Bid, ask and optional-field availability per contract and quoted UTC day."""
    present = [c for c in OPTIONAL_FIELDS if c in quotes.columns]
    out = quotes.withColumn("quote_date", quote_day()).where("quote_date is not null") \
        .groupBy("contract_symbol", "quote_date").agg(
        F.bool_or(F.col("bid_price").isNotNull()).alias("bid_available"),
        F.bool_or(F.col("ask_price").isNotNull()).alias("ask_available"),
        *[F.bool_or(F.col(c).isNotNull()).alias(f"has_{c}") for c in present])
    return out.withColumn("quote_field_status", F.when(
        F.col("bid_available") & F.col("ask_available"), "complete_bid_ask").otherwise("partial_fields"))


def follow_up_grid(selected: DataFrame, summary: DataFrame, as_of_date) -> DataFrame:
    """Quote status of each name at the event session and 1, 5, 10 and 20 sessions later."""
    labels = F.explode(F.array(*[F.struct(F.lit(a).alias("label"), F.lit(k).alias("k")) for a, k in FOLLOW_UPS]))
    grid = selected.where("contract_symbol is not null").withColumn("_l", labels)
    grid = with_session_at(grid.select("lockup_id", "contract_symbol", "contract_expiration", "event_ix", "_l.*"),
                           F.col("event_ix") + F.col("k"), "date")
    quotes = summary.select("contract_symbol", F.col("quote_date").alias("date"), "bid_available", "ask_available",
                            "quote_field_status")
    late, expired = F.col("date") > F.lit(as_of_date), F.col("date") > F.col("contract_expiration")
    rows = grid.join(quotes, ["contract_symbol", "date"], "left")
    return rows.withColumns({
        "status": F.when(late, "not_reached").when(expired, "contract_expired")
            .otherwise(F.coalesce("quote_field_status", F.lit("no_quotes"))),
        **{c: F.when(~late & ~expired, F.coalesce(c, F.lit(False))) for c in ("bid_available", "ask_available")}}) \
        .drop("quote_field_status", "event_ix", "k")


def name_results(selected: DataFrame, summary: DataFrame, grid: DataFrame, *, current: DataFrame | None = None,
                 errors: DataFrame | None = None) -> DataFrame:
    """One row per sampled name with the statuses the feasibility class looks at."""
    at_t5 = summary.select("contract_symbol", F.col("quote_date").alias("t5_date"), "quote_field_status",
                           F.col("bid_available").alias("historical_bid_available"),
                           F.col("ask_available").alias("historical_ask_available"))
    reached = ~F.col("status").isin("not_reached", "contract_expired")
    both = F.col("bid_available") & F.col("ask_available")
    later = grid.groupBy("lockup_id").agg(F.count_if(reached).alias("_reached"),
                                          F.count_if(reached & both).alias("_full"))
    df = selected.join(at_t5, ["contract_symbol", "t5_date"], "left").join(later, "lockup_id", "left")
    if errors is not None:
        df = df.join(errors.select("lockup_id", "error_category"), "lockup_id", "left")
    else:
        df = df.withColumn("error_category", F.lit(None).cast("string"))
    if current is not None:
        df = df.join(current.select("lockup_id", "current_chain_status"), "lockup_id", "left")
    else:
        df = df.withColumn("current_chain_status", F.lit("not_attempted"))
    found = F.col("contract_discovery_status") == "historical_contracts_found"
    status = (F.when(~found, "not_attempted").when((F.col("_reached") > 0) & (F.col("_full") == F.col("_reached")),
                                                   "historical_quotes_available")
              .when(F.col("_full") > 0, "partially_available").when(F.col("_reached") > 0, "unavailable")
              .otherwise("contract_expired"))
    return df.withColumns({"later_valuation_status": status, "historical_quote_status": F.when(
        found, F.coalesce("quote_field_status", F.lit("no_quotes"))).otherwise("not_attempted")}) \
        .drop("_reached", "_full", "quote_field_status")


def tri_state(test: Column) -> Column:
    """True when all rows pass, null when some do, false when none does; null without rows."""
    test = F.coalesce(test, F.lit(False))
    return F.when(F.count(F.lit(1)) == 0, F.lit(None).cast("boolean")).when(F.bool_and(test), True) \
        .when(F.bool_or(test), F.lit(None).cast("boolean")).otherwise(False)


def feasibility(names: DataFrame) -> DataFrame:
    """Class and tri-state support flags of the provider over all sampled names."""
    found = F.col("contract_discovery_status") == "historical_contracts_found"
    bid = F.coalesce("historical_bid_available", F.lit(False))
    ask = F.coalesce("historical_ask_available", F.lit(False))
    complete = F.coalesce(found, F.lit(False)) & bid & ask
    partial = F.coalesce(found & (bid | ask | (F.col("later_valuation_status") == "partially_available")), F.lit(False))
    one = names.agg(
        F.count(F.lit(1)).alias("sample_size"), F.count_if(F.col("error_category").isin(*BLOCKED)).alias("_blocked"),
        F.count_if(complete).alias("_complete"), F.count_if(partial).alias("_partial"),
        F.count_if(F.col("current_chain_status") == "current_chain_available").alias("_current"),
        tri_state(found).alias("historical_contract_discovery_supported"),
        tri_state(bid & ask).alias("historical_bid_ask_supported"),
        tri_state(F.col("later_valuation_status") == "historical_quotes_available")
        .alias("historical_followup_valuation_supported"))
    label = (F.when(F.col("sample_size") == 0, "provider_not_suitable")
             .when(F.col("_blocked") > 0, "provider_entitlement_unknown")
             .when(F.col("_complete") == F.col("sample_size"), "historical_backtest_feasible")
             .when((F.col("_complete") > 0) | (F.col("_partial") > 0), "historical_backtest_partially_feasible")
             .when(F.col("_current") > 0, "prospective_collection_only").otherwise("provider_not_suitable"))
    return one.withColumn("classification", label).drop("_blocked", "_complete", "_partial", "_current")
