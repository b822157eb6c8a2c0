"""Domain tables derived from the driver's star schema.

Every view is a projection or a combining aggregate of whole tables, so its size
follows theirs.  Only integer and modulo arithmetic decides values, which keeps the
views reproducible in any SQL engine.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.session import configure

HOLDERS = ("existing_stockholders", "pre_ipo_investors", "selling_stockholders",
           "directors_officers", "employees", "unknown")
FORMS = ("S-1", "S-1/A", "EFFECT", "424B4", "8-A12B", "10-Q", "F-1", "RW", "8-K", "424B4", "s-1", "10-K")


def pick(values, index: Column) -> Column:
    """The value at a 0-based index of a short fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def owner(security: Column) -> Column:
    """Company of a security: every tenth supplier security is its neighbour's second one."""
    return F.when((security >= 1000) & (security % 10 == 9), security - 1).otherwise(security)


class Warehouse:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = configure(spark), path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    # -- market data ---------------------------------------------------------
    def daily_prices(self) -> DataFrame:
        """Daily OHLCV of three security tiers (dense, medium, sparse)."""
        cents = (2000 + F.round(F.col("l_discount") * 100).cast("long") * 20
                 + F.col("l_quantity").cast("long") * 2)
        ticks = self.table("lineitem").select(
            F.explode(F.array(1 + F.col("l_partkey") % 3, 100 + F.col("l_partkey") % 25,
                              1000 + F.col("l_suppkey"))).alias("security_id"),
            F.date_add(F.to_date("l_shipdate"), 1).alias("trade_date"), cents.alias("cents"),
            F.col("l_quantity").cast("long").alias("size"))
        days = ticks.groupBy("security_id", "trade_date").agg(
            F.min("cents").alias("lo"), F.max("cents").alias("hi"), F.sum("cents").alias("total"),
            F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n"))
        spread = F.col("hi") - F.col("lo") + 1
        return days.select(
            "security_id", "trade_date",
            ((F.col("lo") + (F.col("n") * 7 + F.col("volume")) % spread) / 100.0).alias("open"),
            (F.col("hi") / 100.0).alias("high"), (F.col("lo") / 100.0).alias("low"),
            ((F.col("lo") + F.col("total") % spread) / 100.0).alias("close"), "volume",
            F.when(F.col("security_id") % 10 == 3, "secondary").otherwise("primary").alias("provider"))

    def bars(self) -> DataFrame:
        """The stored bars; the view already holds one bar per security and day."""
        return self.daily_prices().drop("provider")

    def securities(self) -> DataFrame:
        part, supplier = self.table("part"), self.table("supplier")
        ids = (part.select(F.explode(F.array(1 + F.col("p_partkey") % 3, 100 + F.col("p_partkey") % 25))
                           .alias("security_id")).distinct()
               .unionByName(supplier.select((1000 + F.col("s_suppkey")).alias("security_id"))))
        s = F.col("security_id")
        ticker = F.concat(F.lit("T"), s.cast("string"))
        return ids.select(
            "security_id", owner(s).alias("company_id"), ticker.alias("ticker"),
            F.when(s % 2 == 0, "NYSE").otherwise("NASDAQ").alias("exchange"),
            F.lit("sec_company").alias("source"),
            F.when(s % 14 != 0, ticker).alias("provider_symbol"), (s % 13 != 5).alias("is_primary"))

    def companies(self) -> DataFrame:
        c = F.col("company_id")
        return self.securities().select("company_id").distinct().select(
            "company_id", F.lpad(c.cast("string"), 10, "0").alias("cik"),
            F.concat(F.lit("Company "), c.cast("string")).alias("name"),
            F.when(c % 19 != 0, F.concat(F.lit("T"), c.cast("string"))).alias("ticker"),
            F.when(c % 2 == 0, "NYSE").otherwise("NASDAQ").alias("exchange"))

    # -- offerings and agreements --------------------------------------------
    def lockups(self) -> DataFrame:
        key, cust = F.col("o_orderkey"), F.col("o_custkey")
        security = (F.when(key % 4 == 0, 1 + cust % 3).when(key % 4 == 1, 100 + cust % 25)
                    .otherwise(1000 + F.floor(cust / 15).cast("long")))
        day = F.to_date("o_orderdate")
        return self.table("orders").select(
            key.alias("lockup_id"), owner(security).alias("ipo_id"), key.alias("filing_id"),
            F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), day).alias("stated_expiration_date"),
            F.when(F.substring("o_orderpriority", 1, 1).isin("3", "4", "2"), F.date_add(day, 180))
            .alias("calculated_expiration_date"),
            F.when(key % 5 == 0, 90).otherwise(180).alias("duration_days"),
            pick(HOLDERS, key % 6).alias("holder_group"),
            F.when(F.col("o_orderstatus") == "P", "company_lockup").otherwise("underwriter_lockup")
            .alias("lockup_type"),
            pick((0.97, 0.92, 0.82), key % 3).alias("confidence"),
            (1000000 + key % 1000 * 100).alias("shares_locked"))

    def ipos(self) -> DataFrame:
        """One offering per company; its primary agreement is its first dated one."""
        c = F.col("ipo_id")
        first = (self.lockups().withColumn("d", F.coalesce("stated_expiration_date",
                                                           "calculated_expiration_date"))
                 .where("d is not null")
                 .groupBy("ipo_id").agg(F.min("lockup_id").alias("_lockup"),
                                        F.min_by("d", "lockup_id").alias("_expires")))
        base = self.companies().select(F.col("company_id").alias("ipo_id"), "company_id") \
            .join(first, "ipo_id", "left")
        listed = F.date_add(F.lit("1995-01-02").cast("date"), (c % 60).cast("int"))
        primary = 1000000 + c % 13 * 1000
        secondary = F.when(c % 6 != 0, c % 4 * 250000)
        return base.select(
            "ipo_id", "company_id", F.date_sub(listed, 90).alias("first_filing_date"),
            F.when(c % 23 != 0, listed).alias("ipo_date"),
            F.when(c % 7 == 0, F.lit(None)).when(c % 11 == 0, 0.0).otherwise(20 + c % 5 * 0.5)
            .cast("double").alias("ipo_price"),
            primary.cast("double").alias("primary_shares"), secondary.cast("double").alias("secondary_shares"),
            F.when(c % 17 == 0, 0.0).otherwise(primary + F.coalesce(secondary, F.lit(0))).cast("double")
            .alias("shares_offered"),
            (primary * 20).cast("double").alias("deal_size"),
            (5000000 + c % 100 * 10000).cast("double").alias("shares_outstanding_post_ipo"),
            F.when(c % 9 == 4, "needs_review").otherwise("classified").alias("classification_status"),
            F.when(c % 8 == 5, "spac").otherwise("operating_company_ipo").alias("candidate_type"),
            F.when(c % 10 == 7, "filed").otherwise("priced").alias("offering_status"),
            F.when(c % 12 != 0, F.col("_lockup")).alias("primary_lockup_id"),
            F.when((c % 12 != 0) & (c % 15 != 0), F.col("_expires")).alias("primary_lockup_expiration_date"))

    def attempts(self) -> DataFrame:
        e, u = F.col("event_id"), F.col("user_id")
        start = F.date_add(F.lit("1995-01-02").cast("date"), (e * 37 % 2450).cast("int"))
        return self.table("events").select(
            e.alias("attempt_id"),
            F.when(e % 4 == 0, 1 + u % 3).when(e % 4 == 1, 100 + u % 25)
            .otherwise(1000 + F.floor(u * 2 / 3).cast("long")).alias("security_id"),
            F.when(e % 6 == 0, "secondary").otherwise("primary").alias("provider"),
            start.alias("requested_start_date"),
            F.date_add(start, (e % 30).cast("int")).alias("requested_end_date"),
            F.when(F.col("event_type") == "view", "success").when(F.col("event_type") == "click", "partial")
            .when(F.col("event_type") == "error", "error").otherwise("no_data").alias("status"),
            F.col("ts").cast("timestamp").alias("attempted_at"),
            F.floor("value").cast("int").alias("bars_returned"))

    # -- issuers and their filing history ------------------------------------
    def issuers(self) -> DataFrame:
        k = F.col("c_custkey")
        suffix = (F.when(k % 11 == 3, " Acquisition Corp").when(k % 11 == 7, " Growth Fund")
                  .otherwise(" Inc"))
        return self.table("customer").select(
            k.alias("company_id"), F.lpad(k.cast("string"), 10, "0").alias("cik"),
            F.concat("c_name", suffix).alias("name"),
            F.when(k % 5 != 0, F.concat(F.lit("c"), k.cast("string"))).alias("ticker"),
            F.when(k % 2 == 0, "NYSE").alias("exchange"))

    def filings(self) -> DataFrame:
        k = F.col("o_orderkey")
        accession = F.concat(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), F.lit("-"),
                             F.date_format("o_orderdate", "yy"), F.lit("-"),
                             F.lpad((k % 1000000).cast("string"), 6, "0"))
        path = F.concat(F.lit("edgar/data/"), F.col("o_custkey").cast("string"), F.lit("/"), accession,
                        F.lit(".txt"))
        return self.table("orders").select(
            k.alias("filing_id"), F.col("o_custkey").alias("company_id"),
            pick(FORMS, k % 12).alias("form_type"), F.to_date("o_orderdate").alias("filed_at"),
            accession.alias("accession_number"), path.alias("filing_path"))

    def candidates(self) -> DataFrame:
        """Candidate offering per issuer, with the classification stored by an earlier run."""
        k = F.col("company_id")
        return self.issuers().select(
            (k + 10).alias("ipo_id"), "company_id",
            F.when(k % 4 == 1, F.date_add(F.lit("1996-01-01").cast("date"), (k % 900).cast("int")))
            .alias("first_filing_date"),
            F.lit("unknown").alias("candidate_type"), F.lit("needs_review").alias("classification_status"),
            F.when(k % 3 == 0, "priced").otherwise("unknown").alias("offering_status"),
            F.lit(None).cast("string").alias("classification_reason"),
            F.lit(None).cast("long").alias("final_prospectus_filing_id"))

    # -- signals, runs, options and prospectus text --------------------------
    def signals(self, hypothesis) -> DataFrame:
        """Signals stored by earlier runs, one for every dated agreement, in all four modes."""
        from lockstep.operators.prospective import signal_columns
        k = F.col("lockup_id")
        base = self.lockups().withColumn("event_date", F.coalesce(
            "stated_expiration_date", "calculated_expiration_date")).where("event_date is not null")
        mode = pick(("strict_prospective", "prospective", "shadow_prospective", "lifecycle_tracking"), F.floor(k / 5) % 4)
        mature = (k % 10 == 0) & (F.floor(k / 5) % 4 != 3)
        group = pick(("low_low", "low_high", "high_low", "high_high"), F.floor(k / 20) % 4)
        rows = base.select(
            k, "ipo_id", F.col("ipo_id").alias("security_id"), "event_date",
            F.col("event_date").alias("event_trade_date"), F.date_sub("event_date", 7).alias("observation_date"),
            ((k % 100) / 1000.0).alias("feature1_value"), ((k % 200) / 100.0).alias("feature2_value"),
            group.alias("interaction_group"), (group == "high_high").alias("is_high_high"),
            F.when(F.floor(k / 5) % 4 == 3, "unavailable").when(mature, "matured").otherwise("awaiting_event")
            .alias("signal_status"),
            F.when(F.floor(k / 5) % 4 == 3, "observation_before_prospective_start").alias("unavailable_reason"),
            F.when(mature, F.lit(hypothesis.outcome)).alias("realized_outcome_name"),
            F.when(mature, ((k % 41) - 20) / 100.0).alias("realized_outcome_value"),
            F.when(mature, (k % 13) / 100.0).alias("bearish_mfe_20d"),
            F.when(mature, (k % 17) / 100.0).alias("bearish_mae_20d"),
            F.when(mature, F.date_add("event_date", 28)).alias("outcome_observation_date"),
            F.lit(None).cast("timestamp").alias("outcome_attached_at"),
            F.lit(None).cast("string").alias("feature1_side"), F.lit(None).cast("string").alias("feature2_side"),
            F.col("event_date").cast("timestamp").alias("created_at"), mode.alias("evaluation_mode"))
        return rows.withColumns({**signal_columns(F.col("evaluation_mode"), hypothesis), "signal_id": k})

    def runs(self) -> DataFrame:
        """One run per user and day of the event stream."""
        e = self.table("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
        return e.groupBy(F.concat_ws("-", F.col("user_id").cast("string"), F.to_date("ts").cast("string")).alias("run_id"),
                         F.concat(F.lit("daily-"), (F.col("user_id") % 10).cast("string")).alias("run_name")).agg(
            F.min("ts").alias("started_at"), F.max("ts").alias("finished_at"),
            F.when(F.bool_or(F.col("event_type") == "error"), "failed").otherwise("succeeded").alias("status"))

    def stages(self) -> DataFrame:
        ts = F.col("ts").cast("timestamp")
        return self.table("events").select(
            F.concat_ws("-", F.col("user_id").cast("string"), F.to_date(ts).cast("string")).alias("run_id"),
            F.col("event_id").alias("stage_id"),
            F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "running")
            .otherwise("succeeded").alias("status"))

    def contracts(self) -> DataFrame:
        """Three listed puts per part, on the securities the part maps to."""
        k = F.col("p_partkey")
        grid = self.table("part").select(k, "p_retailprice", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("n"))
        security = F.when(k % 2 == 0, 1 + k % 3).otherwise(100 + k % 25)
        expires = F.date_add(F.lit("1995-02-01").cast("date"), (k * 7 % 2400 + F.col("n") * 30).cast("int"))
        return grid.select(
            F.concat(F.lit("T"), security.cast("string")).alias("underlying_ticker"),
            F.when(k % 17 != 0, F.concat(F.lit("P"), k.cast("string"), F.lit("-"), F.col("n").cast("string")))
            .alias("contract_symbol"),
            F.when(k % 19 == 0, F.lit("unknown")).otherwise(expires.cast("string")).alias("expiration_date"),
            (15 + k % 10).alias("strike_price"))

    def quotes(self) -> DataFrame:
        """Line items as option quotes at nanosecond timestamps."""
        k = F.col("l_partkey")
        nanos = (F.unix_micros(F.col("l_shipdate").cast("timestamp")) * 1000).cast("long")
        return self.table("lineitem").select(
            F.concat(F.lit("P"), k.cast("string"), F.lit("-"), (F.col("l_linenumber") % 3).cast("string")).alias("contract_symbol"),
            F.when(F.col("l_linenumber") != 2, nanos).alias("sip_timestamp"),
            F.when(F.col("l_linenumber") == 2, nanos).alias("participant_timestamp"),
            F.lit(None).cast("long").alias("timestamp"),
            F.when(F.col("l_returnflag") != "R", F.col("l_discount")).alias("bid_price"),
            F.when(F.col("l_linestatus") == "O", F.col("l_tax")).alias("ask_price"),
            F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("bid_size"))

    def spread_orders(self) -> DataFrame:
        """The narrow order columns of a text, dealt evenly: what follows reads each text many times."""
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.table("orders").select("o_orderkey", "o_orderdate", "o_orderpriority").repartition(parts)

    def lockup_documents(self) -> DataFrame:
        """Prospectus texts whose answers are order columns."""
        k = F.col("o_orderkey")
        holder = pick(("substantially all holders of our common stock", "our principal stockholders",
                       "certain selling stockholders", "our directors and executive officers"), k % 4)
        days = pick(("90", "120", "180"), k % 3)
        text = F.concat(
            F.lit("PROSPECTUS SUMMARY\nThe trial lasts 180 days.\n\nUNDERWRITING\n\nBoilerplate comes first. In this offering "),
            holder, F.lit(" have agreed with the underwriters that they will not sell any\nshares for "), days,
            F.lit(" days after the date of this prospectus. An aggregate of "), (1000 + k).cast("string"),
            F.lit(" shares are subject to the lock-up agreement. "),
            F.when(k % 2 == 0, "The representatives may waive these restrictions.").otherwise("Nothing else is agreed."),
            F.lit("\n\nThe company has agreed not to issue or sell common stock for 90 days.\n\nSHARES ELIGIBLE FOR FUTURE SALE\n\n"
                  "Certain selling stockholders may not sell their shares until the restrictions terminate on "),
            F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(".\n\nDESCRIPTION OF CAPITAL STOCK\n\n"), F.col("o_orderpriority"))
        return self.spread_orders().select(
            k.alias("filing_id"), (k % 700).alias("ipo_id"), F.to_date("o_orderdate").alias("filed_at"), text.alias("text"))

    def offering_documents(self) -> DataFrame:
        k = F.col("o_orderkey")
        price = F.concat((10 + k % 40).cast("string"), F.lit(".50"))
        primary, secondary = F.format_number(1000000 + k, 0), F.format_number(500000 + k % 1000, 0)
        offered = (F.when(k % 4 == 0, F.concat(F.lit("We are offering "), primary, F.lit(" shares of common stock. The selling stockholders are offering "), secondary, F.lit(" shares.")))
                   .when(k % 4 == 1, F.concat(F.lit("We are offering "), primary, F.lit(" shares.")))
                   .when(k % 4 == 2, F.concat(F.lit("All of the "), secondary, F.lit(" shares of common stock are being sold by the selling stockholders.")))
                   .otherwise(F.concat(F.lit("This is an offering of "), primary, F.lit(" shares."))))
        text = F.concat(
            F.lit("PROSPECTUS\n"), offered,
            F.when(k % 3 == 0, F.concat(F.lit("\nInitial public offering price\n$ "), price, F.lit("\n$ 99,000,000.00\n")))
            .otherwise(F.concat(F.lit("\nThe initial public offering price per share is $"), price, F.lit(".\n"))),
            F.lit("Common stock to be outstanding after this offering: "), F.format_number(9000000 + k, 0), F.lit(" shares\n"))
        return self.table("orders").select(k.alias("filing_id"), (k % 700).alias("ipo_id"), text.alias("text"))
