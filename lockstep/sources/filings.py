"""Filing-index text, issuer-submission JSON and daily-bar JSON as row sources."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Form lists and archive address used in stored links.
REGISTRATION_FORMS = ("S-1", "S-1/A", "F-1", "F-1/A")
SUBMISSION_FORMS = ("424B4", "EFFECT", "8-A12B", "8-A12G", "10-Q", "10-K", "8-K", "20-F", "6-K")
ARCHIVES = "https://www.sec.gov/Archives"

SUBMISSION_SCHEMA = (
    "name STRING, tickers ARRAY<STRING>, exchanges ARRAY<STRING>, "
    "filings STRUCT<recent: STRUCT<accessionNumber: ARRAY<STRING>, filingDate: ARRAY<STRING>, "
    "form: ARRAY<STRING>, primaryDocument: ARRAY<STRING>>>")
BAR_SCHEMA = ("results ARRAY<STRUCT<t: BIGINT, o: DECIMAL(20,8), h: DECIMAL(20,8), "
              "l: DECIMAL(20,8), c: DECIMAL(20,8), v: DECIMAL(20,4)>>")
#: Where the parser keeps a record that does not fit its schema.
CORRUPT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def read_index(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.text(list(paths))


def parse_index(lines: DataFrame, forms=REGISTRATION_FORMS, start=None, end=None) -> DataFrame:
    """Pipe-separated index lines to filings.

    Banner, header and dash lines fail the five-field and numeric-CIK tests, so the
    scan needs no line order and splits freely across tasks.
    """
    parts = F.transform(F.split(F.trim("value"), r"\|"), lambda x: F.trim(x))
    rows = lines.select(parts.alias("p")).where(
        (F.size("p") == 5) & F.get("p", 0).rlike(r"^\d+$") & F.get("p", 2).isin(*forms))
    out = rows.select(
        F.lpad(F.get("p", 0), 10, "0").alias("cik"), F.get("p", 1).alias("company_name"),
        F.get("p", 2).alias("form_type"), F.try_to_date(F.get("p", 3), "yyyy-MM-dd").alias("filed_at"),
        F.get("p", 4).alias("filing_path")).where("filed_at is not null")
    if start is not None:
        out = out.where(F.col("filed_at") >= F.lit(start))
    if end is not None:
        out = out.where(F.col("filed_at") <= F.lit(end))
    return out.withColumns({
        "accession_number": F.regexp_replace(F.regexp_extract("filing_path", r"([^/]+)$", 1), r"\.txt$", ""),
        "sec_url": F.concat(F.lit(ARCHIVES + "/"), F.regexp_replace("filing_path", "^/+", ""))})


def _first_text(values: Column) -> Column:
    return F.nullif(F.trim(F.get(values, 0)), F.lit(""))


def parse_submissions(payloads: DataFrame) -> DataFrame:
    """``(cik, payload)`` JSON text to issuer attributes plus an array of relevant filings.

    ``malformed`` marks payloads without the three required arrays; they carry no
    filings and count as errors, and ``reason`` says what is wrong.  ``rejected`` are the
    relevant filings that cannot be used, with a reason each: one bad entry costs itself.
    """
    doc = F.from_json("payload", SUBMISSION_SCHEMA + ", _corrupt STRING", CORRUPT)
    recent = payloads.select("cik", "payload", doc.alias("d")).select("cik", "payload", "d", "d.filings.recent.*")
    malformed = (F.col("d").isNull() | F.col("accessionNumber").isNull()
                 | F.col("filingDate").isNull() | F.col("form").isNull())
    numeric = F.coalesce(F.nullif(F.regexp_replace(F.trim("cik"), "^0+", ""), F.lit("")), F.lit("0"))
    reason = (F.when(F.col("payload").isNull(), "no payload")
              .when(F.col("d").isNull() | (F.col("d._corrupt").isNotNull() & F.col("d.filings").isNull() & F.col("d.name").isNull()), "not a JSON object")
              .when(malformed, "required arrays are missing"))
    length = F.least(F.size("accessionNumber"), F.size("filingDate"), F.size("form"))

    def filing(i: Column) -> Column:
        accession = F.trim(F.get("accessionNumber", i))
        compact = F.regexp_replace(accession, "-", "")
        document = F.coalesce(F.nullif(F.trim(F.get("primaryDocument", i)), F.lit("")),
                              F.concat(compact, F.lit("-index.html")))
        path = F.concat(F.lit("edgar/data/"), numeric, F.lit("/"), compact, F.lit("/"), document)
        return F.struct(
            accession.alias("accession_number"), F.get("form", i).alias("form_type"),
            F.try_to_date(F.get("filingDate", i), "yyyy-MM-dd").alias("filed_at"),
            path.alias("filing_path"), F.concat(F.lit(ARCHIVES + "/"), path).alias("sec_url"))

    # An inverted sequence would count down, so empty arrays are handled apart.
    positions = F.when(length > 0, F.sequence(F.lit(0), length - 1))
    relevant = F.filter(F.transform(F.when(~malformed, positions), filing), lambda f: f["form_type"].isin(*SUBMISSION_FORMS))

    def fault(f: Column) -> Column:
        proper = F.coalesce(f["accession_number"].rlike(r"^\d{10}-\d{2}-\d{6}$"), F.lit(False))
        return F.when(~proper, "accession number").when(f["filed_at"].isNull(), "filing date")

    recent = recent.withColumn("relevant", relevant)
    rejected = F.filter(F.transform("relevant", lambda f: F.struct(
        f["accession_number"].alias("accession_number"), f["form_type"].alias("form_type"), fault(f).alias("reason"))),
        lambda f: f["reason"].isNotNull())
    return recent.select(
        "cik", malformed.alias("malformed"), reason.alias("reason"), rejected.alias("rejected"), F.nullif(F.trim("d.name"), F.lit("")).alias("name"),
        _first_text(F.col("d.tickers")).alias("ticker"),
        _first_text(F.col("d.exchanges")).alias("exchange"),
        F.filter("relevant", lambda f: fault(f).isNull()).alias("filings"))


def submission_filings(parsed: DataFrame) -> DataFrame:
    # The outer form keeps the optimizer from copying the array expression, and with it
    # the JSON parse, into an inferred filter below the generator.
    return parsed.select("cik", F.explode_outer("filings").alias("f")).where("f is not null").select("cik", "f.*")


def rejected_submissions(parsed: DataFrame) -> DataFrame:
    """Documents and single filings set aside: ``cik, accession_number, form_type, reason``."""
    text = F.lit(None).cast("string")
    whole = parsed.where("malformed").select("cik", text.alias("accession_number"), text.alias("form_type"), "reason")
    single = parsed.select("cik", F.explode_outer("rejected").alias("f")).where("f is not null").select("cik", "f.*")
    return whole.unionByName(single)


def read_daily_bars(payloads: DataFrame) -> DataFrame:
    """``(security_id, payload)`` daily-aggregate JSON to exact decimal bars and, beside them, what is wrong.

    ``reason`` is null for a good bar.  A payload that is no JSON object gives one row with
    its reason; a bar without time or with a missing or unreadable price gives its own,
    and the bars around it stay.  A payload without results has no data, which is no fault.
    """
    doc = F.from_json("payload", BAR_SCHEMA + ", _corrupt STRING", CORRUPT)
    read = payloads.select("security_id", "payload", doc.alias("d"))
    broken = (F.when(F.col("payload").isNull(), "no payload")
              .when(F.col("d").isNull() | (F.col("d._corrupt").isNotNull() & F.col("d.results").isNull()), "not a JSON object"))
    items = read.select("security_id", broken.alias("_broken"), F.posexplode_outer("d.results").alias("position", "r"))
    price = F.col("r.o").isNull() | F.col("r.h").isNull() | F.col("r.l").isNull() | F.col("r.c").isNull()
    reason = (F.when(F.col("_broken").isNotNull(), F.col("_broken")).when(F.col("r").isNull(), "empty bar")
              .when(F.col("r.t").isNull(), "bar without time").when(price, "bar without price"))
    # No position: a payload without results.
    return items.where("_broken is not null or position is not null").select(
        "security_id", "position", reason.alias("reason"), F.to_date(F.timestamp_millis("r.t")).alias("trade_date"),
        F.col("r.o").alias("open"), F.col("r.h").alias("high"), F.col("r.l").alias("low"),
        F.col("r.c").alias("close"), F.col("r.v").cast("long").alias("volume"),
        F.lit(None).cast("decimal(20,8)").alias("adjusted_close"))


def parse_daily_bars(payloads: DataFrame) -> DataFrame:
    """The good bars of ``read_daily_bars``."""
    return read_daily_bars(payloads).where("reason is null").drop("position", "reason")
