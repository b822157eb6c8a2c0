"""Offering facts from final prospectuses, as column expressions over whole documents."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parser identity, promotion floor and wording patterns.
PARSER_NAME = "final_prospectus_offering"
PARSER_VERSION = "4"
PROMOTION_CONFIDENCE = 0.90
#: A line of its own that ends the cover.
COVER_END = (r"(?imU)^\s*(?:table\s+of\s+contents|prospectus\s+summary|summary|risk\s+factors|the\s+offering|use\s+of\s+proceeds|"
             r"dividend\s+policy|capitalization)\s*$")
FIELDS = ("ipo_price", "shares_offered", "primary_shares", "secondary_shares", "shares_outstanding_post_ipo")
PRICE = (
    r"initial\s+public\s+offering\s+price\s+per\s+share\s+(?:will\s+be|is)\s*\$\s*(\d+(?:\.\d+)?)",
    r"(?:initial\s+)?public\s+offering\s+price\s+of\s+[^.!?\n]{1,120}?\s+is\s*\$\s*(\d+(?:\.\d+)?)\s+per\s+share",
    r"initial\s+public\s+offering\s+price\s+(?:of|:)\s*\$\s*(\d+(?:\.\d+)?)\s+per\s+share",
    r"(?:initial\s+public\s+)?offering\s+price\s+is\s*\$\s*(\d+(?:\.\d+)?)\s+per\s+share",
    r"public\s+offering\s+price\s*:\s*\$\s*(\d+(?:\.\d+)?)\s+per\s+share",
    r"price\s+to\s+public\s*:\s*\$\s*(\d+(?:\.\d+)?)\s+per\s+share")
PRICE_TABLE = (r"(?imU)^\s*(?:initial\s+)?public\s+offering\s+price\s*$"
               r"\s*^\s*\$\s*(\d{1,4}(?:\.\d{1,4})?)\s*$")
PRIMARY = (
    r"(?:common stock|shares of common stock)\s+offered\s+by\s+(?:us|the company)\s*[:\-]?\s*(None\.?|[\d,]+\s+shares)",
    r"(?:we|the company)\s+(?:are|is)\s+offering\s+([\d,]+)\s+shares",
    r"([\d,]+)\s+shares\s+(?:are being )?offered\s+by\s+(?:us|the company)")
ALL_SECONDARY = (r"all\s+of\s+the\s+([\d,]+)\s+shares\s+of\s+common\s+stock\s+are\s+being\s+sold\s+by\s+"
                 r"(?:the\s+)?selling\s+(?:stockholders|shareholders)")
SECONDARY = (
    r"(?:common stock|shares of common stock)\s+offered\s+by\s+(?:the\s+)?selling\s+(?:stockholders|shareholders)"
    r"\s*[:\-]?\s*(None\.?|[\d,]+\s+shares)",
    ALL_SECONDARY,
    r"selling\s+(?:stockholders|shareholders)\s+(?:are\s+)?offering\s+([\d,]+)\s+shares",
    r"([\d,]+)\s+shares\s+(?:are being )?offered\s+by\s+(?:the\s+)?selling\s+(?:stockholders|shareholders)",
    r"our principal (?:stockholder|shareholder)[^.!?]{0,400}?\bis offering\s+([\d,]+)\s+shares")
SUMMARY_PRIMARY = (r"common\s+stock\s+offered\s+by\s+us\s*[:\-]?\s*(None\.?|[\d,]+\s+shares)",)
SUMMARY_SECONDARY = (r"common\s+stock\s+offered\s+by\s+the\s+selling\s+stockholders\s*[:\-]?\s*"
                     r"(None\.?|[\d,]+\s+shares)",)
DIRECT_OFFER = r"(?iU)^(?:we|the company)\s+(?:are|is)\s+offering"
TOTAL = r"(?iU)(?:a total of|offering consists of|offering of)\s+([\d,]+)\s+shares"
SUMMARY_LABEL = (
    r"(?:common\s+stock\s+offered\s+by\s+(?:us|the\s+selling\s+stockholders)|"
    r"common\s+stock\s+outstanding\s+immediately\s+after\s+giving\s+effect\s+to\s+this\s+offering|"
    r"common\s+stock\s+to\s+be\s+outstanding\s+after\s+this\s+offering|"
    r"class\s+[A-Za-z0-9]+\s+common\s+stock\s+to\s+be\s+outstanding\s+after\s+this\s+offering|"
    r"total\s+class\s+[A-Za-z0-9]+(?:\s+and\s+class\s+[A-Za-z0-9]+)+\s+common\s+stock\s+"
    r"to\s+be\s+outstanding\s+after\s+this\s+offering)")
POST_TOTAL = (r"total\s+class\s+[A-Za-z0-9]+(?:\s+and\s+class\s+[A-Za-z0-9]+)+\s+common\s+stock\s+"
              r"to\s+be\s+outstanding\s+after\s+this\s+offering\s*[:\-]?\s*([\d,]+)\s+shares",)
POST = (
    r"(?:shares\s+of\s+)?common\s+stock\s+outstanding\s+immediately\s+after\s+giving\s+effect\s+to\s+this\s+"
    r"offering\s*[:\-]?\s*([\d,]+)\s+shares",
    r"(?:shares\s+of\s+)?common\s+stock\s+(?:to\s+be\s+)?outstanding\s+immediately\s+(?:after|following)\s+"
    r"(?:this|the)\s+offering\s*[:\-]?\s*([\d,]+)\s+shares",
    r"common\s+stock\s+to\s+be\s+outstanding\s+after\s+this\s+offering\s*[:\-]?\s*([\d,]+)\s+shares",
    r"([\d,]+)\s+shares\s+of\s+(?:our\s+)?(?:common stock|ordinary shares)\s+will\s+be\s+outstanding\s+"
    r"immediately\s+(?:after|following)\s+(?:this|the)\s+offering")
POST_CLASS = (r"class\s+[A-Za-z0-9]+\s+common\s+stock\s+to\s+be\s+outstanding\s+after\s+this\s+offering"
              r"\s*[:\-]?\s*([\d,]+)\s+shares",)

_FACT = ("field_name string, value decimal(24,4), unit string, confidence double, source_excerpt string, "
         "source_locator string, is_derived boolean, derivation string")


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def earliest(text: Column, patterns) -> Column:
    """Earliest match of several patterns as (position, pattern, match, captured); ties by pattern order."""
    found = []
    for index, pattern in enumerate(patterns):
        p = "(?imU)" + pattern
        found.append(F.struct(F.regexp_instr(text, F.lit(p)).alias("at"), F.lit(index).alias("pattern"),
                              F.regexp_extract(text, p, 0).alias("match"),
                              F.regexp_extract(text, p, 1).alias("captured")))
    return F.array_min(F.filter(F.array(*found), lambda m: m["at"] > 0))


def _first_context(patterns) -> Column:
    hits = F.transform("_contexts", lambda c: earliest(c, patterns))
    return F.get(F.filter(hits, lambda h: h.isNotNull()), 0)


def _number(text: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text, r"[\d,]*\d[\d,]*(?:\.\d+)?", 0), ",", "").try_cast("decimal(24,4)")


def _fact(field: str, value: Column, unit: str, confidence: Column, excerpt: Column, locator: Column, *,
          derived: bool = False, derivation: str | None = None) -> Column:
    excerpt = F.trim(F.regexp_replace(excerpt, r"(?U)\s+", " "))
    return F.struct(F.lit(field).alias("field_name"), value.cast("decimal(24,4)").alias("value"),
                    F.lit(unit).alias("unit"), confidence.cast("double").alias("confidence"),
                    excerpt.alias("source_excerpt"), locator.alias("source_locator"),
                    F.lit(derived).alias("is_derived"), F.lit(derivation).cast("string").alias("derivation"))


COVER = "Prospectus cover"
SUMMARY = "Offering summary"


def cover_of(text: Column) -> Column:
    """The text before the first heading that ends a cover; all of it where nothing comes before one."""
    before = F.get(F.split(text, COVER_END, 2), 0)
    return F.when(F.trim(before) == "", text).otherwise(before)


def offering_facts(documents: DataFrame) -> DataFrame:
    """Long fact rows per document; optional share counts are ignored.

    Everything happens inside the document row.  A label's context runs to the next
    label, blank line or heading.
    """
    return _found_facts(documents).where("value is not null")


def rejected_facts(documents: DataFrame) -> DataFrame:
    """Facts whose number does not fit the stored type: kept for review, never stored."""
    return _found_facts(documents).where("value is null and field_name is not null")


def _found_facts(documents: DataFrame) -> DataFrame:
    keep = [c for c in documents.columns if c != "text"]
    context = rf"(?is){SUMMARY_LABEL}.*?(?={SUMMARY_LABEL}|\n[ \t]*\r?\n|\n[ \t]*(?:risk factors|use of proceeds|dividend policy)[ \t]*\r?\n|\z)"
    df = documents.withColumns({"_cover": cover_of(F.col("text")),
                                "_contexts": _matches(F.col("text"), context)})
    cover = F.col("_cover")
    df = df.withColumns({
        "_pure": earliest(cover, (ALL_SECONDARY,)),
        "_primary": F.coalesce(earliest(cover, PRIMARY), _first_context(SUMMARY_PRIMARY)),
        "_secondary": F.coalesce(earliest(cover, SECONDARY), _first_context(SUMMARY_SECONDARY)),
        "_totals": _matches(cover, TOTAL),
        "_post": F.coalesce(_first_context(POST_TOTAL), _first_context(POST), _first_context(POST_CLASS))})
    pure = F.col("_pure").isNotNull()
    # "All of the N shares" also states that the issuer sells none.
    df = df.withColumn("_primary", F.when(~pure, F.col("_primary")))

    def component(hit):
        none = F.lower(F.col(f"{hit}.captured")).startswith("none")
        return none, F.when(none, F.lit(0)).otherwise(_number(F.col(f"{hit}.captured")))

    none1, value1 = component("_primary")
    none2, value2 = component("_secondary")
    df = df.withColumns({
        "_v1": F.when(pure, F.lit(0)).otherwise(value1).cast("decimal(24,4)"), "_v2": value2.cast("decimal(24,4)"),
        "_none1": none1, "_none2": none2,
        "_distinct": F.array_distinct(F.transform("_totals", lambda t: _number(F.regexp_extract(t, TOTAL, 1))))})
    v1, v2, totals = F.col("_v1"), F.col("_v2"), F.col("_totals")

    def priced(pattern, locator):
        return F.transform(_matches(cover, pattern), lambda m: _fact(
            "ipo_price", F.regexp_extract(m, pattern, 1).try_cast("decimal(24,4)"), "USD/share", F.lit(0.99), m,
            F.lit(locator)))

    prices = [priced("(?iU)" + p, COVER) for p in PRICE]
    table = priced(PRICE_TABLE, "Prospectus cover pricing table")

    def one(test, fact):
        return F.when(test, F.array(fact)).otherwise(F.array().cast(f"array<struct<{_ddl()}>>"))

    primary_fact = _fact("primary_shares", v1, "shares", F.when(pure | F.col("_none1"), 0.99).otherwise(0.98),
                         F.when(pure, F.col("_pure.match")).otherwise(F.col("_primary.match")),
                         F.when(~pure & F.col("_none1"), F.lit(SUMMARY)).otherwise(F.lit(COVER)))
    secondary_fact = _fact("secondary_shares", v2, "shares", F.when(F.col("_none2"), 0.99).otherwise(0.98),
                           F.col("_secondary.match"), F.when(F.col("_none2"), F.lit(SUMMARY)).otherwise(F.lit(COVER)))
    single = F.size("_distinct") == 1
    stated = F.transform(F.when(single, F.slice(totals, 1, 1)).otherwise(totals), lambda t: _fact(
        "shares_offered", _number(F.regexp_extract(t, TOTAL, 1)), "shares", F.when(single, 0.96).otherwise(0.80), t,
        F.lit(COVER)))
    both = v1.isNotNull() & v2.isNotNull()
    summed = _fact("shares_offered", v1 + v2, "shares", F.lit(0.98),
                   F.lit("Derived from explicit issuer and selling-stockholder base offering shares"),
                   F.lit("Prospectus cover / offering summary"), derived=True,
                   derivation="primary_shares + secondary_shares")
    alone = (F.size(totals) == 0) & F.col("_primary").isNotNull() & v2.isNull() \
        & F.col("_primary.match").rlike(DIRECT_OFFER)
    direct = _fact("shares_offered", v1, "shares", F.lit(0.94), F.col("_primary.match"), F.lit(COVER))
    post = _fact("shares_outstanding_post_ipo", _number(F.col("_post.captured")), "shares", F.lit(0.98),
                 F.col("_post.match"), F.lit(SUMMARY))
    facts = F.concat(*prices, table, one(v1.isNotNull(), primary_fact), one(v2.isNotNull(), secondary_fact), stated,
                     one(both, summed), one(~both & alone, direct), one(F.col("_post").isNotNull(), post))
    # Outer generator: an inferred filter on the array would run every pattern twice.
    return df.select(*keep, F.explode_outer(facts).alias("f")).select(*keep, "f.*")


def _ddl() -> str:
    return ",".join(part.strip().replace(" ", ":", 1) for part in _FACT.split(", "))


FACT_IDENTITY = ("field_name", "value", "unit", "confidence", "source_excerpt", "source_locator", "is_derived",
                 "derivation")


def fact_key() -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in FACT_IDENTITY]),
                            {"ignoreNullFields": "false"}), 256)


def store_facts(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """Facts not stored yet for the same offering, filing and parser version."""
    key = ["ipo_id", "filing_id", "value_key", "parser_name", "parser_version"]
    rows = parsed.withColumns({"value_key": fact_key(), "parser_name": F.lit(PARSER_NAME),
                               "parser_version": F.lit(PARSER_VERSION)}).dropDuplicates(key)
    return rows.join(stored.select(*key), key, "left_anti")


def promote_facts(ipos: DataFrame, facts: DataFrame) -> DataFrame:
    """Canonical values per offering: set when all trusted facts agree, cleared when they differ.

    Agreement is ``min = max``, so facts combine on the map side.
    """
    current = ((F.col("parser_name") == PARSER_NAME) & (F.col("parser_version") == PARSER_VERSION)
               & (F.col("confidence") >= PROMOTION_CONFIDENCE) & F.col("field_name").isin(*FIELDS))
    final = ipos.select("ipo_id", F.col("final_prospectus_filing_id").alias("filing_id"))
    trusted = facts.where(current).join(final, ["ipo_id", "filing_id"], "left_semi")
    stats = []
    for field in FIELDS:
        value = F.when(F.col("field_name") == field, F.col("value"))
        stats += [F.min(value).alias(f"{field}_lo"), F.max(value).alias(f"{field}_hi")]
    used = F.col("field_name").isin("ipo_price", "shares_offered")
    wide = trusted.groupBy("ipo_id").agg(*stats, F.min(F.when(used, F.col("confidence"))).alias("_confidence"))
    agreed = {f: F.when(F.col(f"{f}_lo") == F.col(f"{f}_hi"), F.col(f"{f}_lo")) for f in FIELDS}
    clash = [(F.col(f"{f}_lo") != F.col(f"{f}_hi")).cast("int") for f in FIELDS]
    old = ipos.where("final_prospectus_filing_id is not null").select(
        "ipo_id", *[F.col(f).alias(f"_old_{f}") for f in (*FIELDS, "deal_size")])
    df = old.join(wide, "ipo_id", "left")
    fresh = {f: F.when(F.col(f"{f}_lo").isNotNull(), agreed[f]).otherwise(F.col(f"_old_{f}")) for f in FIELDS}
    deal = (agreed["ipo_price"].cast("double") * agreed["shares_offered"].cast("double"))
    out = df.withColumns({**fresh, "deal_size": deal,
                          "ambiguities": reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0)) for c in clash]),
                          "deal_facts": F.when(deal.isNotNull(), 1).otherwise(0)})
    changed = [(~F.col(f).cast("double").eqNullSafe(F.col(f"_old_{f}").cast("double"))).cast("int")
               for f in (*FIELDS, "deal_size")]
    return out.withColumn("updated", reduce(lambda a, b: a + b, changed)).select(
        "ipo_id", *[F.col(f).cast("double").alias(f) for f in FIELDS], "deal_size", "updated", "ambiguities", "deal_facts")


def offering_job_report(cohort: DataFrame, documents: DataFrame, created: DataFrame, promoted: DataFrame) -> DataFrame:
    """Counters of one batch: offerings seen, documents used, facts and canonical updates."""
    from lockstep.operators.outcomes import side_by_side
    text = documents.select("filing_id", F.lit(True).alias("_text")).distinct()
    seen = cohort.join(text, cohort["final_prospectus_filing_id"] == text["filing_id"], "left")
    return side_by_side([
        seen.agg(F.count(F.lit(1)).alias("ipos_seen"), F.count("_text").alias("documents_normalized"),
                 F.count_if(F.col("_text").isNull()).alias("documents_failed")),
        created.agg(F.count(F.lit(1)).alias("parsed_facts")),
        promoted.agg(F.sum("updated").alias("canonical_fields_updated"), F.sum("ambiguities").alias("ambiguities"),
                     F.sum("deal_facts").alias("derived_facts"))])
