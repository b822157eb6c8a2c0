"""Candidate classification from filing chronology."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.functions.numeric import all_of
from lockstep.sources.filings import REGISTRATION_FORMS

# Evidence forms and issuer-name terms.
PERIODIC_FORMS = ("10-K", "10-Q", "20-F", "6-K")
INDEPENDENT_FORMS = ("EFFECT", "8-A12B", "8-A12G")
SPAC_TERMS = ("acquisition corp", "acquisition company", "capital corp", "blank check")
FUND_TERMS = (" fund", " etf", "portfolio", "investment trust")
WINDOW_DAYS = 180
# Stored reason texts.
NO_ANCHOR = "Needs review: no S-1/F-1 registration anchor is available."
PERIODIC = ("Needs review: periodic filing history (", ") predates registration, suggesting an already-public issuer.")
SPAC = ("Likely SPAC: issuer name matches a blank-check/acquisition pattern and registration has "
        "subsequent offering evidence.")
FUND = ("Likely fund: issuer name matches a fund/trust pattern and registration has subsequent "
        "offering evidence.")
OPERATING = ("Likely operating-company IPO: registration is followed by a nearby 424B4 and independent "
             "EFFECT or 8-A evidence, with no prior periodic filing history.")
INSUFFICIENT = ("Needs review: registration metadata lacks enough independent evidence for a confident "
                "candidate type.")


def _named(name: Column, terms) -> Column:
    return ~all_of([~F.contains(name, F.lit(t)) for t in terms])


def classify(candidates: DataFrame, companies: DataFrame, filings: DataFrame) -> DataFrame:
    """Classification per candidate (``ipo_id, company_id, first_filing_date`` in).

    Filings shrink to one row per (company, form, day) before anything is joined, so
    an issuer with an extreme filing count costs at most forms x days rows.
    """
    form = F.upper("form_type")
    used = (*REGISTRATION_FORMS, *PERIODIC_FORMS, *INDEPENDENT_FORMS, "424B4", "RW")
    days = (filings.select("company_id", form.alias("form"), "filed_at", "accession_number", "filing_id")
            .where(F.col("form").isin(*used)).groupBy("company_id", "form", "filed_at")
            .agg(F.min("accession_number").alias("accession"),
                 F.min_by("filing_id", "accession_number").alias("filing_id")))
    registered = days.where(F.col("form").isin(*REGISTRATION_FORMS)).groupBy("company_id").agg(
        F.min("filed_at").alias("_registered"))
    anchored = (candidates.select("ipo_id", "company_id", "first_filing_date").join(companies.select("company_id", F.lower("name").alias("_name")), "company_id")
                .join(registered, "company_id", "left")
                .withColumn("anchor", F.coalesce("first_filing_date", "_registered")))
    inside = (F.col("filed_at") >= F.col("anchor")) & (F.col("filed_at") <= F.date_add("anchor", WINDOW_DAYS))
    before = (F.col("filed_at") < F.col("anchor")) & F.col("form").isin(*PERIODIC_FORMS)
    final = inside & (F.col("form") == "424B4")
    evidence = (days.join(anchored.select("ipo_id", "company_id", "anchor"), "company_id")
                .groupBy("ipo_id").agg(
        F.min_by(F.when(final, F.col("filing_id")),
                 F.when(final, F.struct("filed_at", "accession"))).alias("final_prospectus_filing_id"),
        F.bool_or(inside & (F.col("form") == "RW")).alias("_withdrawn"),
        F.bool_or(inside & (F.col("form") == "EFFECT")).alias("_effective"),
        F.bool_or(inside & F.col("form").isin(*REGISTRATION_FORMS)).alias("_filed"),
        F.bool_or(inside & F.col("form").isin(*INDEPENDENT_FORMS)).alias("_independent"),
        F.array_join(F.array_sort(F.collect_set(F.when(before, F.col("form")))), ", ").alias("_periodic")))
    row = anchored.join(evidence, "ipo_id", "left")
    prospectus = F.col("final_prospectus_filing_id").isNotNull()
    independent = F.coalesce("_independent", F.lit(False))
    anchor = F.col("anchor").isNotNull()
    prior = F.coalesce("_periodic", F.lit("")) != ""
    sequence = prospectus | independent
    spac = _named(F.col("_name"), SPAC_TERMS) & sequence
    fund = _named(F.col("_name"), FUND_TERMS) & sequence
    operating = prospectus & independent
    open_case = anchor & ~prior
    return row.select(
        "ipo_id", "company_id", "anchor",
        F.when(open_case & spac, "spac").when(open_case & fund, "fund")
        .when(open_case & operating, "operating_company_ipo").otherwise("unknown").alias("candidate_type"),
        F.when(open_case & (spac | fund | operating), "classified").otherwise("needs_review")
        .alias("classification_status"),
        F.when(~anchor, "unknown").when(prospectus, "priced").when(F.col("_withdrawn"), "withdrawn")
        .when(F.col("_effective"), "effective").when(F.col("_filed"), "filed").otherwise("unknown")
        .alias("offering_status"),
        F.when(~anchor, NO_ANCHOR)
        .when(prior, F.concat(F.lit(PERIODIC[0]), F.col("_periodic"), F.lit(PERIODIC[1])))
        .when(spac, SPAC).when(fund, FUND).when(operating, OPERATING).otherwise(INSUFFICIENT)
        .alias("classification_reason"),
        "final_prospectus_filing_id")


RESULT = ("candidate_type", "classification_status", "offering_status", "classification_reason",
          "final_prospectus_filing_id")


def classification_report(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Seen, unchanged, classified, needs_review and linked counters of a batch."""
    old = stored.select("ipo_id", F.struct(*RESULT).alias("_old"))
    both = fresh.join(old, "ipo_id")
    return both.agg(
        F.count(F.lit(1)).alias("ipos_seen"),
        F.count_if(F.col("classification_status") == "classified").alias("classified"),
        F.count_if(F.col("classification_status") == "needs_review").alias("needs_review"),
        F.count_if(F.struct(*RESULT).eqNullSafe(F.col("_old"))).alias("unchanged"),
        F.count("final_prospectus_filing_id").alias("prospectuses_linked"))
