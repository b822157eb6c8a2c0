"""Text-extraction queries over generated prospectuses and the raw document corpus."""
from __future__ import annotations

from pyspark.sql import functions as F

from lockstep.catalog import register
from lockstep.operators import lockup_text as lt
from lockstep.operators import offering_text as ot
from lockstep.sources.warehouse import pick
from lockstep.verification import CTES

# Three agreements per generated prospectus: holders, issuer, stated date.
CTES["agree"] = """
 SELECT o_orderkey AS filing_id, o_orderkey % 700 AS ipo_id, CAST(o_orderdate AS DATE) AS filed, n, CASE n WHEN 0 THEN ['existing_stockholders','pre_ipo_investors','selling_stockholders','directors_officers'][o_orderkey % 4 + 1] WHEN 1 THEN 'company' ELSE 'selling_stockholders' END AS holder_group,
  CASE n WHEN 0 THEN [90,120,180][o_orderkey % 3 + 1] WHEN 1 THEN 90 END AS duration_days, CASE WHEN n = 2 AND year(o_orderdate) >= 2000 THEN CAST(o_orderdate AS DATE) END AS stated,
  CASE n WHEN 0 THEN 'underwriter_lockup' WHEN 1 THEN 'company_lockup' ELSE 'unknown' END AS lockup_type, CASE WHEN n = 0 THEN 1000 + o_orderkey END AS shares
 FROM orders, (SELECT unnest([0,1,2]) AS n) WHERE n < 2 OR year(o_orderdate) >= 2000
"""


def found(w):
    return lt.agreements(w.lockup_documents())


@register("j1_sections", """
 SELECT o_orderkey AS filing_id, 'UNDERWRITING' AS heading, 4 AS start_line, [90, 120, 180][o_orderkey % 3 + 1]::VARCHAR AS told FROM orders
 UNION ALL SELECT o_orderkey, 'SHARES ELIGIBLE FOR FUTURE SALE', 11, strftime(CAST(o_orderdate AS DATE), '%B %-d, %Y') FROM orders""")
def sections(w):
    """Every section with its place, and the term or date its text ends up with."""
    rows = lt.sections(w.lockup_documents())
    told = F.when(F.col("heading") == "UNDERWRITING", F.regexp_extract("text", r"for (\d+) days after", 1)).otherwise(
        F.regexp_extract("text", r"terminate on (\w+ \d+, \d+)", 1))
    return rows.select("filing_id", "heading", F.col("start_line").cast("int").alias("start_line"), told.alias("told"))


@register("j2_sentence_windows", "SELECT o_orderkey AS filing_id, 1000 + o_orderkey AS shares, o_orderkey % 2 = 0 AS may_be_waived FROM orders")
def sentences(w):
    """The sentence that names the shares, and what the two sentences after it say."""
    rows = lt.sentence_windows(lt.sections(w.lockup_documents())).where("sentence like 'An aggregate of %'")
    return rows.select("filing_id", F.regexp_extract("sentence", r"of (\d+) shares", 1).cast("long").alias("shares"),
                       F.col("window").contains("may waive these restrictions").alias("may_be_waived"))


@register("j3_duration", "SELECT filing_id, duration_days, count(*) AS n FROM agree GROUP BY ALL")
def durations(w):
    return found(w).groupBy("filing_id", "duration_days").agg(F.count(F.lit(1)).alias("n"))


@register("j4_stated_date", "SELECT filing_id, stated AS stated_expiration_date FROM agree WHERE stated IS NOT NULL")
def stated(w):
    return found(w).where("stated_expiration_date is not null").select("filing_id", "stated_expiration_date")


@register("j5_holder_group", """
 SELECT filing_id, holder_group, CASE WHEN n = 1 THEN 'The company' WHEN n = 2 THEN 'Certain selling stockholders may not sell their shares until the restrictions terminate on ' || strftime(filed, '%B') ELSE
  'In this offering ' || ['substantially all holders of our common stock','our principal stockholders','certain selling stockholders','our directors and executive officers'][filing_id % 4 + 1] END AS phrase_start FROM agree""")
def holders(w):
    text = F.col("holder_group_text")
    start = F.when(F.col("stated_expiration_date").isNotNull(), F.regexp_extract(text, r"^.*? terminate on [A-Z][a-z]+", 0)) \
        .otherwise(F.regexp_replace(text, " have$", ""))
    return found(w).select("filing_id", "holder_group", start.alias("phrase_start"))


@register("j6_early_release", "SELECT filing_id, n = 0 AND filing_id % 2 = 0 AS early_release_exists FROM agree")
def early(w):
    return found(w).select("filing_id", "early_release_exists")


@register("j7_locked_shares", "SELECT filing_id, CAST(shares AS DOUBLE) AS shares_locked FROM agree WHERE shares IS NOT NULL")
def shares(w):
    return found(w).where("shares_locked is not null").select("filing_id", F.col("shares_locked").cast("double").alias("shares_locked"))


@register("j8_lockup_type", "SELECT filing_id, holder_group, lockup_type FROM agree")
def kinds(w):
    return found(w).select("filing_id", "holder_group", "lockup_type")


@register("j9_calculated_date", "SELECT filing_id, filed + duration_days AS calculated_expiration_date FROM agree WHERE n = 0")
def calculated(w):
    return found(w).where("calculated_expiration_date is not null").select("filing_id", "calculated_expiration_date")


@register("j10_confidence", "SELECT confidence, count(*) AS n FROM (SELECT CASE WHEN n = 2 THEN 0.97 WHEN n = 0 THEN 0.92 ELSE 0.82 END::DOUBLE AS confidence FROM agree) GROUP BY 1")
def confidence(w):
    return found(w).groupBy("confidence").agg(F.count(F.lit(1)).alias("n"))


@register("j11_agreements", """
 SELECT filing_id, holder_group, duration_days, CASE WHEN n = 2 THEN 'SHARES ELIGIBLE FOR FUTURE SALE, line 11' ELSE 'UNDERWRITING, line 4' END AS source_locator FROM agree""")
def agreement_rows(w):
    return found(w).select("filing_id", "holder_group", "duration_days", "source_locator")


@register("j11_corpus_negatives", "SELECT count(*) AS documents, 0::BIGINT AS agreements FROM documents")
def negatives(w):
    from lockstep.operators.outcomes import side_by_side
    docs = w.table("documents").select("doc_id", "text", F.lit("2001-01-01").cast("date").alias("filed_at"))
    return side_by_side([docs.agg(F.count("doc_id").alias("documents")),
                         lt.agreements(docs).agg(F.count(F.lit(1)).alias("agreements"))])


def _offerings(w):
    """Offerings with the newest text linked as final prospectus."""
    return w.lockup_documents().groupBy("ipo_id").agg(F.max("filing_id").alias("final_prospectus_filing_id")).withColumns({
        "shares_outstanding_post_ipo": F.lit(2000000.0), "primary_lockup_id": F.lit(None).cast("long"),
        "primary_lockup_expiration_date": F.lit(None).cast("date")})


@register("j12_evidence_identity", """
 SELECT filing_id, count(*) AS agreements, count(*) AS identities, TRUE AS repeat_is_same, FALSE AS other_excerpt_is_same FROM agree GROUP BY 1""")
def identity(w):
    """One key a row, the same when parsed again, another when the excerpt differs in its last character."""
    # Digests as 32 bytes, tagged by where they come from; keys are counted, so nothing but counts meets.
    key = lambda excerpt, tag: F.struct(F.unhex(lt.evidence_key(excerpt)).alias("key"), F.lit(tag).alias("tag"))
    excerpt = F.col("source_excerpt")
    rows = found(w).select("filing_id", F.explode(F.array(key(excerpt, 0), key(F.concat(excerpt, F.lit(".")), 2))).alias("k"))
    again = found(w).select("filing_id", key(excerpt, 1).alias("k"))
    keys = rows.unionByName(again).groupBy("filing_id", "k.key").agg(
        *[F.count_if(F.col("k.tag") == tag).alias(name) for tag, name in enumerate(("own", "again", "other"))])
    # A row meets every equal key of the repetition and of the others; a missing filing meets none.
    met = lambda name: F.when(F.col("filing_id").isNotNull(), F.col(name)).otherwise(0)
    return keys.where("own > 0").groupBy("filing_id").agg(
        F.sum(F.col("own") * F.greatest(met("again"), F.lit(1)) * F.greatest(met("other"), F.lit(1))).alias("agreements"),
        F.count(F.lit(1)).alias("identities"), F.bool_and(met("again") > 0).alias("repeat_is_same"),
        F.bool_or(met("other") > 0).alias("other_excerpt_is_same"))


@register("j13_agreement_store", """
 SELECT count(*) AS created, count(shares) AS with_percentage, round(sum((1000 + filing_id) / 2000000.0 * 100) FILTER (shares IS NOT NULL), 4) AS percentage_sum FROM agree WHERE n <> 1""")
def store(w):
    parsed = found(w)
    known = parsed.where("holder_group = 'company'").select(lt.evidence_key().alias("evidence_key"))
    rows = lt.store_agreements(known, parsed, _offerings(w))
    return rows.agg(F.count(F.lit(1)).alias("created"), F.count_if("percentage_is_derived").alias("with_percentage"),
                    F.round(F.sum(F.col("percentage_locked").cast("double")), 4).alias("percentage_sum"))


def _numbered(w):
    return found(w).withColumn("lockup_id", F.col("filing_id") * 3 + F.coalesce(F.col("duration_days"), F.lit(2)) % 3)


@register("j14_primary_selection", """
 SELECT g.ipo_id, CASE WHEN lo = hi THEN lo END AS primary_lockup_expiration_date, coalesce(lo = hi, FALSE) AS selected, coalesce(lo <> hi, FALSE) AS ambiguous FROM (SELECT DISTINCT o_orderkey % 700 AS ipo_id FROM orders) g LEFT JOIN (
  SELECT a.ipo_id, min(a.d) AS lo, max(a.d) AS hi FROM (SELECT *, filed + duration_days AS d FROM agree WHERE n = 0) a
  WHERE list_position(['existing_stockholders','pre_ipo_investors','selling_stockholders','directors_officers'], holder_group) = (
   SELECT min(list_position(['existing_stockholders','pre_ipo_investors','selling_stockholders','directors_officers'], b.holder_group)) FROM agree b WHERE b.ipo_id = a.ipo_id AND b.n = 0) GROUP BY 1) USING (ipo_id)""")
def primary(w):
    return lt.select_primary(_offerings(w), _numbered(w)).select("ipo_id", "primary_lockup_expiration_date", "selected", "ambiguous")


@register("j15_lockup_job_report", """
 SELECT (SELECT count(DISTINCT o_orderkey % 700) FROM orders) AS ipos_seen, (SELECT count(DISTINCT o_orderkey % 700) FROM orders) AS documents_available, 0::BIGINT AS documents_skipped, count(*) AS lockups_created,
  count(DISTINCT ipo_id) AS ipos_with_lockups, count(DISTINCT ipo_id) AS primary_lockups_selected, 0::BIGINT AS ambiguities FROM agree WHERE filing_id IN (SELECT max(o_orderkey) FROM orders GROUP BY o_orderkey % 700)""")
def job_report(w):
    cohort = _offerings(w)
    none = w.lockups().where("false").select("ipo_id", "filing_id", F.lit("").alias("parser_name"), F.lit("").alias("parser_version"))
    todo = lt.unparsed(cohort, w.lockup_documents().drop("ipo_id"), none)
    created = lt.agreements(todo)
    numbered = created.withColumn("lockup_id", F.col("filing_id"))
    return lt.lockup_job_report(cohort, w.lockup_documents(), none, created, lt.select_primary(cohort, numbered))


# ------------------------------------------------------------------ offering facts
def facts(w):
    return ot.offering_facts(w.offering_documents())


def _values(df, *fields):
    return df.where(F.col("field_name").isin(*fields)).select(
        "filing_id", "field_name", F.col("value").cast("double").alias("value"), "confidence", "is_derived")


@register("j16_offer_price", "SELECT o_orderkey AS filing_id, 10.5 + o_orderkey % 40 AS value FROM orders WHERE o_orderkey % 3 <> 0")
def price(w):
    rows = facts(w).where("field_name = 'ipo_price' and source_locator = 'Prospectus cover'")
    return rows.select("filing_id", F.col("value").cast("double").alias("value"))


@register("j17_price_table", "SELECT o_orderkey AS filing_id, 10.5 + o_orderkey % 40 AS value FROM orders WHERE o_orderkey % 3 = 0")
def price_table(w):
    rows = facts(w).where("source_locator = 'Prospectus cover pricing table'")
    return rows.select("filing_id", F.col("value").cast("double").alias("value"))


@register("j18_component_shares", """
 SELECT o_orderkey AS filing_id, 'primary_shares' AS field_name, CASE WHEN o_orderkey % 4 = 2 THEN 0 ELSE 1000000 + o_orderkey END::DOUBLE AS value, CASE WHEN o_orderkey % 4 = 2 THEN 0.99 ELSE 0.98 END::DOUBLE AS confidence, FALSE AS is_derived FROM orders WHERE o_orderkey % 4 < 3
 UNION ALL SELECT o_orderkey, 'secondary_shares', 500000 + o_orderkey % 1000, 0.98, FALSE FROM orders WHERE o_orderkey % 4 IN (0, 2)""")
def components(w):
    return _values(facts(w), "primary_shares", "secondary_shares")


@register("j19_pure_secondary", "SELECT o_orderkey AS filing_id, 0.0::DOUBLE AS value FROM orders WHERE o_orderkey % 4 = 2")
def pure(w):
    return _values(facts(w), "primary_shares").where("value = 0").select("filing_id", "value")


@register("j20_summary_contexts", "SELECT o_orderkey AS filing_id, 'Offering summary' AS source_locator FROM orders")
def contexts(w):
    return facts(w).where("field_name = 'shares_outstanding_post_ipo'").select("filing_id", "source_locator")


@register("j21_explicit_totals", "SELECT o_orderkey AS filing_id, 'shares_offered' AS field_name, (1000000 + o_orderkey)::DOUBLE AS value, 0.96::DOUBLE AS confidence, FALSE AS is_derived FROM orders WHERE o_orderkey % 4 = 3")
def explicit(w):
    return _values(facts(w), "shares_offered").where("confidence = 0.96")


@register("j22_derived_totals", """
 SELECT o_orderkey AS filing_id, 'shares_offered' AS field_name, CASE o_orderkey % 4 WHEN 0 THEN 1500000 + o_orderkey + o_orderkey % 1000 WHEN 1 THEN 1000000 + o_orderkey ELSE 500000 + o_orderkey % 1000 END::DOUBLE AS value,
  CASE WHEN o_orderkey % 4 = 1 THEN 0.94 ELSE 0.98 END::DOUBLE AS confidence, o_orderkey % 4 <> 1 AS is_derived FROM orders WHERE o_orderkey % 4 < 3""")
def derived(w):
    return _values(facts(w), "shares_offered").where("confidence <> 0.96")


@register("j23_post_shares", "SELECT o_orderkey AS filing_id, 'shares_outstanding_post_ipo' AS field_name, (9000000 + o_orderkey)::DOUBLE AS value, 0.98::DOUBLE AS confidence, FALSE AS is_derived FROM orders")
def post(w):
    return _values(facts(w), "shares_outstanding_post_ipo")


@register("j24_fact_store", "SELECT field_name, count(*) AS created FROM (SELECT unnest(['shares_offered','shares_outstanding_post_ipo','primary_shares','secondary_shares']) AS field_name, o_orderkey % 4 AS k FROM orders) WHERE CASE field_name WHEN 'primary_shares' THEN k < 3 WHEN 'secondary_shares' THEN k IN (0, 2) ELSE TRUE END GROUP BY 1")
def fact_store(w):
    parsed = facts(w)
    known = ot.store_facts(_no_facts(parsed), parsed.where("field_name = 'ipo_price'"))
    return ot.store_facts(known, parsed).groupBy("field_name").agg(F.count(F.lit(1)).alias("created"))


def _no_facts(parsed):
    return parsed.where("false").withColumns({"value_key": F.lit(""), "parser_name": F.lit(""), "parser_version": F.lit("")})


def _final_offerings(w):
    empty = F.lit(None).cast("double")
    return w.offering_documents().groupBy("ipo_id").agg(F.max("filing_id").alias("final_prospectus_filing_id")) \
        .withColumns({c: empty for c in (*ot.FIELDS, "deal_size")})


_FINAL = "(SELECT o_orderkey % 700 AS ipo_id, max(o_orderkey) AS k FROM orders GROUP BY 1)"


@register("j25_promotion", f"""
 SELECT ipo_id, 10.5 + k % 40 AS ipo_price, so AS shares_offered, so * (10.5 + k % 40) AS deal_size FROM (SELECT *, CASE k % 4 WHEN 0 THEN 1500000 + k + k % 1000 WHEN 2 THEN 500000 + k % 1000 ELSE 1000000 + k END::DOUBLE AS so FROM {_FINAL})""")
def promotion(w):
    parsed = facts(w)
    stored = ot.store_facts(_no_facts(parsed), parsed)
    return ot.promote_facts(_final_offerings(w), stored).select("ipo_id", "ipo_price", "shares_offered", "deal_size")


@register("j26_offering_job_report", f"""
 SELECT count(*) AS ipos_seen, count(*) AS documents_normalized, 0::BIGINT AS documents_failed, sum(CASE k % 4 WHEN 0 THEN 5 WHEN 1 THEN 4 WHEN 2 THEN 5 ELSE 3 END)::BIGINT AS parsed_facts,
  sum(CASE k % 4 WHEN 0 THEN 6 WHEN 1 THEN 5 WHEN 2 THEN 6 ELSE 4 END)::BIGINT AS canonical_fields_updated, 0::BIGINT AS ambiguities, count(*) AS derived_facts FROM {_FINAL}""")
def offering_report(w):
    cohort = _final_offerings(w)
    final = w.offering_documents().join(cohort.select(F.col("final_prospectus_filing_id").alias("filing_id")), "filing_id", "left_semi")
    stored = ot.store_facts(_no_facts(ot.offering_facts(final)), ot.offering_facts(final))
    return ot.offering_job_report(cohort, final, stored, ot.promote_facts(cohort, stored))


# ------------------------------------------------------- evidence inside the given documents
def _planted(w):
    """The given texts, whole, with a section at their end: a fifth of them names two terms for one kind of holder."""
    k = F.col("doc_id")
    said = lambda days: F.concat(
        F.lit("Our principal stockholders have agreed with the underwriters that they will not sell any shares for "), days,
        F.lit(" days after the date of this prospectus. Nothing else is agreed. "))
    first, second = pick(("90", "120", "180"), k % 3), pick(("120", "180", "90"), k % 3)
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\n\nUNDERWRITING\n\n"), said(first), F.when(k % 5 == 0, said(second)).otherwise(""))
    return w.table("documents").select(k.alias("filing_id"), k.alias("ipo_id"), F.lit("2001-01-01").cast("date").alias("filed_at"), text.alias("text"))


@register("j11_planted_agreements", """
 SELECT doc_id AS filing_id, unnest(CASE WHEN doc_id % 5 = 0 THEN [[90,120,180][doc_id % 3 + 1], [120,180,90][doc_id % 3 + 1]] ELSE [[90,120,180][doc_id % 3 + 1]] END) AS duration_days,
  'pre_ipo_investors' AS holder_group, 'underwriter_lockup' AS lockup_type, 'UNDERWRITING' AS heading FROM documents""")
def planted_agreements(w):
    return lt.agreements(_planted(w)).select("filing_id", "duration_days", "holder_group", "lockup_type",
                                             F.regexp_extract("source_locator", "^[A-Z]+", 0).alias("heading"))


@register("j14_planted_selection", """
 SELECT doc_id AS ipo_id, doc_id % 5 <> 0 AS selected, doc_id % 5 = 0 AS ambiguous,
  CASE WHEN doc_id % 5 <> 0 THEN DATE '2001-01-01' + [90,120,180][doc_id % 3 + 1]::INT END AS primary_lockup_expiration_date FROM documents""")
def planted_selection(w):
    rows = lt.agreements(_planted(w)).withColumn("lockup_id", F.col("filing_id") * 1000 + F.col("duration_days"))
    ipos = w.table("documents").select(F.col("doc_id").alias("ipo_id"), F.lit(None).cast("long").alias("primary_lockup_id"),
                                       F.lit(None).cast("date").alias("primary_lockup_expiration_date"))
    return lt.select_primary(ipos, rows).select("ipo_id", "selected", "ambiguous", "primary_lockup_expiration_date")


@register("j16_planted_prices", """
 SELECT doc_id AS filing_id, 10.5 + doc_id % 40 AS value, 'Prospectus cover' AS source_locator FROM documents
 UNION ALL SELECT page_id + 1000000000, 10.5 + page_id % 40, 'Prospectus cover' FROM pages""")
def planted_prices(w):
    """Every given text and every page's text with a price after it."""
    from lockstep.sources.documents import normalise_documents
    pages = normalise_documents(w.table("pages")).select((F.col("page_id") + 1000000000).alias("filing_id"), F.col("page_id").alias("k"), "text")
    texts = w.table("documents").select(F.col("doc_id").alias("filing_id"), F.col("doc_id").alias("k"), F.coalesce("text", F.lit("")).alias("text")).union(pages)
    told = F.concat("text", F.lit("\nThe initial public offering price per share is $"), (10 + F.col("k") % 40).cast("string"), F.lit(".50.\n"))
    facts = ot.offering_facts(texts.select("filing_id", told.alias("text")))
    return facts.where("field_name = 'ipo_price'").select("filing_id", F.col("value").cast("double").alias("value"), "source_locator")


@register("j24_rejected_facts", """
 SELECT doc_id AS filing_id, 'shares_outstanding_post_ipo' AS field_name, 'shares' AS unit FROM documents WHERE doc_id % 3 = 0""")
def rejected_facts(w):
    """Every given text with a share count after it; a third of the counts are longer than the stored type."""
    count = F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("9"), 30)).otherwise(F.format_number(F.col("doc_id") + 1000, 0))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\nCommon stock to be outstanding after this offering: "), count, F.lit(" shares\n"))
    rows = ot.rejected_facts(w.table("documents").select(F.col("doc_id").alias("filing_id"), text.alias("text")))
    return rows.select("filing_id", "field_name", "unit")


@register("j15_planted_job_report", """
 SELECT count(*) AS ipos_seen, count(*) FILTER (doc_id % 7 <> 0) AS documents_available, count(*) FILTER (doc_id % 7 = 0) AS documents_skipped,
  (count(*) FILTER (doc_id % 7 <> 0) + count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 5 = 0))::BIGINT AS lockups_created, count(*) FILTER (doc_id % 7 <> 0) AS ipos_with_lockups,
  count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 5 <> 0) AS primary_lockups_selected, count(*) FILTER (doc_id % 7 <> 0 AND doc_id % 5 = 0) AS ambiguities FROM documents""")
def planted_job_report(w):
    """One batch over all given texts: a seventh has no document, a fifth of the rest names two terms for one kind of holder."""
    documents = _planted(w).where(F.col("filing_id") % 7 != 0)
    cohort = w.table("documents").select(F.col("doc_id").alias("ipo_id"), F.col("doc_id").alias("final_prospectus_filing_id"),
                                         F.lit(None).cast("long").alias("primary_lockup_id"), F.lit(None).cast("date").alias("primary_lockup_expiration_date"))
    none = w.lockups().where("false").select("ipo_id", "filing_id", F.lit("").alias("parser_name"), F.lit("").alias("parser_version"))
    created = lt.agreements(lt.unparsed(cohort, documents.drop("ipo_id"), none))
    numbered = created.withColumn("lockup_id", F.col("filing_id") * 1000 + F.col("duration_days"))
    return lt.lockup_job_report(cohort, documents, none, created, lt.select_primary(cohort, numbered))
