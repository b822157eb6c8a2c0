"""Source, ingest, cohort and classification queries."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lockstep.catalog import register
from lockstep.operators import classification as cl
from lockstep.operators import events as ev
from lockstep.operators import ingest as ing
from lockstep.sources import documents, filings, tables

REGISTRATION = ("S-1", "S-1/A", "F-1")


def index_lines(w):
    """The orders table written as index text: data lines plus banner-like noise."""
    named = w.filings().join(w.issuers().select("company_id", "name"), "company_id")
    short = F.when(F.col("filing_id") % 7 == 0, "AB").when(
        F.col("filing_id") % 3 == 0, F.concat("name", F.lit(" Holdings"))).otherwise(F.col("name"))
    line = F.concat_ws("|", F.col("company_id").cast("string"), short, F.col("form_type"),
                       F.col("filed_at").cast("string"), F.col("filing_path"))
    noise = F.when(F.col("filing_id") % 50 == 0, "CIK|Company Name|Form Type|Date Filed|Filename") \
        .when(F.col("filing_id") % 50 == 1, "-----------").otherwise("no fields here")
    return named.select(F.explode(F.array(line, noise)).alias("value"))


INDEX = """(SELECT lpad(CAST(company_id AS VARCHAR), 10, '0') AS cik,
 CASE WHEN filing_id % 7 = 0 THEN 'AB' WHEN filing_id % 3 = 0 THEN name || ' Holdings' ELSE name END AS company_name,
 form_type, filed_at, filing_path, accession_number FROM filing JOIN issuer USING (company_id) WHERE form_type IN ('S-1', 'S-1/A', 'F-1', 'F-1/A'))"""


def index(w):
    return filings.parse_index(index_lines(w))


@register("a2_filing_index", f"SELECT *, 'https://www.sec.gov/Archives/' || filing_path AS sec_url FROM {INDEX}")
def filing_index(w):
    return index(w)


@register("a4_index_date_filter", f"SELECT form_type, count(*) AS n, min(filed_at) AS first, max(filed_at) AS last FROM {INDEX} "
          "WHERE filed_at BETWEEN DATE '1996-03-01' AND DATE '1999-06-30' GROUP BY 1")
def index_dates(w):
    rows = filings.parse_index(index_lines(w), start=dt.date(1996, 3, 1), end=dt.date(1999, 6, 30))
    return rows.groupBy("form_type").agg(F.count(F.lit(1)).alias("n"), F.min("filed_at").alias("first"),
                                         F.max("filed_at").alias("last"))


def submissions(w):
    """One submissions document per order: three parallel filings, one of them unusable."""
    k = F.col("filing_id")
    recent = F.struct(
        F.array(F.col("accession_number"), F.lit("bad"), F.concat(F.lit("9"), F.substring("accession_number", 2, 30)))
        .alias("accessionNumber"),
        F.array(F.col("filed_at").cast("string"), F.lit("2001-01-01"), F.when(k % 4 == 0, "not a date")
                .otherwise(F.date_add("filed_at", 3).cast("string"))).alias("filingDate"),
        F.array(F.upper("form_type"), F.lit("10-K"), F.lit("8-K")).alias("form"),
        F.array(F.when(k % 2 == 0, "doc.htm").otherwise("")).alias("primaryDocument"))
    doc = F.struct(
        F.when(k % 3 == 0, F.concat(F.lit(" Issuer "), F.col("company_id").cast("string"))).alias("name"),
        F.array(F.when(k % 5 == 0, F.lit("TK"))).alias("tickers"), F.array(F.lit("NYSE")).alias("exchanges"),
        F.when(k % 10 != 9, F.struct(recent.alias("recent"))).alias("filings"))
    return w.filings().select(k.alias("submission_id"), F.lpad(F.col("company_id").cast("string"), 10, "0").alias("cik"),
                              F.to_json(doc).alias("payload"))


@register("a5_submission_filings", """
 SELECT cik, accession_number, form_type, filed_at, 'edgar/data/' || n || '/' || c || '/' || doc AS filing_path,
  'https://www.sec.gov/Archives/edgar/data/' || n || '/' || c || '/' || doc AS sec_url FROM (
 SELECT *, replace(accession_number, '-', '') AS c, coalesce(nullif(ltrim(cik, '0'), ''), '0') AS n,
  CASE WHEN pos = 0 AND filing_id % 2 = 0 THEN 'doc.htm' ELSE replace(accession_number, '-', '') || '-index.html' END AS doc FROM (
  SELECT filing_id, lpad(CAST(company_id AS VARCHAR), 10, '0') AS cik, accession_number, upper(form_type) AS form_type, filed_at, 0 AS pos FROM filing WHERE filing_id % 10 <> 9
  UNION ALL SELECT filing_id, lpad(CAST(company_id AS VARCHAR), 10, '0'), '9' || substr(accession_number, 2), '8-K', filed_at + 3, 2 FROM filing WHERE filing_id % 10 <> 9 AND filing_id % 4 <> 0))
 WHERE form_type IN ('424B4','EFFECT','8-A12B','8-A12G','10-Q','10-K','8-K','20-F','6-K')""")
def submission_rows(w):
    return filings.submission_filings(filings.parse_submissions(submissions(w)))


@register("a6_daily_bar_json", """
 SELECT l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS trade_date, round(l_extendedprice,2)::DOUBLE AS open, round(l_tax,2)::DOUBLE AS low,
  CAST(l_quantity AS BIGINT) AS volume FROM lineitem""")
def bar_json(w):
    item = F.struct(F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("t"),
                    F.col("l_extendedprice").alias("o"), F.col("l_extendedprice").alias("h"),
                    F.col("l_tax").alias("l"), F.col("l_discount").alias("c"), F.col("l_quantity").alias("v"))
    payload = F.to_json(F.struct(F.array(item).alias("results")))
    rows = w.table("lineitem").select(F.col("l_suppkey").alias("security_id"), payload.alias("payload"))
    bars = filings.parse_daily_bars(rows)
    return bars.select("security_id", "trade_date", F.round(F.col("open").cast("double"), 2).alias("open"),
                       F.round(F.col("low").cast("double"), 2).alias("low"), "volume")


@register("a5_rejected_filings", """
 SELECT lpad(CAST(company_id AS VARCHAR), 10, '0') AS cik, CASE WHEN filing_id % 12 IN (2, 5) THEN NULL WHEN pos = 1 THEN 'bad' ELSE '9' || substr(accession_number, 2) END AS accession_number,
  CASE WHEN filing_id % 12 IN (2, 5) THEN NULL WHEN pos = 1 THEN '10-K' ELSE '8-K' END AS form_type,
  CASE WHEN filing_id % 12 = 2 THEN 'not a JSON object' WHEN filing_id % 12 = 5 THEN 'required arrays are missing' WHEN pos = 1 THEN 'accession number' ELSE 'filing date' END AS reason
 FROM filing, (VALUES (1), (2)) t(pos) WHERE CASE WHEN filing_id % 12 IN (2, 5) THEN pos = 1 ELSE filing_id % 10 <> 9 AND (pos = 1 OR filing_id % 4 = 0) END
 UNION ALL SELECT lpad(CAST(company_id AS VARCHAR), 10, '0'), NULL, NULL, 'required arrays are missing' FROM filing WHERE filing_id % 12 NOT IN (2, 5) AND filing_id % 10 = 9""")
def rejected_filings(w):
    """Every sixth document is broken: half of them cut off, half without their arrays."""
    k = F.col("submission_id")
    broken = submissions(w).withColumn("payload", F.when(k % 12 == 2, F.substring("payload", 1, 25))
                                       .when(k % 12 == 5, F.lit('{"name": "X", "filings": {"recent": {"form": []}}}')).otherwise(F.col("payload")))
    return filings.rejected_submissions(filings.parse_submissions(broken))


@register("a6_rejected_bars", """
 SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 2 THEN 'not a JSON object' WHEN 3 THEN 'bar without time' WHEN 4 THEN 'bar without price' END AS reason,
  CASE WHEN l_linenumber NOT IN (2, 3, 4) THEN CAST(l_quantity AS BIGINT) END AS volume FROM lineitem WHERE l_linenumber <> 5""")
def rejected_bars(w):
    """Line items as payloads, some cut off, some without time, price or results: good bars and reasons side by side."""
    n = F.col("l_linenumber")
    item = F.struct(F.when(n != 3, F.unix_millis(F.col("l_shipdate").cast("timestamp"))).alias("t"),
                    F.when(n == 4, F.lit("n/a")).otherwise(F.col("l_extendedprice").cast("string")).alias("o"),
                    F.col("l_extendedprice").alias("h"), F.col("l_tax").alias("l"), F.col("l_discount").alias("c"), F.col("l_quantity").alias("v"))
    whole = F.to_json(F.struct(F.when(n != 5, F.array(item)).alias("results"), F.lit("OK").alias("status")))
    payload = F.when(n == 2, F.substring(whole, 1, 30)).otherwise(whole)
    key = F.struct("l_orderkey", "l_linenumber")
    rows = filings.read_daily_bars(w.table("lineitem").select(key.alias("security_id"), payload.alias("payload")))
    return rows.select("security_id.*", "reason", F.when(F.col("reason").isNull(), F.col("volume")).alias("volume"))


# The references the pages have by name, and all numeric ones.
_NAMES_SQL = {"amp": "&", "copy": "©", "middot": "·", "quot": '"', "lt": "<", "gt": ">", "nbsp": chr(160), "reg": "®", "euro": "€", "ndash": "–", "mdash": "—"}
_REFERENCE_SQL = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:middot|copy|nbsp|quot|amp|reg|lt|gt))"
_DECODED_SQL = ("CASE WHEN regexp_matches(r, '^&#[0-9]') THEN chr(regexp_extract(r, '[0-9]+')::INT) "
                "WHEN regexp_matches(r, '^&#[xX]') THEN chr(('0x' || regexp_extract(r, '[xX]([0-9a-fA-F]+)', 1))::INT) "
                + " ".join(f"WHEN rtrim(r, ';') = '&{name}' THEN chr({ord(shown)})" for name, shown in _NAMES_SQL.items()) + " ELSE r END")


@register("a7_html_text", rf"""
 SELECT page_id, sha256(html) AS sha256, octet_length(encode(html)) AS byte_size, sha256(text) AS text_sha256, length(text) AS text_chars FROM (
 SELECT page_id, html, array_to_string(list_filter(list_transform(regexp_split_to_array(b3, '\r\n|\r|\n|' || chr(11) || '|' || chr(12) || '|' || chr(133) || '|' || chr(8232) || '|' || chr(8233)),
   lambda x: trim(regexp_replace(x, '[ \t' || chr(160) || ']+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10)) || chr(10) AS text FROM (
 SELECT page_id, html, array_to_string(list_transform(range(1, len(parts) + 1), lambda n: parts[n] || CASE WHEN n <= len(refs) THEN shown[n] ELSE '' END), '') AS b3 FROM (
 SELECT *, list_transform(refs, lambda r: {_DECODED_SQL}) AS shown FROM (
 SELECT page_id, html, string_split_regex(b2, '{_REFERENCE_SQL}') AS parts, regexp_extract_all(b2, '{_REFERENCE_SQL}') AS refs FROM (
 SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>', chr(10), 'g'), '(?is)<style\b[^>]*>.*?</style\s*>', chr(10), 'g'),
  '(?is)<noscript\b[^>]*>.*?</noscript\s*>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g'), '(?s)<[^>]*>', chr(10), 'g') AS b2 FROM pages)))))""")
def html_text(w):
    df = documents.normalise_documents(w.table("pages"))
    return df.select("page_id", "sha256", F.col("byte_size").cast("long").alias("byte_size"),
                     F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("text_chars"))


@register("a8_table_scan", "SELECT count(*) AS rows, sum(volume)::BIGINT AS volume FROM prices")
def scan(w):
    return w.daily_prices().agg(F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"))


@register("a12_latest_prices", "SELECT trade_date, round(close, 6) AS close, provider FROM prices WHERE security_id = 103 ORDER BY trade_date DESC LIMIT 500")
def newest(w):
    return tables.latest_prices(w.daily_prices(), 103, 500).select(
        "trade_date", F.round("close", 6).alias("close"), "provider")


def known_companies(w):
    return w.issuers().where(F.col("company_id") % 3 == 0)


def known_filings(w):
    return w.filings().where(F.col("filing_id") % 4 == 0)


@register("b1_company_upsert", f"""
 SELECT coalesce(k.cik, n.cik) AS cik, coalesce(last, k.name, first) AS name, k.cik IS NULL AS created
 FROM (SELECT cik, name FROM issuer WHERE company_id % 3 = 0) k FULL JOIN (SELECT cik, arg_min(company_name, filed_at || accession_number) AS first,
  arg_max(company_name, filed_at || accession_number) FILTER (length(company_name) > 2) AS last FROM {INDEX} GROUP BY 1) n ON n.cik = k.cik""")
def company_upsert(w):
    return ing.upsert_companies(known_companies(w), index(w))


@register("b2_filing_insert", f"""
 SELECT accession_number, arg_min(cik, filed_at || cik || filing_path) AS cik, min(filed_at) AS filed_at FROM {INDEX}
 WHERE accession_number NOT IN (SELECT accession_number FROM filing WHERE filing_id % 4 = 0) GROUP BY 1""")
def filing_insert(w):
    return ing.insert_filings(known_filings(w), index(w)).select("accession_number", "cik", "filed_at")


def known_candidates(w):
    return known_companies(w).select("cik", F.date_add(F.lit("1998-01-01").cast("date"), (F.col("company_id") % 300).cast("int"))
                                     .alias("first_filing_date"))


@register("b3_candidate_upsert", f"""
 SELECT coalesce(k.cik, n.cik) AS cik, least(k.d, n.d) AS first_filing_date, k.cik IS NULL AS created FROM
 (SELECT cik, DATE '1998-01-01' + CAST(company_id % 300 AS INT) AS d FROM issuer WHERE company_id % 3 = 0) k
 FULL JOIN (SELECT cik, min(filed_at) AS d FROM {INDEX} GROUP BY 1) n ON n.cik = k.cik""")
def candidate_upsert(w):
    return ing.upsert_candidates(known_candidates(w), index(w))


@register("b4_ingest_counts", f"""
 SELECT count(*) AS candidate_filings_seen, count(DISTINCT cik) FILTER (cik NOT IN (SELECT cik FROM issuer WHERE company_id % 3 = 0)) AS companies_created,
  count(DISTINCT accession_number) FILTER (accession_number NOT IN (SELECT accession_number FROM filing WHERE filing_id % 4 = 0)) AS filings_created,
  count(DISTINCT cik) FILTER (cik NOT IN (SELECT cik FROM issuer WHERE company_id % 3 = 0)) AS ipo_candidates_created FROM {INDEX}""")
def counts(w):
    return ing.ingest_counts(known_companies(w), known_filings(w), known_candidates(w), index(w))


def latest_submission(w):
    """One parsed document per issuer: the one with the highest order id."""
    latest = w.filings().groupBy("company_id").agg(F.max("filing_id").alias("submission_id"))
    return filings.parse_submissions(submissions(w).join(latest, "submission_id", "left_semi"))


LATEST = """(SELECT company_id, max(filing_id) AS k FROM filing GROUP BY 1)"""


@register("b5_enrichment", f"""
 SELECT cik, coalesce(n, name) AS name, coalesce(t, ticker) AS ticker, coalesce(e, exchange) AS exchange,
  coalesce(n IS NOT NULL AND n IS DISTINCT FROM name, FALSE) OR coalesce(t IS NOT NULL AND t IS DISTINCT FROM ticker, FALSE)
  OR coalesce(e IS NOT NULL AND e IS DISTINCT FROM exchange, FALSE) AS changed FROM (
 SELECT cik, name, ticker, exchange, CASE WHEN k % 10 <> 9 AND k % 3 = 0 THEN 'Issuer ' || company_id END AS n,
  CASE WHEN k % 10 <> 9 AND k % 5 = 0 THEN 'TK' END AS t, CASE WHEN k % 10 <> 9 THEN 'NYSE' END AS e FROM issuer LEFT JOIN {LATEST} USING (company_id))""")
def enrichment(w):
    return ing.enrich_companies(w.issuers(), latest_submission(w)).drop("company_id")


@register("b5_enrichment_counts", f"""
 SELECT count(*) AS companies_seen, count(*) FILTER (k % 10 <> 9 AND (k % 3 = 0 OR (k % 5 = 0 AND ticker IS DISTINCT FROM 'TK') OR exchange IS NULL)) AS companies_updated,
  (SELECT sum(CASE WHEN upper(form_type) IN ('424B4','EFFECT','8-A12B','10-Q','10-K','8-K') THEN 1 ELSE 0 END + CASE WHEN filing_id % 4 <> 0 THEN 1 ELSE 0 END)::BIGINT
   FROM filing WHERE filing_id IN (SELECT k FROM {LATEST}) AND filing_id % 10 <> 9) AS filings_seen,
  (SELECT count(DISTINCT a) FROM (SELECT filing_id, accession_number AS a, upper(form_type) AS f FROM filing UNION ALL SELECT filing_id, '9' || substr(accession_number, 2), '8-K' FROM filing WHERE filing_id % 4 <> 0)
   WHERE f IN ('424B4','EFFECT','8-A12B','10-Q','10-K','8-K') AND filing_id IN (SELECT k FROM {LATEST}) AND filing_id % 10 <> 9
   AND a NOT IN (SELECT accession_number FROM filing WHERE filing_id % 4 = 0)) AS filings_created,
  count(*) FILTER (k % 10 = 9) AS errors FROM issuer LEFT JOIN {LATEST} USING (company_id)""")
def enrichment_counts(w):
    return ing.enrichment_counts(w.issuers(), latest_submission(w), known_filings(w))


@register("b6_primary_securities", """
 SELECT company_id, upper(ticker) AS ticker, exchange, TRUE AS is_primary, 'sec_company' AS source, upper(ticker) AS provider_symbol
 FROM issuer WHERE ticker IS NOT NULL AND company_id NOT IN (SELECT company_id FROM issuer WHERE company_id % 3 = 0)""")
def primary_securities(w):
    known = known_companies(w).select("company_id", F.upper("ticker").alias("ticker"),
                                      F.lit("sec_company").alias("source"))
    return ing.initialise_securities(w.issuers(), known)


@register("b7_completed_session", """
 SELECT event_id, s.session AS completed_session FROM (SELECT event_id, ts - INTERVAL 5 HOUR AS t FROM events)
 JOIN cal ON day = CAST(t AS DATE) JOIN ses s ON s.ix = CASE WHEN NOT is_session OR hour(t) >= 18 THEN prev_ix ELSE cal.ix - 1 END""")
def completed(w):
    rows = w.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return ing.latest_completed_session(rows, "ts").select("event_id", "completed_session")


def offerings(w):
    return w.ipos().join(ev.primary_security(w.securities()), "company_id")


def _plan(w, refresh):
    return ing.fetch_plan(offerings(w), w.daily_prices(), "primary", dt.date(2001, 10, 1), lookback_days=365,
                          refresh=refresh, refresh_days=30)


for _mode, _start in ((False, "coalesce(latest + 1, ipo_date, DATE '2001-10-01' - 364)"),
                      (True, "greatest(coalesce(ipo_date, DATE '2001-10-01' - 364), DATE '2001-10-01' - 29)")):
    @register("b8_fetch_plan_refresh" if _mode else "b8_fetch_plan", f"""
     SELECT ipo_id, security_id, {_start} AS start_date, {_start} > DATE '2001-10-01' AS skipped_current FROM ipo JOIN prim USING (company_id)
     LEFT JOIN (SELECT security_id, max(trade_date) AS latest FROM prices WHERE provider = 'primary' GROUP BY 1) USING (security_id)""")
    def plan(w, mode=_mode):
        return _plan(w, mode).select("ipo_id", "security_id", "start_date", "skipped_current")


def _fetched(w):
    """Responses: every third stored day again (new prices) and the day after the last one."""
    prices = w.daily_prices()
    again = prices.where(F.dayofmonth("trade_date") % 3 == 0).withColumn("close", F.col("close") + 1)
    moved = prices.where(F.dayofmonth("trade_date") % 7 == 0).withColumn("trade_date", F.date_add("trade_date", 3000))
    return again.unionByName(moved)


for _mode in (False, True):
    @register("b9_bar_refresh" if _mode else "b9_bar_insert", f"""
     SELECT security_id, count(*) AS bars, round(sum(close), 4) AS closes FROM (
      SELECT security_id, close {'+ CASE WHEN dayofmonth(trade_date) % 3 = 0 THEN 1 ELSE 0 END' if _mode else ''} AS close FROM prices
      UNION ALL SELECT security_id, close FROM prices WHERE dayofmonth(trade_date) % 7 = 0) GROUP BY 1""")
    def bar_merge(w, mode=_mode):
        merged = ing.merge_bars(w.daily_prices(), _fetched(w), refresh=mode)
        return merged.groupBy("security_id").agg(F.count(F.lit(1)).alias("bars"), F.round(F.sum("close"), 4).alias("closes"))


@register("b10_ingest_order", """
 SELECT ipo_id, row_number() OVER (ORDER BY offering_status = 'priced' DESC NULLS FIRST, first_filing_date DESC NULLS FIRST, ipo_id) AS position FROM ipo""")
def order(w):
    return ing.ingest_positions(w.ipos()).select("ipo_id", "position")


@register("b11_ingest_report", """
 SELECT count(*) AS securities_seen, count(*) FILTER (skip) AS skipped_current, 0::BIGINT AS securities_created, 0::BIGINT AS symbols_missing,
  (SELECT count(*) FILTER (dayofmonth(trade_date) % 3 = 0) + count(*) FILTER (dayofmonth(trade_date) % 7 = 0) FROM prices) AS bars_fetched,
  (SELECT count(*) FILTER (dayofmonth(trade_date) % 7 = 0) FROM prices) AS bars_created, 0::BIGINT AS bars_updated,
  count(*) FILTER (NOT skip AND security_id NOT IN (SELECT security_id FROM prices WHERE dayofmonth(trade_date) % 3 = 0 OR dayofmonth(trade_date) % 7 = 0)) AS provider_no_data,
  0::BIGINT AS provider_errors, 0::BIGINT AS errors FROM (
  SELECT security_id, coalesce(latest + 1, ipo_date, DATE '2001-10-01' - 364) > DATE '2001-10-01' AS skip FROM ipo JOIN prim USING (company_id)
  LEFT JOIN (SELECT security_id, max(trade_date) AS latest FROM prices WHERE provider = 'primary' GROUP BY 1) USING (security_id))""")
def report(w):
    return ing.ingest_report(_plan(w, False), _fetched(w), w.daily_prices())


_COHORT = "FROM lock JOIN ipo USING (ipo_id) JOIN comp USING (company_id)"
_CLEAN = "classification_status = 'classified' AND candidate_type = 'operating_company_ipo' AND offering_status = 'priced'"


@register("c1_cohort_filter", f"SELECT lockup_id, ipo_id, ticker {_COHORT} WHERE {_CLEAN} AND lockup_id = primary_lockup_id")
def cohort(w):
    return ev.analysis_cohort(w.lockups(), w.ipos(), w.companies(), **ev.CLEAN).select("lockup_id", "ipo_id", "ticker")


@register("c2_lockup_override", f"SELECT lockup_id, ipo_id {_COHORT} WHERE lockup_id = 7")
def override(w):
    return ev.analysis_cohort(w.lockups(), w.ipos(), w.companies(), lockup_id=7, **ev.CLEAN).select("lockup_id", "ipo_id")


@register("c3_primary_variants", f"""
 SELECT count(*) FILTER (primary_lockup_expiration_date IS NOT NULL) AS promoted, count(*) AS selected {_COHORT} WHERE lockup_id = primary_lockup_id""")
def variants(w):
    rows = w.lockups().join(w.ipos(), "ipo_id")
    return rows.agg(F.count_if(ev.promoted_primary()).alias("promoted"), F.count_if(ev.selected_primary()).alias("selected"))


@register("c4_event_level_limit", """
 SELECT lockup_id, observation_offset FROM snap1 WHERE lockup_id IN (
  SELECT lockup_id FROM snap1 GROUP BY lockup_id, ipo_id ORDER BY min(event_date), ipo_id, lockup_id LIMIT 40)""")
def event_limit(w):
    from lockstep.catalog.snapshots import stored_bar
    rows = stored_bar(w).select("lockup_id", "ipo_id", "event_date", "observation_offset")
    return ev.event_level_limit(rows, 40, order=["ipo_id"]).select("lockup_id", "observation_offset")


@register("c5_clean_cohort", f"SELECT lockup_id, ipo_id, primary_lockup_expiration_date {_COHORT} WHERE {_CLEAN} AND lockup_id = primary_lockup_id AND primary_lockup_expiration_date IS NOT NULL")
def clean(w):
    rows = ev.analysis_cohort(w.lockups(), w.ipos(), w.companies(), primary_lockup_only=True, **ev.CLEAN)
    return rows.select("lockup_id", "ipo_id", "primary_lockup_expiration_date").orderBy(
        "primary_lockup_expiration_date", "ipo_id", "lockup_id")


@register("c6_substring_search", "SELECT company_id, name FROM issuer WHERE name ILIKE '%00 gr%' OR ticker ILIKE '%00 gr%'")
def search(w):
    from lockstep.operators.projections import matches_text
    return w.issuers().where(matches_text(" 00 GR ")).select("company_id", "name")


@register("c7_range_tasks", """
 SELECT count(*) AS explicit_tasks, (SELECT count(*) FROM lock JOIN ipo USING (ipo_id) JOIN sec USING (company_id) WHERE is_primary AND event_date IS NOT NULL) AS derived_tasks,
  (SELECT count(*) FROM lock JOIN ipo USING (ipo_id) JOIN sec USING (company_id) WHERE is_primary AND event_date IS NULL) AS skipped
 FROM (SELECT DISTINCT security_id FROM lock JOIN ipo USING (ipo_id) JOIN sec USING (company_id) WHERE is_primary)""")
def tasks(w):
    from lockstep.operators import coverage as cv
    from lockstep.operators.outcomes import side_by_side
    rows = cv.selected_rows(w.ipos(), w.companies(), w.lockups(), w.securities())
    explicit = cv.explicit_tasks(rows, dt.date(1996, 1, 1), dt.date(1996, 12, 31))
    derived, skipped = cv.derived_tasks(rows)
    return side_by_side([df.agg(F.count(F.lit(1)).alias(name)) for df, name in (
        (explicit, "explicit_tasks"), (derived, "derived_tasks"), (skipped, "skipped"))])


@register("c8_selected_join", "SELECT lockup_id, security_id, sec.ticker FROM lock JOIN ipo USING (ipo_id) JOIN sec USING (company_id) WHERE is_primary")
def selected(w):
    from lockstep.operators import coverage as cv
    return cv.selected_rows(w.ipos(), w.companies(), w.lockups(), w.securities()).select("lockup_id", "security_id", "ticker")


_CLASSIFIED = """(SELECT ipo_id, company_id, anchor, CASE WHEN anchor IS NULL OR periodic <> '' THEN 'unknown' WHEN spac THEN 'spac' WHEN fund THEN 'fund' WHEN fin IS NOT NULL AND ind THEN 'operating_company_ipo' ELSE 'unknown' END AS candidate_type,
  CASE WHEN anchor IS NOT NULL AND periodic = '' AND (spac OR fund OR (fin IS NOT NULL AND ind)) THEN 'classified' ELSE 'needs_review' END AS classification_status,
  CASE WHEN anchor IS NULL THEN 'unknown' WHEN fin IS NOT NULL THEN 'priced' WHEN rw THEN 'withdrawn' WHEN eff THEN 'effective' WHEN reg THEN 'filed' ELSE 'unknown' END AS offering_status,
  periodic, fin AS final_prospectus_filing_id FROM (
 SELECT *, name ILIKE '%acquisition corp%' AND (fin IS NOT NULL OR ind) AS spac, name ILIKE '% fund%' AND (fin IS NOT NULL OR ind) AS fund FROM (
 SELECT a.ipo_id, a.company_id, a.anchor, any_value(name) AS name, arg_min(filing_id, filed_at || accession_number) FILTER (inw AND f = '424B4') AS fin,
  coalesce(bool_or(inw AND f = 'RW'), FALSE) AS rw, coalesce(bool_or(inw AND f = 'EFFECT'), FALSE) AS eff, coalesce(bool_or(inw AND f IN ('S-1','S-1/A','F-1')), FALSE) AS reg,
  coalesce(bool_or(inw AND f IN ('EFFECT','8-A12B')), FALSE) AS ind,
  coalesce(array_to_string(list_sort(list(DISTINCT f) FILTER (f IN ('10-K','10-Q') AND filed_at < a.anchor)), ', '), '') AS periodic
 FROM (SELECT ipo_id, c.company_id, name, coalesce(first_filing_date, (SELECT min(filed_at) FROM filing g WHERE g.company_id = c.company_id AND upper(form_type) IN ('S-1','S-1/A','F-1'))) AS anchor
   FROM cand c JOIN issuer i ON i.company_id = c.company_id) a LEFT JOIN (SELECT *, upper(form_type) AS f FROM filing) x ON x.company_id = a.company_id,
 LATERAL (SELECT x.filed_at BETWEEN a.anchor AND a.anchor + 180 AS inw) GROUP BY 1, 2, 3)))"""


@register("k1_classification", f"SELECT ipo_id, anchor, candidate_type, classification_status, offering_status, final_prospectus_filing_id FROM {_CLASSIFIED}")
def classification(w):
    return cl.classify(w.candidates(), w.issuers(), w.filings()).drop("company_id", "classification_reason")


@register("k2_evidence_window", """
 SELECT company_id, count(*) AS filings FROM cand c JOIN filing f USING (company_id)
 WHERE filed_at BETWEEN first_filing_date AND first_filing_date + 180 GROUP BY 1""")
def evidence(w):
    rows = w.filings().join(w.candidates().select("company_id", "first_filing_date"), "company_id")
    inside = F.col("filed_at").between(F.col("first_filing_date"), F.date_add("first_filing_date", cl.WINDOW_DAYS))
    return rows.where(inside).groupBy("company_id").agg(F.count(F.lit(1)).alias("filings"))


for _name, _column in (("k3_final_prospectus", "final_prospectus_filing_id"), ("k4_offering_status", "offering_status"),
                       ("k6_type_decision", "candidate_type")):
    @register(_name, f"SELECT ipo_id, {_column} FROM {_CLASSIFIED}")
    def decision(w, column=_column):
        return cl.classify(w.candidates(), w.issuers(), w.filings()).select("ipo_id", column)


@register("k5_periodic_reason", f"""
 SELECT ipo_id, CASE WHEN anchor IS NULL THEN 'Needs review: no S-1/F-1 registration anchor is available.' WHEN periodic <> '' THEN
  'Needs review: periodic filing history (' || periodic || ') predates registration, suggesting an already-public issuer.' END AS reason
 FROM {_CLASSIFIED} WHERE anchor IS NULL OR periodic <> ''""")
def reason(w):
    rows = cl.classify(w.candidates(), w.issuers(), w.filings())
    periodic = F.col("classification_reason").startswith(cl.PERIODIC[0]) | (F.col("classification_reason") == cl.NO_ANCHOR)
    return rows.where(periodic).select("ipo_id", F.col("classification_reason").alias("reason"))


@register("k7_classification_report", f"""
 SELECT count(*) AS ipos_seen, count(*) FILTER (classification_status = 'classified') AS classified, count(*) FILTER (classification_status = 'needs_review') AS needs_review,
  0::BIGINT AS unchanged, count(final_prospectus_filing_id) AS prospectuses_linked FROM {_CLASSIFIED}""")
def classification_report(w):
    stored = w.candidates()
    return cl.classification_report(stored, cl.classify(stored, w.issuers(), w.filings()))
