import datetime as dt

import pytest
from pyspark.sql import functions as F

from lockstep.operators import lockup_text as lt
from lockstep.operators import offering_text as ot
from lockstep.sources.documents import normalise_documents

D = dt.date
HOLDERS = """PROSPECTUS SUMMARY

The study is reviewed after 180 days and restricts nobody.

UNDERWRITING

Our officers and substantially all holders of our common stock have agreed with the underwriters that they
will not offer or sell any shares for 180 days after the date of this prospectus. An aggregate of 12,500,000
shares are subject to the lock-up agreement. The representatives may waive these restrictions.

The company has agreed not to issue or sell common stock for 90 days after the date of this prospectus.

SHARES ELIGIBLE FOR FUTURE SALE

Certain selling stockholders may not sell their shares until the restrictions terminate on January 15, 2027. A
release during a blackout period moves.

DESCRIPTION OF CAPITAL STOCK
"""
BANKS = """LOCK-UP AGREEMENTS

Our principal stockholders have agreed not to sell shares for 180 days after the date of this prospectus without
first obtaining the written consent of Example Securities, Inc. Further terms follow. None matter.
Our employees have agreed not to sell shares for 90 days after the closing. These restrictions may be waived by
Sample Capital Markets LLC. Nothing else is agreed.
"""


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, D(2026, 2, 1)) for i, t in enumerate(texts)], "doc_id int, text string, filed_at date")


def test_sections_and_agreements(spark):
    df = docs(spark, HOLDERS)
    assert lt.sections(df).count() == 2
    rows = lt.agreements(df).collect()
    holders = next(r for r in rows if r["duration_days"] == 180)
    assert holders["holder_group"] == "existing_stockholders" and holders["lockup_type"] == "underwriter_lockup"
    assert holders["calculated_expiration_date"] == D(2026, 7, 31) and holders["shares_locked"] == 12500000
    assert holders["early_release_exists"] and "waive" in holders["early_release_terms"]
    assert holders["confidence"] == 0.92
    company = next(r for r in rows if r["holder_group"] == "company")
    assert (company["duration_days"], company["lockup_type"]) == (90, "company_lockup")
    stated = next(r for r in rows if r["stated_expiration_date"])
    assert stated["stated_expiration_date"] == D(2027, 1, 15) and stated["confidence"] == 0.97
    assert "blackout" in stated["early_release_terms"] and stated["calculated_expiration_date"] is None


def test_named_banks_and_closing_anchor(spark):
    rows = {r["duration_days"]: r for r in lt.agreements(docs(spark, BANKS)).collect()}
    assert rows[180]["holder_group"] == "pre_ipo_investors" and rows[180]["lockup_type"] == "underwriter_lockup"
    assert rows[180]["calculated_expiration_date"] == D(2026, 7, 31)
    assert rows[90]["lockup_type"] == "underwriter_lockup" and rows[90]["calculated_expiration_date"] is None


@pytest.mark.parametrize("text", [
    "BUSINESS\nThe trial lasts 180 days after the date of this prospectus.",
    "UNDERWRITING\n\nHolders have agreed not to sell for approximately six months."])
def test_unrelated_or_approximate_terms_give_nothing(spark, text):
    assert lt.agreements(docs(spark, text)).count() == 0


def test_unrelated_consent_stays_unknown(spark):
    text = ("UNDERWRITING\n\nOur principal stockholders have agreed not to sell stock for 180 days after the date of this "
            "prospectus. An amendment requires the written consent of Other Securities, Inc.")
    assert lt.agreements(docs(spark, text)).first()["lockup_type"] == "unknown"


def test_agreement_store_is_idempotent(spark):
    import pyspark.sql.functions as F
    parsed = lt.agreements(docs(spark, HOLDERS)).withColumns({"ipo_id": F.lit(1), "filing_id": F.lit(2)})
    ipos = spark.createDataFrame([(1, 25000000.0)], "ipo_id int, shares_outstanding_post_ipo double")
    none = parsed.select(lt.evidence_key().alias("evidence_key")).where("false")
    stored = lt.store_agreements(none, parsed, ipos)
    assert stored.count() == 3 and lt.store_agreements(stored, parsed, ipos).count() == 0
    share = stored.where("holder_group = 'existing_stockholders'").first()
    assert float(share["percentage_locked"]) == pytest.approx(50.0) and share["percentage_is_derived"]


def test_primary_selection_tiers_and_ambiguity(spark):
    rows = [(1, 10, "existing_stockholders", D(2026, 7, 31), 0.92), (2, 10, "existing_stockholders", D(2026, 7, 31), 0.97),
            (3, 10, "directors_officers", D(2026, 5, 1), 0.97), (4, 20, "pre_ipo_investors", D(2026, 5, 1), 0.92),
            (5, 20, "pre_ipo_investors", D(2026, 6, 1), 0.92), (6, 30, "existing_stockholders", D(2026, 6, 1), 0.82)]
    lockups = spark.createDataFrame([(i, ipo, g, "underwriter_lockup", None, d, c) for i, ipo, g, d, c in rows],
                                    "lockup_id int, ipo_id int, holder_group string, lockup_type string, "
                                    "stated_expiration_date date, calculated_expiration_date date, confidence double")
    ipos = spark.createDataFrame([(10, None, None), (20, 4, D(2026, 5, 1)), (30, None, None)],
                                 "ipo_id int, primary_lockup_id int, primary_lockup_expiration_date date")
    got = {r["ipo_id"]: r for r in lt.select_primary(ipos, lockups).collect()}
    assert (got[10]["primary_lockup_id"], got[10]["selected"]) == (2, True)
    assert got[20]["ambiguous"] and got[20]["cleared"] and got[20]["primary_lockup_id"] is None
    assert not got[30]["selected"] and not got[30]["cleared"]


def facts(spark, text):
    rows = ot.offering_facts(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()
    out = {}
    for r in rows:
        out.setdefault(r["field_name"], []).append((float(r["value"]), r["confidence"], r["is_derived"]))
    return out


def test_two_sided_offering(spark):
    got = facts(spark, "The initial public offering price per share is $22.00. We are offering 24,390,243 shares of common "
                       "stock. Our principal stockholder, a fund, is offering 13,170,731 shares.")
    assert got["ipo_price"] == [(22.0, 0.99, False)]
    assert got["primary_shares"] == [(24390243.0, 0.98, False)] and got["secondary_shares"][0][0] == 13170731
    assert got["shares_offered"] == [(37560974.0, 0.98, True)]


def test_pure_secondary_and_summary(spark):
    pad = "Filler words. " * 2000
    got = facts(spark, "Initial public offering price\n$ 32.00\n$ 136,000,000\nAll of the 4,250,000 shares of common stock are being "
                       "sold by the selling stockholders.\n" + pad +
                       "\nCommon stock outstanding immediately after giving effect to this offering: 35,596,255 shares")
    assert got["ipo_price"] == [(32.0, 0.99, False)]
    assert got["primary_shares"] == [(0.0, 0.99, False)] and got["secondary_shares"] == [(4250000.0, 0.98, False)]
    assert got["shares_outstanding_post_ipo"] == [(35596255.0, 0.98, False)]


def test_class_totals_and_conflicting_totals(spark):
    got = facts(spark, "a total of 10 shares and an offering of 12 shares. Class A common stock to be outstanding after this offering "
                       "5 shares. Total Class A and Class B common stock to be outstanding after this offering 9 shares.")
    assert sorted(got["shares_offered"]) == [(10.0, 0.80, False), (12.0, 0.80, False)]
    assert got["shares_outstanding_post_ipo"][0][0] == 9


def test_promotion_sets_clears_and_derives(spark):
    rows = [(1, 5, "ipo_price", 20.0, 0.99, "a"), (1, 5, "ipo_price", 20.0, 0.99, "b"), (1, 5, "shares_offered", 10.0, 0.96, "c"),
            (2, 6, "ipo_price", 20.0, 0.99, "d"), (2, 6, "ipo_price", 21.0, 0.99, "e"), (2, 6, "shares_offered", 9.0, 0.80, "f")]
    parsed = spark.createDataFrame([(i, f, n, v, "u", c, x, "l", False, None) for i, f, n, v, c, x in rows],
                                   "ipo_id int, filing_id int, field_name string, value double, unit string, confidence double, "
                                   "source_excerpt string, source_locator string, is_derived boolean, derivation string")
    none = parsed.where("false").selectExpr("*", "'' as value_key", "'' as parser_name", "'' as parser_version")
    stored = ot.store_facts(none, parsed)
    assert stored.count() == 6 and ot.store_facts(stored, parsed).count() == 0
    ipos = spark.createDataFrame([(1, 5) + (None,) * 6, (2, 6, 20.0, 9.0, None, None, None, 180.0)],
                                 "ipo_id int, final_prospectus_filing_id int, ipo_price double, shares_offered double, "
                                 "primary_shares double, secondary_shares double, shares_outstanding_post_ipo double, deal_size double")
    got = {r["ipo_id"]: r for r in ot.promote_facts(ipos, stored).collect()}
    assert (got[1]["ipo_price"], got[1]["deal_size"], got[1]["ambiguities"], got[1]["updated"]) == (20.0, 200.0, 0, 3)
    assert got[2]["ipo_price"] is None and got[2]["deal_size"] is None and got[2]["ambiguities"] == 1


def test_html_normalisation(spark):
    html = ("<html><style>p{}</style><script>var t='</p>';</script><!-- note --><p>A&nbsp;&amp;\t B</p>"
            "<noscript>x</noscript>\n\n<b> C </b></html>")
    row = normalise_documents(spark.createDataFrame([(1, html)], "page_id int, html string")).first()
    assert row["text"] == "A & B\nC\n" and row["byte_size"] == len(html)


FILLER = "Nothing of note is said in this line.\n"


def test_far_facts_in_long_sections_are_found(spark):
    far = "UNDERWRITING\n\n" + FILLER * 1200 + ("Our directors have agreed not to sell shares for 180 days after the date of this prospectus. "
                                              "The underwriters may waive these restrictions " + "at any time and " * 40 + "for anyone.\n")
    rows = lt.agreements(docs(spark, far, "\x0cLOCK-UP AGREEMENTS\x0c" + "Our sponsor will not sell shares for 90 days.")).collect()
    assert {(r["doc_id"], r["holder_group"], r["duration_days"]) for r in rows} == {(0, "directors_officers", 180), (1, "sponsor", 90)}
    told = next(r for r in rows if r["doc_id"] == 0)
    assert told["early_release_terms"].endswith("for anyone.") and told["source_excerpt"].endswith("for anyone.")


def test_windows_that_differ_late_keep_their_identity(spark):
    texts = ["LOCK-UP AGREEMENTS\nOur sponsor will not sell shares for 90 days. " + "and so on " * 200 + end for end in ("first.", "second.")]
    rows = lt.agreements(docs(spark, *texts)).withColumns({"ipo_id": F.lit(1), "filing_id": F.lit(1)})
    assert rows.select(lt.evidence_key()).distinct().count() == 2


def test_cover_ends_at_a_heading_and_not_at_a_length(spark):
    price = "The initial public offering price per share is $12.50.\n"
    late = docs(spark, "PROSPECTUS\n" + FILLER * 900 + price, "PROSPECTUS\n" + FILLER + "RISK FACTORS\n" + price,
                "TABLE OF CONTENTS\n" + price)
    rows = ot.offering_facts(late).where("field_name = 'ipo_price'").collect()
    assert sorted((r["doc_id"], float(r["value"])) for r in rows) == [(0, 12.5), (2, 12.5)]
    summary = "Common stock to be outstanding after this offering" + ":" + " " * 700 + "9,000,000 shares\n\nOther."
    assert ot.offering_facts(docs(spark, summary)).where("field_name = 'shares_outstanding_post_ipo'").first()["value"] == 9_000_000


def test_numbers_that_do_not_fit_are_kept_as_rejected(spark):
    total = docs(spark, "PROSPECTUS\nThis is an offering of " + "9" * 30 + " shares.\n")
    assert [r["field_name"] for r in ot.rejected_facts(total).collect()] == ["shares_offered"]
    assert ot.offering_facts(total).where("field_name = 'shares_offered'").count() == 0


def test_character_references(spark):
    html = ("<p>&#8220;A&#8221; &#x2014; &#151; &amp;lt; &reg;&euro; &amp &copy2024 &unknown; &#0; &#xD800; &#1114112; &#99999999999999;</p>"
            "<script>x</style>y</script>a\x0cb")
    text = normalise_documents(spark.createDataFrame([(html,)], "html string")).first()["text"]
    assert text == "“A” — — &lt; ®€ & ©2024 &unknown; � � � �\na\nb\n"


def test_evidence_identity_parses_each_text_twice(spark, tmp_path):
    import datetime as dt

    import __spark_entry__ as entry
    day = dt.datetime(1999, 3, 1)
    spark.createDataFrame([(1, day, "1-URGENT"), (2, day, "2-HIGH"), (2, day, "2-HIGH"), (None, day, "2-HIGH")],
                          "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    out = entry.queries()["j12_evidence_identity"](spark, str(tmp_path))
    assert out._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 2
    got = {r["filing_id"]: (r["agreements"], r["identities"], r["repeat_is_same"], r["other_excerpt_is_same"]) for r in out.collect()}
    # A filing that comes twice: each of its rows meets both of the repetition; one without a number meets none.
    assert got[1] == (2, 2, True, False) and got[2] == (8, 2, True, False)
    assert None not in got or got[None][2:] == (False, False)


def test_lookaheads_part_nothing(spark):
    import re

    from lockstep.operators import lockup_text as lt
    texts = ["AGREED NOT TO sell", "Lock up", "locKup ends", "ſix months", "the ſponsor", "xsix months", "a 180 days", "91 90 days",
             "We have agreed not to issue", "the Company agreed not to sell", "Our Directors, and Executive Officers", "following the date of this prospectus",
             "terminate on March 3, 2001", "may be waived by X Securities Inc.", "such restriction may be waived by Y Company, LLC", "dırector", "one hundred eighty days"]
    patterns = [lt.CONCEPT, lt.EARLY, lt.ANCHOR, lt.NAMED_CONSENT, lt.LINKED_WAIVER, lt.DAYS, lt.WRITTEN_DAYS, lt.SIX_MONTHS, lt.STATED, lt.COMPANY, *[p for _, p in lt.HOLDERS]]
    assert all("(?iU)(?=[" in p or re.match(r"\(\?iU\)\(\?=\w\)", p) for p in patterns)
    plain = [re.sub(r"^\(\?iU\)\(\?=\[[^\]]*\]\)|^\(\?iU\)\(\?=\w\)", "(?iU)", p) for p in patterns]
    from pyspark.sql import functions as F
    for row in spark.createDataFrame([(t,) for t in texts], "t string").select(
            "t", *[(F.regexp_extract("t", a, 0) == F.regexp_extract("t", b, 0)) & (F.col("t").rlike(a) == F.col("t").rlike(b)) for a, b in zip(patterns, plain)]).collect():
        assert all(row[1:]), row
