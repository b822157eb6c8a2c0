"""Lock-up agreements from prospectus text, as column expressions over whole documents.

Sections, sentences and evidence windows are arrays inside the document row, so the
extraction needs no shuffle; only the final agreement rows leave it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lockstep.functions.numeric import all_of

# Parser identity, confidences, heading and wording patterns.
PARSER_NAME = "deterministic_lockup_parser"
PARSER_VERSION = "1.1"
VERY_HIGH, HIGH, PLAUSIBLE = 0.97, 0.92, 0.82
# Where a pattern can begin with few letters, a lookahead for them spares its branches and \b at all other places.
#: Line ends, form feeds and separators included.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
SENTENCE_END = r"(?U)(?<=[.!?])\s+"
HEADING = (r"(?iU)^\s*(?:underwriting|shares eligible for (?:future )?sale|lock[ -]?up (?:agreements?|arrangements?)|"
           r"restrictions? on sale)\s*$")
CONCEPT = (r"(?iU)(?=[larmw])(?:lock[ -]?up|agree(?:d)?(?:.{0,100})?(?:not to|will not)|(?:may|will) not (?:offer|sell)|"
           r"restricted from)")
EARLY = r"(?iU)(?=[werbsp])(?:waiv(?:e|er)|early release|release .*shares|blackout|staggered release|partial release)"
ANCHOR = r"(?iU)(?=[af])(?:after|following) (?:the )?date of (?:this|the) prospectus"
FIRM = (r"(?=[^.]{0,180}\b(?:Securities|Capital Markets|Company)\b)"
        r"[^.]{0,180}\b(?:Inc\.?|LLC|L\.?P\.?|Ltd\.?)")
NAMED_CONSENT = (r"(?iU)(?=[wm])(?:without (?:first obtaining|the prior) (?:the )?written consent of|"
                 r"may be waived by|written consent of)" + FIRM)
LINKED_WAIVER = (r"(?iU)(?=[ts])(?:this|these|the|such) (?:sale |transfer )?(?:restriction|lock[ -]?up)s? "
                 r"may be waived by" + FIRM)
DAYS = r"(?iU)(?=[19])\b(90|120|180)\s*(?:calendar\s+)?days\b"
WRITTEN_DAYS = r"(?iU)(?=o)\b(one hundred (?:and )?eighty) days\b"
SIX_MONTHS, APPROXIMATE = r"(?iU)(?=s)\bsix months\b", r"(?iU)approximately|about"
STATED = (r"(?iU)(?=[te])(?:terminate|expire|expiration)(?:s|d)?(?:\s+on|\s+is)?\s+"
          r"(January|February|March|April|May|June|July|August|September|October|November|December)"
          r"\s+(\d{1,2}),\s+(20\d{2})")
COMPANY = r"(?iU)(?=[wt])(?:we|the company) (?:have |has )?agree(?:d)? not to (?:issue|sell)"
COMPANY_NAME = r"(?iU)(?:we|the company)"
HOLDERS = (
    ("selling_stockholders", r"(?iU)(?=[os])\b(?:our )?selling stockholders?\b"),
    ("existing_stockholders",
     r"(?iU)(?=[scoh])\b(?:substantially all |certain |our )?(?:holders|stockholders) of (?:our )?(?:common )?stock\b"),
    ("pre_ipo_investors", r"(?iU)(?=p)\b(?:pre-IPO investors?|principal stockholders?)\b"),
    ("directors_officers", r"(?iU)(?=[od])\b(?:our )?directors?(?:,? (?:and )?(?:executive )?officers?)?\b"),
    ("employees", r"(?iU)(?=[oe])\b(?:our )?employees?\b"),
    ("sponsor", r"(?iU)(?=[ots])\b(?:our |the )?sponsor\b"))
SHARES = (r"(?iU)(?:an aggregate of )?([\d,]+) shares (?:are |is |will be )?(?:subject to|covered by) "
          r"(?:the )?lock[ -]?up")
TIERS = ("existing_stockholders", "pre_ipo_investors", "selling_stockholders", "directors_officers")
PRIMARY_CONFIDENCE = 0.90


def _group(text: Column, pattern: str, index: int = 0) -> Column:
    """A capture group, or null without a match."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, index))


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def _bare(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def sections(documents: DataFrame) -> DataFrame:
    """``doc_id, filed_at, heading, text, start_line`` of every section with the concept.

    A section runs to the next heading or the end of the document.
    """
    lines = F.split("text", LINE_END)
    heads = F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(HEADING), i)),
                     lambda i: i.isNotNull())

    def region(start: Column, n: Column) -> Column:
        stop = F.coalesce(F.get("_heads", n + 1), F.size("_lines"))
        body = F.array_join(F.slice("_lines", start + 2, F.greatest(stop - start - 1, F.lit(0))), "\n")
        return F.struct(_bare(F.get("_lines", start)).alias("heading"), body.alias("text"),
                        (start + 1).alias("start_line"))

    keep = [c for c in documents.columns if c != "text"]
    # Outer generators: an inferred "array is not empty" filter would repeat the regexes.
    return (documents.withColumn("_lines", lines).withColumn("_heads", heads)
            .select(*keep, F.explode_outer(F.transform("_heads", region)).alias("s")).where("s is not null")
            .select(*keep, "s.*").where(F.col("text").rlike(CONCEPT)))


def sentence_windows(found: DataFrame) -> DataFrame:
    """Each sentence of a section with itself and the next two as its evidence window."""
    keep = [c for c in found.columns if c != "text"]
    split = found.withColumn("_all", F.split(_flat(F.col("text")), SENTENCE_END))
    return split.select(*keep, "_all", F.posexplode_outer("_all").alias("position", "sentence")) \
        .where("sentence is not null").withColumn(
        "window", F.array_join(F.slice("_all", F.col("position") + 1, 3), " ")).drop("_all")


def duration(text: Column) -> Column:
    """90, 120 or 180 days; exact six months count as 180, approximate ones do not."""
    return (F.when(text.rlike(DAYS), F.regexp_extract(text, DAYS, 1).try_cast("int"))
            .when(text.rlike(WRITTEN_DAYS), 180)
            .when(text.rlike(SIX_MONTHS) & ~text.rlike(APPROXIMATE), 180))


def stated_expiration(text: Column) -> Column:
    parts = F.concat_ws(" ", F.initcap(_group(text, STATED, 1)), _group(text, STATED, 2), _group(text, STATED, 3))
    return F.when(text.rlike(STATED), F.try_to_date(parts, "MMMM d yyyy"))


def holder_group(text: Column) -> Column:
    group = F.when(text.rlike(COMPANY), "company")
    for name, pattern in HOLDERS:
        group = group.when(text.rlike(pattern), name)
    return group.otherwise("unknown")


def holder_phrase(text: Column, group: Column) -> Column:
    """Wording around the holder: from the last full stop to the verb, or the sentence's end without one."""
    at, found = F.lit(0), F.lit("")
    for name, pattern in reversed(HOLDERS):
        at = F.when(group == name, F.regexp_instr(text, F.lit(pattern))).otherwise(at)
        found = F.when(group == name, F.regexp_extract(text, pattern, 0)).otherwise(found)
    before = F.regexp_extract(F.substr(text, F.lit(1), F.greatest(at - 1, F.lit(0))), r"([^.]*)$", 1)
    after = F.substr(text, at + F.length(found))
    verb = F.locate(", have", after)
    agreed = F.locate(" agreed", after)
    stop = F.when(verb > 0, verb - 1).when(agreed > 0, agreed - 1).otherwise(F.length(after))
    phrase = F.concat(before, found, F.substr(after, F.lit(1), stop))
    bare = F.regexp_replace(phrase, r"^[ ,;\n]+|[ ,;\n]+$", "")
    return F.when(group == "company", F.regexp_extract(text, COMPANY_NAME, 0)).when(group != "unknown", bare)


def early_release_terms(text: Column) -> Column:
    """The sentences with early-release wording."""
    told = F.filter(F.split(text, SENTENCE_END), lambda x: x.rlike(EARLY))
    return F.when(text.rlike(EARLY), _flat(F.array_join(told, " ")))


def agreements(documents: DataFrame) -> DataFrame:
    """One row per restricting sentence that names a term or a date.

    ``documents`` carries ``text``, ``filed_at`` and any key columns.
    """
    rows = sentence_windows(sections(documents))
    sentence, window = F.col("sentence"), F.col("window")
    rows = rows.where(sentence.rlike(CONCEPT)).withColumns({
        "duration_days": duration(sentence), "stated_expiration_date": stated_expiration(sentence)})
    rows = rows.where("duration_days is not null or stated_expiration_date is not null")
    rows = rows.withColumn("holder_group", holder_group(sentence))
    group = F.col("holder_group")
    bank = sentence.rlike(NAMED_CONSENT) | window.rlike(LINKED_WAIVER)
    rows = rows.withColumns({
        "holder_group_text": holder_phrase(sentence, group),
        "lockup_type": F.when(group == "company", "company_lockup")
            .when(F.contains(F.lower(window), F.lit("market standoff")), "market_standoff")
            .when(window.rlike(r"(?iU)underwriter|representative") | bank, "underwriter_lockup").otherwise("unknown"),
        "calculated_expiration_date": F.when(window.rlike(ANCHOR), F.date_add("filed_at", F.col("duration_days"))),
        "shares_locked": F.regexp_replace(_group(window, SHARES, 1), ",", "").try_cast("decimal(18,2)"),
        "early_release_terms": early_release_terms(window)})
    named = group != "unknown"
    return rows.withColumns({
        "early_release_exists": F.col("early_release_terms").isNotNull(),
        "confidence": F.when(F.col("stated_expiration_date").isNotNull() & named, VERY_HIGH)
            .when((F.col("lockup_type") == "underwriter_lockup") & named, HIGH).otherwise(PLAUSIBLE),
        "source_excerpt": window,
        "source_locator": F.concat("heading", F.lit(", line "), F.col("start_line").cast("string")),
    }).drop("heading", "start_line", "position", "sentence", "window")


def evidence_key(excerpt: Column | None = None) -> Column:
    """Identity of an agreement row: a digest of its thirteen attributes; ``excerpt`` stands in for its excerpt."""
    names = ("ipo_id", "filing_id", "lockup_type", "holder_group", "holder_group_text", "duration_days",
             "stated_expiration_date", "calculated_expiration_date", "shares_locked", "source_excerpt",
             "source_locator")
    values = {c: F.col(c) for c in names}
    if excerpt is not None:
        values["source_excerpt"] = excerpt
    fields = [v.cast("string").alias(c) for c, v in values.items()]
    return F.sha2(F.to_json(F.struct(*fields, F.lit(PARSER_NAME).alias("parser_name"),
                                     F.lit(PARSER_VERSION).alias("parser_version")),
                            {"ignoreNullFields": "false"}), 256)


def store_agreements(stored: DataFrame, parsed: DataFrame, ipos: DataFrame) -> DataFrame:
    """Agreement rows not stored yet, with the locked percentage derived from outstanding shares."""
    rows = parsed.withColumn("evidence_key", evidence_key()).dropDuplicates(["evidence_key"])
    fresh = rows.join(stored.select("evidence_key"), "evidence_key", "left_anti")
    outstanding = ipos.select("ipo_id", F.col("shares_outstanding_post_ipo").alias("_out"))
    share = F.try_divide(F.col("shares_locked"), F.nullif(F.col("_out"), F.lit(0))) * 100
    return fresh.join(outstanding, "ipo_id", "left").withColumns({
        "percentage_locked": share, "percentage_is_derived": share.isNotNull(),
        "parser_name": F.lit(PARSER_NAME), "parser_version": F.lit(PARSER_VERSION)}).drop("_out")


def select_primary(ipos: DataFrame, lockups: DataFrame) -> DataFrame:
    """Primary agreement per offering, cleared when the best holder tier disagrees on the date.

    Aggregates only: the best tier, whether its dates agree, and the pick by confidence
    then id, so an offering with very many agreements never gathers in one task.
    """
    expires = F.coalesce("stated_expiration_date", "calculated_expiration_date")
    tier = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("holder_group"))
    rows = lockups.where((F.col("lockup_type") == "underwriter_lockup") & F.col("holder_group").isin(*TIERS)
                         & (F.col("confidence") >= PRIMARY_CONFIDENCE)).withColumns({"_d": expires, "_t": tier}) \
        .where("_d is not null")
    tiers = rows.groupBy("ipo_id", "_t").agg(
        F.min("_d").alias("_first"), F.max("_d").alias("_last"),
        F.min_by("lockup_id", F.struct((-F.col("confidence")).alias("c"), F.col("lockup_id"))).alias("_pick"))
    best = tiers.groupBy("ipo_id").agg(F.min_by(F.struct("_first", "_last", "_pick"), "_t").alias("_b"))
    agree = F.col("_b._first") == F.col("_b._last")
    return ipos.select("ipo_id", "primary_lockup_id", "primary_lockup_expiration_date").join(best, "ipo_id", "left") \
        .select("ipo_id", F.when(agree, F.col("_b._pick")).alias("primary_lockup_id"),
                F.when(agree, F.col("_b._first")).alias("primary_lockup_expiration_date"),
                F.coalesce(agree, F.lit(False)).alias("selected"),
                F.coalesce(~agree, F.lit(False)).alias("ambiguous"),
                (~F.coalesce(agree, F.lit(False)) & (F.col("primary_lockup_id").isNotNull()
                 | F.col("primary_lockup_expiration_date").isNotNull())).alias("cleared"))


def lockup_job_report(cohort: DataFrame, documents: DataFrame, stored: DataFrame, created: DataFrame,
                      selection: DataFrame) -> DataFrame:
    """Counters of one batch over offerings with a linked prospectus."""
    from lockstep.operators.outcomes import side_by_side
    text = documents.select("filing_id", F.lit(True).alias("_text")).distinct()
    seen = cohort.join(text, cohort["final_prospectus_filing_id"] == text["filing_id"], "left")
    after = stored.select("ipo_id").unionByName(created.select("ipo_id")).distinct()
    picked = selection.join(seen.where("_text").select("ipo_id"), "ipo_id", "left_semi")
    return side_by_side([
        seen.agg(F.count(F.lit(1)).alias("ipos_seen"), F.count("_text").alias("documents_available"),
                 F.count_if(F.col("_text").isNull()).alias("documents_skipped")),
        created.agg(F.count(F.lit(1)).alias("lockups_created")),
        seen.where("_text").join(after, "ipo_id", "left_semi").agg(F.count(F.lit(1)).alias("ipos_with_lockups")),
        picked.agg(F.count_if("selected").alias("primary_lockups_selected"), F.count_if("ambiguous").alias("ambiguities"))])


def unparsed(cohort: DataFrame, documents: DataFrame, stored: DataFrame, *, reparse: bool = False) -> DataFrame:
    """Documents of the cohort that this parser version has not read yet."""
    rows = documents.join(cohort.select("ipo_id", F.col("final_prospectus_filing_id").alias("filing_id")), "filing_id")
    if reparse:
        return rows
    done = stored.where(all_of([F.col("parser_name") == PARSER_NAME, F.col("parser_version") == PARSER_VERSION]))
    return rows.join(done.select("ipo_id", "filing_id"), ["ipo_id", "filing_id"], "left_anti")
