"""HTML pages to normalised text lines, with a digest of the raw bytes."""
from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Named references that are read without a semicolon too.
BARE_NAMES = sorted((name for name in html5 if not name.endswith(";")), key=lambda name: (-len(name), name))
REFERENCE = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:" + "|".join(BARE_NAMES) + "))"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def _named() -> Column:
    """All named references, without the ampersand, as one constant map."""
    return F.from_json(F.lit(json.dumps(html5)), "map<string,string>")


def _windows_characters() -> Column:
    """What numbers 128 to 159 stand for on web pages."""
    shown = {str(n): bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if n not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}
    return F.from_json(F.lit(json.dumps(shown)), "map<string,string>")


def decoded_reference(reference: Column) -> Column:
    """The text a character reference stands for; an unknown name stays as it is."""
    digits = F.regexp_extract(reference, r"^&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));?$", 1)
    decimal = F.regexp_extract(reference, r"^&#([0-9]+);?$", 1)
    text = F.when(digits != "", F.conv(digits, 16, 10)).otherwise(decimal)
    code = F.when(F.length(F.ltrim(text, F.lit("0"))) <= 9, text.try_cast("long"))
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    shown = F.coalesce(F.try_element_at(_windows_characters(), code.cast("string")),
                       F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    numeric = F.when(F.coalesce(valid, F.lit(False)), shown).otherwise("\ufffd")
    name = F.substr(reference, F.lit(2))
    return F.when(reference.startswith("&#"), numeric).otherwise(
        F.coalesce(F.try_element_at(_named(), name), reference))


def decode_references(text: Column) -> Column:
    """Every character reference replaced, in one pass: what decoding yields is not decoded again."""
    both = F.struct(F.split(text, REFERENCE).alias("between"),
                    F.regexp_extract_all(text, F.lit(f"({REFERENCE})"), F.lit(1)).alias("references"))
    # Held in a one-element array, so that both lists are computed once and not for every element.
    return F.get(F.transform(F.array(both), lambda x: F.array_join(F.transform(
        x["between"], lambda part, n: F.concat(part, F.coalesce(F.when(
            n < F.size(x["references"]), decoded_reference(F.get(x["references"], n))), F.lit("")))), "")), F.lit(0))


def normalised_text(html: Column) -> Column:
    """Drop scripts, styles and comments, break at tags, decode references, collapse blanks, drop empty lines."""
    body = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", "\n")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", "\n")
    body = F.regexp_replace(body, r"(?s)<[^>]*>", "\n")
    lines = F.transform(F.split(decode_references(body), LINE_END),
                        lambda x: F.trim(F.regexp_replace(x, "[ \t\u00a0]+", " ")))
    kept = F.filter(lines, lambda x: x != "")
    return F.concat(F.array_join(kept, "\n"), F.lit("\n"))


def normalise_documents(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.withColumns({
        "text": normalised_text(F.col(html)), "sha256": F.sha2(F.col(html), 256),
        "byte_size": F.octet_length(html)})
