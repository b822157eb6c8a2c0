"""Licence recognition by sentences and rules.

Texts are cut where a sentence may begin or end, known licence sentences are looked for from one such cut
to another, and the sequence of identifiers a document has, in order, is matched against rules: a rule
fires when its identifiers occur in that order, others between them allowed, and none of the identifiers
that rule it out occurs anywhere.

A line break, ":" and ";" may end a sentence or stand inside one, so notices on a line of their own are
found as well as sentences wrapped over lines, in comments too.  A blank line, ".", "!" and "?" always end one.

The known sentences are a fixed list, so they travel as a pattern and a broadcast table; only matched
sentences are shuffled, keyed by the document they are in.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- Fixed values: identifier and sentence, normalised as below; rules -------------------------------
SENTENCES = (
    ("apache-notice", "licensed under the apache license version 2 0"),
    ("apache-notice", "licensed under the apache license version 2 0 the license"),
    ("apache-use", "you may not use this file except in compliance with the license"),
    ("apache-copy", "you may obtain a copy of the license at"),
    ("apache-basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "licensed under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit-keep", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-as-is", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("gpl3-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl3-notice", "licensed under the gnu general public license version 3"),
    ("gpl2-notice", "licensed under the gnu general public license version 2"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("lgpl-notice", "licensed under the gnu lesser general public license version 3"),
    ("agpl-notice", "licensed under the gnu affero general public license version 3"),
    ("mpl-notice", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-names", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by-notice", "licensed under cc by 4 0"),
    ("cc-by-sa-notice", "licensed under cc by sa 4 0"),
    ("cc-by-nc-notice", "licensed under cc by nc 4 0"),
    ("cc-by-nd-notice", "licensed under cc by nd 4 0"),
    ("cc0-notice", "licensed under cc0 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("reserved", "all rights reserved"),
)
#: licence, identifiers in order, identifiers that rule it out
RULES = (
    ("Apache-2.0", ("apache-notice",), ()),
    ("Apache-2.0", ("apache-use", "apache-copy", "apache-basis"), ()),
    ("MIT", ("mit-notice",), ()),
    ("MIT", ("mit-grant", "mit-keep", "mit-as-is"), ()),
    ("GPL-3.0", ("gpl3-notice",), ()),
    ("GPL-3.0", ("gpl-free", "gpl-hope"), ()),
    ("GPL-2.0", ("gpl2-notice",), ()),
    ("LGPL-3.0", ("lgpl-notice",), ()),
    ("AGPL-3.0", ("agpl-notice",), ()),
    ("MPL-2.0", ("mpl-notice",), ()),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary"), ("bsd-names",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), ()),
    ("ISC", ("isc-grant",), ()),
    ("CC-BY-4.0", ("cc-by-notice",), ()),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",), ()),
    ("CC-BY-NC-4.0", ("cc-by-nc-notice",), ()),
    ("CC-BY-ND-4.0", ("cc-by-nd-notice",), ()),
    ("CC0-1.0", ("cc0-notice",), ()),
    ("Unlicense", ("unlicense",), ()),
    ("Reserved", ("reserved",), ()),
)
#: Rewriting of a text in lower case with "|" before it, in order: what is left are words, each followed by a blank,
#: by a line feed where a sentence may end or go on, or by "|" where it ends.
CUTS = (
    (r"(?<=[\n|])[^a-z0-9\n]*+(?:dnl|rem)\b", ""),  # comment leaders that are words; all others are no letters or digits
    (r"\n[^a-z0-9|]*\n[^a-z0-9|]*", "|"),  # lines without a word
    (r"\n[^a-z0-9|]+", "\n"),
    (r"(?<=[\n|])(\W{0,3}[a-z0-9]{1,3}\))", "$1\n"),  # 1) and (a) start a list item; 1. is a mark
    (r"\bv\.\s+", "v "),
    (r"(?<![.!?:;])[:;]*+[.!?][.!?:;]*+(?:\s+|$)", "|"),
    (r"(?<![.!?:;])[:;]++(?:\s+|$)", "\n"),
    (r"[^a-z0-9\n|]+", " "),
    (r" ?([\n|]) ?", "$1"),
)
# -----------------------------------------------------------------------------------------------------


def marked(text: Column) -> Column:
    """The words of a text in lower case A-Z and digits, with the places where sentences end, as CUTS says."""
    out = F.concat(F.lit("|"), F.translate(F.lower(text), "|", "_"))
    for pattern, new in CUTS:
        out = F.regexp_replace(out, pattern, new)
    return F.concat(out, F.lit("|"))


def known_sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SENTENCES), "sentence_id string, sentence string")


def _pattern() -> str:
    """Known sentences from one end to another; of those that begin at one place the longest."""
    longest = sorted((s for _, s in SENTENCES), key=len, reverse=True)
    return "[|\n](" + "|".join(s.replace(" ", r"[ \n]++") for s in longest) + r")(?=[|\n])"


def matched_sentences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, at, sentence_id): the known sentences of each text, ``at`` counting them from 0."""
    runs = F.regexp_extract_all(marked(F.col(text_column)), F.lit(_pattern()), F.lit(1))
    cut = docs.select(F.col(id_column), F.posexplode(runs).alias("at", "raw"))
    clean = cut.select(id_column, "at", F.regexp_replace("raw", r"\n+", " ").alias("sentence"))
    return clean.join(F.broadcast(known_sentences(docs.sparkSession)), "sentence").select(id_column, "at", "sentence_id")


def _fires(ids: Column, order: tuple[str, ...], against: tuple[str, ...]) -> Column:
    """One pass over the identifiers: how far in ``order`` one has come."""
    wanted = F.array(*map(F.lit, order), F.lit(""))
    reached = F.aggregate(ids, F.lit(0), lambda k, x: F.when(x == F.get(wanted, k), k + 1).otherwise(k))
    fires = reached == len(order)
    for identifier in against:
        fires = fires & ~F.array_contains(ids, identifier)
    return fires


def find_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, sentence_ids, licenses) for documents with a known sentence; licenses may be empty.

    Null and empty texts have no sentences.  Rows without an id form one document, rows that repeat an
    id are read as one after another.  An empty table gives no rows; other columns are ignored.
    """
    found = matched_sentences(docs.select(id_column, text_column), id_column, text_column).groupBy(id_column).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "sentence_id"))), lambda x: x["sentence_id"]).alias("sentence_ids"))
    fired = F.array(*(F.when(_fires(F.col("sentence_ids"), order, against), F.lit(name)) for name, order, against in RULES))
    return found.withColumn("licenses", F.array_sort(F.array_distinct(F.array_compact(fired))))
