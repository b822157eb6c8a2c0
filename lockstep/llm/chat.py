"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "[INST]" role "[/INST]" text "</s>"

Neither role nor text may hold a control string.  A conversation is rendered as it stands, the result is
reparsed by the grammar, and the recovered turns are compared with the source.  Where they differ, the
turns that do not survive on their own are escaped and the whole is tried again; what still differs is
escaped in full.  Escaping puts one backslash after the first character of a control string (or of one
that is already escaped), unescaping takes one away, so each undoes the other on any text.  A last
comparison stops the job if a conversation could still not be recovered.

Rendering, parsing and comparing are column expressions.  Positions of turns come from a running sum
over the turns of a conversation, so the loss mask needs no second pass over its text.
"""
from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
#: Control strings, and those with backslashes inside, as a Java pattern.
CONTROL = r"\[/?INST\]|</?s>"
GUARDED = r"([\[<])(\\*)(/?INST\]|/?s>)"
ESCAPED = r"([\[<])\\(\\*)(/?INST\]|/?s>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, GUARDED, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(END))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once: inside a lambda a plain expression would be computed for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse(rendered: Column) -> Column:
    """Turns of a rendered conversation (array of role and text), null where the grammar does not accept it."""
    def turn(pieces, k):
        # Between the end of one turn and the opening of the next there is nothing.
        return F.struct(unescape(F.get(pieces, k * 3 + 1)).alias("role"), unescape(F.get(pieces, k * 3 + 2)).alias("text"))

    def read(marks, pieces):
        turns = (F.size(marks) / 3).cast("int")
        fits = (F.size(marks) == turns * 3) & (F.array_join(marks, "") == F.repeat(F.lit(OPEN + CLOSE + END), turns))
        none = F.array().cast("array<struct<role:string,text:string>>")
        return F.when(fits & (turns == 0), none).when(
            fits, F.transform(F.sequence(F.lit(0), turns - 1), lambda k: turn(pieces, k)))

    both = F.struct(F.regexp_extract_all(rendered, F.lit(f"({CONTROL})"), F.lit(1)).alias("marks"),
                    F.split(rendered, CONTROL).alias("pieces"))
    return _let(both, lambda x: read(x["marks"], x["pieces"]))


def format_conversations(turns: DataFrame, conversation: str = "conv_id", order: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its key, n_turns, formatted, loss_mask (array of start, end over formatted,
    code points, end exclusive: the assistant texts as rendered), escaped_turns.

    Null roles and texts count as empty.  Turns go by ``order``, nulls first; ties by role, then text.
    Repeated rows are turns of their own.  Rows with a null key form one conversation.  An empty table
    gives no rows; other columns are ignored.  A conversation becomes one string, so it has to fit a row.
    """
    given = turns.select(F.col(conversation).alias("c"), F.col(order).alias("o"),
                         F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    alone = F.coalesce(_let(render(F.col("role"), F.col("text")), parse) == F.array(F.struct("role", "text")), F.lit(False))
    given = given.withColumn("conflict", ~alone)
    own = lambda name, guard: F.when(guard, escape(F.col(name))).otherwise(F.col(name))
    # First attempt: as it stands.  Second: turns in conflict escaped.  Third: all turns escaped.
    attempts = [F.lit(False), F.col("conflict"), F.lit(True)]
    for k, guard in enumerate(attempts):
        given = given.withColumn(f"r{k}", own("role", guard)).withColumn(f"t{k}", own("text", guard))
    by = Window.partitionBy("c").orderBy("o", "role", "text")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    for k in range(3):
        size = F.length(render(F.col(f"r{k}"), F.col(f"t{k}")))
        start = (F.coalesce(F.sum(size).over(before), F.lit(0)) + len(OPEN) + F.length(f"r{k}") + len(CLOSE)).cast("long")
        given = given.withColumn(f"s{k}", start)
    fields = ["n", "role", "text", "conflict", *(f"{x}{k}" for k in range(3) for x in "rts")]
    told = (given.withColumn("n", F.row_number().over(by)).groupBy("c")
            .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("turns")))
    source = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    told = told.withColumn("source", source)

    def formatted(k):
        return F.array_join(F.transform("turns", lambda x: render(x[f"r{k}"], x[f"t{k}"])), "")

    def mask(k):
        spoken = F.filter("turns", lambda x: x["role"] == "assistant")
        return F.transform(spoken, lambda x: F.struct(x[f"s{k}"].alias("start"), (x[f"s{k}"] + F.length(x[f"t{k}"])).alias("end")))

    def same(k):
        return F.coalesce(_let(formatted(k), parse) == F.col("source"), F.lit(False))

    failed = F.raise_error(F.concat(F.lit("conversation not recovered: "), F.coalesce(F.col("c").cast("string"), F.lit("null"))))
    level = F.when(same(0), 0).when(same(1), 1).when(same(2), 2).otherwise(failed.cast("int"))
    told = told.withColumn("level", level)
    pick = lambda build: F.when(F.col("level") == 0, build(0)).when(F.col("level") == 1, build(1)).otherwise(build(2))
    return told.select(
        F.col("c").alias(conversation), F.size("turns").cast("long").alias("n_turns"), pick(formatted).alias("formatted"),
        pick(mask).alias("loss_mask"),
        F.when(F.col("level") == 0, F.lit(0)).when(F.col("level") == 1, F.size(F.filter("turns", lambda x: x["conflict"])))
        .otherwise(F.size("turns")).cast("long").alias("escaped_turns"))


def masked_text(formatted: DataFrame) -> DataFrame:
    """Adds loss_chars and loss_sha256: the text under the mask, cut out of the formatted string and unescaped."""
    undo = re.compile(ESCAPED)

    @F.pandas_udf("struct<loss_chars:long,loss_sha256:string>")
    def read(strings: pd.Series, masks: pd.Series) -> pd.DataFrame:
        chars, digests = [], []
        for string, mask in zip(strings, masks, strict=True):
            total, digest = 0, hashlib.sha256()
            for span in mask:
                part = undo.sub(r"\1\2\3", string[span["start"]:span["end"]])
                total += len(part)
                digest.update(part.encode("utf-8", "surrogatepass"))
            chars.append(total)
            digests.append(digest.hexdigest())
        return pd.DataFrame({"loss_chars": chars, "loss_sha256": digests})

    return formatted.withColumn("__loss", read("formatted", "loss_mask")).select("*", "__loss.*").drop("__loss")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns_sha256 over the turns parsed from the formatted string: role, newline, text, newline each."""
    turns = F.transform(parse(F.col("formatted")), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return formatted.withColumn("turns_sha256", F.sha2(F.array_join(turns, ""), 256))
