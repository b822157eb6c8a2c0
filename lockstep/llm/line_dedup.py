"""Line deduplication over range-partitioned line hashes, with keep bitmaps as the result.

Every line becomes a narrow row: 128-bit hash of its key, document and position.  The rows are dealt by
ranges of the hash and sorted by (hash, document from the largest id down, position) inside each range.
One pass over that order streams the occurrences of a key: the first document met holds it, a dense rank
counts the documents, and every later occurrence of a key with enough documents is dropped.

A key with a large share of a sample of the lines would be a range of its own.  There are at most HOT_KEYS
such keys; their documents are counted by an aggregate that combines before its shuffle, and what it
finds, one row a key, is broadcast to their lines.  The sample only decides which of both ways a key
goes; both give the same rows.

What leaves the streams are positions, packed per document as runs of dropped lines, never text.  To cut the
texts, a broadcast sieve of at most MOST_BITS bits names the documents that can have lost something; only
their texts move, to meet their bitmaps.  All others are finished where they are.  Column expressions only.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lockstep.llm.common import fold_ascii, let, stored

BLANKS = " \t\n\x0b\x0c\r"
#: One line in so many is looked at for hot keys; a key is hot from so many sampled lines on, and from the share 1 / HOT_KEYS.
SAMPLE, HOT, HOT_KEYS = 16, 8, 20_000
#: Bits of the sieve: so many a document that loses lines, within these bounds (2 to 16 MB).
BITS, LEAST_BITS, MOST_BITS = 16, 1 << 24, 1 << 27


def key_of(line: Column) -> Column:
    """A line without blanks at both ends and with A-Z lower-cased."""
    return fold_ascii(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    """Lines of a text; null counts as empty, and an empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def pack(positions: Column) -> Column:
    """Ascending positions as a bitmap of runs: 4 bytes of start and 4 of end (exclusive) for each run."""
    four = lambda x: F.lpad(F.hex(x), 8, "0")

    def runs(at):
        # A run starts where the position before is missing, and ends where the next one is.
        starts = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) < x - 1))
        ends = F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) > x + 1))
        return F.zip_with(starts, ends, lambda s, e: F.concat(four(s), four(e + 1)))

    return F.unhex(F.array_join(let(positions, runs), ""))


def unpack(bitmap: Column) -> Column:
    """Runs (array of start, end) of a bitmap; null and empty bitmaps have none."""
    def read(bits):
        number = lambda at: F.conv(F.hex(F.substring(bits, at, F.lit(4))), 16, 10).cast("int")
        return F.transform(F.sequence(F.lit(1), F.length(bits), F.lit(8)), lambda at: F.struct(
            number(at).alias("start"), number(at + 4).alias("end")))

    return F.when(F.length(bitmap) > 0, let(bitmap, read)).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def kept_lines(lines: Column, bitmap: Column) -> Column:
    """The lines outside the runs of a bitmap, in order."""
    def cut(both):
        bounds = F.concat(F.array(F.lit(0)), F.transform(both["runs"], lambda r: r["end"]))
        until = F.concat(F.transform(both["runs"], lambda r: r["start"]), F.array(F.size(both["lines"])))
        return F.flatten(F.zip_with(bounds, until, lambda s, e: F.slice(both["lines"], s + 1, e - s)))

    return let(F.struct(lines.alias("lines"), unpack(bitmap).alias("runs")), cut)


def _named(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows (id, t1, t2, text): rows of equal id and equal text lose the same lines, so (id, t1, t2) names a row."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).alias("id"), text.alias("text")).withColumns(
        {"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit("line"), "text")})


def _occurrences(named: DataFrame, least_chars: int) -> DataFrame:
    rows = named.select("id", "t1", "t2", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    keys = rows.where(F.length("line") >= least_chars).withColumn("key", key_of(F.col("line"))).where(F.length("key") >= least_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("key"), "key").alias("h2"), "id", "t1", "t2", "pos")


def _dropped_hot(rows: DataFrame, least_docs: int) -> DataFrame:
    """Dropped occurrences among hot keys; one row a key is broadcast, HOT_KEYS at most."""
    found = rows.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("holder")).where(F.col("n") >= least_docs)
    found = F.broadcast(found.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "holder"))
    return rows.join(found, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2"))).where(~F.col("id").eqNullSafe(F.col("holder")))


def _dropped_ranges(rows: DataFrame, least_docs: int) -> DataFrame:
    """Dropped occurrences among all other keys, by one stream over each range."""
    by = Window.partitionBy("h1", "h2")
    largest = F.col("id").desc_nulls_last()
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    streams = rows.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", largest, "pos")
    # Both windows read the ranges in the order they are sorted in: no further exchange and no further sort.
    told = (streams.withColumn("nth", F.when(F.col("id").isNotNull(), F.dense_rank().over(by.orderBy(largest))))
            .withColumn("n", F.max("nth").over(whole)))
    return told.where((F.col("n") >= least_docs) & (F.coalesce("nth", F.lit(0)) != 1))


def keep_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """Rows (id, t1, t2, keep_bitmap, n_dropped) of documents that lose lines; t1 and t2 are hashes of the text.

    The bitmap lists the runs of dropped lines; see ``pack``, ``unpack`` and ``kept_lines``.
    """
    # Written once: the sample, the ranges and the hot keys all read these rows.
    rows = stored(_occurrences(_named(docs, id_column, text_column), least_chars))
    seen = rows.where(F.pmod(F.xxhash64("t1", "id", "pos"), F.lit(SAMPLE)) == 0).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    seen = stored(seen.where(F.col("n") >= HOT))
    total = rows.count() / SAMPLE
    hot = F.broadcast(seen.where(F.col("n") > total / HOT_KEYS).select("h1", "h2"))
    cold = _dropped_ranges(rows.join(hot, ["h1", "h2"], "left_anti"), least_docs)
    warm = _dropped_hot(rows.join(hot, ["h1", "h2"], "left_semi"), least_docs)
    names = ["id", "t1", "t2"]
    lost = cold.select(*names, "pos").union(warm.select(*names, "pos")).groupBy(*names).agg(F.array_sort(F.collect_set("pos")).alias("positions"))
    return lost.select(*names, pack(F.col("positions")).alias("keep_bitmap"), F.size("positions").cast("long").alias("n_dropped"))


def _sieved(named: DataFrame, lost: DataFrame) -> DataFrame:
    """named with ``suspected``: true for every row of lost, and for few others unless those are too many for the bits."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS * lost.count()):
        bits *= 2
    at = F.pmod(F.col("t1"), F.lit(bits))
    # Buckets of 2^15 bits: MOST_BITS / 2^15 rows of 4 KB at most.
    sieve = F.broadcast(lost.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("sieve")))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("sieve", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    held = F.getbit(byte, (place % 8).cast("int")) == 1
    return named.join(sieve, F.bitmap_bucket_number(at) == F.col("bucket"), "left").select(
        "id", "t1", "t2", "text", F.coalesce(held, F.lit(False)).alias("suspected"))


def line_dedup(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, id_column: str = "doc_id", text_column: str = "text",
               emit_text: bool = True) -> DataFrame:
    """One row per row of docs: id, n_lines, n_dropped, keep_bitmap, kept_text, kept_sha256.

    Lines end at ``\\n``; a line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased.
    A key of at least ``least_chars`` code points found in at least ``least_docs`` documents loses all its
    lines except in the document with the largest id that holds it; there all of them stay.  Rows that repeat
    an id are one document for counting and for holding.  Rows without an id count for no key and hold none,
    so they lose every line whose key enough documents have.  Null and empty texts are one empty line.  An
    empty table gives no rows; other columns are ignored.  Documents that lose nothing have an empty bitmap.
    """
    lost = stored(keep_bitmaps(docs, least_chars, least_docs, id_column, text_column))
    named = _sieved(_named(docs, id_column, text_column), lost)
    n_lines = (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long").alias("n_lines")

    def told(rows, dropped, bitmap, kept):
        return rows.select(F.col("id").alias(id_column), n_lines, dropped.alias("n_dropped"), bitmap.alias("keep_bitmap"),
                           *([kept.alias("kept_text")] if emit_text else []), F.sha2(kept, 256).alias("kept_sha256"))

    clean = told(named.where("not suspected"), F.lit(0).cast("long"), F.lit(b""), F.col("text"))
    lost = lost.select(F.col("id").alias("lost_id"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), "keep_bitmap", "n_dropped")
    same = F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2"))
    met = named.where("suspected").join(lost, same, "left")
    kept = F.when(F.col("keep_bitmap").isNull(), F.col("text")).otherwise(
        F.array_join(kept_lines(lines_of(F.col("text")), F.col("keep_bitmap")), "\n"))
    return clean.union(told(met, F.coalesce("n_dropped", F.lit(0).cast("long")), F.coalesce("keep_bitmap", F.lit(b"")), kept))
