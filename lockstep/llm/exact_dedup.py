"""Exact deduplication as a stateful stream.

Documents arrive as (digest, id, row, locator) records, written once to the shared folder.  A stream
over them keeps one state row per digest in a disk-backed store (RocksDB, checkpointed in the shared
folder) with no expiry: the largest (id, row) seen, where its content lies, and how many arrived.
Later calls with the same root go on from that state.  A hit on a digest is only a candidate: the full
bytes of all rows with a repeated digest are compared, per digest, by least and greatest text, which
combines before the shuffle, so a group of copies of any size costs one text per task.  Groups whose
bytes differ are regrouped by the text itself.

Column expressions only.  State and records are keyed by digest; the records of one huge group of copies
meet its state row in an equi-join, whose hot side Spark splits.
"""
from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lockstep.llm.common import fold_ascii, shared_folder, stored, unused

STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Many small stores: files take the space they use, not what is set aside for them.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _advance(spark: SparkSession, root: str, schema) -> DataFrame:
    """Run the stream over what has arrived since the last call; the state as rows (digest, keep, n)."""
    with _settings(spark, STATE_SETTINGS):
        arrivals = spark.readStream.schema(schema).parquet(f"{root}/arrivals")
        state = arrivals.groupBy("digest").agg(
            F.max(F.struct("id", "row", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))
        (state.writeStream.format("noop").outputMode("update").option("checkpointLocation", f"{root}/state")
         .trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.format("statestore").load(f"{root}/state")
    keep, n = rows.schema["value"].dataType.names
    return rows.select(F.col("key.digest").alias("digest"), F.col(f"value.`{keep}`").alias("keep"), F.col(f"value.`{n}`").alias("n"))


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", root: str | None = None,
                contents: DataFrame | None = None, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row that arrived, dropped ones too: id, digest, keep_id, keep_locator, group_size, kept.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty, and empty texts
    equal each other.  The row with the largest id stays (null is the smallest); of rows that repeat an
    id and a text, the last one written.  Repeated rows count in group_size.  An empty table gives no rows.
    Other columns are ignored.  With a ``root`` of an earlier call, ``docs`` are the new arrivals and
    ``contents`` all documents so far.
    """
    spark = docs.sparkSession
    root = root or shared_folder(spark)

    def read(df):
        text = fold_ascii(F.col(text_column))
        return df.select(F.col(id_column).alias("id"), text.alias("text"), digest(text).alias("digest"))

    located = docs.select(F.col(id_column).alias("id"), digest(fold_ascii(F.col(text_column))).alias("digest"),
                          F.monotonically_increasing_id().alias("row"), F.input_file_name().alias("locator"))
    located.write.mode("append").parquet(f"{root}/arrivals")
    arrivals = spark.read.schema(located.schema).parquet(f"{root}/arrivals")
    state = _advance(spark, root, located.schema)
    grouped = stored(arrivals.select("id", "row", "digest", "locator").join(state, "digest").select(
        "id", "digest", F.col("keep.id").alias("keep_id"), F.col("keep.locator").alias("keep_locator"),
        F.col("n").alias("group_size"),
        ((F.col("row") == F.col("keep.row")) & F.col("id").eqNullSafe(F.col("keep.id"))
         & (F.col("locator") == F.col("keep.locator"))).alias("kept")), f"{root}/grouped/{_count(spark, root)}")

    hits = grouped.where("group_size > 1").select(F.col("id").alias("hit_id"), F.col("digest").alias("hit_digest"))
    texts = read(contents if contents is not None else docs)
    texts = texts.join(hits, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("digest") == F.col("hit_digest")), "left_semi")
    differ = stored(texts.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).where("a <> b").select("digest"))
    if differ.isEmpty():
        return grouped.withColumnRenamed("id", id_column)
    return _regrouped(grouped, texts.join(differ, "digest", "left_semi"), differ).withColumnRenamed("id", id_column)


def _count(spark: SparkSession, root: str) -> int:
    """Calls so far with this root: the number of the stream's last batch."""
    return spark.read.format("state-metadata").load(f"{root}/state").agg(F.max("maxBatchId")).first()[0]


def _regrouped(grouped: DataFrame, texts: DataFrame, differ: DataFrame) -> DataFrame:
    """Rows of digests whose texts differ, grouped by the text itself; all others as they are."""
    own = texts.groupBy("digest", "text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    copies = texts.groupBy("digest", "text", "id").agg(F.count(F.lit(1)).alias("copies"))
    rows = (copies.join(own, ["digest", "text"]).select(
        "id", "digest", "keep_id", F.lit(None).cast("string").alias("keep_locator"), "group_size",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        .withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).drop("copy"))
    return grouped.join(differ, "digest", "left_anti").select(*rows.columns).union(rows)


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    own, kept, mark = (unused(docs, name) for name in ("__id", "__kept", "__digest"))
    stay = exact_dedup(docs, id_column, text_column).where("kept").select(F.col(id_column).alias(own), F.col("digest").alias(kept))
    marked = docs.withColumn(mark, sha256(fold_ascii(F.col(text_column))))
    found = marked.join(stay, F.col(id_column).eqNullSafe(F.col(own)) & (F.col(mark) == F.col(kept)), "left_semi")
    return found.dropDuplicates([id_column, mark]).drop(mark)
