"""Daily bar files picked up incrementally and merged into the stored bars.

The daily run only asks for what arrived since the last one.  A file source with a
checkpoint remembers that; each micro-batch applies the same key merge as the batch job
to the months it touches and publishes a manifest that names, for every month, the
version that holds it.  Months without news are neither read nor written.

A manifest also records which batch of which stream made it, so a batch that is run
again after a restart is recognised, and one of another checkpoint is not mistaken for it.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lockstep.operators.ingest import merge_bars
from lockstep.sources.filings import parse_daily_bars

RESPONSE = "security_id BIGINT, payload STRING"
MANIFEST = "month STRING, data_version BIGINT, stream STRING, epoch BIGINT"
KEY = ["security_id", "trade_date", "provider"]


def _manifest(spark: SparkSession, root: str, table: str) -> tuple[int, list]:
    """Number and rows of the newest manifest: one row for each month the table has."""
    try:
        kept = spark.read.schema(f"{MANIFEST}, version BIGINT").parquet(f"{root}/{table}/manifest")
        version = kept.agg(F.max("version")).first()[0]
    except AnalysisException:
        return -1, []
    return (-1, []) if version is None else (version, kept.where(F.col("version") == version).collect())


def _published(spark: SparkSession, root: str, table: str, stream: str, epoch: int) -> bool:
    try:
        kept = spark.read.schema(f"{MANIFEST}, version BIGINT").parquet(f"{root}/{table}/manifest")
        return not kept.where((F.col("stream") == stream) & (F.col("epoch") == epoch)).isEmpty()
    except AnalysisException:
        return False


def _months(spark: SparkSession, root: str, table: str, rows: list, months: set | None = None) -> DataFrame | None:
    paths = [f"{root}/{table}/data/version={r['data_version']}/month={r['month']}" for r in rows
             if r["month"] is not None and (months is None or r["month"] in months)]
    return spark.read.option("basePath", f"{root}/{table}/data").parquet(*paths).drop("version", "month") if paths else None


def stored_bars(spark: SparkSession, root: str, table: str = "daily_prices") -> DataFrame | None:
    return _months(spark, root, table, _manifest(spark, root, table)[1])


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The identity Spark gave the stream when its checkpoint was made."""
    return spark.read.json(f"{checkpoint}/metadata").first()["id"]


def ingest_bar_files(spark: SparkSession, incoming: str, root: str, checkpoint: str, *, provider: str,
                     refresh: bool = False, table: str = "daily_prices") -> StreamingQuery:
    """Merge every response file not seen before, then stop.

    Of several bars with one key in a batch the greatest counts, column by column.
    """
    responses = spark.readStream.schema(RESPONSE).json(incoming)

    def apply(batch: DataFrame, epoch: int) -> None:
        stream = _stream_id(spark, checkpoint)
        if _published(spark, root, table, stream, epoch):
            return  # this batch was already published before a restart
        fresh = parse_daily_bars(batch).withColumn("provider", F.lit(provider))
        values = [c for c in fresh.columns if c not in KEY]
        fresh = fresh.groupBy(*KEY).agg(F.max(F.struct(*values)).alias("_bar")).select(*KEY, *[f"_bar.{c}" for c in values])
        month = F.date_format("trade_date", "yyyy-MM")
        version, rows = _manifest(spark, root, table)
        version += 1
        touched = {r[0] for r in fresh.select(month).distinct().collect()}  # months, not rows
        stored = _months(spark, root, table, rows, touched)
        merged = fresh if stored is None else merge_bars(stored, fresh, refresh=refresh)
        merged.withColumn("month", month).write.mode("overwrite").partitionBy("month").parquet(f"{root}/{table}/data/version={version}")
        kept = [(r["month"], r["data_version"], stream, epoch) for r in rows if r["month"] is not None and r["month"] not in touched]
        told = kept + [(m, version, stream, epoch) for m in sorted(touched)] or [(None, version, stream, epoch)]
        spark.createDataFrame(told, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/{table}/manifest/version={version}")

    return (responses.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
