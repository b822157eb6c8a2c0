"""Stored tables and report sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def read_database(spark: SparkSession, url: str, table: str, *, partition_column: str,
                  lower: int, upper: int, partitions: int, **options) -> DataFrame:
    """An existing database table, read in key ranges by many tasks."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", table)
            .option("partitionColumn", partition_column).option("lowerBound", lower)
            .option("upperBound", upper).option("numPartitions", partitions).options(**options).load())


def write_version(df: DataFrame, root: str, name: str, version: str) -> str:
    """Write a merged table as a new version directory; readers switch by path."""
    path = f"{root}/{name}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_backtest_csv(dataset: DataFrame, columns, path: str) -> None:
    """Backtest rows in canonical column order, ISO dates, LF, header."""
    dataset.select(*columns).write.mode("errorifexists").csv(
        path, header=True, lineSep="\n", dateFormat="yyyy-MM-dd", emptyValue="")


def flat_report(df: DataFrame) -> DataFrame:
    """Encode array, map and struct columns as JSON text so that CSV can hold them."""
    return df.select(*[
        F.to_json(name).alias(name) if kind.startswith(("array", "map", "struct")) else F.col(name)
        for name, kind in df.dtypes])


def write_parity_csv(df: DataFrame, path: str) -> None:
    flat_report(df).write.mode("errorifexists").csv(path, header=True, lineSep="\n")


def json_report(df: DataFrame) -> DataFrame:
    """One JSON document per row; decimals become numbers, dates ISO text, nulls stay."""
    plain = df.select(*[
        F.col(name).cast("double").alias(name) if kind.startswith("decimal") else F.col(name)
        for name, kind in df.dtypes])
    return plain.select(F.to_json(F.struct(*plain.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json_report(df: DataFrame, path: str) -> None:
    json_report(df).write.mode("errorifexists").text(path)


def latest_prices(prices: DataFrame, security_id: int, limit: int) -> DataFrame:
    """Newest ``limit`` bars of one security, oldest first."""
    newest = (prices.where(F.col("security_id") == security_id)
              .orderBy(F.desc("trade_date"), F.desc("provider")).limit(limit))
    return newest.orderBy("trade_date", "provider")
