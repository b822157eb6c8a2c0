"""First, latest and high of each offering from one provider's bars, in decimal arithmetic."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def market_summary(ipos: DataFrame, securities: DataFrame, prices: DataFrame, provider: str) -> DataFrame:
    """One row per offering with stored bars; ratios are rounded to 10 decimals."""
    exact = "decimal(20,8)"
    bars = (prices.where(F.col("provider") == provider).groupBy("security_id").agg(
        F.min("trade_date").alias("first_trade_date"), F.max("trade_date").alias("latest_trade_date"),
        F.min_by("open", "trade_date").cast(exact).alias("first_day_open"),
        F.min_by("close", "trade_date").cast(exact).alias("first_day_close"),
        F.max_by("close", "trade_date").cast(exact).alias("latest_close"),
        F.max("high").cast(exact).alias("post_ipo_high")))
    owned = summary_scope(ipos, securities)
    price = F.nullif(F.col("ipo_price").cast("decimal(12,4)"), F.lit(0).cast("decimal(12,4)"))

    def relative(value, base):
        return F.round(F.try_divide(F.col(value) - base, base), 10).cast("decimal(20,10)")

    high = F.col("post_ipo_high")
    return owned.join(bars, "security_id").select(
        "ipo_id", "security_id", F.col("latest_trade_date").alias("as_of_date"),
        "first_trade_date", "first_day_open", "first_day_close",
        "latest_trade_date", "latest_close", "post_ipo_high",
        relative("first_day_close", price).alias("first_day_close_return_vs_ipo_price"),
        relative("latest_close", price).alias("return_from_ipo_price"),
        relative("latest_close", high).alias("drawdown_from_post_ipo_high"))


def summary_scope(ipos: DataFrame, securities: DataFrame) -> DataFrame:
    scope = securities.where(F.col("is_primary") & (F.col("source") == "sec_company"))
    return ipos.select("ipo_id", "company_id", "ipo_price").join(
        scope.select("company_id", "security_id"), "company_id")


def summary_report(ipos: DataFrame, securities: DataFrame, prices: DataFrame, provider: str) -> DataFrame:
    done = (prices.where(F.col("provider") == provider).select("security_id").distinct()
            .withColumn("_done", F.lit(True)))
    return summary_scope(ipos, securities).join(done, "security_id", "left").agg(
        F.count(F.lit(1)).alias("ipos_seen"), F.count("_done").alias("summaries_recomputed"),
        F.count_if(F.col("_done").isNull()).alias("no_stored_bars"))
