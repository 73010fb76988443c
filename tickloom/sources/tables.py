"""Bars and ticks from tables of events, orders and line items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_from(df: DataFrame, symbol: Column, ts: Column, price: Column, order: list[Column], by_symbol: bool = False) -> DataFrame:
    """One aggregation: first, highest, lowest and last price, and their number, by symbol and ts.

    by_symbol: rows are dealt by symbol, so that windows over symbols need no second shuffle; for many symbols.
    """
    d = df.select(symbol.cast("string").alias("symbol"), ts.alias("ts"), price.alias("_p"), F.struct(*(x.alias(f"k{i}") for i, x in enumerate(order))).alias("_o"))
    d = d.repartition("symbol") if by_symbol else d
    return d.groupBy("symbol", "ts").agg(
        F.min_by("_p", "_o").alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"), F.max_by("_p", "_o").alias("close"), F.count("*").alias("volume")
    ).withColumn("oi", F.lit(0).cast("bigint"))


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null")
    return bars_from(e, C("event_type"), F.date_trunc("hour", "ts").cast("timestamp_ntz"), C("value").cast("double"), [C("ts"), C("event_id")])


def bars_minutely(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null")
    return bars_from(e, C("event_type"), F.date_trunc("minute", "ts").cast("timestamp_ntz"), C("value").cast("double"), [C("ts"), C("event_id")])


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return bars_from(o, C("o_orderpriority"), F.to_date("o_orderdate").cast("timestamp_ntz"), C("o_totalprice").cast("double"), [C("o_orderkey")])


def bars_wide(spark: SparkSession, sf_dir: str, by_symbol: bool = False) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    price = C("l_extendedprice").cast("double") / C("l_quantity").cast("double")
    return bars_from(x, C("l_suppkey"), F.to_date("l_shipdate").cast("timestamp_ntz"), price, [C("l_orderkey"), C("l_linenumber"), C("l_partkey"), C("l_suppkey")], by_symbol)


def benchmark(bars: DataFrame) -> DataFrame:
    """Mean close over symbols."""
    return bars.groupBy("ts").agg(F.avg("close").alias("benchmark_close"))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ltt, ltp, event_id, volume): volume counts a symbol's ticks of the day so far, as feeds report it."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").where("value is not null").select(C("event_type").alias("symbol"), C("ts").alias("ltt"), C("value").cast("double").alias("ltp"), "event_id")
    return e.withColumn("volume", F.count("*").over(Window.partitionBy("symbol", F.to_date("ltt")).orderBy("ltt", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
