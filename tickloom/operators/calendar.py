"""Trading days as a dimension: weekends and holidays are joined by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def trading_calendar(days: DataFrame, holidays: DataFrame, around: int = 30) -> DataFrame:
    """(day, is_holiday, is_open, next_trading_day, last_trading_day) for every day from `around` days before the first of days (day) to as many after the last.

    holidays: (day). One row per calendar day, however many rows `days` has.
    """
    span = days.agg(F.date_sub(F.min("day"), around).alias("a"), F.date_add(F.max("day"), around).alias("b")).where("a is not null")
    every = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    off = holidays.select("day", F.lit(True).alias("is_holiday")).distinct()
    d = every.join(off, "day", "left").withColumn("is_holiday", F.coalesce("is_holiday", F.lit(False))).withColumn("is_open", ~C("is_holiday") & (F.weekday("day") < 5))
    order = Window.partitionBy().orderBy("day")  # a row per calendar day
    opened = F.when(C("is_open"), C("day"))
    after, before = F.first(opened, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)), F.last(opened, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return d.withColumn("next_trading_day", after).withColumn("last_trading_day", before)


def with_trading_days(df: DataFrame, ts: str, holidays: DataFrame) -> DataFrame:
    """df with is_holiday, is_open, next_trading_day and last_trading_day of the day of `ts`; null times have none."""
    d = df.withColumn("_day", F.to_date(ts))
    calendar = trading_calendar(d.select(C("_day").alias("day")), holidays)
    return d.join(calendar, C("_day") == C("day"), "left").drop("_day", "day")
