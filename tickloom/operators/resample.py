"""Bars of longer periods."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
_EVERY = re.compile(r"^(\d+)\s*(min|m|h|d|b|w|mo|M|ME)$")


def _day(ts: Column) -> Column:
    return F.to_date(ts)


def business_day(ts: Column) -> Column:
    """The weekday of a time; a weekend's is the Friday before."""
    d, wd = _day(ts), F.weekday(ts)
    return F.date_sub(d, F.greatest(wd - 4, F.lit(0)))


def week_end(ts: Column) -> Column:
    """The Sunday on or after."""
    return F.date_add(_day(ts), 6 - F.weekday(ts))


def bucket(ts: Column, n: int, unit: str) -> Column:
    """Label of a time's period. Periods of minutes and hours start at midnight; weeks and months are named after their last day."""
    if unit in ("min", "h"):
        size = n * (60 if unit == "min" else 3600)
        seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
        return F.timestamp_add("SECOND", (F.floor(seconds / size) * size).cast("int"), F.date_trunc("day", ts)).cast("timestamp_ntz")
    if n == 1:
        return {"d": _day, "b": business_day, "w": week_end, "mo": lambda x: F.last_day(_day(x))}[unit](ts).cast("timestamp_ntz")
    raise ValueError("periods of several days, weeks or months start at each symbol's first bar; see resample")


def parse_every(every: str) -> tuple[int, str]:
    m = _EVERY.match(every)
    if not m:
        raise ValueError(f"not a period: {every!r}")
    return int(m[1]), {"m": "min", "M": "mo", "ME": "mo"}.get(m[2], m[2])


def resample(bars: DataFrame, every: str, market_hours: tuple[str, str] | None = None) -> DataFrame:
    """Bars of `every` ('5min', '1h', '1b' business day, '1w', '1mo', '3b', ...): one aggregation by symbol and period.

    First open, highest high, lowest low, last close, sum of volume, last oi; periods without open or close are left out.
    market_hours restricts bars of minutes and hours.
    """
    n, unit = parse_every(every)
    d = within_hours(bars, *market_hours) if market_hours and unit in ("min", "h") else bars
    if n > 1 and unit not in ("min", "h"):
        one = bucket(C("ts"), 1, unit)
        base = {"d": F.datediff, "b": _weekdays_between, "w": lambda a, b: F.datediff(a, b) / 7, "mo": lambda a, b: F.months_between(F.trunc(a, "month"), F.trunc(b, "month"))}[unit]
        first = Window.partitionBy("symbol")
        d = d.withColumn("_one", one).withColumn("_first", F.min("_one").over(first))
        d = d.withColumn("_k", F.floor(base(C("_one"), C("_first")) / n)).withColumn("_label", F.min("_one").over(Window.partitionBy("symbol", "_k")))
    else:
        d = d.withColumn("_label", bucket(C("ts"), n, unit))
    has_oi = "oi" in bars.columns
    out = d.groupBy("symbol", C("_label").alias("ts_")).agg(
        F.min_by("open", F.when(C("open").isNotNull(), C("ts"))).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", F.when(C("close").isNotNull(), C("ts"))).alias("close"), F.sum("volume").alias("volume"), *([F.max_by("oi", "ts").alias("oi")] if has_oi else []),
    )
    return out.withColumnRenamed("ts_", "ts").where("open is not null and close is not null")


def _weekdays_between(a: Column, b: Column) -> Column:
    """Weekdays from b to a, both weekdays."""
    days = F.datediff(a, b)
    whole = F.floor(days / 7)
    return whole * 5 + F.pmod(F.weekday(a) - F.weekday(b), F.lit(5))


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _seconds(clock: str) -> int:
    h, m, *s = map(int, clock.split(":"))
    return h * 3600 + m * 60 + (s[0] if s else 0)


def within_hours(bars: DataFrame, start: str = "09:15", stop: str = "15:30", inclusive: bool = True) -> DataFrame:
    t = second_of_day(C("ts"))
    return bars.where((t >= _seconds(start)) & (t <= _seconds(stop) if inclusive else t < _seconds(stop)))


def between_dates(bars: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from the start day to the end day, both included."""
    if start:
        bars = bars.where(C("ts") >= F.lit(start).cast("timestamp_ntz"))
    return bars.where(C("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")) if end else bars


def period_start(end: Column, n: int, unit: str) -> Column:
    """The day n days, weeks, months or years before, at the month's last day where there is no such day."""
    unit = unit.rstrip("s")
    if unit in ("day", "week"):
        return F.date_sub(end, n * (7 if unit == "week" else 1))
    return F.add_months(end, -n * {"month": 1, "year": 12}[unit])


def opening_range(bars: DataFrame, start: str = "09:15", stop: str = "09:30", least: int = 10) -> DataFrame:
    """Bars with or_high and or_low of their day, null where fewer than `least` bars lie in the range."""
    day = Window.partitionBy("symbol", F.to_date("ts"))
    t = second_of_day(C("ts"))
    inside = (t >= _seconds(start)) & (t <= _seconds(stop))
    ok = F.count(F.when(inside, 1)).over(day) >= least
    return bars.withColumn("or_high", F.when(ok, F.max(F.when(inside, C("high"))).over(day))).withColumn("or_low", F.when(ok, F.min(F.when(inside, C("low"))).over(day)))
