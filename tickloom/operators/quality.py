"""Checks of bars, and cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import flag, no_nan
from .windows import W, before_n, lag

C = F.col
PRICES = ("open", "high", "low", "close")
LOOK_AHEAD = frozenset({"next_open", "next_close", "future_return", "target"})


def enforce_schema(df: DataFrame) -> DataFrame:
    """symbol, ts, prices as double, volume and oi as bigint, oi 0 where missing; other columns stay."""
    d = no_nan(df)
    if "oi" not in d.columns:
        d = d.withColumn("oi", F.lit(0))
    missing = {"symbol", "ts", *PRICES, "volume"} - set(d.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    casts = {"symbol": "string", "ts": "timestamp_ntz", **dict.fromkeys(PRICES, "double"), "volume": "bigint", "oi": "bigint"}
    d = d.select(*(F.expr(f"try_cast(`{c}` as {casts[c]})").alias(c) if c in casts else F.col(c) for c in d.columns))
    return d.withColumn("oi", F.coalesce("oi", F.lit(0)))


def keep_last(df: DataFrame, *order: str) -> DataFrame:
    """Of rows with one symbol and ts, the last in `order`."""
    w = Window.partitionBy("symbol", "ts").orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both together; where they have the same bar, the new one."""
    both = old.withColumn("_load", F.lit(0)).unionByName(new.withColumn("_load", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, "_load", *(c for c in ("close", "volume") if c in both.columns)).drop("_load")


def clean(df: DataFrame) -> DataFrame:
    """Rows with all prices, one for each symbol and ts."""
    return keep_last(enforce_schema(df).dropna(subset=["symbol", "ts", *PRICES]), "volume", "close", "high", "low", "open")


def reject_look_ahead(df: DataFrame) -> None:
    found = LOOK_AHEAD & set(df.columns)
    if found:
        raise ValueError(f"columns look ahead: {sorted(found)}")


def frame_checks(bars: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, bars, is_valid, reason) for each of symbols (symbol): whether there are bars to work with.

    reason is null, or the first that holds of: empty, no time (a bar without ts), blank bar (one without any price and volume;
    NaN counts as null). A missing column is an error.
    """
    missing = {"symbol", "ts", *PRICES, "volume"} - set(bars.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    blank = F.coalesce(*(C(c).cast("double") for c in (*PRICES, "volume"))).isNull()
    found = no_nan(bars).groupBy("symbol").agg(F.count("*").alias("_bars"), F.count_if(C("ts").isNull()).alias("_timeless"), F.count_if(blank).alias("_blank"))
    d = symbols.select("symbol").distinct().join(found, "symbol", "left")
    reason = F.when(C("_bars").isNull(), "empty").when(C("_timeless") > 0, "no time").when(C("_blank") > 0, "blank bar")
    return d.select("symbol", F.coalesce("_bars", F.lit(0)).cast("bigint").alias("bars"), reason.isNull().alias("is_valid"), reason.alias("reason"))


def quality_report(bars: DataFrame, spike: float = 10.0) -> DataFrame:
    """Per symbol: bars and how many break each rule. Gaps are counted within a day, over 2 minutes, and between days in weekdays."""
    o, h, lo, c = (C(x) for x in PRICES)
    median = F.when(F.count("volume").over(before_n(20)) >= 10, F.percentile("volume", F.lit(0.5)).over(before_n(20)))
    d = bars.withColumn("_m", median).withColumn("_before", lag("ts")).withColumn("_n", F.count("*").over(Window.partitionBy("symbol", "ts")))
    minutes = (F.unix_micros(C("ts").cast("timestamp")) - F.unix_micros(C("_before").cast("timestamp"))) / 60e6
    same_day = F.to_date("ts") == F.to_date("_before")
    return d.groupBy("symbol").agg(
        F.count("*").alias("bars"), F.count_if(flag(h < F.greatest(o, c, lo))).alias("bad_high"), F.count_if(flag(lo > F.least(o, c, h))).alias("bad_low"),
        F.count_if(flag(F.least(o, h, lo, c) < 0)).alias("negative"), F.count_if(flag(c == 0)).alias("zero_close"), F.count_if(C("_n") > 1).alias("duplicates"),
        F.count_if(flag(C("volume") == 0)).alias("zero_volume"), F.count_if(flag(C("volume") > spike * C("_m"))).alias("volume_spikes"),
        F.count_if(flag(same_day & (minutes > 2))).alias("minute_gaps"), F.count_if(F.isnull("close")).alias("null_close"),
    )


def missing_weekdays(bars: DataFrame) -> DataFrame:
    """(symbol, day): weekdays between a symbol's first and last day that have no bar."""
    days = bars.select("symbol", F.to_date("ts").alias("day")).distinct()
    span = days.groupBy("symbol").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    due = span.select("symbol", F.explode(F.sequence("a", "b")).alias("day")).where(F.weekday("day") < 5)
    return due.join(days, ["symbol", "day"], "left_anti")


def prefilter(bars: DataFrame, min_bars: int = 0, min_price: float = 0, max_price: float = 0, min_volume: float = 0, min_atr_pct: float = 0) -> DataFrame:
    """Symbols whose last bar passes; 0 turns a bound off. The average range is a simple mean of 14 true ranges."""
    before = F.coalesce(lag("close"), C("close"))
    tr = F.greatest(C("high") - C("low"), F.abs(C("high") - before), F.abs(C("low") - before))
    d = bars.withColumn("_tr", tr).withColumn("_atr", F.avg("_tr").over(W().rowsBetween(-13, 0))).withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).withColumn("_n", F.count("*").over(Window.partitionBy("symbol")))
    ok = C("_n") >= min_bars
    for bound, test in ((min_price, C("close") >= min_price), (max_price, C("close") <= max_price), (min_volume, C("volume") >= min_volume), (min_atr_pct, F.try_divide(C("_atr") * 100, C("close")) >= min_atr_pct)):
        ok = ok & flag(test) if bound else ok
    return d.where(C("_k") == 1).where(ok).select("symbol")
