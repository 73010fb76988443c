"""Indicators that a window expresses. Each adds columns to bars (symbol, ts, open, high, low, close, volume)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import DAY, W, before_n, full, lag, last_n
from ..schema import flag, ratio

C = F.col


def sma(x: Column, n: int) -> Column:
    return full(x, n, F.avg(x))


def wma(x: Column, n: int) -> Column:
    """Mean of the last n with weights 1 to n, the newest heaviest."""
    parts = reduce(lambda a, b: a + b, ((n - k) * (F.lag(x, k).over(W()) if k else x) for k in range(n)))
    return parts / F.lit(n * (n + 1) / 2)


def roc(x: Column, n: int = 12) -> Column:
    return 100 * (ratio(x, lag(x, n)) - 1)


def true_range() -> Column:
    before = lag("close")
    return F.greatest(C("high") - C("low"), F.abs(C("high") - before), F.abs(C("low") - before))


def vwap() -> Column:
    """Mean price of a day so far, by volume."""
    upto = DAY().rowsBetween(Window.unboundedPreceding, 0)
    typical = (C("high") + C("low") + C("close")) / 3
    return ratio(F.sum(typical * C("volume")).over(upto), F.sum("volume").over(upto))


def zscore(x: Column, n: int) -> Column:
    if n < 2:
        raise ValueError("a score needs 2 bars or more")
    return ratio(x - sma(x, n), full(x, n, F.stddev_samp(x)))


def rolling_correlation(a: Column, b: Column, n: int) -> Column:
    """Null where one of the two doesn't change."""
    both = F.when(a.isNotNull() & b.isNotNull(), a)
    # From parts, as corr divides by 0 over a window that doesn't change.
    spread_of = lambda x: F.stddev_samp(x).over(last_n(n))
    return ratio(full(both, n, F.covar_samp(a, b)), spread_of(a) * spread_of(b))


def rolling_beta(a: Column, b: Column, n: int) -> Column:
    return ratio(full(b, n, F.covar_samp(a, b)), full(b, n, F.var_samp(b)))


def spread(a: Column, b: Column, hedge: Column | float = 1.0) -> Column:
    if isinstance(hedge, int | float) and hedge == 0:
        raise ValueError("the hedge ratio is not 0")
    return a - hedge * b


def relative_strength(x: Column, base: Column, n: int = 55) -> Column:
    return ratio(ratio(x, lag(x, n)), ratio(base, lag(base, n))) - 1


def crossover(a: Column, b: Column) -> Column:
    return flag((a > b) & (lag(a) <= lag(b)))


def crossunder(a: Column, b: Column) -> Column:
    return flag((a < b) & (lag(a) >= lag(b)))


def above_threshold(a: Column, level: float) -> Column:
    return flag((a > level) & (lag(a) <= level))


def below_threshold(a: Column, level: float) -> Column:
    return flag((a < level) & (lag(a) >= level))


def with_stochastic(df: DataFrame, k: int = 14, d: int = 3, smooth: int = 3, name: str = "stoch") -> DataFrame:
    low, high = full(C("low"), k, F.min("low")), full(C("high"), k, F.max("high"))
    df = df.withColumn("_raw", 100 * ratio(C("close") - low, high - low))
    df = df.withColumn(f"{name}_k", sma(C("_raw"), smooth) if smooth > 1 else C("_raw"))
    return df.withColumn(f"{name}_d", sma(C(f"{name}_k"), d)).drop("_raw")


def with_cci(df: DataFrame, n: int = 20, name: str = "cci") -> DataFrame:
    """The mean distance from the mean can't be summed up; the window's n prices are gathered in an array."""
    df = df.withColumn("_tp", (C("high") + C("low") + C("close")) / 3).withColumn("_m", sma(C("_tp"), n)).withColumn("_all", F.collect_list("_tp").over(last_n(n)))
    mad = F.aggregate("_all", F.lit(0.0), lambda s, x: s + F.abs(x - C("_m"))) / n
    return df.withColumn(name, ratio(C("_tp") - C("_m"), 0.015 * mad)).drop("_tp", "_m", "_all")


def with_bollinger(df: DataFrame, n: int = 20, k: float = 2.0, x: str = "close", name: str = "bb") -> DataFrame:
    mid, sd = sma(C(x), n), full(C(x), n, F.stddev_samp(x))
    df = df.withColumn(f"{name}_mid", mid).withColumn("_sd", sd)
    df = df.withColumn(f"{name}_upper", C(f"{name}_mid") + k * C("_sd")).withColumn(f"{name}_lower", C(f"{name}_mid") - k * C("_sd")).drop("_sd")
    width = C(f"{name}_upper") - C(f"{name}_lower")
    return df.withColumn(f"{name}_percent_b", ratio(C(x) - C(f"{name}_lower"), width)).withColumn(f"{name}_bandwidth", ratio(width, C(f"{name}_mid")))


def with_obv(df: DataFrame, name: str = "obv") -> DataFrame:
    move = F.coalesce(F.signum(C("close") - lag("close")) * C("volume"), F.lit(0.0))
    return df.withColumn("_m", move).withColumn(name, F.sum("_m").over(W().rowsBetween(Window.unboundedPreceding, 0))).drop("_m")


def with_mansfield(df: DataFrame, base: str = "benchmark_close", n: int = 55, name: str = "mansfield") -> DataFrame:
    df = df.withColumn("_r", ratio(C("close"), C(base)))
    return df.withColumn(name, 100 * (ratio(C("_r"), sma(C("_r"), n)) - 1)).drop("_r")


def with_atr_simple(df: DataFrame, n: int = 14, name: str = "atr_simple") -> DataFrame:
    """Mean true range, the first bar's from its high and low; for prefilters."""
    df = df.withColumn("_tr", true_range())
    return df.withColumn(name, sma(C("_tr"), n)).drop("_tr")


def with_keltner(df: DataFrame, mid: str, atr: str, multiplier: float = 2.0, name: str = "kc") -> DataFrame:
    """Channels around an ema and by an atr that folds have added."""
    return df.withColumn(f"{name}_mid", C(mid)).withColumn(f"{name}_upper", C(mid) + multiplier * C(atr)).withColumn(f"{name}_lower", C(mid) - multiplier * C(atr))


def squeeze(bands: str = "bb", channel: str = "kc") -> Column:
    return flag((C(f"{bands}_upper") < C(f"{channel}_upper")) & (C(f"{bands}_lower") > C(f"{channel}_lower")))


def half_life_inputs(df: DataFrame, x: str) -> DataFrame:
    """(symbol, slope, n): regression of changes on the level before."""
    d = df.withColumn("_before", lag(x)).withColumn("_d", C(x) - C("_before")).where("_d is not null")
    return d.groupBy("symbol").agg(F.regr_slope("_d", "_before").alias("slope"), F.count("*").alias("n"))


def half_life(df: DataFrame, x: str) -> DataFrame:
    """(symbol, half_life): infinite where there is no pull back to the mean or fewer than 30 changes."""
    pull = half_life_inputs(df, x)
    value = F.when((C("n") < 30) | C("slope").isNull() | (C("slope") >= 0), F.lit(float("inf"))).otherwise(-F.ln(F.lit(2.0)) / C("slope"))
    return pull.select("symbol", value.alias("half_life"))


def prior_extremes(n: int) -> tuple[Column, Column]:
    """Highest high and lowest low of the n bars before this one."""
    ok = F.count("close").over(before_n(n)) == n
    return F.when(ok, F.max("high").over(before_n(n))), F.when(ok, F.min("low").over(before_n(n)))


def trail_increment(divisor: float = 5.0) -> Column:
    """By how much a stop is trailed: a part of the body of the bar before; 0 at the first bar."""
    return F.coalesce(F.abs(lag("open") - lag("close")) / divisor, F.lit(0.0))


def relative_strength_rank(bars: DataFrame, n: int = 55) -> DataFrame:
    """(ts, symbol, rs, place): symbols by relative strength at each time, of bars with benchmark_close; those without one are left out."""
    d = bars.select("ts", "symbol", relative_strength(C("close"), C("benchmark_close"), n).alias("rs")).where("rs is not null")
    return d.withColumn("place", F.row_number().over(Window.partitionBy("ts").orderBy(F.desc("rs"), "symbol")))
