"""Windows over a symbol's bars in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def W() -> WindowSpec:  # noqa: N802
    """A symbol's bars in time order."""
    return Window.partitionBy("symbol").orderBy("ts")


def DAY() -> WindowSpec:  # noqa: N802
    """A symbol's bars of one day."""
    return Window.partitionBy("symbol", F.to_date("ts")).orderBy("ts")


def last_n(n: int) -> WindowSpec:
    if n < 1:
        raise ValueError("a window has 1 row or more")
    return W().rowsBetween(-(n - 1), 0)


def before_n(n: int) -> WindowSpec:
    """The n rows before this one."""
    return W().rowsBetween(-n, -1)


def full(x: Column, n: int, value: Column) -> Column:
    """value over the last n rows, null until n of them are not null."""
    return F.when(F.count(x).over(last_n(n)) == n, value.over(last_n(n)))


def lag(x: Column | str, k: int = 1) -> Column:
    return F.lag(x, k).over(W())


def row() -> Column:
    return F.row_number().over(W())


def latest(df: DataFrame, n: int = 1) -> DataFrame:
    """The last n bars of each symbol."""
    down = Window.partitionBy("symbol").orderBy(F.desc("ts"))
    return df.withColumn("_back", F.row_number().over(down)).where(F.col("_back") <= n).drop("_back")


def with_run_length(df: DataFrame, on: Column, name: str) -> DataFrame:
    """How many bars in a row, up to this one, the condition holds."""
    upto = W().rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_on", F.coalesce(on, F.lit(False))).withColumn("_n", row())
    return d.withColumn(name, (F.col("_n") - F.coalesce(F.max(F.when(~F.col("_on"), F.col("_n"))).over(upto), F.lit(0))).cast("int")).drop("_on", "_n")


def with_last_known(df: DataFrame, x: str, k: int, prefix: str) -> DataFrame:
    """The last k non-null values of x up to each bar, newest first, and their row numbers: prefix1, prefix1_at, ..."""
    upto = W().rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_n", row())
    for i in range(1, k + 1):
        seen = F.last(F.when(F.col(x).isNotNull(), F.struct(F.col(x).cast("double").alias("v"), F.col("_n").alias("at"))), ignorenulls=True)
        if i == 1:
            d = d.withColumn("_s1", seen.over(upto))
        else:
            older = F.when(F.col(x).isNotNull(), F.lag(f"_s{i - 1}").over(W()))
            d = d.withColumn(f"_s{i}", F.last(older, ignorenulls=True).over(upto))
        d = d.withColumn(f"{prefix}{i}", F.col(f"_s{i}.v")).withColumn(f"{prefix}{i}_at", F.col(f"_s{i}.at"))
    return d.drop("_n", *(f"_s{i}" for i in range(1, k + 1)))
