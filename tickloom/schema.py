"""Schemas of bars and ticks, and expressions that treat nulls the same everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint, oi bigint"
LEVEL = "struct<price:double,strength:double,level_type:string,source:string,touches:int,last_tested:timestamp_ntz>"
FEED = (
    "feeds map<string, struct<fullFeed:struct<"
    "marketFF:struct<ltpc:struct<ltp:double,ltt:string,ltq:string,cp:double>,marketLevel:struct<bidAskQuote:array<struct<bq:string,bp:double,aq:string,ap:double,bidQ:string,bidP:double,askQ:string,askP:double>>>,"
    "marketOHLC:struct<ohlc:array<struct<interval:string,open:double,high:double,low:double,close:double,volume:string,ts:string>>>,eFeedDetails:struct<vtt:double,atp:double,oi:double>,"
    "optionGreeks:struct<delta:double,theta:double,gamma:double,vega:double,rho:double,iv:double>>,"
    "indexFF:struct<ltpc:struct<ltp:double,ltt:string,ltq:string,cp:double>,marketOHLC:struct<ohlc:array<struct<interval:string,open:double,high:double,low:double,close:double,volume:string,ts:string>>>>>,"
    "ltpc:struct<ltp:double,ltt:string,ltq:string,cp:double>>>"
)


def flag(condition: Column) -> Column:
    """A condition that is false where it is unknown."""
    return F.coalesce(condition, F.lit(False))


def code(condition: Column, value: int = 1) -> Column:
    return F.when(condition, value).otherwise(0).cast("int")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def no_nan(df: DataFrame) -> DataFrame:
    """NaN as null in all floating-point columns."""
    return df.select(*(F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))
