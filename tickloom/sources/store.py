"""The bar store, lists, decoders and sinks."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import clean, upsert

C = F.col
PARTITIONS = ["timeframe", "symbol", "month"]


def write_bars(bars: DataFrame, path: str, timeframe: str) -> None:
    """Adds bars to the store; of bars with one symbol and ts the new ones stay. Only the months that get bars are rewritten."""
    spark = bars.sparkSession
    new = clean(bars).withColumn("timeframe", F.lit(timeframe)).withColumn("month", F.date_format("ts", "yyyy-MM"))
    months = new.select(*PARTITIONS).distinct()
    if _exists(spark, path):
        kept = _stored(spark, path).join(months, PARTITIONS, "left_semi")
        new = upsert(kept, new).select(*new.columns)
    # The partitions that are read are overwritten, so what replaces them is written elsewhere first, by each writer for itself.
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    new.write.parquet(staged)
    _swap(spark.read.schema(new.schema).parquet(staged), path, PARTITIONS, ["symbol", "ts"])
    _delete(spark, staged)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.delete(at, True)


def _swap(new: DataFrame, path: str, partitions: list[str], order: list[str]) -> None:
    """Replaces the partitions that new has rows of."""
    new.repartition(*partitions).sortWithinPartitions(*order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy").partitionBy(*partitions).parquet(path)


def merge_batch(batch: DataFrame, batch_id: int, path: str, *, keys: list[str], newest: list[str], partitions: list[str]) -> None:
    """Merges a micro-batch into the table at path: of rows with equal keys the one with the greatest `newest` stays.

    Only partitions that the batch has rows of are read and replaced; keys hold the partitions' columns, or these follow from
    them. What replaces them is staged under the batch's number first. If the batch comes again, after a failure between
    stage and swap or in the middle of the swap, a stage that is complete is swapped in again, as the partitions may be gone
    by then; once the swap is done, a marker says so, and the batch changes nothing.
    """
    spark = batch.sparkSession
    log = f"{path.rstrip('/')}.batches"
    staged, done = f"{log}/{batch_id}.staged", f"{log}/{batch_id}.done"
    if _exists(spark, done):
        return
    if not _exists(spark, f"{staged}/_SUCCESS"):
        new = batch
        if _exists(spark, path):
            old = spark.read.schema(batch.schema).parquet(path)
            new = old.join(batch.select(*partitions).distinct(), partitions, "left_semi").unionByName(batch)
        rest = [c for c in new.columns if c not in keys]
        order = F.struct(*newest, *(c for c in rest if c not in newest))
        kept = new.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*batch.columns)
        kept.write.mode("overwrite").parquet(staged)
    _swap(spark.read.schema(batch.schema).parquet(staged), path, partitions, keys)
    files, at = _files(spark, done)
    files.create(at, True).close()
    _delete(spark, staged)


def write_merged(d: DataFrame, path: str, checkpoint: str, *, keys: list[str], newest: list[str], partitions: list[str], **trigger):
    """A stream kept as a table without repeats, by merge_batch()."""
    return d.writeStream.foreachBatch(lambda batch, n: merge_batch(batch, n, path, keys=keys, newest=newest, partitions=partitions)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """The store's table, partition columns as text: Spark would take '1d' for a number."""
    schema = spark.read.parquet(path).schema
    return spark.read.schema(T.StructType([T.StructField(f.name, T.StringType()) if f.name in PARTITIONS else f for f in schema])).parquet(path)


def read_bars(spark: SparkSession, path: str, timeframe: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars from the start day to the end day; partitions of other symbols, timeframes and months are not read."""
    d = _stored(spark, path).where(C("timeframe") == timeframe)
    d = d.where(C("symbol").isin(symbols)) if symbols else d
    if start:
        d = d.where((C("month") >= start[:7]) & (C("ts") >= F.lit(start).cast("timestamp_ntz")))
    if end:
        d = d.where((C("month") <= end[:7]) & (C("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")))
    return d.drop("timeframe", "month")


def clear(spark: SparkSession, path: str, timeframe: str | None = None, symbols: list[str] | None = None) -> None:
    """Deletes what the store has of a timeframe (of all, if None) and of symbols (of all, if None)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    pattern = "/".join([f"timeframe={timeframe or '*'}", *([] if symbols is None else ["symbol=*"])])
    wanted = None if symbols is None else set(symbols)
    for found in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, pattern)) or ():
        name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(found.getPath().getName())
        if wanted is None or name.removeprefix("symbol=") in wanted:
            files.delete(found.getPath(), True)


def span(spark: SparkSession, path: str, timeframe: str) -> DataFrame:
    """(symbol, first, last)."""
    return read_bars(spark, path, timeframe).groupBy("symbol").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))


def holes(requests: DataFrame, bars: DataFrame, slack: int = 5) -> DataFrame:
    """(symbol, start, stop): days to fetch so that bars (symbol, ts) cover requests (symbol, start, stop), for all symbols at once.

    Missing days at the head or between bars count from more than `slack` days in a row on, as weekends and holidays have no
    bars; at the tail every day counts. A symbol without bars gets its whole request. Requests of a symbol may overlap and are
    answered each; null or empty ones are left out.
    """
    asked = requests.where("start is not null and stop is not null and start <= stop").select("symbol", C("start").cast("date").alias("start"), C("stop").cast("date").alias("stop")).distinct()
    days = bars.select(C("symbol").alias("_symbol"), F.to_date("ts").alias("day")).distinct()
    within = asked.join(days, (C("symbol") == C("_symbol")) & C("day").between(C("start"), C("stop"))).select("symbol", "start", "stop", "day", F.lit(slack).alias("least"))
    # The day after the request closes the tail.
    points = within.unionByName(asked.select("symbol", "start", "stop", F.date_add("stop", 1).alias("day"), F.lit(0).alias("least")))
    before = F.coalesce(F.lag("day").over(Window.partitionBy("symbol", "start", "stop").orderBy("day")), F.date_sub("start", 1))
    return points.withColumn("before", before).where(F.datediff("day", "before") - 1 > C("least")).select("symbol", F.date_add("before", 1).alias("start"), F.date_sub("day", 1).alias("stop"))


def missing_ranges(first: dt.date | None, last: dt.date | None, start: dt.date, end: dt.date, slack: int = 5) -> list[tuple[dt.date, dt.date]]:
    """What to fetch so that the store covers start to end: all, a head more than `slack` days long, a tail."""
    if first is None or last is None:
        return [(start, end)]
    head = [(start, first - dt.timedelta(days=1))] if (first - start).days > slack else []
    return head + ([(last + dt.timedelta(days=1), end)] if last < end else [])


def chunks(start: dt.date, end: dt.date, days: int) -> list[tuple[dt.date, dt.date]]:
    """Ranges of at most `days` days."""
    out = []
    while start <= end:
        stop = min(end, start + dt.timedelta(days=days - 1))
        out.append((start, stop))
        start = stop + dt.timedelta(days=1)
    return out


def is_current(last: dt.datetime, now: dt.datetime, minute: bool, close: dt.time = dt.time(15, 35)) -> bool:
    """Whether the store has the last weekday; of minutes only once the day is over."""
    day = now.date() if not minute or now.time() >= close else now.date() - dt.timedelta(days=1)
    while day.weekday() > 4:
        day -= dt.timedelta(days=1)
    return last.date() >= day


def decode_candles(df: DataFrame, zone: str = "Asia/Kolkata") -> DataFrame:
    """Bars from (symbol, payload): JSON arrays of [time with offset, open, high, low, close, volume, oi]."""
    rows = df.select("symbol", F.explode(F.from_json("payload", "array<array<string>>")).alias("r"))
    at = lambda i, t: F.get("r", F.lit(i)).cast(t)
    ts = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_utc_timestamp(F.to_timestamp(F.get("r", F.lit(0))), F.current_timezone()).cast("timestamp_ntz"))
    return rows.select("symbol", ts.alias("ts"), *(at(i + 1, "double").alias(c) for i, c in enumerate(("open", "high", "low", "close"))), at(5, "bigint").alias("volume"), F.coalesce(at(6, "bigint"), F.lit(0)).alias("oi"))


def watchlist(df: DataFrame) -> DataFrame:
    """Distinct symbols of a list, trimmed and in upper case: its column `symbol`, or the array `symbols`, or else its first column."""
    c = F.explode("symbols") if "symbols" in df.columns else C("symbol" if "symbol" in df.columns else df.columns[0])
    return df.select(c.alias("s")).select(F.upper(F.trim("s")).alias("symbol")).where("symbol <> ''").distinct()


def exchange_symbol(symbol, exchange: str):
    """With the exchange's ending, in place of another."""
    return F.concat(F.regexp_replace(symbol, r"\.(NS|BO)$", ""), F.lit({"NSE": ".NS", "BSE": ".BO"}[exchange]))


def write_table(df: DataFrame, path: str, kind: str = "csv") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)
