import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from tickloom.operators import fold as folds
from tickloom.plans.strategies import EmaCrossover, MacdCrossover
from tickloom.sources import tables
from tickloom.streaming import live


@pytest.fixture(autouse=True)
def one_partition(spark):
    """State in one partition: each micro-batch starts a Python worker for each."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


class Feed:
    """A folder that a stream reads, and the query that is run again on what has come since."""

    def __init__(self, spark, path, make, watermark=None):
        self.spark, self.path, self.make, self.watermark, self.n = spark, path, make, watermark, 0

    def add(self, d):
        d.coalesce(1).write.mode("append").parquet(f"{self.path}/in")
        self.schema = d.schema

    def start(self, **trigger):
        s = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 2).parquet(f"{self.path}/in")
        s = s.withWatermark(*self.watermark) if self.watermark else s
        return self.make(s).writeStream.format("parquet").option("path", f"{self.path}/out").outputMode("append").option("checkpointLocation", f"{self.path}/cp").trigger(**trigger).start()

    def run(self):
        assert self.start(availableNow=True).awaitTermination(120)

    def out(self, schema=None):
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(f"{self.path}/out")


def _bars(spark, sf):
    return tables.bars_hourly(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).cache()


def _key(rows, names):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in (r[c] for c in names)) for r in rows)


def test_streamed_signals_are_the_table_s_after_a_restart(spark, sf, tmp_path):
    b = _bars(spark, sf)
    strategy = EmaCrossover()
    feed = Feed(spark, tmp_path, lambda s: live.stream_signals(s, strategy.fold(), keep=7))
    cuts = ["2024-01-01", "2024-01-09", "2024-01-10", "2024-01-20", "2025-01-01"]
    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
        feed.add(b.where(f"ts >= '{x}' and ts < '{y}'"))
        if k == 1:
            feed.add(b.where("ts >= '2024-01-08' and ts < '2024-01-09'").withColumn("close", F.lit(1.0)))  # stale candles
        if k in (1, 3):
            feed.run()  # stops, and starts again from its checkpoint
    names = ["symbol", "ts", "signal", "signal_tag"]
    got, want = _key(feed.out().collect(), names), _key(strategy.signals(b).collect(), names)
    assert got == want and any(x[2] for x in want)


def test_a_symbol_starts_from_its_history(spark, sf, tmp_path):
    b = _bars(spark, sf)
    history, rest = b.where("ts < '2024-01-15'"), b.where("ts >= '2024-01-15'")
    program = MacdCrossover().fold()
    feed = Feed(spark, tmp_path, lambda s: live.stream_signals(s, program, history=history, keep=5))
    feed.add(rest.where("ts < '2024-01-20'"))
    feed.add(rest.where("ts >= '2024-01-20'"))
    feed.run()
    names = ["symbol", "ts", "signal"]
    want = MacdCrossover().signals(b).where("ts >= '2024-01-15'")
    assert _key(feed.out().collect(), names) == _key(want.collect(), names)
    kept = spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "bars").option("flattenCollectionTypes", True).load()
    sizes = {tuple(r): r["count"] for r in kept.groupBy("key").count().collect()}
    assert len(sizes) == b.select("symbol").distinct().count() and set(sizes.values()) == {5}


def test_idle_symbols_are_removed(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    make = lambda rows: spark.createDataFrame([(s, at(h), p, p, p, p, 1) for s, h, p in rows], "symbol string, ts timestamp, open double, high double, low double, close double, volume bigint")
    feed = Feed(spark, tmp_path, lambda s: live.stream_signals(s, folds.ema("close", 2, "e"), keep=3, idle_ms=10 * 3_600_000, mode="EventTime"), ("ts", "0 seconds"))
    for rows in ([("a", 0, 1.0), ("b", 0, 1.0), ("a", 1, 2.0), ("b", 1, 2.0)], [("b", 20, 3.0)], [("a", 22, 5.0), ("b", 22, 5.0), ("a", 23, 6.0)]):
        feed.add(make(rows))
        feed.run()
    got = {(r.symbol, r.ts.hour + 24 * (r.ts.day - 1)): r.e for r in feed.out().collect()}
    assert got[("a", 1)] is not None and got[("a", 22)] is None and got[("a", 23)] is not None  # a was forgotten and began anew
    assert got[("b", 22)] is not None


def _ticks(spark, rows):
    return spark.createDataFrame([(x, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for x, s in rows], "symbol string, ltt timestamp")


def test_silent_symbols_are_told_by_the_watermark(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda s: live.stream_silence(s, 5000, "EventTime"), ("ltt", "0 seconds"))
    for rows in ([("a", 0), ("b", 1), ("a", 3), ("b", 3)], [("b", 20)], [("a", 22), ("b", 22)]):
        feed.add(_ticks(spark, rows))
        feed.run()
    told = [(r.symbol, r.since.second, r.silent) for r in feed.out().where("symbol = 'a'").orderBy("since").collect()]
    assert told == [("a", 3, True), ("a", 22, False)]


def test_silent_symbols_are_told_without_any_tick(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda s: live.stream_silence(s, 3000))
    feed.add(_ticks(spark, [("a", 0), ("a", 3)]))
    q = feed.start(processingTime="500 milliseconds")
    told, until = [], time.time() + 90
    while not told and time.time() < until:
        time.sleep(1)
        told = feed.out(live.SilenceProcessor.SCHEMA).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
    assert [(r.symbol, r.since.second, r.silent) for r in told] == [("a", 3, True)]
    feed.add(_ticks(spark, [("a", 9)]))
    while len(told) < 2 and time.time() < until:
        time.sleep(1)
        told = feed.out().collect()
    q.stop()
    assert [(r.since.second, r.silent) for r in sorted(told)][:2] == [(3, True), (9, False)]
