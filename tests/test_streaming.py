import datetime as dt
import json
import time

from tickloom.streaming import ticks as tk


def test_feed_messages(spark):
    full = {"ltpc": {"ltp": 10.5, "ltt": "1704100500000", "ltq": "5", "cp": 10.0}, "marketLevel": {"bidAskQuote": [{"bq": "7", "bp": 10.4, "aq": "8", "ap": 10.6}] * 6}, "marketOHLC": {"ohlc": [{"interval": "1d", "open": 1.0}, {"interval": "I1", "open": 2.0}]}, "eFeedDetails": {"vtt": 900, "atp": 10.2, "oi": 3}}
    messages = [json.dumps({"feeds": {"A": {"fullFeed": {"marketFF": full}}, "B": {"ltpc": {"ltp": 3.0, "ltt": "x"}}, "C": {"ltpc": {"ltp": 0.0}}}}), "[]", "nonsense"]
    got = {r.instrument_key: r for r in tk.parse_feed(spark.createDataFrame([(m,) for m in messages], "value string")).collect()}
    assert set(got) == {"A", "B"} and got["A"].feed_mode == "full_d30" and got["A"].volume == 900 and got["A"].candle.open == 2.0 and got["A"].depth[0].bid_qty == 7
    assert got["B"].ltt is None and got["B"].feed_mode == "ltpc"


def _ticks(spark):
    at = lambda m, s: dt.datetime(2024, 1, 1, 10, m, s)
    rows = [("a", at(0, 1), 10.0, 100), ("a", at(0, 30), 12.0, 130), ("a", at(1, 5), 11.0, 150), ("a", at(2, 0), 9.0, 150), ("b", at(0, 2), 5.0, 10), ("b", at(3, 2), 6.0, 30)]
    return spark.createDataFrame(rows, "symbol string, ltt timestamp, ltp double, volume bigint")


def test_a_stream_gives_the_batch_s_candles(spark, tmp_path):
    t = _ticks(spark)
    batch = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in tk.candles(tk.volume_steps(t)).collect()}
    t.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in")
    q = tk.stream_candles(stream).writeStream.format("memory").queryName("made").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    until = time.time() + 60  # with timers of the machine's time, batches go on without ticks
    while spark.table("made").count() < len(batch) - 2 and time.time() < until:
        time.sleep(0.5)
    q.stop()
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("made").collect()}
    assert got and all(batch[k] == v for k, v in got.items())
    assert len(got) == len(batch) - 2  # the forming candle of each symbol


def test_event_time_stream(spark, tmp_path):
    t = tk.volume_steps(_ticks(spark))
    t.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in")
    q = tk.candles(stream, "0 seconds").writeStream.format("memory").queryName("timed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in spark.table("timed").collect()}
    want = {(r.symbol, r.ts): (r.open, r.high, r.low, r.close, r.volume) for r in tk.candles(t).collect()}
    assert got == {k: v for k, v in want.items() if k[1] < dt.datetime(2024, 1, 1, 10, 3)}  # the watermark has passed all minutes but the last


def test_a_stream_of_ticks_without_repeats(spark, tmp_path):
    t = _ticks(spark)
    t.unionByName(t).repartition(1).write.parquet(f"{tmp_path}/in")
    stream = tk.distinct_ticks(spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in"), "1 hour")
    q = stream.writeStream.format("memory").queryName("once").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(spark.table("once").collect()) == sorted(t.collect())


def test_paper_account(spark):
    fills = spark.createDataFrame([("a", "BUY", 10, 8.0, 1.0), ("a", "SELL", 4, 9.0, 1.0)], "symbol string, side string, quantity int, price double, charges double")
    r = tk.paper_account(fills, _ticks(spark)).first()
    assert (r.quantity, r.ltp, r.value) == (6, 9.0, 54.0) and abs(r.pnl - (-80 - 1 + 36 - 1 + 54)) < 1e-9
