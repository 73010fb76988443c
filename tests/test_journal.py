"""The audit trail, sessions and orders: batches that come again, ranges, the last state; checks of frames and depth."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom.operators import quality
from tickloom.sources import journal
from tickloom.streaming import ticks as tk

AT = dt.datetime(2024, 1, 5, 9, 15)
DAY = dt.timedelta(days=1)


def _at(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, t in df.dtypes if t == "timestamp"})


def _trades(spark, rows):
    return _at(spark.createDataFrame(rows, "symbol string, side string, exit_time timestamp, exit_price double, net_pnl double"))


def test_trail_of_all_kinds(spark, tmp_path):
    path = f"file://{tmp_path}/audit"
    signals = _at(spark.createDataFrame([("a", AT, 1, "UP"), ("a", AT + DAY, 0, ""), ("b", AT + DAY, -1, None)], "symbol string, ts timestamp, signal int, signal_tag string"))
    checks = _at(spark.createDataFrame([(AT, "a", "BUY", "MAX_LOSS", "too much")], "at timestamp, symbol string, action string, result string, reason string"))
    orders = _at(spark.createDataFrame([(AT, "a", "BUY", None), (AT, "b", "SELL", 9.5)], "created_at timestamp, symbol string, action string, limit_price double"))
    fills = _at(spark.createDataFrame([(AT + 2 * DAY, "a", "BUY", 10.0, 0.05)], "at timestamp, symbol string, action string, price double, slippage double"))
    rejected = _at(spark.createDataFrame([(AT, 77, "no funds")], "at timestamp, order_id long, reason string"))
    closed = _trades(spark, [("a", "LONG", AT + 3 * DAY, 11.0, 2.5), ("b", "SHORT", None, 1.0, None)])
    made = {"s": journal.signal_entries(signals, "ema"), "r": journal.risk_entries(checks), "o": journal.order_entries(orders), "f": journal.fill_entries(fills), "x": journal.rejection_entries(rejected), "c": journal.closing_entries(closed)}
    for name, d in [*made.items(), ("o", made["o"])]:  # one batch comes again
        journal.append(d, path, name)
    far = (str(AT - 30 * DAY), str(AT + 30 * DAY))
    got = sorted(tuple(x) for x in journal.between(spark, path, *far).select("at", "event_type", "symbol", "action", "price", "reason", "result").collect())
    assert got == sorted([
        (AT, "SIGNAL", "a", "LONG", 0.0, "Strategy: ema, Reason: UP", "GENERATED"), (AT + DAY, "SIGNAL", "b", "SHORT", 0.0, "Strategy: ema, Reason: ", "GENERATED"),
        (AT, "RISK_CHECK", "a", "BUY", 0.0, "too much", "MAX_LOSS"), (AT, "ORDER_PLACED", "a", "BUY", 0.0, "System logic", "PLACED"), (AT, "ORDER_PLACED", "b", "SELL", 9.5, "System logic", "PLACED"),
        (AT + 2 * DAY, "ORDER_FILLED", "a", "BUY", 10.0, "Slippage: 0.0500", "FILLED"), (AT, "ORDER_REJECTED", "UNKNOWN", "UNKNOWN", 0.0, "Order 77: no funds", "REJECTED"),
        (AT + 3 * DAY, "POSITION_CLOSED", "a", "LONG", 11.0, "PnL: 2.5000", "CLOSED"),
    ])
    assert spark.read.parquet(path).count() == 9  # the trade without a time is kept
    assert journal.between(spark, path, str(AT), str(AT)).count() == 5 and journal.between(spark, path, str(AT), str(AT), "b").count() == 1  # both ends count
    plan = journal.between(spark, path, "2024-01-06 00:00:00", "2024-01-06 23:00:00", "b")._jdf.queryExecution().executedPlan().toString()
    filters = {x.split(": ", 1)[0]: x for x in plan.replace("], ", "]\n").replace("PartitionFilters", "\nPartitionFilters").splitlines()}
    assert "day" in filters["PartitionFilters"] and "symbol" in filters["PushedFilters"] and "at" in filters["PushedFilters"], plan
    journal.export_entries(journal.between(spark, path, *far), f"file://{tmp_path}/csv")
    lines = [x for f in (tmp_path / "csv").glob("*.csv") for x in f.read_text().splitlines()]
    assert "Timestamp,Event,Symbol,Action,Price,Reason,Result" in lines and len(set(lines)) == 9


def test_streamed_trail(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    for n in range(2):
        journal.closing_entries(_trades(spark, [("a", "LONG", AT + n * DAY, 1.0, 1.0)])).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
        assert journal.append_stream(stream, path, f"{tmp_path}/cp", availableNow=True).awaitTermination(100)
    assert journal.between(spark, path, str(AT), str(AT + DAY)).count() == 2


def test_sessions_and_orders_keep_the_last_state(spark, tmp_path):
    ticks = _at(spark.createDataFrame([("a", AT), ("a", AT + dt.timedelta(hours=1)), ("b", AT), (None, AT + DAY), ("a", None)], "symbol string, ltt timestamp"))
    candles = _at(spark.createDataFrame([("a", AT), ("c", AT)], "symbol string, ts timestamp"))
    orders = _at(spark.createDataFrame([("a", AT), ("a", AT + 40 * DAY)], "symbol string, created_at timestamp"))
    stats = journal.session_stats(ticks, candles, orders)
    day = AT.date()
    want = [(day, 3, 3, 2, 1, AT, AT + dt.timedelta(hours=1)), (day + DAY, 0, 1, 0, 0, AT + DAY, AT + DAY), (day + 40 * DAY, 1, 0, 0, 1, None, None)]
    assert [tuple(x) for x in stats.orderBy("day").collect()] == want
    assert journal.session_stats(ticks.limit(0), candles.limit(0), orders.limit(0)).count() == 0
    path = f"file://{tmp_path}/sessions"
    journal.save_sessions(stats, 0, path)
    later = stats.where(F.col("day") == F.lit(day)).withColumn("ticks_received", F.lit(9).cast("long")).withColumn("ended_at", F.lit(AT + dt.timedelta(hours=6)).cast("timestamp_ntz"))
    for _ in range(2):
        journal.save_sessions(later, 1, path)
    assert sorted(x.ticks_received for x in journal.sessions_between(spark, path, "2024-01-01", "2024-01-31").collect()) == [1, 9]
    assert journal.sessions_between(spark, path, "2024-01-01", "2024-12-31").count() == 3
    states = _at(spark.createDataFrame([(1, "a", "BUY", 5, "OPEN", AT, AT), (2, "a", "BUY", 5, "OPEN", AT, AT), (1, "a", "BUY", 5, "FILLED", AT, AT + DAY)], "order_id long, symbol string, action string, quantity long, status string, created_at timestamp, updated_at timestamp"))
    at = f"file://{tmp_path}/orders"
    journal.save_orders(states, 0, at)
    journal.save_orders(states.where("order_id = 2").withColumn("status", F.lit("CANCELLED")).withColumn("updated_at", F.lit(AT + DAY).cast("timestamp_ntz")), 1, at)
    assert sorted((x.order_id, x.status) for x in spark.read.parquet(at).collect()) == [(1, "FILLED"), (2, "CANCELLED")]


def test_frames_and_depth(spark):
    nan = float("nan")
    bars = _at(spark.createDataFrame([("ok", AT, 1.0, None, 1.0, 1.0, 5), ("blank", AT, nan, None, nan, None, None), ("timeless", None, 1.0, 1.0, 1.0, 1.0, 5), ("timeless", AT, None, None, None, None, None)], "symbol string, ts timestamp, open double, high double, low double, close double, volume long"))
    asked = spark.createDataFrame([(x,) for x in ("ok", "blank", "timeless", "gone", "ok")], "symbol string")
    got = {x.symbol: (x.bars, x.is_valid, x.reason) for x in quality.frame_checks(bars, asked).collect()}
    assert got == {"ok": (1, True, None), "blank": (1, False, "blank bar"), "timeless": (2, False, "no time"), "gone": (0, False, "empty")}
    with pytest.raises(ValueError, match="close"):
        quality.frame_checks(bars.drop("close"), asked)
    level = "struct<bid_price:double,bid_qty:bigint,ask_price:double,ask_qty:bigint>"
    five = [(10.0 - i, 3, 11.0 + i, 1) for i in range(5)]
    rows = [("a", 10.5, five), ("short", 10.5, five[:4]), ("holes", 10.5, [*five[:4], (None, None, 15.0, 1)]), ("none", 10.5, None), ("zero", 0.0, five), ("deep", 10.5, [*five, (1.0, 900, 20.0, 1)]), ("empty", 1.0, [(10.0, 0, 11.0, None)] * 5)]
    ticks = spark.createDataFrame(rows, f"instrument_key string, ltp double, depth array<{level}>")
    got = {x.instrument_key: (x.best_bid, x.best_ask, x.spread, x.imbalance) for x in tk.with_depth(ticks).collect()}
    assert got == {"a": (10.0, 11.0, 1.0, 0.5), "deep": (10.0, 11.0, 1.0, 0.5), "empty": (10.0, 11.0, 1.0, None)}
