"""What trading leaves behind: an audit trail and closed trades, to which batches are added, sessions and orders, of which the last state stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import merge_batch, write_table

C = F.col


def _entries(d: DataFrame, at: str, kind: str, action: Column, price: Column, reason: Column, result: Column, symbol: Column | None = None) -> DataFrame:
    return d.select(C(at).cast("timestamp_ntz").alias("at"), F.lit(kind).alias("event_type"), (C("symbol") if symbol is None else symbol).alias("symbol"), action.cast("string").alias("action"), F.coalesce(price.cast("double"), F.lit(0.0)).alias("price"), reason.alias("reason"), result.alias("result"))


def _amount(c: Column) -> Column:
    return F.coalesce(F.round(c, 4).cast("decimal(18,4)").cast("string"), F.lit("unknown"))


def signal_entries(signals: DataFrame, strategy: str) -> DataFrame:
    """Audit entries (at, event_type, symbol, action, price, reason, result) of bars (symbol, ts, signal, signal_tag) that have a signal."""
    d = signals.where("signal <> 0")
    return _entries(d, "ts", "SIGNAL", F.when(C("signal") > 0, "LONG").otherwise("SHORT"), F.lit(0.0), F.concat(F.lit(f"Strategy: {strategy}, Reason: "), F.coalesce("signal_tag", F.lit(""))), F.lit("GENERATED"))


def risk_entries(checks: DataFrame) -> DataFrame:
    """Of checks (at, symbol, action, result, reason)."""
    return _entries(checks, "at", "RISK_CHECK", C("action"), F.lit(0.0), C("reason"), C("result"))


def order_entries(orders: DataFrame) -> DataFrame:
    """Of orders placed (created_at, symbol, action, limit_price, null at market)."""
    return _entries(orders, "created_at", "ORDER_PLACED", C("action"), C("limit_price"), F.lit("System logic"), F.lit("PLACED"))


def fill_entries(fills: DataFrame) -> DataFrame:
    """Of fills (at, symbol, action, price, slippage)."""
    return _entries(fills, "at", "ORDER_FILLED", C("action"), C("price"), F.concat(F.lit("Slippage: "), _amount(C("slippage"))), F.lit("FILLED"))


def rejection_entries(rejected: DataFrame) -> DataFrame:
    """Of rejections (at, order_id, reason), which know no symbol."""
    unknown = F.lit("UNKNOWN")
    return _entries(rejected, "at", "ORDER_REJECTED", unknown, F.lit(0.0), F.concat(F.lit("Order "), C("order_id").cast("string"), F.lit(": "), F.coalesce("reason", F.lit(""))), F.lit("REJECTED"), unknown)


def closing_entries(trades: DataFrame) -> DataFrame:
    """Of closed trades (exit_time, symbol, side, exit_price, net_pnl)."""
    return _entries(trades, "exit_time", "POSITION_CLOSED", C("side"), C("exit_price"), F.concat(F.lit("PnL: "), _amount(C("net_pnl"))), F.lit("CLOSED"))


def append(d: DataFrame, path: str, batch: str, at: str = "at") -> None:
    """Adds a batch of rows with a time to the table at path. A batch that comes again replaces itself, so that nothing is twice.

    Files are ordered by day, symbol and time over all tasks, whatever the number of rows of a day, so that reads for a symbol
    skip row groups. Rows without a time are kept, in a partition of their own that no range finds.
    """
    out = d.withColumn("day", F.to_date(at)).withColumn("batch", F.lit(f"b-{batch}"))
    out = out.repartitionByRange("day", "symbol", at).sortWithinPartitions("day", "symbol", at)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def append_stream(d: DataFrame, path: str, checkpoint: str, at: str = "at", **trigger):
    """A stream added to the table, each micro-batch under its number."""
    return d.writeStream.foreachBatch(lambda rows, n: append(rows, path, str(n), at)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def between(spark: SparkSession, path: str, start: str, end: str, symbol: str | None = None, at: str = "at") -> DataFrame:
    """The rows from the time start to the time end, both included, of one symbol or all; other days are not read."""
    first, last = (F.lit(x).cast("timestamp_ntz") for x in (start, end))
    d = spark.read.parquet(path).where(C("day").cast("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & C(at).cast("timestamp_ntz").between(first, last))
    return (d.where(C("symbol") == symbol) if symbol else d).drop("day", "batch")


def export_entries(entries: DataFrame, path: str) -> None:
    """Audit entries as CSV with a header."""
    names = {"at": "Timestamp", "event_type": "Event", "symbol": "Symbol", "action": "Action", "price": "Price", "reason": "Reason", "result": "Result"}
    write_table(entries.select(*(C(c).alias(n) for c, n in names.items())), path)


def session_stats(ticks: DataFrame, candles: DataFrame, orders: DataFrame) -> DataFrame:
    """(day, symbols, ticks_received, candles_completed, orders_placed, started_at, ended_at) of each day with any of ticks (symbol, ltt),
    candles (symbol, ts) and orders (symbol, created_at).

    Counted by day and symbol first. A session starts with its first tick and ends with its last; both are null without ticks.
    Rows without a time belong to no session.
    """
    kinds = {"ticks": (ticks, "ltt"), "candles": (candles, "ts"), "orders": (orders, "created_at")}
    parts = None
    for kind, (d, at) in kinds.items():
        counts = [F.count_if(F.lit(k == kind)).alias(k) for k in kinds]
        times = [(f(at) if kind == "ticks" else f(F.lit(None))).cast("timestamp_ntz").alias(n) for f, n in ((F.min, "started_at"), (F.max, "ended_at"))]
        part = d.where(C(at).isNotNull()).groupBy(F.to_date(at).alias("day"), "symbol").agg(*counts, *times)
        parts = part if parts is None else parts.unionByName(part)
    each = parts.groupBy("day", "symbol").agg(*(F.sum(k).alias(k) for k in kinds), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"))
    return each.groupBy("day").agg(F.count("symbol").alias("symbols"), F.sum("ticks").alias("ticks_received"), F.sum("candles").alias("candles_completed"), F.sum("orders").alias("orders_placed"), F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"))


def save_sessions(stats: DataFrame, batch_id: int, path: str) -> None:
    """Sessions by day; of one day the one that ended last stays. A batch that comes again changes nothing."""
    merge_batch(stats.withColumn("month", F.date_format("day", "yyyy-MM")), batch_id, path, keys=["month", "day"], newest=["ended_at"], partitions=["month"])


def sessions_between(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """The sessions of the days from start to end."""
    months = C("month").cast("string").between(start[:7], end[:7])
    return spark.read.parquet(path).where(months & C("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).drop("month")


def save_orders(orders: DataFrame, batch_id: int, path: str) -> None:
    """Orders (order_id, symbol, action, quantity, status, created_at, updated_at); of one order_id the state updated last stays."""
    merge_batch(orders.withColumn("day", F.to_date("created_at")), batch_id, path, keys=["day", "order_id"], newest=["updated_at"], partitions=["day"])
