"""Ticks from feed messages, one-minute candles, and what follows from them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schema import FEED

C = F.col


def parse_feed(messages: DataFrame) -> DataFrame:
    """Ticks from (value): JSON feed messages. Ticks without a positive price are left out; unreadable times are null.

    feed_mode: ltpc, full, full_d30 (more than 5 levels) or option_greeks.
    """
    f = messages.select(F.from_json("value", FEED).alias("m")).select(F.explode("m.feeds").alias("instrument_key", "f"))
    market, index = C("f.fullFeed.marketFF"), C("f.fullFeed.indexFF")
    ltpc = F.coalesce(market["ltpc"], index["ltpc"], C("f.ltpc"))
    quotes = market["marketLevel"]["bidAskQuote"]
    depth = F.transform(quotes, lambda q: F.struct(
        F.coalesce(q["bp"], q["bidP"]).alias("bid_price"), F.coalesce(q["bq"], q["bidQ"]).cast("bigint").alias("bid_qty"),
        F.coalesce(q["ap"], q["askP"]).alias("ask_price"), F.coalesce(q["aq"], q["askQ"]).cast("bigint").alias("ask_qty")))
    candles = F.coalesce(market["marketOHLC"]["ohlc"], index["marketOHLC"]["ohlc"])
    mode = F.when(market["optionGreeks"].isNotNull(), "option_greeks").when(F.size(quotes) > 5, "full_d30").when(market.isNotNull() | index.isNotNull(), "full").otherwise("ltpc")
    return f.select(
        "instrument_key", ltpc["ltp"].alias("ltp"), F.timestamp_millis(F.expr("1L") * F.try_to_number(ltpc["ltt"], F.lit("999999999999999")).cast("bigint")).alias("ltt"), ltpc["ltq"].cast("bigint").alias("ltq"), ltpc["cp"].alias("close_price"),
        market["eFeedDetails"]["vtt"].cast("bigint").alias("volume"), market["eFeedDetails"]["oi"].cast("bigint").alias("oi"), depth.alias("depth"),
        F.try_element_at(F.filter(candles, lambda c: c["interval"] == "I1"), F.lit(1)).alias("candle"), market["optionGreeks"].alias("greeks"), mode.alias("feed_mode"),
    ).where("ltp > 0")


def parse_rest(payloads: DataFrame) -> DataFrame:
    """Ticks from (value, received_at): {"data": {key: {last_price, close_price, volume}}}."""
    kind = "data map<string, struct<last_price:double,close_price:double,volume:bigint>>"
    d = payloads.select(F.from_json("value", kind).alias("m"), "received_at").select(F.explode("m.data").alias("instrument_key", "q"), "received_at")
    return d.select("instrument_key", C("q.last_price").alias("ltp"), C("received_at").alias("ltt"), C("q.close_price").alias("close_price"), "q.volume").where("ltp > 0")


def with_depth(ticks: DataFrame, levels: int = 5) -> DataFrame:
    """The ticks of parse_feed() that have a positive price and at least `levels` levels with a bid, with the best bid and ask.

    Adds best_bid, best_ask, spread and imbalance: of the first `levels` levels' quantities the bids' share less the asks'.
    Also for streams, as it looks at one tick at a time.
    """
    top = F.slice(F.filter("depth", lambda x: x["bid_price"].isNotNull()), 1, levels)
    total = lambda c: F.aggregate(C("_top"), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x[c], F.lit(0)))
    d = ticks.withColumn("_top", top).where((C("ltp") > 0) & (F.size("_top") >= levels))
    d = d.withColumns({"best_bid": F.array_max(F.transform("_top", lambda x: x["bid_price"])), "best_ask": F.array_min(F.transform("_top", lambda x: x["ask_price"])), "_bids": total("bid_qty"), "_asks": total("ask_qty")})
    return d.withColumns({"spread": C("best_ask") - C("best_bid"), "imbalance": F.try_divide(C("_bids") - C("_asks"), C("_bids") + C("_asks"))}).drop("_top", "_bids", "_asks")


def is_stale(received_at: Column, seconds: int = 5) -> Column:
    return F.unix_micros(F.current_timestamp()) - F.unix_micros(received_at) > seconds * 1_000_000


def volume_steps(ticks: DataFrame) -> DataFrame:
    """Ticks with volume_step, what they add to the day's volume; a day's first tick adds nothing, a falling count neither.

    For tables. On a stream, stream_candles() takes the steps from the state, and feeds that report each trade's own
    quantity need none: candles() takes it as volume_step.
    """
    w = Window.partitionBy("symbol", F.to_date("ltt")).orderBy("ltt", "volume")
    return ticks.withColumn("volume_step", F.greatest(C("volume") - F.coalesce(F.lag("volume").over(w), C("volume")), F.lit(0)))


def candles(ticks: DataFrame, watermark: str | None = None) -> DataFrame:
    """One-minute bars from ticks (symbol, ltt, ltp, volume_step); of streams, once the watermark has passed the minute."""
    d = ticks.withWatermark("ltt", watermark) if watermark else ticks
    order = F.struct("ltt", "ltp") if "event_id" not in ticks.columns else F.struct("ltt", "event_id")
    g = d.groupBy("symbol", F.window("ltt", "1 minute").alias("w")).agg(
        F.min_by("ltp", order).alias("open"), F.max("ltp").alias("high"), F.min("ltp").alias("low"), F.max_by("ltp", order).alias("close"), F.sum("volume_step").alias("volume")
    )
    return g.select("symbol", C("w.start").alias("ts"), "open", "high", "low", "close", "volume")


class CandleProcessor(StatefulProcessor):
    """Candles of one symbol from a stream of ticks with the day's cumulative volume, emitted by the next minute's first tick.

    late='drop' leaves out ticks of minutes already emitted; late='merge' puts them into the forming candle.
    """

    SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume bigint"

    def __init__(self, late: str = "drop"):
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("candle", "minute long, open double, high double, low double, close double, volume long, last long, day long", ttlDurationMs=3_600_000 * 24)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s = list(self.state.get()) if self.state.exists() else None
        out = []
        for batch in rows:
            for ltt, price, total in sorted(zip(batch["ltt"], batch["ltp"].tolist(), batch["volume"].tolist(), strict=True)):
                minute, day = int(ltt.timestamp()) // 60, int(ltt.timestamp()) // 86400
                step = max(0, int(total) - s[6]) if s and s[7] == day else 0
                if s and minute < s[0] and self.late == "drop":
                    continue
                if s is None or minute > s[0]:
                    if s:
                        out.append((key[0], pd.Timestamp(s[0] * 60, unit="s"), *s[1:6]))
                    s = [minute, price, price, price, price, step, int(total), day]
                else:
                    s = [s[0], s[1], max(s[2], price), min(s[3], price), price, s[5] + step, max(s[6], int(total)), day]
        if s:
            self.state.update(tuple(s))
        yield pd.DataFrame(out, columns=["symbol", "ts", "open", "high", "low", "close", "volume"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        return iter(())

    def close(self) -> None:
        pass


def stream_candles(ticks: DataFrame, late: str = "drop") -> DataFrame:
    """The stream's candles; needs the RocksDB state store."""
    return ticks.groupBy("symbol").transformWithStateInPandas(CandleProcessor(late), CandleProcessor.SCHEMA, "Append", "ProcessingTime")


def distinct_ticks(ticks: DataFrame, watermark: str | None = None) -> DataFrame:
    """One tick for each symbol and time; of streams, among ticks within the watermark, so that state stays bounded."""
    return ticks.withWatermark("ltt", watermark).dropDuplicatesWithinWatermark(["symbol", "ltt"]) if watermark else ticks.dropDuplicates(["symbol", "ltt"])


def write_stream(d: DataFrame, path: str, checkpoint: str, kind: str = "parquet", every: str = "5 seconds"):
    """Chunks by symbol, day and hour; JSON lines with kind='json'."""
    d = d.withColumn("date", F.to_date("ts")).withColumn("hour", F.hour("ts")) if "ts" in d.columns else d.withColumn("date", F.to_date("ltt")).withColumn("hour", F.hour("ltt"))
    return d.writeStream.format(kind).option("compression", "zstd" if kind == "parquet" else "none").option("checkpointLocation", checkpoint).partitionBy("symbol", "date", "hour").trigger(processingTime=every).start(path)


def latest_ticks(ticks: DataFrame) -> DataFrame:
    """(symbol, ltp, ltt): the newest tick of each symbol, for open positions."""
    return ticks.groupBy("symbol").agg(F.max_by("ltp", "ltt").alias("ltp"), F.max("ltt").alias("ltt"))


def paper_account(fills: DataFrame, ticks: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """(symbol, quantity, cash_flow, ltp, value, pnl) from fills (symbol, side, quantity, price, charges) at the newest prices."""
    sign = F.when(C("side") == "BUY", 1).otherwise(-1)
    book = fills.groupBy("symbol").agg(F.sum(sign * C("quantity")).alias("quantity"), F.sum(-sign * C("quantity") * C("price") - C("charges")).alias("cash_flow"))
    d = book.join(latest_ticks(ticks).select("symbol", "ltp"), "symbol", "left").withColumn("value", C("quantity") * C("ltp"))
    return d.withColumn("pnl", C("cash_flow") + F.coalesce("value", F.lit(0.0)))
