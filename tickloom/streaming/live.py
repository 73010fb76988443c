"""Strategies on a stream of finished candles, and alerts on symbols that fall silent.

What a strategy knows of a symbol is the state of its fold, kept in the state store with the last bars; each candle moves it on by
the same code that replays bars of tables, so that streamed signals are those of the table.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.fold import Fold
from ..operators.keep import shared_dir

BAR = "ts timestamp, open double, high double, low double, close double, volume long"
_FIELDS = ("ts", "open", "high", "low", "close", "volume")


def _null(x):
    return None if x is None or x is pd.NaT or x != x else x


def _rearm(handle: StatefulProcessorHandle, at: int) -> None:
    """One timer for the key, at `at` milliseconds."""
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(at)


class _Clock:
    """Milliseconds by the watermark, or by the machine. Times of rows come as those of the session's zone."""

    def __init__(self, mode: str, zone: str):
        self.event, self.zone = mode == "EventTime", zone

    def due(self, timers, last, after_ms: int) -> int:
        """after_ms after the newest row, by the watermark, or after now; never at once."""
        now = timers.getCurrentWatermarkInMs() if self.event else timers.getCurrentProcessingTimeInMs()
        base = int(pd.Timestamp(last).tz_localize(self.zone).timestamp() * 1000) if self.event else now
        return max(base + after_ms, now + 1)


class SignalProcessor(StatefulProcessor):
    """One symbol's fold over its candles. State: the fold's (of fixed size), the last `keep` bars, and a timer that clears both after
    `idle_ms` without a candle. Candles that are not newer than the last one are refused; of equal times the last row counts."""

    def __init__(self, program: Fold, keep: int, idle_ms: int | None, clock: _Clock):
        self.program, self.keep, self.idle_ms, self.clock = program, keep, idle_ms, clock
        self.names = [f.name for f in T.StructType.fromDDL(program.outputs)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getListState("bars", BAR)
        self.fold = handle.getValueState("fold", "row long, last timestamp, states binary")

    def _moved(self, rows: pd.DataFrame) -> tuple[pd.DataFrame, dict[str, np.ndarray]]:
        """The new candles in order, and the fold's outputs at them."""
        row, last, states = tuple(self.fold.get()) if self.fold.exists() else (0, None, None)
        states = pickle.loads(bytes(states)) if states is not None else self.program.starts()
        new = rows.drop_duplicates("ts", keep="last").sort_values("ts", kind="stable")
        new = new[new["ts"].notna()]
        new = new if last is None else new[new["ts"] > pd.Timestamp(last)]
        if not len(new):
            return new, {}
        c = {x: pd.to_numeric(new[x]).to_numpy("float64") for x in self.program.inputs} | {"row": np.arange(row + 1, row + len(new) + 1)}
        out = self.program.finish(self.program.replay(states, c))
        self.fold.update((row + len(new), new["ts"].iloc[-1].to_pydatetime(), pickle.dumps(states)))
        if self.keep:
            old = list(self.bars.get()) if self.bars.exists() and len(new) < self.keep else []
            own = [(x.ts.to_pydatetime(), *(_null(getattr(x, c)) if c != "volume" or _null(x.volume) is None else int(x.volume) for c in _FIELDS[1:])) for x in new.itertuples(index=False)]
            self.bars.put([*map(tuple, old), *own][-self.keep :])
        return new, out

    def _armed(self, timers) -> None:
        if self.idle_ms is not None and self.fold.exists():
            _rearm(self.handle, self.clock.due(timers, self.fold.get()[1], self.idle_ms))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        self._moved(initialState)
        self._armed(timerValues)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new, out = self._moved(pd.concat(list(rows), ignore_index=True))  # a symbol's candles of one micro-batch
        self._armed(timerValues)
        if len(new):
            yield pd.DataFrame({"symbol": key[0], "ts": new["ts"].to_numpy(), "close": new["close"].to_numpy(), **{x: out[x] for x in self.names}})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.fold.clear()
        self.bars.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_signals(candles: DataFrame, program: Fold, *, history: DataFrame | None = None, keep: int = 500, idle_ms: int | None = None, mode: str = "ProcessingTime") -> DataFrame:
    """(symbol, ts, close, the fold's outputs) at each finished candle of a stream (symbol, ts timestamp, open, high, low, close, volume).

    program: a strategy's or indicator's fold. history: bars of a table that each symbol starts from, without output, when the
    query first runs. keep: bars of a symbol that its state holds. idle_ms: after so long without a candle, by the machine's
    time or (mode EventTime) by the watermark, a symbol's state is removed, and its next candle is the first. Needs the RocksDB
    state store.
    """
    schema = f"symbol string, ts timestamp, close double, {program.outputs}"
    seed = None
    if history is not None:
        seed = history.select("symbol", *_FIELDS).repartition("symbol").sortWithinPartitions("symbol", "ts").groupBy("symbol")
    mode = mode if idle_ms is not None else "None"  # without timers, no batch runs without candles
    processor = SignalProcessor(program, keep, idle_ms, _Clock(mode, candles.sparkSession.conf.get("spark.sql.session.timeZone")))
    return candles.select("symbol", *_FIELDS).groupBy("symbol").transformWithStateInPandas(processor, schema, "Append", mode, seed)


def replayed(bars: DataFrame, program: Fold, *, chunks: int = 3, keep: int = 0) -> DataFrame:
    """stream_signals() over bars of a table, as a stream of `chunks` files in order of time: what it would have said live.

    Files, state and results are below the shared folder. A symbol's candles of one file meet in one micro-batch, so that
    long tables want many chunks.
    """
    spark, base = bars.sparkSession, f"{shared_dir(bars.sparkSession)}/live-{uuid.uuid4().hex}"
    us = F.unix_micros("ts")
    cuts = bars.select(F.percentile_approx(us, [k / chunks for k in range(1, chunks)], 10_000)).first()[0] if chunks > 1 else []
    for low, high in zip([None, *(cuts or [])], [*(cuts or []), None], strict=True):
        part = bars.where((us > low if low is not None else F.lit(True)) & (us <= high if high is not None else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(f"{base}/in")  # streams read files in the order in which they were made
    session = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        session.conf.set(name, spark.conf.get(name))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = session.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    out = stream_signals(stream, program, keep=keep)
    query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


class SilenceProcessor(StatefulProcessor):
    """A timer for each symbol, put off by each tick; what it tells when it expires, and the next tick after that."""

    SCHEMA = "symbol string, since timestamp, silent boolean"

    def __init__(self, after_ms: int, clock: _Clock):
        self.after_ms, self.clock = after_ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at timestamp, silent boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest, first = None, None
        for part in rows:
            times = part["ltt"].dropna()
            if len(times):
                newest = times.max() if newest is None else max(newest, times.max())
                first = times.min() if first is None else min(first, times.min())
        if newest is None:
            return
        last, silent = tuple(self.last.get()) if self.last.exists() else (None, False)
        newest = newest if last is None else max(newest, pd.Timestamp(last))
        self.last.update((newest.to_pydatetime(), False))
        _rearm(self.handle, self.clock.due(timerValues, newest, self.after_ms))
        if silent:
            yield pd.DataFrame({"symbol": [key[0]], "since": [first], "silent": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.last.exists():
            last, silent = tuple(self.last.get())
            if not silent:
                self.last.update((last, True))
                yield pd.DataFrame({"symbol": [key[0]], "since": [pd.Timestamp(last)], "silent": [True]})

    def close(self) -> None:
        pass


def stream_silence(ticks: DataFrame, after_ms: int = 5000, mode: str = "ProcessingTime") -> DataFrame:
    """(symbol, since, silent): a row when a symbol has had no tick for after_ms, since its last one, and one when it is heard again.

    mode EventTime goes by the watermark of ticks (symbol, ltt): a symbol is silent when others are so much further.
    """
    processor = SilenceProcessor(after_ms, _Clock(mode, ticks.sparkSession.conf.get("spark.sql.session.timeZone")))
    return ticks.select("symbol", "ltt").groupBy("symbol").transformWithStateInPandas(processor, SilenceProcessor.SCHEMA, "Append", mode)
