"""Strategies: bars to signals (+1, -1, 0) with a tag, stop, target and confidence.

Each is conditions for entry and exit, put through a state machine; a strategy is a class of parameters, so that a search can
vary them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import indicators as ind
from ..operators import fold as folds
from ..operators.resample import opening_range, second_of_day
from ..operators.windows import DAY
from ..schema import flag

C = F.col


_OUT = "signal{0} int, signal_tag{0} string, stop_loss{0} double, take_profit{0} double, confidence{0} double"
Conditions = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def finish(d: DataFrame, columns: list[str], tag_long: str, tag_short: str, stop: Column, target_pct: float = 0) -> DataFrame:
    """Signal columns of bars with signal, for strategies that are windows alone."""
    s, side = C("signal").cast("int"), C("signal").cast("double")
    target = F.when(s != 0, C("close") * (1 + side * target_pct / 100)) if target_pct else F.lit(None).cast("double")
    return d.select(
        *columns, s.alias("signal"), F.when(s == 1, tag_long).when(s == -1, tag_short).otherwise("").alias("signal_tag"),
        F.when(s != 0, stop).alias("stop_loss"), target.alias("take_profit"), F.when(s != 0, 1.0).otherwise(0.0).alias("confidence"),
    )


def signal_fold(
    parts: list[folds.Fold], events: Callable[[folds.Columns], Conditions], extra: tuple[str, ...], *, warmup: int, tags: tuple[str, str], lagged: tuple[str, ...] = (), levels: tuple[folds.Level, ...] = (),
    stop: str | None = None, confidence: Callable[[folds.Columns, np.ndarray], np.ndarray] | None = None, stop_pct: float = 0, target_pct: float = 0, suffix: str = "",
) -> folds.Fold:
    """A strategy as one fold: parts, their outputs `lagged` one row before (<name>.lag_1), `levels`, then the position and the signal's columns.

    events() gives long entry, short entry, long exit and short exit from the parts' outputs and the columns `extra`, close
    among them. stop: the column that holds the stop, else stop_pct of the close. confidence: 1 where not given. Signals of the
    first `warmup` bars are cleared after the position has seen them.
    """
    before = folds.Level({f"{x}.lag": folds.Lag() for x in lagged}, lambda c: {f"{x}.lag": (c[x],) for x in lagged})
    machine = folds.Level({"side": folds.Machine()}, lambda c: {"side": (folds.positions(*events(c)),)})

    def signal(c: folds.Columns) -> folds.Columns:
        s = np.where(c["row"] > warmup, np.sign(c["side"] - c["side_before"]), 0)
        at = c[stop] if stop else c["close"] * (1 - s * stop_pct / 100) if stop_pct else np.full(len(s), np.nan)
        target = c["close"] * (1 + s * target_pct / 100) if target_pct else np.full(len(s), np.nan)
        sure = confidence(c, s) if confidence else np.ones(len(s))
        tag = np.where(s > 0, tags[0], np.where(s < 0, tags[1], ""))
        return {f"signal{suffix}": s, f"signal_tag{suffix}": tag, f"stop_loss{suffix}": np.where(s != 0, at, np.nan), f"take_profit{suffix}": np.where(s != 0, target, np.nan), f"confidence{suffix}": np.where(s != 0, sure, 0.0)}

    return folds.chain(parts, [*([before] if lagged else []), *levels, machine], signal, _OUT.format(suffix), extra)


def by_mode(up: np.ndarray, down: np.ndarray, mode: str) -> Conditions:
    """Entries and exits on two events: reversal, long only or short only."""
    never = np.zeros(len(up), bool)
    return {"long_short": (up, down, never, never), "long_only": (up, never, down, never), "short_only": (never, down, never, up)}[mode]


def crossing(a: np.ndarray, before_a: np.ndarray, b: np.ndarray | float, before_b: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """Whether a first value crosses above, or below, a second one; never where one of the four is missing."""
    return (a > b) & (before_a <= before_b), (a < b) & (before_a >= before_b)


class Strategy:
    """signals() is prepared(), which adds columns by windows, and then fold(), so that bars are dealt and sorted once."""

    def prepared(self, bars: DataFrame) -> DataFrame:
        return bars

    def fold(self, suffix: str = "") -> folds.Fold:
        raise NotImplementedError

    def signals(self, bars: DataFrame) -> DataFrame:
        d = folds.fold(self.prepared(bars), self.fold())
        return d.select(*bars.columns, *(f.name for f in T.StructType.fromDDL(_OUT.format(""))))

    @classmethod
    def schema(cls) -> dict[str, tuple[str, object]]:
        """Parameters with type and default."""
        return {f.name: (str(f.type), f.default) for f in fields(cls)}

    @classmethod
    def of(cls, **params) -> Strategy:
        """From values that may be strings."""
        known = {f.name: f for f in fields(cls)}
        if unknown := set(params) - set(known):
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return cls(**{k: type(known[k].default)(v) for k, v in params.items()})


@dataclass(frozen=True)
class EmaCrossover(Strategy):
    fast: int = 10
    slow: int = 21
    mode: str = "long_short"
    stop_pct: float = 0.0
    target_pct: float = 0.0

    def fold(self, suffix: str = "") -> folds.Fold:
        def events(c: folds.Columns) -> Conditions:
            return by_mode(*crossing(c["a"], c["a.lag_1"], c["b"], c["b.lag_1"]), self.mode)

        parts = [folds.ema("close", self.fast, "a"), folds.ema("close", self.slow, "b")]
        return signal_fold(parts, events, ("close",), lagged=("a", "b"), warmup=self.slow, tags=("EMA_UP", "EMA_DOWN"), stop_pct=self.stop_pct, target_pct=self.target_pct, suffix=suffix)


@dataclass(frozen=True)
class MacdCrossover(Strategy):
    fast: int = 12
    slow: int = 26
    signal: int = 9
    mode: str = "long_short"
    stop_pct: float = 0.0
    target_pct: float = 0.0

    def fold(self, suffix: str = "") -> folds.Fold:
        def events(c: folds.Columns) -> Conditions:
            return by_mode(*crossing(c["m_line"], c["m_line.lag_1"], c["m_signal"], c["m_signal.lag_1"]), self.mode)

        parts = [folds.macd("close", self.fast, self.slow, self.signal, "m")]
        return signal_fold(parts, events, ("close",), lagged=("m_line", "m_signal"), warmup=self.slow + self.signal, tags=("MACD_UP", "MACD_DOWN"), stop_pct=self.stop_pct, target_pct=self.target_pct, suffix=suffix)


@dataclass(frozen=True)
class RsiReversion(Strategy):
    period: int = 14
    oversold: float = 30.0
    overbought: float = 70.0
    exit_at_midline: bool = False
    mode: str = "long_short"
    stop_pct: float = 0.0
    target_pct: float = 0.0

    def fold(self, suffix: str = "") -> folds.Fold:
        def events(c: folds.Columns) -> Conditions:
            cross = lambda level: crossing(c["r"], c["r.lag_1"], level, level)
            sold, bought, never = cross(self.oversold)[1], cross(self.overbought)[0], np.zeros(len(c["r"]), bool)
            out = cross(50.0) if self.exit_at_midline else (bought, sold)
            return sold if self.mode != "short_only" else never, bought if self.mode != "long_only" else never, *out

        def far(c: folds.Columns, s: np.ndarray) -> np.ndarray:
            return np.clip(np.where(s > 0, (self.oversold - c["r"]) / self.oversold, (c["r"] - self.overbought) / (100 - self.overbought)), 0.0, 1.0)

        parts = [folds.rsi("close", self.period, "r")]
        return signal_fold(parts, events, ("close",), lagged=("r",), confidence=far, warmup=self.period + 1, tags=("RSI_LOW", "RSI_HIGH"), stop_pct=self.stop_pct, target_pct=self.target_pct, suffix=suffix)


@dataclass(frozen=True)
class BollingerSqueeze(Strategy):
    period: int = 20
    std: float = 2.0
    atr_period: int = 20
    multiplier: float = 1.5
    stop_pct: float = 0.0
    target_pct: float = 0.0

    def prepared(self, bars: DataFrame) -> DataFrame:
        return ind.with_bollinger(bars, self.period, self.std)

    def fold(self, suffix: str = "") -> folds.Fold:
        def tight(c: folds.Columns) -> np.ndarray:
            return (c["bb_upper"] < c["e"] + self.multiplier * c["a"]) & (c["bb_lower"] > c["e"] - self.multiplier * c["a"])

        def length(c: folds.Columns) -> dict[str, tuple]:
            on = tight(c).astype("float64")
            return {"run": (on, on)}  # one more while it lasts

        def events(c: folds.Columns) -> Conditions:
            freed = (c["run_1"] > 0) & ~tight(c)
            return freed & (c["close"] > c["bb_upper"]), freed & (c["close"] < c["bb_lower"]), c["close"] < c["bb_mid"], c["close"] > c["bb_mid"]

        parts = [folds.ema("close", self.period, "e"), folds.atr(self.atr_period, "a")]
        return signal_fold(
            parts, events, ("bb_mid", "bb_upper", "bb_lower", "close"), levels=(folds.Level({"run": folds.Affine()}, length),), stop=None if self.stop_pct else "bb_mid", confidence=lambda c, s: np.minimum(c["run_1"] / 10, 1.0),
            warmup=self.period, tags=("SQUEEZE_UP", "SQUEEZE_DOWN"), stop_pct=self.stop_pct, target_pct=self.target_pct, suffix=suffix,
        )


@dataclass(frozen=True)
class SupertrendFlip(Strategy):
    period: int = 10
    multiplier: float = 3.0
    mode: str = "long_short"
    target_pct: float = 0.0

    def fold(self, suffix: str = "") -> folds.Fold:
        parts = [folds.supertrend(self.period, self.multiplier, "t")]
        return signal_fold(parts, lambda c: by_mode(c["t_buy"], c["t_sell"], self.mode), ("close",), stop="t", warmup=self.period, tags=("TREND_UP", "TREND_DOWN"), target_pct=self.target_pct, suffix=suffix)


@dataclass(frozen=True)
class StrengthRsiTrend(Strategy):
    """Long while relative strength, RSI and supertrend agree; needs benchmark_close."""

    rs_period: int = 55
    rsi_period: int = 14
    rsi_level: float = 50.0
    period: int = 10
    multiplier: float = 3.0
    enter: int = 3
    leave: int = 2
    stop_pct: float = 0.0
    target_pct: float = 0.0

    def prepared(self, bars: DataFrame) -> DataFrame:
        return bars.withColumn("_rs", ind.relative_strength(C("close"), C("benchmark_close"), self.rs_period))

    def fold(self, suffix: str = "") -> folds.Fold:
        def agree(c: folds.Columns) -> np.ndarray:
            return (c["_rs"] > 0).astype("int64") + (c["r"] > self.rsi_level) + (c["t_direction"] == 1)

        def events(c: folds.Columns) -> Conditions:
            n, never = agree(c), np.zeros(len(c["r"]), bool)
            return n >= self.enter, never, n < self.leave, never

        parts = [folds.rsi("close", self.rsi_period, "r"), folds.supertrend(self.period, self.multiplier, "t")]
        return signal_fold(parts, events, ("_rs", "close"), confidence=lambda c, s: agree(c) / 3, warmup=self.rs_period, tags=("AGREE", "LEAVE"), stop_pct=self.stop_pct, target_pct=self.target_pct, suffix=suffix)


@dataclass(frozen=True)
class OpeningRangeBreakout(Strategy):
    """At most one long and one short entry a day, out of the opening range and on the right side of the day's mean price. Windows alone, no fold."""

    start: str = "09:15"
    stop: str = "09:30"
    last: str = "15:15"
    least_bars: int = 10
    min_body: float = 0.0
    use_vwap: bool = True
    target_pct: float = 0.0

    def signals(self, bars: DataFrame) -> DataFrame:
        d = opening_range(bars, self.start, self.stop, self.least_bars).withColumn("_v", ind.vwap())
        clock = lambda x: int(x[:2]) * 3600 + int(x[3:5]) * 60
        t = second_of_day(C("ts"))
        ok = (t > clock(self.stop)) & (t < clock(self.last)) & (F.abs(C("close") - C("open")) >= self.min_body)
        high = (C("close") > C("or_high")) & ((C("close") > C("_v")) if self.use_vwap else F.lit(True))
        low = (C("close") < C("or_low")) & ((C("close") < C("_v")) if self.use_vwap else F.lit(True))
        d = d.withColumn("_l", flag(ok & high)).withColumn("_s", flag(ok & low & ~flag(high)))
        upto = DAY().rowsBetween(Window.unboundedPreceding, -1)
        first = lambda c: C(c) & (F.coalesce(F.sum(C(c).cast("int")).over(upto), F.lit(0)) == 0)
        d = d.withColumn("signal", F.when(first("_l"), 1).when(first("_s"), -1).otherwise(0))
        return finish(d, bars.columns, "ORB_LONG", "ORB_SHORT", C("open"), self.target_pct)


def first_signal_per_session(d: DataFrame, column: str = "signal") -> DataFrame:
    """Signals other than the first of a symbol's day are cleared."""
    seen = F.coalesce(F.sum((C(column) != 0).cast("int")).over(DAY().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("_seen", seen).withColumn(column, F.when(C("_seen") == 0, C(column)).otherwise(0)).drop("_seen")


STRATEGIES: dict[str, type[Strategy]] = {
    "ema_crossover": EmaCrossover, "macd_crossover": MacdCrossover, "rsi_reversion": RsiReversion, "bollinger_squeeze": BollingerSqueeze,
    "supertrend": SupertrendFlip, "rs_rsi_supertrend": StrengthRsiTrend, "opening_range": OpeningRangeBreakout,
}


def confluence(bars: DataFrame, strategies: list[Strategy], n: int) -> DataFrame:
    """Bars with long_votes, short_votes and a signal where n strategies (with folds) agree at the bar. All run in one pass."""
    d = bars
    for x in strategies:
        d = x.prepared(d)
    d = folds.fold(d, *(x.fold(f"_{i}") for i, x in enumerate(strategies)))
    votes = lambda v: sum(((C(f"signal_{i}") == v).cast("int") for i in range(len(strategies))), F.lit(0))
    d = d.select(*bars.columns, votes(1).alias("long_votes"), votes(-1).alias("short_votes"))
    return d.withColumn("signal", F.when(C("long_votes") >= n, 1).when(C("short_votes") >= n, -1).otherwise(0).cast("int"))
