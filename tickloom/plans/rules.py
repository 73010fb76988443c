"""Screens: trees of rules as dictionaries (or JSON), compiled to columns of bars.

A rule names an indicator's condition; and/or/not/at_least combine rules. What the rules of a tree need is collected first:
each indicator is added once, those that are windows before those that are folds, so that bars are dealt and sorted by symbol
once. What the conditions need of the bar before is a column too. Every bar gets an answer: the last one is the end-of-day scan,
all of them the historical scan.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import candles, indicators, swings
from ..operators import fold as folds
from ..operators.windows import W, before_n, lag, row
from ..schema import flag, ratio

C = F.col


@dataclass(frozen=True)
class Compiled:
    """passed and value of a rule on each bar, and how many bars it needs."""

    name: str
    passed: Column
    value: Column
    least: int
    weight: float = 1.0


Pair = tuple[Column, Column]  # at this bar and at the one before


def _crossing(x: Pair, level: Pair, how: str) -> Column:
    return {"above": x[0] > level[0], "below": x[0] < level[0], "cross_above": (x[0] > level[0]) & (x[1] <= level[1]), "cross_below": (x[0] < level[0]) & (x[1] >= level[1])}[how]


class _Needs:
    """What the rules of a tree need, each once."""

    def __init__(self) -> None:
        self.folds: dict[str, folds.Fold] = {}
        self.lagged: dict[str, None] = {}
        self.windows: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def fold(self, name: str, f: folds.Fold) -> str:
        self.folds[name] = f
        return name

    def before(self, name: str) -> Column:
        """A fold's output at the bar before."""
        self.lagged[name] = None
        return C(f"{name}_1")

    def window(self, name: str, add: Callable[[DataFrame], DataFrame] | Column) -> Column:
        """A column that windows give, by a function of bars or as it is."""
        self.windows.setdefault(name, add if callable(add) else lambda d: d.withColumn(name, add))
        return C(name)

    def pair(self, name: str) -> Pair:
        """A column of bars, or of windows asked for before, with its value at the bar before."""
        return C(name), self.window(f"{name}_1", lag(name))

    def folded(self, name: str) -> Pair:
        return C(name), self.before(name)

    def apply(self, bars: DataFrame) -> DataFrame:
        d = bars
        for add in self.windows.values():
            d = add(d)
        return folds.fold(d, *self.folds.values(), number="_n", lagged=tuple(self.lagged)) if self.folds else d.withColumn("_n", row())


def _leaf(rule: dict, needs: _Needs) -> Compiled:
    p = {k: v for k, v in rule.items() if k not in ("type", "weight", "name")}
    kind = rule["type"]
    num = lambda x: (F.lit(float(x)),) * 2
    close, volume = C("close"), C("volume")

    def ema(n: int) -> Pair:
        return needs.folded(needs.fold(f"ema_{n}", folds.ema("close", n, f"ema_{n}")))

    if kind == "rsi":
        n = p.get("period", 14)
        x = needs.folded(needs.fold(f"rsi_{n}", folds.rsi("close", n, f"rsi_{n}")))
        passed, value, least = _crossing(x, num(p.get("threshold", 30)), p.get("direction", "below")), x[0], n + 1
    elif kind == "macd":
        a, b, c = p.get("fast", 12), p.get("slow", 26), p.get("signal", 9)
        name = needs.fold(f"macd_{a}_{b}_{c}", folds.macd("close", a, b, c, f"macd_{a}_{b}_{c}"))
        how, hist = p.get("condition", "cross_above"), C(f"{name}_histogram")
        passed = hist > 0 if how == "histogram_positive" else hist < 0 if how == "histogram_negative" else _crossing(needs.folded(f"{name}_line"), needs.folded(f"{name}_signal"), how)
        value, least = hist, b + c
    elif kind == "ema":
        n = p.get("period", 20)
        how = p.get("condition", "above").replace("price_", "")
        passed, value, least = _crossing(needs.pair("close"), ema(n), how), ema(n)[0], n
    elif kind in ("golden_cross", "death_cross"):
        a, b = ema(p.get("fast", 50)), ema(p.get("slow", 200))
        passed, value, least = _crossing(a, b, "cross_above" if kind == "golden_cross" else "cross_below"), a[0] - b[0], p.get("slow", 200) + 1
    elif kind == "supertrend":
        n, m = p.get("period", 10), p.get("multiplier", 3.0)
        name = needs.fold(f"supertrend_{n}_{m:g}".replace(".", "_"), folds.supertrend(n, m, f"supertrend_{n}_{m:g}".replace(".", "_")))
        how, side = p.get("condition", "bullish"), C(f"{name}_direction")
        want = 1 if how.endswith("bullish") else -1
        passed = (side == want) & (needs.before(f"{name}_direction") == -want) if how.startswith("flip") else side == want
        value, least = C(name), n + 1
    elif kind == "bollinger_squeeze":
        n, k, m = p.get("period", 20), p.get("std", 2.0), p.get("multiplier", 1.5)
        name, atr = f"bbsq_{n}", C(needs.fold(f"atr_{n}", folds.atr(n, f"atr_{n}")))
        needs.window(name, lambda d: indicators.with_bollinger(d, n, k, name=name))
        mid = ema(n)[0]
        passed, value, least = (C(f"{name}_upper") <= mid + m * atr) & (C(f"{name}_lower") >= mid - m * atr), C(f"{name}_bandwidth"), n
    elif kind == "relative_strength":
        n = p.get("period", 55)
        needs.window(f"mansfield_{n}", lambda d: indicators.with_mansfield(d, "benchmark_close", n, f"mansfield_{n}"))
        x, how = needs.pair(f"mansfield_{n}"), p.get("condition", "above")
        passed, value, least = x[0] > x[1] if how == "improving" else _crossing(x, num(p.get("threshold", 0)), how), x[0], n + 1
    elif kind == "adx":
        n = p.get("period", 14)
        name = needs.fold(f"adx_{n}", folds.adx(n, f"adx_{n}"))
        how, plus, minus = p.get("condition", "above"), C(f"{name}_plus_di"), C(f"{name}_minus_di")
        strong = C(name) > p.get("threshold", 25)
        passed = {"above": strong, "di_plus_above": strong & (plus > minus), "di_minus_above": strong & (minus > plus)}[how]
        value, least = C(name), 2 * n
    elif kind == "vwap":
        price = needs.pair("close")  # the window by symbol first: its shuffle serves days too
        needs.window("vwap", indicators.vwap())
        passed, value, least = _crossing(price, needs.pair("vwap"), p.get("condition", "above").replace("price_", "")), C("vwap"), 2
    elif kind == "price_breakout":
        n, up = p.get("lookback", 20), p.get("direction", "above") == "above"
        x = needs.window(f"prior_high_{n}", indicators.prior_extremes(n)[0]) if up else needs.window(f"prior_low_{n}", indicators.prior_extremes(n)[1])
        passed, value, least = _crossing(needs.pair("close"), (x, x), "cross_above" if up else "cross_below"), x, n + 1
    elif kind in ("near_support", "near_resistance"):
        levels, tolerance = [float(x) for x in p["levels"]], p.get("tolerance", 0.02)
        nearest = F.least(*(F.abs(close - x) for x in levels)) if len(levels) > 1 else F.abs(close - levels[0])
        passed, value, least = ratio(nearest, close) <= tolerance, nearest, 1
    elif kind == "price_range":
        low, high = p.get("min_price", 0), p.get("max_price", 0)
        passed, value, least = (close >= low if low else F.lit(True)) & (close <= high if high else F.lit(True)), close, 1
    elif kind in ("higher_high", "lower_low"):
        w, x = p.get("window", 5), "high" if kind == "higher_high" else "low"
        needs.window(f"structure_{w}", lambda d: _with_structure(d, w))
        told = f"higher_{x}_{w}" if x == "high" else f"lower_{x}_{w}"
        at = needs.window(f"last_{told}", F.last(F.when(C(f"swing_{x}_known_{w}").isNotNull(), C(told)), ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, 0)))
        passed, value, least = at, C(f"swing_{x}_known_{w}"), p.get("lookback", 20)
    elif kind in ("volume_breakout", "volume_ratio", "volume_decline"):
        n, m = p.get("period", 20), p.get("multiplier", 0.5 if kind == "volume_decline" else 1.5 if kind == "volume_ratio" else 2.0)
        mean = needs.window(f"volume_mean_{n}", F.when(F.count("volume").over(before_n(n)) == n, F.avg("volume").over(before_n(n))))
        passed, value, least = volume <= m * mean if kind == "volume_decline" else volume >= m * mean, ratio(volume, mean), n + 1
    elif kind in ("accumulation", "distribution"):
        n = p.get("period", 10)
        needs.window("obv", indicators.with_obv)
        mean = needs.window(f"obv_mean_{n}", indicators.sma(C("obv"), n))
        passed, value, least = C("obv") > mean if kind == "accumulation" else C("obv") < mean, C("obv"), n
    elif kind == "candle":
        name, side = p["pattern"], p.get("direction", "ANY")
        needs.window(f"candle_{name}", lambda d: candles.with_candles(d, name, signed=True))
        passed, value, least = {"BULLISH": C(name) == 1, "BEARISH": C(name) == -1, "ANY": C(name) != 0}[side], C(name), 10
    elif kind == "chart":
        name = p["pattern"]
        needs.window(f"chart_{name}", lambda d: _with_chart(d, name))
        passed, value, least = C(f"{name}_seen") != 0, C(f"{name}_seen"), 50
    elif kind == "trend":
        needs.window("structure_5", lambda d: _with_structure(d, 5))
        passed, value, least = C(f"{p.get('direction', 'uptrend')}_5"), C("trend_change_5"), 21
    elif kind == "signal":
        passed, value, least = C(p.get("column", "signal")) == (1 if p.get("direction", "long") == "long" else -1), C(p.get("column", "signal")), 1
    elif kind == "expression":
        passed, value, least = F.expr(p["sql"]), F.lit(None), p.get("min_bars", 1)
    else:
        raise ValueError(f"unknown rule {kind!r}")
    label = rule.get("name", kind + ("" if not p else "_" + "_".join(str(v) for v in p.values() if isinstance(v, str | int | float))))
    return Compiled(label, flag(passed), value.cast("double"), least, float(rule.get("weight", 1.0)))


def _with_structure(d: DataFrame, w: int) -> DataFrame:
    """The columns of the trend structure as screens know it, with _<w> at the end, so that several widths can stand side by side."""
    made = swings.with_trend_structure(d, w, as_known=True)
    return made.select(*d.columns, *(C(c).alias(f"{c}_{w}") for c in made.columns if c not in d.columns))


def _with_chart(d: DataFrame, name: str) -> DataFrame:
    return swings.with_charts(d, as_known=True, only=(name,), suffix="_seen")


def _tree(rule: dict, needs: _Needs, leaves: list[Compiled]) -> tuple[Column, int]:
    kind = rule["type"]
    if kind in ("and", "or", "at_least"):
        parts = [_tree(r, needs, leaves) for r in rule["rules"]]
        least = max(n for _, n in parts)
        if kind == "at_least":
            return sum((x.cast("int") for x, _ in parts), F.lit(0)) >= rule["n"], least
        return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), (x for x, _ in parts)), least
    if kind == "not":
        x, least = _tree(rule["rule"], needs, leaves)
        return ~x & (C("_n") >= least), least
    leaf = _leaf(rule, needs)
    leaves.append(leaf)
    return leaf.passed & (C("_n") >= leaf.least), leaf.least


def evaluate(bars: DataFrame, rule: dict | str, weighted: bool = False) -> DataFrame:
    """Bars with passed, score and rules: for each leaf its name, answer and value. score: the part of leaves that pass, by weight if weighted."""
    rule = json.loads(rule) if isinstance(rule, str) else rule
    needs, leaves = _Needs(), []
    _tree(rule, needs, leaves)
    d = needs.apply(bars)
    for i, x in enumerate(leaves):
        d = d.withColumn(f"_p{i}", x.passed & (C("_n") >= x.least)).withColumn(f"_v{i}", x.value)
    at = iter(range(len(leaves)))

    def answered(r: dict) -> Column:
        if r["type"] in ("and", "or", "at_least"):
            parts = [answered(x) for x in r["rules"]]
            if r["type"] == "at_least":
                return sum((x.cast("int") for x in parts), F.lit(0)) >= r["n"]
            return reduce((lambda a, b: a & b) if r["type"] == "and" else (lambda a, b: a | b), parts)
        if r["type"] == "not":
            return ~answered(r["rule"]) & (C("_n") >= _least(r["rule"]))
        return C(f"_p{next(at)}")

    total = sum(x.weight if weighted else 1.0 for x in leaves)
    score = sum((C(f"_p{i}").cast("double") * (x.weight if weighted else 1.0) for i, x in enumerate(leaves)), F.lit(0.0)) / total
    details = F.array(*(F.struct(F.lit(x.name).alias("rule"), C(f"_p{i}").alias("passed"), C(f"_v{i}").alias("value"), F.lit(x.weight).alias("weight")) for i, x in enumerate(leaves)))
    return d.select(*bars.columns, answered(rule).alias("passed"), score.alias("score"), details.alias("rules"))


def _least(rule: dict) -> int:
    return _tree(rule, _Needs(), [])[1]


RANKS = {"SCORE": "score", "CLOSE": "close", "VOLUME": "volume", "ATR_PCT": "atr_pct", "RS_SCORE": "rs_score", "SIGNAL_STRENGTH": "signal_strength"}


def with_atr_pct(bars: DataFrame, n: int = 14) -> DataFrame:
    """Adds atr_pct, the simple mean range of n bars in percent of the close, for rank()."""
    return indicators.with_atr_simple(bars, n, "_a").withColumn("atr_pct", 100 * ratio(C("_a"), C("close"))).drop("_a")


def rank(scan: DataFrame, by: str = "SCORE", descending: bool = True, limit: int = 0) -> DataFrame:
    """In order of one of RANKS, nulls last and ties by symbol.

    RS_SCORE and SIGNAL_STRENGTH are a column of that name, or else the value of a rule of that name, or else the score.
    """
    if by not in RANKS:
        raise ValueError(f"unknown rank {by!r}: one of {', '.join(RANKS)}")
    name = RANKS[by]
    if name in scan.columns:
        c = C(name)
    elif by in ("RS_SCORE", "SIGNAL_STRENGTH"):
        c = F.coalesce(F.try_element_at(F.filter("rules", lambda r: F.lower(r["rule"]) == name), F.lit(1))["value"], C("score"))
    else:
        raise ValueError(f"the scan has no column {name!r}")
    d = scan.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "symbol")
    return d.limit(limit) if limit else d


def scan_eod(bars: DataFrame, rule: dict | str, weighted: bool = False, eligible: DataFrame | None = None) -> DataFrame:
    """The last bar of each symbol that passes. eligible (symbol): only those are looked at at all, from before the indicators on."""
    d = bars.join(eligible, "symbol", "left_semi") if eligible is not None else bars
    return _last(evaluate(d, rule, weighted)).where("passed").drop("passed")


def _last(d: DataFrame) -> DataFrame:
    """The last row of each symbol, by an aggregate: tasks send one row for each symbol on."""
    return d.groupBy("symbol").agg(F.max_by(F.struct(*d.columns), "ts").alias("_r")).select("_r.*")


def scan_history(bars: DataFrame, rule: dict | str, start: str, end: str, weighted: bool = False) -> DataFrame:
    """All bars from start to end that pass; bars before them still count as history."""
    d = evaluate(bars, rule, weighted)
    return d.where((C("ts") >= F.lit(start).cast("timestamp_ntz")) & (C("ts") < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))).where("passed").drop("passed")


def scan_live(history: DataFrame, ticks: DataFrame, rule: dict | str) -> DataFrame:
    """The scan as if each symbol's latest tick (symbol, ts, ltp, volume) were its next bar."""
    now = ticks.groupBy("symbol").agg(F.max_by(F.struct("ltp", "volume"), "ts").alias("t"), F.max("ts").alias("ts"))
    as_bars = now.select("symbol", "ts", *(C("t.ltp").alias(c) for c in ("open", "high", "low", "close")), C("t.volume").cast("bigint").alias("volume"))
    return scan_eod(history.unionByName(as_bars, allowMissingColumns=True), rule)


def summary(evaluated: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(scanned, passed, failed, errored): symbols of evaluate(), by their last bar. Those of wanted (symbol) without bars, and those whose last close is null, count as errors."""
    last = _last(evaluated).select("symbol", "passed", C("close").isNull().alias("bad"))
    if wanted is not None:
        last = wanted.select("symbol").distinct().join(last, "symbol", "left")
    bad = F.coalesce(C("bad"), F.lit(True))
    return last.agg(F.count("*").alias("scanned"), F.count_if(~bad & C("passed")).alias("passed"), F.count_if(~bad & ~C("passed")).alias("failed"), F.count_if(bad).alias("errored"))
