"""Swings, trend structure and chart patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import W, lag, row, with_last_known
from ..schema import code, flag
from .indicators import sma

C = F.col


def swing(x: str, w: int = 5, high: bool = True) -> Column:
    """The value where it is the extreme of w bars to both sides. Known only w bars later; see known()."""
    around = W().rowsBetween(-w, w)
    top = F.max(x) if high else F.min(x)
    return F.when((F.count(x).over(around) == 2 * w + 1) & (C(x) == top.over(around)), C(x))


def known(x: str, w: int = 5) -> Column:
    """A centred value from the bar on at which it could be told."""
    return lag(x, w)


def with_swings(bars: DataFrame, w: int = 5) -> DataFrame:
    d = bars.withColumn("swing_high", swing("high", w)).withColumn("swing_low", swing("low", w, high=False))
    return d.withColumn("swing_high_known", known("swing_high", w)).withColumn("swing_low_known", known("swing_low", w))


def with_trend_structure(bars: DataFrame, w: int = 5, as_known: bool = False) -> DataFrame:
    """higher_high, lower_high, higher_low, lower_low at swings; uptrend, downtrend and trend_change at all bars.

    as_known: swings count from when they could be told, as screens need it.
    """
    d, tail = with_swings(bars, w), "_known" if as_known else ""
    ahead, upto = W().rowsBetween(Window.unboundedPreceding, -1), W().rowsBetween(Window.unboundedPreceding, 0)
    for x in ("high", "low"):
        s, before = C(f"swing_{x}{tail}"), F.last(f"swing_{x}{tail}", ignorenulls=True).over(ahead)
        d = d.withColumn(f"higher_{x}", flag(s > before)).withColumn(f"lower_{x}", flag(s < before))
    for x in ("high", "low"):
        told = F.when(C(f"higher_{x}"), F.lit(1)).when(C(f"lower_{x}"), F.lit(-1))
        d = d.withColumn(f"_{x}", told).withColumn(f"_last_{x}", F.last(f"_{x}", ignorenulls=True).over(upto))
    d = d.withColumn("uptrend", flag((C("_last_high") == 1) & (C("_last_low") == 1))).withColumn("downtrend", flag((C("_last_high") == -1) & (C("_last_low") == -1)))
    d = d.withColumn("trend_change", F.when(C("downtrend"), -1).when(C("uptrend"), 1).otherwise(0).cast("int"))
    return d.drop("_high", "_low", "_last_high", "_last_low")


def with_market_phase(bars: DataFrame, short: int = 50, long: int = 200) -> DataFrame:
    """1 accumulation, 2 markup, 3 distribution, 4 markdown, 0 unknown: by the close and two means."""
    d = bars.withColumn("_a", sma(C("close"), short)).withColumn("_b", sma(C("close"), long))
    c, a, b = C("close"), C("_a"), C("_b")
    phase = F.when((c > a) & (a <= b), 1).when((c > a) & (a > b), 2).when((c < a) & (a >= b), 3).when((c < a) & (a < b), 4).otherwise(0)
    return d.withColumn("market_phase", phase.cast("int")).drop("_a", "_b")


class _Line:
    """Through the last two swings of a side, followed to the bar."""

    def __init__(self, side: str):
        v1, v2, p1, p2 = (C(f"{side}{k}{at}") for at in ("", "_at") for k in (1, 2))
        self.slope = (v1 - v2) / F.greatest(p1 - p2, F.lit(1))
        self.now = v1 + self.slope * (C("_row") - p1)

    def broken_up(self) -> Column:
        return (C("close") > self.now) & (C("_close1") <= self.now - self.slope)

    def broken_down(self) -> Column:
        return (C("close") < self.now) & (C("_close1") >= self.now - self.slope)


def _close_to(a: Column, b: Column, part: float, of: Column | None = None) -> Column:
    return F.abs(a - b) / F.greatest(a if of is None else of, F.lit(1e-5)) < part


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


CHARTS = (
    "triangle_ascending", "triangle_descending", "triangle_symmetrical", "flag_bullish", "flag_bearish", "wedge_rising", "wedge_falling",
    "double_top", "double_bottom", "head_and_shoulders", "inverse_head_and_shoulders", "cup_and_handle",
)


def with_charts(bars: DataFrame, w: int = 5, as_known: bool = False, only: tuple[str, ...] = CHARTS, suffix: str = "") -> DataFrame:
    """Codes of chart patterns: the last swings form the pattern and the close breaks its line at this bar."""
    d = with_swings(bars, w).withColumn("_row", row()).withColumn("_close1", lag("close"))
    tail = "_known" if as_known else ""
    d = with_last_known(with_last_known(d, f"swing_high{tail}", 3, "h"), f"swing_low{tail}", 3, "l")
    h1, h2, h3, l1, l2, l3 = (C(f"{s}{k}") for s in "hl" for k in (1, 2, 3))
    h1p, h2p, h3p, l1p, l2p, l3p = (C(f"{s}{k}_at") for s in "hl" for k in (1, 2, 3))
    top, bottom, after = _Line("h"), _Line("l"), C("_row") > F.greatest(h1p, l1p)
    parallel = F.abs(top.slope - bottom.slope) < 0.5 * F.greatest(F.abs(top.slope), F.lit(1e-5))
    both_down, both_up = (top.slope < 0) & (bottom.slope < 0), (top.slope > 0) & (bottom.slope > 0)
    fall = lambda level: (C("close") < level) & (C("_close1") >= level)
    rise = lambda level: (C("close") > level) & (C("_close1") <= level)
    neck = lambda a, ap, b, bp: b + (a - b) / F.greatest(ap - bp, F.lit(1)) * (C("_row") - bp)
    neck_slope = lambda a, ap, b, bp: (a - b) / F.greatest(ap - bp, F.lit(1))
    under, over = neck(l1, l1p, l2, l2p), neck(h1, h1p, h2, h2p)
    narrowing = (top.slope < 0) & (bottom.slope > 0) & after
    codes = {
        "triangle_ascending": code(_all(_close_to(h1, h2, 0.02), l1 > 1.005 * l2, top.broken_up(), after)),
        "triangle_descending": code(_all(_close_to(l1, l2, 0.02), h1 < 0.995 * h2, bottom.broken_down(), after), -1),
        "triangle_symmetrical": F.when(narrowing & bottom.broken_down(), -1).when(narrowing & top.broken_up(), 1).otherwise(0).cast("int"),
        "flag_bullish": code(_all(both_down, parallel, top.broken_up(), after)),
        "flag_bearish": code(_all(both_up, parallel, bottom.broken_down(), after), -1),
        "wedge_rising": code(_all(both_up, bottom.slope > top.slope, bottom.broken_down(), after), -1),
        "wedge_falling": code(_all(both_down, top.slope < bottom.slope, top.broken_up(), after)),
        "double_top": code(_all(_close_to(h1, h2, 0.03), h2p < l1p, l1p < h1p, fall(l1), C("_row") > h1p), -1),
        "double_bottom": code(_all(_close_to(l1, l2, 0.03), l2p < h1p, h1p < l1p, rise(h1), C("_row") > l1p)),
        "head_and_shoulders": code(_all(h2 > h1, h2 > h3, _close_to(h1, h3, 0.05, F.greatest(h1, h3)), h3p < l2p, l2p < h2p, h2p < l1p, l1p < h1p, (C("close") < under) & (C("_close1") >= under - neck_slope(l1, l1p, l2, l2p)), C("_row") > h1p), -1),
        "inverse_head_and_shoulders": code(_all(l2 < l1, l2 < l3, _close_to(l1, l3, 0.05, F.greatest(l1, l3)), l3p < h2p, h2p < l2p, l2p < h1p, h1p < l1p, (C("close") > over) & (C("_close1") <= over - neck_slope(h1, h1p, h2, h2p)), C("_row") > l1p)),
        "cup_and_handle": code(_all(_close_to(h3, h2, 0.05, F.greatest(h3, h2)), h1 < h2, (h2 - l2) / F.greatest(h2, F.lit(1e-5)) > 0.05, l1 > l2 + 0.3 * (h2 - l2), h3p < l2p, l2p < h2p, h2p < l1p, l1p < h1p, rise(h2), C("_row") > h1p)),
    }
    return d.select(*bars.columns, *(codes[x].alias(x + suffix) for x in only))


def with_all_charts(bars: DataFrame, w: int = 5) -> DataFrame:
    """The twelve patterns and pennants, which are symmetrical triangles of swings 3 bars wide."""
    d = with_charts(bars, w)
    narrow = with_charts(d, 3, only=("triangle_symmetrical",), suffix="_3")
    return narrow.withColumnRenamed("triangle_symmetrical_3", "pennant")
