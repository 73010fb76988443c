"""Candlestick patterns: for each, when it is bullish (+1) and bearish (-1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.windows import W

# Columns that the conditions use: prices o h l c, size of the body, shadows us and ls, range rng, top and bottom of the body rt
# and rb, up and down; with 1 or 2 at the end, those of one or two bars before.
FEATURES = {
    "o": "open", "h": "high", "l": "low", "c": "close", "body": "abs(close - open)", "us": "high - greatest(open, close)", "ls": "least(open, close) - low",
    "rng": "high - low", "rt": "greatest(open, close)", "rb": "least(open, close)", "up": "close > open", "down": "close < open",
}

_INSIDE = "rt < rt1 and rb > rb1"
_OVER = "body > body1 and rt > rt1 and rb < rb1"
_STAR = "body1 <= 0.3 * rng1"
_BALD = "us <= 0.05 * rng and ls <= 0.05 * rng"

# The patterns' definitions, as (condition for the first code, its code, condition for the second, its code).
PATTERNS: dict[str, tuple] = {
    "doji": ("body <= 0.1 * rng", 1),
    "hammer": ("ls >= 2 * body and us <= 0.1 * rng and rng > 0", 1),
    "hanging_man": ("ls >= 2 * body and us <= 0.1 * rng and body > 0", -1),
    "inverted_hammer": ("us >= 2 * body and ls <= 0.1 * rng and body > 0", 1),
    "shooting_star": ("us >= 2 * body and ls <= 0.1 * rng and body > 0", -1),
    "bullish_engulfing": (f"down1 and up and {_OVER}", 1),
    "bearish_engulfing": (f"up1 and down and {_OVER}", 1),
    "morning_star": (f"down2 and {_STAR} and up and c > (o2 + c2) / 2", 1),
    "evening_star": (f"up2 and {_STAR} and down and c < (o2 + c2) / 2", -1),
    "three_white_soldiers": ("up and up1 and up2 and c > c1 and c1 > c2", 1),
    "three_black_crows": ("down and down1 and down2 and c < c1 and c1 < c2", -1),
    "marubozu": (f"up and {_BALD} and body > 0", 1, f"down and {_BALD} and body > 0", -1),
    "dragonfly_doji": ("body <= 0.1 * rng and us <= 0.1 * rng and ls > 0.5 * rng", 1),
    "gravestone_doji": ("body <= 0.1 * rng and ls <= 0.1 * rng and us > 0.5 * rng", 1),
    "harami": (f"down1 and up and {_INSIDE}", 1, f"up1 and down and {_INSIDE}", -1),
    "harami_cross": (f"down1 and body <= 0.1 * rng and {_INSIDE}", 1, f"up1 and body <= 0.1 * rng and {_INSIDE}", -1),
    "piercing_pattern": ("down1 and up and o < rb1 and c > (o1 + c1) / 2 and c < rt1", 1),
    "dark_cloud_cover": ("up1 and down and o > rt1 and c < (o1 + c1) / 2 and c > rb1", -1),
    "spinning_top": ("body <= 0.3 * rng and us > body and ls > body and up", 1, "body <= 0.3 * rng and us > body and ls > body and down", -1),
    "tweezer_top": ("abs(h - h1) < 0.0001 * h and down", -1),
    "tweezer_bottom": ("abs(l - l1) < 0.0001 * l and up", 1),
    "abandoned_baby": ("down2 and body1 <= 0.1 * rng1 and up and h1 < l2 and h1 < l and l1 < l2 and l1 < l", 1, "up2 and body1 <= 0.1 * rng1 and down and l1 > h2 and l1 > h and h1 > h2 and h1 > h", -1),
    "three_inside_up": ("down2 and up1 and rt1 < rt2 and rb1 > rb2 and up and c > c1", 1),
    "three_inside_down": ("up2 and down1 and rt1 < rt2 and rb1 > rb2 and down and c < c1", 1),
    "three_outside_up": ("down2 and up1 and body1 > body2 and rt1 > rt2 and rb1 < rb2 and up and c > c1", 1),
    "three_outside_down": ("up2 and down1 and body1 > body2 and rt1 > rt2 and rb1 < rb2 and down and c < c1", 1),
    "kicking": (f"down1 and us1 <= 0.05 * rng1 and ls1 <= 0.05 * rng1 and up and {_BALD} and o > o1", 1, f"up1 and us1 <= 0.05 * rng1 and ls1 <= 0.05 * rng1 and down and {_BALD} and o < o1", -1),
}
#: Patterns that say bearish with +1.
BEARISH_ONES = frozenset({"bearish_engulfing", "three_inside_down", "three_outside_down"})


def code_sql(pattern: str) -> str:
    parts = PATTERNS[pattern]
    return "CAST(CASE " + " ".join(f"WHEN {parts[i]} THEN {parts[i + 1]}" for i in range(0, len(parts), 2)) + " ELSE 0 END AS INT)"


def with_candles(bars: DataFrame, *patterns: str, signed: bool = False) -> DataFrame:
    """Adds a code for each pattern (all, if none is named). signed: bearish patterns are -1 throughout."""
    names = patterns or tuple(PATTERNS)
    now = bars.select("*", F.struct(*(F.expr(x).alias(n) for n, x in FEATURES.items())).alias("_0"))
    seen = now.withColumn("_1", F.lag("_0", 1).over(W())).withColumn("_2", F.lag("_0", 2).over(W()))
    wide = seen.select(*bars.columns, *(F.col(f"_{k}.{n}").alias(f"{n}{k or ''}") for k in range(3) for n in FEATURES))
    sign = lambda p: -1 if signed and p in BEARISH_ONES else 1
    return wide.select(*bars.columns, *((sign(p) * F.expr(code_sql(p))).cast("int").alias(p) for p in names))
