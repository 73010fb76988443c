"""Charges, order fills, stops, targets and position sizes: as columns where a query needs them, as small functions for the simulator."""

from __future__ import annotations

import math
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col

# Rates of the eight segments in percent of turnover: brokerage (at most BROKERAGE_CAP an order; 0: the cap itself),
# transaction tax on buys and on sells, exchange charge, stamp duty on buys.
RATES = {
    "EQUITY_DELIVERY": (0.1, 0.1, 0.1, 0.00297, 0.015),
    "EQUITY_INTRADAY": (0.05, 0.025, 0.025, 0.00297, 0.0003),
    "EQUITY_FUTURES": (0.05, 0.0, 0.0125, 0.00173, 0.0002),
    "EQUITY_OPTIONS": (0.0, 0.0625, 0.125, 0.03503, 0.0003),
    "CURRENCY_FUTURES": (0.05, 0.0, 0.0, 0.00035, 0.0001),
    "CURRENCY_OPTIONS": (0.0, 0.0, 0.0, 0.03503, 0.0001),
    "COMMODITY_FUTURES": (0.05, 0.0, 0.01, 0.0026, 0.0001),
    "COMMODITY_OPTIONS": (0.0, 0.0, 0.01, 0.0026, 0.0001),
}
BROKERAGE_CAP, SEBI, GST, DP_CHARGE = 20.0, 0.00001, 18.0, 18.5
PARTS = ("brokerage", "stt", "exchange_charge", "sebi_fee", "gst", "stamp_duty", "dp_charge")


def charges(segment: str, side: str, quantity: float, price: float) -> dict[str, float]:
    if segment not in RATES:
        raise ValueError(f"unknown segment {segment!r}")
    if side not in ("BUY", "SELL") or quantity <= 0 or price <= 0:
        raise ValueError("an order is BUY or SELL, of a positive quantity and price")
    broker, on_buy, on_sell, exchange, stamp = RATES[segment]
    value = quantity * price
    brokerage = min(BROKERAGE_CAP, value * broker / 100) if broker else BROKERAGE_CAP
    charge = value * exchange / 100
    parts = (
        brokerage, value * (on_buy if side == "BUY" else on_sell) / 100, charge, value * SEBI / 100, (brokerage + charge) * GST / 100,
        value * stamp / 100 if side == "BUY" else 0.0, DP_CHARGE if side == "SELL" and segment == "EQUITY_DELIVERY" else 0.0,
    )
    return {k: _cents(x) for k, x in zip(PARTS, parts, strict=True)} | {"total": _cents(sum(parts))}


def _cents(x: float) -> float:
    """To two places, ties of the shortest decimal form to the even one, as bround does on columns."""
    return float(Decimal(repr(x)).quantize(Decimal("0.01"), ROUND_HALF_EVEN))


def rate_table(spark: SparkSession) -> DataFrame:
    """One row per segment."""
    return spark.createDataFrame([(k, *v) for k, v in RATES.items()], "segment string, r_broker double, r_buy double, r_sell double, r_exchange double, r_stamp double")


def with_charges(orders: DataFrame) -> DataFrame:
    """Adds the parts and the total to orders (segment, side, quantity, price). The table of rates has eight rows."""
    d = orders.join(F.broadcast(rate_table(orders.sparkSession)), "segment").withColumn("_v", C("quantity") * C("price"))
    brokerage = F.when(C("r_broker") > 0, F.least(F.lit(BROKERAGE_CAP), C("_v") * C("r_broker") / 100)).otherwise(BROKERAGE_CAP)
    buy = C("side") == "BUY"
    d = d.withColumn("_b", brokerage).withColumn("_x", C("_v") * C("r_exchange") / 100)
    parts = (
        C("_b"), C("_v") * F.when(buy, C("r_buy")).otherwise(C("r_sell")) / 100, C("_x"), C("_v") * SEBI / 100, (C("_b") + C("_x")) * GST / 100,
        F.when(buy, C("_v") * C("r_stamp") / 100).otherwise(0.0), F.when(~buy & (C("segment") == "EQUITY_DELIVERY"), DP_CHARGE).otherwise(0.0),
    )
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return d.select(*orders.columns, *(F.bround(x, 2).alias(n) for n, x in zip(PARTS, parts, strict=True)), F.bround(total, 2).alias("total"))


def limit_fill(side: str, limit: float, o: float, h: float, lo: float) -> float | None:
    """A gap through the limit fills at the open."""
    better, reached = (o <= limit, lo <= limit) if side == "BUY" else (o >= limit, h >= limit)
    return o if better else limit if reached else None


def stop_fill(side: str, stop: float, o: float, h: float, lo: float) -> float | None:
    beyond, reached = (o >= stop, h >= stop) if side == "BUY" else (o <= stop, lo <= stop)
    return o if beyond else stop if reached else None


def stop_limit_fill(side: str, stop: float, limit: float, triggered: bool, o: float, h: float, lo: float) -> tuple[float | None, bool]:
    """Fill and whether the order is triggered, which stays."""
    triggered = triggered or (h >= stop if side == "BUY" else lo <= stop)
    if not triggered:
        return None, False
    price = max(o, stop) if side == "BUY" else min(o, stop)
    return (price if (price <= limit if side == "BUY" else price >= limit) else None), True


STOPS = frozenset("NONE FIXED_PRICE FIXED_PCT FIXED_POINTS FIXED_TICKS ATR_MULTIPLE VOLATILITY TRAILING_PCT TRAILING_POINTS TRAILING_TICKS TRAILING_ATR CHANDELIER TIME_BASED".split())


@dataclass(frozen=True)
class Stop:
    """kind: NONE, FIXED_PRICE, FIXED_PCT, FIXED_POINTS, FIXED_TICKS, ATR_MULTIPLE, VOLATILITY, TRAILING_PCT, TRAILING_POINTS, TRAILING_TICKS, TRAILING_ATR, CHANDELIER, TIME_BASED.

    A stop at a swing needs the swing's price: signals bring it as stop_loss.
    """

    kind: str = "NONE"
    value: float = 0.0
    tick: float = 0.05

    def __post_init__(self) -> None:
        if self.kind not in STOPS:
            raise ValueError(f"unknown stop {self.kind!r}")

    @property
    def trailing(self) -> bool:
        return self.kind.startswith("TRAILING") or self.kind == "CHANDELIER"

    def distance(self, price: float, atr: float | None) -> float | None:
        k, v = self.kind, self.value
        if k.endswith("PCT"):
            return price * v / 100
        if k.endswith("POINTS"):
            return v
        if k.endswith("TICKS"):
            return v * self.tick
        if k in ("ATR_MULTIPLE", "VOLATILITY", "TRAILING_ATR", "CHANDELIER"):
            return None if atr is None else atr * v
        return None

    def first(self, side: int, price: float, atr: float | None) -> float | None:
        if self.kind == "FIXED_PRICE":
            return self.value
        d = self.distance(price, atr)
        return None if d is None else price - side * d


@dataclass(frozen=True)
class Target:
    """kind: NONE, FIXED_PRICE, FIXED_PCT, FIXED_POINTS, FIXED_TICKS, RISK_REWARD, ATR_MULTIPLE, PARTIAL_EXIT (value in percent away, part of the position)."""

    kind: str = "NONE"
    value: float = 0.0
    part: float = 1.0
    tick: float = 0.05

    def price(self, side: int, entry: float, risk: float | None, atr: float | None) -> float | None:
        k, v = self.kind, self.value
        if k == "FIXED_PRICE":
            return v
        d = {"FIXED_PCT": entry * v / 100, "PARTIAL_EXIT": entry * v / 100, "FIXED_POINTS": v, "FIXED_TICKS": v * self.tick,
             "RISK_REWARD": None if risk is None else risk * v, "ATR_MULTIPLE": None if atr is None else atr * v}.get(k)
        return None if d is None else entry + side * d


def quantity(cash: float, price: float, *, fixed: float = 0, risk: float = 0.01, stop: float | None = None, atr: float | None = None, atr_multiple: float = 2.0, lot: int = 1) -> int:
    """Whole lots that cash can pay: a fixed number, or as many as lose `risk` of cash at the stop (or at a distance of atr)."""
    if price <= 0 or cash <= 0:
        return 0
    distance = abs(price - stop) if stop is not None else atr * atr_multiple if atr else 0
    wanted = fixed or math.floor(cash * risk / distance if distance else cash * risk / price)
    return max(0, int(min(wanted, cash // price) // lot * lot))


def quantity_column(cash: Column, price: Column, stop: Column, risk: float = 0.01, lot: int = 1) -> Column:
    distance = F.abs(price - stop)
    wanted = F.floor(F.when(distance > 0, cash * risk / F.nullif(distance, F.lit(0.0))).otherwise(cash * risk / price))
    return F.when((price > 0) & (cash > 0), F.greatest(F.floor(F.least(wanted, F.floor(cash / price)) / lot) * lot, F.lit(0))).otherwise(0).cast("long")
