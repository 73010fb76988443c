"""Backtests: signals to trades and equity, one account at a time, many accounts in parallel.

An account's bars are dealt to one task and streamed in time order; the state is cash, open positions and waiting orders, so
that an account may have any number of bars. An account is a symbol, or a portfolio of symbols that share cash, or either
with a parameter set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.pricing import Stop, Target, charges, limit_fill, quantity, stop_fill, stop_limit_fill

C = F.col


@dataclass(frozen=True)
class Config:
    capital: float = 100_000.0
    segment: str | None = "EQUITY_INTRADAY"  # None: no charges
    slippage_pct: float = 0.05
    risk: float = 0.01
    fixed_quantity: int = 0
    lot: int = 1
    allow_short: bool = False
    max_positions: int = 5
    max_drawdown: float = 0.0  # 0: none; a part of the peak
    max_daily_loss: float = 0.0  # 0: none; a part of the capital
    squareoff: str | None = None  # "15:20"
    stop: Stop = Stop("ATR_MULTIPLE", 2.0)
    target: Target = Target()
    order: str = "MARKET"  # LIMIT, STOP, STOP_LIMIT, AMO, GTT: at order_pct from the close
    order_pct: float = 0.0
    expires: int = 5
    max_bars: int = 0  # bars until a position is closed; 0: none
    cautious_trailing: bool = False  # a trailing stop moves after its bar has been tested, not before


TRADE = "symbol string, side string, entry_time timestamp_ntz, exit_time timestamp_ntz, entry_price double, exit_price double, quantity bigint, gross_pnl double, charges double, net_pnl double, bars_held int, mae double, mfe double, exit_reason string"
_NAMES = [x.split()[0] for x in TRADE.split(", ")]


@dataclass
class _Position:
    side: int
    qty: int
    entry: float
    time: object
    paid: float
    stop: float | None
    trail: float | None
    target: float | None
    bars: int = 0
    worst: float = 0.0
    best: float = 0.0


@dataclass
class _Symbol:
    pending_signal: tuple | None = None
    order: dict | None = None
    position: _Position | None = None
    price: float | None = None
    atr_sum: float = 0.0
    atr: float | None = None
    seen: int = -1
    before: float | None = None


@dataclass
class Account:
    """Steps through bars; on_bar returns the trades that the bar closes."""

    config: Config
    cash: float = 0.0
    peak: float = 0.0
    halted: bool = False
    day: object = None
    day_start: float = 0.0
    symbols: dict[str, _Symbol] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.cash = self.peak = self.day_start = self.config.capital

    def equity(self) -> float:
        return self.cash + sum(s.position.qty * s.price * s.position.side for s in self.symbols.values() if s.position)

    def _fee(self, side: str, qty: float, price: float) -> float:
        return charges(self.config.segment, side, qty, price)["total"] if self.config.segment else 0.0

    def _atr(self, s: _Symbol, h: float, lo: float, c: float) -> None:
        tr = h - lo if s.before is None else max(h - lo, abs(h - s.before), abs(lo - s.before))
        s.seen, s.before = s.seen + 1, c
        if 1 <= s.seen <= 14:
            s.atr_sum += tr
            s.atr = s.atr_sum / 14 if s.seen == 14 else None
        elif s.seen > 14:
            s.atr = (s.atr * 13 + tr) / 14

    def _open(self, s: _Symbol, side: int, price: float, ts, stop: float | None, target: float | None) -> None:
        cfg = self.config
        held = sum(1 for x in self.symbols.values() if x.position)
        if self.halted or s.position or held >= cfg.max_positions or side < 0 and not cfg.allow_short:
            return
        if cfg.max_daily_loss and self.equity() <= self.day_start - cfg.max_daily_loss * cfg.capital:
            return
        price *= 1 + side * cfg.slippage_pct / 100
        first = stop if stop is not None else cfg.stop.first(side, price, s.atr)
        qty = quantity(self.cash, price, fixed=cfg.fixed_quantity, risk=cfg.risk, stop=first, atr=s.atr, lot=cfg.lot)
        name = "BUY" if side > 0 else "SELL"
        while qty > 0 and qty * price + self._fee(name, qty, price) > self.cash:
            qty -= max(cfg.lot, int((qty * price + self._fee(name, qty, price) - self.cash) // price // cfg.lot * cfg.lot))
        if qty <= 0:
            return
        fee = self._fee(name, qty, price)
        self.cash -= side * qty * price + fee
        risk = abs(price - first) if first is not None else None
        goal = target if target is not None else cfg.target.price(side, price, risk, s.atr)
        trailing = stop is None and cfg.stop.trailing
        s.position = _Position(side, qty, price, ts, fee, None if trailing else first, first if trailing else None, goal)

    def _close(self, name: str, s: _Symbol, price: float, ts, reason: str, qty: int | None = None) -> tuple:
        p = s.position
        qty = p.qty if qty is None else qty
        price *= 1 - p.side * self.config.slippage_pct / 100
        fee = self._fee("SELL" if p.side > 0 else "BUY", qty, price)
        entry_fee = p.paid * qty / p.qty
        self.cash += p.side * qty * price - fee
        gross = p.side * qty * (price - p.entry)
        trade = (name, "LONG" if p.side > 0 else "SHORT", p.time, ts, p.entry, price, qty, gross, entry_fee + fee, gross - entry_fee - fee, p.bars, p.worst, p.best, reason)
        p.paid -= entry_fee
        p.qty -= qty
        if p.qty <= 0:
            s.position = None
        return trade

    def _trail(self, s: _Symbol, h: float, lo: float) -> None:
        p = s.position
        d = self.config.stop.distance(h if p.side > 0 else lo, s.atr)
        if p.trail is not None and d is not None:
            p.trail = max(p.trail, h - d) if p.side > 0 else min(p.trail, lo + d)

    def _exits(self, name: str, s: _Symbol, ts, o: float, h: float, lo: float) -> list[tuple]:
        """Fixed stop, trailing stop, time, target, in this order."""
        cfg, p, out = self.config, s.position, []
        p.bars += 1
        mid = p.side * ((h + lo) / 2 - p.entry)
        p.worst, p.best = min(p.worst, mid), max(p.best, mid)
        leave = "SELL" if p.side > 0 else "BUY"
        if p.stop is not None and (x := stop_fill(leave, p.stop, o, h, lo)) is not None:
            return [self._close(name, s, x, ts, "SL")]
        if not cfg.cautious_trailing:
            self._trail(s, h, lo)
        if p.trail is not None and (x := stop_fill(leave, p.trail, o, h, lo)) is not None:
            return [self._close(name, s, x, ts, "TRAILING_SL")]
        self._trail(s, h, lo)
        due = cfg.max_bars or (int(cfg.stop.value) if cfg.stop.kind == "TIME_BASED" else 0)
        if due and p.bars >= due:
            return [self._close(name, s, o, ts, "TIME")]
        if p.target is not None and (x := limit_fill(leave, p.target, o, h, lo)) is not None:
            part = int(p.qty * cfg.target.part // cfg.lot * cfg.lot) if cfg.target.kind == "PARTIAL_EXIT" else p.qty
            if 0 < part < p.qty:
                out.append(self._close(name, s, x, ts, "PARTIAL_TARGET", part))
                p.target = None
            else:
                out.append(self._close(name, s, x, ts, "TARGET"))
        return out

    def _waiting(self, s: _Symbol, ts, o: float, h: float, lo: float) -> None:
        w = s.order
        w["age"] += 1
        side, kind = w["side"], w["kind"]
        name = "BUY" if side > 0 else "SELL"
        price = None
        if kind == "AMO":
            price = o
        elif kind == "LIMIT":
            price = limit_fill(name, w["price"], o, h, lo)
        elif kind == "STOP":
            price = stop_fill(name, w["price"], o, h, lo)
        elif kind == "STOP_LIMIT":
            price, w["triggered"] = stop_limit_fill(name, w["price"], w["limit"], w["triggered"], o, h, lo)
        elif kind == "GTT":
            price = limit_fill(name, w["price"], o, h, lo)
        if price is not None:
            s.order = None
            self._open(s, side, price, ts, w["stop"], w["target"])
        elif kind != "GTT" and w["age"] >= self.config.expires:
            s.order = None

    def _signal(self, name: str, s: _Symbol, ts, o: float) -> list[tuple]:
        side, stop, target, close = s.pending_signal
        s.pending_signal, out, cfg = None, [], self.config
        if s.position and s.position.side != side:
            out.append(self._close(name, s, o, ts, "SIGNAL"))
        if not s.position:
            if cfg.order == "MARKET":
                self._open(s, side, o, ts, stop, target)
            else:
                away = close * cfg.order_pct / 100
                price = close + side * away if cfg.order.startswith("STOP") else close - side * away
                s.order = {"kind": cfg.order, "side": side, "price": price, "limit": price + side * close * 0.005, "stop": stop, "target": target, "age": 0, "triggered": False}
        return out

    def on_bar(self, name: str, ts, o, h, lo, c, signal, stop, target) -> list[tuple]:
        """Exits, waiting orders, squareoff, the signal of the bar before at this open, then the mark at the close."""
        if o is None or h is None or lo is None or c is None or o <= 0:
            return []
        cfg, s, out = self.config, self.symbols.setdefault(name, _Symbol()), []
        day = ts.date()
        if day != self.day:
            self.day, self.day_start = day, self.equity() if any(x.price for x in self.symbols.values()) else self.cash
        s.price = s.price or o
        if s.position:
            out += self._exits(name, s, ts, o, h, lo)
        if s.order:
            self._waiting(s, ts, o, h, lo)
        late = cfg.squareoff is not None and (ts.hour, ts.minute) >= (int(cfg.squareoff[:2]), int(cfg.squareoff[3:5]))
        if late:
            s.pending_signal = s.order = None
            if s.position:
                out.append(self._close(name, s, o, ts, "EOD"))
        elif s.pending_signal:
            out += self._signal(name, s, ts, o)
        self._atr(s, h, lo, c)
        s.price = c
        if signal:
            s.pending_signal = (int(signal), stop, target, c)
        worth = self.equity()
        self.peak = max(self.peak, worth)
        if cfg.max_drawdown and not self.halted and worth < self.peak * (1 - cfg.max_drawdown):
            self.halted = True
            for k, x in self.symbols.items():
                if x.position:
                    out.append(self._close(k, x, x.price, ts, "DRAWDOWN"))
        return out

    def close_all(self, ts) -> list[tuple]:
        return [self._close(k, x, x.price, ts, "END") for k, x in self.symbols.items() if x.position]


def simulate(signals: DataFrame, config: Config | dict[str, Config] = Config(), account: list[str] | None = None) -> DataFrame:
    """A row for each bar and account: account columns, ts, symbol, equity, drawdown, cash, trades (those that the bar closes).

    signals: bars with signal, stop_loss, take_profit. account: what an account is, ['symbol'] by default. config may differ
    by the value of the first account column.
    """
    keys = account or ["symbol"]
    fields = [signals.schema[k] for k in keys]
    own = [] if "symbol" in keys else [signals.schema["symbol"]]
    trades = T.StructField("trades", T.ArrayType(T.StructType.fromDDL(TRADE)))
    schema = T.StructType([*fields, *own, signals.schema["ts"], *T.StructType.fromDDL("equity double, drawdown double, cash double"), trades, T.StructField("is_last", T.BooleanType())])
    cols = ["symbol", "ts", "open", "high", "low", "close", "signal", "stop_loss", "take_profit"]
    want = list(dict.fromkeys([*keys, *cols]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _stream(batches, keys, config, schema.names)

    d = signals.select(*want).repartition(*keys).sortWithinPartitions(*keys, "ts", "symbol")
    return d.mapInPandas(run, schema)


def _clean(column: pd.Series) -> list:
    return [None if x is None or x != x else x for x in column.tolist()]


def _stream(batches: Iterator[pd.DataFrame], keys: list[str], config: Config | dict[str, Config], names: list[str]) -> Iterator[pd.DataFrame]:
    current, book, held = None, None, None  # held: the row before, which may be its account's last
    pick = partial(dict.get, config) if isinstance(config, dict) else lambda _: config

    def row(at: tuple, symbol: str, ts, closed: list[tuple], last: bool) -> dict:
        worth = book.equity()
        return dict(zip(keys, at, strict=True)) | {"symbol": symbol, "ts": ts, "equity": worth, "drawdown": (worth - book.peak) / book.peak, "cash": book.cash, "trades": [dict(zip(_NAMES, x, strict=True)) for x in closed], "is_last": last}

    def ended() -> dict:
        at, symbol, ts, closed, _ = held
        return row(at, symbol, ts, closed + book.close_all(ts), True)

    for batch in batches:
        columns, out = {c: _clean(batch[c]) for c in batch.columns}, []
        for i in range(len(batch)):
            at = tuple(columns[k][i] for k in keys)
            if at != current:
                if held:
                    out.append(ended())
                current, book, held = at, Account(pick(at[0])), None
            if held:
                out.append(held[4])
            symbol, ts, *rest = (columns[c][i] for c in ("symbol", "ts", "open", "high", "low", "close", "signal", "stop_loss", "take_profit"))
            closed = book.on_bar(symbol, ts, *rest)
            held = (at, symbol, ts, closed, row(at, symbol, ts, closed, False))
        yield pd.DataFrame(out, columns=names)
    if held:
        yield pd.DataFrame([ended()], columns=names)


def trades(result: DataFrame) -> DataFrame:
    keys = [c for c in result.columns if c not in ("symbol", "ts", "equity", "drawdown", "cash", "trades", "is_last")]
    return result.select(*keys, F.explode("trades").alias("t")).select(*keys, "t.*")
