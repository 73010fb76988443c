import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import fold as folds
from tickloom.plans import backtest, rules, strategies
from tickloom.functions.pricing import PARTS, RATES, Stop, charges, limit_fill, quantity, stop_fill, stop_limit_fill, with_charges
from tickloom.operators import joins, pairs
from tickloom.operators.resample import resample
from tickloom.sources import store, tables
from tickloom.functions import indicators, levels, swings


def bars(spark, closes, symbol="a", start=dt.datetime(2024, 1, 1, 9, 15), step=dt.timedelta(hours=1)):
    rows = [(symbol, start + i * step, c, None if c is None else c + 1.0, None if c is None else c - 1.0, c, 10, 0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint, oi bigint")


def test_smoothing_is_that_of_pandas_with_gaps():
    x = pd.Series([1.0, None, 3.0, 4.0, None, None, 2.0, 8.0])
    for adjust, node in ((False, folds.Smoother(0.3, 2)), (True, folds.AdjustedSmoother(0.3, 2))):
        want = x.ewm(alpha=0.3, adjust=adjust, min_periods=2).mean().to_numpy()
        for cut in range(9):
            state, by_map = node.start, node.start
            parts = [p for p in (x.to_numpy()[:cut], x.to_numpy()[cut:]) if len(p)]
            got = []
            for p in parts:
                made, state = node.replay(state, p)
                by_map = node.advance(by_map, node.summary(p))
                got.append(made[""])
                assert np.allclose(state, by_map, equal_nan=True)
            assert np.allclose(np.concatenate(got), want, equal_nan=True)


def _band(top, last, u=float("inf")):
    out = []
    for t, c in zip(top, last, strict=True):
        u = t if t == t and (t < u or c == c and c > u) else u
        out.append(u)
    return out


def test_band_and_machine_are_those_of_a_loop():
    r = np.random.default_rng(5)
    for trial in range(60):
        n = int(r.integers(1, 90))
        top = np.round(np.cumsum(r.normal(size=n)) + 3, 1)
        last = np.round(top - 3 + r.normal(scale=3, size=n), 1)
        top[r.random(n) < 0.1], last[r.random(n) < 0.1] = np.nan, np.nan
        for u in (np.inf, 0.0, float(np.round(np.nanmedian(np.append(top, 1.0)), 1))):
            made, state = folds.Band().replay(u, top, last)
            want = _band(top, last, u)
            assert made[""].tolist() == want and state == want[-1]
            assert folds.Band().advance(u, folds.Band().summary(top, last)) == want[-1]
        a, b, c, d = (r.random(n) < 0.2 for _ in range(4))
        for side in (-1, 0, 1):
            state, want = side, []
            for i in range(n):
                state = 1 if state <= 0 and a[i] else -1 if state >= 0 and b[i] else 0 if state > 0 and c[i] or state < 0 and d[i] else state
                want.append(state)
            table = folds.positions(a, b, c, d)
            assert folds.Machine().replay(side, table)[0][""].tolist() == want and folds.Machine().advance(side, folds.Machine().summary(table)) == want[-1]


def walk(spark, lengths, gaps=0.03):
    """Bars of symbols of given lengths, some prices missing."""
    r, rows = np.random.default_rng(9), []
    for k, n in enumerate(lengths):
        close = np.round(50 + np.cumsum(r.normal(size=n)), 2)
        for i in range(n):
            c = float(close[i]) if r.random() > gaps else None
            rows.append((f"s{k}", dt.datetime(2024, 1, 1) + i * dt.timedelta(hours=1), c, float(close[i] + r.random()), float(close[i] - r.random()), c, None if i % 9 == 0 else 2**60 + i, 0))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint, oi bigint")


def _same(a, b):
    def value(x):
        return round(x, 9) if isinstance(x, float) else x

    a, b = (sorted(tuple(map(value, r)) for r in x.collect()) for x in (a, b))
    assert a == b and a


def test_a_long_symbol_is_cut_into_tasks_without_a_trace(spark):
    b = walk(spark, [700, 3, 1, 40, 0, 2])
    every = [
        folds.ema("close", 5, "e"), folds.ema("close", 5, "ea", adjust=True), folds.dema("close", 4, "de"), folds.rsi("close", 6), folds.macd("close", 3, 7, 4), folds.atr(5), folds.atr_seeded(6), folds.adx(5),
        folds.supertrend(5, 1.5),
    ]
    lagged = ("e", "macd_line", "supertrend_direction")
    whole = folds.fold(b, *every, number="n", lagged=lagged, parts=1)
    made = folds.fold(b, *every, number="n", lagged=lagged, parts=9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        small = folds.fold(b, *every, number="n", lagged=lagged, parts=9)
        _same(small, whole)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    _same(made, whole)
    tasks = made.where("symbol = 's0'").groupBy(F.spark_partition_id()).count().count()
    assert tasks >= 5
    assert made.agg(F.max("volume")).first()[0] > 2**60  # beside nulls, and not rounded
    rows = made.where("symbol = 's0'").orderBy("ts").collect()
    assert [r.n for r in rows] == list(range(1, 701)) and [r.e_1 for r in rows[1:]] == [r.e for r in rows[:-1]]
    want = pd.Series([r.close for r in rows], dtype=float).ewm(span=5, adjust=False, min_periods=5).mean()
    assert np.allclose([np.nan if r.e is None else r.e for r in rows], want, equal_nan=True)


def test_strategies_don_t_see_the_cuts(spark, monkeypatch):
    b = walk(spark, [500, 20], gaps=0).withColumn("benchmark_close", F.col("close") * 2 + F.hour("ts"))
    made = (strategies.EmaCrossover(3, 8), strategies.MacdCrossover(3, 7, 4), strategies.RsiReversion(5), strategies.BollingerSqueeze(6, 1.0, 6, 2.0), strategies.SupertrendFlip(5, 1.0), strategies.StrengthRsiTrend(10, 5, 50.0, 5, 1.0))
    plain = folds.fold
    for s in made:
        monkeypatch.setattr(folds, "fold", lambda *a, **k: plain(*a, **k, parts=1))
        whole = s.signals(b)
        monkeypatch.setattr(folds, "fold", lambda *a, **k: plain(*a, **k, parts=8))
        cut = s.signals(b)
        _same(cut, whole)
        assert whole.where("signal <> 0").count() > 3, s


def test_flat_prices_never_cross(spark):
    b = bars(spark, [1.1] * 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert folds.fold(b, folds.ema("close", 7, "e"), parts=4).where("e <> 1.1").count() == 0
        assert strategies.EmaCrossover(3, 8).signals(b).where("signal <> 0").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_folds_of_nothing_and_of_ties(spark):
    b = walk(spark, [5])
    assert folds.fold(b.where("false"), folds.ema("close", 2, "e"), number="n").collect() == []
    twice = b.unionByName(b)
    assert folds.fold(twice, folds.supertrend(2), parts=4).count() == 10
    none = b.withColumn("symbol", F.lit(None).cast("string"))
    assert folds.fold(none, folds.ema("close", 2, "e"), parts=3).where("e is not null").count() > 0


def test_rsi_extremes(spark):
    for closes, want in (([5.0] * 20, 0.0), ([float(i) for i in range(1, 21)], 100.0), ([float(i) for i in range(40, 20, -1)], 0.0)):
        last = folds.fold(bars(spark, closes), folds.rsi("close", 14)).orderBy("ts").collect()[-1]
        assert last.rsi == want


def test_state_carries_over_batches_and_not_over_symbols(spark):
    b = bars(spark, [float(i % 7) for i in range(300)], "a").unionByName(bars(spark, [float(i % 5) for i in range(300)], "b"))
    made = folds.fold(b, folds.ema("close", 5, "e"))
    whole = sorted(made.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        _same(folds.fold(b, folds.ema("close", 5, "e")), made)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r.e is None for r in whole if r.symbol == "b" and r.ts < dt.datetime(2024, 1, 1, 13, 15))


def test_values_don_t_change_when_later_bars_come(spark, sf):
    b = tables.bars_hourly(spark, sf).where("symbol = 'click'")
    cut = b.where("ts < timestamp_ntz'2024-01-20 00:00:00'")
    rule = {"type": "or", "rules": [{"type": "supertrend", "condition": "flip_bullish"}, {"type": "trend"}, {"type": "chart", "pattern": "double_top"}]}
    early = {tuple(r)[:2]: r.passed for r in rules.evaluate(cut, rule).collect()}
    late = {tuple(r)[:2]: r.passed for r in rules.evaluate(b, rule).collect()}
    assert early and all(late[k] == v for k, v in early.items())


def test_bad_parameters():
    with pytest.raises(ValueError):
        folds.macd("close", 26, 12)
    with pytest.raises(ValueError):
        folds.ema("close", 0, "e")
    with pytest.raises(ValueError):
        charges("EQUITY_DELIVERY", "HOLD", 1, 1)


def test_fills():
    assert limit_fill("BUY", 10, 9, 12, 8) == 9 and limit_fill("BUY", 10, 11, 12, 10) == 10 and limit_fill("BUY", 10, 11, 12, 10.5) is None
    assert limit_fill("SELL", 10, 11, 12, 9) == 11 and limit_fill("SELL", 10, 9, 10, 8) == 10
    assert stop_fill("BUY", 10, 11, 12, 9) == 11 and stop_fill("SELL", 10, 11, 12, 9) == 10 and stop_fill("SELL", 8, 11, 12, 9) is None
    assert stop_limit_fill("BUY", 10, 10.5, False, 9, 9.5, 8) == (None, False)
    assert stop_limit_fill("BUY", 10, 10.5, False, 9, 10.2, 8) == (10, True) and stop_limit_fill("BUY", 10, 10.5, False, 11, 12, 10.6) == (None, True)
    assert quantity(1000, 10, risk=0.1, stop=8) == 50 and quantity(1000, 10, fixed=500) == 100 and quantity(1000, 10, fixed=57, lot=10) == 50


def test_cash_is_kept_without_costs(spark):
    b = bars(spark, [float(x) for x in (10, 11, 12, 13, 12, 11, 10, 11, 12, 13, 14, 15, 13, 11, 9)] * 4)
    signals = strategies.EmaCrossover(2, 4).signals(b)
    config = backtest.Config(segment=None, slippage_pct=0, allow_short=True, stop=Stop(), fixed_quantity=10)
    result = backtest.simulate(signals, config).orderBy("ts").collect()
    made = sum(t.net_pnl for r in result for t in r.trades)
    assert any(r.trades for r in result) and abs(result[-1].equity - config.capital - made) < 1e-6 and result[-1].is_last
    assert all(t.exit_time > t.entry_time or t.exit_reason == "END" for r in result for t in r.trades)


def test_trailing_stops_only_tighten():
    account = backtest.Account(backtest.Config(segment=None, slippage_pct=0, stop=Stop("TRAILING_PCT", 5), fixed_quantity=1))
    t, stops = dt.datetime(2024, 1, 1), []
    for i, c in enumerate([100, 100, 104, 110, 108, 112, 111]):
        account.on_bar("a", t + dt.timedelta(hours=i), c, c + 1, c - 1, c, 1 if i == 0 else 0, None, None)
        p = account.symbols["a"].position
        stops.append(p.trail if p else None)
    seen = [x for x in stops if x is not None]
    assert seen == sorted(seen) and len(seen) > 3


def test_store(spark, tmp_path):
    b = bars(spark, [1.0, 2.0, 3.0])
    store.write_bars(b, f"{tmp_path}/bars", "1h")
    store.write_bars(bars(spark, [9.0], start=dt.datetime(2024, 1, 1, 10, 15)), f"{tmp_path}/bars", "1h")
    assert [r.close for r in store.read_bars(spark, f"{tmp_path}/bars", "1h", ["a"], "2024-01-01", "2024-01-01").orderBy("ts").collect()] == [1.0, 9.0, 3.0]
    assert store.missing_ranges(None, None, dt.date(2024, 1, 1), dt.date(2024, 1, 9)) == [(dt.date(2024, 1, 1), dt.date(2024, 1, 9))]
    assert store.missing_ranges(dt.date(2024, 1, 4), dt.date(2024, 1, 7), dt.date(2024, 1, 1), dt.date(2024, 1, 9)) == [(dt.date(2024, 1, 8), dt.date(2024, 1, 9))]


def test_weekend_bars_go_to_friday(spark):
    b = bars(spark, [1.0, 2.0, 3.0, 4.0], start=dt.datetime(2024, 1, 5), step=dt.timedelta(days=1))
    assert [(str(r.ts)[:10], r.close) for r in resample(b, "1b").orderBy("ts").collect()] == [("2024-01-05", 3.0), ("2024-01-08", 4.0)]


def test_double_top(spark):
    rise = lambda a, b: [a + (b - a) * k / 8 for k in range(8)]
    path = rise(10, 20) + rise(20, 15) + rise(15, 20.1) + rise(20.1, 8)
    got = swings.with_charts(bars(spark, path), 5).where("double_top <> 0").collect()
    assert [r.double_top for r in got] == [-1]


@pytest.mark.parametrize("closes", [[5.0] * 30, [0.0] * 30, [7.0], [float(i % 2) for i in range(30)]])
def test_flat_zero_and_single_bars(spark, closes):
    b = bars(spark, closes)
    got = b.select(indicators.rolling_correlation(F.col("close"), F.col("volume").cast("double"), 5).alias("r")).collect()
    assert {r.r for r in got} == {None}
    both = b.unionByName(bars(spark, [float(i) for i in range(len(closes))], "b")).select("symbol", "ts", F.col("close").alias("r"))
    assert {(r.a, r.b): r.corr for r in joins.correlation_matrix(both).collect()}["a", "a"] == 1.0
    assert rules.evaluate(b, {"type": "near_support", "levels": [5.0, 0.0]}).count() == len(closes)
    levels.near_price(b.select("close", F.lit(3.0).alias("price")), "close").collect()
    for rule in ({"type": "rsi"}, {"type": "macd"}, {"type": "adx"}, {"type": "bollinger_squeeze"}, {"type": "vwap"}, {"type": "supertrend"}, {"type": "accumulation"}):
        assert rules.evaluate(b, rule).count() == len(closes)


def test_charges_are_the_same_as_columns_and_alone(spark):
    orders = [(seg, side, float(q), p) for seg in RATES for side in ("BUY", "SELL") for q in (1, 7, 50, 333) for p in (0.05, 10.0, 99.95, 1234.5, 20.25)]
    got = with_charges(spark.createDataFrame(orders, "segment string, side string, quantity double, price double")).collect()
    assert len(got) == len(orders)
    for r in got:
        assert {k: r[k] for k in (*PARTS, "total")} == charges(r.segment, r.side, r.quantity, r.price)


def test_unknown_stops_and_ranks_are_rejected(spark):
    with pytest.raises(ValueError):
        Stop("SWING_LOW")
    with pytest.raises(ValueError):
        rules.rank(spark.range(1), "COLOUR")


def test_rank_by_a_rule_s_value(spark):
    b = bars(spark, [1.0, 5.0], "a").unionByName(bars(spark, [9.0, 3.0], "b")).unionByName(bars(spark, [2.0, 4.0], "c"))
    scan = rules.scan_eod(b, {"type": "price_range", "min_price": 1, "name": "rs_score"})
    assert [r.symbol for r in rules.rank(scan, "RS_SCORE").collect()] == ["a", "c", "b"]
    assert [r.symbol for r in rules.rank(scan, "SIGNAL_STRENGTH", limit=2).collect()] == ["a", "b"]


def plain_unit_root(x):
    """The statistic by least squares over plain tables of lags."""
    d = np.diff(x)
    most = min(len(x) // 2 - 2, int(np.ceil(12 * (len(x) / 100) ** 0.25)))

    def fit(lags, skip):
        rows = range(max(lags, skip), len(d))
        z = np.array([[1.0, x[t], *(d[t - k] for k in range(1, lags + 1))] for t in rows])
        y = np.array([d[t] for t in rows])
        b, *_ = np.linalg.lstsq(z, y, rcond=None)
        return z, b, float(((y - z @ b) ** 2).sum()), len(y)

    score = lambda lags: (lambda z, b, rest, n: n * np.log(rest / n) + 2 * z.shape[1])(*fit(lags, most))
    z, b, rest, n = fit(min(range(most + 1), key=score), 0)
    return b[1] / np.sqrt(rest / (n - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1])


def test_cointegration(spark):
    r = np.random.default_rng(4)
    walk = np.cumsum(r.normal(size=400)) + 50
    noise, x = r.normal(size=400), [0.0]
    for e in noise[1:]:
        x.append(0.6 * x[-1] + e)
    series = {"a": 3 + 2 * walk + np.array(x), "b": walk, "c": np.cumsum(r.normal(size=400)) + 50}
    b = bars(spark, series["a"].tolist(), "a")
    for k in "bc":
        b = b.unionByName(bars(spark, series[k].tolist(), k))
    b = b.unionByName(bars(spark, [1.0] * 10, "short"))
    wanted = spark.createDataFrame([("a", "b"), ("c", "b"), ("a", "short"), ("a", "none")], "a string, b string")
    aligned = pairs.align_pairs(b, wanted)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {(x.a, x.b): x for x in pairs.cointegration(aligned).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {("a", "b"), ("c", "b")}
    for (p, q), g in got.items():
        slope, cut = np.polyfit(series[q], series[p], 1)
        assert abs(g.hedge_ratio - slope) < 1e-6 and abs(g.adf_statistic - plain_unit_root(series[p] - slope * series[q] - cut)) < 1e-4
    assert got["a", "b"].is_cointegrated and not got["c", "b"].is_cointegrated
    # The published critical values of the test with a constant.
    assert abs(pairs.p_value(-2.86) - 0.05) < 0.002 and abs(pairs.p_value(-3.43) - 0.01) < 0.001 and abs(pairs.p_value(-2.57) - 0.10) < 0.002


def test_the_store_is_cleared_by_symbol_and_timeframe(spark, tmp_path):
    path = f"file://{tmp_path}/bars"
    store.write_bars(bars(spark, [1.0, 2.0], "a b").unionByName(bars(spark, [3.0], "c")), path, "1h")
    store.write_bars(bars(spark, [4.0], "c"), path, "1d")
    store.clear(spark, path, "1h", ["a b"])
    left = lambda t: [(r.symbol, r.close) for r in store.read_bars(spark, path, t).collect()]
    assert left("1h") == [("c", 3.0)] and left("1d") == [("c", 4.0)]
    store.clear(spark, path, "1h")
    assert left("1h") == [] and left("1d") == [("c", 4.0)]
