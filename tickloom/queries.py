"""The registered queries over the test tables, and the same in SQL for DuckDB where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql as q
from .functions import candles as cs
from .functions import indicators as ind
from .functions import levels, pricing, swings
from .operators import fold as folds
from .operators import joins, pairs, quality, touch
from .operators.calendar import with_trading_days
from .operators.keep import shared_dir
from .operators.resample import between_dates, opening_range, period_start, resample, within_hours
from .operators.windows import W as ordered
from .operators.windows import latest, with_run_length
from .plans import backtest, performance, rules, search
from .plans.strategies import STRATEGIES, BollingerSqueeze, EmaCrossover, confluence
from .sources import journal, store, tables
from .sql import ewm
from .streaming import live
from .streaming import ticks as tk

C = F.col
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

# --- bars in SQL -----------------------------------------------------------------------------------------------------

HOURLY = """bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, count(*) AS volume, 0::BIGINT AS oi FROM events WHERE value IS NOT NULL GROUP BY ALL)"""
DAILY = """bars AS (SELECT o_orderpriority AS symbol, o_orderdate::TIMESTAMP AS ts, first(o_totalprice::DOUBLE ORDER BY o_orderkey) AS open, max(o_totalprice::DOUBLE) AS high, min(o_totalprice::DOUBLE) AS low,
  last(o_totalprice::DOUBLE ORDER BY o_orderkey) AS close, count(*) AS volume, 0::BIGINT AS oi FROM orders GROUP BY ALL)"""
WIDE = """bars AS (SELECT l_suppkey::VARCHAR AS symbol, l_shipdate::TIMESTAMP AS ts, first(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open, max(p) AS high, min(p) AS low,
  last(p ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close, count(*) AS volume, 0::BIGINT AS oi FROM (SELECT *, l_extendedprice::DOUBLE / l_quantity::DOUBLE AS p FROM lineitem) GROUP BY ALL)"""
NUMBERED = "b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM bars)"
BENCH = "bench AS (SELECT ts, avg(close) AS benchmark_close FROM bars GROUP BY ts)"
W = "(PARTITION BY symbol ORDER BY ts)"


def w(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(n: int, f: str, x: str = "close") -> str:
    return f"CASE WHEN count({x}) OVER {w(n)} = {n} THEN {f} OVER {w(n)} END"


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*(F.when(F.round(c, n) == 0, F.lit(0.0)).otherwise(F.round(c, n)).alias(c) if t == "double" else C(c) for c, t in df.dtypes))


def r6(x: str, n: int = 6) -> str:
    return f"CASE WHEN round({x}, {n}) = 0 THEN 0.0::DOUBLE ELSE round({x}, {n}) END"


def register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def on_bars(name: str, made: Callable[[], dict[str, Column]] | Callable[[DataFrame], DataFrame], sql: dict[str, str] | None = None, *, before: str = "", out: tuple[str, ...] = (), source: Callable[[SparkSession, str], DataFrame] = tables.bars_hourly, bars: str = HOURLY, plain: tuple[str, ...] = ()) -> None:
    """Registers columns over bars: (symbol, ts, columns), doubles rounded to 6 places. made gives columns, or bars with the columns `out`."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        d = source(spark, sf_dir)
        if out:
            d = made(d).select("symbol", "ts", *out)
        else:
            d = d.select("symbol", "ts", *(x.alias(k) for k, x in made().items()))
        return rounded(d)

    text = None
    if sql:
        text = f"WITH RECURSIVE {bars}, {before + ', ' if before else ''}x AS (SELECT * FROM {'src' if 'src AS' in before else 'bars'}) SELECT symbol, ts, {', '.join((v if k in plain else r6(v)) + ' AS ' + k for k, v in sql.items())} FROM x"
    register(name, query, text)


# --- bars --------------------------------------------------------------------------------------------------------------

register("bars_hourly", tables.bars_hourly, f"WITH {HOURLY} SELECT * FROM bars")
register("bars_daily", tables.bars_daily, f"WITH {DAILY} SELECT * FROM bars")
register("bars_wide", tables.bars_wide, f"WITH {WIDE} SELECT * FROM bars")


def _resampled(label: str, source: str) -> str:
    return f"WITH {source} SELECT symbol, {label} AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume)::BIGINT AS volume, last(oi ORDER BY ts) AS oi FROM bars GROUP BY ALL"


register("resample_4h", lambda s, d: resample(tables.bars_hourly(s, d), "4h"), _resampled("time_bucket(INTERVAL 4 HOUR, bars.ts)", HOURLY))
register("resample_business_day", lambda s, d: resample(tables.bars_daily(s, d), "1b"), _resampled("(bars.ts::DATE - greatest(isodow(bars.ts)::INT - 5, 0))::TIMESTAMP", DAILY))
register("resample_weekly", lambda s, d: resample(tables.bars_daily(s, d), "1w"), _resampled("(bars.ts::DATE + (7 - isodow(bars.ts))::INT)::TIMESTAMP", DAILY))
register("resample_monthly", lambda s, d: resample(tables.bars_daily(s, d), "1mo"), _resampled("last_day(bars.ts)::TIMESTAMP", DAILY))
register("resample_3_days", lambda s, d: resample(tables.bars_daily(s, d), "3d"), f"""WITH {DAILY}, k AS (SELECT *, datediff('day', min(ts) OVER (PARTITION BY symbol), ts) // 3 AS k FROM bars)
SELECT symbol, min(ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume)::BIGINT AS volume, last(oi ORDER BY ts) AS oi FROM k GROUP BY symbol, k""")
register("date_range", lambda s, d: between_dates(tables.bars_hourly(s, d), "2024-01-05", "2024-01-09"), f"WITH {HOURLY} SELECT * FROM bars WHERE ts >= '2024-01-05' AND ts < '2024-01-10'")

# --- window indicators ---------------------------------------------------------------------------------------------------

on_bars("sma", lambda: {"sma": ind.sma(C("close"), 20)}, {"sma": full(20, "avg(close)")})
on_bars("wma", lambda: {"wma": ind.wma(C("close"), 10)}, {"wma": "(" + " + ".join(f"{10 - k} * {'close' if not k else f'lag(close, {k}) OVER {W}'}" for k in range(10)) + ") / 55.0"})
on_bars("roc", lambda: {"roc": ind.roc(C("close"), 12)}, {"roc": f"100 * (close / nullif(lag(close, 12) OVER {W}, 0) - 1)"})
on_bars("true_range", lambda: {"tr": ind.true_range()}, {"tr": f"greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W}))"})
DAY = "(PARTITION BY symbol, ts::DATE ORDER BY ts)"
on_bars("vwap", lambda: {"vwap": ind.vwap()}, {"vwap": f"sum((high + low + close) / 3 * volume) OVER {DAY} / nullif(sum(volume) OVER {DAY}, 0)"})
on_bars("zscore", lambda: {"z": ind.zscore(C("close"), 20)}, {"z": f"(close - {full(20, 'avg(close)')}) / nullif({full(20, 'stddev_samp(close)')}, 0)"})
on_bars("rolling_correlation", lambda: {"corr": ind.rolling_correlation(C("close"), C("volume").cast("double"), 20)}, {"corr": f"{full(20, 'covar_samp(close, volume)')} / nullif(stddev_samp(close) OVER {w(20)} * stddev_samp(volume) OVER {w(20)}, 0)"})
on_bars("rolling_beta", lambda: {"beta": ind.rolling_beta(C("close"), C("open"), 20)}, {"beta": f"{full(20, 'covar_samp(close, open)')} / nullif({full(20, 'var_samp(open)')}, 0)"})
on_bars("spread", lambda: {"spread": ind.spread(C("close"), C("open"), 1.5)}, {"spread": "close - 1.5 * open"})
on_bars("crossovers", lambda: {
    "over": ind.crossover(C("close"), C("open")), "under": ind.crossunder(C("close"), C("open")), "above": ind.above_threshold(C("close"), 50.0), "below": ind.below_threshold(C("close"), 50.0)},
    {"over": f"coalesce(close > open AND lag(close) OVER {W} <= lag(open) OVER {W}, false)", "under": f"coalesce(close < open AND lag(close) OVER {W} >= lag(open) OVER {W}, false)",
     "above": f"coalesce(close > 50 AND lag(close) OVER {W} <= 50, false)", "below": f"coalesce(close < 50 AND lag(close) OVER {W} >= 50, false)"}, plain=("over", "under", "above", "below"))
on_bars("bollinger", ind.with_bollinger, {"bb_mid": "mid", "bb_upper": "mid + 2 * sd", "bb_lower": "mid - 2 * sd", "bb_percent_b": "(close - (mid - 2 * sd)) / nullif(4 * sd, 0)", "bb_bandwidth": "4 * sd / nullif(mid, 0)"},
        before=f"src AS (SELECT *, {full(20, 'avg(close)')} AS mid, {full(20, 'stddev_samp(close)')} AS sd FROM bars)", out=("bb_mid", "bb_upper", "bb_lower", "bb_percent_b", "bb_bandwidth"))
on_bars("stochastic", ind.with_stochastic, {"stoch_k": "k", "stoch_d": full(3, "avg(k)", "k")}, before=f"""
r AS (SELECT *, {full(14, 'min(low)', 'low')} AS ll, {full(14, 'max(high)', 'high')} AS hh FROM bars), q AS (SELECT *, 100 * (close - ll) / nullif(hh - ll, 0) AS raw FROM r), src AS (SELECT *, {full(3, 'avg(raw)', 'raw')} AS k FROM q)""", out=("stoch_k", "stoch_d"))
on_bars("cci", ind.with_cci, {"cci": "(tp - m) / nullif(0.015 * list_sum(list_transform(l, lambda v: abs(v - m))) / 20, 0)"}, before=f"t AS (SELECT *, (high + low + close) / 3 AS tp FROM bars), src AS (SELECT *, {full(20, 'avg(tp)', 'tp')} AS m, array_agg(tp) OVER {w(20)} AS l FROM t)", out=("cci",))
on_bars("obv", ind.with_obv, {"obv": f"sum(m) OVER {W}"}, before=f"src AS (SELECT *, coalesce(sign(close - lag(close) OVER {W}) * volume, 0) AS m FROM bars)", out=("obv",))
on_bars("atr_simple", ind.with_atr_simple, {"atr_simple": full(14, "avg(tr)", "tr")}, before=f"src AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS tr FROM bars)", out=("atr_simple",))
_with_bench = lambda d: joins.with_benchmark(d, tables.benchmark(d))
_JOINED = f"{BENCH}, j AS (SELECT bars.*, benchmark_close FROM bars JOIN bench USING (ts))"
on_bars("mansfield", lambda d: ind.with_mansfield(_with_bench(d)), {"mansfield": f"100 * (r / nullif({full(55, 'avg(r)', 'r')}, 0) - 1)"}, before=f"{_JOINED}, src AS (SELECT *, close / nullif(benchmark_close, 0) AS r FROM j)", out=("mansfield",))
on_bars("relative_strength", lambda d: _with_bench(d).withColumn("rs", ind.relative_strength(C("close"), C("benchmark_close"), 55)), {"rs": f"(close / nullif(lag(close, 55) OVER {W}, 0)) / nullif(benchmark_close / nullif(lag(benchmark_close, 55) OVER {W}, 0), 0) - 1"}, before=f"{_JOINED}, src AS (SELECT * FROM j)", out=("rs",))
on_bars("run_length", lambda d: with_run_length(d, C("close") > C("open"), "run"), {"run": f"(rn - coalesce(max(CASE WHEN NOT close > open THEN rn END) OVER {W}, 0))::INTEGER"}, before=f"{NUMBERED}, src AS (SELECT * FROM b)", out=("run",), plain=("run",))
register("half_life", lambda s, d: rounded(ind.half_life(tables.bars_hourly(s, d), "close")), f"""WITH {HOURLY}, l AS (SELECT symbol, close - lag(close) OVER {W} AS d, lag(close) OVER {W} AS x FROM bars),
g AS (SELECT symbol, regr_slope(d, x) AS k, count(*) AS n FROM l WHERE d IS NOT NULL GROUP BY symbol) SELECT symbol, CASE WHEN n < 30 OR k IS NULL OR k >= 0 THEN 'inf'::DOUBLE ELSE round(-ln(2.0::DOUBLE) / k, 6) END AS half_life FROM g""")

# --- folds -----------------------------------------------------------------------------------------------------------


def _fold(name: str, f: folds.Fold, out: tuple[str, ...], sql: dict[str, str] | None = None, before: str = "", plain: tuple[str, ...] = ()) -> None:
    on_bars(name, lambda d: folds.fold(d, f), sql, before=before, out=out, plain=plain)


_TR = f"tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS x FROM b)"
_fold("ema", folds.ema("close", 20, "ema"), ("ema",), {"ema": "CASE WHEN rn >= 20 THEN y END"}, f"{NUMBERED}, {ewm('e', 'b', 'close', 2 / 21)}, src AS (SELECT b.*, y FROM b JOIN e USING (symbol, rn))")
_fold("dema", folds.dema("close", 10, "dema"), ("dema",), {"dema": "2 * y - z"}, f"{NUMBERED}, {ewm('e', 'b', 'close', 2 / 11)}, {ewm('f', 'e', 'y', 2 / 11, 10)}, src AS (SELECT b.*, e.y, CASE WHEN rn >= 19 THEN f.y END AS z FROM b JOIN e USING (symbol, rn) LEFT JOIN f USING (symbol, rn))")
_fold("macd", folds.macd("close"), ("macd_line", "macd_signal", "macd_histogram"), {"macd_line": "line", "macd_signal": "CASE WHEN rn >= 34 THEN sig END", "macd_histogram": "CASE WHEN rn >= 34 THEN line - sig END"},
      f"{NUMBERED}, {ewm('e', 'b', 'close', 2 / 13)}, {ewm('f', 'b', 'close', 2 / 27)}, l AS (SELECT symbol, rn, e.y - f.y AS line FROM e JOIN f USING (symbol, rn) WHERE rn >= 26), {ewm('g', 'l', 'line', 2 / 10, 26)}, src AS (SELECT b.*, line, g.y AS sig FROM b LEFT JOIN l USING (symbol, rn) LEFT JOIN g USING (symbol, rn))")
_fold("rsi", folds.rsi("close", 14, "rsi"), ("rsi",), {"rsi": "CASE WHEN rn >= 15 THEN CASE WHEN up.y = 0 THEN 0 WHEN dn.y = 0 THEN 100 ELSE 100 - 100 / (1 + up.y / dn.y) END END".replace("up.y", "u").replace("dn.y", "n")},
      f"{NUMBERED}, d AS (SELECT *, greatest(close - lag(close) OVER {W}, 0) AS g, greatest(lag(close) OVER {W} - close, 0) AS l FROM b), {ewm('up', 'd', 'g', 1 / 14, 2)}, {ewm('dn', 'd', 'l', 1 / 14, 2)}, src AS (SELECT b.*, up.y AS u, dn.y AS n FROM b LEFT JOIN up USING (symbol, rn) LEFT JOIN dn USING (symbol, rn))")
_fold("atr", folds.atr(14, "atr"), ("atr",), {"atr": "CASE WHEN rn >= 14 THEN y END"}, f"{NUMBERED}, {_TR}, {ewm('e', 'tr', 'x', 1 / 14)}, src AS (SELECT b.*, y FROM b JOIN e USING (symbol, rn))")
_fold("atr_seeded", folds.atr_seeded(14, "atr"), ("atr",), {"atr": "y"}, f"{NUMBERED}, {_TR}, seed AS (SELECT symbol, rn, CASE WHEN rn = 15 THEN avg(x) OVER {w(14)} ELSE x END AS x FROM (SELECT * FROM tr) q), {ewm('e', 'seed', 'x', 1 / 14, 15)}, src AS (SELECT b.*, y FROM b LEFT JOIN e USING (symbol, rn))".replace("FROM (SELECT * FROM tr) q", "FROM tr"))
_fold("adx", folds.adx(14, "adx"), ("adx", "adx_plus_di", "adx_minus_di"), {"adx": "CASE WHEN rn >= 27 THEN z END", "adx_plus_di": "p", "adx_minus_di": "m"},
      f"""{NUMBERED}, {_TR}, mv AS (SELECT *, coalesce(CASE WHEN high - lag(high) OVER {W} > lag(low) OVER {W} - low AND high - lag(high) OVER {W} > 0 THEN high - lag(high) OVER {W} END, 0) AS up,
      coalesce(CASE WHEN lag(low) OVER {W} - low > high - lag(high) OVER {W} AND lag(low) OVER {W} - low > 0 THEN lag(low) OVER {W} - low END, 0) AS dn FROM tr), {ewm('t', 'mv', 'x', 1 / 14)}, {ewm('pu', 'mv', 'up', 1 / 14)}, {ewm('pd', 'mv', 'dn', 1 / 14)},
      di AS (SELECT symbol, rn, CASE WHEN rn >= 14 THEN 100 * pu.y / nullif(t.y, 0) END AS p, CASE WHEN rn >= 14 THEN 100 * pd.y / nullif(t.y, 0) END AS m FROM t JOIN pu USING (symbol, rn) JOIN pd USING (symbol, rn)),
      dx AS (SELECT *, 100 * abs(p - m) / nullif(p + m, 0) AS d FROM di), {ewm('ax', 'dx', 'd', 1 / 14, 14)}, src AS (SELECT b.*, p, m, ax.y AS z FROM b JOIN di USING (symbol, rn) LEFT JOIN ax USING (symbol, rn))""")  # fmt: skip
_fold("supertrend", folds.supertrend(10, 3.0, "st"), ("st", "st_direction"), {"st": "CASE WHEN rn >= 10 THEN CASE WHEN side = 1 THEN lo ELSE up END END", "st_direction": "coalesce(side, 0)::INTEGER"},
      f"""{NUMBERED}, {_TR}, {ewm('e', 'tr', 'x', 1 / 10)}, k AS (SELECT b.*, (high + low) / 2 + 3 * y AS bu, (high + low) / 2 - 3 * y AS bl, lag(close) OVER {W} AS pc FROM b JOIN e USING (symbol, rn)),
      s AS (SELECT symbol, rn, bu AS up, bl AS lo, 1 AS side FROM k WHERE rn = 10 UNION ALL SELECT symbol, rn, up, lo, CASE WHEN side = -1 AND close > up THEN 1 WHEN side = 1 AND close < lo THEN -1 ELSE side END FROM
        (SELECT k.symbol, k.rn, k.close, s.side, CASE WHEN k.bu < s.up OR k.pc > s.up THEN k.bu ELSE s.up END AS up, CASE WHEN k.bl > s.lo OR k.pc < s.lo THEN k.bl ELSE s.lo END AS lo FROM s JOIN k ON k.symbol = s.symbol AND k.rn = s.rn + 1)),
      src AS (SELECT b.*, up, lo, side FROM b LEFT JOIN s USING (symbol, rn))""", plain=("st_direction",))  # fmt: skip


def _keltner(d: DataFrame) -> DataFrame:
    d = folds.fold(ind.with_bollinger(d), folds.ema("close", 20, "_e"), folds.atr(10, "_a"))
    return ind.with_keltner(d, "_e", "_a", 1.5).withColumn("squeeze", ind.squeeze())


on_bars("keltner_squeeze", _keltner, {"kc_upper": "m + 1.5 * a", "kc_lower": "m - 1.5 * a", "squeeze": "coalesce(mid + 2 * sd < m + 1.5 * a AND mid - 2 * sd > m - 1.5 * a, false)"}, before=f"""{NUMBERED}, {_TR}, {ewm('e', 'b', 'close', 2 / 21)}, {ewm('f', 'tr', 'x', 1 / 10)},
src AS (SELECT b.*, CASE WHEN rn >= 20 THEN e.y END AS m, CASE WHEN rn >= 10 THEN f.y END AS a, {full(20, 'avg(close)')} AS mid, {full(20, 'stddev_samp(close)')} AS sd FROM b JOIN e USING (symbol, rn) JOIN f USING (symbol, rn))""", out=("kc_upper", "kc_lower", "squeeze"), plain=("squeeze",))

# --- patterns ----------------------------------------------------------------------------------------------------------


_CANDLE_SQL = f"WITH {HOURLY}, {q.CANDLE_BARS} SELECT symbol, ts, {', '.join(f'CASE WHEN {a} THEN 1 WHEN {b} THEN -1 ELSE 0 END::INTEGER AS {k}' for k, (a, b) in q.CANDLES.items())} FROM cb"
register("candles_all", lambda s, d: cs.with_candles(tables.bars_hourly(s, d)).select("symbol", "ts", *cs.PATTERNS), _CANDLE_SQL)
_AROUND = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)"
_SWING = f"sw AS (SELECT *, CASE WHEN count(*) OVER {_AROUND} = 11 AND high = max(high) OVER {_AROUND} THEN high END AS sh, CASE WHEN count(*) OVER {_AROUND} = 11 AND low = min(low) OVER {_AROUND} THEN low END AS sl FROM bars)"
on_bars("swings", swings.with_swings, {"swing_high": "sh", "swing_low": "sl", "swing_high_known": f"lag(sh, 5) OVER {W}", "swing_low_known": f"lag(sl, 5) OVER {W}"}, before=f"{_SWING}, src AS (SELECT * FROM sw)", out=("swing_high", "swing_low", "swing_high_known", "swing_low_known"))
_PREV = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
on_bars("trend_structure", swings.with_trend_structure, {"higher_high": "coalesce(sh > ph, false)", "lower_high": "coalesce(sh < ph, false)", "higher_low": "coalesce(sl > pl, false)", "lower_low": "coalesce(sl < pl, false)",
        "uptrend": "coalesce(lh = 1 AND ll = 1, false)", "downtrend": "coalesce(lh = -1 AND ll = -1, false)", "trend_change": "CASE WHEN lh = -1 AND ll = -1 THEN -1 WHEN lh = 1 AND ll = 1 THEN 1 ELSE 0 END::INTEGER"},
        before=f"""{_SWING}, p AS (SELECT *, last_value(sh IGNORE NULLS) OVER {_PREV} AS ph, last_value(sl IGNORE NULLS) OVER {_PREV} AS pl FROM sw),
        c AS (SELECT *, CASE WHEN sh > ph THEN 1 WHEN sh < ph THEN -1 END AS ch, CASE WHEN sl > pl THEN 1 WHEN sl < pl THEN -1 END AS c2 FROM p),
        src AS (SELECT *, last_value(ch IGNORE NULLS) OVER {W} AS lh, last_value(c2 IGNORE NULLS) OVER {W} AS ll FROM c)""",
        out=("higher_high", "lower_high", "higher_low", "lower_low", "uptrend", "downtrend", "trend_change"), plain=("higher_high", "lower_high", "higher_low", "lower_low", "uptrend", "downtrend", "trend_change"))
on_bars("market_phase", swings.with_market_phase, {"market_phase": "CASE WHEN close > a AND a <= b THEN 1 WHEN close > a AND a > b THEN 2 WHEN close < a AND a >= b THEN 3 WHEN close < a AND a < b THEN 4 ELSE 0 END::INTEGER"},
        before=f"src AS (SELECT *, {full(50, 'avg(close)')} AS a, {full(200, 'avg(close)')} AS b FROM bars)", out=("market_phase",), plain=("market_phase",))
_CHARTS = ", ".join(f"{x}::INTEGER AS {k}" for k, x in q.CHARTS.items())
for _n, _source, _bars in (("charts_all", tables.bars_hourly, HOURLY), ("charts_daily", tables.bars_daily, DAILY)):
    register(_n, lambda s, d, source=_source: swings.with_all_charts(source(s, d)).select("symbol", "ts", *swings.CHARTS, "pennant"), f"""WITH {_bars}, {q.charts(5, False, 'ch')}, {q.charts(3, False, 'nr')},
wide AS (SELECT symbol, ts, {_CHARTS} FROM ch), narrow AS (SELECT symbol, ts, {q.SYMMETRICAL}::INTEGER AS pennant FROM nr) SELECT wide.*, pennant FROM wide JOIN narrow USING (symbol, ts)""")

# --- levels ------------------------------------------------------------------------------------------------------------

_PIVOT_SQL = {
    "classic": {"P": "(h+l+c)/3", "R1": "2*(h+l+c)/3-l", "S1": "2*(h+l+c)/3-h", "R2": "(h+l+c)/3+h-l", "S2": "(h+l+c)/3-h+l", "R3": "(h+l+c)/3+2*(h-l)", "S3": "(h+l+c)/3-2*(h-l)"},
    "woodie": {"P": "(h+l+2*c)/4", "R1": "(h+l+2*c)/2-l", "S1": "(h+l+2*c)/2-h", "R2": "(h+l+2*c)/4+h-l", "S2": "(h+l+2*c)/4-h+l"},
    "camarilla": {f"{s}{k}": f"c{'+' if s == 'R' else '-'}(h-l)*1.1/{p}" for s in "RS" for k, p in ((1, 12), (2, 6), (3, 4), (4, 2))},
    "fibonacci": {"P": "(h+l+c)/3"} | {f"{s}{k}": f"(h+l+c)/3{'+' if s == 'R' else '-'}{p}*(h-l)" for s in "RS" for k, p in ((1, 0.382), (2, 0.618), (3, 1.0))},
    "demark": {"P": "x/4", "R1": "x/2-l", "S1": "x/2-h"},
}
for _m, _p in _PIVOT_SQL.items():
    register(f"pivots_{_m}", lambda s, d, m=_m: rounded(levels.pivot_levels(tables.bars_hourly(s, d), m)), f"""WITH {HOURLY}, l AS (SELECT symbol, ts, lag(open) OVER {W} AS o, lag(high) OVER {W} AS h, lag(low) OVER {W} AS l, lag(close) OVER {W} AS c FROM bars),
k AS (SELECT *, CASE WHEN c < o THEN h + 2 * l + c WHEN c > o THEN 2 * h + l + c ELSE h + l + 2 * c END AS x FROM l WHERE c IS NOT NULL) """ + " UNION ALL ".join(f"SELECT symbol, ts, '{n}' AS name, {r6(f'({e})::DOUBLE')} AS price FROM k" for n, e in _p.items()))  # fmt: skip
for _n, _every, _source, _bars, _label in (("weekly_pivots", "1w", tables.bars_hourly, HOURLY, "(bars.ts::DATE + (7 - isodow(bars.ts))::INT)"), ("monthly_pivots", "1mo", tables.bars_daily, DAILY, "last_day(bars.ts)")):
    register(_n, lambda s, d, source=_source, every=_every: rounded(levels.period_pivots(source(s, d), every)), f"""WITH {_bars}, pd AS (SELECT symbol, {_label} AS label, max(high) AS h, min(low) AS l, last(close ORDER BY ts) AS c FROM bars GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY label DESC) AS back FROM pd) WHERE back = 2) """ + " UNION ALL ".join(f"SELECT symbol, '{n}' AS name, {r6(f'({e})::DOUBLE')} AS price FROM k" for n, e in _PIVOT_SQL["classic"].items()))  # fmt: skip
_TAIL = "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) WHERE k <= {n})"
_FIB = ", ".join(map(str, levels.RETRACEMENTS))
register("auto_fibonacci", lambda s, d: rounded(levels.auto_fibonacci(tables.bars_hourly(s, d))), f"""WITH {HOURLY}, {_TAIL.format(n=50)}, g AS (SELECT symbol, max(high) AS h, min(low) AS l, first(ts ORDER BY high DESC, ts) AS ht, first(ts ORDER BY low, ts) AS lt FROM t GROUP BY symbol),
p AS (SELECT *, unnest([{_FIB}]::DOUBLE[]) AS part FROM g) SELECT symbol, part, {r6('CASE WHEN lt < ht THEN h - (h - l) * part ELSE l + (h - l) * part END')} AS price FROM p""")
register("recent_high_low", lambda s, d: levels.recent_high_low(tables.bars_hourly(s, d)), f"WITH {HOURLY}, {_TAIL.format(n=20)} SELECT symbol, max(high) AS recent_high, min(low) AS recent_low FROM t GROUP BY symbol")
register("swing_levels", lambda s, d: rounded(levels.swing_levels(tables.bars_hourly(s, d))), f"""WITH {HOURLY}, {_SWING}, lv AS (SELECT DISTINCT symbol, sh AS price, 'resistance' AS level_type FROM sw WHERE sh IS NOT NULL UNION SELECT DISTINCT symbol, sl, 'support' FROM sw WHERE sl IS NOT NULL)
SELECT lv.symbol, price, level_type, count(close)::BIGINT AS touches, least(count(close) / 10.0::DOUBLE, 1.0::DOUBLE) AS strength FROM (SELECT symbol, round(price, 6) AS price, level_type, price AS p FROM lv) lv LEFT JOIN bars ON bars.symbol = lv.symbol AND abs(close - p) <= p * 0.005 GROUP BY ALL""")
register("round_numbers", lambda s, d: rounded(levels.round_numbers(tables.bars_hourly(s, d))), f"""WITH {HOURLY}, l AS (SELECT symbol, last(close ORDER BY ts) AS close FROM bars GROUP BY symbol),
st AS (SELECT *, greatest(pow(10.0::DOUBLE, floor(log10(close))) / 10, 0.01) AS step FROM l WHERE close > 0), g AS (SELECT *, unnest(range(-5, 6)) AS k, round_even(close / step, 0) * step AS mid FROM st)
SELECT symbol, {r6('mid + k * step')} AS price, CASE WHEN mid + k * step > close THEN 'resistance' ELSE 'support' END AS level_type FROM g WHERE mid + k * step > 0""")
register("volume_profile", lambda s, d: rounded(levels.volume_profile(tables.bars_hourly(s, d))), f"""WITH {HOURLY}, s AS (SELECT symbol, min(close) AS lo, (max(close) - min(close)) / 50 AS wd, sum(volume) AS al FROM bars GROUP BY symbol),
p AS (SELECT bars.symbol, least(greatest(coalesce(ceil((close - lo) / nullif(wd, 0)), 1), 1), 50)::INTEGER AS bin, lo, wd, al, volume FROM bars JOIN s USING (symbol))
SELECT symbol, bin, {r6('lo + (bin - 0.5::DOUBLE) * wd')} AS price, sum(volume)::BIGINT AS volume, sum(volume) > 1.5 * al / 50 AS is_node FROM p GROUP BY symbol, bin, lo, wd, al""")
_LEVELS = f"""SELECT p.symbol, price, 0.0::DOUBLE AS strength, CASE WHEN name = 'P' THEN 'pivot' WHEN name LIKE 'R%' THEN 'resistance' ELSE 'support' END AS level_type, 'classic' AS source FROM ({SQL["pivots_classic"]}) p JOIN (SELECT event_type AS symbol, date_trunc('hour', max(ts)) AS ts FROM events WHERE value IS NOT NULL GROUP BY 1) e ON p.symbol = e.symbol AND p.ts = e.ts
UNION ALL SELECT symbol, price, strength, level_type, 'swing' FROM ({SQL["swing_levels"]})
UNION ALL SELECT symbol, price, 0.0::DOUBLE, 'fibonacci', 'fibonacci' FROM ({SQL["auto_fibonacci"].replace("k <= 50", "k > 0")})"""
register("levels_all", lambda s, d: rounded(levels.all_levels(tables.bars_hourly(s, d))), _LEVELS)
register("nearest_levels", lambda s, d: rounded(levels.nearest_levels(tables.bars_hourly(s, d), levels.all_levels(tables.bars_hourly(s, d)))), f"""WITH lv AS ({_LEVELS}), l AS (SELECT symbol, last(close ORDER BY ts) AS close FROM (WITH {HOURLY} SELECT * FROM bars) GROUP BY symbol)
SELECT l.symbol, {r6('close')} AS close, max(price) FILTER (WHERE price < close) AS support, min(price) FILTER (WHERE price > close) AS resistance FROM l LEFT JOIN lv ON l.symbol = lv.symbol GROUP BY l.symbol, close""")

# --- quality, joins, prices ----------------------------------------------------------------------------------------------

MINUTELY = HOURLY.replace("'hour'", "'minute'")
_LAST20 = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
register("quality_report", lambda s, d: quality.quality_report(tables.bars_minutely(s, d)), f"""WITH {MINUTELY}, f AS (SELECT *, CASE WHEN count(volume) OVER {_LAST20} >= 10 THEN quantile_cont(volume, 0.5) OVER {_LAST20} END AS mid, lag(ts) OVER {W} AS before, count(*) OVER (PARTITION BY symbol, ts) AS n FROM bars)
SELECT symbol, count(*) AS bars, count_if(high < greatest(open, close, low))::BIGINT AS bad_high, count_if(low > least(open, close, high))::BIGINT AS bad_low, count_if(least(open, high, low, close) < 0)::BIGINT AS negative, count_if(close = 0)::BIGINT AS zero_close, count_if(n > 1)::BIGINT AS duplicates,
count_if(volume = 0)::BIGINT AS zero_volume, count_if(volume > 10 * mid)::BIGINT AS volume_spikes, count_if(before::DATE = ts::DATE AND date_diff('second', before, ts) > 120)::BIGINT AS minute_gaps, count_if(close IS NULL)::BIGINT AS null_close FROM f GROUP BY symbol""")
register("missing_weekdays", lambda s, d: quality.missing_weekdays(tables.bars_daily(s, d)), f"""WITH {DAILY}, dd AS (SELECT DISTINCT symbol, ts::DATE AS day FROM bars), sp AS (SELECT symbol, min(day) AS a, max(day) AS b FROM dd GROUP BY symbol),
due AS (SELECT symbol, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM sp) SELECT symbol, day FROM due WHERE isodow(day) < 6 EXCEPT SELECT symbol, day FROM dd""")


def _upserted(s: SparkSession, d: str) -> DataFrame:
    b = tables.bars_hourly(s, d)
    return quality.upsert(b, b.where("ts >= timestamp_ntz'2024-01-15 00:00:00'").withColumn("close", C("close") + 1))


register("upsert", _upserted, f"WITH {HOURLY} SELECT symbol, ts, open, high, low, CASE WHEN ts >= '2024-01-15' THEN close + 1 ELSE close END AS close, volume, oi FROM bars")
register("prefilter", lambda s, d: quality.prefilter(tables.bars_wide(s, d), min_bars=400, min_price=1200.0), """
WITH b AS (SELECT l_suppkey::VARCHAR AS symbol, l_shipdate AS ts, last(l_extendedprice::DOUBLE / l_quantity::DOUBLE ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close FROM lineitem GROUP BY ALL)
SELECT symbol FROM b GROUP BY symbol HAVING count(*) >= 400 AND last(close ORDER BY ts) >= 1200""")


def _universe(s: SparkSession, *symbols: str) -> DataFrame:
    return s.createDataFrame([(x,) for x in symbols], "symbol string")


register("universe_members", lambda s, d: joins.members(tables.bars_hourly(s, d), _universe(s, "click", "view", "other")), f"WITH {HOURLY} SELECT * FROM bars WHERE symbol IN ('click', 'view', 'other')")
def _traded(s: SparkSession, d: str, when: str) -> DataFrame:
    return tables.bars_wide(s, d).where(when).select("symbol")


register("universe_changes", lambda s, d: joins.changes(_traded(s, d, "ts < timestamp_ntz'1995-01-05'"), _traded(s, d, "ts >= timestamp_ntz'2001-10-31'")), f"""WITH {WIDE}, a AS (SELECT DISTINCT symbol FROM bars WHERE ts < '1995-01-05'), b AS (SELECT DISTINCT symbol FROM bars WHERE ts >= '2001-10-31')
SELECT symbol, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT symbol, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")


def _returns(s: SparkSession, d: str, source: Callable[[SparkSession, str], DataFrame] = tables.bars_daily) -> DataFrame:
    return source(s, d).select("symbol", "ts", ind.roc(C("close"), 1).alias("r")).where("r is not null")


for _n, _source, _bars in (("correlation_matrix", tables.bars_daily, DAILY), ("correlation_wide", partial(tables.bars_wide, by_symbol=True), WIDE)):
    register(_n, lambda s, d, source=_source: joins.correlation_matrix(_returns(s, d, source), places=6), f"""WITH {_bars}, q AS (SELECT symbol, ts, 100 * (close / nullif(lag(close) OVER {W}, 0) - 1) AS r FROM bars), n AS (SELECT * FROM q WHERE r IS NOT NULL)
SELECT a.symbol AS a, b.symbol AS b, CASE WHEN a.symbol = b.symbol THEN 1.0::DOUBLE ELSE {r6('coalesce(CASE WHEN isfinite(corr(a.r, b.r)) THEN corr(a.r, b.r) END, 0)')} END AS corr FROM n a JOIN n b USING (ts) GROUP BY a.symbol, b.symbol""")


def _instruments(s: SparkSession, d: str) -> DataFrame:
    p = tables.table(s, d, "part")
    day = 86_400_000
    return p.select(F.split("p_type", " ")[0].alias("segment"), C("p_brand").alias("asset_symbol"), F.lit("OPT").alias("instrument_type"), (C("p_size").cast("bigint") * day).alias("expiry"), C("p_retailprice").cast("double").alias("strike_price"), C("p_partkey").alias("position"), F.concat(F.lit("K"), C("p_partkey")).alias("instrument_key"))


def _find(s: SparkSession, d: str) -> DataFrame:
    i = _instruments(s, d)
    wanted = i.select(C("position").alias("request_id"), "segment", "asset_symbol", "instrument_type", (C("expiry") - 3_600_000).alias("expiry_from"), C("strike_price").alias("strike"))
    return joins.find_instruments(wanted, i)


register("instrument_lookup", _find, """WITH i AS (SELECT split_part(p_type, ' ', 1) AS segment, p_brand AS asset_symbol, p_size::BIGINT * 86400000 AS expiry, p_retailprice::DOUBLE AS strike, p_partkey AS position FROM part)
SELECT a.position AS request_id, 'K' || first(b.position ORDER BY b.position) AS instrument_key FROM i a JOIN i b ON a.segment = b.segment AND a.asset_symbol = b.asset_symbol AND b.expiry >= a.expiry - 7200000 AND b.expiry <= a.expiry - 3600000 + 86400000 AND abs(a.strike - b.strike) <= 0.01 GROUP BY a.position""")


def _orders(s: SparkSession, d: str) -> DataFrame:
    x = tables.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (C("l_quantity").cast("double")).alias("quantity"), (C("l_extendedprice").cast("double") / C("l_quantity").cast("double")).alias("price"))
    seg = F.element_at(F.array(*map(F.lit, pricing.RATES)), (F.pmod(C("l_orderkey"), F.lit(8)) + 1).cast("int"))
    return pricing.with_charges(x.withColumn("segment", seg).withColumn("side", F.when(C("l_linenumber") % 2 == 0, "SELL").otherwise("BUY")))


def _cents(x: str) -> str:
    """To two places, ties of the shortest decimal form to the even one."""
    d = f"(({x})::VARCHAR::DECIMAL(30,18) * 100::DECIMAL(3,0))"
    return f"(floor({d})::BIGINT + CASE WHEN {d} - floor({d}) > 0.5 OR ({d} - floor({d}) = 0.5 AND floor({d})::BIGINT % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE"


_PARTS = {
    "brokerage": "b", "stt": "v * CASE WHEN buy THEN r_buy ELSE r_sell END / 100", "exchange_charge": "x", "sebi_fee": f"v * {pricing.SEBI}::DOUBLE / 100", "gst": f"(b + x) * {pricing.GST}::DOUBLE / 100",
    "stamp_duty": "CASE WHEN buy THEN v * r_stamp / 100 ELSE 0.0::DOUBLE END", "dp_charge": f"CASE WHEN NOT buy AND segment = 'EQUITY_DELIVERY' THEN {pricing.DP_CHARGE}::DOUBLE ELSE 0.0::DOUBLE END",
}
register("charges", lambda s, d: _orders(s, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "segment", "side", *pricing.PARTS, "total"), f"""WITH rates(n, segment, r_broker, r_buy, r_sell, r_exchange, r_stamp) AS (VALUES {", ".join(f"({n}, '{k}', " + ", ".join(f"{x!r}::DOUBLE" for x in v) + ")" for n, (k, v) in enumerate(pricing.RATES.items()))}),
o AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber % 2 = 1 AS buy, l_quantity::DOUBLE * (l_extendedprice::DOUBLE / l_quantity::DOUBLE) AS v, rates.* FROM lineitem JOIN rates ON l_orderkey % 8 = rates.n),
p AS (SELECT *, CASE WHEN r_broker > 0 THEN least({pricing.BROKERAGE_CAP}::DOUBLE, v * r_broker / 100) ELSE {pricing.BROKERAGE_CAP}::DOUBLE END AS b, v * r_exchange / 100 AS x FROM o),
q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, segment, CASE WHEN buy THEN 'BUY' ELSE 'SELL' END AS side, {", ".join(f"{x} AS {k}" for k, x in _PARTS.items())} FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, segment, side, {", ".join(f"{_cents(k)} AS {k}" for k in _PARTS)}, {_cents(" + ".join(_PARTS))} AS total FROM q""")
register("position_size", lambda s, d: tables.bars_hourly(s, d).select("symbol", "ts", pricing.quantity_column(F.lit(100000.0), C("close"), C("low") - 1).alias("quantity")), f"""WITH {HOURLY} SELECT symbol, ts, greatest(least(floor(100000.0::DOUBLE * 0.01::DOUBLE / abs(close - (low - 1))), floor(100000.0::DOUBLE / close)), 0)::BIGINT AS quantity FROM bars""")

# --- screens ---------------------------------------------------------------------------------------------------------------

def screen_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last bar of each symbol whose close is above its 20-bar mean on a volume of 1 or more."""
    d = tables.bars_daily(spark, sf_dir)
    d = d.withColumn("sma", ind.sma(C("close"), 20))
    return rounded(latest(d).where("close > sma and volume >= 1").select("symbol", "ts", "close", "sma", "volume"))


register("screen_expression", screen_expression, f"""WITH {DAILY}, q AS (SELECT *, {full(20, 'avg(close)')} AS sma, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) SELECT symbol, ts, {r6('close')} AS close, {r6('sma')} AS sma, volume FROM q WHERE k = 1 AND close > sma AND volume >= 1""")


def _rule(name: str, rule: dict, sql: str, before: str = "", least: int = 1, source: Callable[[SparkSession, str], DataFrame] = tables.bars_hourly, bars: str = HOURLY, table: str = "src") -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        b = source(s, d)
        return rules.evaluate(_with_bench(b) if "relative" in str(rule) else b, rule).where("passed").select("symbol", "ts", F.round("score", 6).alias("score"))

    register(f"rule_{name}", query, f"WITH RECURSIVE {bars}, {NUMBERED}, {before + ', ' if before else ''}q AS (SELECT *, ({sql}) AS ok FROM {table if before else 'b'}) SELECT symbol, ts, 1.0::DOUBLE AS score FROM q WHERE ok AND rn >= {least}")


_BEFORE20 = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
_EMA20 = f"{ewm('e', 'b', 'close', 2 / 21)}, src AS (SELECT b.*, y FROM b JOIN e USING (symbol, rn))"
_CROSSED = f"{ewm('e', 'b', 'close', 2 / 51)}, {ewm('f', 'b', 'close', 2 / 201)}, src AS (SELECT b.*, CASE WHEN rn >= 50 THEN e.y END AS a, CASE WHEN rn >= 200 THEN f.y END AS z FROM b JOIN e USING (symbol, rn) JOIN f USING (symbol, rn))"
_OBV = f"mv AS (SELECT *, coalesce(sign(close - lag(close) OVER {W}) * volume, 0) AS m FROM b), ob AS (SELECT *, sum(m) OVER {W} AS obv FROM mv), src AS (SELECT *, {full(10, 'avg(obv)', 'obv')} AS mean FROM ob)"
_DAYVWAP = f"src AS (SELECT *, sum((high + low + close) / 3 * volume) OVER {DAY} / nullif(sum(volume) OVER {DAY}, 0) AS v FROM b)"
_rule("price_breakout", {"type": "price_breakout", "lookback": 20}, f"close > p AND lag(close) OVER {W} <= p", f"src AS (SELECT *, CASE WHEN rn > 20 THEN max(high) OVER {_BEFORE20} END AS p FROM b)", 21)
_rule("volume_breakout", {"type": "volume_breakout"}, f"volume >= 2 * avg(volume) OVER {_BEFORE20}", least=21)
_rule("volume_decline", {"type": "volume_decline"}, f"volume <= 0.5 * avg(volume) OVER {_BEFORE20}", least=21)
_rule("volume_ratio", {"type": "volume_ratio"}, f"volume >= 1.5 * avg(volume) OVER {_BEFORE20}", least=21)
_rule("price_range", {"type": "price_range", "min_price": 20, "max_price": 60}, "close >= 20 AND close <= 60")
_rule("near_levels", {"type": "near_support", "levels": [25.0, 50.0, 75.0], "tolerance": 0.02}, "least(abs(close - 25), abs(close - 50), abs(close - 75)) / close <= 0.02")
_rule("ema", {"type": "ema", "period": 20, "condition": "price_above"}, "close > y", _EMA20, 20)
_rule("candle", {"type": "candle", "pattern": "doji"}, "abs(close - open) <= 0.1 * (high - low)", least=10)
_rule("rsi", {"type": "rsi", "period": 14, "threshold": 40, "direction": "below"}, "r < 40", q.RSI, 15, table="rs")
_rule("expression", {"type": "expression", "sql": "try_divide(close - low, high - low) > 0.9 and volume >= 5", "min_bars": 3}, "(close - low) / nullif(high - low, 0) > 0.9 AND volume >= 5", least=3)
_rule("macd", {"type": "macd"}, f"line > sig AND lag(line) OVER {W} <= lag(sig) OVER {W}", q.MACD, 35)
_rule("golden_cross", {"type": "golden_cross"}, f"a > z AND lag(a) OVER {W} <= lag(z) OVER {W}", _CROSSED, 201)
_rule("death_cross", {"type": "death_cross"}, f"a < z AND lag(a) OVER {W} >= lag(z) OVER {W}", _CROSSED, 201)
_rule("supertrend", {"type": "supertrend", "condition": "flip_bullish"}, "side = 1 AND side1 = -1", q.SUPERTREND, 11, table="trend")
_rule("bollinger_squeeze", {"type": "bollinger_squeeze"}, "mid + 2 * sd <= em + 1.5 * ar AND mid - 2 * sd >= em - 1.5 * ar", q.SQUEEZE, 20, table="bands")
_rule("relative_strength", {"type": "relative_strength"}, f"100 * (r / nullif({full(55, 'avg(r)', 'r')}, 0) - 1) > 0", f"{BENCH}, src AS (SELECT b.*, close / nullif(benchmark_close, 0) AS r FROM b JOIN bench USING (ts))", 56)
_rule("adx", {"type": "adx"}, "z > 25", q.ADX, 28)
_rule("vwap", {"type": "vwap", "condition": "cross_above"}, f"close > v AND lag(close) OVER {W} <= lag(v) OVER {W}", _DAYVWAP, 2)
_rule("higher_high", {"type": "higher_high"}, "last_hh", q.STRUCTURE, 20)
_rule("lower_low", {"type": "lower_low"}, "last_ll", q.STRUCTURE, 20)
_rule("accumulation", {"type": "accumulation"}, "obv > mean", _OBV, 10)
_rule("distribution", {"type": "distribution"}, "obv < mean", _OBV, 10)
_rule("trend", {"type": "trend"}, "lh = 1 AND ltl = 1", q.STRUCTURE, 21)
_rule("chart", {"type": "chart", "pattern": "double_top"}, f"({q.CHARTS['double_top']}) <> 0", q.charts(5, True, "ch"), 50, tables.bars_daily, DAILY, "ch")
_HAMMER = "least(open, close) - low >= 2 * abs(close - open) AND high - greatest(open, close) <= 0.1 * (high - low) AND high > low"
_TREE = {"type": "and", "rules": [{"type": "rsi", "period": 14, "threshold": 45, "direction": "below"}, {"type": "or", "rules": [{"type": "volume_breakout"}, {"type": "candle", "pattern": "hammer"}]}, {"type": "not", "rule": {"type": "price_range", "min_price": 90}}]}
register("scan_tree", lambda s, d: rules.evaluate(tables.bars_hourly(s, d), _TREE).where("passed").select("symbol", "ts", F.round("score", 6).alias("score")), f"""WITH RECURSIVE {HOURLY}, {NUMBERED}, {q.RSI},
a AS (SELECT *, coalesce(rn >= 15 AND r < 45, false) AS p1, coalesce(rn >= 21 AND volume >= 2 * avg(volume) OVER {_BEFORE20}, false) AS p2, coalesce(rn >= 10 AND {_HAMMER}, false) AS p3, close >= 90 AS p4 FROM rs)
SELECT symbol, ts, round((p1::INT + p2::INT + p3::INT + p4::INT) / 4.0::DOUBLE, 6) AS score FROM a WHERE p1 AND (p2 OR p3) AND NOT p4""")
_ANY2 = {"type": "at_least", "n": 2, "rules": [{"type": "ema", "period": 20}, {"type": "volume_ratio"}, {"type": "rsi", "threshold": 55, "direction": "below"}]}
_ANY2_SQL = f"""WITH RECURSIVE {WIDE}, {NUMBERED}, {q.RSI}, {ewm('e', 'b', 'close', 2 / 21)}, a AS (SELECT rs.*, coalesce(rn >= 20 AND close > e.y, false)::INT + coalesce(rn >= 21 AND volume >= 1.5 * avg(volume) OVER {_BEFORE20}, false)::INT + coalesce(rn >= 15 AND r < 55, false)::INT AS n,
row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM rs JOIN e USING (symbol, rn))"""
register("scan_at_least", lambda s, d: rules.rank(rules.scan_eod(tables.bars_wide(s, d), _ANY2)).select("symbol", "ts", F.round("score", 6).alias("score")), f"{_ANY2_SQL} SELECT symbol, ts, round(n / 3.0::DOUBLE, 6) AS score FROM a WHERE back = 1 AND n >= 2")
register("scan_history", lambda s, d: rules.scan_history(tables.bars_hourly(s, d), {"type": "ema", "period": 20}, "2024-01-10", "2024-01-20").select("symbol", "ts"), f"""WITH RECURSIVE {HOURLY}, {NUMBERED}, {ewm('e', 'b', 'close', 2 / 21)} SELECT symbol, ts FROM b JOIN e USING (symbol, rn) WHERE rn >= 20 AND close > y AND ts >= '2024-01-10' AND ts < '2024-01-21'""")

# --- signals, backtests, searches --------------------------------------------------------------------------------------------

#: Events run all day and night, a few a minute at most.
_SETTINGS = {"opening_range": {"start": "00:00", "stop": "04:00", "last": "23:00", "least_bars": 3}}
_SIGNALS = ("signal", "signal_tag", "stop_loss", "take_profit", "confidence")


def _signals(name: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        b = tables.bars_minutely(s, d) if name == "opening_range" else tables.bars_hourly(s, d)
        made = STRATEGIES[name](**_SETTINGS.get(name, {})).signals(_with_bench(b) if name == "rs_rsi_supertrend" else b)
        return rounded(made.select("symbol", "ts", *_SIGNALS))

    return query


for _n in STRATEGIES:
    register(f"signals_{_n}", _signals(_n))
SQL["signals_ema_crossover"] = f"""WITH RECURSIVE {HOURLY}, {NUMBERED}, {ewm('e', 'b', 'close', 2 / 11)}, {ewm('f', 'b', 'close', 2 / 22)},
g AS (SELECT b.*, CASE WHEN rn >= 10 THEN e.y END AS a, CASE WHEN rn >= 21 THEN f.y END AS z FROM b JOIN e USING (symbol, rn) JOIN f USING (symbol, rn)),
c AS (SELECT *, coalesce(a > z AND lag(a) OVER {W} <= lag(z) OVER {W}, false) AS up, coalesce(a < z AND lag(a) OVER {W} >= lag(z) OVER {W}, false) AS dn FROM g),
s AS (SELECT symbol, rn, 0 AS pos, 0 AS sig FROM c WHERE rn = 1 UNION ALL SELECT c.symbol, c.rn, CASE WHEN s.pos <= 0 AND up THEN 1 WHEN s.pos >= 0 AND dn THEN -1 ELSE s.pos END, CASE WHEN s.pos <= 0 AND up THEN 1 WHEN s.pos >= 0 AND dn THEN -1 ELSE 0 END FROM s JOIN c ON c.symbol = s.symbol AND c.rn = s.rn + 1),
o AS (SELECT b.symbol, b.ts, CASE WHEN rn > 21 THEN sig ELSE 0 END::INTEGER AS signal FROM b JOIN s USING (symbol, rn))
SELECT symbol, ts, signal, CASE signal WHEN 1 THEN 'EMA_UP' WHEN -1 THEN 'EMA_DOWN' ELSE '' END AS signal_tag, NULL::DOUBLE AS stop_loss, NULL::DOUBLE AS take_profit, abs(signal)::DOUBLE AS confidence FROM o"""
_START = f"WITH RECURSIVE {HOURLY}, {NUMBERED}, "
_OVER = lambda a, b, n=1: f"{a} > {b} AND lag({a}, {n}) OVER {W} <= lag({b}, {n}) OVER {W}"
SQL["signals_macd_crossover"] = f"""{_START}{q.MACD}, x AS (SELECT *, {_OVER('line', 'sig')} AS up, {_OVER('sig', 'line')} AS dn FROM src), {q.machine('x', 'up', 'dn')} {q.signals('x', 35, 'MACD_UP', 'MACD_DOWN')}"""
SQL["signals_rsi_reversion"] = f"""{_START}{q.RSI}, x AS (SELECT *, r < 30 AND lag(r) OVER {W} >= 30 AS low_, r > 70 AND lag(r) OVER {W} <= 70 AS high_ FROM rs), {q.machine('x', 'low_', 'high_', 'high_', 'low_')}
{q.signals('x', 15, 'RSI_LOW', 'RSI_HIGH', confidence='least(greatest(CASE WHEN signal = 1 THEN (30 - r) / 30 ELSE (r - 70) / 30 END, 0), 1)')}"""
SQL["signals_supertrend"] = f"""{_START}{q.SUPERTREND}, {q.machine('trend', 'side1 = -1 AND side = 1', 'side1 = 1 AND side = -1')} {q.signals('trend', 10, 'TREND_UP', 'TREND_DOWN', 'line')}"""
SQL["signals_bollinger_squeeze"] = f"""{_START}{q.SQUEEZE}, sq AS (SELECT *, coalesce(mid + 2 * sd < em + 1.5 * ar AND mid - 2 * sd > em - 1.5 * ar, false) AS tight FROM bands), ln AS (SELECT *, rn - coalesce(max(CASE WHEN NOT tight THEN rn END) OVER {W}, 0) AS run FROM sq),
x AS (SELECT *, lag(run) OVER {W} AS run1, NOT tight AND coalesce(lag(tight) OVER {W}, false) AS freed FROM ln), {q.machine('x', 'freed AND close > mid + 2 * sd', 'freed AND close < mid - 2 * sd', 'close < mid', 'close > mid')}
{q.signals('x', 20, 'SQUEEZE_UP', 'SQUEEZE_DOWN', 'mid', confidence='least(run1 / 10.0::DOUBLE, 1)')}"""
SQL["signals_rs_rsi_supertrend"] = f"""{_START}{BENCH}, {q.RSI}, {q.SUPERTREND.replace("trend AS", "tren AS")}, n3 AS (SELECT rs.*, side, (close / nullif(lag(close, 55) OVER {W}, 0)) / nullif(benchmark_close / nullif(lag(benchmark_close, 55) OVER {W}, 0), 0) - 1 AS strong
  FROM rs JOIN bench USING (ts) JOIN (SELECT symbol, rn, side FROM tren) USING (symbol, rn)),
x AS (SELECT *, coalesce(strong > 0, false)::INT + coalesce(r > 50, false)::INT + (side = 1)::INT AS agree FROM n3), {q.machine('x', 'agree >= 3', 'false', 'agree < 2')} {q.signals('x', 55, 'AGREE', 'LEAVE', confidence='agree / 3.0::DOUBLE')}"""
_WHOLEDAY = "(PARTITION BY symbol, ts::DATE)"
_EARLIER = "(PARTITION BY symbol, ts::DATE ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SQL["signals_opening_range"] = f"""WITH {MINUTELY}, o AS (SELECT *, ts::TIME <= '04:00:00' AS early, sum((high + low + close) / 3 * volume) OVER {DAY} / nullif(sum(volume) OVER {DAY}, 0) AS v FROM bars),
g AS (SELECT *, CASE WHEN count_if(early) OVER {_WHOLEDAY} >= 3 THEN max(high) FILTER (WHERE early) OVER {_WHOLEDAY} END AS top, CASE WHEN count_if(early) OVER {_WHOLEDAY} >= 3 THEN min(low) FILTER (WHERE early) OVER {_WHOLEDAY} END AS bot FROM o),
e AS (SELECT *, coalesce(ts::TIME > '04:00:00' AND ts::TIME < '23:00:00' AND close > top AND close > v, false) AS up, coalesce(ts::TIME > '04:00:00' AND ts::TIME < '23:00:00' AND close < bot AND close < v, false) AS dn FROM g),
f AS (SELECT *, CASE WHEN up AND coalesce(count_if(up) OVER {_EARLIER}, 0) = 0 THEN 1 WHEN dn AND coalesce(count_if(dn) OVER {_EARLIER}, 0) = 0 THEN -1 ELSE 0 END::INTEGER AS signal FROM e)
SELECT symbol, ts, signal, CASE signal WHEN 1 THEN 'ORB_LONG' WHEN -1 THEN 'ORB_SHORT' ELSE '' END AS signal_tag, CASE WHEN signal <> 0 THEN {r6('open')} END AS stop_loss, NULL::DOUBLE AS take_profit, abs(signal)::DOUBLE AS confidence FROM f"""
_live = lambda s, d, name: live.replayed(tables.bars_hourly(s, d).withColumn("ts", C("ts").cast("timestamp")), STRATEGIES[name]().fold()).withColumn("ts", C("ts").cast("timestamp_ntz"))
for _n in ("ema_crossover", "supertrend"):
    register(f"live_{_n}", lambda s, d, n=_n: rounded(_live(s, d, n).select("symbol", "ts", "signal", "signal_tag", "stop_loss", "take_profit", "confidence")), SQL[f"signals_{_n}"])
register("signals_confluence", lambda s, d: confluence(tables.bars_hourly(s, d), [EmaCrossover(), BollingerSqueeze()], 1).select("symbol", "ts", "long_votes", "short_votes", "signal"), f"""SELECT symbol, ts, (a.signal = 1)::INT + (b.signal = 1)::INT AS long_votes, (a.signal = -1)::INT + (b.signal = -1)::INT AS short_votes,
CASE WHEN a.signal = 1 OR b.signal = 1 THEN 1 WHEN a.signal = -1 OR b.signal = -1 THEN -1 ELSE 0 END AS signal FROM ({SQL["signals_ema_crossover"]}) a JOIN ({SQL["signals_bollinger_squeeze"]}) b USING (symbol, ts)""")


def _simulated(s: SparkSession, d: str, **config) -> DataFrame:
    return backtest.simulate(EmaCrossover(stop_pct=0).signals(tables.bars_hourly(s, d)), backtest.Config(**({"allow_short": True} | config)))


register("equity", lambda s, d: rounded(_simulated(s, d).select("symbol", "ts", "equity", "drawdown", "cash"), 4))
register("trades", lambda s, d: rounded(backtest.trades(_simulated(s, d)), 4))
register("trades_trailing", lambda s, d: rounded(backtest.trades(_simulated(s, d, stop=pricing.Stop("CHANDELIER", 3.0), target=pricing.Target("PARTIAL_EXIT", 5.0, 0.5))), 4))
register("trades_limit", lambda s, d: rounded(backtest.trades(_simulated(s, d, order="LIMIT", order_pct=0.5, stop=pricing.Stop("FIXED_PCT", 3.0), target=pricing.Target("RISK_REWARD", 2.0))), 4))


def _portfolio(s: SparkSession, d: str) -> DataFrame:
    signals = EmaCrossover().signals(tables.bars_hourly(s, d)).withColumn("portfolio", F.when(C("symbol").isin("click", "view"), "traffic").otherwise("rest"))
    return rounded(backtest.simulate(signals, backtest.Config(max_positions=3), ["portfolio"]).select("portfolio", "symbol", "ts", "equity", "cash"), 4)


register("portfolio_equity", _portfolio)


def _day_trades(s: SparkSession, d: str) -> DataFrame:
    """A fixed table of trades: each symbol is bought for 10 at each day's first hourly close and sold at its last."""
    b = tables.bars_hourly(s, d).groupBy("symbol", F.to_date("ts").alias("day")).agg(
        F.min("ts").alias("entry_time"), F.max("ts").alias("exit_time"), F.min_by("close", "ts").alias("entry_price"), F.max_by("close", "ts").alias("exit_price"), F.min("low").alias("_lo"), F.max("high").alias("_hi"), F.count("*").alias("bars_held")
    ).where("entry_time < exit_time")
    reason = F.element_at(F.array(*map(F.lit, ("SL", "TARGET", "TIME", "SIGNAL"))), (F.dayofmonth("day") % 4 + 1).cast("int"))
    gross = 10 * (C("exit_price") - C("entry_price"))
    return b.select("symbol", F.lit("LONG").alias("side"), "entry_time", "exit_time", "entry_price", "exit_price", F.lit(10).cast("bigint").alias("quantity"), gross.alias("gross_pnl"), F.lit(0.5).alias("charges"), (gross - 0.5).alias("net_pnl"), C("bars_held").cast("int").alias("bars_held"), (C("_lo") - C("entry_price")).alias("mae"), (C("_hi") - C("entry_price")).alias("mfe"), reason.alias("exit_reason"))


_TRADES = f"""{HOURLY}, tr AS (SELECT symbol, ts::DATE AS day, min(ts) AS entry_time, max(ts) AS exit_time, first(close ORDER BY ts) AS entry_price, last(close ORDER BY ts) AS exit_price, min(low) - first(close ORDER BY ts) AS mae, max(high) - first(close ORDER BY ts) AS mfe, count(*)::INTEGER AS bars_held FROM bars GROUP BY ALL HAVING min(ts) < max(ts)),
trades AS (SELECT *, 10 * (exit_price - entry_price) - 0.5 AS net_pnl, ['SL', 'TARGET', 'TIME', 'SIGNAL'][day(day) % 4 + 1] AS reason FROM tr),
runs AS (SELECT symbol, net_pnl > 0 AS won, row_number() OVER (PARTITION BY symbol ORDER BY exit_time) - row_number() OVER (PARTITION BY symbol, net_pnl > 0 ORDER BY exit_time) AS g FROM trades),
streaks AS (SELECT symbol, coalesce(max(n) FILTER (WHERE won), 0)::BIGINT AS max_wins, coalesce(max(n) FILTER (WHERE NOT won), 0)::BIGINT AS max_losses FROM (SELECT symbol, won, g, count(*) AS n FROM runs GROUP BY ALL) GROUP BY symbol),
tm AS (SELECT symbol, count(*) AS trades, count_if(net_pnl > 0)::BIGINT AS winners, count_if(net_pnl <= 0)::BIGINT AS losers, sum(net_pnl) AS net_profit, 0.5::DOUBLE * count(*) AS charges, coalesce(avg(net_pnl) FILTER (WHERE net_pnl > 0), 0.0::DOUBLE) AS avg_win, coalesce(avg(net_pnl) FILTER (WHERE net_pnl <= 0), 0.0::DOUBLE) AS avg_loss,
  max(net_pnl) AS best_trade, min(net_pnl) AS worst_trade, sum(net_pnl) FILTER (WHERE net_pnl > 0) AS won, -sum(net_pnl) FILTER (WHERE net_pnl <= 0) AS lost, avg(bars_held) AS avg_bars_held, avg(date_diff('day', entry_time, exit_time)) AS avg_days_held,
  100.0::DOUBLE * count_if(reason = 'SL') / count(*) AS stop_pct, 100.0::DOUBLE * count_if(reason = 'TARGET') / count(*) AS target_pct, 100.0::DOUBLE * count_if(reason = 'TIME') / count(*) AS time_pct, avg(mae * 10) AS avg_mae, avg(mfe * 10) AS avg_mfe FROM trades GROUP BY symbol),
tw AS (SELECT *, winners / trades::DOUBLE AS win_rate, CASE WHEN lost > 0 THEN coalesce(won, 0) / lost ELSE 999.0::DOUBLE END AS profit_factor FROM tm),
tx AS (SELECT *, win_rate * avg_win + (1 - win_rate) * avg_loss AS expectancy, CASE WHEN avg_win <> 0 THEN (win_rate * avg_win - (1 - win_rate) * abs(avg_loss)) / avg_win ELSE 0 END AS kelly, greatest(100 - stop_pct - target_pct - time_pct, 0) AS signal_pct FROM tw)"""
register("trade_metrics", lambda s, d: rounded(performance.trade_metrics(_day_trades(s, d), "symbol"), 4), f"WITH {_TRADES} SELECT symbol, trades, winners, losers, {', '.join(r6(x, 4) + ' AS ' + x for x in ('net_profit', 'charges', 'avg_win', 'avg_loss', 'best_trade', 'worst_trade', 'avg_bars_held', 'avg_days_held', 'stop_pct', 'target_pct', 'time_pct', 'win_rate', 'profit_factor', 'expectancy', 'kelly', 'signal_pct'))} FROM tx")
register("trade_streaks", lambda s, d: performance.longest_streaks(_day_trades(s, d), "symbol"), f"WITH {_TRADES} SELECT * FROM streaks")
register("contributions", lambda s, d: rounded(performance.contributions(_day_trades(s, d)), 4), f"WITH {_TRADES}, c AS (SELECT symbol, sum(net_pnl) AS x FROM trades GROUP BY symbol) SELECT symbol, {r6('x', 4)} AS net_pnl, {r6('100 * x / sum(x) OVER ()', 4)} AS share_pct, row_number() OVER (ORDER BY x DESC, symbol) = 1 AS is_best, row_number() OVER (ORDER BY x, symbol) = 1 AS is_worst FROM c")
register("exposure", lambda s, d: joins.exposure(tables.bars_hourly(s, d), _day_trades(s, d)), f"WITH {_TRADES} SELECT b.symbol, count(*) AS bars, count_if(EXISTS (FROM trades t WHERE t.symbol = b.symbol AND b.ts >= t.entry_time AND b.ts <= t.exit_time))::BIGINT AS exposed FROM bars b GROUP BY b.symbol")
register("daily_summary", lambda s, d: rounded(performance.daily_summary(_day_trades(s, d)), 4), f"WITH {_TRADES} SELECT exit_time::DATE AS day, {r6('sum(net_pnl)', 4)} AS pnl, count(*) AS trades, {r6('100.0::DOUBLE * count_if(net_pnl > 0) / count(*)', 4)} AS win_rate_pct FROM trades GROUP BY exit_time::DATE")


def _curve(s: SparkSession, d: str) -> DataFrame:
    """A fixed curve: 20,000,000 and the running sum of each day's close less open."""
    return tables.bars_daily(s, d).select("symbol", "ts", F.round(20_000_000 + F.sum(C("close") - C("open")).over(ordered()), 2).alias("equity"))


_CURVE = f"{DAILY}, eq AS (SELECT symbol, ts, round(20000000 + sum(close - open) OVER {W}, 2) AS equity FROM bars)"
register("drawdowns", lambda s, d: rounded(performance.drawdowns(_curve(s, d), "symbol"), 4), f"WITH {_CURVE}, p AS (SELECT *, max(equity) OVER {W} AS peak FROM eq) SELECT symbol, ts, {r6('equity', 4)} AS equity, {r6('peak', 4)} AS peak, {r6('(equity - peak) / peak', 4)} AS drawdown FROM p")
register("monthly_returns", lambda s, d: rounded(performance.period_returns(_curve(s, d), "symbol"), 4), f"WITH {_CURVE}, m AS (SELECT symbol, date_trunc('month', ts)::DATE AS period, last(equity ORDER BY ts) AS e FROM eq GROUP BY ALL), r AS (SELECT *, 100 * (e / lag(e) OVER (PARTITION BY symbol ORDER BY period) - 1) AS p FROM m) SELECT symbol, period, {r6('p', 4)} AS return_pct FROM r WHERE p IS NOT NULL")
_FREE = (1 + performance.RISK_FREE) ** (1 / performance.DAYS) - 1
register("equity_metrics", lambda s, d: rounded(performance.equity_metrics(_curve(s, d), "symbol").select("symbol", "start_equity", "end_equity", "total_return", "cagr", "volatility", "sharpe", "sortino", "max_drawdown", "omega", "bars"), 4), f"""WITH {_CURVE},
p AS (SELECT *, (equity - max(equity) OVER {W}) / max(equity) OVER {W} AS dd FROM eq), a AS (SELECT symbol, first(equity ORDER BY ts) AS s, last(equity ORDER BY ts) AS e, min(dd) AS mdd, count(*) AS bars, greatest(datediff('day', min(ts), max(ts)) / 365.25, 1 / 365.25) AS y FROM p GROUP BY symbol),
r AS (SELECT symbol, equity / lag(equity) OVER {W} - 1 AS r FROM eq), g AS (SELECT symbol, stddev_samp(r) AS sd, avg(r - {_FREE!r}) AS ex, stddev_samp(CASE WHEN r < 0 THEN r END) AS dn, sum(CASE WHEN r > 0 THEN r ELSE 0 END) AS up, sum(CASE WHEN r <= 0 THEN -r ELSE 0 END) AS lo FROM r GROUP BY symbol)
SELECT symbol, {r6('s', 4)} AS start_equity, {r6('e', 4)} AS end_equity, {r6('e / s - 1', 4)} AS total_return, {r6('pow(e / s, 1 / y) - 1', 4)} AS cagr, {r6('sd * sqrt(252.0::DOUBLE)', 4)} AS volatility, {r6('ex / sd * sqrt(252.0::DOUBLE)', 4)} AS sharpe, {r6('ex / dn * sqrt(252.0::DOUBLE)', 4)} AS sortino, {r6('mdd', 4)} AS max_drawdown, {r6('CASE WHEN lo > 0 THEN up / lo WHEN up > 0 THEN 999 ELSE 0 END', 4)} AS omega, bars FROM a JOIN g USING (symbol)""")


def _performance(s: SparkSession, d: str) -> DataFrame:
    t = _day_trades(s, d)
    curve = tables.bars_hourly(s, d).join(t.select("symbol", C("exit_time").alias("ts"), "net_pnl"), ["symbol", "ts"], "left")
    curve = curve.select("symbol", "ts", (100_000 + F.sum(F.coalesce("net_pnl", F.lit(0.0))).over(ordered())).alias("equity"))
    out = performance.performance(curve, t, "symbol")
    return rounded(out.withColumn("monthly_returns", F.map_values("monthly_returns")).withColumn("annual_returns", F.coalesce(F.map_values("annual_returns"), F.array().cast("array<double>"))).withColumn("monthly_returns", F.coalesce("monthly_returns", F.array().cast("array<double>")).cast("string")).withColumn("annual_returns", C("annual_returns").cast("string")), 4)


_P4 = lambda **columns: ", ".join(f"{r6(v, 4)} AS {k}" for k, v in columns.items())
register("performance", _performance, f"""WITH {_TRADES}, eq AS (SELECT bars.symbol, bars.ts, 100000 + sum(coalesce(net_pnl, 0)) OVER (PARTITION BY bars.symbol ORDER BY bars.ts) AS equity FROM bars LEFT JOIN trades t ON t.symbol = bars.symbol AND t.exit_time = bars.ts),
pk AS (SELECT *, max(equity) OVER {W} AS peak, row_number() OVER {W} AS rn FROM eq), ru AS (SELECT *, CASE WHEN equity < peak THEN rn - coalesce(max(CASE WHEN equity >= peak THEN rn END) OVER {W}, 0) ELSE 0 END AS run FROM pk),
a AS (SELECT symbol, min(ts)::DATE AS start_date, max(ts)::DATE AS end_date, last(equity ORDER BY ts) AS e, min(equity / peak - 1) AS mdd, coalesce(avg(CASE WHEN equity < peak THEN equity / peak - 1 END), 0) AS add_, max(run)::BIGINT AS dur, max(peak - equity) AS mdm, greatest(date_diff('day', min(ts), max(ts)) / 365.25::DOUBLE, 1 / 365.25::DOUBLE) AS y, count(*) AS bars FROM ru GROUP BY symbol),
dy AS (SELECT symbol, ts::DATE AS day, last(equity ORDER BY ts) AS equity FROM eq GROUP BY ALL), r AS (SELECT symbol, equity / lag(equity) OVER (PARTITION BY symbol ORDER BY day) - 1 AS r FROM dy),
g AS (SELECT symbol, stddev_samp(r) AS sd, avg(r - {_FREE!r}) AS ex, stddev_samp(CASE WHEN r < 0 THEN r END) AS dn, sum(CASE WHEN r > 0 THEN r ELSE 0 END) AS up, sum(CASE WHEN r <= 0 THEN -r ELSE 0 END) AS lo FROM r GROUP BY symbol),
ex AS (SELECT b.symbol, 100.0::DOUBLE * count_if(EXISTS (FROM trades t WHERE t.symbol = b.symbol AND b.ts >= t.entry_time AND b.ts <= t.exit_time)) / count(*) AS pct FROM bars b GROUP BY b.symbol),
j AS (SELECT a.*, g.* EXCLUDE (symbol), tx.* EXCLUDE (symbol), streaks.* EXCLUDE (symbol), pct, pow(e / 100000, 1 / y) - 1 AS cagr FROM a JOIN g USING (symbol) JOIN tx USING (symbol) JOIN streaks USING (symbol) JOIN ex USING (symbol))
SELECT symbol, start_date, end_date, {_P4(initial_capital='100000.0::DOUBLE', final_capital='e', total_net_pnl='e - 100000', total_return_pct='100 * (e / 100000 - 1)', cagr_pct='100 * cagr', annualised_volatility='100 * sd * sqrt(252.0::DOUBLE)', sharpe_ratio='ex / sd * sqrt(252.0::DOUBLE)', sortino_ratio='ex / dn * sqrt(252.0::DOUBLE)', calmar_ratio='abs(cagr / mdd)', omega_ratio='up / lo', kelly_fraction='kelly', max_drawdown_pct='100 * mdd', avg_drawdown_pct='100 * add_', recovery_factor='(e - 100000) / mdm', brokerage_drag_pct='charges / 1000', net_return_after_tax_pct='100 * (e / 100000 - 1) - charges / 1000', avg_holding_days='avg_days_held', trades_per_month='trades / (y * 12)')},
dur AS max_drawdown_duration_bars, trades AS total_trades, winners AS winning_trades, losers AS losing_trades, max_wins AS max_consecutive_wins, max_losses AS max_consecutive_losses, '[]' AS monthly_returns, '[]' AS annual_returns,
{_P4(win_rate_pct='100 * win_rate', avg_win='avg_win', avg_loss='avg_loss', largest_win='greatest(best_trade, 0)', largest_loss='least(worst_trade, 0)', profit_factor='profit_factor', expectancy='expectancy', risk_reward_ratio='avg_win / abs(avg_loss)', avg_trade_duration_bars='avg_bars_held', avg_mae='avg_mae', avg_mfe='avg_mfe', pct_stopped_out='stop_pct', pct_target_hit='target_pct', pct_signal_exit='signal_pct', pct_time_exit='time_pct', exposure_pct='pct', total_commission_paid='charges')} FROM j""")
register("grid_search", lambda s, d: rounded(search.grid_search(tables.bars_hourly(s, d), EmaCrossover, {"fast": [5, 10], "slow": [21, 34]}, backtest.Config(allow_short=True)).select("symbol", "param_id", "parameters", "sharpe", "total_return", "place"), 4))
register("walk_forward", lambda s, d: rounded(search.walk_forward(tables.bars_hourly(s, d), EmaCrossover, {"fast": [5, 10], "slow": [21]}, 240, 80, backtest.Config(allow_short=True)).select("symbol", "fold", "param_id", "parameters", "train_sharpe", "sharpe", "total_return"), 4))

# --- ticks -----------------------------------------------------------------------------------------------------------------

register("candles_from_ticks", lambda s, d: tk.candles(tk.volume_steps(tables.ticks(s, d))).withColumn("ts", C("ts").cast("timestamp_ntz")), """
WITH t AS (SELECT event_type AS symbol, ts, value, event_id, count(*) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS v FROM events WHERE value IS NOT NULL),
s AS (SELECT *, greatest(v - coalesce(lag(v) OVER (PARTITION BY symbol, ts::DATE ORDER BY ts, v), v), 0) AS step FROM t)
SELECT symbol, date_trunc('minute', ts) AS ts, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(step)::BIGINT AS volume FROM s GROUP BY symbol, date_trunc('minute', ts)""")
register("latest_ticks", lambda s, d: tk.latest_ticks(tables.ticks(s, d)), "SELECT event_type AS symbol, last(value ORDER BY ts) AS ltp, max(ts) AS ltt FROM events WHERE value IS NOT NULL GROUP BY event_type")

# --- what has no other query -------------------------------------------------------------------------------------------------

register("annual_returns", lambda s, d: rounded(performance.period_returns(_curve(s, d), "symbol", unit="year"), 4), f"WITH {_CURVE}, m AS (SELECT symbol, date_trunc('year', ts)::DATE AS period, last(equity ORDER BY ts) AS e FROM eq GROUP BY ALL), r AS (SELECT *, 100 * (e / lag(e) OVER (PARTITION BY symbol ORDER BY period) - 1) AS p FROM m) SELECT symbol, period, {r6('p', 4)} AS return_pct FROM r WHERE p IS NOT NULL")
on_bars("trail_increment", lambda: {"step": ind.trail_increment()}, {"step": f"coalesce(abs(lag(open) OVER {W} - lag(close) OVER {W}) / 5, 0)"})
register("relative_strength_rank", lambda s, d: rounded(ind.relative_strength_rank(_with_bench(tables.bars_hourly(s, d)), 55)), f"""WITH {HOURLY}, {BENCH}, j AS (SELECT symbol, ts, close / nullif(lag(close, 55) OVER {W}, 0) / (benchmark_close / nullif(lag(benchmark_close, 55) OVER {W}, 0)) - 1 AS x FROM bars JOIN bench USING (ts))
SELECT ts, symbol, {r6('x')} AS rs, row_number() OVER (PARTITION BY ts ORDER BY x DESC, symbol)::INTEGER AS place FROM j WHERE x IS NOT NULL""")
for _n, _parts in (("fibonacci_extensions", levels.EXTENSIONS), ("fibonacci_fans", levels.FANS)):
    register(_n, lambda s, d, parts=_parts: rounded(levels.fibonacci_levels(tables.bars_hourly(s, d), parts)), f"""WITH {HOURLY}, {_TAIL.format(n=50)}, g AS (SELECT symbol, max(high) AS h, min(low) AS l, first(ts ORDER BY high DESC, ts) AS ht, first(ts ORDER BY low, ts) AS lt FROM t GROUP BY symbol HAVING count(*) = 50),
p AS (SELECT *, unnest([{", ".join(map(str, _parts))}]::DOUBLE[]) AS part FROM g) SELECT symbol, part, {r6('CASE WHEN lt < ht THEN h - (h - l) * part ELSE l + (h - l) * part END')} AS price, CASE WHEN lt < ht THEN 'support' ELSE 'resistance' END AS level_type FROM p""")
register("level_clusters", lambda s, d: rounded(levels.cluster_levels(levels.swing_levels(tables.bars_hourly(s, d)), 0.02).select("symbol", "price")), f"""WITH RECURSIVE lv AS (SELECT symbol, price, row_number() OVER (PARTITION BY symbol ORDER BY price) AS rn FROM ({SQL["swing_levels"]})),
cl AS (SELECT symbol, rn, price, price AS first_, 1 AS c FROM lv WHERE rn = 1 UNION ALL SELECT lv.symbol, lv.rn, lv.price, CASE WHEN lv.price > first_ * 1.02 THEN lv.price ELSE first_ END, CASE WHEN lv.price > first_ * 1.02 THEN c + 1 ELSE c END FROM cl JOIN lv ON lv.symbol = cl.symbol AND lv.rn = cl.rn + 1)
SELECT symbol, {r6('avg(price)')} AS price FROM cl GROUP BY symbol, c""")
register("levels_near_price", lambda s, d: levels.near_price(levels.nearest_levels(tables.bars_hourly(s, d), levels.all_levels(tables.bars_hourly(s, d))).join(levels.all_levels(tables.bars_hourly(s, d)), "symbol"), "close", 0.05).select("symbol", F.round("price", 6).alias("price"), "source"), f"""WITH lv AS ({_LEVELS}), l AS (SELECT symbol, last(close ORDER BY ts) AS close FROM (WITH {HOURLY} SELECT * FROM bars) GROUP BY symbol) SELECT symbol, price, source FROM lv JOIN l USING (symbol) WHERE abs(price - close) / close <= 0.05""")
register("market_hours", lambda s, d: within_hours(tables.bars_minutely(s, d), "09:15", "15:30"), f"WITH {MINUTELY} SELECT * FROM bars WHERE ts::TIME >= '09:15:00' AND ts::TIME <= '15:30:00'")
register("resample_market_hours", lambda s, d: resample(tables.bars_minutely(s, d), "30min", ("09:15", "15:30")), f"WITH {MINUTELY}, m AS (SELECT * FROM bars WHERE ts::TIME >= '09:15:00' AND ts::TIME <= '15:30:00') SELECT symbol, time_bucket(INTERVAL 30 MINUTE, m.ts) AS ts, first(open ORDER BY m.ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY m.ts) AS close, sum(volume)::BIGINT AS volume, last(oi ORDER BY m.ts) AS oi FROM m GROUP BY ALL")
register("opening_range", lambda s, d: opening_range(tables.bars_minutely(s, d), "00:00", "04:00", 3).select("symbol", "ts", "or_high", "or_low"), f"""WITH {MINUTELY}, m AS (SELECT symbol, ts::DATE AS day, max(high) AS h, min(low) AS l, count(*) AS n FROM bars WHERE ts::TIME <= '04:00:00' GROUP BY ALL)
SELECT b.symbol, b.ts, CASE WHEN n >= 3 THEN h END AS or_high, CASE WHEN n >= 3 THEN l END AS or_low FROM bars b LEFT JOIN m ON m.symbol = b.symbol AND m.day = b.ts::DATE""")
register("last_two_months", lambda s, d: (lambda b: b.join(b.groupBy("symbol").agg(period_start(F.to_date(F.max("ts")), 2, "months").alias("_from")), "symbol").where("ts >= _from").drop("_from"))(tables.bars_daily(s, d)), f"WITH {DAILY}, f AS (SELECT symbol, (max(ts)::DATE - INTERVAL 2 MONTH)::DATE AS from_ FROM bars GROUP BY symbol) SELECT bars.* FROM bars JOIN f USING (symbol) WHERE ts >= from_")


def _dirty(s: SparkSession, d: str) -> DataFrame:
    """Hourly bars as text, with some prices missing and some bars twice."""
    b = tables.bars_hourly(s, d)
    torn = b.withColumn("close", F.when(C("volume") % 7 == 0, None).otherwise(C("close")))
    again = b.where("volume % 5 = 0").withColumn("close", C("close") + 1).withColumn("volume", C("volume") + 100)
    return torn.unionByName(again).select("symbol", "ts", *(C(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "volume")))


register("clean", lambda s, d: quality.clean(_dirty(s, d)), f"""WITH {HOURLY}, u AS (SELECT symbol, ts, open, high, low, CASE WHEN volume % 7 <> 0 THEN close END AS close, volume FROM bars UNION ALL SELECT symbol, ts, open, high, low, close + 1, volume + 100 FROM bars WHERE volume % 5 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY volume DESC) AS back FROM u WHERE close IS NOT NULL) SELECT symbol, ts, open, high, low, close, volume, 0::BIGINT AS oi FROM k WHERE back = 1""")
register("daily_benchmark", lambda s, d: rounded(joins.with_daily_benchmark(tables.bars_hourly(s, d), tables.bars_hourly(s, d).where("dayofmonth(ts) % 3 <> 0").groupBy(F.to_date("ts").alias("ts")).agg(F.avg("close").alias("benchmark_close")), True).select("symbol", "ts", "benchmark_close")), f"""WITH {HOURLY}, dd AS (SELECT ts::DATE AS day, avg(close) AS c FROM bars WHERE day(ts) % 3 <> 0 GROUP BY ALL), j AS (SELECT symbol, ts, c FROM bars LEFT JOIN dd ON ts::DATE = day)
SELECT symbol, ts, {r6(f"coalesce(last_value(c IGNORE NULLS) OVER {W}, first_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")} AS benchmark_close FROM j""")
register("aligned_pairs", lambda s, d: pairs.align_pairs(tables.bars_hourly(s, d), _pairs(s, d)), f"WITH {HOURLY} SELECT a.symbol AS a, b.symbol AS b, a.ts, a.close AS xa, b.close AS xb FROM bars a JOIN bars b USING (ts) WHERE a.symbol < b.symbol")
register("cointegration", lambda s, d: rounded(pairs.cointegration(pairs.align_pairs(tables.bars_hourly(s, d), _pairs(s, d)))))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    """All pairs of symbols that have a bar at the same time: the test of pairs is asked of each."""
    b = tables.bars_hourly(s, d)
    return b.select("ts", C("symbol").alias("a")).join(b.select("ts", C("symbol").alias("b")), "ts").where("a < b").select("a", "b").distinct()


register("memberships", lambda s, d: joins.memberships(tables.bars_hourly(s, d).groupBy("symbol").agg(F.max("close").alias("h"), F.sum("volume").alias("v")).select("symbol", F.explode(F.array_compact(F.array(F.when(C("h") > 99.5, "tops"), F.when(C("v") > 1990, "busy"), F.lit("all")))).alias("name"))).select("symbol", F.array_join("universes", ",").alias("universes")), f"""WITH {HOURLY}, g AS (SELECT symbol, max(close) AS h, sum(volume) AS v FROM bars GROUP BY symbol)
SELECT upper(symbol) AS symbol, concat_ws(',', 'all', CASE WHEN v > 1990 THEN 'busy' END, CASE WHEN h > 99.5 THEN 'tops' END) AS universes FROM g""")
register("watchlist", lambda s, d: store.watchlist(tables.table(s, d, "part").select(F.concat(F.lit(" "), "p_brand").alias("symbol"))), "SELECT DISTINCT upper(trim(p_brand)) AS symbol FROM part WHERE trim(p_brand) <> ''")
_HOLIDAYS = ("1996-01-26", "1997-08-15", "1999-12-24", "1999-12-25")
register("trading_days", lambda s, d: with_trading_days(tables.table(s, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", s.createDataFrame([(x,) for x in _HOLIDAYS], "day string").select(C("day").cast("date").alias("day"))).drop("o_orderdate"), f"""WITH hd AS (SELECT unnest([{", ".join(f"DATE '{x}'" for x in _HOLIDAYS)}]) AS day), sp AS (SELECT min(o_orderdate)::DATE - 30 AS a, max(o_orderdate)::DATE + 30 AS b FROM orders), al AS (SELECT unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM sp),
st AS (SELECT day, day IN (SELECT day FROM hd) AS is_holiday, isodow(day) < 6 AND day NOT IN (SELECT day FROM hd) AS is_open FROM al), nx AS (SELECT *, (SELECT min(o.day) FROM st o WHERE o.is_open AND o.day > st.day) AS next_trading_day, (SELECT max(o.day) FROM st o WHERE o.is_open AND o.day < st.day) AS last_trading_day FROM st)
SELECT o_orderkey, is_holiday, is_open, next_trading_day, last_trading_day FROM orders JOIN nx ON o_orderdate::DATE = day""")
_RANKED = {"type": "or", "rules": [{"type": "price_range", "min_price": 40}, {"type": "volume_ratio"}]}
register("scan_ranked", lambda s, d: rules.rank(rules.scan_eod(rules.with_atr_pct(tables.bars_wide(s, d)), _RANKED), "ATR_PCT", limit=20).select("symbol", F.round("atr_pct", 6).alias("atr_pct")), f"""WITH {WIDE}, {NUMBERED}, t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS tr FROM b), a AS (SELECT *, {full(14, 'avg(tr)', 'tr')} AS atr, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back,
coalesce(close >= 40, false) OR coalesce(rn >= 21 AND volume >= 1.5 * avg(volume) OVER {_BEFORE20}, false) AS ok FROM t) SELECT symbol, {r6('100 * atr / close')} AS atr_pct FROM a WHERE back = 1 AND ok ORDER BY 100 * atr / close DESC NULLS LAST, symbol LIMIT 20""")
register("scan_summary", lambda s, d: rules.summary(rules.evaluate(tables.bars_wide(s, d), _ANY2), tables.table(s, d, "supplier").select(C("s_suppkey").cast("string").alias("symbol")).unionByName(_universe(s, "NONE"))), f"{_ANY2_SQL}, s AS (SELECT s_suppkey::VARCHAR AS symbol FROM supplier UNION SELECT 'NONE') SELECT count(*) AS scanned, count_if(coalesce(n >= 2, false))::BIGINT AS passed, count_if(coalesce(n < 2, false))::BIGINT AS failed, count_if(n IS NULL)::BIGINT AS errored FROM s LEFT JOIN (SELECT * FROM a WHERE back = 1) USING (symbol)")
register("scan_live", lambda s, d: rules.scan_live(tables.bars_hourly(s, d), tables.ticks(s, d).select("symbol", (C("ltt") + F.expr("interval 1 hour")).alias("ts"), "ltp", "volume"), {"type": "price_range", "min_price": 30}).select("symbol", "ts", "close", "volume"), """
WITH t AS (SELECT event_type AS symbol, ts, value, count(*) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS v FROM events WHERE value IS NOT NULL), l AS (SELECT symbol, max(ts) + INTERVAL 1 HOUR AS ts, last(value ORDER BY ts) AS close, last(v ORDER BY ts) AS volume FROM t GROUP BY symbol) SELECT * FROM l WHERE close >= 30""")


def _entries(s: SparkSession, d: str) -> DataFrame:
    """An entry at every tick, long and short by turns, with levels far enough to be touched days later."""
    side = F.when(C("event_id") % 2 == 0, "LONG").otherwise("SHORT")
    near, far = C("ltp") * 0.02, C("ltp") * 40.0
    return tables.ticks(s, d).select(C("event_id").alias("entry_id"), "symbol", C("ltt").alias("at"), side.alias("side"), F.when(C("event_id") % 2 == 0, near).otherwise(far).alias("stop"), F.when(C("event_id") % 2 == 0, far).otherwise(near).alias("target"))


register("first_touch", lambda s, d: touch.first_touch(_entries(s, d), tables.ticks(s, d)), """WITH t AS (SELECT event_id, event_type AS symbol, ts, value FROM events WHERE value IS NOT NULL),
x AS (SELECT e.event_id AS entry_id, min(t.ts) AS touched_at, arg_min(t.value, t.ts) AS price FROM t e JOIN t ON t.symbol = e.symbol AND t.ts > e.ts AND (t.value <= e.value * 0.02::DOUBLE OR t.value >= e.value * 40.0::DOUBLE) GROUP BY e.event_id)
SELECT t.event_id AS entry_id, x.touched_at, x.price, CASE WHEN x.price IS NULL THEN NULL WHEN (x.price <= t.value * 0.02::DOUBLE) = (t.event_id % 2 = 0) THEN 'stop' ELSE 'target' END AS reason FROM t LEFT JOIN x ON x.entry_id = t.event_id""")


def _requests(s: SparkSession, d: str) -> DataFrame:
    """Of each symbol of the wide bars, and one that the store lacks, from before its first bar to after its last."""
    b = tables.bars_wide(s, d)
    own = b.groupBy("symbol").agg(F.date_sub(F.to_date(F.min("ts")), F.expr("cast(symbol as int) % 9")).alias("start"), F.date_add(F.to_date(F.max("ts")), F.expr("cast(symbol as int) % 3")).alias("stop"))
    return own.unionByName(b.agg(F.lit("none").alias("symbol"), F.to_date(F.min("ts")).alias("start"), F.to_date(F.max("ts")).alias("stop")))


register("fetch_holes", lambda s, d: store.holes(_requests(s, d), tables.bars_wide(s, d)), f"""WITH {WIDE}, r AS (SELECT symbol, min(ts)::DATE - (symbol::INT % 9)::INT AS start, max(ts)::DATE + (symbol::INT % 3)::INT AS stop FROM bars GROUP BY symbol UNION ALL SELECT 'none', min(ts)::DATE, max(ts)::DATE FROM bars),
p AS (SELECT DISTINCT r.*, bars.ts::DATE AS day, 5 AS least FROM r JOIN bars USING (symbol) WHERE bars.ts::DATE BETWEEN start AND stop UNION ALL SELECT *, stop + 1, 0 FROM r),
g AS (SELECT *, coalesce(lag(day) OVER (PARTITION BY symbol ORDER BY day), start - 1) AS before FROM p) SELECT symbol, (before + 1)::DATE AS start, (day - 1)::DATE AS stop FROM g WHERE day - before - 1 > least""")


def _messages(s: SparkSession, d: str) -> DataFrame:
    """Feed messages of one instrument each, made of events: every third with depth and greeks."""
    t = tables.ticks(s, d)
    ltpc = F.struct(C("ltp"), F.unix_millis(C("ltt").cast("timestamp")).cast("string").alias("ltt"), F.lit("3").alias("ltq"), (C("ltp") - 1).alias("cp"))
    quote = F.array_repeat(F.struct(F.lit("5").alias("bq"), (C("ltp") - 0.5).alias("bp"), F.lit("6").alias("aq"), (C("ltp") + 0.5).alias("ap")), (C("event_id") % 9).cast("int"))
    market = F.struct(ltpc.alias("ltpc"), F.struct(quote.alias("bidAskQuote")).alias("marketLevel"), F.struct(C("volume").alias("vtt"), F.lit(7.0).alias("oi")).alias("eFeedDetails"), F.when(C("event_id") % 6 == 0, F.struct(F.lit(0.5).alias("delta"))).alias("optionGreeks"))
    whole = F.struct(F.when(C("event_id") % 3 == 0, F.struct(market.alias("marketFF"))).alias("fullFeed"), F.when(C("event_id") % 3 != 0, ltpc).alias("ltpc"))
    return t.select(F.to_json(F.struct(F.create_map("symbol", whole).alias("feeds"))).alias("value"))


register("feed_ticks", lambda s, d: tk.parse_feed(_messages(s, d)).select("instrument_key", "ltp", C("ltt").cast("timestamp_ntz").alias("ltt"), "ltq", "close_price", "volume", "oi", F.greatest(F.size("depth"), F.lit(0)).alias("levels"), F.try_element_at("depth", F.lit(1))["ask_qty"].alias("ask_qty"), "feed_mode"), """
WITH t AS (SELECT *, count(*) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS v, event_id % 3 = 0 AS f FROM events WHERE value IS NOT NULL) SELECT event_type AS instrument_key, value AS ltp, date_trunc('millisecond', ts) AS ltt, 3::BIGINT AS ltq, value - 1 AS close_price, CASE WHEN f THEN v END AS volume, CASE WHEN f THEN 7::BIGINT END AS oi,
CASE WHEN f THEN event_id % 9 ELSE 0 END::INTEGER AS levels, CASE WHEN f AND event_id % 9 > 0 THEN 6::BIGINT END AS ask_qty, CASE WHEN event_id % 6 = 0 THEN 'option_greeks' WHEN f AND event_id % 9 > 5 THEN 'full_d30' WHEN f THEN 'full' ELSE 'ltpc' END AS feed_mode FROM t WHERE value > 0""")
register("rest_ticks", lambda s, d: tk.parse_rest(tables.ticks(s, d).select(F.to_json(F.struct(F.create_map("symbol", F.struct(C("ltp").alias("last_price"), (C("ltp") - 2).alias("close_price"), "volume")).alias("data"))).alias("value"), C("ltt").alias("received_at"))), """
SELECT event_type AS instrument_key, value AS ltp, ts AS ltt, value - 2 AS close_price, count(*) OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS volume FROM events WHERE value IS NOT NULL QUALIFY value > 0""")
register("decoded_candles", lambda s, d: store.decode_candles(tables.bars_hourly(s, d).select("symbol", F.to_json(F.array(F.array(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")), *(C(c).cast("string") for c in ("open", "high", "low", "close", "volume"))))).alias("payload"))), f"WITH {HOURLY} SELECT symbol, ts + INTERVAL 330 MINUTE AS ts, open, high, low, close, volume, 0::BIGINT AS oi FROM bars")
register("distinct_ticks", lambda s, d: tk.distinct_ticks(tables.ticks(s, d).select("symbol", F.date_trunc("minute", "ltt").alias("ltt"))), "SELECT DISTINCT event_type AS symbol, date_trunc('minute', ts) AS ltt FROM events WHERE value IS NOT NULL")
register("depth_ticks", lambda s, d: rounded(tk.with_depth(tk.parse_feed(_messages(s, d))).select("instrument_key", C("ltt").cast("timestamp_ntz").alias("ltt"), "best_bid", "best_ask", "spread", "imbalance")), f"""
SELECT event_type AS instrument_key, date_trunc('millisecond', ts) AS ltt, {r6('value - 0.5::DOUBLE')} AS best_bid, {r6('value + 0.5::DOUBLE')} AS best_ask, 1.0::DOUBLE AS spread, {r6('-5 / 55.0::DOUBLE')} AS imbalance FROM events WHERE value > 0 AND event_id % 3 = 0 AND event_id % 9 >= 5""")


def _frames(s: SparkSession, d: str) -> DataFrame:
    """Bars of one event each, by user; some without a time, some blank."""
    e, blank = tables.table(s, d, "events"), C("event_id") % 50 == 7
    return e.select(F.concat(F.lit("u"), "user_id").alias("symbol"), F.when(C("event_id") % 500 != 0, C("ts")).alias("ts"), *(F.when(~blank, C("value")).alias(c) for c in ("open", "high", "low", "close")), F.when(~blank, 1).alias("volume"))


register("frame_checks", lambda s, d: quality.frame_checks(_frames(s, d), _frames(s, d).select("symbol").unionByName(_universe(s, "none"))), """
WITH f AS (SELECT 'u' || user_id AS symbol, event_id, event_id % 50 = 7 AS blank FROM events), g AS (SELECT symbol, count(*) AS bars, bool_or(event_id % 500 = 0) AS timeless, bool_or(blank) AS blank FROM f GROUP BY symbol UNION ALL SELECT 'none', 0, false, false),
r AS (SELECT symbol, bars, CASE WHEN bars = 0 THEN 'empty' WHEN timeless THEN 'no time' WHEN blank THEN 'blank bar' END AS reason FROM g) SELECT symbol, bars, reason IS NULL AS is_valid, reason FROM r""")
_WEIGHTED = {"type": "or", "rules": [{"type": "rsi", "period": 14, "threshold": 45, "direction": "below", "weight": 3.0}, {"type": "volume_breakout", "weight": 0.5}, {"type": "price_range", "min_price": 90, "weight": 1.5}]}
register("scan_weighted", lambda s, d: rules.evaluate(tables.bars_hourly(s, d), _WEIGHTED, weighted=True).where("passed").select("symbol", "ts", F.round("score", 6).alias("score")), f"""WITH RECURSIVE {HOURLY}, {NUMBERED}, {q.RSI},
a AS (SELECT *, coalesce(rn >= 15 AND r < 45, false) AS p1, coalesce(rn >= 21 AND volume >= 2 * avg(volume) OVER {_BEFORE20}, false) AS p2, close >= 90 AS p3 FROM rs)
SELECT symbol, ts, round((3.0::DOUBLE * p1::INT + 0.5::DOUBLE * p2::INT + 1.5::DOUBLE * p3::INT) / 5.0::DOUBLE, 6) AS score FROM a WHERE p1 OR p2 OR p3""")


def _audited(s: SparkSession, d: str) -> DataFrame:
    """Signals and closed trades as two batches of an audit trail, one of which comes twice, and its entries of two weeks."""
    path = f"{shared_dir(s)}/{uuid.uuid4().hex}"
    closed = journal.closing_entries(_day_trades(s, d))
    journal.append(journal.signal_entries(_signals("ema_crossover")(s, d), "ema_crossover"), path, "signals")
    for _ in range(2):
        journal.append(closed, path, "closed")
    return rounded(journal.between(s, path, "2024-01-08 00:00:00", "2024-01-22 12:00:00"), 4)


register("audit_trail", _audited, f"""WITH e AS (SELECT ts AS at, 'SIGNAL' AS event_type, symbol, CASE WHEN signal > 0 THEN 'LONG' ELSE 'SHORT' END AS action, 0.0::DOUBLE AS price, 'Strategy: ema_crossover, Reason: ' || signal_tag AS reason, 'GENERATED' AS result FROM ({SQL["signals_ema_crossover"]}) WHERE signal <> 0
UNION ALL SELECT exit_time, 'POSITION_CLOSED', symbol, 'LONG', {r6('exit_price', 4)}, 'PnL: ' || round(net_pnl, 4)::DECIMAL(18,4)::VARCHAR, 'CLOSED' FROM (WITH {_TRADES} SELECT * FROM trades)) SELECT * FROM e WHERE e.at BETWEEN '2024-01-08' AND '2024-01-22 12:00:00'""")
register("session_stats", lambda s, d: journal.session_stats(tables.ticks(s, d).select("symbol", C("ltt").cast("timestamp_ntz").alias("ltt")), tables.bars_minutely(s, d), _day_trades(s, d).withColumnRenamed("entry_time", "created_at")), f"""WITH {_TRADES},
t AS (SELECT ts::DATE AS day, count(DISTINCT event_type) AS symbols, count(*) AS ticks_received, count(DISTINCT (event_type, date_trunc('minute', ts))) AS candles_completed, min(ts) AS started_at, max(ts) AS ended_at FROM events WHERE value IS NOT NULL GROUP BY ts::DATE),
o AS (SELECT day, count(*) AS n FROM trades GROUP BY day) SELECT t.*, coalesce(n, 0)::BIGINT AS orders_placed FROM t LEFT JOIN o USING (day)""")
