"""Parts of the SQL that queries are compared with: chart patterns, candlesticks, recursive indicators and signals, for DuckDB.

Written from the definitions, not from the columns that the library builds.
"""

from __future__ import annotations

W = "(PARTITION BY symbol ORDER BY ts)"
PREV = "(PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
TR = f"tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER {W}), abs(low - lag(close) OVER {W})) AS x FROM b)"


def ewm(name: str, source: str, x: str, alpha: float, start: int = 1) -> str:
    """A recursive smoothing of x of a numbered table, as a common table expression."""
    return f"{name} AS (SELECT symbol, rn, {x} AS y FROM {source} WHERE rn = {start} UNION ALL SELECT s.symbol, s.rn, {alpha!r}::DOUBLE * s.{x} + (1 - {alpha!r}::DOUBLE) * e.y FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.rn = e.rn + 1)"


MACD = f"{ewm('e', 'b', 'close', 2 / 13)}, {ewm('f', 'b', 'close', 2 / 27)}, l AS (SELECT symbol, rn, e.y - f.y AS line FROM e JOIN f USING (symbol, rn) WHERE rn >= 26), {ewm('g', 'l', 'line', 2 / 10, 26)}, src AS (SELECT b.*, line, CASE WHEN rn >= 34 THEN g.y END AS sig FROM b LEFT JOIN l USING (symbol, rn) LEFT JOIN g USING (symbol, rn))"
RSI = f"""d AS (SELECT *, greatest(close - lag(close) OVER {W}, 0) AS g, greatest(lag(close) OVER {W} - close, 0) AS l FROM b), {ewm('up', 'd', 'g', 1 / 14, 2)}, {ewm('dn', 'd', 'l', 1 / 14, 2)},
rs AS (SELECT b.*, CASE WHEN rn >= 15 THEN CASE WHEN up.y = 0 THEN 0 WHEN dn.y = 0 THEN 100 ELSE 100 - 100 / (1 + up.y / dn.y) END END AS r FROM b LEFT JOIN up USING (symbol, rn) LEFT JOIN dn USING (symbol, rn))"""
SUPERTREND = f"""{TR}, {ewm('ea', 'tr', 'x', 1 / 10)}, k AS (SELECT b.*, (high + low) / 2 + 3 * y AS bu, (high + low) / 2 - 3 * y AS bl, lag(close) OVER {W} AS pc FROM b JOIN ea USING (symbol, rn)),
st AS (SELECT symbol, rn, bu AS up, bl AS lo, 1 AS side FROM k WHERE rn = 10 UNION ALL SELECT symbol, rn, up, lo, CASE WHEN side = -1 AND close > up THEN 1 WHEN side = 1 AND close < lo THEN -1 ELSE side END FROM
  (SELECT k.symbol, k.rn, k.close, st.side, CASE WHEN k.bu < st.up OR k.pc > st.up THEN k.bu ELSE st.up END AS up, CASE WHEN k.bl > st.lo OR k.pc < st.lo THEN k.bl ELSE st.lo END AS lo FROM st JOIN k ON k.symbol = st.symbol AND k.rn = st.rn + 1)),
trend AS (SELECT b.*, CASE WHEN side = 1 THEN lo ELSE up END AS line, coalesce(side, 0) AS side, coalesce(lag(side) OVER {W}, 0) AS side1 FROM b LEFT JOIN st USING (symbol, rn))"""
ADX = f"""{TR}, mv AS (SELECT *, high - lag(high) OVER {W} AS u, lag(low) OVER {W} - low AS v FROM tr), mw AS (SELECT *, CASE WHEN u > v AND u > 0 THEN u ELSE 0 END AS up, CASE WHEN v > u AND v > 0 THEN v ELSE 0 END AS dn FROM mv),
{ewm('t', 'mw', 'x', 1 / 14)}, {ewm('pu', 'mw', 'up', 1 / 14)}, {ewm('pd', 'mw', 'dn', 1 / 14)},
di AS (SELECT symbol, rn, CASE WHEN rn >= 14 THEN 100 * pu.y / nullif(t.y, 0) END AS p, CASE WHEN rn >= 14 THEN 100 * pd.y / nullif(t.y, 0) END AS m FROM t JOIN pu USING (symbol, rn) JOIN pd USING (symbol, rn)),
dx AS (SELECT *, 100 * abs(p - m) / nullif(p + m, 0) AS d FROM di), {ewm('ax', 'dx', 'd', 1 / 14, 14)}, src AS (SELECT b.*, p, m, CASE WHEN rn >= 27 THEN ax.y END AS z FROM b JOIN di USING (symbol, rn) LEFT JOIN ax USING (symbol, rn))"""


def band(n: int, f: str) -> str:
    over = f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN rn >= {n} THEN {f}(close) {over} END"


SQUEEZE = f"""{ewm('e', 'b', 'close', 2 / 21)}, {TR}, {ewm('ra', 'tr', 'x', 1 / 20)},
bands AS (SELECT b.*, {band(20, 'avg')} AS mid, {band(20, 'stddev_samp')} AS sd, CASE WHEN rn >= 20 THEN e.y END AS em, CASE WHEN rn >= 20 THEN ra.y END AS ar FROM b JOIN e USING (symbol, rn) JOIN ra USING (symbol, rn))"""


def swings(w: int, name: str = "sw") -> str:
    around = f"(PARTITION BY symbol ORDER BY ts ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING)"
    return f"{name} AS (SELECT *, CASE WHEN count(*) OVER {around} = {2 * w + 1} AND high = max(high) OVER {around} THEN high END AS sh, CASE WHEN count(*) OVER {around} = {2 * w + 1} AND low = min(low) OVER {around} THEN low END AS sl FROM bars)"


#: Structure as screens see it: swings count 5 bars later.
STRUCTURE = f"""{swings(5)}, kn AS (SELECT *, row_number() OVER {W} AS rn, lag(sh, 5) OVER {W} AS kh, lag(sl, 5) OVER {W} AS kl FROM sw), pv AS (SELECT *, last_value(kh IGNORE NULLS) OVER {PREV} AS ph, last_value(kl IGNORE NULLS) OVER {PREV} AS pl FROM kn),
told AS (SELECT *, CASE WHEN kh > ph THEN 1 WHEN kh < ph THEN -1 END AS th, CASE WHEN kl > pl THEN 1 WHEN kl < pl THEN -1 END AS tl, CASE WHEN kh IS NOT NULL THEN coalesce(kh > ph, false) END AS hh, CASE WHEN kl IS NOT NULL THEN coalesce(kl < pl, false) END AS ll FROM pv),
src AS (SELECT *, last_value(th IGNORE NULLS) OVER {W} AS lh, last_value(tl IGNORE NULLS) OVER {W} AS ltl, last_value(hh IGNORE NULLS) OVER {W} AS last_hh, last_value(ll IGNORE NULLS) OVER {W} AS last_ll FROM told)"""


def charts(w: int, known: bool, name: str) -> str:
    """Tables that end in `name`: each bar with its last three swings on both sides and the two lines through the last two."""
    sh, sl = (f"lag(sh, {w}) OVER {W}", f"lag(sl, {w}) OVER {W}") if known else ("sh", "sl")
    of = lambda side, k: f"LEFT JOIN {name}_{side} {side}{k} ON {side}{k}.symbol = n.symbol AND {side}{k}.k = n.n{side} - {k - 1}"
    columns = ", ".join(f"{s}{k}.v AS {s}{k}, {s}{k}.p AS {s}{k}p" for s in "hl" for k in (1, 2, 3))
    return f"""{swings(w, name + '_sw')}, {name}_a AS (SELECT *, row_number() OVER {W} AS rn, lag(close) OVER {W} AS c1, {sh} AS ah, {sl} AS al FROM {name}_sw),
{name}_n AS (SELECT *, count(ah) OVER {W} AS nh, count(al) OVER {W} AS nl FROM {name}_a),
{name}_h AS (SELECT symbol, rn AS p, ah AS v, nh AS k FROM {name}_n WHERE ah IS NOT NULL), {name}_l AS (SELECT symbol, rn AS p, al AS v, nl AS k FROM {name}_n WHERE al IS NOT NULL),
{name}_j AS (SELECT n.*, {columns} FROM {name}_n n {' '.join(of(s, k) for s in 'hl' for k in (1, 2, 3))}),
{name}_s AS (SELECT *, (h1 - h2) / greatest(h1p - h2p, 1) AS ts_, (l1 - l2) / greatest(l1p - l2p, 1) AS bs FROM {name}_j),
{name}_t AS (SELECT *, h1 + ts_ * (rn - h1p) AS top, l1 + bs * (rn - l1p) AS bot, l2 + bs * (rn - l2p) AS under, h2 + ts_ * (rn - h2p) AS over_, rn > greatest(h1p, l1p) AS later FROM {name}_s),
{name} AS (SELECT *, close > top AND c1 <= top - ts_ AS up_, close < bot AND c1 >= bot - bs AS down_ FROM {name}_t)"""


SYMMETRICAL = "CASE WHEN ts_ < 0 AND bs > 0 AND later AND down_ THEN -1 WHEN ts_ < 0 AND bs > 0 AND later AND up_ THEN 1 ELSE 0 END"
CHARTS = {
    "triangle_ascending": "CASE WHEN abs(h1 - h2) / greatest(h1, 0.00001) < 0.02 AND l1 > l2 * 1.005 AND up_ AND later THEN 1 ELSE 0 END",
    "triangle_descending": "CASE WHEN abs(l1 - l2) / greatest(l1, 0.00001) < 0.02 AND h1 < h2 * 0.995 AND down_ AND later THEN -1 ELSE 0 END",
    "triangle_symmetrical": SYMMETRICAL,
    "flag_bullish": "CASE WHEN ts_ < 0 AND bs < 0 AND abs(ts_ - bs) < 0.5 * greatest(abs(ts_), 0.00001) AND up_ AND later THEN 1 ELSE 0 END",
    "flag_bearish": "CASE WHEN ts_ > 0 AND bs > 0 AND abs(ts_ - bs) < 0.5 * greatest(abs(ts_), 0.00001) AND down_ AND later THEN -1 ELSE 0 END",
    "wedge_rising": "CASE WHEN ts_ > 0 AND bs > 0 AND bs > ts_ AND down_ AND later THEN -1 ELSE 0 END",
    "wedge_falling": "CASE WHEN ts_ < 0 AND bs < 0 AND ts_ < bs AND up_ AND later THEN 1 ELSE 0 END",
    "double_top": "CASE WHEN abs(h1 - h2) / greatest(h1, 0.00001) < 0.03 AND h2p < l1p AND l1p < h1p AND close < l1 AND c1 >= l1 AND rn > h1p THEN -1 ELSE 0 END",
    "double_bottom": "CASE WHEN abs(l1 - l2) / greatest(l1, 0.00001) < 0.03 AND l2p < h1p AND h1p < l1p AND close > h1 AND c1 <= h1 AND rn > l1p THEN 1 ELSE 0 END",
    "head_and_shoulders": "CASE WHEN h2 > h1 AND h2 > h3 AND abs(h1 - h3) / greatest(h1, h3, 0.00001) < 0.05 AND h3p < l2p AND l2p < h2p AND h2p < l1p AND l1p < h1p AND close < under AND c1 >= under - bs AND rn > h1p THEN -1 ELSE 0 END",
    "inverse_head_and_shoulders": "CASE WHEN l2 < l1 AND l2 < l3 AND abs(l1 - l3) / greatest(l1, l3, 0.00001) < 0.05 AND l3p < h2p AND h2p < l2p AND l2p < h1p AND h1p < l1p AND close > over_ AND c1 <= over_ - ts_ AND rn > l1p THEN 1 ELSE 0 END",
    "cup_and_handle": "CASE WHEN abs(h3 - h2) / greatest(h3, h2, 0.00001) < 0.05 AND h1 < h2 AND (h2 - l2) / greatest(h2, 0.00001) > 0.05 AND l1 > l2 + 0.3 * (h2 - l2) AND h3p < l2p AND l2p < h2p AND h2p < l1p AND l1p < h1p AND close > h2 AND c1 <= h2 AND rn > h1p THEN 1 ELSE 0 END",
}

#: Bars with the two before them; d: close - open, of this bar and of those before.
CANDLE_BARS = f"""cb AS (SELECT symbol, ts, open AS o, high AS h, low AS l, close AS c, close - open AS d, high - low AS g,
  lag(open) OVER {W} AS o1, lag(high) OVER {W} AS h1, lag(low) OVER {W} AS l1, lag(close) OVER {W} AS c1, lag(close - open) OVER {W} AS d1, lag(high - low) OVER {W} AS g1,
  lag(open, 2) OVER {W} AS o2, lag(high, 2) OVER {W} AS h2, lag(low, 2) OVER {W} AS l2, lag(close, 2) OVER {W} AS c2, lag(close - open, 2) OVER {W} AS d2 FROM bars)"""
_TOP, _FOOT = "(h - greatest(o, c))", "(least(o, c) - l)"
_IN = "greatest(o, c) < greatest(o1, c1) AND least(o, c) > least(o1, c1)"
_IN1 = "greatest(o1, c1) < greatest(o2, c2) AND least(o1, c1) > least(o2, c2)"
_OUT = "abs(d) > abs(d1) AND greatest(o, c) > greatest(o1, c1) AND least(o, c) < least(o1, c1)"
_OUT1 = "abs(d1) > abs(d2) AND greatest(o1, c1) > greatest(o2, c2) AND least(o1, c1) < least(o2, c2)"
_SMOOTH = f"{_TOP} <= 0.05 * g AND {_FOOT} <= 0.05 * g AND d <> 0"
_SMOOTH1 = "h1 - greatest(o1, c1) <= 0.05 * g1 AND least(o1, c1) - l1 <= 0.05 * g1"
# When each pattern is +1 and when it is -1.
CANDLES = {
    "doji": ("abs(d) <= 0.1 * g", "false"), "hammer": (f"{_FOOT} >= 2 * abs(d) AND {_TOP} <= 0.1 * g AND g > 0", "false"), "hanging_man": ("false", f"{_FOOT} >= 2 * abs(d) AND {_TOP} <= 0.1 * g AND d <> 0"),
    "inverted_hammer": (f"{_TOP} >= 2 * abs(d) AND {_FOOT} <= 0.1 * g AND d <> 0", "false"), "shooting_star": ("false", f"{_TOP} >= 2 * abs(d) AND {_FOOT} <= 0.1 * g AND d <> 0"),
    "bullish_engulfing": (f"d1 < 0 AND d > 0 AND {_OUT}", "false"), "bearish_engulfing": (f"d1 > 0 AND d < 0 AND {_OUT}", "false"),
    "morning_star": ("d2 < 0 AND abs(d1) <= 0.3 * g1 AND d > 0 AND c > (o2 + c2) / 2", "false"), "evening_star": ("false", "d2 > 0 AND abs(d1) <= 0.3 * g1 AND d < 0 AND c < (o2 + c2) / 2"),
    "three_white_soldiers": ("d > 0 AND d1 > 0 AND d2 > 0 AND c > c1 AND c1 > c2", "false"), "three_black_crows": ("false", "d < 0 AND d1 < 0 AND d2 < 0 AND c < c1 AND c1 < c2"),
    "marubozu": (f"d > 0 AND {_SMOOTH}", f"d < 0 AND {_SMOOTH}"),
    "dragonfly_doji": (f"abs(d) <= 0.1 * g AND {_TOP} <= 0.1 * g AND {_FOOT} > 0.5 * g", "false"), "gravestone_doji": (f"abs(d) <= 0.1 * g AND {_FOOT} <= 0.1 * g AND {_TOP} > 0.5 * g", "false"),
    "harami": (f"d1 < 0 AND d > 0 AND {_IN}", f"d1 > 0 AND d < 0 AND {_IN}"), "harami_cross": (f"d1 < 0 AND abs(d) <= 0.1 * g AND {_IN}", f"d1 > 0 AND abs(d) <= 0.1 * g AND {_IN}"),
    "piercing_pattern": ("d1 < 0 AND d > 0 AND o < c1 AND c > (o1 + c1) / 2 AND c < o1", "false"), "dark_cloud_cover": ("false", "d1 > 0 AND d < 0 AND o > c1 AND c < (o1 + c1) / 2 AND c > o1"),
    "spinning_top": (f"d > 0 AND abs(d) <= 0.3 * g AND {_TOP} > abs(d) AND {_FOOT} > abs(d)", f"d < 0 AND abs(d) <= 0.3 * g AND {_TOP} > abs(d) AND {_FOOT} > abs(d)"),
    "tweezer_top": ("false", "abs(h - h1) < h * 0.0001 AND d < 0"), "tweezer_bottom": ("abs(l - l1) < l * 0.0001 AND d > 0", "false"),
    "abandoned_baby": ("d2 < 0 AND abs(d1) <= 0.1 * g1 AND d > 0 AND h1 < least(l2, l) AND l1 < least(l2, l)", "d2 > 0 AND abs(d1) <= 0.1 * g1 AND d < 0 AND l1 > greatest(h2, h) AND h1 > greatest(h2, h)"),
    "three_inside_up": (f"d2 < 0 AND d1 > 0 AND {_IN1} AND d > 0 AND c > c1", "false"), "three_inside_down": (f"d2 > 0 AND d1 < 0 AND {_IN1} AND d < 0 AND c < c1", "false"),
    "three_outside_up": (f"d2 < 0 AND d1 > 0 AND {_OUT1} AND d > 0 AND c > c1", "false"), "three_outside_down": (f"d2 > 0 AND d1 < 0 AND {_OUT1} AND d < 0 AND c < c1", "false"),
    "kicking": (f"d1 < 0 AND {_SMOOTH1} AND d > 0 AND {_SMOOTH} AND o > o1", f"d1 > 0 AND {_SMOOTH1} AND d < 0 AND {_SMOOTH} AND o < o1"),
}


def machine(source: str, long_in: str, short_in: str, long_out: str = "false", short_out: str = "false") -> str:
    """A table `mc` (symbol, rn, pos, sig): entries and exits of a position that may be long, flat or short, over a numbered source."""
    c = f"mi AS (SELECT symbol, rn, coalesce({long_in}, false) AS li, coalesce({short_in}, false) AS si, coalesce({long_out}, false) AS lo, coalesce({short_out}, false) AS so FROM {source})"
    pos = "CASE WHEN {p} <= 0 AND li THEN 1 WHEN {p} >= 0 AND si THEN -1 WHEN {p} > 0 AND lo THEN 0 WHEN {p} < 0 AND so THEN 0 ELSE {p} END"
    sig = "CASE WHEN {p} <= 0 AND li THEN 1 WHEN {p} >= 0 AND si THEN -1 WHEN {p} > 0 AND lo THEN -1 WHEN {p} < 0 AND so THEN 1 ELSE 0 END"
    return f"{c}, mc AS (SELECT symbol, rn, {pos.format(p='0')} AS pos, {sig.format(p='0')} AS sig FROM mi WHERE rn = 1 UNION ALL SELECT mi.symbol, mi.rn, {pos.format(p='pos')}, {sig.format(p='pos')} FROM mc JOIN mi ON mi.symbol = mc.symbol AND mi.rn = mc.rn + 1)"


def signals(source: str, warmup: int, up: str, down: str, stop: str = "NULL::DOUBLE", target: str = "NULL::DOUBLE", confidence: str = "1.0::DOUBLE") -> str:
    """The signal columns, from a source and mc."""
    r6 = lambda x: f"CASE WHEN round({x}, 6) = 0 THEN 0.0::DOUBLE ELSE round({x}, 6) END"
    return f"""SELECT symbol, ts, signal::INTEGER AS signal, CASE signal WHEN 1 THEN '{up}' WHEN -1 THEN '{down}' ELSE '' END AS signal_tag, CASE WHEN signal <> 0 THEN {r6(stop)} END AS stop_loss, CASE WHEN signal <> 0 THEN {r6(target)} END AS take_profit,
CASE WHEN signal <> 0 THEN {r6(confidence)} ELSE 0.0::DOUBLE END AS confidence FROM (SELECT s.*, CASE WHEN rn > {warmup} THEN mc.sig ELSE 0 END AS signal FROM {source} s JOIN mc USING (symbol, rn))"""
