"""Pairs of symbols: alignment, and the Engle-Granger test for a common long-run level."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ratio

C = F.col
# MacKinnon's response surface for one series with a constant: limits of the statistic, and polynomials of its
# normal quantile below and above the middle one.
_LEAST, _MIDDLE, _MOST = -18.83, -1.61, 2.74
_LOW, _HIGH = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def align_pairs(bars: DataFrame, pairs: DataFrame, x: str = "close") -> DataFrame:
    """(a, b, ts, xa, xb): values of both symbols of each pair (a, b) at the times that both have one."""
    one = bars.where(C(x).isNotNull()).select("symbol", "ts", C(x).cast("double").alias("x"))
    left = pairs.select("a", "b").distinct().join(one.select(C("symbol").alias("a"), "ts", C("x").alias("xa")), "a")
    return left.join(one.select(C("symbol").alias("b"), "ts", C("x").alias("xb")), ["b", "ts"]).select("a", "b", "ts", "xa", "xb")


def p_value(statistic: float) -> float:
    if statistic > _MOST:
        return 1.0
    if statistic < _LEAST:
        return 0.0
    z = sum(c * statistic**k for k, c in enumerate(_LOW if statistic <= _MIDDLE else _HIGH))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _most_lags(n: int) -> int:
    return min(n // 2 - 2, math.ceil(12 * (n / 100) ** 0.25))


class UnitRoot:
    """The augmented Dickey-Fuller statistic of a series that comes in blocks, lags chosen by AIC.

    Only products of the regression's columns are kept, the last values and the first ones: what it needs grows with the
    lags, not with the series.
    """

    def __init__(self, n: int):
        self.lags = _most_lags(n)
        self.last, self.first = np.zeros(0), np.zeros(0)
        self.products = np.zeros((self.lags + 3, self.lags + 3))
        self.rows = 0

    def _columns(self, x: np.ndarray, lags: int) -> np.ndarray:
        """1, the level before, the changes before, newest first, and last the change, for each place that has them all."""
        d = np.diff(x)
        n = len(d) - lags
        return np.column_stack([np.ones(n), x[lags : lags + n], *(d[lags - k : lags - k + n] for k in range(1, lags + 1)), d[lags:]]) if n > 0 else np.zeros((0, lags + 3))

    def add(self, block: np.ndarray) -> None:
        keep = self.lags + 1
        if len(self.first) < 2 * keep:
            self.first = np.concatenate([self.first, block])[: 2 * keep]
        x = np.concatenate([self.last, block])
        z = self._columns(x, self.lags)
        self.products += z.T @ z
        self.rows += len(z)
        self.last = x[-keep:]

    @staticmethod
    def _fit(g: np.ndarray, k: int) -> tuple[np.ndarray, float]:
        b = np.linalg.lstsq(g[:k, :k], g[:k, -1], rcond=None)[0]
        return b, max(float(g[-1, -1] - b @ g[:k, -1]), 0.0)

    def statistic(self) -> float:
        n, best = self.rows, None
        for k in range(2, self.lags + 3):
            rest = self._fit(self.products, k)[1]
            score = n * math.log(max(rest / n, 1e-300)) + 2 * k
            if best is None or score < best[0]:
                best = (score, k - 2)
        lags = best[1]
        # The chosen lags leave more rows than the largest: those at the start of the series.
        cols = [0, 1, *range(2, 2 + lags), -1]
        g = self.products[np.ix_(cols, cols)].copy()
        early = self._columns(self.first[: self.lags + 1], lags)
        g += early.T @ early
        n += len(early)
        b, rest = self._fit(g, lags + 2)
        spread = rest / (n - lags - 2) * np.linalg.pinv(g[:-1, :-1])[1, 1]
        return float(b[1] / math.sqrt(spread)) if spread > 0 else 0.0


def cointegration(aligned: DataFrame, significance: float = 0.05, least: int = 30) -> DataFrame:
    """(a, b, n, hedge_ratio, adf_statistic, p_value, is_cointegrated) of align_pairs().

    The rest of a regression of xa on xb is tested for a unit root. Pairs of fewer than `least` common times are left out.
    Tasks stream through a pair in order of time.
    """
    fit = aligned.groupBy("a", "b").agg(F.count("*").alias("n"), ratio(F.covar_pop("xa", "xb"), F.var_pop("xb")).alias("slope"), F.avg("xa").alias("ma"), F.avg("xb").alias("mb")).where(C("n") >= least)
    fit = fit.withColumn("slope", F.coalesce("slope", F.lit(0.0)))
    d = aligned.join(fit, ["a", "b"]).select("a", "b", "ts", "n", "slope", (C("xa") - C("ma") - C("slope") * (C("xb") - C("mb"))).alias("e"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, test = None, None

        def done() -> pd.DataFrame:
            s = test.statistic()
            p = p_value(s)
            return pd.DataFrame([(*now, s, p, p < significance)], columns=["a", "b", "n", "hedge_ratio", "adf_statistic", "p_value", "is_cointegrated"])

        for batch in batches:
            for at, part in batch.groupby(["a", "b", "n", "slope"], sort=False):
                if at != now:
                    if test:
                        yield done()
                    now, test = at, UnitRoot(int(at[2]))
                test.add(part["e"].to_numpy("float64"))
        if test:
            yield done()

    return d.repartition("a", "b").sortWithinPartitions("a", "b", "ts").mapInPandas(run, "a string, b string, n long, hedge_ratio double, adf_statistic double, p_value double, is_cointegrated boolean")
