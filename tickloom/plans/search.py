"""Searches for parameters: each set is an account column, so that all are simulated side by side."""

from __future__ import annotations

import itertools
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import fold as folds
from .backtest import Config, simulate
from .performance import equity_metrics
from .strategies import Strategy

C = F.col


def combinations(grid: dict[str, list], sample: int = 0, seed: int = 7) -> list[dict]:
    """All sets of a grid, or `sample` different ones of them."""
    every = [dict(zip(grid, x, strict=True)) for x in itertools.product(*grid.values())]
    return random.Random(seed).sample(every, sample) if 0 < sample < len(every) else every


def all_signals(bars: DataFrame, strategies: list[Strategy]) -> DataFrame:
    """(param_id, bars, signal, stop_loss, take_profit) of strategies of one class. Those of one preparation run as folds of one pass over the bars."""
    kinds: dict[str, list[int]] = {}
    for i, x in enumerate(strategies):
        kinds.setdefault("" if type(x).prepared is Strategy.prepared else str(i), []).append(i)
    out = None
    for group in kinds.values():
        d = folds.fold(strategies[group[0]].prepared(bars), *(strategies[i].fold(f"_{i}") for i in group))
        each = F.array(*(F.struct(F.lit(f"p{i}").alias("param_id"), *(C(f"{c}_{i}").alias(c) for c in ("signal", "stop_loss", "take_profit"))) for i in group))
        d = d.select(*bars.columns, F.explode(each).alias("_s")).select(*bars.columns, "_s.*")
        out = d if out is None else out.unionByName(d)
    return out


def _written(equity: DataFrame) -> DataFrame:
    """The simulated curve, which several aggregates read, written once where there is a folder for it."""
    return equity.checkpoint() if equity.sparkSession.sparkContext.getCheckpointDir() else equity


def grid_search(bars: DataFrame, strategy: type[Strategy], grid: dict[str, list], config: Config = Config(), metric: str = "sharpe", top: int = 10, sample: int = 0) -> DataFrame:
    """(param_id, symbol, parameters, metrics) of the best sets for each symbol; sets without the metric are left out."""
    sets = combinations(grid, sample)
    signals = all_signals(bars, [strategy.of(**p) for p in sets])
    equity = simulate(signals, config, ["param_id", "symbol"])
    m = equity_metrics(_written(equity.drop("trades")), "param_id", "symbol").where(C(metric).isNotNull())
    names = F.create_map(*(y for i, p in enumerate(sets) for y in (F.lit(f"p{i}"), F.lit(", ".join(f"{k}={v}" for k, v in p.items())))))
    best = Window.partitionBy("symbol").orderBy(F.desc(metric), "param_id")
    return m.withColumn("place", F.row_number().over(best)).where(C("place") <= top).withColumn("parameters", F.element_at(names, C("param_id")))


def windows(bars: DataFrame, train: int, test: int) -> DataFrame:
    """Bars with fold and part ('train' or 'test'): windows of rows that slide by `test` rows in each symbol. A bar is in train/test + 1 windows at most."""
    n = F.row_number().over(Window.partitionBy("symbol").orderBy("ts")) - 1
    total = F.count("*").over(Window.partitionBy("symbol"))
    d = bars.withColumn("_n", n).withColumn("_all", total)
    first = F.greatest(F.ceil((C("_n") - (train + test) + 1) / test), F.lit(0))
    last = F.least(F.floor(C("_n") / test), F.floor((C("_all") - (train + test)) / test))
    d = d.withColumn("_f", F.when(last >= first, F.sequence(first, last))).withColumn("fold", F.explode("_f"))
    return d.withColumn("part", F.when(C("_n") - C("fold") * test < train, "train").otherwise("test")).drop("_n", "_all", "_f")


def walk_forward(bars: DataFrame, strategy: type[Strategy], grid: dict[str, list], train: int, test: int, config: Config = Config(), metric: str = "sharpe") -> DataFrame:
    """(symbol, fold, param_id, parameters, train_<metric>, <metric>, total_return): the set that is best in training, and how it does in the test that follows."""
    sets = combinations(grid)
    cut = windows(bars, train, test)
    # Each window is a series of its own for indicators, as its tests have no history before them.
    named = cut.withColumn("_own", C("symbol")).withColumn("symbol", F.concat_ws("|", "symbol", "fold", "part"))
    signals = all_signals(named, [strategy.of(**p) for p in sets])
    keys = ["param_id", "_own", "fold", "part", "symbol"]
    m = equity_metrics(_written(simulate(signals, config, keys).drop("trades")), *keys)
    train_m = m.where("part = 'train'").select(C("_own").alias("symbol"), "fold", "param_id", C(metric).alias(f"train_{metric}"))
    test_m = m.where("part = 'test'").select(C("_own").alias("symbol"), "fold", "param_id", metric, "total_return")
    best = Window.partitionBy("symbol", "fold").orderBy(F.desc(f"train_{metric}"), "param_id")
    names = F.create_map(*(y for i, p in enumerate(sets) for y in (F.lit(f"p{i}"), F.lit(", ".join(f"{k}={v}" for k, v in p.items())))))
    return train_m.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k").join(test_m, ["symbol", "fold", "param_id"]).withColumn("parameters", F.element_at(names, C("param_id")))


def compare_configs(signals: DataFrame, configs: dict[str, Config]) -> DataFrame:
    """Equity metrics of the same signals under named configurations."""
    d = signals.withColumn("config", F.explode(F.array(*map(F.lit, configs))))
    return equity_metrics(simulate(d, configs, ["config", "symbol"]), "config", "symbol")
