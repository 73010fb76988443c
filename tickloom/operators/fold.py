"""Ordered folds as parallel scans: recursive state over a symbol's bars in time order, with no symbol bound to one task.

What a recursion does to its state over a block of bars is a small map, and maps compose: an exponential mean is affine
(y -> a y + b), a position is a table of states, a trailing band is a function of few steps. Bars are dealt in ranges of symbol
and time, so that a symbol of any length is cut into many tasks, and kept by a checkpoint, so that the ranges stay. Then, level
by level, each task reduces its last symbol's blocks (Arrow batches) to maps; one map row for each task comes to the driver,
which finds the state that each task starts with; and tasks replay their blocks from there. Within a block, maps are composed
by doubling in numpy, never row by row.

A level is what can be known from the columns and the levels before it: an exponential mean of an exponential mean takes two.
Only the first symbol of a task can go on from the task before, so a task needs one start state, whatever the number of symbols.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .keep import checkpointed

Columns = dict[str, np.ndarray]


def affine(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maps y -> A y + B of all rows up to each, from those of each row. Doubling: every turn composes twice as many."""
    a, b, d = a.copy(), b.copy(), 1
    while d < len(a):
        b[d:] += a[d:] * b[:-d]
        a[d:] *= a[:-d]
        d *= 2
    return a, b


def _before(first: float, x: np.ndarray) -> np.ndarray:
    """x one row later, `first` before it."""
    return np.concatenate([[first], x[:-1]]) if len(x) else x


class Node:
    """A recursion. start: its state before a symbol's first bar. summary() is the map of a block, advance() applies it to a state,
    replay() gives a block's columns from its start state, and the state after it."""

    start: object = None

    def summary(self, *given: np.ndarray) -> object:
        raise NotImplementedError

    def advance(self, state, summary):
        raise NotImplementedError

    def replay(self, state, *given: np.ndarray) -> tuple[Columns, object]:
        raise NotImplementedError


@dataclass
class Lag(Node):
    """The value one row before, under the suffix _1."""

    start: float = math.nan

    def summary(self, x):
        return x[-1]

    def advance(self, state, summary):
        return summary

    def replay(self, state, x):
        return {"_1": _before(state, x)}, x[-1]


@dataclass
class Affine(Node):
    """y -> a y + b with a and b of each row. State: y."""

    start: float = 0.0

    def summary(self, a, b):
        a, b = affine(a, b)
        return a[-1], b[-1]

    def advance(self, state, summary):
        return summary[0] * state + summary[1]

    def replay(self, state, a, b):
        a, b = affine(a, b)
        y = a * state + b
        return {"": y, "_1": _before(state, y)}, y[-1]


@dataclass
class Smoother(Node):
    """Exponential mean that starts at the first value; null until `least` values. Nulls let the old weight fade but add nothing.

    State: the mean, nulls since the last value, values seen.
    """

    alpha: float
    least: int
    start: tuple[float, int, int] = (math.nan, 0, 0)

    def _maps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of values, and the maps from the first of them to each. Distances from a block's first value are mapped, so that
        flat prices have exactly themselves as mean."""
        at = np.flatnonzero(~np.isnan(x))
        old = (1 - self.alpha) ** np.diff(at)
        a, b = affine(old / (old + self.alpha), self.alpha / (old + self.alpha) * (x[at[1:]] - x[at[:1]]))
        return at, x[at], np.concatenate([[1.0], a])[: len(at)], np.concatenate([[0.0], b])[: len(at)]

    def _met(self, state: tuple[float, int, int], nulls: int, x: float) -> float:
        mean, gap, seen = state
        old = (1 - self.alpha) ** (gap + nulls + 1)
        return mean + self.alpha / (old + self.alpha) * (x - mean) if seen else x

    def summary(self, x):
        at, values, a, b = self._maps(x)
        return (len(x), len(at), int(at[0]), values[0], a[-1], b[-1], len(x) - 1 - int(at[-1])) if len(at) else (len(x), 0)

    def advance(self, state, summary):
        if not summary[1]:
            return state[0], state[1] + summary[0], state[2]
        _, n, nulls, x, a, b, gap = summary
        return x + a * (self._met(state, nulls, x) - x) + b, gap, state[2] + n

    def replay(self, state, x):
        at, values, a, b = self._maps(x)
        mean, gap, seen = state
        means = np.concatenate([[mean], values[0] + a * (self._met(state, int(at[0]), values[0]) - values[0]) + b if len(at) else []])
        count = np.cumsum(~np.isnan(x))
        y = np.where(seen + count >= self.least, means[count], math.nan)
        after = (float(means[-1]), len(x) - 1 - int(at[-1]) if len(at) else gap + len(x), seen + len(at))
        return {"": y, "_1": _before(mean if seen >= self.least else math.nan, y)}, after


@dataclass
class AdjustedSmoother(Node):
    """Exponential mean whose weights are scaled to sum to 1. State: weighted sum, weights, values seen."""

    alpha: float
    least: int
    start: tuple[float, float, int] = (0.0, 0.0, 0)

    def _maps(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        some = ~np.isnan(x)
        keep = np.full(len(x), 1 - self.alpha)
        fade, total = affine(keep, np.where(some, x, 0.0))
        return fade, total, affine(keep, some.astype(float))[1], np.cumsum(some)

    def summary(self, x):
        return tuple(y[-1] for y in self._maps(x))

    def advance(self, state, summary):
        fade, total, weights, n = summary
        return fade * state[0] + total, fade * state[1] + weights, state[2] + int(n)

    def replay(self, state, x):
        fade, total, weights, n = self._maps(x)
        total, weights, seen = fade * state[0] + total, fade * state[1] + weights, state[2] + n
        with np.errstate(divide="ignore", invalid="ignore"):
            y = np.where((seen >= self.least) & (weights > 0), total / weights, math.nan)
        return {"": y}, (float(total[-1]), float(weights[-1]), int(seen[-1]))


@dataclass
class Machine(Node):
    """One of the states -1, 0 and 1, from a table of each row: three columns, what each state becomes. Gives the state before and after."""

    start: int = 0

    def _maps(self, table: np.ndarray) -> np.ndarray:
        made, d = table.astype("int64") + 1, 1
        while d < len(made):
            made[d:] = np.take_along_axis(made[d:], made[:-d], 1)
            d *= 2
        return made - 1

    def summary(self, table):
        return tuple(self._maps(table)[-1].tolist())

    def advance(self, state, summary):
        return summary[state + 1]

    def replay(self, state, table):
        after = self._maps(table)[:, state + 1]
        return {"": after, "_before": _before(state, after).astype("int64")}, int(after[-1])


@dataclass
class Band(Node):
    """A bound that only falls: it becomes `top` where that is lower, or where `last` has left it; else it stays. State: the bound.

    Which row is the next to replace a bound depends on that bound alone, and is found for all rows at once by descending tables of
    minima and maxima; rows that replace it are those that are reached from the first one by doubled jumps. Rows without top
    leave the bound.
    """

    start: float = math.inf

    @staticmethod
    def _replaced(top: np.ndarray, last: np.ndarray, bound: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First place from `at` on where bound is replaced; the number of rows where there is none."""
        low, high, n = [top], [last], len(top)
        while 2 << (len(low) - 1) <= n:
            d = 1 << (len(low) - 1)
            low.append(np.minimum(low[-1][:-d], low[-1][d:]))
            high.append(np.maximum(high[-1][:-d], high[-1][d:]))
        at = at.copy()
        for k in reversed(range(len(low))):
            inside = np.minimum(at, len(low[k]) - 1)
            at += ((at + (1 << k) <= n) & (low[k][inside] >= bound) & (high[k][inside] <= bound)).astype("int64") << k
        return at

    def _jumps(self, top: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of rows with top, their top and last, and from each of them to the next that replaces it."""
        at = np.flatnonzero(~np.isnan(top))
        t, c = top[at], np.where(np.isnan(last[at]), -math.inf, last[at])
        return at, t, c, self._replaced(t, c, t, np.arange(1, len(t) + 1)) if len(t) else np.zeros(0, "int64")

    def summary(self, top, last):
        _, t, c, jump = self._jumps(top, last)
        if not len(t):
            return None
        end = np.where(jump == len(t), np.arange(len(t)), jump)
        for _ in range(len(t).bit_length()):
            end = end[end]
        falls = np.flatnonzero(t < np.concatenate([[math.inf], np.minimum.accumulate(t)[:-1]]))
        rises = np.flatnonzero(c > np.concatenate([[-math.inf], np.maximum.accumulate(c)[:-1]]))
        return falls, t[falls], t[end[falls]], rises, c[rises], t[end[rises]]

    def advance(self, state, summary):
        if summary is None:
            return state
        falls, tops, after_fall, rises, lasts, after_rise = summary
        i = int(np.searchsorted(-tops, -state, side="right"))  # the first top below the bound
        j = int(np.searchsorted(lasts, state, side="right"))  # the first last above it
        if i == len(falls) and j == len(rises):
            return state
        return float(after_fall[i] if j == len(rises) or i < len(falls) and falls[i] <= rises[j] else after_rise[j])

    def replay(self, state, top, last):
        at, t, c, jump = self._jumps(top, last)
        n = len(t)
        if not n:
            return {"": np.full(len(top), state)}, state
        hit = np.zeros(n + 1, bool)
        hit[self._replaced(t, c, np.array([state]), np.array([0]))] = True
        jump = np.concatenate([jump, [n]])
        for _ in range(n.bit_length()):
            hit[jump[np.flatnonzero(hit)]] = True
            jump = jump[jump]
        latest = np.maximum.accumulate(np.where(hit[:n], np.arange(n), -1))
        bound = np.concatenate([[state], np.where(latest < 0, state, t[latest])])
        return {"": bound[np.cumsum(~np.isnan(top))]}, float(bound[-1])


@dataclass
class Level:
    """Recursions by name, and what they are given, from the columns so far. Their columns are added as name + suffix."""

    nodes: dict[str, Node]
    given: Callable[[Columns], dict[str, tuple]]


@dataclass
class Fold:
    """inputs: columns, as numbers with NaN for null, beside `row`, the row's number from 1. finish() gives the outputs."""

    inputs: tuple[str, ...]
    outputs: str
    levels: list[Level]
    finish: Callable[[Columns], Columns]

    def starts(self) -> list[dict[str, object]]:
        return [{name: node.start for name, node in level.nodes.items()} for level in self.levels]

    def replay(self, states: list[dict], columns: Columns, upto: int | None = None) -> Columns:
        """Adds the columns of the levels before `upto` to those of a block, and moves their states on."""
        c = dict(columns)
        for level, state in list(zip(self.levels, states, strict=True))[:upto]:
            given = level.given(c)
            for name, node in level.nodes.items():
                made, state[name] = node.replay(state[name], *given[name])
                c.update((name + suffix, x) for suffix, x in made.items())
        return c


def chain(parts: list[Fold], levels: list[Level], finish: Callable[[Columns], Columns], outputs: str, extra: tuple[str, ...] = ()) -> Fold:
    """A fold of folds: levels and finish() see the outputs of the parts and the columns `extra`. Names of parts are distinct."""

    def together(i: int) -> Level:
        own = [p.levels[i] for p in parts if i < len(p.levels)]
        return Level({k: v for x in own for k, v in x.nodes.items()}, lambda c: {k: v for x in own for k, v in x.given(c).items()})

    def ready(c: Columns) -> Columns:
        for p in parts:
            c.update(p.finish(c))
        return c

    then = [Level(x.nodes, (lambda c, x=x: x.given(ready(c))) if i == 0 else x.given) for i, x in enumerate(levels)]
    inputs = tuple(dict.fromkeys([*(c for p in parts for c in p.inputs), *extra]))
    return Fold(inputs, outputs, [*(together(i) for i in range(max(len(p.levels) for p in parts))), *then], finish if levels else lambda c: finish(ready(c)))


def lagged_outputs(f: Fold, names: tuple[str, ...]) -> Fold:
    """f with outputs <name>_1: the value one row before."""
    kinds = {x.name: x for x in T.StructType.fromDDL(f.outputs)}
    own = [x for x in names if x in kinds]
    if not own:
        return f
    more = ", ".join(f"{x}_1 {kinds[x].dataType.simpleString()}" for x in own)
    last = Level({f"{x}.lag": Lag() for x in own}, lambda c: (c.update(f.finish(c)), {f"{x}.lag": (np.asarray(c[x], "float64"),) for x in own})[1])
    return Fold(f.inputs, f"{f.outputs}, {more}", [*f.levels, last], lambda c: {**{x: c[x] for x in kinds}, **{f"{x}_1": c[f"{x}.lag_1"] for x in own}})


# --- running them ----------------------------------------------------------------------------------------------------


def _numbers(column: pa.Array) -> np.ndarray:
    if pa.types.is_boolean(column.type):
        column = column.cast("int8")
    return column.cast("float64").to_numpy(zero_copy_only=False)


def _runs(batch: pa.RecordBatch, keys: list[str]) -> list[tuple[int, int, tuple]]:
    """Where each key's rows begin and end in a batch, and the key."""
    codes = [pc.fill_null(batch.column(k).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for k in keys]
    new = np.logical_or.reduce([x[1:] != x[:-1] for x in codes]) if batch.num_rows > 1 else np.zeros(0, bool)
    cuts = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
    return [(i, j, tuple(batch.column(k)[i].as_py() for k in keys)) for i, j in zip(cuts, cuts[1:], strict=False)]


def _array(x: np.ndarray, kind: T.DataType) -> pa.Array:
    if isinstance(kind, T.StringType):
        return pa.array(x.tolist(), "string")
    if isinstance(kind, T.BooleanType):
        return pa.array(np.asarray(x, bool))
    x = np.asarray(x, "float64")
    return pa.array(x, mask=np.isnan(x)).cast(to_arrow_type(kind))


@dataclass
class _Block:
    """State of one task while it streams: the key it is at, its rows so far, and the folds' states."""

    key: tuple | None = None
    row: int = 0
    states: list[list[dict]] = field(default_factory=list)


def fold(df: DataFrame, *folds: Fold, key: str | list[str] = "symbol", order: str | list[str] = "ts", number: str | None = None, lagged: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """df with the folds' outputs, for each key in order.

    number: a column for the row's number; lagged: outputs whose value at the row before is added as <name>_1; parts: number
    of ranges that bars are cut into, by default Spark's number of shuffle partitions, joined where they are small. Rows of
    equal key and order are taken in an order of Spark's choice, but one and the same throughout.
    """
    keys, orders = ([x] if isinstance(x, str) else list(x) for x in (key, order))
    programs = [lagged_outputs(f, lagged) for f in folds]
    cut = df.repartitionByRange(*([parts] if parts else []), *keys, *orders).sortWithinPartitions(*keys, *orders)
    base = checkpointed(cut)
    inputs = sorted({c for f in programs for c in f.inputs})
    depth = max((len(f.levels) for f in programs), default=0)

    def stream(batches: Iterator[pa.RecordBatch], starts: dict[int, tuple], upto: int | None) -> Iterator[tuple[pa.RecordBatch, list]]:
        """Batches, and for each run of a key in them its key, whether it goes on from the batch before, its row number, and columns and folds."""
        at = _Block()
        first = starts.get(TaskContext.get().partitionId())
        for batch in batches:
            if not batch.num_rows:
                continue
            values, out = {c: _numbers(batch.column(c)) for c in inputs}, []
            for i, j, k in _runs(batch, keys):
                new = at.key != k
                if new:
                    go_on = at.key is None and first is not None
                    at = _Block(k, *(pickle.loads(first[0]) if go_on else (0, [f.starts() for f in programs])))
                c = {x: v[i:j] for x, v in values.items()} | {"row": np.arange(at.row + 1, at.row + j - i + 1)}
                at.row += j - i
                out.append((k, new, j - i, [f.replay(s, c, upto) for f, s in zip(programs, at.states, strict=True)]))
            yield batch, out

    def summaries(level: int, starts: dict[int, tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = last = None
            alone, rows, maps = True, 0, []
            for _, runs in stream(batches, starts, level):
                for k, new, n, columns in runs:
                    if new:
                        first, last, alone, rows, maps = k if first is None else first, k, first is None, 0, []
                    rows += n
                    given = [(f.levels[level], f.levels[level].given(c)) if level < len(f.levels) else None for f, c in zip(programs, columns, strict=True)]
                    maps.append([{name: node.summary(*x[1][name]) for name, node in x[0].nodes.items()} if x else {} for x in given])
            if first is not None:
                told = pickle.dumps((first, last, alone, rows, maps))
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], "int64"), pa.array([told], "binary")], names=["part", "told"])

        return run

    starts: dict[int, tuple] = {}
    for level in range(max(depth, 1)):
        # A row for each task: the maps of its last key, in the order of its batches.
        told = sorted((r.part, pickle.loads(r.told)) for r in base.mapInArrow(summaries(level, starts), "part long, told binary").collect())
        known, before, cuts = {p: pickle.loads(x[0]) for p, x in starts.items()}, None, 0
        for part, (first, last, alone, rows, maps) in told:
            fresh = (0, [f.starts() for f in programs])
            goes_on = before is not None and before[0] == first
            begin = before[1:] if goes_on else fresh
            if goes_on:
                cuts += 1
                own = known.setdefault(part, (begin[0], [f.starts() for f in programs]))[1]
                for f, mine, state in zip(programs, own, begin[1], strict=True):
                    if level < len(f.levels):
                        mine[level] = dict(state[level])
            row, states = pickle.loads(pickle.dumps(begin if alone else fresh))
            for step in maps:
                for f, state, made in zip(programs, states, step, strict=True):
                    for name, x in made.items():
                        state[level][name] = f.levels[level].nodes[name].advance(state[level][name], x)
            before = (last, row + rows, states)
        starts = {p: (pickle.dumps(x),) for p, x in known.items()}
        if not cuts:
            break  # no key goes over the end of a task

    made = [x for f in programs for x in T.StructType.fromDDL(f.outputs)]
    count = [T.StructField(number, T.IntegerType())] if number else []
    columns = df.columns
    schema = T.StructType([*df.schema.fields, *count, *made])

    def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, runs in stream(batches, starts, None):
            done = [{k: v for f, c in zip(programs, each, strict=True) for k, v in f.finish(c).items()} | {number: each[0]["row"]} for _, _, _, each in runs]
            added = [_array(np.concatenate([np.asarray(x[f.name]) for x in done]), f.dataType) for f in [*count, *made]]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *added], names=schema.names)

    return base.mapInArrow(replayed, schema)


# --- indicators ------------------------------------------------------------------------------------------------------


def _positive(period: int) -> None:
    if period < 1:
        raise ValueError("a period is 1 or more")


def ema(x: str, n: int, name: str, adjust: bool = False) -> Fold:
    _positive(n)
    node = (AdjustedSmoother if adjust else Smoother)(2 / (n + 1), n)
    return Fold((x,), f"{name} double", [Level({name: node}, lambda c: {name: (c[x],)})], lambda c: {name: c[name]})


def dema(x: str, n: int, name: str) -> Fold:
    _positive(n)
    one, two = f"{name}.one", f"{name}.two"
    levels = [Level({one: Smoother(2 / (n + 1), n)}, lambda c: {one: (c[x],)}), Level({two: Smoother(2 / (n + 1), n)}, lambda c: {two: (c[one],)})]
    return Fold((x,), f"{name} double", levels, lambda c: {name: 2 * c[one] - c[two]})


def rsi(x: str, n: int = 14, name: str = "rsi") -> Fold:
    """Gains against losses, both smoothed by 1/n. Without gains 0 (also where prices are flat), without losses 100."""
    _positive(n)
    lag, up, down = f"{name}.x", f"{name}.up", f"{name}.down"

    def moves(c: Columns) -> dict[str, tuple]:
        d = c[x] - c[f"{lag}_1"]
        return {up: (np.maximum(d, 0.0),), down: (np.maximum(-d, 0.0),)}

    def finish(c: Columns) -> Columns:
        a, b = c[up], c[down]
        with np.errstate(divide="ignore", invalid="ignore"):
            y = np.where(a == 0, 0.0, np.where(b == 0, 100.0, 100 - 100 / (1 + a / b)))
        return {name: np.where(np.isnan(a) | np.isnan(b), math.nan, y)}

    return Fold((x,), f"{name} double", [Level({lag: Lag()}, lambda c: {lag: (c[x],)}), Level({up: Smoother(1 / n, n), down: Smoother(1 / n, n)}, moves)], finish)


def macd(x: str, fast: int = 12, slow: int = 26, signal: int = 9, name: str = "macd") -> Fold:
    if fast >= slow:
        raise ValueError("the fast period is shorter than the slow one")
    a, b, s = f"{name}.fast", f"{name}.slow", f"{name}.signal"
    levels = [Level({a: Smoother(2 / (fast + 1), fast), b: Smoother(2 / (slow + 1), slow)}, lambda c: {a: (c[x],), b: (c[x],)}), Level({s: Smoother(2 / (signal + 1), signal)}, lambda c: {s: (c[a] - c[b],)})]

    def finish(c: Columns) -> Columns:
        line = c[a] - c[b]
        return {f"{name}_line": line, f"{name}_signal": c[s], f"{name}_histogram": line - c[s]}

    return Fold((x,), f"{name}_line double, {name}_signal double, {name}_histogram double", levels, finish)


PRICES = ("high", "low", "close")


def _last_prices(name: str) -> Level:
    return Level({f"{name}.{x}": Lag() for x in PRICES}, lambda c: {f"{name}.{x}": (c[x],) for x in PRICES})


def _true_range(c: Columns, name: str) -> np.ndarray:
    """Of the first bar high - low; parts that need a missing price are left out."""
    last = c[f"{name}.close_1"]
    return np.fmax(np.fmax(c["high"] - c["low"], np.abs(c["high"] - last)), np.abs(c["low"] - last))


def atr(n: int = 14, name: str = "atr") -> Fold:
    _positive(n)
    return Fold(PRICES, f"{name} double", [_last_prices(name), Level({name: Smoother(1 / n, n)}, lambda c: {name: (_true_range(c, name),)})], lambda c: {name: c[name]})


def atr_seeded(n: int = 14, name: str = "atr_seeded") -> Fold:
    """The simulator's own range: the mean of the first n true ranges after the first bar, then smoothed by 1/n.

    From the second bar to bar n + 1 a row adds an n-th of its range, later ones keep (n-1)/n and add it. Missing ranges are 0.
    """
    _positive(n)

    def maps(c: Columns) -> dict[str, tuple]:
        x, row = np.nan_to_num(_true_range(c, name)), c["row"]
        return {name: (np.where(row > n + 1, (n - 1) / n, np.where(row == 1, 0.0, 1.0)), np.where(row == 1, 0.0, x / n))}

    return Fold(PRICES, f"{name} double", [_last_prices(name), Level({name: Affine()}, maps)], lambda c: {name: np.where(c["row"] > n, c[name], math.nan)})


def adx(n: int = 14, name: str = "adx") -> Fold:
    _positive(n)
    t, p, m, s = (f"{name}.{x}" for x in ("tr", "plus", "minus", "strength"))

    def moves(c: Columns) -> dict[str, tuple]:
        up, down = c["high"] - c[f"{name}.high_1"], c[f"{name}.low_1"] - c["low"]
        known = ~np.isnan(up + down)
        return {t: (_true_range(c, name),), p: (np.where(known & (up > down) & (up > 0), up, 0.0),), m: (np.where(known & (down > up) & (down > 0), down, 0.0),)}

    def sides(c: Columns) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore", invalid="ignore"):
            return tuple(np.where(c[t] == 0, math.nan, 100 * c[x] / c[t]) for x in (p, m))

    def spread(c: Columns) -> dict[str, tuple]:
        a, b = sides(c)
        with np.errstate(divide="ignore", invalid="ignore"):
            return {s: (np.where(a + b == 0, math.nan, 100 * np.abs(a - b) / (a + b)),)}

    def finish(c: Columns) -> Columns:
        a, b = sides(c)
        return {name: c[s], f"{name}_plus_di": a, f"{name}_minus_di": b}

    levels = [_last_prices(name), Level({x: Smoother(1 / n, n) for x in (t, p, m)}, moves), Level({s: Smoother(1 / n, n)}, spread)]
    return Fold(PRICES, f"{name} double, {name}_plus_di double, {name}_minus_di double", levels, finish)


def supertrend(n: int = 10, multiplier: float = 3.0, name: str = "supertrend") -> Fold:
    """Bands that follow the price and only tighten while it stays within; the direction flips when the close leaves the far one.

    The bands start at the first bar that has an average range; bars without one, or without a price, leave all as it was.
    """
    a, u, w, side = (f"{name}.{x}" for x in ("atr", "upper", "lower", "side"))

    def bounds(c: Columns) -> dict[str, tuple]:
        mid, far = (c["high"] + c["low"]) / 2, multiplier * c[a]
        known = ~np.isnan(mid + far + c["close"])
        # The lower band is an upper one of the negated prices.
        return {u: (np.where(known, mid + far, math.nan), c[f"{name}.close_1"]), w: (np.where(known, far - mid, math.nan), -c[f"{name}.close_1"])}

    def turns(c: Columns) -> dict[str, tuple]:
        known = ~np.isnan(c["high"] + c["low"] + c["close"] + c[a])
        table = np.stack([np.where(known & (c["close"] > c[u]), 1, -1), np.where(known, 1, 0), np.where(known & (c["close"] < -c[w]), -1, 1)], 1)
        return {side: (table,)}

    def finish(c: Columns) -> Columns:
        known, now, before = ~np.isnan(c["high"] + c["low"] + c["close"] + c[a]), c[side], c[f"{side}_before"]
        return {name: np.where(known, np.where(now > 0, -c[w], c[u]), math.nan), f"{name}_direction": now, f"{name}_buy": known & (before == -1) & (now == 1), f"{name}_sell": known & (before == 1) & (now == -1)}

    levels = [_last_prices(name), Level({a: Smoother(1 / n, n)}, lambda c: {a: (_true_range(c, name),)}), Level({u: Band(), w: Band()}, bounds), Level({side: Machine()}, turns)]
    return Fold(PRICES, f"{name} double, {name}_direction int, {name}_buy boolean, {name}_sell boolean", levels, finish)


def positions(long_in: np.ndarray, short_in: np.ndarray, long_out: np.ndarray, short_out: np.ndarray) -> np.ndarray:
    """What short, flat and long become at each row: entries first, then exits; a reversal is one step."""
    return np.stack([np.where(long_in, 1, np.where(short_out, 0, -1)), np.where(long_in, 1, np.where(short_in, -1, 0)), np.where(short_in, -1, np.where(long_out, 0, 1))], 1)


def _signals(inputs: tuple[str, ...], conditions: Callable[[Columns], tuple], name: str) -> Fold:
    side = f"{name}.side"
    return Fold(inputs, f"{name} int", [Level({side: Machine()}, lambda c: {side: (positions(*conditions(c)),)})], lambda c: {name: np.sign(c[side] - c[f"{side}_before"])})


def long_only(enter: str, leave: str, name: str = "signal") -> Fold:
    """+1 on entry while flat, -1 on exit while long."""
    return _signals((enter, leave), lambda c: (c[enter] == 1, np.zeros(len(c[enter]), bool), c[leave] == 1, np.zeros(len(c[enter]), bool)), name)


def long_short(long_in: str, short_in: str, long_out: str, short_out: str, name: str = "signal") -> Fold:
    """+1 and -1 for entries and exits of a position that may be long, flat or short; a reversal is one signal."""
    columns = (long_in, short_in, long_out, short_out)
    return _signals(columns, lambda c: tuple(c[x] == 1 for x in columns), name)


def half_life(slope: float | None, n: int) -> float:
    """Bars until half of a deviation is gone, from the slope of changes on levels; infinite where there is no pull back."""
    return math.inf if n < 30 or slope is None or slope >= 0 else -math.log(2) / slope
