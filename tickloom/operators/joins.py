"""Joins of bars with benchmarks, lists, instruments and trades."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .keep import checkpointed, shared_dir
from .windows import W

C = F.col


def with_benchmark(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Bars with benchmark_close of the same ts; bars without it are left out. benchmark: (ts, benchmark_close)."""
    return bars.join(benchmark.select("ts", "benchmark_close"), "ts")


def with_daily_benchmark(bars: DataFrame, daily: DataFrame, allow_backfill: bool = False) -> DataFrame:
    """The day's benchmark_close on each bar, else the last one before. allow_backfill: leading bars get the first one after."""
    d = bars.withColumn("_day", F.to_date("ts")).join(daily.select(F.to_date("ts").alias("_day"), "benchmark_close"), "_day", "left").drop("_day")
    filled = F.last("benchmark_close", ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, 0))
    if allow_backfill:
        filled = F.coalesce(filled, F.first("benchmark_close", ignorenulls=True).over(W().rowsBetween(0, Window.unboundedFollowing)))
    return d.withColumn("benchmark_close", filled)


def members(df: DataFrame, universe: DataFrame) -> DataFrame:
    return df.join(universe.select("symbol").distinct(), "symbol", "left_semi")


def not_covered(universe: DataFrame, df: DataFrame) -> DataFrame:
    return universe.join(df.select("symbol").distinct(), "symbol", "left_anti")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(symbol, change): added and removed members."""
    a, b = old.select("symbol").distinct(), new.select("symbol").distinct()
    return b.subtract(a).withColumn("change", F.lit("added")).unionByName(a.subtract(b).withColumn("change", F.lit("removed")))


def find_instruments(wanted: DataFrame, instruments: DataFrame) -> DataFrame:
    """wanted (request_id, segment, asset_symbol, instrument_type, expiry_from, strike) with the first fitting instrument_key.

    Equality on segment, symbol and type; an expiry from 1 hour before to 24 hours after; a strike within 0.01. Instruments
    are tried in the order of position. Expiries are cut into days and strikes into cells of 0.01: an instrument stands in one
    cell, a request asks the two or three days and the five cells that can hold what it wants, rounding included, so that a segment or symbol of
    any size makes no more pairs than fit, or nearly so. Of instruments with equal values the first one stands for all, and
    equal requests are asked once. Null keys, expiries and strikes find nothing.

    Both joins are hinted to merge: packed files are many times smaller than their rows, and Spark would send a side that looks
    small through the driver.
    """
    hour, day = 3_600_000, 86_400_000
    keys = ["segment", "asset_symbol", "instrument_type"]
    cell = F.floor(C("strike_price") * 100).cast("long")
    there = instruments.where("expiry is not null and strike_price is not null").groupBy(*keys, "expiry", "strike_price").agg(F.min(F.struct("position", "instrument_key")).alias("_first"))
    there = there.withColumn("_day", F.floor(C("expiry") / day).cast("long")).withColumn("_cell", cell)
    days = F.sequence(F.floor((C("expiry_from") - hour) / day).cast("long"), F.floor((C("expiry_from") + 24 * hour) / day).cast("long"))
    cells = F.sequence(F.floor(C("strike") * 100).cast("long") - 2, F.floor(C("strike") * 100).cast("long") + 2)
    wants = [*keys, "expiry_from", "strike"]
    valid = wanted.where("expiry_from is not null and strike is not null and not isnan(strike)").select("request_id", *wants)
    asked = valid.select(*wants).distinct().withColumn("_day", F.explode(days)).withColumn("_cell", F.explode(cells))
    j = asked.join(there.hint("merge"), [*keys, "_day", "_cell"]).where((C("expiry") >= C("expiry_from") - hour) & (C("expiry") <= C("expiry_from") + 24 * hour) & (F.abs(C("strike_price") - C("strike")) <= 0.01))
    found = j.groupBy(*wants).agg(F.min("_first").alias("_first"))
    return valid.join(found.hint("merge"), wants).groupBy("request_id").agg(F.min("_first")["instrument_key"].alias("instrument_key"))


def exposure(bars: DataFrame, trades: DataFrame) -> DataFrame:
    """(symbol, bars, exposed): bars that lie within any of the symbol's trades, both ends included.

    A sweep over starts and ends, not a join of intervals: one sort by symbol and time.
    """
    points = bars.select("symbol", "ts", F.lit(1).alias("o"), F.lit(0).alias("d")).unionByName(trades.select("symbol", C("entry_time").alias("ts"), F.lit(0).alias("o"), F.lit(1).alias("d"))).unionByName(trades.select("symbol", C("exit_time").alias("ts"), F.lit(2).alias("o"), F.lit(-1).alias("d")))
    running = F.sum("d").over(Window.partitionBy("symbol").orderBy("ts", "o").rowsBetween(Window.unboundedPreceding, 0))
    return points.withColumn("open", running).where("o = 1").groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if(C("open") > 0).alias("exposed"))


def _tiles(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, tile, block, symbol, ts, r) in order of tile and block, packed into one row for each tile and block.

    A tile numbers its symbols as they come; a value has the number of its symbol and the place of its time among the block's.
    """
    now, held, known = None, [], {}

    def packed() -> pa.RecordBatch:
        d = pa.Table.from_batches(held)
        symbol = d["symbol"].combine_chunks().dictionary_encode(null_encoding="encode")
        names = symbol.dictionary.to_pylist()
        ids = np.array([known.setdefault(x, len(known)) for x in names], "int32")
        at = d["ts"].combine_chunks()
        at = (at.cast(pa.int32()) if pa.types.is_date(at.type) else at).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        has = d["r"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        times, places = np.unique(at[has], return_inverse=True)
        of = ids[symbol.indices.to_numpy(zero_copy_only=False)[has]]
        r = d["r"].combine_chunks().drop_null().to_numpy()
        parts = (times, of.astype(_index_type(ids.max() + 1)), places.astype(_index_type(len(times))), r)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, names, ids.tobytes(), *(x.tobytes() for x in parts)), _TILE_TYPES, strict=True)], names=list(_TILE))

    for batch in rows:
        keys = np.column_stack([batch[x].to_numpy() for x in ("part", "tile", "block")])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for start, stop in zip(cuts, cuts[1:], strict=False):
            if start == stop:
                continue
            if (key := tuple(keys[start].tolist())) != now:
                if held:
                    yield packed()
                if now is None or key[1] != now[1]:
                    known = {}
                now, held = key, []
            held.append(batch.slice(start, stop - start))
    if held:
        yield packed()


_TILE = {"part": "int", "tile": "int", "block": "int", "symbols": "array<string>", "ids": "binary", "times": "binary", "of": "binary", "places": "binary", "r": "binary"}
_TILE_TYPES = (*[pa.int32()] * 3, pa.list_(pa.string()), *[pa.binary()] * 5)


def _index_type(n: int) -> type:
    return np.uint16 if n <= 65_536 else np.int32


class _Side:
    """One side of a pair of tiles in one block."""

    def __init__(self, row: dict, prefix: str, names: list):
        ids = np.frombuffer(row[f"{prefix}ids"], "int32")
        names += [None] * (int(ids.max()) + 1 - len(names))
        for k, x in zip(ids.tolist(), row[f"{prefix}symbols"], strict=True):
            names[k] = x
        self.size = len(names)
        self.times = np.frombuffer(row[f"{prefix}times"], "int64")
        self.of = np.frombuffer(row[f"{prefix}of"], _index_type(int(ids.max()) + 1))
        self.places = np.frombuffer(row[f"{prefix}places"], _index_type(len(self.times)))
        self.r = np.frombuffer(row[f"{prefix}r"], "float64")

    def dense(self, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Values (0 where a symbol has none or no finite one), where it has one, and where that is not finite, if anywhere."""
        place = np.full(len(self.times), -1)
        place[np.searchsorted(self.times, common)] = np.arange(len(common))
        at = place[self.places]
        x = np.full((self.size, len(common)), np.nan)
        has = np.zeros(x.shape)
        of, at, r = self.of[at >= 0], at[at >= 0], self.r[at >= 0]
        x[of, at], has[of, at] = r, 1.0
        odd = None if np.isfinite(r).all() else has * ~np.isfinite(x)
        return np.where(np.isfinite(x), x, 0.0), has, odd


def _correlated(n, sa, sb, saa, sbb, sab, odd) -> np.ndarray:  # noqa: ANN001
    with np.errstate(divide="ignore", invalid="ignore"):
        va, vb, both = saa - sa * sa / n, sbb - sb * sb / n, sab - sa * sb / n
        # Less than rounding leaves of a sum of squares is no variance.
        flat = ~((va > saa * 1e-12) & (vb > sbb * 1e-12)) | (odd > 0)
        c = np.clip(both / np.sqrt(va * vb), -1.0, 1.0)
        return np.where(flat | np.isnan(c), 0.0, c)


def _correlations(rows: Iterator[pa.RecordBatch], places: int | None) -> Iterator[pa.RecordBatch]:
    """(a, b, corr) and (b, a, corr) of pairs of tiles, that come block by block; rows of a left tile stand together."""
    now, mine = None, []
    met: dict[int, tuple[list, np.ndarray]] = {}

    def done() -> Iterator[pa.RecordBatch]:
        left = pa.array(mine, pa.string())
        for j, (names, sums) in met.items():
            right, same = pa.array(names, pa.string()), j == now
            for lo in range(0, sums.shape[1], step := max(1, 65_536 // max(1, sums.shape[2]))):
                part = sums[:, lo : lo + step]
                c, ok = _correlated(*part), part[0] > 0
                if same:
                    k = np.arange(len(c))
                    c[k, lo + k], ok[k, lo + k] = 1.0, True
                if places is not None:
                    c = np.copysign(np.floor(np.abs(c) * 10.0**places + 0.5) / 10.0**places, c) + 0.0
                a, b = np.nonzero(ok)
                x, y, c = left.take(pa.array(a + lo)), right.take(pa.array(b)), pa.array(c[ok])
                yield pa.RecordBatch.from_arrays([x, y, c], names=["a", "b", "corr"])
                if not same:
                    yield pa.RecordBatch.from_arrays([y, x, c], names=["a", "b", "corr"])

    for batch in rows:
        for k in range(batch.num_rows):
            row = {x: batch[x][k].as_py() for x in batch.schema.names}
            if row["l_tile"] != now:
                if met:
                    yield from done()
                now, mine, met = row["l_tile"], [], {}
            names, sums = met.get(row["tile"], ([], np.zeros((7, 0, 0))))
            a, b = _Side(row, "l_", mine), _Side(row, "", names)
            common = np.intersect1d(a.times, b.times, assume_unique=True)
            (x, p, odd_x), (y, q, odd_y) = a.dense(common), b.dense(common)
            if sums.shape[1:] != (a.size, b.size):
                sums = np.pad(sums, ((0, 0), (0, a.size - sums.shape[1]), (0, b.size - sums.shape[2])))
            qt, yt = q.T, y.T
            for s, (u, v) in enumerate(((p, qt), (x, qt), (p, yt), (x * x, qt), (p, yt * yt), (x, yt), *(((odd_x, qt),) if odd_x is not None else ()))):
                sums[s] += u @ v
            if odd_y is not None:
                sums[6] += p @ odd_y.T
            met[row["tile"]] = (names, sums)
    if met:
        yield from done()


def correlation_matrix(returns: DataFrame, *, tile: int = 256, times: int = 1024, places: int | None = None) -> DataFrame:
    """(a, b, corr) of returns (symbol, ts, r) over the times that both have; 1 on the diagonal, 0 where undefined or where r is not finite.

    Returns are kept in the shared folder, so that what they come from is made once. Symbols are dealt by hash into tiles of
    about `tile` (more symbols make larger tiles, up to 1,024), times into blocks of about `times`. A tile's returns of a
    block are one packed row. Tiles are kept too, and the product of their partitions reads them from there: a task has all
    blocks of its pairs of tiles, adds up counts and sums of products by matrix products and gives both orders of each pair.
    So neither returns nor sums of pairs are shuffled by pair, and disk holds each return a few times, however many symbols
    there are. places: decimals of corr, all where None.
    """
    spark = returns.sparkSession
    r = C("r").cast("double")
    finite = F.when(F.abs(r) < float("inf"), r)
    # Around each symbol's mean, so that sums of squares keep their digits.
    path = f"{shared_dir(spark)}/returns-{uuid.uuid4().hex}"
    returns.select("symbol", "ts", F.when(C("ts").isNotNull(), r - F.coalesce(F.avg(finite).over(Window.partitionBy("symbol")), F.lit(0.0))).alias("r")).write.parquet(path)
    d = spark.read.parquet(path)
    n_symbols, n_times = d.agg(F.approx_count_distinct("symbol"), F.approx_count_distinct("ts")).first()
    n_tiles, n_blocks = max(1, -(-n_symbols // min(max(tile, n_symbols // 64), max(tile, 1024)))), max(1, -(-n_times // times))
    n_parts = min(n_tiles, 256)
    number = F.pmod(F.xxhash64("symbol"), F.lit(n_tiles)).cast("int")
    d = d.select((number % n_parts).alias("part"), number.alias("tile"), F.pmod(F.xxhash64(C("ts").cast("string")), F.lit(n_blocks)).cast("int").alias("block"), "symbol", "ts", "r")
    schema = ", ".join(f"{k} {v}" for k, v in _TILE.items())
    tiles = checkpointed(d.repartitionById(n_parts, "part").sortWithinPartitions("tile", "block").mapInArrow(_tiles, schema))
    met = tiles.select(*(C(x).alias(f"l_{x}") for x in _TILE)).join(tiles.hint("shuffle_replicate_nl"), (C("l_block") == C("block")) & ((C("l_part") < C("part")) | ((C("l_part") == C("part")) & (C("l_tile") <= C("tile")))))
    return met.mapInArrow(lambda rows: _correlations(rows, places), "a string, b string, corr double")


def memberships(universes: DataFrame) -> DataFrame:
    """(symbol, universes): the names of all universes (name, symbol) that hold a symbol, in order."""
    d = universes.select("name", F.upper(F.trim("symbol")).alias("symbol")).where("symbol <> ''").distinct()
    return d.groupBy("symbol").agg(F.array_sort(F.collect_list("name")).alias("universes"))  # a symbol's universes, not a universe's symbols
