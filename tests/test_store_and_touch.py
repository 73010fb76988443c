import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import levels
from tickloom.operators import joins, touch
from tickloom.sources import store

AT = dt.datetime(2024, 1, 1, 9, 15)


def _plain_touch(entries, ticks):
    out = {}
    for e, symbol, at, side, stop, target in entries:
        floor, ceiling = (stop, target) if side == "LONG" else (target, stop)
        later = sorted((t, p) for s, t, p in ticks if s == symbol and p is not None and t > at)
        hit = next(((t, p) for t, p in later if floor is not None and p <= floor or ceiling is not None and p >= ceiling), (None, None))
        low = hit[1] is not None and floor is not None and hit[1] <= floor
        out[e] = (*hit, None if hit[1] is None else "stop" if low == (side == "LONG") else "target")
    return out


@pytest.mark.parametrize("seconds, fan", [(30, 8), (60, 64)])
def test_first_touch_is_that_of_a_loop(spark, seconds, fan):
    r = random.Random(fan)
    ticks, entries = [], []
    for k, n in enumerate((400, 30, 1)):
        p, at = 100.0, AT
        for i in range(n):
            at += dt.timedelta(seconds=r.choice([0.5, 1, 7, 90, 4000, 90_000]))
            p = round(p + r.gauss(0, 1), 2)
            ticks.append((f"s{k}", at, p if r.random() > 0.02 else None))
            side = r.choice(["LONG", "SHORT"])
            a, b = round(p - r.choice([0.5, 3, 50]), 2), round(p + r.choice([0.5, 3, 50]), 2)
            stop, target = (a, b) if side == "LONG" else (b, a)
            entries.append((len(entries), f"s{k}", at, side, stop if r.random() > 0.1 else None, target if r.random() > 0.1 else None))
    entries += [(9001, "none", AT, "LONG", 1.0, 2.0), (9002, "s0", dt.datetime(2020, 1, 1), "LONG", 99.0, 101.0), (9003, "s0", dt.datetime(2030, 1, 1), "LONG", 99.0, 101.0), (9004, "s0", AT, "SHORT", None, None)]
    e = spark.createDataFrame(entries, "entry_id long, symbol string, at timestamp_ntz, side string, stop double, target double")
    t = spark.createDataFrame(ticks, "symbol string, ltt timestamp_ntz, ltp double")
    got = {x.entry_id: (x.touched_at, x.price, x.reason) for x in touch.first_touch(e.unionByName(e), t, seconds=seconds, fan=fan).collect()}
    want = _plain_touch(entries, ticks)
    assert got == want
    assert {x[2] for x in want.values()} == {"stop", "target", None}
    assert touch.first_touch(e, t.where("false")).where("price is not null").count() == 0 and touch.first_touch(e.where("false"), t).count() == 0


def test_lookup_of_one_key_makes_few_pairs(spark):
    r = random.Random(2)
    day = 86_400_000
    rows = [(f"k{i}", "S", "A", "OPT", r.randrange(200) * day + r.randrange(day), round(r.randrange(20_000) * 0.005, 3), i) for i in range(4000)]
    i = spark.createDataFrame(rows, "instrument_key string, segment string, asset_symbol string, instrument_type string, expiry long, strike_price double, position long")
    asked = [(n, "S", "A", "OPT", x[4] + r.choice([-24 * 3_600_000, 0, 3_600_000, 3_600_001, 5]), round(x[5] + r.choice([-0.01, 0.0, 0.01, 0.005, 0.02]), 3)) for n, x in enumerate(rows[:300])] + [(999, "S", "A", "OPT", None, 1.0), (998, None, "A", "OPT", 0, 1.0)]
    w = spark.createDataFrame(asked, "request_id long, segment string, asset_symbol string, instrument_type string, expiry_from long, strike double")
    got = {x.request_id: x.instrument_key for x in joins.find_instruments(w, i).collect()}
    want = {}
    for n, s, *_, at, strike in asked:
        fit = [x for x in rows if s and at is not None and at - 3_600_000 <= x[4] <= at + day and abs(x[5] - strike) <= 0.01]
        if fit:
            want[n] = min(fit, key=lambda x: x[6])[0]
    assert got == want and len(got) > 100


def test_lookup_sends_nothing_through_the_driver(spark, sf):
    from tickloom.queries import QUERIES

    assert "Broadcast" not in QUERIES["instrument_lookup"](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_lookup_of_copies_takes_the_first(spark):
    day = 86_400_000
    rows = [("S", "A", "OPT", k % 2 * day, 1.0 + k % 3 * 0.01, 900 - k, f"k{k}") for k in range(900)] + [(None, "A", "OPT", 0, 1.0, 0, "x"), ("S", "A", "OPT", None, 1.0, 0, "y"), ("S", "A", "OPT", 0, None, 0, "z")]
    i = spark.createDataFrame(rows, "segment string, asset_symbol string, instrument_type string, expiry long, strike_price double, position long, instrument_key string")
    asked = [(n, "S", "A", "OPT", at, 1.0) for n, at in enumerate([0, day, 5 * day] * 300)] + [(0, "S", "A", "OPT", day, 1.02), (5000, "S", None, "OPT", 0, 1.0), (5001, "S", "A", "OPT", 0, float("nan"))]
    w = spark.createDataFrame(asked, "request_id long, segment string, asset_symbol string, instrument_type string, expiry_from long, strike double")
    want = {}
    for n, s, a, _, at, strike in asked:
        fit = [(x[5], x[6]) for x in rows if s == x[0] and a == x[1] and x[3] is not None and x[4] is not None and at - 3_600_000 <= x[3] <= at + day and abs(x[4] - strike) <= 0.01]
        if fit:
            want[n] = min([want[n], *fit] if n in want else fit)
    got = {x.request_id: x.instrument_key for x in joins.find_instruments(w, i).collect()}
    assert got == {n: k for n, (_, k) in want.items()} and len(got) == 600


def test_correlations_by_tiles(spark):
    r = np.random.default_rng(3)
    rows = [(f"s{k:02}", AT + dt.timedelta(days=i), float(r.normal() + 1000 * (k == 3)) if k != 5 else 2.0) for k in range(13) for i in range(60) if r.random() > 0.3 or k < 2]
    d = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, r double")
    whole = {(x.a, x.b): x["corr"] for x in joins.correlation_matrix(d).collect()}
    tiled = {(x.a, x.b): x["corr"] for x in joins.correlation_matrix(d, tile=3, times=7).collect()}
    of = {}
    for s, t, x in rows:
        of.setdefault(s, {})[t] = x
    assert set(whole) == set(tiled) and len(whole) == 13 * 13
    for (a, b), c in whole.items():
        common = sorted(set(of[a]) & set(of[b]))
        x, y = (np.array([of[s][t] for t in common]) for s in (a, b))
        want = 1.0 if a == b else 0.0 if "s05" in (a, b) else float(np.corrcoef(x, y)[0, 1])
        assert abs(c - want) < 1e-9 and abs(tiled[a, b] - want) < 1e-9


@pytest.mark.parametrize("tile, times", [(256, 1024), (2, 3)])
def test_correlations_keep_returns_once_and_shuffle_no_pairs(spark, tile, times):
    r = np.random.default_rng(5)
    rows = [(f"s{k:02}", AT + dt.timedelta(days=i), float(r.normal())) for k in range(9) for i in range(5 * k, 40) if r.random() > 0.2]
    rows += [("odd", AT + dt.timedelta(days=39), float("inf")), *(("odd", AT + dt.timedelta(days=i), float(i % 7)) for i in range(30)), ("nan", AT, float("nan")), ("none", AT, None), ("far", dt.datetime(1999, 1, 1), 1.0)]
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for x in batches:
            made.add(x.num_rows)
            yield x

    d = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, r double").mapInArrow(seen, "symbol string, ts timestamp_ntz, r double")
    got = joins.correlation_matrix(d, tile=tile, times=times)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    corr = {(x.a, x.b): x["corr"] for x in got.collect()}
    assert made.value == len(rows) and got.count() == len(corr)
    of = {}
    for s, t, x in rows:
        of.setdefault(s, {}).update({t: x} if x is not None else {})
    want = {}
    for a in of:
        for b in of:
            x, y = (np.array([of[s][t] for t in sorted(set(of[a]) & set(of[b]))]) for s in (a, b))
            if len(x) or a == b:
                flat = len(x) < 2 or not np.isfinite([*x, *y]).all() or np.ptp(x) == 0 or np.ptp(y) == 0
                want[a, b] = 1.0 if a == b else 0.0 if flat else float(np.corrcoef(x, y)[0, 1])
    assert set(corr) == set(want) and all(abs(corr[k] - want[k]) < 1e-9 for k in want)
    assert {(x.a, x.b): x["corr"] for x in joins.correlation_matrix(d, tile=tile, times=times, places=4).collect()} == {k: round(x, 4) for k, x in corr.items()}
    assert joins.correlation_matrix(d.where("false")).collect() == []


def test_level_clusters_are_those_of_a_loop(spark):
    r = random.Random(6)
    prices = {"a": [round(10 * 1.001**k, 6) for k in range(120)], "b": [5.0], "c": [round(r.uniform(10, 12), 3) for _ in range(60)] + [10.0, 10.0, 10.05], "d": [1.0, 1.005, 1.0050001, None]}
    d = spark.createDataFrame([(s, p) for s, x in prices.items() for p in x], "symbol string, price double")
    want = set()
    for s, x in prices.items():
        groups = []
        for p in sorted(y for y in x if y is not None):
            if not groups or p > groups[-1][0] * 1.005:
                groups.append([])
            groups[-1].append(p)
        want |= {(s, round(sum(g) / len(g), 9), len(g)) for g in groups}
    assert {(x.symbol, round(x.price, 9), x.size) for x in levels.cluster_levels(d).collect()} == want
    assert levels.cluster_levels(d.where("false")).collect() == []


def test_holes(spark):
    day = lambda x: dt.date(2024, 1, x)
    bars = spark.createDataFrame([("a", dt.datetime(2024, 1, x, h)) for x in (8, 9, 10, 17, 18) for h in (9, 10)], "symbol string, ts timestamp_ntz")
    asked = spark.createDataFrame([("a", day(1), day(20)), ("a", day(4), day(18)), ("b", day(1), day(2)), ("b", day(3), day(2)), ("a", None, day(3)), ("a", day(25), day(30))], "symbol string, start date, stop date")
    got = {tuple(x) for x in store.holes(asked, bars).collect()}
    assert got == {("a", day(1), day(7)), ("a", day(11), day(16)), ("a", day(19), day(20)), ("b", day(1), day(2)), ("a", day(25), day(30))}


def _rows(spark, path):
    return sorted(tuple(x) for x in spark.read.parquet(path).select("symbol", "ltt", "ltp", "seq").collect())


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path, monkeypatch):
    make = lambda rows: spark.createDataFrame(rows, "symbol string, ltt timestamp_ntz, ltp double, seq long").withColumn("date", F.to_date("ltt"))
    path = f"file://{tmp_path}/ticks"
    args = {"keys": ["symbol", "ltt", "date"], "newest": ["seq"], "partitions": ["symbol", "date"]}
    t = lambda x: AT + dt.timedelta(hours=x)
    one = make([("a", t(0), 1.0, 1), ("a", t(0), 2.0, 3), ("a", t(0), 9.0, 2), ("b", t(1), 5.0, 1)])
    store.merge_batch(one, 0, path, **args)
    first = _rows(spark, path)
    assert first == [("a", t(0), 2.0, 3), ("b", t(1), 5.0, 1)]
    store.merge_batch(one, 0, path, **args)
    assert _rows(spark, path) == first
    untouched = {f.name for f in (tmp_path / "ticks" / "symbol=b").rglob("*.parquet")}
    two = make([("a", t(0), 7.0, 4), ("a", t(2), 8.0, 5), ("a", t(0), 0.0, 0)])
    plain = store._swap

    def killed(new, at, *rest):  # between stage and swap, the partition already gone
        files, root = store._files(spark, f"{path}/symbol=a")
        files.delete(root, True)
        raise RuntimeError("killed")

    monkeypatch.setattr(store, "_swap", killed)
    with pytest.raises(RuntimeError):
        store.merge_batch(two, 1, path, **args)
    monkeypatch.setattr(store, "_swap", plain)
    store.merge_batch(two, 1, path, **args)
    assert _rows(spark, path) == [("a", t(0), 7.0, 4), ("a", t(2), 8.0, 5), ("b", t(1), 5.0, 1)]
    assert {f.name for f in (tmp_path / "ticks" / "symbol=b").rglob("*.parquet")} == untouched
    assert not [x for x in (tmp_path / "ticks.batches").iterdir() if x.name.endswith(".staged")]


def test_a_merged_stream(spark, tmp_path):
    d = spark.createDataFrame([("a", AT, 1.0, 1), ("a", AT, 2.0, 2), ("b", AT, 3.0, 1)], "symbol string, ltt timestamp_ntz, ltp double, seq long").withColumn("date", F.to_date("ltt"))
    for _ in range(2):
        d.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
        assert store.write_merged(stream, f"file://{tmp_path}/out", f"{tmp_path}/cp", keys=["symbol", "ltt", "date"], newest=["seq"], partitions=["symbol", "date"], availableNow=True).awaitTermination(100)
    assert _rows(spark, f"file://{tmp_path}/out") == [("a", AT, 2.0, 2), ("b", AT, 3.0, 1)]
