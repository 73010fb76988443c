"""Exact top-k by inner product with a pivot-distance index.

Vectors get one more component that gives all the same length, so that the largest inner products are the smallest
distances. Each is keyed by its nearest pivot and its distance from it; rows of a pivot in a range of distances are an
annulus. The triangle inequality bounds the score that any row of an annulus can have with a query.

Vectors too long for that arithmetic, if there are any, are compared beside the index as whole numbers of any size.
"""

from __future__ import annotations

from math import floor, isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_texts, same

NONE = -(1 << 63)  # no score yet
SCALE = 1024


#: Vectors of integer squared lengths up to this are indexed: their scores fit a long, as |q . c| <= |q| |c|.
LONGEST = 1 << 62
#: Scores are ordered as unsigned big-endian numbers of WIDTH bytes, of which this is the zero: products of doubles need less.
WIDTH, ZERO = 272, 1 << 2170


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, x): components times scale, a power of two, rounded down, of vectors without null or non-finite components.

    x is null, and v the whole numbers; but of vectors whose squared length is more than LONGEST v is null, and x the
    components, rounded to what gives the same whole numbers.
    """
    x = F.transform("embedding", lambda c: c.cast("double"))
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    v = vectors.select(vectors["vec_id"], vectors["embedding"]).where("vec_id is not null and embedding is not null").where(good)
    square = F.aggregate(x, F.lit(0.0), lambda a, c: a + F.floor(F.greatest(F.least(c, F.lit(1e9)), F.lit(-1e9)) * scale).cast("double") * F.floor(F.greatest(F.least(c, F.lit(1e9)), F.lit(-1e9)) * scale))
    fits = square <= float(LONGEST)
    # From 2**52 on all doubles are whole.
    rounded = F.transform(x, lambda c: F.when(F.abs(c) < F.lit(2.0**52 / scale), F.floor(c * scale).cast("double") / scale).otherwise(c))
    return v.select("vec_id", F.when(fits, F.transform(x, lambda c: F.floor(c * scale))).alias("v"), F.when(~fits, rounded).alias("x")).dropDuplicates()


def _farthest(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n distinct vectors, each far from those before it."""
    picked = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(picked) < n and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))


def _stack(column: list[bytes], n: int, kind: str = "float64") -> np.ndarray:
    return np.frombuffer(b"".join(column), "int64").reshape(-1, n).astype(kind)


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, pivots: int = 32, most_pivots: int = 512, sample: int = 4096, rows: int = 4096, bins: int = 256, first: int = 6) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding, ...) whose vec_id is divisible by `every`, the k
    other rows with the largest integer inner products, ties to the smaller vec_id.

    Vectors of each length are indexed on their own, as only they have products with each other. The pivots come from at
    most `sample` rows, those with the smallest hashes; all rows are indexed. There are `pivots` pivots, more as the square
    root of the number of rows grows, up to most_pivots, and at most bins annuli for each; annuli of more than `rows` rows,
    equal vectors included, are dealt to several groups by a hash of vec_id, and queries to blocks. The search goes out in
    three turns: one group of the nearest annulus gives a lowest score worth finding, then the `first` annuli with the best
    bounds, then all others whose bound is not below the k-th score found. Within a group, rows sorted by distance are
    looked at only as far as the bound allows. Products are exact: in double precision where squared lengths are below
    2**52, else of 64-bit integers. Vectors of integer squared lengths above 2**62 have scores that neither holds: as queries
    they are compared with all rows, as candidates with all queries, in blocks, by integers of any size.

    Defined results: vectors that are null, hold null or non-finite components or have a null vec_id take no part; equal rows
    are one row, and rows with the query's vec_id are not its candidates; scores beyond a long's range are ranked as they
    are and given as the end of that range; empty tables give no rows; other columns are ignored.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    every_row = scratch.write(whole_numbers(vectors, SCALE).withColumn("n", F.size(F.coalesce("v", "x"))), "whole")
    whole = every_row.where("v is not null").drop("x")
    whole = whole.withColumn("v", F.when(F.col("n") > 0, F.col("v")).otherwise(F.array(F.lit(0).cast("long"))))  # all scores of empty vectors are 0
    square = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    lengths = whole.groupBy("n").agg(F.count("*").alias("count"), F.max(square).alias("most"), F.count_if(F.col("vec_id") % every == 0).alias("asked")).where("asked > 0").collect()  # a row per length
    out = None
    for x in lengths:
        made = _top_k_of(scratch, whole.where(F.col("n") == x["n"]).drop("n"), max(x["n"], 1), x["count"], x["most"], k=k, every=every, pivots=max(pivots, min(most_pivots, isqrt(x["count"] // rows))), sample=sample, rows=rows, bins=bins, first=first)
        out = made if out is None else out.unionByName(made)
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if out is None else out
    return _with_long(scratch, every_row, out, k, every) if every_row.where("v is null").take(1) else out


def _with_long(scratch: Scratch, every_row: DataFrame, found: DataFrame, k: int, every: int, rows: int = 512) -> DataFrame:
    """found, the best among rows that are indexed, put together with the scores that the others (v null) have or give."""

    def whole(vs: pd.Series, xs: pd.Series) -> np.ndarray:
        exact = lambda c: floor(c * SCALE) if abs(c) < 2.0**52 else int(c) * SCALE
        return np.array([[int(c) for c in v] if v is not None else [exact(c) for c in x] for v, x in zip(vs, xs, strict=True)], dtype=object)

    def score(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own) and len(asked):
            products, ids = whole(asked["v"], asked["x"]) @ whole(own["v"], own["x"]).T, own["vec_id"].tolist()
            for q, line in zip(asked["vec_id"].tolist(), products.tolist(), strict=True):
                best = sorted((-s, i) for s, i in zip(line, ids, strict=True) if i != q)[:k]
                out += [(q, i, (ZERO - s).to_bytes(WIDTH, "big"), max(min(-s, (1 << 63) - 1), NONE)) for s, i in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "key", "score"])

    def keyed(batch: pa.RecordBatch) -> dict:
        return {"key": [(ZERO + s).to_bytes(WIDTH, "big") for s in batch.column("score").to_pylist()]}

    is_long, asked = F.col("v").isNull(), F.col("vec_id") % every == 0
    found = map_texts(found.drop("rank"), ["query_id", "vec_id", "score"], keyed, "key binary").select("query_id", "vec_id", "key", "score")
    again = scratch.spark.read.schema(every_row.schema).parquet(scratch.path("whole"))  # with columns of its own
    for own, queries in ((every_row.where(is_long), again.where(asked)), (every_row.where(~is_long), again.where(is_long & asked))):
        parts, blocks = (max(1, -(-d.count() // rows)) for d in (own, queries))
        dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        lengths = every_row.where(is_long).select("n").distinct()  # empty vectors are never long
        a = own.join(lengths, "n", "left_semi").withColumn("part", dealt(parts)).withColumn("block", each(blocks))
        q = queries.join(lengths, "n", "left_semi").withColumn("block", dealt(blocks)).withColumn("part", each(parts))
        near = a.groupBy("n", "part", "block").cogroup(q.groupBy("n", "part", "block")).applyInPandas(score, "query_id long, vec_id long, key binary, score long")
        found = found.unionByName(near)
    # Where a vec_id has several vectors, a row may find it more than once, as in the index.
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id")))
    return scratch.write(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "all")


def _top_k_of(scratch: Scratch, v: DataFrame, n: int, count: int, most: int, *, k: int, every: int, pivots: int, sample: int, rows: int, bins: int, first: int) -> DataFrame:
    """top_k() of `count` vectors (vec_id, v), all of length n and of squared lengths up to most."""
    kind, slack = ("float64" if most < 1 << 52 else "int64"), 0.5 + 4e-12 * most
    scratch = Scratch(scratch.spark)
    picked = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas().sort_values("vec_id")
    chosen = np.stack(picked["v"].to_numpy()).astype("float64")

    def longer(a: np.ndarray) -> np.ndarray:
        return np.concatenate([a, np.sqrt(np.maximum(most - (a**2).sum(1), 0))[:, None]], 1)

    centres = _farthest(longer(chosen), pivots)

    def keyed(batch: pa.RecordBatch) -> dict:
        a = np.stack([np.array(x, "int64") for x in batch.column("v").to_pylist()])
        d = _distances(longer(a.astype("float64")), centres)
        near = d.argmin(1)
        return {"x": [r.tobytes() for r in a], "pivot": near.tolist(), "d": d[np.arange(len(a)), near].tolist()}

    index = scratch.write(map_texts(v, ["vec_id"], keyed, "x binary, pivot int, d double"), "index")
    farthest = index.agg(F.max("d")).first()[0] or 1.0
    # Bins of distance, at most pivots * bins of them, are put together to annuli of about `rows` rows.
    step = farthest / bins or 1.0
    index = index.withColumn("bin", F.least(F.floor(F.col("d") / step), F.lit(bins - 1)).cast("int"))
    b = index.groupBy("pivot", "bin").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
    b = b.withColumn("ring", F.floor((F.sum("n").over(Window.partitionBy("pivot").orderBy("bin")) - F.col("n")) / rows).cast("int"))
    rings = b.groupBy("pivot", "ring").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).withColumn("parts", F.ceil(F.col("n") / rows).cast("int"))
    bins_of = scratch.write(b.select("pivot", "bin", "ring").join(rings.select("pivot", "ring", "parts"), ["pivot", "ring"]), "bins")
    table = rings.toPandas().sort_values(["pivot", "ring"])
    index = index.join(F.broadcast(bins_of), ["pivot", "bin"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts").cast("long")).cast("int"))
    index = scratch.write(index.select("vec_id", "x", "d", "pivot", "ring", "part"), "rings")
    pivot, ring, parts = (table[c].to_numpy("int64") for c in ("pivot", "ring", "parts"))
    low, high, size = table["low"].to_numpy(), table["high"].to_numpy(), table["n"].to_numpy()
    blocks = max(1, -(-count // every // rows))

    def planned(turn: int):
        def plan(batch: pa.RecordBatch) -> dict:
            q = _stack(batch.column("x").to_pylist(), n)
            d = _distances(np.concatenate([q, np.zeros((len(q), 1))], 1), centres)
            to = d[:, pivot]
            near = np.maximum(np.maximum(to - high, low - to), np.maximum((to - d.min(1)[:, None]) / 2, 0))
            top = ((q**2).sum(1)[:, None] + most - near**2) / 2 + slack  # covers rounding
            found = batch.column("least").to_pylist()
            got = []
            for i in range(len(q)):
                order = np.argsort(-top[i], kind="stable")
                if turn == 0:
                    order = order[size[order] > k][:1] if (size > k).any() else order[:1]
                else:
                    order = order[:first] if turn == 1 else order[first:]
                    if found[i] is not None:
                        order = order[top[i][order] >= found[i]]
                got.append([{"pivot": int(pivot[j]), "ring": int(ring[j]), "part": p, "to": float(to[i, j])} for j in order for p in range(1 if turn == 0 else int(parts[j]))])
            return {"groups": got}

        return plan

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        own = own.sort_values("d", kind="stable")
        a, ids, d = _stack(own["x"].tolist(), n, kind), own["vec_id"].to_numpy(), own["d"].to_numpy()
        q = _stack(asked["x"].tolist(), n, kind)
        least = np.array([NONE if x is None or x != x else int(x) for x in asked["least"].tolist()], "int64")
        reach = np.where(least == NONE, np.inf, np.sqrt(np.maximum((q.astype("float64") ** 2).sum(1) + most - 2 * (least - slack), 0)))
        to = asked["to"].to_numpy()
        starts, stops = np.searchsorted(d, to - reach, "left"), np.searchsorted(d, to + reach, "right")
        out = []
        for at in range(0, len(q), 256):
            s, e = int(starts[at : at + 256].min()), int(stops[at : at + 256].max())
            scores = (q[at : at + 256] @ a[s:e].T).astype("int64")
            for i, row in enumerate(scores, at):
                ok = np.flatnonzero((row >= least[i]) & (ids[s:e] != asked["query_id"].iat[i]))
                if len(ok) > k:
                    ok = ok[row[ok] >= np.partition(row[ok], len(ok) - k)[len(ok) - k]]
                best = ok[np.lexsort((ids[s:e][ok], -row[ok]))][:k]
                out.append(pd.DataFrame({"query_id": asked["query_id"].iat[i], "vec_id": ids[s:e][best], "score": row[best]}))
        return pd.concat(out).astype("int64")

    queries = scratch.write(index.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "x"), "queries")
    found, key = None, ["pivot", "ring", "part", "block"]
    in_order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for turn in range(3):
        asked = queries.withColumn("least", F.lit(None).cast("long")) if turn == 0 else queries.join(least, "query_id", "left")
        asked = map_texts(asked, ["query_id", "x", "least"], planned(turn), "groups array<struct<pivot:int,ring:int,part:int,to:double>>")
        asked = asked.select("query_id", "x", "least", F.explode("groups").alias("g")).select("query_id", "x", "least", "g.*", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"))
        asked = scratch.write(asked, f"asked{turn}")
        wanted = asked.select(*(F.col(c).alias(f"_{c}") for c in key)).distinct()
        rows_of = index.join(wanted, same(index, wanted, {c: f"_{c}" for c in key[:3]})).select("vec_id", "x", "d", "pivot", "ring", "part", F.col("_block").alias("block"))
        near = rows_of.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score long")
        if turn and found is not None:
            near = near.unionByName(found)
        best = near.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= k)
        best = scratch.write(best, f"best{turn}")
        least = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
        found = best.drop("rank") if turn else None  # the first turn's rows come again in the next two
    return best.select("query_id", "rank", "vec_id", "score")


#: The same, for DuckDB.
SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, greatest(least(list_dot_product(q.v, c.v), 9223372036854774784), -9223372036854775808)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
