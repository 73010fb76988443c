"""What the corpus operators share: tables, written intermediates and joins on keys that may be hot."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (local master only) a new temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set, and executors can't see the driver's temporary folder")
        base = "file://" + tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


class Scratch:
    """Tables written below the shared folder. They cut lineage, survive lost executors and have known sizes."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


SALTS, HOT_PART = 64, 1000


def _hot_size(sizes: DataFrame) -> float:
    return max((sizes.agg(F.sum("size")).first()[0] or 0) / HOT_PART, 1)


def with_salt(rows: DataFrame, sizes: DataFrame, key: str, spread: Column, salts: int = SALTS) -> DataFrame:
    """rows with `salt`: 0, but 0 ... salts - 1 by `spread` for hot keys, those of more than a 1/HOT_PART of all rows in `sizes` (key, size).

    Fewer than HOT_PART keys can be that large, whatever the input, so they are broadcast.
    """
    hot = sizes.where(F.col("size") > _hot_size(sizes)).select(F.col(key).alias("_hot"))
    return rows.join(F.broadcast(hot), rows[key] == hot["_hot"], "left").withColumn("salt", F.when(F.col("_hot").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(salts))).cast("int")).drop("_hot")


def salts_of(sizes: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """sizes with `salt`, once for each salt that rows of their key may have."""
    several = F.when(F.col("size") > _hot_size(sizes), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return sizes.withColumn("salt", F.explode(several)).drop("size")


FILTER_BITS = 1 << 24


def likely_in(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is in `keys` (one column), and a few others, before a join that would else shuffle all of them.

    A bitmap of hashed keys is broadcast: at most FILTER_BITS / 64 rows of two numbers (4 MB), whatever the input. With many
    more keys than bits it lets everything pass, and the join after it decides alone.
    """
    name = keys.columns[0]
    hashed = lambda x: F.pmod(F.xxhash64(x), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(_bit % 64 as int))")
    words = keys.select(hashed(F.col(name)).alias("_bit")).groupBy(F.floor(F.col("_bit") / 64).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    marked = rows.withColumn("_bit", hashed(F.col(key)))
    found = marked.join(F.broadcast(words), F.floor(marked["_bit"] / 64) == words["_word"]).where(F.col("_bits").bitwiseAND(bit) != 0)
    return found.select(*(F.col(c) for c in rows.columns))


def same(left: DataFrame, right: DataFrame, keys: dict[str, str]) -> Column:
    """Equality of left's and right's columns, null equal to null."""
    return reduce(lambda a, b: a & b, (left[a].eqNullSafe(right[b]) for a, b in keys.items()))


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space; null text counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column, seed: int) -> Column:
    """A number in (0, 1) for each key, the same on every run and engine: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def map_texts(df: DataFrame, keep: list[str], fn: Callable[[pa.RecordBatch], dict], out: str, rows: int = 1024) -> DataFrame:
    """Adds to the columns `keep` those that fn makes of each Arrow batch of at most `rows` rows. Ids pass unchanged, nulls and all."""
    made = T.StructType.fromDDL(out)
    schema = T.StructType([*(df.schema[c] for c in keep), *made])
    kinds = [to_arrow_type(f.dataType) for f in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                part = whole.slice(at, rows)
                got = fn(part)
                cols = [got[f.name] if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], kind) for f, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *cols], names=schema.names)

    return df.mapInArrow(run, schema)
