"""A training corpus in five stages, each applied to all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import line_spread, ngram_join, ordinal_quality, source_mix, spaced_seeds
from tickloom.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the model, fitted on a bounded sample of the rated ones, finds good with probability 1/2 or more.

    Null and empty texts are rated as empty ones, equal texts alike, so that repeated rows stay or go together. Without
    ratings of both kinds everything stays; an empty table stays empty.
    """
    model = ordinal_quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return ordinal_quality.keep_good(docs, model)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that stand on many sources out of all documents but the first.

    Null texts stay as they are; a null source is a source of its own. Documents of which all lines go are dropped, others
    that are empty stay. Rows repeated with one doc_id are treated alike; rows without doc_id are never the first.
    """
    return line_spread.without_shared_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of documents that are similar (five words, 0.8), through others too, the one with the smallest doc_id.

    Null and empty texts are similar to nothing; rows repeated with one doc_id become one; rows without doc_id stay; an empty
    table stays empty.
    """
    groups = Scratch(spark).write(ngram_join.similar_groups(docs, size=5, percent=80), "groups")
    copies = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__copy")).distinct()
    out = docs.join(copies, F.col("doc_id") == F.col("__copy"), "left_anti")
    if groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").take(1):
        named = F.col("doc_id").isNotNull()
        out = out.where(named).dropDuplicates(["doc_id"]).unionByName(out.where(~named))
    return out


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap a benchmark item.

    Null and empty texts overlap nothing; rows repeated with one doc_id go together, if any of them overlaps; rows without
    doc_id stay. With an empty benchmark everything stays.
    """
    found = spaced_seeds.find_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("__leak"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, size, source_size, target, taken.

    Null and empty texts have size 0 and take 0; a null source is a source; repeated rows are documents of their own; an
    empty table gives no rows.
    """
    return source_mix.mix_sources(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality", quality), ("shared_lines", shared_lines), ("near_copies", near_copies), ("leaks", leaks), ("mix", mix)]

#: The quality model can't be expressed in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
