"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, same, unit_hash, word_count


def source_targets(sizes: DataFrame, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), max_copies: float = 3.0) -> DataFrame:
    """Words that each source should give. sizes: (source, source_size), one row per source.

    Sources in code point order, null last, get the weights of `cycle` in turn and share the total size by weight. A target
    stops at max_copies times its source's size; what is above goes to the others by weight. As in water filling: in order
    of cap / weight, the capped sources are a prefix. The windows run over one row per source.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in cycle])
    d = sizes.withColumn("_w", F.element_at(weights, ((F.row_number().over(by_name) - 1) % len(cycle) + 1).cast("int")))
    d = d.withColumn("_cap", F.col("source_size") * F.lit(float(max_copies))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    before, onward, whole = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.withColumn("_rest", F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn("_wsum", F.sum("_w").over(onward))
    d = d.withColumn("_capped", F.col("_cap") * F.col("_wsum") <= F.col("_w") * F.col("_rest"))
    level = [F.max(F.when(~F.col("_capped"), F.col(c))).over(whole) for c in ("_rest", "_wsum")]  # largest: at the first uncapped source
    d = d.withColumn("_r", level[0]).withColumn("_s", level[1])
    return d.select("source", "source_size", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * F.col("_r") / F.col("_s")).alias("target"))


def class_copies(classes: DataFrame, max_copies: float = 3.0) -> DataFrame:
    """Adds `copies`, the expected copies of a class's documents, to (source, class, words, odds, target, ...).

    Copies are in proportion to odds and at most max_copies, and words times copies make up the source's target. As in
    source_targets, in descending order of odds the capped classes are a prefix. A source has 64 classes at most.
    """
    by_odds = Window.partitionBy("source").orderBy(F.desc("odds"), "class")
    before, onward, whole = by_odds.rowsBetween(Window.unboundedPreceding, -1), by_odds.rowsBetween(0, Window.unboundedFollowing), by_odds.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = classes.withColumn("_rest", F.col("target") - F.coalesce(F.sum(F.col("words") * F.lit(float(max_copies))).over(before), F.lit(0.0)))
    d = d.withColumn("_level", F.try_divide(F.col("_rest"), F.sum(F.col("words") * F.col("odds")).over(onward)))
    d = d.withColumn("_capped", F.col("odds") * F.col("_level") >= F.lit(float(max_copies)))
    level = F.max(F.when(~F.col("_capped"), F.struct(F.col("odds"), F.col("_level")))).over(whole)["_level"]  # at the first class that isn't capped
    return d.withColumn("_at", level).withColumn("copies", F.when(F.col("_capped"), F.lit(float(max_copies))).otherwise(F.coalesce(F.col("odds") * F.col("_at"), F.lit(0.0)))).drop("_rest", "_level", "_capped", "_at")


def _pareto_rank(u: Column, inclusion: Column) -> Column:
    """Random odds over inclusion odds, mapped from (0, infinity) to (0, 1) without changing the order; the cut is near 1/2."""
    a, b = u * (1 - inclusion), inclusion * (1 - u)
    return a / (a + b)


def mix_sources(docs: DataFrame, *, cycle: tuple[float, ...] = (1.0, 2.0, 3.0), max_copies: float = 3.0, length_power: float = 0.25, seed: int = 20240607, bins: int = 4096) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of docs (doc_id, text, source, ...).

    Expected copies differ within a source: they fall with a document's length, so that the same words are repeated from
    more, shorter documents. A document of class k (2**k words or more, less than twice as many) has the odds
    2**(-k * length_power), and class_copies() gives each class its expected copies so that the source's target is met. The
    whole part of the copies is taken for certain. The fraction p is the document's inclusion probability: its source's
    documents are ranked by u/(1-u) over p/(1-p), u from a digest of doc_id, and the first are taken until the source's
    remaining words, sum of p times size, are reached to the nearest document: a sample of fixed size in words.

    No source is gathered in one task: words are first summed by (source, class), then by (source, bin of the rank), and
    only the bin in which the cut falls, about 1/bins of a source, is put in order.

    Defined results: null text or a text without words has size 0 and takes 0; a null source is a source; equal ranks go by
    doc_id; repeated rows are documents of their own, of which the cut may take some; an empty table gives no rows; other
    columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    sized = docs.select(docs["doc_id"], docs["source"], word_count(docs["text"]).alias("size"))
    sized = scratch.write(sized.withColumn("class", F.coalesce(F.length(F.bin("size")) - 1, F.lit(0)).cast("int")), "sized")
    classes = scratch.write(sized.groupBy("source", "class").agg(F.sum("size").alias("words")), "classes")
    totals = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(totals, cycle, max_copies).withColumnRenamed("source", "of")
    classes = classes.join(targets, same(classes, targets, {"source": "of"})).drop("of").withColumn("odds", F.pow(F.lit(2.0), -F.col("class") * F.lit(length_power)))
    classes = class_copies(classes, max_copies).withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.floor("copies"))
    need = F.sum(F.col("p") * F.col("words")).over(Window.partitionBy("source"))
    classes = scratch.write(classes.select(F.col("source").alias("of"), F.col("class").alias("of_class"), "source_size", "target", "whole", "p", need.alias("need")), "copies")

    ranked = sized.join(classes, same(sized, classes, {"source": "of", "class": "of_class"})).drop("of", "of_class").withColumn("rank", _pareto_rank(unit_hash(F.col("doc_id"), seed), F.col("p"))).withColumn("bin", F.floor(F.col("rank") * bins).cast("int"))
    by_bin = ranked.filter("p > 0").groupBy("source", "bin").agg(F.sum("size").alias("words"), F.first("need").alias("need"))
    upto = Window.partitionBy("source").orderBy("bin")
    cut = by_bin.withColumn("end", F.sum("words").over(upto)).filter("end >= need").groupBy("source").agg(F.min_by(F.struct("bin", (F.col("need") - F.col("end") + F.col("words")).alias("left")), "bin").alias("cut"))
    cut = scratch.write(cut.select(F.col("source").alias("of"), F.col("cut.bin").alias("cut_bin"), F.col("cut.left").alias("left")), "cut")

    ranked = ranked.join(cut, same(ranked, cut, {"source": "of"}), "left").drop("of")
    at_cut = F.col("p") > 0
    at_cut &= F.coalesce(F.col("bin") == F.col("cut_bin"), F.lit(False))
    clear = ranked.filter(~at_cut).withColumn("extra", (F.col("p") > 0) & (F.coalesce(F.col("bin") < F.col("cut_bin"), F.lit(True))))
    in_order = Window.partitionBy("source").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    close = ranked.filter(at_cut).withColumn("extra", F.sum("size").over(in_order) - F.col("size") / 2 <= F.col("left"))
    out = clear.unionByName(close)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("extra").cast("long"))).alias("taken"))


#: The same, for DuckDB.
SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
classed AS (SELECT *, greatest(length(bin(size)) - 1, 0) AS class FROM sized),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM totals),
filled AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS rest,
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wsum FROM weighed),
capped AS (SELECT *, cap * wsum <= w * rest AS is_capped FROM filled),
levels AS (SELECT max(rest) AS r, max(wsum) AS s FROM capped WHERE NOT is_capped),
targets AS (SELECT source, source_size, CASE WHEN is_capped THEN cap ELSE w * r / s END AS target FROM capped CROSS JOIN levels),
classes AS (SELECT source, class, sum(size)::BIGINT AS words, pow(2.0::DOUBLE, -class * 0.25::DOUBLE) AS odds FROM classed GROUP BY source, class),
joined AS (SELECT c.*, t.source_size, t.target FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source),
poured AS (SELECT *, (target - coalesce(sum(words * 3.0::DOUBLE) OVER (PARTITION BY source ORDER BY class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
  / nullif(sum(words * odds) OVER (PARTITION BY source ORDER BY class ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level FROM joined),
full_ones AS (SELECT *, coalesce(odds * level >= 3, false) AS is_full FROM poured),
copied AS (SELECT *, CASE WHEN is_full THEN 3.0::DOUBLE ELSE coalesce(odds * max(CASE WHEN NOT is_full THEN level END) OVER (PARTITION BY source), 0.0::DOUBLE) END AS copies FROM full_ones),
split AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS p, sum((copies - floor(copies)) * words) OVER (PARTITION BY source) AS need FROM copied),
ranked AS (SELECT d.doc_id, d.source, d.size, s.source_size, s.target, whole, p, need,
  (('0x' || substr(md5('20240607:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM classed d JOIN split s ON d.source IS NOT DISTINCT FROM s.source AND d.class = s.class),
placed AS (SELECT *, u * (1 - p) / (u * (1 - p) + p * (1 - u)) AS rank FROM ranked),
run AS (SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY p = 0, rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM placed)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN p > 0 AND upto - size / 2.0 <= need THEN 1 ELSE 0 END))::BIGINT AS taken FROM run
"""
