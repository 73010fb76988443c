"""Line deduplication by the number of distinct sites on which a line stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, salts_of, same, with_salt

NO_SITE = "\x00"


def line_form(line: Column) -> Column:
    """Lines that differ in case or outer spaces only are one line."""
    return F.lower(F.trim(line))


def _shared_lines(docs: DataFrame, min_sites: int, min_chars: int, lg_k: int) -> DataFrame:
    """(__of, __text, __keys): for each document that loses lines, told by doc_id and text, their hashes.

    Lines that stand in a large part of all documents are hot: their rows are dealt to several tasks by a salt.
    """
    scratch = Scratch(docs.sparkSession)
    d = docs.select(docs["doc_id"], docs["text"], F.xxhash64(docs["text"]).alias("content"), F.coalesce(docs["source"].cast("string"), F.lit(NO_SITE)).alias("site"))
    each = d.select("doc_id", "content", "site", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", line_form(F.col("line")))
    each = each.filter(F.length("line") >= min_chars).select("doc_id", "content", "site", F.xxhash64("line").alias("key"))

    keys = each.groupBy("key").agg(F.min("site").alias("a"), F.max("site").alias("b"), F.count("*").alias("size")).filter("a <> b").select("key", "size")
    keys = scratch.write(keys, "keys")
    salted = with_salt(each, keys, "key", F.struct("doc_id", "content"))
    several = scratch.write(salted.join(salts_of(keys, "key"), ["key", "salt"], "left_semi"), "several")
    error = 3 * 1.04 / 2 ** (lg_k / 2)
    sketches = several.groupBy("key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", lg_k)).alias("sites"), F.min("doc_id").alias("first"), F.max("salt").alias("salts"))
    likely = scratch.write(sketches.filter(F.col("sites") >= min_sites * (1 - error) - 1), "likely")
    sure = F.col("sites") > min_sites * (1 + error) + 1
    near = several.join(_every_salt(likely.filter(~sure)).select("key", "salt"), ["key", "salt"], "left_semi")
    exact = near.select("key", "site").distinct().groupBy("key").count().filter(F.col("count") >= min_sites).select("key")
    shared = likely.filter(sure).select("key", "first", "salts").unionByName(likely.filter(~sure).join(exact, "key", "left_semi").select("key", "first", "salts"))
    shared = scratch.write(shared, "shared")

    gone = several.join(_every_salt(shared), ["key", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    return gone.groupBy(F.col("doc_id").alias("__of"), F.col("content").alias("__text")).agg(F.collect_set("key").alias("__keys"))  # a document's own lines


def _every_salt(keys: DataFrame) -> DataFrame:
    """keys (key, salts, ...) once for each salt that their rows have: all but hot ones have salt 0 only."""
    return keys.withColumn("salt", F.explode(F.sequence(F.lit(0), "salts"))).drop("salts")


def _left(text: Column, min_chars: int) -> Column:
    """The lines that stay; null where the document loses none."""
    goes = lambda x: (F.length(F.trim(x)) >= min_chars) & F.array_contains("__keys", F.xxhash64(line_form(x)))
    return F.when(F.col("__keys").isNotNull(), F.filter(F.split(text, "\n"), lambda x: ~goes(x)))


def drop_shared_lines(docs: DataFrame, *, min_sites: int = 3, min_chars: int = 20, lg_k: int = 10) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) for every row of docs (doc_id, text, source, ...).

    A line of min_chars characters or more that stands on min_sites distinct sources or more is boilerplate. It stays in the
    document with the smallest doc_id that has it, so that one of a group of copies stays whole, and goes from all others.

    Line hashes are summed before they are shuffled. Those on one source only need no sketch; the others get a HyperLogLog
    sketch of their sources, merged by aggregation. Where the estimate is within three standard errors and 1 of
    min_sites, distinct sources are counted exactly. Lines with equal 64-bit hashes count as one line; among 2**32 lines of
    one length range, that is expected for about two pairs. The last join is by doc_id and the text's hash.

    Defined results: null text stays null with 0 lines; a null source is a source of its own; lines end at \\n; a text of
    which all lines go is empty; repeated rows are treated alike; an empty table gives no rows; other columns are ignored.
    """
    d, gone = docs.select(docs["doc_id"], docs["text"], F.xxhash64(docs["text"]).alias("content")), _shared_lines(docs, min_sites, min_chars, lg_k)
    out = d.join(gone, same(d, gone, {"doc_id": "__of", "content": "__text"}), "left").withColumn("left", _left(F.col("text"), min_chars))
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long"))
    n_left = F.when(F.col("left").isNull(), F.col("n_lines")).otherwise(F.size("left"))
    return out.select("doc_id", F.when(F.col("left").isNull(), F.col("text")).otherwise(F.array_join("left", "\n")).alias("text"), "n_lines", (F.col("n_lines") - n_left).cast("long").alias("n_removed"))


def without_shared_lines(docs: DataFrame, *, min_sites: int = 3, min_chars: int = 20, lg_k: int = 10) -> DataFrame:
    """The rows of docs with all their columns, text without the lines that drop_shared_lines removes, n_chars (if there is
    such a column) its length. Documents of which no line but blank ones is left go, if they lost any. Nulls, repeated rows
    and empty tables are treated as there."""
    gone = _shared_lines(docs, min_sites, min_chars, lg_k)
    out = docs.join(gone, docs["doc_id"].eqNullSafe(gone["__of"]) & (F.xxhash64(docs["text"]) == gone["__text"]), "left").withColumn("__left", _left(F.col("text"), min_chars))
    out = out.where(F.col("__left").isNull() | F.exists("__left", lambda x: F.trim(x) != ""))
    out = out.withColumn("text", F.when(F.col("__left").isNull(), F.col("text")).otherwise(F.array_join("__left", "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__left").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


#: The same, for DuckDB.
SQL = r"""
WITH lines AS (SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, lower(trim(line)) AS form FROM lines),
shared AS (SELECT form, min(doc_id) AS first FROM keyed WHERE length(form) >= 20 GROUP BY form HAVING count(DISTINCT site) >= 3),
marked AS (SELECT k.doc_id, k.line, k.pos, s.form IS NOT NULL AND k.doc_id <> s.first AS gone FROM keyed k LEFT JOIN shared s ON k.form = s.form),
joined AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE j.text END AS text, coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id
"""
