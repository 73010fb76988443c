"""WARC archives: writing, and reading by boundary chains.

Reading never trusts the magic string. Each task splits its byte range at it and computes, for every candidate record, the
offset at which its successor must start. Pointer jumping from the start of each file keeps the records that the chain
reaches; magic inside payloads is not reached, and what follows it is given back to the payload it belongs to.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, same

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"

# The digits of Spark's base 32 and of RFC 4648.
_DIGITS, _RFC4648 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 digest: five hexadecimal digits are four in base 32."""
    digest = F.sha1(data)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]), _DIGITS, _RFC4648)


def write_warc(pages: DataFrame, path: str, at: dt.datetime | None = None) -> None:
    """One record per row of pages (page_id, url, html, ...), payload the html in UTF-8 (null: empty), in files below path.

    Records are the lines of a text file whose line end is that of a WARC record, so that Spark's own writer makes the
    archives on any file system. White space and control characters in urls are escaped, as a header ends at a line's end.
    Record ids hold the page_id and the row's number, so that none occurs twice; WARC-Date is `at`, by default now.
    """
    payload = F.coalesce(pages["html"], F.lit(""))
    date = (at or dt.datetime.now(dt.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    header = F.concat(
        F.lit(MAGIC + f"WARC-Type: resource\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:page:"), F.coalesce(pages["page_id"].cast("string"), F.lit("")), F.lit(":"), F.monotonically_increasing_id().cast("string"),
        F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce(pages["url"], F.lit("")), r"[\x00-\x20\x7F]", "%20"),
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nWARC-Payload-Digest: sha1:"), sha1_base32(payload.cast("binary")),
        F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )
    pages.select(F.concat(header, payload).alias("value")).write.mode("overwrite").option("lineSep", END).text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, seq, value): what stands between two magic strings, in file order within each block."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"), "value")


def _field(head: Column, name: str) -> Column:
    return F.regexp_extract(head, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*$", 1)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, record_id, url, payload_bytes, payload_digest, payload) of every record below path, in plain or whole-file compressed archives.

    payload is null where the record stands in one segment and was digested where it was read (nearly always), else the
    payload's bytes. Records whose length reaches beyond the end of the file are dropped, as are bytes that no chain reaches.
    """
    scratch = Scratch(spark)
    head = F.substring_index("value", "\r\n\r\n", 1)
    segs = _segments(spark, path).withColumn("head", head).withColumn("skip", F.octet_length("head") + 4)
    segs = segs.withColumn("length", F.try_to_number(_field(F.col("head"), "content-length"), F.lit("999999999999999999")).cast("long"))
    body = F.substring(F.col("value").cast("binary"), F.col("skip") + 1, F.col("length").cast("int"))
    whole = F.octet_length("value") >= F.col("skip") + F.col("length")
    segs = segs.select("file", "block", "seq", F.octet_length("value").cast("long").alias("n"), F.col("skip").cast("long").alias("skip"), "length", _field(F.col("head"), "warc-record-id").alias("record_id"), _field(F.col("head"), "warc-target-uri").alias("url"), F.when(whole, sha1_base32(body)).alias("payload_digest"))
    segs = scratch.write(segs, "segments")

    c = _placed(segs).withColumn("next", F.col("at") + len(MAGIC) + F.col("skip") + F.col("length") + len(END))

    # Candidates that follow each other without a gap are a run: whoever reaches one of them reaches all that come after it in the run.
    real = c.filter("at >= 0 and length is not null")
    within = Window.partitionBy("file", "block").orderBy("seq")
    broken = F.coalesce(F.lag("next").over(within) != F.col("at"), F.lit(True))
    c = real.withColumn("first", F.when(broken, F.col("at"))).withColumn("run", F.last("first", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))).drop("first")
    c = scratch.write(c, "candidates")
    entries = _reached(scratch, c)
    found = c.join(entries, ["file", "run"]).filter("at >= entry").drop("entry")
    found = scratch.write(found, "found")

    one = found.filter("payload_digest is not null").select("file", "at", "record_id", "url", F.col("length").alias("payload_bytes"), "payload_digest", F.lit(None).cast("binary").alias("payload"))
    return one.unionByName(_assembled(spark, scratch, path, found.filter("payload_digest is null")))


def _placed(segs: DataFrame) -> DataFrame:
    """Segments (file, block, seq, n, ...) with `at`, the offset in the file at which their magic starts.

    It is the lengths before in the block, and of the blocks before. A segment starts after its magic, the file's first has
    none. Offsets depend on the file alone, block and seq on how Spark split it when it read.
    """
    block = segs.groupBy("file", "block").agg((F.sum("n") + F.count("n") * len(MAGIC)).alias("size"))
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    block = block.select("file", "block", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("_base"))
    before = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("_base") + F.coalesce(F.sum(F.col("n") + len(MAGIC)).over(before), F.lit(0)) - len(MAGIC)
    return segs.join(block, ["file", "block"]).withColumn("at", at).drop("_base")


def _reached(scratch: Scratch, c: DataFrame) -> DataFrame:
    """(file, run, entry): the runs that the chain from offset 0 reaches, and where it enters them, by pointer jumping over runs."""
    exits = c.groupBy("file", "run").agg(F.max_by("next", "at").alias("exit"))
    targets = c.select("file", F.col("run").alias("to"), F.col("at").alias("exit"))
    jump = scratch.write(exits.join(targets, ["file", "exit"]).select("file", "run", "to", F.col("exit").alias("entry")), "jump0")
    reached = scratch.write(c.filter("at = 0").select("file", "run", F.col("at").alias("entry")), "reached0")
    turn = 0
    while jump.take(1):
        # After turn k, all within 2**k runs of the start are reached, and a jump leads 2**k runs on.
        new = reached.select("file", "run").join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), "entry")
        turn += 1
        grown = scratch.write(reached.unionByName(new).groupBy("file", "run").agg(F.min("entry").alias("entry")), f"reached{turn}")
        if grown.count() == reached.count():
            break
        on = jump.select("file", F.col("run").alias("to"), F.col("to").alias("to2"), F.col("entry").alias("entry2"))
        jump = scratch.write(jump.join(on, ["file", "to"]).select("file", "run", F.col("to2").alias("to"), F.col("entry2").alias("entry")), f"jump{turn}")
        reached = grown
    return reached


def _assembled(spark: SparkSession, scratch: Scratch, path: str, cut: DataFrame) -> DataFrame:
    """Records whose payload holds the magic string, put together from segments. A payload is put together in one row.

    Files with such records are read again, and what is read is written with its own blocks and numbers, as Spark may split
    files differently than at the first reading. Segments and records meet by offsets in the file.
    """
    cut = scratch.write(cut.select("file", F.col("at").alias("start"), F.col("next").alias("stop"), "record_id", "url", "skip", "length"), "cut")
    files = cut.select("file").distinct()
    texts = scratch.write(_segments(spark, path).join(files, "file", "left_semi").withColumn("n", F.octet_length("value").cast("long")), "texts")
    # Each segment belongs to the last record that starts at or before it.
    spans = _placed(texts.select("file", "block", "seq", "n")).select("file", "block", "seq", "at", F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("stop"))
    marks = cut.select("file", F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("seq"), F.col("start").alias("at"), "start", "stop")
    order = Window.partitionBy("file").orderBy("at", F.col("start").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    own = spans.unionByName(marks).select("file", "block", "seq", "at", F.last(F.when(F.col("start").isNotNull(), F.struct("start", "stop")), ignorenulls=True).over(order).alias("of"))
    own = scratch.write(own.filter("seq is not null and at < of.stop").select("file", "block", "seq", "at", "of.start"), "own")
    parts = texts.join(own, ["file", "block", "seq"]).groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("at", F.col("value").cast("binary").alias("part")))).alias("parts"))
    full = F.aggregate(F.transform("parts", lambda x: x["part"]), F.lit(None).cast("binary"), lambda a, x: F.when(a.isNull(), x).otherwise(F.concat(a, F.lit(MAGIC).cast("binary"), x)))
    got = parts.withColumn("full", full).join(cut, ["file", "start"]).filter(F.octet_length("full") >= F.col("skip") + F.col("length"))
    got = got.withColumn("payload", F.substring(F.col("full"), (F.col("skip") + 1).cast("int"), F.col("length").cast("int")))
    return got.select("file", F.col("start").alias("at"), "record_id", "url", F.col("length").alias("payload_bytes"), sha1_base32(F.col("payload")).alias("payload_digest"), "payload")


def mark_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds record_type and refers_to to records (page_id, payload_bytes, payload_digest, ...).

    Of records with equal digests and at least min_bytes bytes, the one with the largest page_id is the response and the
    others revisit it; smaller ones are responses. The largest page_id per digest is found by aggregation; only digests
    that occur more than once are joined back.
    """
    large = records.filter(F.col("payload_bytes") >= min_bytes)
    last = large.groupBy(F.col("payload_digest").alias("_digest")).agg(F.max("page_id").alias("_last"), F.count("page_id").alias("_n")).filter("_n > 1").drop("_n")
    out = records.join(last, (records["payload_digest"] == last["_digest"]) & (records["payload_bytes"] >= min_bytes), "left")
    again = F.coalesce(F.col("page_id") != F.col("_last"), F.lit(False))
    return out.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, F.col("_last"))).drop("_digest", "_last")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url): pages written as WARC archives in the shared folder and read back.

    Fails where another number of records is read than rows were written.

    Defined results: null html is an empty payload, null urls are empty; null page_ids come back as null and, as they have
    no order, are responses; rows repeated with the same page_id are all responses where it is the largest; an empty table
    gives no rows; other columns are ignored.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession)
    write_warc(pages, scratch.path("archive"))
    records = read_warc(spark, scratch.path("archive"))
    page_id = F.regexp_extract("record_id", r"^<urn:page:(.*):[0-9]+>$", 1)
    records = records.withColumn("page_id", F.when(page_id != "", page_id).cast(pages.schema["page_id"].dataType))
    records = scratch.write(records.select("page_id", "payload_bytes", "payload_digest", "url"), "records")
    written, read = pages.count(), records.count()
    if written != read:
        raise RuntimeError(f"{written} records were written and {read} read")
    return mark_revisits(records, min_bytes).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: What a true round trip gives, for DuckDB.
SQL = r"""
WITH p AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\x00-\x20\x7F]', '%20', 'g') AS url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS hex FROM p),
b AS (SELECT page_id, url, strlen(html)::BIGINT AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(hex, (i * 5 // 4)::INT + 1, 2))::BIGINT * (CASE WHEN (i * 5 // 4) = 39 THEN 16 ELSE 1 END)) >> (3 - (i * 5) % 4)::INT) & 31)::INT + 1, 1)), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, url, CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM b WINDOW w AS (PARTITION BY payload_digest)
"""
