"""Token counts of whole texts, huge ones in overlapping chunks that are spliced where both encodings must agree."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts

# The characters with Unicode's White_Space property.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: From one stable position to the next.
_PIECE = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
_STABLE = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]")


@cache
def _encoder(path: str):
    """The tokenizer of a file, once for each Python worker; one thread, as Spark runs a task for each core."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@cache
def splits_at_space(path: str) -> bool:
    """Whether a file's tokenizer is byte-level BPE that splits words at white space before merging, and changes nothing else."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pre = t.get("pre_tokenizer") or {}
    # Added tokens that hold white space, or take it from around them, could reach over a position.
    if any(x.get("lstrip") or x.get("rstrip") or set(x["content"]) & set(_SPACE) for x in t.get("added_tokens") or ()):
        return False
    return not t.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)


def encode_lengths(path: str, texts: list[str]) -> list[int]:
    t = _encoder(path)
    if path.endswith(".model"):
        return [len(x) for x in t.encode(texts, num_threads=1)]
    return [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


@cache
def _known(path: str) -> dict[str, int]:
    return {}


def count_tokens(path: str, texts: list[str], keep: int = 1 << 20) -> list[int]:
    """Tokens of each whole text. Between stable positions (see stable()) pieces are encoded alone, each distinct one once; a worker keeps at most `keep` of them."""
    if not splits_at_space(path):
        return encode_lengths(path, texts)
    known, pieces = _known(path), [_PIECE.findall(x) for x in texts]
    if len(known) > keep:
        known.clear()
    new = list({y for x in pieces for y in x}.difference(known))
    known.update(zip(new, encode_lengths(path, new), strict=True))
    return [sum(map(known.__getitem__, x)) for x in pieces]


def stable(text: str, first: int, stop: int) -> list[int]:
    """Positions from first to before stop at which a byte-level BPE's word splitting must cut, whatever stands around.

    Its pattern has no alternative in which white space follows anything else than white space, so that a word ends before
    white space that follows another character; special strings hold no white space. Merges stay within words.
    """
    return [m.start() for m in _STABLE.finditer(text, max(first, 0), max(stop, 0))]


def cuts(path: str, text: str, first: int, last: int, offset: int) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]]]:
    """Number of tokens of a chunk, and (position in the document, tokens before it) of its stable positions up to `first` and from `last` on.

    Offsets may leave out a token's leading space, but never characters before its first, so tokens before a stable position
    are those that start before it; a position within a token's offsets is not taken.
    """
    offsets = _encoder(path).encode(text, add_special_tokens=False).offsets
    starts = [a for a, _ in offsets]

    def found(places: list[int]) -> list[tuple[int, int]]:
        out = []
        for at in places:
            n = bisect_left(starts, at)
            if n == 0 or offsets[n - 1][1] <= at:
                out.append((offset + at, n))
        return out

    return len(starts), found(stable(text, 0, min(first, len(text) - 1) + 1)), found(stable(text, last, len(text)))


_CUT = "array<struct<at:long,n:long>>"


def count_tokens_of(docs: DataFrame, path: str, *, limit: int = 1024, huge: int = 16384, chunk: int = 8192, overlap: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs (doc_id, text, ...).

    Texts of up to `huge` characters are encoded where they are read, in pieces between stable positions. Longer ones are cut into chunks of `chunk` characters
    with `overlap` more, dealt over all tasks and encoded with offsets. Neighbours are spliced at the first position in
    their overlap at which both have a token start that is stable (see stable()). Where there is none, the document goes
    through the next round with overlaps 8 times as wide, in the end as one chunk. Tokenizers that don't split at white
    space have no stable positions; their texts are encoded whole, whatever their length.

    Defined results: null text is an empty one, of 0 tokens; equal rows have equal results and repeated rows are kept; an
    empty table gives no rows; other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    d = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"))
    is_huge = F.length("text") > huge if splits_at_space(path) else F.lit(False)

    def whole(batch: pa.RecordBatch) -> dict:
        return {"n_tokens": count_tokens(path, batch.column("text").to_pylist())}

    size = F.octet_length("text").cast("long").alias("n_bytes")
    small = map_texts(d.filter(~is_huge).select("doc_id", "text", size), ["doc_id", "n_bytes"], whole, "n_tokens long", 256)
    results, rest, wide = [small], d.filter(is_huge), overlap
    rest = scratch.write(rest.withColumn("row", F.monotonically_increasing_id()), "huge")
    most = rest.agg(F.max(F.length("text"))).first()[0] or 0
    turn = 0
    while most:
        # Both sides of the splice read the chunks, which are encoded once.
        encoded = scratch.write(_encode_chunks(rest, path, max(chunk, wide), wide), f"encoded{turn}")
        spliced = scratch.write(_splice(encoded), f"spliced{turn}")
        scratch.drop(f"encoded{turn}")
        good = spliced.filter("n_tokens is not null")
        results.append(rest.join(good, "row").select("doc_id", size, "n_tokens"))
        if wide >= most:
            break  # the chunks were whole documents
        rest = scratch.write(rest.join(spliced.filter("n_tokens is null").select("row"), "row", "left_semi"), f"rest{turn}")
        most, wide, turn = rest.agg(F.max(F.length("text"))).first()[0] or 0, 8 * wide, turn + 1
    out = results[0]
    for x in results[1:]:
        out = out.unionByName(x)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def _encode_chunks(texts: DataFrame, path: str, step: int, wide: int) -> DataFrame:
    """(row, k, n, head, tail): tokens of each chunk, and where it may be cut."""
    k = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / step).cast("int")))
    chunks = texts.select("row", "text", k.alias("k")).select("row", "k", F.length("text").alias("all"), F.substring("text", F.col("k") * step + 1, F.lit(step + wide)).alias("text"))

    def encode(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"n": [], "head": [], "tail": []}
        for k, n_chars, text in zip(*(batch.column(c).to_pylist() for c in ("k", "all", "text")), strict=True):
            at = k * step
            n, head, tail = cuts(path, text, wide if k else -1, len(text) if at + step >= n_chars else step, at)
            out["n"].append(n)
            out["head"].append([{"at": a, "n": b} for a, b in head])
            out["tail"].append([{"at": a, "n": b} for a, b in tail])
        return out

    return map_texts(chunks.repartition("row", "k"), ["row", "k"], encode, f"n long, head {_CUT}, tail {_CUT}", 256)


def _splice(chunks: DataFrame) -> DataFrame:
    """(row, n_tokens), null where two neighbours have no cut in common."""
    nxt = chunks.select("row", (F.col("k") - 1).alias("k"), F.col("head").alias("next"))
    pairs = chunks.join(nxt, ["row", "k"], "left")
    at = F.array_min(F.array_intersect(F.transform("tail", lambda x: x["at"]), F.transform("next", lambda x: x["at"])))
    taken = lambda cuts: F.try_element_at(F.filter(cuts, lambda x: x["at"] == F.col("at")), F.lit(1))["n"]
    # A chunk gives its tokens before the cut to its successor; the successor's tokens before the same cut are not counted.
    part = F.when(F.col("next").isNull(), F.col("n")).otherwise(taken(F.col("tail")) - taken(F.col("next")))
    one = pairs.withColumn("at", at).withColumn("part", part)
    return one.groupBy("row").agg(F.when(F.count("part") == F.count("k"), F.sum("part")).alias("n_tokens"))
