"""Benchmark decontamination by spaced seeds: fixed masks ignore some token positions, so that substituted tokens don't hide an overlap."""

from __future__ import annotations

import re
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts

_WORD = re.compile(r"[^\W_]+")
# 1 is a position that a seed compares, 0 one that it ignores.
# Whatever places of 10 words or more are substituted, one of MASKS fits while 0.75 or more are equal; one of SHORT of 3 to 9 words.
MASKS = ("1111", "11011")
SHORT = ("111", "1101", "1011")


def masks_for(n: int, masks: tuple[str, ...] = MASKS) -> tuple[str, ...]:
    """The masks that seed an item of n words."""
    return masks if n >= 10 else SHORT if n >= 3 else ("1" * n,) if n else ()


class _Ids(dict):
    """64-bit ids of the words met last, at most 65,536 of 64 characters, as Python workers live on and keep them."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        got = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(word) <= 64:
            self[word] = got
        return got


@cache
def _ids() -> _Ids:
    return _Ids()


def word_ids(text: str | None) -> np.ndarray:
    """Ids of a text's words in lower case, without punctuation."""
    return np.fromiter(map(_ids().__getitem__, _WORD.findall((text or "").lower())), "uint64")


def seed_hashes(ids: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each place of the mask over the ids: a sum of the compared ids, each times an odd number of its own."""
    n = len(ids) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, "uint64")
    out = np.full(n, int.from_bytes(blake2b(mask.encode(), digest_size=8).digest(), "little"), "uint64")
    for k, bit in enumerate(mask):
        if bit == "1":
            out += ids[k : k + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1) | 1) & 0xFFFFFFFFFFFFFFFF)
    return out ^ (out >> np.uint64(31))


def best_overlap(a: np.ndarray, b: np.ndarray, share: float) -> tuple[int, int]:
    """Length and equal words of the longest stretch of two aligned arrays that has equal words at both ends and a part of `share` or more of equal ones."""
    equal = (a == b).astype(np.int64)
    places = np.flatnonzero(equal)
    if not len(places):
        return 0, 0
    total = np.concatenate([[0], np.cumsum(equal)])
    # height[i] - height[j] >= 0 for i > j says that j ... i-1 has enough equal words; the farthest such i is found from running maxima.
    height = total - share * np.arange(len(total))
    most_after = np.maximum.accumulate(height[::-1])[::-1]
    best, end = (0, 0), 0
    for j in places:
        end = max(end, j + 1)
        while end < len(equal) and most_after[end + 1] >= height[j] - 1e-9:
            end += 1
        stop = end
        while stop > j and not (equal[stop - 1] and height[stop] >= height[j] - 1e-9):
            stop -= 1
        best = max(best, (int(stop - j), int(total[stop] - total[j])))
    return best


def _bench_rows(bench: DataFrame, masks: tuple[str, ...]) -> DataFrame:
    """(item_id, ids, seeds): ids as bytes, seeds as structs of hash and place."""

    def rows(batch: pa.RecordBatch) -> dict:
        ids = [word_ids(x) for x in batch.column("text").to_pylist()]
        seeds = [[{"hash": h, "at": at} for m in masks_for(len(x), masks) for at, h in enumerate(seed_hashes(x, m).view("int64").tolist())] for x in ids]
        return {"item": [x.tobytes() for x in ids], "seeds": seeds, "n_item": [len(x) for x in ids]}

    return map_texts(bench.select(bench["item_id"], bench["text"]).where("item_id is not null and text is not null"), ["item_id"], rows, "item binary, seeds array<struct<hash:long,at:int>>, n_item int")


def find_leaks(docs: DataFrame, bench: DataFrame, *, masks: tuple[str, ...] = MASKS, min_words: int = 13, share: float = 0.75, filter_bits: int = 27) -> DataFrame:
    """(doc_id, item_id, n_words, n_equal): documents (doc_id, text, ...) and benchmark items (item_id, text, ...) that overlap.

    An overlap is a stretch of min_words words or more with equal words at both ends, or a whole item of any length with any
    ends, of which a part of `share` or more is equal, word by word; n_words is the longest one's length. It is found where
    some mask fits; with the default masks, a share of 0.75 or more and min_words of 10 or more, that is every overlap.
    Verified around the hit, as many words to each side as the longest item has, so that no overlap is cut short. Items of one
    or two words are found wherever they stand.

    Tasks hash each document's words under each mask. A bitmap of the benchmark's seed hashes, of 512 bits or more for each
    seed up to 2**filter_bits bits in all (16 MB), is sent to the tasks and lets hits through only; benchmarks of more
    seeds than half of those bits send all seeds to the join. A document's hits come with the words
    around them, each word once. Hits and seeds
    are joined by hash, then segments and items by their ids, and aligned word by word.

    Defined results: texts that are null or without words have no leaks; equal documents have equal leaks, repeated
    rows (equal doc_id) give one; null ids take no part; empty tables give no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    items = scratch.write(_bench_rows(bench, masks), "items")
    seeds = items.select("item_id", F.explode("seeds").alias("seed")).select("item_id", "seed.hash", F.col("seed.at").alias("item_at"))
    n_seeds, around, *kinds = items.agg(F.sum(F.size("seeds")), F.max("n_item"), *(F.max(F.col("n_item").between(a, b)) for a, b in ((1, 1), (2, 2), (3, 9), (10, 2**31 - 1)))).first()
    n_seeds, around = n_seeds or 0, around or 0
    used = [m for n, some in zip((1, 2, 3, 10), kinds, strict=True) if some for m in masks_for(n, masks)]
    bitmap, n_bits = None, min(filter_bits, max(20, (512 * n_seeds - 1).bit_length()))
    if n_seeds <= 1 << (filter_bits - 1):
        low = seeds.select(F.col("hash").bitwiseAND(F.lit((1 << n_bits) - 1)).alias("low"))
        low = low.groupBy(F.shiftright("low", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(low & 31 as int))")).alias("bits")).toPandas()  # 2**(filter_bits - 5) rows at most
        made = np.zeros(1 << (n_bits - 5), "uint32")
        made[low["at"].to_numpy("int64")] = low["bits"].to_numpy("int64").astype("uint32")
        bitmap = docs.sparkSession.sparkContext.broadcast(made)

    def seen(h: np.ndarray) -> np.ndarray:
        low = h & np.uint64((1 << n_bits) - 1)
        return np.flatnonzero(bitmap.value[(low >> np.uint64(5)).astype("int64")] >> (low & np.uint64(31)).astype("uint32") & np.uint32(1))

    def hits(batch: pa.RecordBatch) -> dict:
        out = []
        for text in batch.column("text").to_pylist():
            ids, found = word_ids(text), []
            for m in used:
                h = seed_hashes(ids, m)
                places = np.arange(len(h)) if bitmap is None else seen(h)
                found += zip(places.tolist(), h[places].view("int64").tolist(), strict=True)
            found.sort()
            segments: list[dict] = []
            for at, h in found:
                if not segments or at - around > segments[-1]["stop"]:
                    segments.append({"start": max(0, at - around), "stop": 0, "hits": []})
                segments[-1]["stop"] = min(len(ids), at + around)
                segments[-1]["hits"].append({"hash": h, "at": at - segments[-1]["start"]})
            out.append([{"words": ids[x["start"] : x["stop"]].tobytes(), "hits": x["hits"]} for x in segments])
        return {"segments": out}

    found = map_texts(docs.select(docs["doc_id"], docs["text"]).where("doc_id is not null and text is not null"), ["doc_id"], hits, "segments array<struct<words:binary,hits:array<struct<hash:long,at:int>>>>")
    found = found.where(F.size("segments") > 0).select("doc_id", F.posexplode("segments").alias("segment", "s")).select("doc_id", "segment", "s.words", "s.hits").dropDuplicates(["doc_id", "segment", "words"])
    found = scratch.write(found, "found")
    # A document and an item are compared once for each way to lay one along the other.
    hit = found.select("doc_id", "segment", F.xxhash64("words").alias("version"), F.explode("hits").alias("hit")).select("doc_id", "segment", "version", "hit.hash", F.col("hit.at").alias("doc_at"))
    laid = hit.join(seeds, "hash").select("doc_id", "segment", "version", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).distinct()
    words = found.select(F.col("doc_id").alias("_doc"), F.col("segment").alias("_segment"), F.xxhash64("words").alias("_version"), "words")
    pairs = laid.join(words, (laid["doc_id"] == words["_doc"]) & (laid["segment"] == words["_segment"]) & (laid["version"] == words["_version"])).join(items.select("item_id", "item"), "item_id")

    def verify(batch: pa.RecordBatch) -> dict:
        words, items, shifts = (batch.column(x).to_pylist() for x in ("words", "item", "shift"))
        got = []
        for w, i, shift in zip(words, items, shifts, strict=True):
            a, b = np.frombuffer(w, "uint64"), np.frombuffer(i, "uint64")
            start, stop = max(0, shift), min(len(a), shift + len(b))
            n, equal = best_overlap(a[start:stop], b[start - shift : stop - shift], share)
            leak = n >= min_words
            if stop - start == len(b):
                same = int((a[start:stop] == b).sum())
                if same >= share * len(b) - 1e-9:
                    n, equal, leak = len(b), same, True
            got.append((n, equal, leak))
        return {"n_words": [x[0] for x in got], "n_equal": [x[1] for x in got], "leak": [x[2] for x in got]}

    checked = map_texts(pairs.select("doc_id", "item_id", "words", "item", "shift"), ["doc_id", "item_id"], verify, "n_words int, n_equal int, leak boolean").where("leak")
    return checked.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", "n_equal")).alias("best")).select("doc_id", "item_id", F.col("best.n_words").alias("n_words"), F.col("best.n_equal").alias("n_equal"))
