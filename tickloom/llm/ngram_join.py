"""N-gram Jaccard join: groups of documents whose shingle sets, as 64-bit hashes, are similar; no link is lost.

Candidates share one of few hashed shingles, rare ones first, within a tile of neighbouring size bands; bitmaps of hashed
shingles bound their overlap from above by bit counts; what is left is checked by intersecting sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, likely_in, map_texts, salts_of, same, with_salt

EXTRA = 32
_WORDS, _MOST_WORDS = 16, 4096  # of 64 bits in a bitmap
_LAST = 8
_PAIRS = 1 << 14
_ROOM, _ROW = 1 << 19, 256  # shingles in a block of sets, and what a set takes besides its own


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], "uint64")
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LONG, _AT_ONCE = 64, 1 << 20  # bytes


def word_ids(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit ids of the words of texts that stand one after the other in `data`, cut at `cuts`, and where each text's words begin.

    Eight bytes of all words are mixed in at a time; words over 64 bytes are digested one by one. No table of words is kept,
    as large corpora have more words than caches hold.
    """
    inside = _INSIDE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    begins[inner], ends[inner - 1] = inside[inner], inside[inner - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    low = np.zeros(len(data) + 8, "uint8")
    low[: len(data)] = _LOWER[data]
    eight = np.ndarray(len(data) + 1, "<u8", low, strides=(1,))
    left = last - first
    ids = left.astype("uint64")
    long = np.flatnonzero(left > _LONG)
    rows, at = np.arange(len(ids)), first
    while len(rows):
        ids[rows] = _mixed(ids[rows] * _STEP + (eight[at] & _FIRST_BYTES[np.minimum(left, 8)]))
        more = (left > 8) & (at - first[rows] < _LONG)
        rows, at, left = rows[more], at[more] + 8, left[more] - 8
    for k in long:
        ids[k] = int.from_bytes(blake2b(low[first[k] : last[k]], digest_size=8).digest(), "little")
    return ids, np.searchsorted(first, cuts)


def _runs(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    n = max(0, len(ids) - size + 1)
    out = np.full(n, size, "uint64")
    for k in range(size):
        out = out * _STEP + ids[k : k + n]
    return _mixed(out)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct runs of `size` words; of the whole, where it has fewer.

    Words are runs of other than ASCII white space, with A-Z in lower case; null texts have none.
    """
    texts = (texts.fill_null("") if texts.null_count else texts).cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, "int64", len(texts) + 1, 8 * texts.offset) if len(texts) else np.zeros(1, "int64")
    data = np.frombuffer(data, "uint8") if data else np.zeros(0, "uint8")
    out, at = [], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + _AT_ONCE, "right")) - 1)  # texts of about a megabyte at once
        ids, words = word_ids(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
        runs = _runs(ids, size)
        for x, y in zip(words.tolist(), words[1:].tolist(), strict=False):
            out.append(_distinct(runs[x : y - size + 1]) if y - x >= size else _runs(ids[x:y], y - x) if y > x else runs[:0])
        at = to
    return out


def shingles(text: str | None, size: int) -> np.ndarray:
    """shingle_sets of one text."""
    return shingle_sets(pa.array([(text or "").encode("utf-8", "surrogatepass")], pa.large_binary()), size)[0]


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), "int32"), np.concatenate(arrays).view("int64"))


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n has at least in common with any set it links with."""
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    """Smallest hashes of a set that are candidates. Linked sets share at least shared_in_prefix of theirs."""
    return min(n, n - least_overlap(n, percent) + 1 + EXTRA)


def shared_in_prefix(n: int, percent: int) -> int:
    """The common shingles in order of hash: of two linked sets, the first 1 + EXTRA of them (or all, in small sets) stand in
    both prefixes, as at most n - least_overlap others come before. Partners may be as small as least_overlap(n)."""
    return min(1 + EXTRA, least_overlap(least_overlap(n, percent), percent))


def _bitmaps(sets: list[np.ndarray]) -> pa.ListArray:
    """A bit or more for each shingle (fewer beyond _MOST_WORDS), by powers of two, as bitmaps of few bits are full in large sets and rule nothing out."""
    words = np.array([min(max(_WORDS, 1 << (-(-len(x) // 64) - 1).bit_length()), _MOST_WORDS) if len(x) else _WORDS for x in sets])
    out: list = [None] * len(sets)
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w).tolist()
        bits = np.zeros((len(at), 64 * w), "uint8")
        bits[np.repeat(np.arange(len(at)), [len(sets[k]) for k in at]), (np.concatenate([sets[k] for k in at]) >> np.uint64(20)) % np.uint64(64 * w)] = 1
        for k, x in zip(at, np.packbits(bits, axis=1).view("uint64"), strict=True):
            out[k] = x
    return _lists(out)


def folded(bitmaps: pa.ListArray, cut: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, cuts, bitmaps) for the groups (from each cut to the next) whose shortest bitmap has one length; longer ones are folded to it."""
    ends, values = bitmaps.offsets.to_numpy(), bitmaps.values.to_numpy().view("uint64")
    words, sizes = np.diff(ends), np.diff(cut)
    least = np.minimum.reduceat(words, cut[:-1])
    for w in np.unique(least).tolist():
        rows = np.flatnonzero(np.repeat(least == w, sizes))
        bits = np.zeros((len(rows), w), "uint64")
        for v in np.unique(words[rows]).tolist():
            own = np.flatnonzero(words[rows] == v)
            bits[own] = np.bitwise_or.reduce(values[ends[rows[own], None] + np.arange(v)].reshape(len(own), v // w, w), axis=1)
        yield rows, np.cumsum([0, *sizes[least == w]]), bits


class _Before(dict):
    """Sets of a list column's values by row."""

    def __init__(self, lists: pa.ListArray):
        self.ends, self.values = lists.offsets.to_numpy(), lists.values.to_numpy()

    def __missing__(self, at: int) -> frozenset[int]:
        got = self[at] = frozenset(self.values[self.ends[at] : self.ends[at + 1]].tolist())
        return got


def bound_pairs(cut: np.ndarray, n: np.ndarray, bits: np.ndarray, labels: np.ndarray, own: np.ndarray, crossing: np.ndarray, bands: np.ndarray, tile: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions within groups (from each cut to the next) of different labels that bit counts don't rule out. crossing: of different blocks only.

    Each bit that only one of two sets has is an element that the other lacks. A pair is looked at in the tile of its larger
    band only. Pairs of all groups of one size are looked at together, at most about _PAIRS (fewer with longer bitmaps) at once; a larger group's row by row.
    """
    spare = n - np.bitwise_count(bits).sum(1, dtype=np.int64)

    def bounded(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = (labels[i] != labels[j]) & (np.maximum(bands[i], bands[j]) == tile[i]) & ((own[i] != own[j]) | ~crossing[i])
        i, j = i[some], j[some]
        most = np.bitwise_count(bits[i] & bits[j]).sum(1, dtype=np.int64) + np.minimum(spare[i], spare[j])
        some = most * 100 >= (n[i] + n[j] - most) * percent
        return i[some], j[some]

    starts, sizes, most_pairs = cut[:-1], np.diff(cut), _PAIRS * _WORDS // max(_WORDS, bits.shape[1])
    for m in np.unique(sizes[sizes > 1]).tolist():
        begin = starts[sizes == m]
        p, q = np.triu_indices(m, 1) if m * m <= most_pairs else (None, None)
        if p is None:
            for x in begin.tolist():
                for k in range(x, x + m - 1):
                    yield bounded(np.full(x + m - k - 1, k), np.arange(k + 1, x + m))
        else:
            few = max(1, most_pairs // len(p))
            for k in range(0, len(begin), few):
                x = begin[k : k + few, None]
                yield bounded((x + p).ravel(), (x + q).ravel())


def _cuts(key: np.ndarray) -> np.ndarray:
    return np.array([0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1), len(key)])


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and their keys, of batches in which the rows of a group stand together."""
    waiting: list[pa.RecordBatch] = []
    keys_of = lambda t: np.stack([t.column(c).to_numpy() for c in keys], 1)
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        t = pa.Table.from_batches(waiting)
        key = keys_of(t)
        other = np.flatnonzero((key != key[-1]).any(1))  # the last group may go on in the next batch
        done = int(other[-1]) + 1 if len(other) else 0
        if done:
            yield t.slice(0, done), key[:done]
        waiting = t.slice(done).to_batches()
    if waiting:
        t = pa.Table.from_batches(waiting)
        yield t, keys_of(t)


def similar_groups(docs: DataFrame, *, size: int = 4, percent: int = 85, block: int = 512) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text, ...).

    Shingles with equal 64-bit hashes count as one, which a set of a million shingles has with a chance of 3 in 10**8.

    Two documents link when 100 * intersection >= percent * union of their sets of shingles of `size` words; component_id is
    the smallest doc_id that links reach. No link between different texts is lost:

    1. Documents with equal sets (equal 128-bit digests) are one class, represented by its smallest doc_id.
    2. A set's smallest hashes (prefix_length) are its candidates; linked sets share shared_in_prefix of them. Counted over
       all representatives and put in order of count, only as many, rarest first, are needed as leave fewer than that out.
       A document whose candidates are nearly all its own is done. Pairs also share a tile of two size bands.
    3. In each tile of a candidate, members are checked against one centre; each member takes the centre that it shares
       most tiles with. Copies by the thousand thus make as many checks, not all pairs.
    4. In tiles that still hold several components, blocks of about `block` members are compared by bitmaps of their shingles within a
       task: bit counts bound the overlap from above, and only pairs that may link are checked by their sets.

    Defined results: null and blank texts have 0 shingles and are linked with nothing; null doc_ids take no part in links
    and have a null component; one doc_id with several texts is one node, linked by any of them; repeated rows are kept; an
    empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    d = docs.select(docs["doc_id"], docs["text"])

    def sketch(batch: pa.RecordBatch) -> dict:
        sets = shingle_sets(batch.column("text"), size)
        digests = [blake2b(x, digest_size=16).digest() for x in sets]
        return {"n": [len(x) for x in sets], "digest": digests, "candidates": _lists([x[: prefix_length(len(x), percent)] for x in sets]), "bits": _bitmaps(sets)}

    all_sets = scratch.write(map_texts(d, ["doc_id"], sketch, "n long, digest binary, candidates array<long>, bits array<long>", 512), "sets")
    member = scratch.write(all_sets.select("doc_id", "n", "digest"), "members")
    classes = member.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("size"))
    classes = scratch.write(classes.select(F.col("digest").alias("_digest"), "node", "size"), "classes")
    reps = all_sets.join(classes, (all_sets["digest"] == classes["_digest"]) & (all_sets["doc_id"] == classes["node"])).select("node", "n", "candidates", "bits")
    reps = scratch.write(reps, "reps")
    scratch.drop("sets")

    needed = scratch.write(_needed(reps, percent), "needed")
    tiles = scratch.write(_tiles(needed, percent), "tiles")
    sizes = reps.select("node", "n")
    first = verify(scratch, d, deal(scratch, _stars(tiles), sizes, "first"), size, percent, "first")
    labels = scratch.write(components(scratch, first, "first"), "labels")
    scratch.drop("needed")
    dealt = deal(scratch, _rest(scratch, tiles, labels, reps, percent, block), sizes, "more")
    scratch.drop("reps", "tiles", "open")
    more = verify(scratch, d, dealt, size, percent, "more")
    labels = components(scratch, first.unionByName(more), "all")

    named = classes.join(labels.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("_digest", F.coalesce("label", "node").alias("component_id"), "size")
    # A class may hold a large part of all rows, which then are dealt to several tasks.
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    rows = with_salt(member.where(~alone), classes.select(F.col("_digest").alias("digest"), "size"), "digest", F.col("doc_id"))
    named = salts_of(named.select("_digest", "component_id", "size"), "_digest").withColumnRenamed("salt", "_salt")
    out = rows.join(named, (rows["digest"] == named["_digest"]) & (rows["salt"] == named["_salt"]), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(member.where(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _needed(reps: DataFrame, percent: int) -> DataFrame:
    """(node, n, hash): the candidates that are needed of each node that has any."""
    each = reps.select("node", "n", F.explode("candidates").alias("hash"))
    # Candidates that no other set has come first in the order, and are left out here.
    several = each.withColumn("count", F.count("*").over(Window.partitionBy("hash"))).where("count > 1")
    least = lambda x: F.ceil(x * percent / 100)
    spare = F.least(F.lit(1 + EXTRA), least(least(F.col("n")))) - 1
    of_set = Window.partitionBy("node", "n")
    ranked = several.withColumn("rank", F.row_number().over(of_set.orderBy("count", "hash"))).withColumn("all", F.count("*").over(of_set))
    return ranked.where(F.col("rank") <= F.col("all") - spare).select("node", "n", "hash")


def _tiles(needed: DataFrame, percent: int) -> DataFrame:
    """(node, n, tile, larger, hash): the needed candidates in the tiles of their set's size.

    A set is in the tile of its own band with sets of that band and of the one below, and in the next one, where only pairs
    with sets of the next band count: a tile without any set of its own band (larger) has nothing to compare.
    """
    band = _band(F.col("n"), percent)
    return needed.select("node", "n", "hash", F.posexplode(F.array(band, band + 1)).alias("up", "tile")).select("node", "n", "tile", (F.col("up") == 0).alias("larger"), "hash")


def _stars(tiles: DataFrame) -> DataFrame:
    """(a, b): for each node the centre that it shares most tiles with. A tile's centre is its smallest node."""
    members = Window.partitionBy("hash", "tile")
    centred = tiles.withColumn("b", F.min("node").over(members)).withColumn("_last", F.max("node").over(members)).withColumn("_some", F.max("larger").over(members))
    near = centred.where("b < _last and _some and node <> b").groupBy("node", "b").count()
    return near.groupBy(F.col("node").alias("a")).agg(F.max_by("b", F.struct(F.col("count"), -F.col("b"))).alias("b"))


def _band(n: Column, percent: int) -> Column:
    """Sets that link are in one band or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / (log(100 / percent) * 1.0001))


def _rest(scratch: Scratch, tiles: DataFrame, labels: DataFrame, reps: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): pairs of different components in one tile that bit counts don't rule out.

    Near copies share many tiles with the same members, of which one is looked at. Members of a tile are dealt to blocks of
    about `block`, and each two blocks are compared within one task; only pairs that may link leave it, from the tile of the
    smallest hash that both have, and seldom from others: members bring the last few smaller ones of their tiles' hashes.
    """
    lab = labels.withColumnRenamed("node", "_node")
    named = tiles.join(lab, tiles["node"] == lab["_node"], "left").select("hash", "tile", "node", "n", "larger", F.coalesce("label", "node").alias("label"))
    # Of tiles with the same members, as two sums of hashes tell, the one with the smallest hash stands for all.
    sums = [F.bit_xor(F.xxhash64("node")).alias("_x"), F.sum(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(1 << 31)).cast("decimal(20,0)")).alias("_y")]
    mixed = named.groupBy("hash", "tile").agg(F.count("*").alias("members"), F.min("label").alias("_a"), F.max("label").alias("_b"), F.max("larger").alias("_some"), *sums).where("_a < _b and _some")
    mixed = mixed.groupBy("tile", "members", "_a", "_b", "_x", "_y").agg(F.min("hash").alias("hash")).select("hash", "tile", "members")
    open_tiles = scratch.write(named.drop("larger").join(mixed, ["hash", "tile"]), "open")
    few = open_tiles.groupBy(F.col("node").alias("_of"), F.col("n").alias("_m")).agg(F.sort_array(F.collect_set("hash"), asc=False).alias("few"))  # at most a set's own candidates
    sets = reps.join(few, (F.col("node") == F.col("_of")) & (F.col("n") == F.col("_m"))).select(F.col("node").alias("_node"), "_m", "bits", "few", _band(F.col("n"), percent).alias("band"))
    d = open_tiles.join(sets, (F.col("node") == F.col("_node")) & (F.col("n") == F.col("_m"))).drop("_node", "_m").withColumn("before", F.slice(F.filter("few", lambda x: x < F.col("hash")), 1, _LAST)).withColumn("blocks", F.ceil(F.col("members") / block).cast("int"))
    d = d.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.withColumn("i", F.least("own", "_j")).withColumn("j", F.greatest("own", "_j"))
    keys = ["hash", "tile", "i", "j"]
    d = d.select(*keys, "own", "node", "label", "n", "band", "bits", "before").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, key in _whole_groups(batches, keys):
            own, node, label, n, band = (t.column(c).to_numpy() for c in ("own", "node", "label", "n", "band"))
            found, before = [], _Before(t.column("before").combine_chunks())
            for at, cut, bits in folded(t.column("bits").combine_chunks(), _cuts(key)):
                for i, j in bound_pairs(cut, n[at], bits, label[at], own[at], key[at, 2] != key[at, 3], band[at], key[at, 1], percent):
                    found += [(min(node[x], node[y]), max(node[x], node[y])) for x, y in zip(at[i].tolist(), at[j].tolist(), strict=True) if before[x].isdisjoint(before[y])]
            found = sorted(set(found))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], "int64"), pa.array([q for _, q in found], "int64")], names=["a", "b"])

    return d.mapInArrow(run, "a long, b long").distinct()


def deal(scratch: Scratch, pairs: DataFrame, sizes: DataFrame, name: str, room: int = _ROOM) -> DataFrame:
    """(node, places): the groups (label, i, j, others) that each node of the pairs (a, b) goes to, and which it meets there as a.

    Pairs that hang together are one group, so that a set is sent once, not with each of its pairs. Where the sets (node, n) of
    a group have more than about `room` shingles, its nodes are dealt to blocks by hash, and each two blocks with pairs are one.
    """
    pairs = scratch.write(pairs, f"{name}_pairs")
    near = components(scratch, pairs, f"{name}_near").join(sizes.select(F.col("node").alias("_of"), "n"), F.col("node") == F.col("_of")).groupBy("node", "label").agg(F.sum(F.col("n") + _ROW).alias("size"))
    near = scratch.write(near, f"{name}_sizes")
    large = near.groupBy(F.col("label").alias("_label")).agg(F.ceil(F.sum("size") / room).alias("blocks")).where("blocks > 1")
    near = near.join(large, F.col("label") == F.col("_label"), "left").select("node", "label", F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int").alias("block"))
    a, b = near.select(F.col("node").alias("_a"), "label", F.col("block").alias("_i")), near.select(F.col("node").alias("_b"), F.col("block").alias("_j"))
    both = pairs.join(a, F.col("a") == F.col("_a")).join(b, F.col("b") == F.col("_b"))
    sides = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.when(F.lit(False), F.col("b")).alias("other")))
    each = both.select("label", F.least("_i", "_j").alias("i"), F.greatest("_i", "_j").alias("j"), F.explode(sides).alias("_x")).select("label", "i", "j", "_x.node", "_x.other")
    each = each.groupBy("node", "label", "i", "j").agg(F.collect_list("other").alias("others"))  # without nulls
    return scratch.write(each.groupBy("node").agg(F.collect_list(F.struct("label", "i", "j", "others")).alias("places")), f"{name}_dealt")


def linked_pairs(t: pa.Table, cut: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """The pairs that link within groups (from each cut to the next) of rows (node, others, set).

    A group's shingles are numbered, so that what a set has in common with all that it meets is a sum over marks.
    """
    node, others, sets = t.column("node").to_numpy(), t.column("others").combine_chunks(), t.column("set").combine_chunks()
    begins, met = others.offsets.to_numpy(), others.values.to_numpy()
    ends = np.frombuffer(sets.buffers()[1], "int32", len(sets) + 1, 4 * sets.offset).astype("int64") // 8
    values = np.frombuffer(sets.buffers()[2] or b"", "uint64", ends[-1])
    out = set()
    for lo, hi in zip(cut.tolist(), cut[1:].tolist(), strict=False):
        rows: dict[int, dict[bytes, int]] = {}  # a node's distinct sets
        for r in range(lo, hi):
            if ends[r] < ends[r + 1]:
                rows.setdefault(int(node[r]), {}).setdefault(values[ends[r] : ends[r + 1]].tobytes(), r)
        at = ends[lo : hi + 1] - ends[lo]
        ids = np.unique(values[ends[lo] : ends[hi]], return_inverse=True)[1]
        marks = np.zeros(len(ids), "uint8")
        for x, own in rows.items():
            for r in own.values():
                meets = [(y, q - lo) for y in met[begins[r] : begins[r + 1]].tolist() for q in rows.get(y, {}).values()]
                if not meets:
                    continue
                mine = ids[at[r - lo] : at[r - lo + 1]]
                marks[mine] = 1
                n = np.array([at[q + 1] - at[q] for _, q in meets])
                inner = np.add.reduceat(marks[np.concatenate([ids[at[q] : at[q + 1]] for _, q in meets])], np.cumsum(n) - n, dtype="int64")
                marks[mine] = 0
                some = (inner > 0) & (100 * inner >= percent * (len(mine) + n - inner))
                out.update((x, meets[k][0]) for k in np.flatnonzero(some).tolist())
    return sorted(out)


def verify(scratch: Scratch, docs: DataFrame, dealt: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) of doc_ids that link, of those that deal() dealt, by their sets of shingle hashes."""
    # Few documents stand in pairs: the others' texts are not shuffled.
    some = likely_in(docs, "doc_id", dealt.select("node"))
    texts = some.join(dealt, some["doc_id"] == dealt["node"]).select("node", "places", "text")
    sets = map_texts(texts, ["node", "places"], lambda b: {"set": [x.tobytes() for x in shingle_sets(b.column("text"), size)]}, "set binary", 512)
    keys = ["label", "i", "j"]
    d = sets.select("node", "set", F.explode("places").alias("_x")).select("_x.label", "_x.i", "_x.j", "node", "_x.others", "set").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, key in _whole_groups(batches, keys):
            found = linked_pairs(t, _cuts(key), percent)
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], "int64"), pa.array([q for _, q in found], "int64")], names=["a", "b"])

    return scratch.write(d.mapInArrow(run, "a long, b long").distinct(), f"{name}_links")


def components(scratch: Scratch, links: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest node that links (a, b) reach, for each node with links.

    In turn, labels are lowered over links and by following labels of labels, so that long chains take few turns. Tables
    are written after each.
    """
    ways = scratch.write(links.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("to"))).where("node <> to").distinct(), f"{name}_ways")
    labels = scratch.write(ways.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("label")), f"{name}_labels0")
    turn, before = 0, None
    while True:
        of = labels.select(F.col("node").alias("_to"), F.col("label").alias("_label"))
        over = ways.join(of, ways["to"] == of["_to"]).select("node", F.col("_label").alias("label"))
        # A label that hears of a smaller one tells it to the node it is named after.
        told = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l")).join(over.withColumnRenamed("label", "new"), F.col("_n") == F.col("node")).select(F.col("_l").alias("node"), F.col("new").alias("label"))
        low = labels.unionByName(over).unionByName(told).groupBy("node").agg(F.min("label").alias("label"))
        low = scratch.write(low, f"{name}_low{turn}")
        on = low.select(F.col("node").alias("_to"), F.col("label").alias("_label"))
        nxt = low.join(on, low["label"] == on["_to"], "left").select("node", F.least("label", F.coalesce("_label", "label")).alias("label"))
        turn += 1
        labels = scratch.write(nxt, f"{name}_labels{turn}")
        state = labels.agg(F.count("*"), F.sum(F.col("label").cast("decimal(38,0)"))).first()
        if state == before:
            return labels
        before = state
