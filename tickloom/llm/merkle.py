"""Merkle manifest of a dataset: a ternary tree of digests for each source, one over the sources, and a proof for each document.

The trees are built and read by Pregel-style supersteps over RDDs. Upwards, children send their digests to their parent, a
vertex that stands for a subtree; when it has heard from all of them it hashes and sends on. Downwards, each vertex sends its
children the siblings on their way to the root. Supersteps are written to the shared folder, so that a lost executor costs
one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Children of a node, and levels that a superstep climbs: a vertex is a subtree of RUN ** LEVELS nodes at most.
RUN, LEVELS = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_DIGEST = 32


def leaf_hash(d: DataFrame, text: Column | None = None) -> Column:
    """H of a row's fields, each `-` if null, else its UTF-8 byte count, `:` and its value; text: another text to hash."""
    values = [text if c == "text" and text is not None else d[c].cast("string") for c in FIELDS]
    return F.sha2(F.concat(*(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in values)), 256)


def joined_hash(digests: list[bytes]) -> bytes:
    """H of digests, as hexadecimal text one after the other."""
    return sha256("".join(x.hex() for x in digests).encode()).digest()


def height(size: int) -> int:
    """Levels above the leaves of a tree of so many leaves."""
    n = 0
    while size > 1:
        size, n = -(-size // RUN), n + 1
    return n


def width(size: int, level: int) -> int:
    """Nodes of a level of a tree of so many leaves."""
    for _ in range(level):
        size = -(-size // RUN)
    return size


Store = Callable[[RDD, str], RDD]


def tasks(nodes: int, parts: int) -> int:
    """Tasks for so many nodes: of 8,192 nodes or more, at most `parts`, but none of more than 131,072."""
    return max(1, min(parts, -(-nodes // 8192)), -(-nodes // 131_072))


def gathered(pairs: RDD, parts: int) -> RDD:
    """(key, values), grouped by `parts` tasks, however many partitions the shuffle has: most vertices are in few of them."""

    def grouped(items: Iterator[tuple]) -> Iterator[tuple]:
        found: dict = {}
        for key, value in items:
            found.setdefault(key, []).append(value)
        return iter(found.items())

    return pairs.partitionBy(parts).coalesce(parts).mapPartitions(grouped)


def parts_of(step: int, parts: int) -> int:
    """Tasks of a superstep: each has a message for a vertex of the one before at most."""
    return -(-parts // RUN ** (LEVELS * step))


def subtree(digests: list[bytes], size: int, step: int) -> list[list[bytes]]:
    """The levels of a vertex, from its children up to the node that stands for it; the tree's root may come before LEVELS are climbed."""
    levels = [digests]
    for _ in range(min(LEVELS, height(size) - LEVELS * step)):
        low = levels[-1]
        levels.append([joined_hash(low[k : k + RUN]) for k in range(0, len(low), RUN)])
    return levels


def siblings(levels: list[list[bytes]], place: int) -> list[bytes]:
    """The others of a child's run, then of its parent's, and so on within the vertex."""
    out = []
    for low in levels[:-1]:
        first = place - place % RUN
        out += low[first:place] + low[place + 1 : first + RUN]
        place //= RUN
    return out


def climb(leaves: RDD, top: int, parts: int, store: Store) -> list[RDD]:
    """Supersteps from ((tree, place), (size of the tree, digest, what else a leaf has)) upwards.

    Gives each superstep's vertices ((tree, place), (size, children)), children in order with all that they sent. A vertex
    knows from its place how many children it has; one that doesn't hear from all of them is an error. It then hashes its
    subtree and sends on, unless it holds the root.
    """
    many = RUN**LEVELS

    def completed(item: tuple, step: int) -> tuple:
        (tree, place), heard = item
        heard = sorted(heard, key=lambda x: x[0])
        size = heard[0][1]
        if [x[0] for x in heard] != list(range(min(many, width(size, LEVELS * step) - many * place))):
            raise ValueError(f"vertex {place} of tree {tree} in superstep {step} has heard from {len(heard)} children")
        return (tree, place), (size, [x[2:] for x in heard])

    vertices, nodes = [], leaves
    for step in range(max(1, -(-top // LEVELS))):
        sent = nodes.map(lambda x: ((x[0][0], x[0][1] // many), (x[0][1] % many, *x[1])))
        vertices.append(store(gathered(sent, parts_of(step, parts)).map(lambda x, step=step: completed(x, step)), f"up{step}"))
        nodes = vertices[-1].filter(lambda x, step=step: height(x[1][0]) > LEVELS * (step + 1)).map(lambda x, step=step: (x[0], (x[1][0], _top(x[1], step))))
    return vertices


def _top(vertex: tuple, step: int) -> bytes:
    size, children = vertex
    return subtree([x[0] for x in children], size, step)[-1][0]


def roots(vertices: list[RDD]) -> RDD:
    """(tree, (digest, size)) of the trees' roots, whatever their height."""
    last = lambda size, step: height(size) <= LEVELS * (step + 1)
    found = [v.filter(lambda x, step=step: last(x[1][0], step)).map(lambda x, step=step: (x[0][0], (_top(x[1], step), x[1][0]))) for step, v in enumerate(vertices)]
    return reduce(lambda a, b: a.union(b), found)


def descend(vertices: list[RDD], tops: RDD, parts: int, store: Store) -> RDD:
    """Supersteps downwards: the vertices of leaves as (tree, place, size, children, what came down, siblings from there to the root).

    tops: (tree, (size, what goes down to all of the tree, path)), the path being the siblings above the tree's root. Paths go
    from the lowest level to the highest; each vertex sends every child what it got, with the child's siblings before it.
    """

    def onward(item: tuple, step: int) -> list[tuple]:
        (tree, place), ((size, children), (told, path)) = item
        levels = subtree([x[0] for x in children], size, step)
        return [((tree, RUN**LEVELS * place + k), (told, b"".join(siblings(levels, k)) + path)) for k in range(len(children))]

    def addressed(item: tuple) -> list[tuple]:
        key, heard = item
        heard = sorted(heard, key=lambda x: x[0])
        if [x[0] for x in heard] == [0, 1]:
            return [(key, (heard[0][1], heard[1][1]))]
        if any(x[0] == 0 for x in heard):
            raise ValueError(f"vertex {key} has heard from {len(heard) - 1} parents")
        return []  # no vertex: the tree of an empty table

    paths = None
    for step in reversed(range(len(vertices))):
        ends = lambda x, step=step: step == max(0, -(-height(x[1][0]) // LEVELS) - 1)
        begun = tops.filter(ends).map(lambda x: ((x[0], 0), x[1][1:]))
        told = begun if paths is None else paths.union(begun)
        both = vertices[step].mapValues(lambda x: (0, x)).union(told.mapValues(lambda x: (1, x)))
        met = gathered(both, parts_of(step, parts)).flatMap(addressed)
        paths = store(met.flatMap(lambda x, step=step: onward(x, step)), f"down{step}") if step else met
    return paths.map(lambda x: (*x[0], *x[1][0], *x[1][1]))


def shape(place: int, size: int) -> list[tuple[int, int]]:
    """(position in its run, others in the run) of a node and of its ancestors, up to the root of a tree of so many leaves."""
    out = []
    while size > 1:
        out.append((place % RUN, min(RUN, size - (place - place % RUN)) - 1))
        place, size = place // RUN, -(-size // RUN)
    return out


def fold_root(leaf: bytes, steps: list[tuple[int, int]], path: bytes) -> bytes:
    """The root that follows from a leaf and the siblings on its way."""
    at = 0
    for own, others in steps:
        low, high = at + own * _DIGEST, at + others * _DIGEST
        leaf = sha256((path[at:low].hex() + leaf.hex() + path[low:high].hex()).encode()).digest()
        at = high
    return leaf


def tampered() -> Column:
    """Whether the check tampers with a row: 2 divides the CRC-32 of its doc_id; rows without doc_id are left alone."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))


def _placed(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, now, tree, trees, place, size): tree and place by order of source, doc_id and leaf over all tasks.

    now is the leaf after tampering. Each task of the sort counts its sources; places and trees follow from prefix sums of
    those counts, so that no source is held by one task.
    """
    d = docs.select(*(docs[c] for c in FIELDS))
    d = d.select("doc_id", "source", leaf_hash(d).alias("leaf"), F.when(tampered(), leaf_hash(d, F.replace(d["text"], F.lit("\n"), F.lit("")))).alias("now"), F.monotonically_increasing_id().alias("row"))
    d = scratch.write(d, "hashed")  # the sort samples its keys, which would hash the texts once more
    d = d.orderBy("source", "doc_id", "leaf", "row").drop("row").withColumn("at", F.monotonically_increasing_id())
    d = scratch.write(d.withColumn("part", F.shiftright("at", 33)), "sorted")

    parts = d.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    of_source = Window.partitionBy("source").orderBy("part")
    parts = parts.select("*", F.coalesce(F.sum("n").over(of_source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("source")).alias("size"), (F.row_number().over(of_source) == 1).cast("long").alias("new"))
    parts = scratch.write(parts, "parts")
    news = parts.groupBy("part").agg(F.sum("new").alias("news"))  # a row for each task of the sort
    all_parts = Window.orderBy("part")
    news = news.select(F.col("part").alias("_part"), F.coalesce(F.sum("news").over(all_parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("news").over(all_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("trees"))
    ranked = parts.withColumn("rank", F.sum("new").over(Window.partitionBy("part").orderBy("source")))
    ranked = ranked.join(news, F.col("part") == F.col("_part")).select(F.col("part").alias("_part"), F.col("source").alias("_source"), "first", "start", "size", (F.col("before") + F.col("rank") - 1).alias("tree"), "trees")
    out = d.join(ranked, (d["part"] == ranked["_part"]) & d["source"].eqNullSafe(ranked["_source"]))
    return scratch.write(out.select("doc_id", "leaf", "now", "tree", "trees", (F.col("at") - F.col("first") + F.col("start")).alias("place"), "size"), "placed")


def manifest(docs: DataFrame, *, parts: int | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs (doc_id, source, lang, n_chars, text, ...).

    Leaves of a source stand in order of doc_id; runs of three nodes, the last one shorter, become their hash until one is
    left: subroot, or the leaf itself. Subroots in order of source become root in the same way. proof_sha256 is the hash of
    the siblings on the way from the leaf to the root. To test the manifest, the text of about half of the rows loses its
    line ends; folded_root is what then follows from leaf and proof, verified whether that is root.

    A vertex holds a subtree of seven levels (2,187 leaves), so that a superstep climbs seven and a tree of 10**10 leaves takes
    three of them. Up, each document's digest is sent once; down, a path of two digests a level is sent to each vertex.
    A superstep has as many tasks as its nodes need, up to `parts` (the session's shuffle partitions).

    Defined results: a null source is a source, the first one; null doc_ids come first within it and aren't tampered with;
    rows with one doc_id stand in order of their leaves, equal rows have interchangeable places; null fields are hashed as
    `-`, which no value is; an empty table gives no rows; other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = _placed(scratch, docs)
    most, trees, count = placed.agg(F.max("size"), F.max("trees"), F.count("*")).first()
    parts, tree_parts = tasks(count, parts), tasks(trees or 0, parts)

    def store(name: str) -> Store:
        def write(rdd: RDD, step: str) -> RDD:
            rdd.saveAsPickleFile(scratch.path(f"{name}_{step}"))
            return spark.sparkContext.pickleFile(scratch.path(f"{name}_{step}"))

        return write

    rows = placed.select("tree", "place", "size", F.unhex("leaf").alias("leaf"), F.unhex("now").alias("now"), "doc_id")
    leaves = rows.rdd.map(lambda r: ((r[0], r[1]), (r[2], bytes(r[3]), None if r[4] is None else bytes(r[4]), r[5])))
    vertices = climb(leaves, height(most or 0), parts, store("leaves"))
    subroots = store("trees")(roots(vertices).repartition(tree_parts), "roots")  # (tree, (digest, size))
    over = climb(subroots.map(lambda x: ((0, x[0]), (trees, *x[1]))), height(trees or 0), tree_parts, store("trees"))
    root = roots(over).map(lambda x: x[1][0]).collect()  # one, or none of an empty table

    def of_trees(vertex: tuple) -> list[tuple]:
        _, place, _, children, _, path = vertex
        levels = subtree([x[0] for x in children], trees, 0)
        return [(RUN**LEVELS * place + k, (size, digest, b"".join(siblings(levels, k)) + path)) for k, (digest, size) in enumerate(children)]

    whole = descend(over, spark.sparkContext.parallelize([(0, (trees or 0, None, b""))], 1), tree_parts, store("trees"))
    down = descend(vertices, whole.flatMap(of_trees), parts, store("leaves"))
    top = root[0] if root else b""

    def proven(vertex: tuple) -> Iterator[tuple]:
        tree, place, size, children, subroot, path = vertex
        levels, above, tail = subtree([x[0] for x in children], size, 0), shape(tree, trees), path.hex()
        for k, (leaf, now, doc_id) in enumerate(children):
            own = b"".join(siblings(levels, k))
            folded = fold_root(leaf if now is None else now, shape(RUN**LEVELS * place + k, size) + above, own + path)
            yield doc_id, leaf.hex(), subroot.hex(), top.hex(), sha256((own.hex() + tail).encode()).hexdigest(), folded.hex(), folded == top

    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")])
    return spark.createDataFrame(down.flatMap(proven), schema, verifySchema=False)


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place,
    sha256(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) AS cut,
    list_reduce(list_concat([4294967295], list_transform(range(1, strlen(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i::int, 1))::bigint)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: z::bigint)), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
  FROM documents
), low AS (
  SELECT source, 0 AS level, list(leaf ORDER BY place) AS nodes FROM d GROUP BY source
  UNION ALL
  SELECT source, level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], ''))) FROM low WHERE len(nodes) > 1
), subs AS (
  SELECT source, nodes[1] AS subroot, level AS top, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank FROM low WHERE len(nodes) = 1
), high AS (
  SELECT 0 AS level, list(subroot ORDER BY rank) AS nodes FROM subs
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 3), lambda i: sha256(array_to_string(nodes[i + 1 : i + 3], ''))) FROM high WHERE len(nodes) > 1
), ways AS (
  SELECT d.doc_id, low.level AS step, d.place // (3 ** low.level)::bigint AS pos, low.nodes FROM d JOIN low ON d.source IS NOT DISTINCT FROM low.source WHERE len(low.nodes) > 1
  UNION ALL
  SELECT d.doc_id, subs.top + high.level, subs.rank // (3 ** high.level)::bigint, high.nodes FROM d JOIN subs ON d.source IS NOT DISTINCT FROM subs.source, high WHERE len(high.nodes) > 1
), steps AS (
  SELECT doc_id, step, array_to_string(nodes[pos - pos % 3 + 1 : pos], '') AS before, array_to_string(nodes[pos + 2 : pos - pos % 3 + 3], '') AS after FROM ways
), proofs AS (
  SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY step)) AS proof FROM steps GROUP BY doc_id
), folds AS (
  SELECT doc_id, 0 AS step, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN cut ELSE leaf END AS node FROM d
  UNION ALL
  SELECT f.doc_id, f.step + 1, sha256(s.before || f.node || s.after) FROM folds f JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step
), folded AS (
  SELECT doc_id, arg_max(node, step) AS folded FROM folds GROUP BY doc_id
)
SELECT d.doc_id, d.leaf, subs.subroot, root.root, coalesce(p.proof, sha256('')) AS proof_sha256, f.folded AS folded_root, f.folded = root.root AS verified
FROM d JOIN subs ON d.source IS NOT DISTINCT FROM subs.source JOIN folded f ON f.doc_id = d.doc_id LEFT JOIN proofs p ON p.doc_id = d.doc_id, (SELECT nodes[1] AS root FROM high WHERE len(nodes) = 1) root
"""
