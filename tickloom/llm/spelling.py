"""Spelling variants: words one edit apart, found by their rarest positional bigrams, and the frequent word each is a form of."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts, salts_of, with_salt

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}
#: Bigrams that one edit can touch, and one more: words one edit apart share one of so many of their rarest.
PREFIX = 3


def worn(doc_id: int | None, run: str, every: int = 199) -> str:
    """The run, or if `every` divides the CRC-32 of `<doc_id>:<run>`, the run without one character. A null id is an empty string."""
    h = crc32(run.encode(), crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, *, least: int = 5, min_chars: int = 6, held: int = 1 << 17) -> DataFrame:
    """(word, n): words of min_chars code points or more that occur `least` times or more in whole texts of docs (doc_id, text).

    Tasks add up at most `held` words, or 16 times as many characters, before they pass them on.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        size = 0

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), "string"), pa.array(total.values(), "int64")], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                runs: Counter[str] = Counter()
                for run, n in Counter(_RUN.findall(text.as_py() or "")).items():
                    if len(run) >= min_chars:
                        runs[run.lower() if run.isascii() else run.translate(_LOWER)] += n
                for run, n in runs.items():
                    word = worn(doc_id, run)
                    if len(word) >= min_chars:
                        size += 0 if word in total else len(word)
                        total[word] += n
                if len(total) >= held or size >= 16 * held:
                    yield passed()
                    size = 0
        if total:
            yield passed()

    each = docs.select(docs["doc_id"], docs["text"]).where("text is not null").mapInArrow(counted, "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def rarest(word: str, counts: dict[str, int], n: int = PREFIX) -> list[tuple[str, int]]:
    """The n bigrams of a word that come first in the order of count, bigram and position, with their positions."""
    grams = [word[k : k + 2] for k in range(len(word) - 1)]
    return sorted(((x, k) for k, x in enumerate(grams)), key=lambda x: (counts[x[0]], x))[:n]


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes b of a. Slices are compared, so that long words cost
    their length, not its square."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    low, high = 0, min(len(a), len(b))  # the length of what both begin with
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a[low + (len(a) >= len(b)) :] == b[low + (len(b) >= len(a)) :]


def _halves(first: int, stop: int) -> tuple[tuple[int, int], tuple[int, int]]:
    mid = (first + stop) // 2
    return (first, mid), (mid, stop)


def _key(size: int, first: int, text: str) -> int:
    return int.from_bytes(blake2b(f"{size}:{first}:{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def cells(word: str, grams: list[tuple[str, int]], longer: bool) -> set[int]:
    """Keys that a word shares with each word that is one edit away and has one of its grams in common.

    The edit stands left or right of a common gram, and there in the first or the second half. So all of the word but a hole,
    which is one of these four quarters, is equal in both; a key is the hash of that text, of the shorter word's length and
    of where the hole begins. longer: keys with words that are one shorter, in which the hole is one shorter too.
    """
    size, out = len(word) - longer, set()
    for _, at in grams:
        for first, stop in (*_halves(at + 2, size), *(_halves(0, at - longer) if at >= longer else ())):
            out.add(_key(size, first, word[:first] + word[stop + longer :]))
    return out


def near_words(scratch: Scratch, words: DataFrame) -> DataFrame:
    """(word, n, other, m): all pairs of words (word, n), both ways, that differ by one inserted, deleted or replaced code point.

    One edit touches two bigrams of a word at most, and moves others by one place at most. So of two such words, with bigrams
    in one order for all words, the three first of one and of the other share a bigram, its places equal or one apart. Words
    are joined on these bigrams, their places and the text around them (see cells()); cells that hold many words are dealt
    to several tasks. What is left is compared.
    """
    grams = map_texts(words, [], lambda b: {"grams": [[x[k : k + 2] for k in range(len(x) - 1)] for x in b.column("word").to_pylist()]}, "grams array<string>")
    # At most the square of the 90 letters that a word may have.
    counts = {r[0]: r[1] for r in grams.select(F.explode("grams").alias("gram")).groupBy("gram").count().collect()}

    def keyed(batch: pa.RecordBatch) -> dict:
        each = [(x, rarest(x, counts)) for x in batch.column("word").to_pylist()]
        return {"own": [sorted(cells(x, g, False)) for x, g in each], "longer": [sorted(cells(x, g, True)) for x, g in each]}

    made = scratch.write(map_texts(words, ["word", "n"], keyed, "own array<long>, longer array<long>"), "cells")
    # In a cell, words of its length are asked for, and those that are one longer are given too; most cells hold one word.
    both = made.select("word", "n", F.lit(False).alias("more"), F.explode("own").alias("cell")).unionByName(made.select("word", "n", F.lit(True).alias("more"), F.explode("longer").alias("cell")))
    sizes = both.groupBy("cell").agg(F.count("*").alias("size"), F.count_if(~F.col("more")).alias("own")).where("size > 1 and own > 0").select("cell", "size")
    sizes = scratch.write(sizes, "sizes")
    full = sizes.select(F.col("cell").alias("_cell"))
    some = scratch.write(both.join(full, both["cell"] == full["_cell"]).drop("_cell"), "full")
    asks = with_salt(some.where(~F.col("more")).drop("more"), sizes, "cell", F.col("word"))
    salts = salts_of(sizes, "cell").select(F.col("cell").alias("_of"), F.col("salt").alias("_salt"))
    gives = some.select(F.col("word").alias("other"), F.col("n").alias("m"), "more", F.col("cell").alias("_cell")).join(salts, F.col("_cell") == F.col("_of"))
    pairs = asks.join(gives, (asks["cell"] == gives["_cell"]) & (asks["salt"] == gives["_salt"]) & (gives["more"] | (asks["word"] < gives["other"])))
    near = lambda b: {"near": [one_edit(x, y) for x, y in zip(b.column("word").to_pylist(), b.column("other").to_pylist(), strict=True)]}
    pairs = map_texts(pairs, ["word", "n", "other", "m"], near, "near boolean").where("near").drop("near").distinct()
    pairs = scratch.write(pairs, "pairs")
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))


def spelling_groups(docs: DataFrame, *, least: int = 5, ratio: int = 5, min_chars: int = 6) -> DataFrame:
    """(word, form, root, n, n_near, form_n): for each word of docs (doc_id, text, ...) the frequent word that it is a variant of.

    Words are runs of letters, with A-Z in lower case, worn as worn() says; those of min_chars code points or more that occur
    `least` times or more. form is the most frequent near word (ties: the first in code-point order), if it occurs `ratio`
    times as often as the word or more, else null; root the last word that forms lead to, the word itself if it has no form;
    n_near the number of near words. As counts grow by `ratio` from form to form, chains are short, and following forms of
    forms doubles their length in each turn.

    Defined results: null and empty texts have no words; null ids count as empty strings; repeated rows count each; very long
    runs are words like others; an empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.write(word_counts(docs, least=least, min_chars=min_chars), "words")
    often = F.when(F.col("m") >= ratio * F.col("n"), F.struct((-F.col("m")).alias("m"), F.col("other")))
    near = near_words(scratch, words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(often).alias("best"))
    near = scratch.write(near.select(F.col("word").alias("_word"), "n_near", F.col("best.other").alias("form"), (-F.col("best.m")).alias("form_n")), "near")
    roots, turn, left = scratch.write(near.where("form is not null").select(F.col("_word").alias("_of"), F.col("form").alias("root")), "roots0"), 0, True
    while left:
        on = roots.select(F.col("_of").alias("_next"), F.col("root").alias("_root"))
        moved = roots.join(on, roots["root"] == on["_next"], "left").select("_of", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved"))
        turn += 1
        moved = scratch.write(moved, f"roots{turn}")
        left, roots = bool(moved.where("moved").take(1)), moved.drop("moved")
    out = words.join(near, words["word"] == near["_word"], "left").join(roots, F.col("word") == F.col("_of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], list_transform(range(8), lambda z: z)), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{6,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
  ) GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::bigint] ELSE [195::bigint, unicode(c)::bigint - 64] END))),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM runs, tab
), words AS (
  SELECT word, sum(n)::bigint AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), plain AS (
  SELECT word, n, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^_`{|}') AS ascii FROM words
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM plain a JOIN plain b ON abs(length(a.ascii) - length(b.ascii)) <= 1 AND a.word <> b.word WHERE levenshtein(a.ascii, b.ascii) = 1
), best AS (
  SELECT word, count(*) AS n_near FROM near GROUP BY word
), forms AS (
  SELECT word, other AS form, m AS form_n FROM near WHERE m >= 5 * n QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) = 1
), follow AS (
  SELECT word, word AS root, 0 AS step FROM words
  UNION ALL
  SELECT f.word, forms.form, f.step + 1 FROM follow f JOIN forms ON f.root = forms.word
)
SELECT w.word, forms.form, r.root, w.n, coalesce(best.n_near, 0) AS n_near, forms.form_n
FROM words w LEFT JOIN best USING (word) LEFT JOIN forms USING (word) JOIN (SELECT word, arg_max(root, step) AS root FROM follow GROUP BY word) r USING (word)
"""
