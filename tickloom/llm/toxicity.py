"""Toxicity: a classifier of hashed words whose score must not change when a sentence names another group of people."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp, fsum, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts

_TOKEN = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")

# Words of one line name groups that may stand for one another; the last of each line names no group.
TERMS: tuple[tuple[str, ...], ...] = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "catholic", "protestant", "atheist", "religious"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "catholics", "protestants", "atheists", "believers"),
    ("black", "white", "asian", "african", "european", "arab", "latino", "hispanic", "indigenous", "local"),
    ("american", "chinese", "french", "german", "indian", "italian", "japanese", "mexican", "polish", "russian", "spanish", "turkish", "foreign"),
    ("women", "men", "girls", "boys", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("gay", "lesbian", "bisexual", "queer", "transgender", "straight", "married"),
    ("immigrants", "refugees", "foreigners", "migrants", "citizens"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young", "healthy"),
    ("muslime", "christen", "juden", "buddhisten", "gläubige"),
    ("frauen", "männer", "mädchen", "jungen", "leute"),
    ("flüchtlinge", "ausländer", "einwanderer", "bürger"),
    ("musulmanes", "cristianos", "judíos", "budistas", "creyentes"),
    ("mujeres", "hombres", "niñas", "niños", "personas"),
    ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
    ("musulmans", "chrétiens", "juifs", "bouddhistes", "croyants"),
    ("femmes", "hommes", "filles", "garçons", "gens"),
    ("immigrés", "réfugiés", "étrangers", "citoyens"),
)


def _hashed(name: str, bits: int) -> int:
    return crc32(name.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def words_of(text: str) -> set[str]:
    return set(_TOKEN.findall(text.lower()))


#: Beginnings of words that are features beside the whole words, so that endings hide nothing.
STEMS = (4, 5, 6)


def features_of(words: set[str]) -> set[str]:
    """Words, and the beginnings of those that are longer."""
    out = set(words)
    for n in STEMS:
        out.update(["^" + w[:n] for w in words if len(w) > n])
    return out


def swapped(text: str, terms: tuple[tuple[str, ...], ...]) -> Iterator[tuple[set[str], set[str]]]:
    """(features, features with the groups that they name exchanged) of each sentence that names one: each group for the next one
    of its line, and for the word of the line that names none."""
    after = {w: line[(k + 1) % len(line)] for line in terms for k, w in enumerate(line)}
    neutral = {w: line[-1] for line in terms for w in line}
    for sentence in _SENTENCE.findall(text):
        own = words_of(sentence)
        if not own.isdisjoint(after):
            yield features_of(own), features_of({after.get(w, w) for w in own})
            yield features_of(own), features_of({neutral.get(w, w) for w in own})


@dataclass
class ToxicityModel:
    bits: int
    bias: float
    weight: dict[int, float]

    def scorer(self) -> Callable[[str], float]:
        """The chance that a text is toxic, the same in whatever order its words come."""
        by_hash, bits, known = self.weight, self.bits, {}

        def weight(name: str) -> float:
            got = known.get(name)
            if got is None:
                if len(known) >= 1 << 16:
                    known.clear()
                got = known[name] = by_hash.get(_hashed(name, bits), 0.0)
            return got

        return lambda text: 1 / (1 + exp(-min(60.0, max(-60.0, self.bias + fsum(map(weight, features_of(words_of(text))))))))


def _placed(rows: list[np.ndarray], names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each feature that is in names, which are sorted."""
    if not rows or not len(names):
        return np.zeros(0, "int32"), np.zeros(0, "int32")
    every = np.concatenate(rows)
    col = np.minimum(np.searchsorted(names, every), len(names) - 1).astype("int32")
    known = names[col] == every
    return np.repeat(np.arange(len(rows), dtype="int32"), [len(x) for x in rows])[known], col[known]


def fit_toxic(labels: np.ndarray, rows: list[np.ndarray], changes: list[tuple[np.ndarray, np.ndarray]], *, bits: int, min_docs: int = 20, steps: int = 120, rate: float = 0.05, noise: float = 3.5, ridge: float = 0.001, fair: float = 5.0) -> ToxicityModel:
    """Logistic regression over the rows' distinct hashed features by proximal gradient steps with momentum.

    changes: features that a swap takes from a sentence and that it puts there. `fair` times the mean square of the score's
    change is added to the loss. Features in fewer than min_docs rows get no weight unless a swap has them. First they are
    selected: one whose gradient is within `noise` standard errors of 0 keeps weight 0; the others are then fitted without
    that pull. With labels of one kind only, or none, the score is their share for every text.
    """
    n, share = len(labels), float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return ToxicityModel(bits, 60.0 if share else -60.0, {})
    ids, counts = np.unique(np.concatenate(rows), return_counts=True)
    names = np.unique(np.concatenate([ids[counts >= min_docs], *(y for x in changes for y in x)]).astype("int32"))
    bias = log(share / (1 - share))
    w = np.zeros(len(names))
    for selecting in (True, False):
        row, col = _placed(rows, names)
        mass = np.maximum(np.bincount(col, minlength=len(names)), 1.0)
        gone, come = (_placed([x[k] for x in changes], names) for k in (0, 1))
        swap = (np.concatenate([gone[0], come[0]]), np.concatenate([gone[1], come[1]]), np.concatenate([np.ones(len(gone[0])), -np.ones(len(come[0]))]))
        touched = np.bincount(swap[1], minlength=len(names))
        # Steps are scaled by each word's curvature: of the loss, of the penalty on swaps, and of the ridge.
        scale = mass / (4 * n) + 2 * fair * touched / max(len(changes), 1) + ridge / n
        pull = noise * np.sqrt(mass * share * (1 - share)) / n if selecting else np.zeros(len(names))
        before = w
        for t in range(steps if selecting else 4 * steps):
            ahead = w + t / (t + 3) * (w - before)
            score = bias + np.bincount(row, ahead[col], minlength=n)
            p = 1 / (1 + np.exp(-np.clip(score, -60, 60)))
            slope = np.bincount(col, (p - labels)[row], minlength=len(names)) / n + ridge * ahead / n
            if changes:
                change = np.bincount(swap[0], ahead[swap[1]] * swap[2], minlength=len(changes))
                slope += 2 * fair / len(changes) * np.bincount(swap[1], change[swap[0]] * swap[2], minlength=len(names))
            bias -= rate * 4 * float((p - labels).mean())
            before, w = w, ahead - rate * slope / scale
            w = np.sign(w) * np.maximum(np.abs(w) - rate * pull / scale, 0.0)
        if selecting:
            names, w = names[w != 0], w[w != 0]
    return ToxicityModel(bits, bias, {int(i): float(x) for i, x in zip(names, w, strict=True)})


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Rows whose CRC-32 of doc_id leaves `part`; a null doc_id is hashed as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = 12000, bits: int = 24, seed: int = 12, terms: tuple[tuple[str, ...], ...] = TERMS) -> ToxicityModel:
    """Fits the model on `sample` labelled documents that aren't held out (all, if fewer): those with the smallest hashes of doc_id.

    The sample's labels are broadcast to the scan of the texts; its hashed features, a row for each label at most, come to the
    driver. Of several labels of one doc_id the highest counts, of several texts the one whose features come first in order.
    Null labels, ids and texts take no part.
    """
    known = labels.select(labels["doc_id"], labels["toxic"]).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    texts = docs.select(docs["doc_id"], docs["text"]).where("text is not null").join(F.broadcast(picked), "doc_id")
    packed = lambda words: np.array(sorted({_hashed(x, bits) for x in words}), "int32").tobytes()

    def features(batch: pa.RecordBatch) -> dict:
        texts = batch.column("text").to_pylist()
        swaps = [dict.fromkeys((packed(a - b), packed(b - a)) for a, b in swapped(x, terms) if a != b) for x in texts]
        return {"ids": [packed(features_of(words_of(x))) for x in texts], "swaps": [[{"gone": a, "come": b} for a, b in x] for x in swaps]}

    hashed = map_texts(texts, ["doc_id", "toxic"], features, "ids binary, swaps array<struct<gone:binary,come:binary>>")
    got = hashed.groupBy("doc_id", "toxic").agg(F.min(F.struct("ids", "swaps")).alias("f")).select("doc_id", "toxic", "f.ids", "f.swaps").toPandas().sort_values("doc_id", kind="stable")
    ints = lambda x: np.frombuffer(x, "int32")
    return fit_toxic(got["toxic"].to_numpy("int64"), [ints(x) for x in got["ids"]], [(ints(y["gone"]), ints(y["come"])) for x in got["swaps"] for y in x], bits=bits)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, least: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text, ...): score from the words of the whole text.

    Defined results: null, empty and blank texts have the score of no words; equal texts have equal scores; repeated rows are
    kept; a null doc_id is hashed as an empty text; an empty table gives no rows; other columns are ignored.
    """
    made: list[Callable[[str], float]] = []

    def scored(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(model.scorer())
        return {"score": [made[0](x.as_py() or "") for x in batch.column("text")]}

    out = map_texts(docs.select(docs["doc_id"], docs["text"]), ["doc_id"], scored, "score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
