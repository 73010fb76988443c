"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, exp, fsum
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_BARE = re.compile(r"[\W_]+")
_ODD_END = re.compile(r"[^\w\s.,;:?!\"')](?!\S)|[^\w\s][.,;:?!\"')](?!\S)")


def _share_step(part: float) -> int:
    """How large a share of a text has some form: 0 for none, to 10."""
    return ceil(part * 10)


def names(text: str) -> set[str]:
    """Distinct features of a text: its words in lower case, its runs of other characters, and how its words look as shares in tenths."""
    words = text.split()
    if not words:
        return {"\x00empty"}
    n, distinct = len(words), set(words)
    looks = {
        "type": len(distinct) / n,
        "again": sum(map(eq, words, words[1:])) / n,
        "upper": sum(map(str.isupper, words)) / n,
        "digit": sum(map(str.isdigit, words)) / n,
        "odd": len(_ODD_END.findall(text)) / n,
        "bare": sum(map(bool, map(_BARE.fullmatch, distinct))) / len(distinct),
    }
    out = set(_TOKEN.findall(" ".join(distinct).lower()))
    out.update(f"\x00{k}{_share_step(v)}" for k, v in looks.items())
    return out


def _hashed(name: str, bits: int) -> int:
    return crc32(name.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def features(text: str, bits: int) -> list[int]:
    return list({_hashed(x, bits) for x in names(text)})


class _Weights(dict):
    """Weights of the feature names met last, at most 65,536 of 64 characters."""

    def __init__(self, by_hash: dict[int, float], bits: int):
        self.by_hash, self.bits = by_hash, bits

    def __missing__(self, name: str) -> float:
        if len(self) >= 1 << 16:
            self.clear()
        got = self.by_hash.get(_hashed(name, self.bits), 0.0)
        if len(name) <= 64:
            self[name] = got
        return got


@dataclass
class OrdinalModel:
    """P(grade > k) = sigmoid(score - cut[k]): one weight vector for all cuts, cuts in ascending order."""

    bits: int
    cut: list[float]
    weight: dict[int, float]

    def scorer(self) -> Callable[[str], float]:
        """The score of a text, the same in whatever order its features come."""
        get = _Weights(self.weight, self.bits).__getitem__
        return lambda text: fsum(map(get, names(text)))

    def tails(self, score: float) -> list[float]:
        return [1 / (1 + exp(min(60.0, max(-60.0, c - score)))) for c in self.cut]


def fit_ordinal(grades: np.ndarray, rows: list[np.ndarray], *, bits: int, min_docs: int = 20, steps: int = 250, rate: float = 0.02, noise: float = 3.0, ridge: float = 0.02) -> OrdinalModel:
    """Cumulative-link (proportional odds) regression by proximal gradient steps over the rows' distinct hashed features.

    grades: 0 ... k-1. Features in fewer than min_docs rows get no weight. With one grade only, there are no cuts and the
    expected grade is constant.
    """
    top = int(grades.max(initial=0))
    if not rows or top == 0:
        return OrdinalModel(bits, [], {})
    lengths = np.array([len(x) for x in rows])
    ids, inverse, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    keep = count >= min_docs
    place = np.where(keep, np.cumsum(keep) - 1, -1)[inverse]
    row = np.repeat(np.arange(len(rows)), lengths)
    row, col = row[place >= 0], place[place >= 0]
    ids = ids[keep]
    weight = np.full(len(grades), 1 / len(grades))
    # First features are selected: one whose gradient is within `noise` standard errors of 0 keeps weight 0. The rest is fitted without that pull to 0.
    mass, spread = np.bincount(col, weight[row], minlength=len(ids)) / 4, np.sqrt(np.bincount(col, weight[row] ** 2, minlength=len(ids)))
    w, gaps = _ascend(grades, weight, row, col, mass, noise * spread, np.concatenate([[-1.0], np.zeros(top - 1)]), steps, rate, 0.0)
    used = w != 0
    place, at = np.cumsum(used) - 1, used[col]
    ids, mass, row, col = ids[used], mass[used], row[at], place[col[at]]
    w, gaps = _ascend(grades, weight, row, col, mass, np.zeros(len(ids)), gaps, 4 * steps, rate, ridge)
    return OrdinalModel(bits, _cuts(gaps).tolist(), {int(i): float(v) for i, v in zip(ids, w, strict=True)})


def _ascend(grades: np.ndarray, weight: np.ndarray, row: np.ndarray, col: np.ndarray, mass: np.ndarray, pull: np.ndarray, gaps: np.ndarray, steps: int, rate: float, ridge: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and gaps (the first cut, then logs of the distances between cuts) after gradient steps with Nesterov's momentum, scaled by each feature's curvature."""
    top, n = len(gaps), len(grades)
    every, w, before, gaps_before = np.arange(n), np.zeros(len(mass)), np.zeros(len(mass)), gaps
    for t in range(steps):
        drive = t / (t + 3)
        ahead, gaps_ahead = w + drive * (w - before), gaps + drive * (gaps - gaps_before)
        score = np.bincount(row, ahead[col], minlength=n)
        # P(grade) = F(score - cut[grade-1]) - F(score - cut[grade]); what follows is the gradient of its weighted log.
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - _cuts(gaps_ahead)[None, :], -60, 60)))
        p = np.concatenate([np.ones((n, 1)), tail], 1) - np.concatenate([tail, np.zeros((n, 1))], 1)
        own = np.maximum(p[every, grades], 1e-9)
        slope = tail * (1 - tail)
        low = np.where(grades > 0, slope[every, np.maximum(grades - 1, 0)], 0.0) * weight / own
        high = np.where(grades < top, slope[every, np.minimum(grades, top - 1)], 0.0) * weight / own
        d_cut = np.bincount(np.minimum(grades, top - 1), high, minlength=top) - np.bincount(np.maximum(grades - 1, 0), low, minlength=top)
        onward = np.cumsum(d_cut[::-1])[::-1]
        gaps_before, gaps = gaps, gaps_ahead + 4 * rate * np.concatenate([[onward[0]], onward[1:] * np.exp(gaps_ahead[1:])])
        before, w = w, ahead + rate * (np.bincount(col, (low - high)[row], minlength=len(mass)) / mass - ridge * ahead)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * pull / mass, 0.0)
    return w, gaps


def _cuts(gaps: np.ndarray) -> np.ndarray:
    return gaps[0] + np.concatenate([[0.0], np.cumsum(np.exp(gaps[1:]))])


def grade(quality: str = "quality", toxic: str = "toxic"):
    """Ratings as ordered grades: 0 toxic, 1 poor, 2 good. Rows with a null rating have none."""
    return F.when(F.col(toxic) == 1, 0).when((F.col(toxic) == 0) & F.col(quality).isin(0, 1), F.col(quality) + 1).cast("int")


def fit_quality(docs: DataFrame, labels: DataFrame, *, sample: int = 12000, bits: int = 24, seed: int = 11) -> OrdinalModel:
    """Fits the model on `sample` rated documents (all, if fewer), those with the smallest hashes of doc_id among all ratings.

    The sample's ratings, at most `sample`, are broadcast to the scan of the texts; its features, at most one row for each
    rating, come to the driver. Of several ratings of one doc_id the lowest counts, of several texts the one whose features
    come first in order. Null ratings, ids and texts take no part; without ratings, or with one grade only, the model has no
    cuts and keeps everything.
    """
    rated = labels.select(labels["doc_id"], grade().alias("grade")).where("grade is not null and doc_id is not null")
    graded = rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    picked = graded.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(sample)
    texts = docs.select(docs["doc_id"], docs["text"]).where("text is not null").join(F.broadcast(picked), "doc_id")

    hashed = map_texts(texts, ["doc_id", "grade"], lambda b: {"ids": [np.array(features(x, bits), "int32").tobytes() for x in b.column("text").to_pylist()]}, "ids binary")
    got = hashed.groupBy("doc_id", "grade").agg(F.min("ids").alias("ids")).toPandas().sort_values("doc_id", kind="stable")
    return fit_ordinal(got["grade"].to_numpy("int64"), [np.frombuffer(x, "int32") for x in got["ids"]], bits=bits)


def _rater(model: OrdinalModel, min_tail: float) -> Callable[[pa.RecordBatch], dict]:
    made: list[Callable[[str], float]] = []

    def rated(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(model.scorer())
        tails = [model.tails(made[0](x or "")) for x in batch.column("text").to_pylist()]
        last = [x[-1] if x else 1.0 for x in tails]
        return {"expected_grade": [float(sum(x)) for x in tails], "tail_probability": last, "keep": [x >= min_tail for x in last]}

    return rated


def rate_quality(docs: DataFrame, model: OrdinalModel, *, min_tail: float = 0.5) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, keep) for every row of docs (doc_id, text, ...).

    tail_probability is that of the highest grade, expected_grade the sum of all tails. keep: the tail is min_tail or more.
    The model, of at most as many weights as features of its bounded sample, goes to the tasks with the function.

    Defined results: null, empty and blank texts are rated as empty ones; equal texts get equal ratings; repeated rows are
    kept; an empty table gives no rows; other columns are ignored; a model without cuts keeps everything.
    """
    return map_texts(docs.select(docs["doc_id"], docs["text"]), ["doc_id"], _rater(model, min_tail), "expected_grade double, tail_probability double, keep boolean")


def keep_good(docs: DataFrame, model: OrdinalModel, *, min_tail: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that rate_quality would keep."""
    rated, flag = _rater(model, min_tail), "__keep"
    return map_texts(docs, docs.columns, lambda batch: {flag: rated(batch)["keep"]}, f"{flag} boolean").where(flag).drop(flag)
