"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings is trained from confirmed toxic examples
and unlabelled text.
The unlabelled text holds toxic documents too, at the class prior; the risk of calling a text clean
is therefore estimated from the unlabelled text less what the positives would add, and where that
difference turns negative, which no true risk can, the step goes back on it.

The sample has about ``POSITIVES`` toxic and ``UNLABELLED`` other rows at most, drawn by a hash of
the id; the prior is the share of label 1 among the training labels. Held-out rows (crc32 of the id
modulo 5 is 0) never take part. Only buckets that ``MIN_COUNT`` positives share and that are clearly
more frequent among positives (``MIN_EXCESS`` standard errors) can have a weight.

Defined cases: null is the empty text, whose score is that of the bias; labels of ids that don't
occur, null labels and null ids are ignored; repeated rows give equal rows; without positives the
score is the prior (0.5 without labels, less a little); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import map_rows, text_of, words_of
from lorekeep.llm.rule_ensemble import held_out

POSITIVES, UNLABELLED = 2000, 6000
BUCKETS = 1 << 18
MIN_COUNT = 4
MIN_EXCESS = 4.0
BEGINNINGS = (4, 5, 6, 7)
ROUNDS, RATE, RIDGE = 400, 0.05, 1e-4
CACHED_WORDS = 300_000
# stripped from both ends of a word
_EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~0123456789«»“”‘’…–—¿¡"


class Buckets(dict):
    """Buckets of each word and of its beginnings; emptied when full, which changes no result."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        plain = word.strip(_EDGE).lower()
        parts = [plain, *(plain[:k] + "-" for k in BEGINNINGS if len(plain) > k)]
        found = self[word] = tuple(zlib.crc32(part.encode()) % BUCKETS for part in parts)
        return found


class Model(NamedTuple):
    bias: float
    length: float
    weights: np.ndarray


class Features(NamedTuple):
    """Buckets of a text, how many of its distinct words are in each (as a logarithm), its length."""

    buckets: np.ndarray
    values: np.ndarray
    length: float


def features(text: str, buckets: Buckets) -> Features:
    words = words_of(text)
    flat = np.fromiter(chain.from_iterable(map(buckets.__getitem__, set(words))), np.int64)
    found, counts = np.unique(flat, return_counts=True)
    return Features(found, np.log2(1 + counts), float(np.log1p(len(words))))


def margin_of(model: Model, row: Features) -> float:
    return model.bias + model.length * row.length + float(model.weights[row.buckets] @ row.values)


def fit(positives: list[Features], unlabelled: list[Features], prior: float) -> Model:
    weights = np.zeros(BUCKETS)
    start = float(np.log(prior / (1 - prior)))
    if not positives or not unlabelled:
        return Model(start, 0.0, weights)
    n_p, n_u = len(positives), len(unlabelled)
    in_p = np.bincount(np.concatenate([r.buckets for r in positives]), minlength=BUCKETS)
    in_u = np.bincount(np.concatenate([r.buckets for r in unlabelled]), minlength=BUCKETS)
    share = (in_p + in_u) / (n_p + n_u)
    error = np.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u)) + 1e-12
    clear = (in_p / n_p - in_u / n_u) / error >= MIN_EXCESS
    used = np.flatnonzero(clear & (in_p >= min(MIN_COUNT, n_p)))
    place = np.full(BUCKETS, -1)
    place[used] = np.arange(len(used))

    def matrix(rows: list[Features]):
        flat = place[np.concatenate([r.buckets for r in rows])]
        values = np.concatenate([r.values for r in rows])
        owner = np.repeat(np.arange(len(rows)), [len(r.buckets) for r in rows])
        keep = flat >= 0
        return owner[keep], flat[keep], values[keep], np.array([r.length for r in rows])

    p, u = matrix(positives), matrix(unlabelled)
    theta = np.concatenate([np.zeros(len(used) + 1), [start]])
    first, second = np.zeros_like(theta), np.zeros_like(theta)

    def margin(part):
        owner, flat, values, length = part
        return np.bincount(owner, theta[flat] * values, len(length)) + theta[-2] * length + theta[-1]

    def gradient(part, per_row):
        owner, flat, values, length = part
        words = np.bincount(flat, per_row[owner] * values, len(used))
        return np.concatenate([words, [per_row @ length, per_row.sum()]]) / len(length)

    for turn in range(1, ROUNDS + 1):
        at_p, at_u = 1 / (1 + np.exp(-margin(p))), 1 / (1 + np.exp(-margin(u)))
        # logistic losses: -log s for label 1, -log(1 - s) for label 0
        clean_risk = -np.log1p(-at_u + 1e-12).mean() + prior * np.log1p(-at_p + 1e-12).mean()
        clean_step = gradient(u, at_u) - prior * gradient(p, at_p)
        step = prior * gradient(p, at_p - 1) + clean_step if clean_risk >= 0 else -clean_step
        step[:-2] += RIDGE * theta[:-2]
        first, second = 0.9 * first + 0.1 * step, 0.999 * second + 0.001 * step**2
        theta = theta - RATE * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.999**turn)) + 1e-8)
    weights[used] = theta[:-2]
    return Model(float(theta[-1]), float(theta[-2]), weights)


def _feature_rows(docs: DataFrame) -> list[Features]:
    """Features of a bounded number of ids, one row for each, on the driver, in id order."""

    def build():
        buckets = Buckets()

        def step(rows):
            found = [features(t, buckets) for t in rows["text"]]
            return {
                "doc_id": rows["doc_id"], "buckets": [r.buckets.tolist() for r in found],
                "amounts": [r.values.tolist() for r in found], "length": [r.length for r in found],
            }

        return step

    one = docs.groupBy("doc_id").agg(F.min("text").alias("text"))
    rows: pd.DataFrame = map_rows(
        one, "doc_id long, buckets array<int>, amounts array<float>, length double", build
    ).toPandas()
    rows = rows.sort_values("doc_id")
    columns = zip(rows["buckets"], rows["amounts"], rows["length"], strict=True)
    return [Features(np.asarray(b, np.int32), np.asarray(v, np.float32), n) for b, v, n in columns]


def _drawn(rows: DataFrame, most: int) -> DataFrame:
    n = rows.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) / float(2**32)
    return rows.where(share < most / n) if n > most else rows


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED, threshold: float = 0.5,
) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")
    )
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    prior = min(max(ones / n if n else 0.5, 0.001), 0.499)
    usable = slim.where(F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    # at most the sample is broadcast and collected
    chosen = F.broadcast(_drawn(known.where("y = 1").select("doc_id").distinct(), positives))
    toxic = _feature_rows(usable.join(chosen, "doc_id", "left_semi"))
    ids = usable.select("doc_id")
    total = ids.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(2**32)) / float(2**32)
    mixed = _feature_rows(usable.where(share < unlabelled / total) if total > unlabelled else usable)
    model = fit(toxic, mixed, prior)

    def build():
        buckets = Buckets()

        def step(rows):
            margins = np.array([margin_of(model, features(t, buckets)) for t in rows["text"]])
            return {"doc_id": rows["doc_id"], "score": 1 / (1 + np.exp(-np.clip(margins, -500, 500)))}

        return step

    return map_rows(slim, "doc_id long, score double", build).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
