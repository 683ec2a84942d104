"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct character n-grams of its lower-cased form, runs of white space
taken as one blank, hashed to ``2**BITS`` places. Fitting counts each place in the texts of either
label, takes ``r = log((p + a) / |p|) - log((q + a) / |q|)`` and fits logistic weights on features of
value r. Both parts are multiplied into one weight a place, so a score is a sum over a text's
places. The model has a fixed size and is broadcast; scoring is a map.

Fitting takes at most ``max_rows`` labelled rows (a documented bound), the first by a hash of their id,
so the fit runs on the driver in bounded memory whatever the corpus holds.

Edge cases: null and empty text have no features and score the intercept; repeated rows score alike;
without labels of both kinds the model is the label's rate (0.5 without any); a score of exactly the bound is
toxic; very long texts are read in passes; an empty table gives an empty result; of extra columns only one with
the name of the score clashes: ``score`` replaces it, ``drop_toxic`` keeps it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, own, release, spare, texts
from .token_files import text_slices

BITS, SIZES = 18, (3, 4, 5)

#: Most labelled rows that a model is fitted on.
MAX_ROWS = 6000

#: Most characters of a pass of array operations over one text.
PASS_CHARS = 1 << 20


def places(text: str, bits: int = BITS, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """Sorted distinct places of a text's n-grams."""
    seen = np.zeros(1 << bits, bool)
    _mark(text, seen, bits, sizes)
    return np.flatnonzero(seen)


def _mark(text: str, seen: np.ndarray, bits: int, sizes: tuple[int, ...]) -> None:
    longest = max(sizes)
    for at in range(0, max(1, len(text)), PASS_CHARS):
        part = text[at : at + PASS_CHARS + longest - 1].lower().replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if not at:
            part = " " + part
        if at + PASS_CHARS >= len(text):
            part += " "
        x = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if not len(text):
            return
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
        x = (x[keep] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        h = x
        for n in range(2, longest + 1):
            if len(h) < 2:
                break
            h = h[:-1] * np.uint64(0xD1342543DE82EF95) + x[n - 1 :]
            if n in sizes:
                seen[(h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)] = True


@dataclass
class Model:
    weights: np.ndarray
    intercept: float
    bits: int = BITS
    sizes: tuple[int, ...] = SIZES

    def score(self, words: list[str]) -> np.ndarray:
        out = np.full(len(words), self.intercept)
        seen = np.zeros(1 << self.bits, bool)
        for i, w in enumerate(words):
            if w:
                _mark(w, seen, self.bits, self.sizes)
                found = np.flatnonzero(seen)
                out[i] += self.weights[found].sum(dtype=np.float64)
                seen[found] = False
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit(words: list[str], labels: np.ndarray, bits: int = BITS, sizes: tuple[int, ...] = SIZES, alpha: float = 1.0, ridge: float = 1.0, doubt: float = 3.0, steps: int = 300) -> Model:
    """Fits a model. Places get weights if their ratio is beyond ``doubt`` of its standard errors, however many those are."""
    labels = np.asarray(labels, np.float64)
    size, n = 1 << bits, len(words)
    rate = (labels.sum() + 0.5) / (n + 1)
    prior = float(np.log(rate / (1 - rate)))
    if not 0 < labels.sum() < n:
        return Model(np.zeros(size, np.float32), prior, bits, sizes)
    rows = [places(w, bits, sizes).astype(np.int32) for w in words]
    positive, negative = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for row, label in zip(rows, labels, strict=True):
        (positive if label > 0 else negative)[row] += 1  # a text's places are distinct
    p, q = (positive + alpha) / (labels.sum() + 2 * alpha), (negative + alpha) / (n - labels.sum() + 2 * alpha)
    ratio = np.log(p) - np.log(q)
    chosen = np.flatnonzero(np.abs(ratio) > doubt * np.sqrt(1 / (positive + alpha) + 1 / (negative + alpha)))
    index = np.full(size, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    for i, row in enumerate(rows):  # only the chosen places stay in memory
        own = index[row]
        rows[i] = own[own >= 0]
    ids = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    cols = np.concatenate(rows)
    value = ratio[chosen][cols]
    w, b = np.zeros(len(chosen)), prior
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.bincount(ids, value * w[cols], minlength=n) + b
        gap = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels
        grad = np.bincount(cols, value * gap[ids], minlength=len(w)) / n + ridge * w / n
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * gap.mean(), 0.999 * vb + 0.001 * gap.mean() ** 2
        w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        b -= 0.02 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[chosen] = w * ratio[chosen]
    return Model(weights, float(b), bits, sizes)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **options) -> Model:
    """A model from ``labels(doc_id, toxic)`` outside the held-out fold; only so many rows reach the driver.

    A document that is labelled more than once is toxic if any label says so; one with several texts gives its least.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    told = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    picked = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = texts(docs).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = rows.toArrow().sort_by("doc_id")
    model = fit(got.column("text").to_pylist(), got.column("toxic").to_numpy(), **options)
    del got
    release()  # a pipeline's driver lives on: some 100 MB
    return model


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a double column ``into``; a column of that name is replaced. Only the texts go to Python."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one megabyte

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        found = [shared.value.score(words) for words in text_slices(column)]
        release()
        return pa.array(np.concatenate(found) if found else [], pa.float64())

    return docs.withColumn(into, scored(F.coalesce(F.col(text), F.lit(""))))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", most: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``most`` or more; all its columns are kept, whatever their names."""
    at = spare(docs, "toxicity")
    return score(docs, model, text, at).where(F.col(at) < most).select(*own(docs))
