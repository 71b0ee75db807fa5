"""Toxicity by non-negative positive-unlabelled learning.

A linear model over words and word beginnings is fitted to confirmed toxic texts and to unlabelled texts, with the
risk of Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator" (2017): the loss of the unlabelled
texts as negatives, less what the class prior says the toxic ones among them contribute, never below zero.  Texts for
the fit are a bounded sample by hash; scoring reads every whole text.
"""

from __future__ import annotations

import math
import string
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import kept, materialise, texts

#: Bounds of the sample that the classifier is fitted to.
MAX_POSITIVE, MAX_UNLABELLED = 10_000, 20_000
#: The commonest features of the positive sample that are counted among the unlabelled as well.
MAX_CANDIDATES = 100_000
#: Features kept, each in at least MIN_TEXTS positive texts and MIN_RATIO times as common there as among the unlabelled.
MAX_FEATURES, MIN_TEXTS, MIN_RATIO = 4_000, 4, 2.0
#: Lengths of word beginnings that are features besides whole words.
BEGINNINGS = (5, 6, 7, 8)
THRESHOLD = 0.7
STEPS, RATE, DECAY = 400, 0.1, 1e-4
REMEMBERED = 200_000
PUNCTUATION = string.punctuation + "¡¿«»“”‘’…"


def features(word: str) -> list[str]:
    """The word itself, marked at its end, and its beginnings."""
    return [word + "$", *(word[:n] for n in BEGINNINGS if len(word) > n)]


def words(text: str) -> set[str]:
    """Distinct lower-cased words of a whole text, without punctuation around them."""
    found = {w.strip(PUNCTUATION) for w in set(text.lower().split())}
    found.discard("")
    return found


@dataclass(frozen=True)
class Model:
    """Weights of the features, the intercept, and the weight of the logarithm of the number of distinct words."""

    weights: dict[str, float]
    bias: float
    length: float
    prior: float

    def scorer(self):
        """A function from texts to scores that remembers the features of words."""
        known: dict[str, tuple[str, ...]] = {}
        weights = self.weights

        def score(text: str) -> float:
            active: set[str] = set()
            own = words(text)
            for w in own:
                found = known.get(w)
                if found is None:
                    found = tuple(f for f in features(w) if f in weights)
                    if len(w) <= 64:
                        known[w] = found
                if found:
                    active.update(found)
            if len(known) > REMEMBERED:
                known.clear()
            return _sigmoid(self.bias + self.length * _log_size(len(own)) + sum(weights[f] for f in sorted(active)))

        return score


def _log_size(n: int) -> float:
    return float(np.log1p(n) / 5 - 1)


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -500, 500))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never used; a null doc_id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _counts(candidates: frozenset[str] | None):
    """Texts in which each feature (of ``candidates``, or any) occurs, added up within a partition."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def emptied() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["f", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in texts(batch.column(0)):
                own = {f for w in words(text) for f in features(w)}
                seen.update(own if candidates is None else own & candidates)
                if len(seen) > 500_000:
                    yield emptied()
        yield emptied()

    return counts


def _active(index: dict[str, int]):
    def active(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, found = [], []
            for text in texts(batch.column(1)):
                own = words(text)
                sizes.append(len(own))
                found.append(sorted({index[f] for w in own for f in features(w) if f in index}))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["positive", "n", "active"])

    return active


def fit_nnpu(
    rows: np.ndarray, columns: np.ndarray, sizes: np.ndarray, positive: np.ndarray, prior: float, width: int
) -> tuple[np.ndarray, float, float]:
    """Weights, intercept and length weight that minimise the non-negative risk.

    (rows, columns) are the set features of the texts, ``sizes`` a further input of each, ``positive`` marks the
    confirmed positives, all others are unlabelled.
    """
    n, n_pos = len(positive), max(int(positive.sum()), 1)
    n_un = max(n - int(positive.sum()), 1)
    theta, mean, square = np.zeros(width + 2), np.zeros(width + 2), np.zeros(width + 2)
    if prior <= 0:  # no confirmed positives at all
        theta[-2] = -4.0
        return theta[:width], -4.0, 0.0
    theta[-2] = np.log(prior / (1 - prior)) if prior < 1 else 4.0
    for step in range(1, STEPS + 1):
        g = np.bincount(rows, theta[columns], minlength=n) + theta[-2] + theta[-1] * sizes
        p = 1 / (1 + np.exp(-np.clip(g, -30, 30)))  # d log(1 + e^g) / dg
        as_negative = np.logaddexp(0, g)
        rest = as_negative[~positive].sum() / n_un - prior * as_negative[positive].sum() / n_pos
        of_rest = np.where(positive, -prior * p / n_pos, p / n_un)
        slope = np.where(positive, prior * (p - 1) / n_pos, 0.0) + of_rest if rest >= 0 else -of_rest
        grad = np.r_[np.bincount(columns, slope[rows], minlength=width), slope.sum(), slope @ sizes] + DECAY * theta * np.r_[np.ones(width), 0, 0]
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        theta -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
    return theta[:width], float(theta[-2]), float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, prior: float | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit a model to rows of ``docs`` that are not held out: confirmed toxic ones and a sample of the rest.

    Only ``labels.toxic = 1`` marks a text; all others count as unlabelled.  The class prior is ``prior`` or the share
    of toxic rows among all labelled ones that are not held out.  Contradictory or repeated labels of a document count
    as toxic if one of them is.  Without a toxic text every score is low.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.max("toxic") == 1).alias("positive"))
    total = known.agg(F.count("*").alias("n"), F.count_if("positive").alias("k")).first()
    prior = (total.k / total.n if total.n else 0.0) if prior is None else prior
    confirmed = known.where("positive").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)
    ids = docs.where(~held_out(F.col("doc_id"))).select("doc_id").distinct()
    others = ids.orderBy(F.xxhash64("doc_id", F.lit("unlabelled")), "doc_id").limit(max_unlabelled)
    sample = confirmed.withColumn("positive", F.lit(True)).union(others.withColumn("positive", F.lit(False)))
    # At most max_positive + max_unlabelled rows of 9 bytes, whatever the input.  Of rows repeated under one doc_id one
    # stands for all, so that the sample is bounded by rows as well.
    some = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "positive").agg(F.min("text").alias("text")).select("positive", "text")
    some = materialise(some, "toxic-sample", compression="zstd")

    def counted(positive: bool, candidates: frozenset[str] | None = None) -> DataFrame:
        rows = some.where(F.col("positive") == positive).select("text")
        return rows.mapInArrow(_counts(candidates), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))

    size = {r.positive: r.n for r in some.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    n_pos, n_un = size.get(True, 0), size.get(False, 0)
    often = counted(True).where(F.col("n") >= MIN_TEXTS).orderBy(F.desc("n"), "f").limit(MAX_CANDIDATES).collect()
    common = {r.f: r.n for r in often}
    among = {r.f: r.n for r in counted(False, frozenset(common)).collect()} if common else {}
    lift = {f: (p + 0.5) / (n_pos + 1) * (n_un + 1) / (among.get(f, 0) + 0.5) for f, p in common.items()}
    ranked = sorted((-p * math.log(lift[f]), f) for f, p in common.items() if lift[f] >= MIN_RATIO)
    index = {f: i for i, (_, f) in enumerate(ranked[:MAX_FEATURES])}
    if not index or not n_un:
        return Model({}, -4.0, 0.0, prior)
    held = some.mapInArrow(_active(index), "positive boolean, n long, active array<long>").collect()
    held.sort(key=lambda r: (r.positive, r.n, r.active))
    row = np.repeat(np.arange(len(held)), [len(r.active) for r in held])
    column = np.fromiter((f for r in held for f in r.active), np.int64)
    sizes = np.array([_log_size(r.n) for r in held])
    weights, bias, length = fit_nnpu(row, column, sizes, np.array([r.positive for r in held]), prior, len(index))
    return Model({f: float(weights[i]) for f, i in index.items()}, bias, length, prior)


def score_column(model: Model, text: Column) -> Column:
    """Score between 0 and 1 of each whole text; a null text scores as an empty one."""

    key = ("toxicity", uuid.uuid4().hex)

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = kept(key, model.scorer)
        for batch in batches:
            yield pa.array([score(t) for t in texts(batch)], pa.float64())

    scores.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(scores, "double")(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; only doc_id and text of it are used.

    Empty and null texts are scored like others, by what remains of the model without words.  Repeated rows are all
    returned; a null doc_id counts as held out.  An empty table gives an empty one.
    """
    scored = docs.select("doc_id", score_column(train(docs, labels, **options), F.col("text")).alias("score"))
    predicted = (F.col("score") >= threshold).cast("int").alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``docs``, with all its columns, less the rows that score ``threshold`` or more."""
    return docs.where(score_column(train(docs, labels, **options), F.col("text")) < threshold)
