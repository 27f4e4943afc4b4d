"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; other documents are unlabelled text, whatever their label. Linear classifiers
over hashed features (the words of a document and the beginnings of its longer words) minimise the class-prior-corrected
risk of Kiryo et al. (2017), in which the negative part is never let below zero. The class prior is the share of toxic rows
among the usable labels. One classifier is trained per fold, in parallel, on the rows outside it; the scores of the rows
that each classifier has not seen calibrate the mean of all classifiers under the same corrected risk.

Training uses a bounded sample: at most ``positives`` toxic and ``unlabelled`` other documents, those with the smallest
hashes of their ids (``Limits``). Class prior and scores cover all rows. Labels are learnt only from rows whose
``crc32(id as text) mod 3`` is not 1; labels, languages, sources and ids are no inputs of a score.

Null or empty text: no features, its score is that of the intercept. Null or missing labels are ignored; a document with
several labels is toxic if one says so. Without any toxic label every score is 0; with toxic
labels only for documents that aren't there, every score is the class prior. Repeated rows get equal scores. Empty
table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swathline.llm.common import as_bytes, map_batches, unused_names
from swathline.llm.decontaminate import words
from swathline.session import cut_lineage

THRESHOLD = 0.7
FEATURE_BITS = 20
PREFIXES = (4, 5, 6)
KNOWN_WORDS = 120_000


@dataclass(frozen=True)
class Limits:
    """Bounds of the training sample, folds, and the parameters of the learner."""

    positives: int = 4000
    unlabelled: int = 8000
    folds: int = 3
    epochs: int = 20
    batch: int = 256
    rate: float = 0.1
    sparsity: float = 1e-3
    least_count: int = 5
    least_lift: float = 2.0


@dataclass(frozen=True)
class Model:
    weights: dict[int, float]
    bias: float


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1


def word_features(word: bytes) -> set[int]:
    mask = (1 << FEATURE_BITS) - 1
    return {zlib.crc32(word) & mask} | {zlib.crc32(b"^" + word[:k]) & mask for k in PREFIXES if len(word) > k}


def features(text: bytes | None) -> np.ndarray:
    found = set().union(*map(word_features, set(words(text))))
    return np.sort(np.fromiter(found, np.int32, len(found)))


class _Rows:
    """Sparse rows: the features of row i are ``index[start[i]:start[i + 1]]``; each row begins with the intercept, 0."""

    def __init__(self, rows: list[np.ndarray]):
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
        self.index = np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.index], self.start[:-1]) if len(self.start) > 1 else np.empty(0)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def train(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, limits: Limits, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights); the first weight is the intercept, alone if there are no positives or nothing unlabelled."""
    if not positive or not unlabelled:
        return np.array([-1]), np.array([np.log(prior / (1 - prior))])
    size = 1 << FEATURE_BITS
    in_p, in_u = (np.bincount(np.concatenate(rows), minlength=size) for rows in (positive, unlabelled))
    share_p, share_u = in_p / len(positive), in_u / len(unlabelled)
    share_n = np.maximum(share_u - prior * share_p, 0) / (1 - prior)
    useful = (in_p >= limits.least_count) & (share_p >= limits.least_lift * (share_n + 1 / len(unlabelled)))
    chosen = np.flatnonzero(useful)
    place = np.zeros(size, np.int64)
    place[chosen] = np.arange(1, len(chosen) + 1)

    def compact(rows):
        return [np.concatenate([[0], place[r[useful[r]]]]) for r in rows]

    positive, unlabelled = compact(positive), compact(unlabelled)
    rng = np.random.default_rng(seed)
    weights = np.zeros(len(chosen) + 1)
    weights[0] = np.log(prior / (1 - prior))
    seen = np.full(len(weights), 1e-8)
    steps = max(1, len(unlabelled) // limits.batch)
    for _ in range(limits.epochs):
        order_p, order_u = rng.permutation(len(positive)), rng.permutation(len(unlabelled))
        for i in range(steps):
            p = _Rows([positive[j] for j in order_p[i % len(positive) :: steps]])
            u = _Rows([unlabelled[j] for j in order_u[i::steps]])
            score_p, score_u = p.scores(weights), u.scores(weights)
            of_negatives = np.logaddexp(0, score_u).mean() - prior * np.logaddexp(0, score_p).mean()
            if of_negatives >= 0:
                slope_p = -prior * np.ones(len(score_p)) / len(score_p)
                slope_u = _sigmoid(score_u) / len(score_u)
            else:  # below zero the classifier overfits: step back on the negative part alone
                slope_p = prior * _sigmoid(score_p) / len(score_p)
                slope_u = -_sigmoid(score_u) / len(score_u)
            gradient = np.bincount(p.index, np.repeat(slope_p, np.diff(p.start)), len(weights))
            gradient += np.bincount(u.index, np.repeat(slope_u, np.diff(u.start)), len(weights))
            seen += gradient * gradient
            rate = limits.rate / np.sqrt(seen)
            stepped = weights - rate * gradient * (gradient != 0)
            shrunk = np.sign(stepped) * np.maximum(np.abs(stepped) - np.where(gradient != 0, rate * limits.sparsity, 0), 0)
            weights = np.concatenate([stepped[:1], shrunk[1:]])
    return np.concatenate([[-1], chosen]), weights


def calibrate(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift that minimise the corrected logistic risk, by damped Newton steps."""
    theta = np.array([1.0, 0.0])
    x = np.stack([unlabelled, np.ones(len(unlabelled))], axis=1)
    wanted = prior * np.array([positive.mean(), 1.0])

    def risk(t):
        return np.logaddexp(0, x @ t).mean() - wanted @ t + 1e-4 * (t[0] - 1) ** 2

    for _ in range(100):
        share = _sigmoid(x @ theta)
        gradient = x.T @ share / len(x) - wanted + np.array([2e-4 * (theta[0] - 1), 0])
        curve = (x * (share * (1 - share))[:, None]).T @ x / len(x) + np.diag([2e-4, 1e-9])
        step, scale = np.linalg.solve(curve, gradient), 1.0
        while scale > 1e-6 and risk(theta - scale * step) > risk(theta):
            scale /= 2
        theta = theta - scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    spark = docs.sparkSession
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("doc"))
        .agg(F.max("toxic").alias("toxic"))
    )
    row = known.agg(F.avg("toxic").alias("prior")).first()
    if not row.prior:
        return Model({}, -np.inf)
    prior = min(float(row.prior), 0.99)
    order = F.xxhash64("doc")
    positive = known.filter("toxic = 1").select("doc", F.lit(1).alias("role")).orderBy(order, "doc").limit(limits.positives)
    usable = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("doc"))
    others = usable.select("doc", F.lit(0).alias("role")).orderBy(order, "doc").limit(limits.unlabelled)
    sample = cut_lineage(positive.unionByName(others))  # ids alone, at most as many as the limits allow
    texts = docs.select(F.col(id_col).alias("doc"), as_bytes(text_col).alias("text")).join(F.broadcast(sample), "doc")

    def extract():
        def work(batch: pa.RecordBatch) -> dict:
            rows = [features(t.as_py()) for t in batch.column("text")]
            return {"role": batch.column("role"), "fold": batch.column("fold"), "features": rows}

        return work

    fold = F.pmod(F.xxhash64("doc", F.lit("fold")), F.lit(limits.folds)).cast("int")
    rows = cut_lineage(
        map_batches(
            texts.select("text", "role", fold.alias("fold")), "role int, fold int, features array<int>", extract
        )
    )

    def learn(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        member = key[0].as_py()
        role, own = table.column("role").to_numpy(), table.column("fold").to_numpy() == member
        lists = table.column("features").combine_chunks()
        start, index = lists.offsets.to_numpy(), lists.values.to_numpy()
        every = [index[start[i] : start[i + 1]] for i in range(len(lists))]
        order = sorted(range(len(every)), key=lambda i: (role[i], zlib.crc32(every[i].tobytes())))
        pick = lambda r, f: [every[i] for i in order if role[i] == r and own[i] == f]
        p, u = pick(1, False) or pick(1, True), pick(0, False) or pick(0, True)
        chosen, weights = train(p, u, prior, limits, member)
        dense = np.zeros(1 << FEATURE_BITS)
        dense[chosen[1:]] = weights[1:]
        unseen = [[weights[0] + dense[r].sum() for r in pick(k, True)] for k in (1, 0)]
        kept = np.flatnonzero(weights)
        return pa.table(
            {
                "features": pa.array([chosen[kept].tolist()], pa.list_(pa.int32())),
                "weights": pa.array([weights[kept].tolist()], pa.list_(pa.float64())),
                "positive": pa.array([unseen[0]], pa.list_(pa.float64())),
                "unlabelled": pa.array([unseen[1]], pa.list_(pa.float64())),
            }
        )

    members = (
        rows.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(limits.folds - 1))))
        .groupBy("member")
        .applyInArrow(learn, "features array<int>, weights array<double>, positive array<double>, unlabelled array<double>")
        .collect()  # sparse weights, and one score for each row of the bounded sample
    )
    mean: dict[int, float] = {}
    for m in members:
        for f, w in zip(m.features, m.weights):
            mean[f] = mean.get(f, 0.0) + w / len(members)
    positive_scores = np.array([s for m in members for s in m.positive])
    other_scores = np.array([s for m in members for s in m.unlabelled])
    slope, shift = 1.0, 0.0
    if len(positive_scores) and len(other_scores):
        slope, shift = calibrate(positive_scores, other_scores, prior)
    bias = slope * mean.pop(-1, 0.0) + shift
    return Model({f: slope * w for f, w in mean.items()}, bias)


def _scores(docs: DataFrame, model: Model, text_col: str) -> Column:
    """The score of each row's text. Only the text goes to the Python task, and only the score comes back."""
    handle = docs.sparkSession.sparkContext.broadcast(model)  # weights of the bounded sample's features

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, bias = handle.value.weights, handle.value.bias
        known: dict[bytes, tuple] = {}

        def active(word: bytes) -> tuple:
            if len(known) >= KNOWN_WORDS:
                known.clear()
            known[word] = found = tuple(f for f in word_features(word) if f in weights)
            return found

        def total(text: bytes | None) -> float:
            hit: set[int] = set()
            for word in set(words(text)):
                found = known.get(word)
                if found is None:
                    found = active(word)
                if found:
                    hit.update(found)
            return bias + sum(weights[f] for f in sorted(hit))

        for texts in batches:
            yield pa.array(_sigmoid(np.array([total(t.as_py()) for t in texts], np.float64)))

    return F.arrow_udf(scored, "double")(as_bytes(text_col))


def score(
    docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """(id, held_out, score, predicted), one row per document; ``keep``: columns to carry instead of the id alone."""
    (own,) = unused_names(docs, "score")
    scored = docs.withColumn(own, _scores(docs, model, text_col))
    return scored.select(
        *(keep or [id_col]),
        F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"),
        F.col(own).alias("score"),
        (F.col(own) >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents with a score below the threshold, their columns unchanged whatever their names."""
    return docs.filter(_scores(docs, model, text_col) < threshold)
