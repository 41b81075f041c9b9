"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic rows are taken as labels; a bounded hash sample of labelled rows, whatever their label, is the
unlabelled text. A linear
numpy classifier over hashed words and word beginnings minimises the class-prior-corrected risk, whose
negative part is kept from falling below zero. Scoring is one pass over all whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import BYTE_BASE_2, LOWER, chunks, ranges

DIMS = 1 << 18
PREFIXES = (4, 5, 6)
#: Bounds of the learning sample, in rows.
MOST_POSITIVE, MOST_UNLABELLED = 3000, 6000
THRESHOLD = 0.3
#: A feature counts if it is this much more frequent among positives, or half way to what their share of the unlabelled
#: rows allows, by so many deviations of a chance count.
LEAST_LIFT, LEAST_DEVIATIONS = 3.0, 5.0

# letters, digits and bytes above ASCII make words; all else parts them
FOLD = LOWER.copy()
FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 32


def features(column: pa.Array):
    """Sorted distinct feature numbers of each text: hashed words and their beginnings."""
    for w in chunks(pc.utf8_lower(column), FOLD):
        wide = w.data.astype(np.uint64) + np.uint64(1)
        parts = [w.h] + [ranges(wide, w.starts, np.minimum(w.starts + n, w.ends), BYTE_BASE_2) for n in PREFIXES]
        ids = np.stack([(h >> np.uint64(64 - 18)).astype(np.int32) for h in parts], 1)
        for i in range(len(w.bounds) - 1):
            yield np.unique(ids[w.bounds[i] : w.bounds[i + 1]])


def _feature_rows(batches):
    for batch in batches:
        rows = list(features(batch.column(0)))
        offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32)))], names=["f"])


def risks(f: np.ndarray, share_p: np.ndarray, share_u: np.ndarray, prior: float) -> tuple[float, float]:
    """The positives' part of the risk of scores f, and the negatives' part, estimated from unlabelled less positive rows."""
    as_negative = np.logaddexp(0, f)
    return float(prior * (share_p @ np.logaddexp(0, -f))), float(share_u @ as_negative - prior * (share_p @ as_negative))


def slope(f: np.ndarray, share_p: np.ndarray, share_u: np.ndarray, prior: float) -> np.ndarray:
    """The gradient by f of the risk; where the negatives' part is below zero, the way back up from there."""
    s = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
    if risks(f, share_p, share_u, prior)[1] >= 0:
        return prior * share_p * (s - 1) + (share_u - prior * share_p) * s
    return (prior * share_p - share_u) * s


def nn_pu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights (a float for each feature) and bias that minimise the non-negative risk under the logistic loss."""
    weights = np.zeros(DIMS, np.float32)
    if not positive or not unlabelled:
        return weights, -20.0
    has_p, has_u = (np.bincount(np.concatenate(x), minlength=DIMS) for x in (positive, unlabelled))
    by_chance = len(positive) * (has_u + 1) / (len(unlabelled) + 1)
    chosen = np.flatnonzero((has_p >= min(LEAST_LIFT, (1 + 1 / prior) / 2) * by_chance) & (has_p - by_chance >= LEAST_DEVIATIONS * np.sqrt(by_chance + 1)))
    place = np.full(DIMS, -1)
    place[chosen] = np.arange(len(chosen))
    rows = [x[x >= 0] for x in (place[r] for r in [*positive, *unlabelled])]
    row, col = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, int)]).astype(int)
    p, n = len(positive), len(rows)
    theta, m, v = np.zeros(len(chosen) + 1), 0.0, 0.0
    theta[-1] = -1.0
    share_p, share_u = np.zeros(n), np.zeros(n)
    share_p[:p], share_u[p:] = 1 / p, 1 / (n - p)
    for step in range(1, steps + 1):
        g = slope(np.bincount(row, theta[col], n) + theta[-1], share_p, share_u, prior)
        grad = np.append(np.bincount(col, g[row], len(chosen)), g.sum()) + decay * np.append(theta[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    weights[chosen] = theta[:-1]
    return weights, _to_prior(np.bincount(row, theta[:-1][col], n)[p:], prior)


def _to_prior(f: np.ndarray, prior: float) -> float:
    """The bias at which the mean score of unlabelled rows is the class prior."""
    low, high = -30.0, 30.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (1 / (1 + np.exp(-np.clip(f + middle, -40, 40)))).mean() < prior else (low, middle)
    return low


def in_fold(doc_id, folds: int = 4, fold: int = 2):
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, learn_from=None) -> tuple[np.ndarray, float]:
    """Fit on docs (doc_id, text) and labels (doc_id, toxic) of rows where learn_from(doc_id) holds.

    Null labels count as none, repeated labels of a doc_id by their largest. Without a positive row every
    score is about 0.
    """
    learn_from = learn_from or (lambda c: ~in_fold(c))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn_from(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    if not n_toxic:
        return nn_pu([], [], 0.0)
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    positive = known.filter("toxic = 1").select("doc_id").orderBy(*by_hash).limit(MOST_POSITIVE)
    rest = known.select("doc_id").orderBy(*by_hash).limit(MOST_UNLABELLED)  # their labels aren't looked at

    def rows(ids: DataFrame) -> list[np.ndarray]:
        # at most MOST_* ids: broadcast by that bound
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids.distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text")).select("text")  # a row a doc_id
        table = found.mapInArrow(_feature_rows, "f array<int>").toArrow()
        return [np.asarray(x.values) for x in table["f"]]

    return nn_pu(rows(positive), rows(rest), n_toxic / n)


def score(docs: DataFrame, model: tuple[np.ndarray, float], carry: list[str] | None = None) -> DataFrame:
    """doc_id, score (0 to 1) and the columns of carry for each row of docs; a null text scores as an empty one."""
    from pyspark.sql.pandas.types import to_arrow_schema

    carry = carry or []
    weights, bias = docs.sparkSession.sparkContext.broadcast(model[0]), model[1]
    source = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *([F.struct(*carry).alias("carried")] if carry else []))
    shape = source.select(*source.columns[1:], F.lit(None).cast("double").alias("score")).schema
    arrow = to_arrow_schema(shape)

    def run(batches):
        w = weights.value
        for batch in batches:
            f = np.array([w[ids].sum() + bias for ids in features(batch.column(0))], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(1 / (1 + np.exp(-np.clip(f, -40, 40))), pa.float64())], schema=arrow)

    out = source.mapInArrow(run, shape)
    return out.select("doc_id", "score", *(["carried.*"] if carry else []))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) for each row of docs; a null doc_id is never held out."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
