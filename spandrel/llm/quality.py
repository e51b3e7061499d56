"""Quality classifier: supervised subword embeddings (see classify.py) over labelled documents."""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import classify
from ._common import kept

GRAMS, FOLD_CASE = (3, 4), False
#: At most so many labelled documents of each label are learned from.
PER_LABEL = 2000
THRESHOLD, FOLDS = 0.3, 5


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = FOLDS, per_label: int = PER_LABEL) -> tuple[np.ndarray, float]:
    """Weights per feature and bias of the odds that the label is 1.

    Learns from rows of labels outside fold 0 (crc32 of the key as text, modulo folds) with label 0 or 1, at most per_label each; a key with both labels counts as
    both. Scores are calibrated on rows that a model of the other half of the sample judges, at the shares that both labels have in all these rows, so that a score means the same
    whatever the sample takes of each.
    Without rows of both labels every text gets the same score: the share of ones, or one half without any.
    """
    known = labels.where(F.col(label).isin(0, 1) & (classify.fold_of(key, folds) != 0)).select(key, F.col(label).cast("int").alias("y"))
    # only labels of documents that are here; keys alone are compared
    known = kept(known.distinct().join(docs.select(key), key, "left_semi"))
    every = {r.y: r.n for r in known.where(F.col(key).isNotNull()).groupBy("y").agg(F.count("*").alias("n")).collect()}
    return classify.trained(docs, key, text, classify.sample(known, key, "y", per_label), "y", GRAMS, FOLD_CASE, partial(_learned, every))


def _learned(every: dict[int, int], rows: list) -> tuple[np.ndarray, float]:
    """Weights and bias from the sample's (label, features, shares); every: how many labelled documents there are of each label."""
    taken = Counter(y for y, _, _ in rows)
    classes = set(taken)
    if len(classes) < 2:
        return np.zeros((1 << classify.BITS, 1)), {frozenset(): 0.0, frozenset([0]): -3.0, frozenset([1]): 3.0}[frozenset(classes)]
    # margins of each half by a model of the other; a half without both labels leaves the model as it is
    halves, margins = (rows[::2], rows[1::2]), []
    if all(len({y for y, _, _ in h}) == 2 for h in halves):
        for learned, judged in (halves, halves[::-1]):
            weights, bias = _odds(*classify.train_embeddings(learned, 2))
            margins += [(float(shares @ weights[ids, 0]) + bias, y) for y, ids, shares in judged]
        slope, shift = classify.calibrated(*map(np.array, zip(*margins, strict=True)), every[1] / (every[0] + every[1]))
    else:
        # learned are odds for labels as common as in the sample
        slope, shift = 1.0, np.log(every[1] / every[0]) - np.log(taken[1] / taken[0])
    weights, bias = _odds(*classify.train_embeddings(rows, 2))
    return slope * weights, float(slope * bias + shift)


def _odds(weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, float]:
    return (weights[:, 1] - weights[:, 0])[:, None], float(bias[1] - bias[0])


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text", keep: bool = False) -> DataFrame:
    """docs, without the text unless keep is set, with score: 0 to 1, higher where label 1 is likelier. Null and empty texts have no features: their score is that of the bias."""
    weights, bias = model

    def finish(_, mean):
        return [pa.array(1 / (1 + np.exp(-np.clip(mean[:, 0] + bias, -30, 30))), pa.float64())]

    return classify.scored(docs, text, finish, [T.StructField("score", T.DoubleType())], weights, GRAMS, FOLD_CASE, keep)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the text, with held_out (fold 0, not learned from; true for a null key), score and predicted (1 if score >= threshold).

    Repeated rows each get their score, equal texts the same one; texts of any length are scored whole, in slices; columns of docs that clash with an added one are dropped; no
    rows give no rows.
    """
    model = fit(docs, labels, key, text, folds=folds)
    return score(docs, model, text).withColumns(
        {"held_out": F.coalesce(classify.fold_of(key, folds) == 0, F.lit(True)), "predicted": (F.col("score") >= threshold).cast("int")}
    )
