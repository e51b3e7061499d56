"""Language identification in two steps: the family first, then pairwise linear support vector machines inside it."""

from __future__ import annotations

import copy
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as tx
from . import classify

GRAMS, FOLD_CASE = (2, 3), True
#: At most so many documents of each language are learned from.
PER_LANGUAGE = 1000
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
# Closely related languages by ISO 639-1 code. Codes not listed are families of their own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi ur bn pa gu mr ne",
    "uralic": "fi et hu",
    "semitic": "ar he am mt",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], lang)


class Model:
    """Weights of one output per family and one per pair of related languages, and how to read them."""

    def __init__(self, rows: list):
        langs = sorted({y for y, _, _ in rows})
        self.families = sorted({family(x) for x in langs})
        self.members = {f: [x for x in langs if family(x) == f] for f in self.families}
        columns, self.bias = [np.zeros((1 << classify.BITS, 0))], []
        if len(self.families) > 1:
            weights, bias = classify.train_embeddings([(self.families.index(family(y)), i, s) for y, i, s in rows], len(self.families), epochs=6)
            columns.append(weights)
            self.bias += list(bias)
        else:
            columns.append(np.zeros((1 << classify.BITS, len(self.families))))
            self.bias += [0.0] * len(self.families)
        self.pairs = []
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                w, bias = classify.train_svm([(1 if y == a else -1, i, s) for y, i, s in rows if y in (a, b)])
                columns.append(w[:, None])
                self.bias.append(bias)
                self.pairs.append((a, b))
        self.weights = np.concatenate(columns, axis=1)
        if not self.weights.shape[1]:
            self.weights = np.zeros((1 << classify.BITS, 1))

    def read(self, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each row: the family's probability times the winner's mean chance against its relatives."""
        if not self.families:
            return np.full(len(mean), UNKNOWN, object), np.zeros(len(mean))
        values = mean + np.array(self.bias)
        odds = classify.softmax(values[:, : len(self.families)]) if len(mean) else np.zeros((0, len(self.families)))
        chosen = odds.argmax(axis=1)
        lang, score = np.full(len(mean), "", object), np.zeros(len(mean))
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(chosen == k)
            own = self.members[f]
            chance = np.zeros((len(rows), len(own)))
            votes = np.zeros((len(rows), len(own)))
            for p, (a, b) in enumerate(self.pairs):
                if a in own:
                    margin = values[rows, len(self.families) + p]
                    share = 1 / (1 + np.exp(-np.clip(2 * margin, -30, 30)))
                    chance[:, own.index(a)] += share
                    chance[:, own.index(b)] += 1 - share
                    votes[:, own.index(a)] += margin > 0
                    votes[:, own.index(b)] += margin <= 0
            best = (votes + 1e-3 * chance).argmax(axis=1)  # most duels won; of equals the one with the higher chance
            lang[rows] = np.array(own, object)[best]
            score[rows] = odds[rows, k] * (chance[np.arange(len(rows)), best] / (len(own) - 1) if len(own) > 1 else 1)
        return lang, score


def has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter; bytes are looked at in runs of bounded size."""
    data, offsets = tx.flat(column)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    out = np.zeros(len(column), bool)
    for low, high in tx.runs_of_rows(offsets):
        some = low + np.flatnonzero(np.diff(offsets[low : high + 1]))
        if some.size:
            out[some] = np.logical_or.reduceat(ascii_letter[data[offsets[low] : offsets[high]]], offsets[some] - offsets[low])
    for k in np.flatnonzero(~out):
        out[k] = any(c.isalpha() for c in column[int(k)].as_py() or "")
    return out


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = FOLDS, held_out: int = HELD_OUT, per_language: int = PER_LANGUAGE) -> Model:
    """Learns from text and lang of at most per_language documents of each language outside the held-out fold, with any letter."""
    known = docs.where((classify.fold_of(key, folds) != held_out) & F.col(text).rlike(r"\p{L}") & (F.col(lang) != UNKNOWN))
    known = known.select(F.col(key).alias("k"), F.col(lang).cast("string").alias("y"), F.col(text).alias("t"))
    return classify.trained(known, "k", "t", classify.sample(known, "k", "y", per_language), "y", GRAMS, FOLD_CASE, Model, own=True)


def identify(docs: DataFrame, model: Model, text: str = "text", keep: bool = False) -> DataFrame:
    """docs, without the text unless keep is set, with lang_pred and score (0 to 1); `und` and 0 where the text is null or has no letter, or nothing was learned.

    Of equally likely families or languages the first by name wins; texts of any length are read whole, in slices.
    """
    light = copy.copy(model)  # the table is broadcast, not sent with each task
    light.weights = None

    def finish(column, mean):
        lang, score = light.read(mean)
        known = has_letter(column)
        return [pa.array(np.where(known, lang, UNKNOWN), pa.string()), pa.array(np.where(known, score, 0.0), pa.float64())]

    out = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return classify.scored(docs, text, finish, out, model.weights, GRAMS, FOLD_CASE, keep)


def languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the text, with held_out (not learned from; true for a null key), lang_pred and score.

    Repeated rows each get their result; columns of docs that clash with an added one are dropped; no rows give no rows.
    """
    model = fit(docs, key, text, lang)
    return identify(docs, model, text).withColumn("held_out", F.coalesce(classify.fold_of(key, FOLDS) == HELD_OUT, F.lit(True)))
