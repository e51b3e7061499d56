"""Scoring of whole texts by weights over hashed subword features, and bounded training samples.

A document is the average of its features: words and character n-grams, hashed into halves of one table. Any linear read-out of an average of
vectors is the average of a read-out per feature, so that trained models come down to one small table ``weights[feature, output]``, and a document's outputs are
the means of its features' rows plus a bias. The table's size is fixed by ``BITS``.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as tx
from ._common import spare

BITS = 17
LABELS = 10_000


def means(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, grams: tuple[int, ...], fold: bool) -> np.ndarray:
    """Mean of the features' weights for each text (rows) and output (columns; rows of weights); 0 where there is no feature."""
    n, outputs = len(offsets) - 1, len(weights)
    total, count = np.zeros((outputs, n)), np.zeros(n)
    bits = int(weights.shape[1]).bit_length() - 1
    for low, high, part, at in tx.pieces_of_texts(data, offsets):
        for ids, of in tx.feature_ids(part, at, bits, grams, fold):
            size = np.diff(of)
            count[low:high] += size
            some = np.flatnonzero(size)
            if some.size:
                for k in range(outputs):
                    total[k, low + some] += np.add.reduceat(weights[k][ids], of[some], dtype=np.float64)
    return (total / np.maximum(count, 1)).T


def sparse(text: str | None, grams: tuple[int, ...], fold: bool, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of one text and their shares, which add up to 1."""
    data, offsets = tx.flat(pa.array([text], pa.large_string()))
    total = np.zeros(1 << bits)
    for _, _, part, at in tx.pieces_of_texts(data, offsets):
        for found, _ in tx.feature_ids(part, at, bits, grams, fold):
            total += np.bincount(found, minlength=1 << bits)
    ids = np.flatnonzero(total)
    return ids, total[ids] / max(total.sum(), 1)


def scored(docs: DataFrame, text: str, finish, outputs: list[T.StructField], weights: np.ndarray, grams: tuple[int, ...], fold: bool, keep: bool = False) -> DataFrame:
    """docs, without the text unless keep is set, with what finish(texts, means) gives for the outputs, streamed through. Columns that clash with an output are dropped."""
    names = {f.name.lower() for f in outputs}
    rest = [c for c in docs.columns if c != text and c.lower() not in names]
    (own,) = (text,) if keep else spare("text", taken=[*rest, *names])
    plain = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias(own))
    shown = plain.columns if keep else rest
    shipped = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(weights.T, np.float32))

    def run(batches):
        for batch in batches:
            column = batch.column(own)
            values = finish(column, means(*tx.flat(column), shipped.value, grams, fold))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in shown), *values], names=[*shown, *(f.name for f in outputs)])

    return plain.mapInArrow(run, T.StructType([*(f for f in plain.schema if f.name in shown), *outputs]))


def fold_of(key: str, folds: int):
    """crc32 of the key as text, modulo the number of folds; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def sample(rows: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """(key, label) of at most per_label rows of each label, those whose keys hash least: the same ones in every run, wherever the rows lie.

    Labels are counted first, and rows whose hash lies beyond what twice the sample needs are left before any row moves, so what is sorted is a few thousand rows
    a label, however many rows or partitions there are. At most LABELS labels, the most frequent ones, are learned. A key counts once for each of its labels.
    """
    rows = rows.select(key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull()).distinct()
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 40)) / float(1 << 40)
    counts = rows.groupBy(label).agg(F.count("*").alias("_c")).orderBy(F.desc("_c"), label).limit(LABELS)
    near = rows.withColumn("_p", place).join(F.broadcast(counts), label).where(F.col("_p") * F.col("_c") <= 2 * per_label + 100)
    w = Window.partitionBy(label).orderBy("_p", key)
    return near.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_label).select(key, label)


def _made(docs: DataFrame, key: str, text: str, chosen: DataFrame, label: str, grams: tuple[int, ...], fold: bool, bits: int, own: bool) -> DataFrame:
    """(k, label, ids, shares) of the chosen documents, numbers packed as bytes."""
    on = {"k": F.col(key)} | ({"label": F.col(label)} if own else {})
    # the left side is far larger; only the bounded sample is sent to all executors
    picked = docs.select(*[c.alias(n) for n, c in on.items()], F.col(text).alias("text")).join(F.broadcast(chosen.select(F.col(key).alias("k"), F.col(label).alias("label"))), list(on))
    # a partial aggregate: a key on many rows leaves one in each partition
    picked = picked.groupBy("k", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kind, id_kind = picked.schema["label"].dataType.simpleString(), _id_kind(bits)

    def run(batches):
        for batch in batches:
            got = [sparse(x, grams, fold, bits) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), batch.column("label"), pa.array([i.astype(id_kind).tobytes() for i, _ in got], pa.binary()), pa.array([s.astype("<f4").tobytes() for _, s in got], pa.binary())],
                names=["k", "label", "ids", "shares"],
            )

    return picked.select("k", "label", "text").mapInArrow(run, f"k {picked.schema['k'].dataType.simpleString()}, label {kind}, ids binary, shares binary")


def _id_kind(bits: int) -> str:
    return "<u2" if bits <= 16 else "<u4"


def _in_order(got: pa.Table, bits: int) -> list:
    """(label, features, shares) of what _made gives, ordered by key; the arrays only point into Arrow's buffers, so a sample is held once."""
    got = got.combine_chunks()
    keys, labels, ids, shares = (got.column(c) for c in ("k", "label", "ids", "shares"))
    rows = [(labels[n].as_py(), np.frombuffer(ids[n].as_buffer(), _id_kind(bits)), np.frombuffer(shares[n].as_buffer(), "<f4")) for n in range(len(got))]
    order = sorted(range(len(got)), key=lambda n: (keys[n].as_py(), str(rows[n][0]), rows[n][1].tobytes()))
    return [rows[n] for n in order]


def features(docs: DataFrame, key: str, text: str, chosen: DataFrame, label: str, grams: tuple[int, ...], fold: bool, bits: int = BITS, own: bool = False) -> list:
    """(label, features, shares) of the chosen documents, ordered by key, made on the executors; chosen is a bounded sample.

    Of several rows with a chosen key one is taken, that whose text hashes least; with own, docs have the label and only rows that have the chosen one count.
    """
    return _in_order(_made(docs, key, text, chosen, label, grams, fold, bits, own).toArrow(), bits)


def trained(docs: DataFrame, key: str, text: str, chosen: DataFrame, label: str, grams: tuple[int, ...], fold: bool, learn, bits: int = BITS, own: bool = False):
    """learn(features) of the chosen documents, run on an executor: of the bounded sample, whose features are many times larger than a model, only the model comes to the driver."""

    def run(batches):
        got = list(batches)
        if got:
            model = pickle.dumps(learn(_in_order(pa.Table.from_batches(got), bits)))
            got.clear()
            pa.default_memory_pool().release_unused()  # the worker lives on
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    made = _made(docs, key, text, chosen, label, grams, fold, bits, own).repartition(1).mapInArrow(run, "model binary").toArrow()
    return pickle.loads(made.column("model")[0].as_py()) if len(made) else learn([])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_embeddings(rows: list, classes: int, dim: int = 16, epochs: int = 12, rate: float = 0.3, seed: int = 7, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent on feature vectors, averaged per document, and a softmax over them; steps shrink as each number's own squared gradients add up.

    rows: (class, features, shares). Returns the read-out per feature and the bias.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (1 << bits, dim)).astype(np.float32) / dim
    seen = np.full(1 << bits, 1e-8, np.float32)  # squared gradients of a feature's vector
    out = np.zeros((dim, classes), np.float32)
    bias = np.zeros(classes, np.float32)
    seen_out, seen_bias = np.full_like(out, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, ids, shares = rows[k]
            x = shares @ vectors[ids]
            error = softmax(x @ out + bias)
            error[y] -= 1
            back = out @ error
            step = np.outer(x, error)
            seen_out += step**2
            seen_bias += error**2
            seen[ids] += shares**2 * float(back @ back) / dim
            out -= rate * step / np.sqrt(seen_out)
            bias -= rate * error / np.sqrt(seen_bias)
            vectors[ids] -= (rate * shares / np.sqrt(seen[ids]))[:, None] * back
    return (vectors @ out).astype(np.float64), bias.astype(np.float64)


def calibrated(margins: np.ndarray, labels: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift that make a logistic of slope * margin + shift the chance of label 1, where ones have that share of all rows; from margins of rows not learned from.

    Logistic regression by Newton's steps with Platt's smoothed targets; each label weighs as much as it has of all rows.
    """
    ones, zeros = int((labels == 1).sum()), int((labels == 0).sum())
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    weight = np.where(labels == 1, share / ones, (1 - share) / zeros)
    x = np.stack([margins, np.ones(len(margins))], 1)
    at = np.array([1.0, np.log(share / (1 - share))])
    loss = lambda c: float(weight @ (np.logaddexp(0, x @ c) - target * (x @ c)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (weight * (p - target)))
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return max(float(at[0]), 0.05), float(at[1])


def train_svm(rows: list, epochs: int = 8, decay: float = 1e-4, scale: float = 16.0, seed: int = 7, bits: int = BITS) -> tuple[np.ndarray, float]:
    """Linear support vector machine on average features by subgradient steps on the hinge loss; rows: (+1 or -1, features, shares)."""
    rng = np.random.default_rng(seed)
    w, size, bias, t = np.zeros(1 << bits), 1.0, 0.0, 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, ids, shares = rows[k]
            t += 1
            step = 1 / (decay * (t + 1 / decay))
            margin = y * (size * scale * (shares @ w[ids]) + bias)
            size *= 1 - step * decay
            if margin < 1:
                w[ids] += step * y * scale * shares / size
                bias += 0.05 * step * y
    return w * size * scale, bias
