"""Toxicity: a second-order factorization machine over hashed terms.

Terms are a text's words and the beginnings of its words, hashed into one table. Of them the ones count that go with a label beyond chance in the labelled sample; a document is the
vector of the logarithms of their counts, of length one. Its margin is ``bias + sum w[i] x[i] + sum over i < j of <v[i], v[j]> x[i] x[j]``: each term has a weight, and each pair of terms one more,
by the product of their vectors, so that an insult and the mention of a group may weigh more together than both alone, even if training met few documents with that very pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as tx
from . import classify
from ._common import Scratch, spare

BITS = 18
#: Bytes of the beginnings of words that are terms besides whole words.
STEMS = (4, 5, 6, 7, 8)
#: Longer runs without a separator count in pieces of so many bytes.
PIECE = 64
#: At most so many labelled documents of each label are learned from.
PER_LABEL = 2000
#: A term is learned if at least so many documents of the sample have it and twice the log-likelihood ratio of its 2 x 2 table with the label (chi-squared with one degree of freedom) is as large.
LEAST_DOCS, LEAST_RATIO = 3, 15.0
FACTORS, EPOCHS, RATE, BATCH = 8, 15, 0.5, 32
THRESHOLD, FOLDS, HELD_OUT = 0.7, 3, 1
_U = np.uint64


def _cuts(data: np.ndarray, edges: np.ndarray):
    """(begin, end) of parts of at most SLICE bytes, cut behind a separator or at an edge; where there is none, behind whole pieces of one run."""
    size = max(PIECE, tx.SLICE // PIECE * PIECE)
    begin = 0
    while begin < len(data):
        end = min(begin + size, len(data))
        if end < len(data):
            blanks = np.flatnonzero(tx.NOT_ALNUM[data[begin:end]])
            inner = edges[np.searchsorted(edges, begin, "right") : np.searchsorted(edges, end)]
            cut = max(begin + int(blanks[-1]) + 1 if blanks.size else begin, int(inner[-1]) if inner.size else begin)
            end = cut if cut > begin else end
        yield begin, end
        begin = end


def _hashed(part: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the terms in some bytes, and where the word of each begins; a word ends at a separator, at an edge or after PIECE bytes."""
    blank = tx.NOT_ALNUM[part]
    fresh = np.ones(len(part), bool)
    fresh[1:] = blank[:-1]
    fresh[edges[edges < len(part)]] = True
    runs = np.flatnonzero(fresh & ~blank)
    if not runs.size:
        return np.zeros(0, np.int64), runs
    stops = np.flatnonzero(blank | np.append(fresh[1:], True))  # the last byte of a run, or a separator
    ends = stops[np.searchsorted(stops, runs)]
    ends = np.where(blank[ends], ends, ends + 1)
    pieces = -(-(ends - runs) // PIECE)
    starts = np.repeat(runs, pieces) + PIECE * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    sizes = np.minimum(np.repeat(ends, pieces) - starts, PIECE)
    values = tx.byte_values(tx.NOT_ALNUM, True)[part]
    power = np.cumprod(np.full(PIECE, tx._POWER, _U))
    total = np.zeros(len(starts), _U)
    ids, places = [], []
    live = np.arange(len(starts))
    for k in range(PIECE):
        if k in STEMS:
            ids.append(tx.mix(total[live] + _U(k)))
            places.append(starts[live])
        live = live[sizes[live] > k] if k else live
        if not live.size:
            break
        total[live] += values[starts[live] + k] * power[k]
    ids.append(tx.mix(total))
    places.append(starts)
    return (np.concatenate(ids) >> _U(64 - BITS)).astype(np.int64), np.concatenate(places)


def counted(data: np.ndarray, offsets: np.ndarray, slot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of some texts, in order; with slot, only of terms whose slot isn't negative, by slot. Intermediate arrays are bounded: texts are read in parts."""
    edges, keys, counts = np.unique(offsets), [], []
    for begin, end in _cuts(data, edges):
        ids, at = _hashed(data[begin:end], edges[np.searchsorted(edges, begin) : np.searchsorted(edges, end)] - begin)
        if slot is not None:
            ids = slot[ids]
            ids, at = ids[ids >= 0].astype(np.int64), at[ids >= 0]
        row = np.searchsorted(offsets, at + begin, "right") - 1
        key, n = np.unique(row << BITS | ids, return_counts=True)
        keys.append(key)
        counts.append(n)
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    key, where = np.unique(np.concatenate(keys), return_inverse=True)
    return key >> BITS, key & ((1 << BITS) - 1), np.bincount(where, np.concatenate(counts), len(key)).astype(np.int64)


def vectors(row: np.ndarray, count: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """What each term counts for in its document's vector of length one, and where the documents begin and end."""
    x = np.log1p(count)
    size = np.sqrt(np.bincount(row, x * x, rows))
    return x / np.maximum(size, 1e-12)[row], np.searchsorted(row, np.arange(rows + 1))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[at[1:]] - total[at[:-1]]


@dataclass
class Machine:
    """slot of each term (-1: not learned), weights, vectors and bias."""

    slot: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float

    def margins(self, term: np.ndarray, x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each document its margin and the sum of its terms' vectors."""
        v = self.factors[term] * x[:, None]
        both = _sums(v, at)
        return self.bias + _sums(self.weights[term] * x, at) + 0.5 * (both**2 - _sums(v**2, at)).sum(axis=1), both


def train(row: np.ndarray, term: np.ndarray, x: np.ndarray, labels: np.ndarray, terms: int, seed: int = 7) -> Machine:
    """Stochastic gradient descent on the logistic loss in small batches; steps shrink as each number's own squared gradients add up. Entries are in order of their rows."""
    rng = np.random.default_rng(seed)
    model = Machine(np.zeros(0, np.int32), np.zeros(terms), rng.normal(0, 0.05, (terms, FACTORS)), 0.0)
    seen, seen_v, seen_bias = np.full(terms, 1e-6), np.full((terms, FACTORS), 1e-6), 1e-6
    first = np.searchsorted(row, np.arange(len(labels) + 1))
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for k in range(0, len(order), BATCH):
            docs = order[k : k + BATCH]
            size = first[docs + 1] - first[docs]
            at = np.append(0, np.cumsum(size))
            mine = np.repeat(first[docs] - at[:-1], size) + np.arange(at[-1])
            t, part = term[mine], x[mine]
            margin, both = model.margins(t, part, at)
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[docs]
            each = np.repeat(error, size) * part
            used, where = np.unique(t, return_inverse=True)
            step = np.bincount(where, each, len(used))
            slope = each[:, None] * (np.repeat(both, size, axis=0) - model.factors[t] * part[:, None])
            step_v = np.stack([np.bincount(where, slope[:, f], len(used)) for f in range(FACTORS)], axis=1)
            seen[used] += step**2
            seen_v[used] += step_v**2
            seen_bias += error.sum() ** 2
            model.weights[used] -= RATE * step / np.sqrt(seen[used])
            model.factors[used] -= 0.3 * RATE * step_v / np.sqrt(seen_v[used])
            model.bias -= RATE * error.sum() / np.sqrt(seen_bias)
    return model


def ratio(n1: np.ndarray, n0: np.ndarray, all1: int, all0: int) -> np.ndarray:
    """Twice the log-likelihood ratio of having a term against the label, for documents of both labels with it and in all."""
    f = lambda v: np.where(v > 0, v * np.log(np.maximum(v, 1e-9)), 0.0)
    n1, n0 = n1.astype(float), n0.astype(float)
    inside = f(n1) + f(n0) + f(all1 - n1) + f(all0 - n0)
    return 2 * (inside - f(n1 + n0) - f(all1 + all0 - n1 - n0) - f(np.array(float(all1))) - f(np.array(float(all0))) + f(np.array(float(all1 + all0))))


def _tell(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which terms are learned: counts (terms x 2 labels) and sizes (2) of a sample."""
    return (counts.sum(axis=1) >= LEAST_DOCS) & (ratio(counts[:, 1], counts[:, 0], int(sizes[1]), int(sizes[0])) >= LEAST_RATIO)


def _term_counts(batches):
    """How many documents of each half and label have each term, for one partition."""
    total = np.zeros((1 << BITS, 4), np.int64)
    for batch in batches:
        kind = batch.column("half").to_numpy() * 2 + batch.column("label").to_numpy()
        data, offsets = tx.flat(batch.column("text"))
        for low, high in tx.runs_of_rows(offsets):
            row, term, _ = counted(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            np.add.at(total, (term, kind[low + row]), 1)
    some = np.flatnonzero(total.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, k]) for k in range(4))], names=["term", "n0", "n1", "n2", "n3"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = FOLDS, held_out: int = HELD_OUT, per_label: int = PER_LABEL) -> Machine:
    """The machine learned from rows of labels outside the held-out fold (crc32 of the key as text, modulo folds) with label 0 or 1: at most per_label documents of each, chosen by the hash of their keys.

    Terms are chosen and counted on the executors; the driver gets the chosen ones and the sample's counts of those. Margins are turned into chances on rows that a machine of the other half
    of the sample judges, by terms chosen in that half, at the shares that both labels have in all these rows. A key with both labels counts as both. Without rows of both labels every text
    gets the same score: near 0 or 1 with one label, one half with none.
    """
    none = np.full(1 << BITS, -1, np.int32)
    known = labels.where(F.col(label).isin(0, 1) & (classify.fold_of(key, folds) != held_out)).select(key, F.col(label).cast("int").alias("y"))
    with Scratch(docs.sparkSession) as scratch:
        # only labels of documents that are here; keys alone are compared
        known = scratch.keep(known.distinct().join(docs.select(key), key, "left_semi"))
        every = {r.y: r.n for r in known.where(F.col(key).isNotNull()).groupBy("y").agg(F.count("*").alias("n")).collect()}
        if len(every) < 2:
            return Machine(none, np.zeros(0), np.zeros((0, FACTORS)), {frozenset(): 0.0, frozenset([0]): -3.0, frozenset([1]): 3.0}[frozenset(every)])
        chosen = classify.sample(known, key, "y", per_label).select(F.col(key).alias("k"), F.col("y").alias("label"))
        picked = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")
        # a key on many rows leaves one in each partition, that whose text hashes least
        picked = picked.groupBy("k", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumn("half", F.pmod(F.xxhash64(F.lit(1), F.col("k").cast("string")), F.lit(2)).cast("int"))
        picked = scratch.keep(picked)
        sizes = np.zeros(4, np.int64)
        for r in picked.groupBy("half", "label").count().collect():
            sizes[2 * r.half + r.label] = r["count"]
        table = picked.mapInArrow(_term_counts, "term long, n0 long, n1 long, n2 long, n3 long").groupBy("term").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)])
        table = table.where(F.col("n0") + F.col("n1") + F.col("n2") + F.col("n3") >= LEAST_DOCS).orderBy("term").toArrow()
        counts = np.stack([table.column(f"n{k}").to_numpy() for k in range(4)], axis=1).reshape(-1, 2, 2)
        sizes = sizes.reshape(2, 2)
        tells = [_tell(counts.sum(axis=1), sizes.sum(axis=0)), _tell(counts[:, 0], sizes[0]), _tell(counts[:, 1], sizes[1])]
        any_of = np.flatnonzero(tells[0] | tells[1] | tells[2])
        tells = [t[any_of] for t in tells]
        slot = none.copy()
        slot[table.column("term").to_numpy()[any_of]] = np.arange(len(any_of))
        rows = _features(picked, slot)
    row, term, count, label_of, half = rows
    n = len(label_of)

    def learned(docs_in: np.ndarray, tell: np.ndarray):
        mine = docs_in[row] & tell[term]
        x, _ = vectors(row[mine], count[mine], n)
        at = np.cumsum(docs_in) - 1
        return train(at[row[mine]], term[mine], x, label_of[docs_in], len(tell))

    whole = learned(np.ones(n, bool), tells[0])
    share = every[1] / (every[0] + every[1])
    if (sizes > 0).all():
        margins = np.zeros(n)
        for h in (0, 1):
            model, mine = learned(half == h, tells[1 + h]), tells[1 + h][term]
            x, at = vectors(row[mine], count[mine], n)
            margins = np.where(half == h, margins, model.margins(term[mine], x, at)[0])
        slope, shift = classify.calibrated(margins, label_of, share)
    else:
        slope, shift = 1.0, float(np.log(share / (1 - share)) - np.log(sizes[:, 1].sum() / sizes[:, 0].sum()))
    # terms that the whole sample doesn't tell by are taken out
    slot[slot >= 0] = np.where(tells[0], np.cumsum(tells[0]) - 1, -1)[slot[slot >= 0]]
    keep = tells[0]
    # a margin times the slope: weights times the slope, vectors times its root
    return Machine(slot, slope * whole.weights[keep], np.sqrt(slope) * whole.factors[keep], slope * whole.bias + shift)


def _features(picked: DataFrame, slot: np.ndarray):
    """(row, slot, count) of the sample's documents in order of their keys, with each one's label and half; only learned terms leave the executors."""
    shipped = picked.sparkSession.sparkContext.broadcast(slot)

    def run(batches):
        for batch in batches:
            data, offsets = tx.flat(batch.column("text"))
            row, term, count = counted(data, offsets, shipped.value)
            at = np.searchsorted(row, np.arange(len(batch) + 1))
            packed = [pa.array([a[i:j].astype("<i4").tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()) for a in (term, count)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("label"), batch.column("half"), *packed], names=["k", "label", "half", "terms", "counts"])

    shape = f"k {picked.schema['k'].dataType.simpleString()}, label int, half int, terms binary, counts binary"
    got = picked.select("k", "label", "half", "text").mapInArrow(run, shape).orderBy("k", "label").toArrow()
    terms, counts = ([np.frombuffer(b, "<i4") for b in got.column(c).to_pylist()] for c in ("terms", "counts"))
    row = np.repeat(np.arange(len(got)), [len(t) for t in terms])
    join = lambda parts: np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64)
    return row, join(terms), join(counts), got.column("label").to_numpy(), got.column("half").to_numpy()


def score(docs: DataFrame, model: Machine, text: str = "text", keep: bool = False) -> DataFrame:
    """docs, without the text unless keep is set, with score: the chance of label 1. Null, empty and other texts without a learned term get the bias alone. Texts of any length are scored whole, in parts;
    columns that clash with score are dropped; no rows give no rows."""
    rest = [c for c in docs.columns if c != text and c.lower() != "score"]
    (own,) = (text,) if keep else spare("text", taken=[*rest, "score"])
    plain = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias(own))
    shown = plain.columns if keep else rest
    shipped = docs.sparkSession.sparkContext.broadcast((model.slot, model.weights, model.factors, model.bias))

    def run(batches):
        mine = Machine(*shipped.value)
        for batch in batches:
            data, offsets = tx.flat(batch.column(own))
            row, term, count = counted(data, offsets, mine.slot)
            x, at = vectors(row, count, len(batch))
            chance = 1 / (1 + np.exp(-np.clip(mine.margins(term, x, at)[0], -30, 30)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in shown), pa.array(chance, pa.float64())], names=[*shown, "score"])

    return plain.mapInArrow(run, T.StructType([*(f for f in plain.schema if f.name in shown), T.StructField("score", T.DoubleType())]))


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the text, with held_out (crc32 of the key as text modulo 3 is 1, never learned from; true for a null key), score and predicted (1 if score >= threshold).

    Repeated rows each get their score, equal texts the same one; columns of docs that clash with an added one are dropped.
    """
    return score(docs, fit(docs, labels, key, text), text).withColumns(
        {"held_out": F.coalesce(classify.fold_of(key, FOLDS) == HELD_OUT, F.lit(True)), "predicted": (F.col("score") >= threshold).cast("int")}
    )
