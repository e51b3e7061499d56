"""URL filter: host and path rules first, then the ratio of two character models.

URLs that rules accept or reject are the training data of two variable-order Markov models over 64 symbols: the letters, each digit, the
punctuation of URLs one by one, blanks, other ASCII and three kinds of bytes of other characters. Contexts of 3, 2, 1 and 0 symbols are each smoothed with the next shorter one in
proportion to the number of different followers (Witten-Bell). Only contexts that occur are held, so a model grows with the URLs it is made of, up to 64**4 entries a class.
A URL without a rule is judged by its log-likelihood difference per symbol; the threshold is the one that splits held-out ruled URLs best. Counts are made over all
ruled URLs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as tx
from ._common import spare

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
ORDER, BITS = 3, 6
SYMBOLS = 1 << BITS
#: One URL in so many of the ruled ones is for the threshold, not the counts.
HELD_OUT = 5
BINS, SPAN = 4001, 4.0
_END = SYMBOLS - 1


def _symbols() -> np.ndarray:
    """0 pads the start, 1-26 letters, 27-36 digits, 37-57 punctuation, 58 blanks, 59 other ASCII, 60-62 bytes that go on, begin two-byte and begin longer characters, 63 the end."""
    table = np.full(256, 59, np.int64)
    table[97:123] = table[65:91] = np.arange(1, 27)
    table[48:58] = np.arange(27, 37)
    for k, c in enumerate(b"/.-_?=&#%:+~,;@!()'*$"):
        table[c] = 37 + k
    table[[9, 10, 13, 32]] = 58
    table[128:192], table[192:224], table[224:] = 60, 61, 62
    return table


def codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The number of each symbol with its predecessors, of all URLs in a row (the end included), and the URL of each."""
    data, offsets = tx.flat(column)
    n = len(offsets) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.diff(offsets) + 1 + ORDER
    at = np.append(0, np.cumsum(size))
    tape = np.zeros(at[-1], np.int64)
    row = np.repeat(np.arange(n), size)
    place = np.arange(at[-1]) - at[row]
    tape[(place >= ORDER) & (place < size[row] - 1)] = _symbols()[data]
    tape[at[1:] - 1] = _END
    total = np.zeros_like(tape)
    for k in range(ORDER + 1):
        total[ORDER:] |= tape[k : len(tape) - ORDER + k] << (BITS * (ORDER - k))
    real = place >= ORDER
    return total[real], row[real]


class Markov:
    """Witten-Bell probabilities from counts of numbers (contexts of ORDER symbols and what follows), by order: sorted numbers of what occurred, their counts, and sums and kinds of their contexts."""

    def __init__(self, numbers: np.ndarray, counts: np.ndarray):
        self.orders = []
        for order in range(ORDER + 1):
            code, which = np.unique(numbers & ((1 << BITS * (order + 1)) - 1), return_inverse=True)
            n = np.bincount(which, weights=counts, minlength=len(code))
            context, of = np.unique(code >> BITS, return_inverse=True)
            self.orders.append((code, n, context, np.bincount(of, weights=n, minlength=len(context)), np.bincount(of, minlength=len(context))))

    def log_probability(self, numbers: np.ndarray) -> np.ndarray:
        p = np.full(len(numbers), 1 / SYMBOLS)
        for order, (code, n, context, total, kinds) in enumerate(self.orders):
            own = numbers & ((1 << BITS * (order + 1)) - 1)
            at, there = _find(context, own >> BITS)
            hit, met = _find(code, own)
            count = np.where(met, n[hit], 0) if len(n) else 0
            p = np.where(there, (count + kinds[at] * p) / (total[at] + kinds[at]), p) if len(context) else p
        return np.log(p)


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where numbers lie among sorted ones, and whether they do."""
    at = np.minimum(np.searchsorted(sorted_, wanted), max(len(sorted_) - 1, 0))
    return at, sorted_[at] == wanted if len(sorted_) else np.zeros(len(wanted), bool)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; empty without ://."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(found > 0, url.substr(found + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), upper, lower), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):  # longer ones are asked before shorter ones
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


class Ratio:
    """The two models, and the threshold of the difference per symbol."""

    def __init__(self, accepted: Markov, rejected: Markov):
        self.accepted, self.rejected, self.threshold = accepted, rejected, 0.0

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for low, high in tx.runs_of_rows(tx.flat(column)[1]):
            numbers, row = codes(column.slice(low, high - low))
            # URLs share most of their symbols' contexts: each is looked up once
            once, which = np.unique(numbers, return_inverse=True)
            value = (self.accepted.log_probability(once) - self.rejected.log_probability(once))[which]
            out[low:high] = np.bincount(row, weights=value, minlength=high - low) / np.maximum(np.bincount(row, minlength=high - low), 1)
        return out


def fit(urls: DataFrame) -> Ratio | None:
    """From (url, verdict) of ruled URLs; None unless both verdicts occur."""
    urls = urls.where("url IS NOT NULL AND verdict IS NOT NULL").select("url", (F.col("verdict") == "allow").alias("good"), (F.crc32(F.col("url").cast("binary")) % HELD_OUT == 0).alias("held"))

    def count(batches):
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False)
            for low, high in tx.runs_of_rows(tx.flat(batch.column("url"))[1]):
                numbers, row = codes(batch.column("url").slice(low, high - low))
                for k in (0, 1):
                    code, n = np.unique(numbers[good[low:high][row] == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k), pa.int32()), pa.array(code), pa.array(n.astype(np.int64))], names=["good", "code", "n"])

    sums = urls.where("NOT held").select("url", "good").mapInArrow(count, "good int, code long, n long").groupBy("good", "code").agg(F.sum("n").alias("n"))
    got = sums.toArrow()  # what occurs of at most 2 * 64**4
    kind, code, n = (got[c].to_numpy() for c in ("good", "code", "n"))
    if not (kind == 0).any() or not (kind == 1).any():
        return None
    ratio = Ratio(*(Markov(code[kind == k], n[kind == k]) for k in (1, 0)))
    shipped = urls.sparkSession.sparkContext.broadcast(ratio)

    def histogram(batches):
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            bin_ = np.clip(np.round((shipped.value.scores(batch.column("url")) + SPAN) / (2 * SPAN) * (BINS - 1)), 0, BINS - 1).astype(np.int64)
            np.add.at(total, (batch.column("good").to_numpy(zero_copy_only=False).astype(int), bin_), 1)
        good, bin_ = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(good.astype(np.int32)), pa.array(bin_.astype(np.int32)), pa.array(total[good, bin_])], names=["good", "bin", "n"])

    held = urls.where("held").select("url", "good").mapInArrow(histogram, "good int, bin int, n long").groupBy("good", "bin").agg(F.sum("n").alias("n")).toArrow()
    share = np.zeros((2, BINS))
    share[held["good"].to_numpy(), held["bin"].to_numpy()] = held["n"].to_numpy()
    if share.sum(axis=1).all():
        share /= share.sum(axis=1, keepdims=True)
        # share of rejected below a bin and of accepted from it on; of equals the middle
        right = np.append(0, np.cumsum(share[0])[:-1]) + np.cumsum(share[1][::-1])[::-1]
        best = np.flatnonzero(right >= right.max() - 1e-12)
        ratio.threshold = ((best[0] + best[-1]) / 2 - 0.5) / (BINS - 1) * 2 * SPAN - SPAN
    return ratio


def judge(pages: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule (null where none fits), score and verdict (allow or block).

    score is the difference of log-likelihoods per symbol, higher for URLs like the accepted ones; a null URL has the empty one's; URLs of any length are read whole. If rules label no URL, or only one way, there is no
    model: score is 0 and URLs without a rule are allowed. Columns that clash with an added one are dropped; repeated rows each get their verdict.
    """
    made = ("host", "path", "rule", "score", "verdict")
    rest = [c for c in pages.columns if c.lower() not in made]
    host, path = parts(F.col(f"`{url}`"))
    (own,) = spare("url_", taken=[*rest, *made])
    split = pages.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{url}`").alias(own)).withColumns({"host": host, "path": path})
    rule, by_rule = ruled(F.col("host"), F.col("path"), rules)
    split = split.withColumns({"rule": rule, "verdict": by_rule})
    ratio = fit(split.select(F.col(own).alias("url"), "verdict"))
    if ratio is None:
        return split.withColumns({"score": F.lit(0.0), "verdict": F.coalesce("verdict", F.lit("allow"))}).drop(own)
    shipped = pages.sparkSession.sparkContext.broadcast(ratio)

    def run(batches):
        for batch in batches:
            score = shipped.value.scores(batch.column(own))
            names = [c for c in batch.schema.names if c != own]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score, pa.float64())], names=[*names, "score"])

    out = split.mapInArrow(run, T.StructType([*(f for f in split.schema if f.name != own), T.StructField("score", T.DoubleType())]))
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= ratio.threshold, "allow").otherwise("block")))
