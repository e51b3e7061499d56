"""Benchmark decontamination with suffix arrays of the training text.

Each batch of documents is a shard. Its suffixes that share their first two words with a test suffix (others
cannot match) are sorted into a word-level suffix array, and every test suffix is searched in it by bisection;
the range found holds all places where its first ten words occur. Order beyond these words is not needed: a longer match is a run of
successive test suffixes found at successive places, and such runs, extended to both sides as far as they go, are the longest verbatim matches, with their
places in the document and in the test text. Documents are only streamed through: nothing is shuffled.

Benchmark texts are a stated query set, taken in blocks of at most ``BLOCK`` words, an item in one of them: with more words than that, the documents
are streamed once for each block and the hits of a document are merged. A shipped block is thus bounded, however
long the benchmark grows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _text as tx
from ._common import kept, spare

WINDOW = 10
BLOCK = 2_000_000
#: Bytes of text of a shard, a document at least.
SHARD = 1 << 22

_MATCH = T.StructType([T.StructField("item", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("doc_word", "item_word", "n_words")])
_HITS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.BinaryType()),
    T.StructField("longest", T.ArrayType(_MATCH)),
]


class TestSuffixes:
    """Sorted vocabulary, leading word pairs and keys of the test suffixes of one block.

    Word ids start at 1; 0 stands for words that no test text has and for what lies beyond a document's end, and no key of a test suffix
    holds it but as padding of an item shorter than a window.
    """

    def __init__(self, texts: list[str], names: list[str], window: int):
        data, offsets = tx.flat(pa.array(texts, pa.large_string()))
        words, at = tx.word_hashes(data, offsets, tx.NOT_ALNUM)
        self.window, self.words = window, np.unique(words)
        ids = np.searchsorted(self.words, words) + 1
        keys, lengths, owners, places = [], [], [], []
        for k, name in enumerate(names):
            own = ids[at[k] : at[k + 1]]
            if not len(own):
                continue
            width = min(window, len(own))
            grid = np.zeros((len(own) - width + 1, window), ">u4")
            grid[:, :width] = np.lib.stride_tricks.sliding_window_view(own, width)
            keys.append(grid)
            lengths.append(np.full(len(grid), width))
            owners.append(np.full(len(grid), k))
            places.append(np.arange(len(grid)))
        self.names = names
        self.name_ids = np.unique(np.array(names, object), return_inverse=True)[1] if names else np.zeros(0, np.int64)
        self.keys = np.concatenate([*keys, np.zeros((0, window))]).astype(">u4")
        self.lengths, self.owners, self.places = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (lengths, owners, places))
        wide = self.lengths > 1
        self.pairs = np.unique(self.keys[wide, 0].astype(np.int64) << 32 | self.keys[wide, 1 % window].astype(np.int64))
        self.single = np.unique(self.keys[~wide, 0].astype(np.int64))

    def search(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(test suffix, place in words) of all occurrences, sorted by place."""
        none = np.zeros(0, np.int64)
        if not len(words) or not len(self.words):
            return none, none
        found = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        ids = np.where(self.words[found] == words, found + 1, 0).astype(np.int64)
        last = np.zeros(len(words), bool)
        last[at[1:][np.diff(at) > 0] - 1] = True
        after = np.append(ids[1:], 0)
        after[last] = 0
        able = np.isin(ids << 32 | after, self.pairs) & (ids > 0) & (after > 0)
        if len(self.single):
            able |= np.isin(ids, self.single)
        start = np.flatnonzero(able)
        if not start.size:
            return none, none
        end = at[1:][np.searchsorted(at, start, "right") - 1]
        grid = np.zeros((len(start), self.window), ">u4")
        for k in range(self.window):
            inside = start + k < end
            grid[inside, k] = ids[start[inside] + k]
        suffixes = grid.view(f"S{4 * self.window}")[:, 0]
        order = np.argsort(suffixes, kind="stable")
        array = suffixes[order]
        hit_test, hit_place = [none], [none]
        # one search per width, on the suffixes cut to it, as only whole windows count
        for width in np.unique(self.lengths):
            mine = np.flatnonzero(self.lengths == width)
            cut = array if width == self.window else np.ascontiguousarray(grid[order][:, :width]).view(f"S{4 * width}")[:, 0]
            want = np.ascontiguousarray(self.keys[mine][:, :width]).view(f"S{4 * width}")[:, 0]
            low, high = np.searchsorted(cut, want, "left"), np.searchsorted(cut, want, "right")
            count = high - low
            hit_test.append(np.repeat(mine, count))
            hit_place.append(start[order[np.repeat(low - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())]])
        test, place = np.concatenate(hit_test), np.concatenate(hit_place)
        order = np.argsort(place, kind="stable")
        return test[order], place[order]


def _blocks(benchmark: DataFrame, item: str, text: str, window: int, block: int):
    """The test texts in blocks; they reach the driver one by one."""
    texts, names, held = [], [], 0
    rows = benchmark.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("string"), F.col(text))
    for name, body in rows.toLocalIterator():
        texts.append(body)
        names.append(name)
        held += 1 + len(body) // 2
        if held >= block:
            yield TestSuffixes(texts, names, window)
            texts, names, held = [], [], 0
    yield TestSuffixes(texts, names, window)


def _spans(test: np.ndarray, place: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Merged (begin, end) of the words hit; place is sorted."""
    if not len(place):
        return np.zeros((0, 2), np.int64)
    end = np.maximum.accumulate(place + width[test])
    fresh = np.append(True, place[1:] > end[:-1])
    return np.stack([place[fresh], end[np.append(np.flatnonzero(fresh)[1:] - 1, len(place) - 1)]], 1)


def _runs(tests: TestSuffixes, test: np.ndarray, place: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, row of the test texts, document's word, test text's word, words) of the matches that can't be extended."""
    doc = np.searchsorted(at, place, "right") - 1
    owner, spot = tests.owners[test], tests.places[test]
    order = np.lexsort((place, spot - place, owner, doc))
    doc, owner, spot, place, width = (x[order] for x in (doc, owner, spot, place, tests.lengths[test]))
    same = (np.diff(doc) == 0) & (np.diff(owner) == 0) & (np.diff(spot - place) == 0) & (np.diff(place) == 1)
    first = np.flatnonzero(np.append(True, ~same))
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], owner[first], place[first] - at[doc[first]], spot[first], place[last] - place[first] + width[first]


def _longest(tests: TestSuffixes, test: np.ndarray, place: np.ndarray, at: np.ndarray) -> pa.Array:
    """For each document the longest match with each item it holds, of equal ones the first."""
    docs, kind = len(at) - 1, pa.struct([("item", pa.string()), *((n, pa.int64()) for n in ("doc_word", "item_word", "n_words"))])
    if not len(test):
        return pa.array([[]] * docs, pa.list_(kind))
    doc, owner, word, spot, size = _runs(tests, test, place, at)
    item = tests.name_ids[owner]
    order = np.lexsort((spot, word, -size, item, doc))
    fresh = np.append(True, (np.diff(doc[order]) != 0) | (np.diff(item[order]) != 0))
    doc, owner, word, spot, size = (x[order][fresh] for x in (doc, owner, word, spot, size))
    values = pa.StructArray.from_arrays([pa.array([tests.names[x] for x in owner], pa.string()), *(pa.array(x.astype(np.int64)) for x in (word, spot, size))], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(doc, minlength=docs))), pa.int32()), values)


def _hits(tests: TestSuffixes, batches, text: str, keep: bool):
    for batch in batches:
        data, offsets = tx.flat(batch.column(text))
        counts, hit, spans, longest = [], [], [], []
        for low, high in tx.runs_of_rows(offsets, SHARD):
            words, at = tx.word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], tx.NOT_ALNUM)
            counts.append(np.diff(at))
            test, place = tests.search(words, at)
            cut = np.searchsorted(place, at)
            for k in range(high - low):
                mine = slice(cut[k], cut[k + 1])
                ranges = _spans(test[mine], place[mine], tests.lengths) - at[k]
                hit.append(int((ranges[:, 1] - ranges[:, 0]).sum()))
                spans.append(ranges.astype("<i8").tobytes())
            longest.append(_longest(tests, test, place, at))
        shown = [c for c in batch.schema.names if keep or c != text]
        made = pa.concat_arrays(longest) if longest else pa.array([], pa.list_(pa.struct([("item", pa.string()), *((n, pa.int64()) for n in ("doc_word", "item_word", "n_words"))])))
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in shown), pa.array(np.concatenate(counts or [np.zeros(0, np.int64)]), pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, pa.binary()), made],
            names=[*shown, *(f.name for f in _HITS)],
        )


def _merged(rows) -> tuple[int, bytes, list]:
    spans = np.concatenate([np.frombuffer(bytes(r.spans), "<i8").reshape(-1, 2) for r in rows])
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    merged = _spans(np.arange(len(spans)), spans[:, 0], spans[:, 1] - spans[:, 0])
    best: dict[str, tuple] = {}
    for m in (tuple(x) for r in rows for x in r.longest):
        best[m[0]] = min(best.get(m[0], m), m, key=lambda x: (-x[3], x[1], x[2]))
    return int((merged[:, 1] - merged[:, 0]).sum()), merged.astype("<i8").tobytes(), list(best.values())


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK, keep: bool = False
) -> DataFrame:
    """Each row of docs, without its text unless keep is set, with the benchmark passages in it.

    A-Z are lower-cased; words are runs of ASCII letters and digits and of characters beyond ASCII. A window is `window` successive words of a
    test text; a shorter text is one window. Adds n_words, n_hit (words inside an occurrence of a window), spans (merged ranges of word numbers,
    begin and end as little-endian 64-bit pairs), longest (for each test text found its longest verbatim match: item, doc_word, item_word, n_words; of equal ones the first),
    items (their sorted names) and contaminated (n_hit > 0).

    Null and empty texts have no words and no hits. Test rows without name or text are left out; rows that repeat a name are windows of
    one item. An empty benchmark hits nothing. Repeated rows each get their result. Columns of docs that clash with an added
    one are dropped.
    """
    made = {"n_words", "spans", "longest", "items", "n_hit", "contaminated"}
    rest = [c for c in docs.columns if c.lower() not in made and c != text]
    (own,) = (text,) if keep else spare("text", taken=[*rest, *made])
    plain = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias(own))
    blocks = _blocks(benchmark, item, item_text, window, block)

    def run(tests: TestSuffixes, of: DataFrame) -> DataFrame:
        shipped = of.sparkSession.sparkContext.broadcast(tests)
        fields = [f for f in of.schema if keep or f.name != own]
        return of.mapInArrow(lambda batches: _hits(shipped.value, batches, own, keep), T.StructType([*fields, *_HITS]))

    first = next(blocks)
    more = next(blocks, None)
    if more is None:
        out = run(first, plain)
    else:
        (key,) = spare("row", taken=[*plain.columns, *made])
        plain = kept(plain.withColumn(key, F.monotonically_increasing_id()))
        parts = [run(x, plain) for x in (first, more, *blocks)]
        hits = parts[0].select(key, "spans", "longest")
        for p in parts[1:]:
            hits = hits.unionByName(p.select(key, "spans", "longest"))
        merge = F.udf(_merged, T.StructType([T.StructField("n_hit", T.LongType()), T.StructField("spans", T.BinaryType()), T.StructField("longest", T.ArrayType(_MATCH))]))
        hits = hits.where(F.length("spans") > 0).groupBy(key).agg(merge(F.collect_list(F.struct("spans", "longest"))).alias("m"))
        out = parts[0].drop("n_hit", "spans", "longest").join(hits, key, "left").withColumns(
            {"n_hit": F.coalesce("m.n_hit", F.lit(0).cast("long")), "spans": F.coalesce("m.spans", F.lit(b"")), "longest": F.coalesce("m.longest", F.array().cast(T.ArrayType(_MATCH)))}
        ).drop("m", key)
    return out.withColumns({"items": F.array_sort(F.transform("longest", lambda m: m["item"])), "contaminated": F.col("n_hit") > 0})


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK
) -> DataFrame:
    """All verbatim matches of at least a window that can't be extended on either side: (key, item, doc_word, item_word, n_words), words counted from 0."""
    plain = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([plain.schema["key"], *_MATCH])

    def run(tests: TestSuffixes) -> DataFrame:
        shipped = docs.sparkSession.sparkContext.broadcast(tests)

        def found(batches):
            held = shipped.value
            for batch in batches:
                data, offsets = tx.flat(batch.column("text"))
                for low, high in tx.runs_of_rows(offsets, SHARD):
                    words, at = tx.word_hashes(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], tx.NOT_ALNUM)
                    test, place = held.search(words, at)
                    if len(test):
                        doc, owner, word, spot, size = _runs(held, test, place, at)
                        names = pa.array([held.names[x] for x in owner], pa.string())
                        yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(doc + low)), names, *(pa.array(x.astype(np.int64)) for x in (word, spot, size))], names=schema.names)

        return plain.mapInArrow(found, schema)

    return reduce(DataFrame.unionByName, [run(tests) for tests in _blocks(benchmark, item, item_text, window, block)])


def digest(hits: DataFrame) -> DataFrame:
    """The result of decontaminate with its item names as a count and a SHA-256."""
    return hits.withColumns({"n_items": F.size("items").cast("long"), "items_sha256": F.sha2(F.array_join("items", ","), 256)}).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )
