"""Token ids of whole texts with a public tokenizer, made once per distinct word.

The tokenizer used here splits a normalised text into words that it encodes one by one, so the ids of a text are those of its words in a row. Texts of
Latin letters (no character beyond U+017F) are split here by the tokenizer's own rule over all bytes of a batch at once. Words are told apart by a 64-bit hash, and in a
worker's table by their length and first eight bytes too (the odds that two of a million words fall together are below 1e-7); a word not seen yet goes
through the tokenizer's model, and the ids are gathered. Other texts go through the tokenizer as they are.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import _text as tx
from ._common import vocabulary

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
#: A worker's table with more words than this keeps only those met again since it was last cut.
WORDS = 1 << 19
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


def _classes() -> np.ndarray:
    """Class of each byte; bytes of characters beyond ASCII count as letters here."""
    table = np.full(256, _OTHER, np.uint8)
    table[[9, 10, 13, 32]] = _SPACE
    table[97:123] = _LETTER
    table[128:] = _LETTER
    table[48:58] = _DIGIT
    return table


def _latin1() -> np.ndarray:
    """Class of a character of U+0080 to U+00BF by its second byte: feminine and masculine ordinals and micro are letters, small digits and fractions are digits."""
    table = np.full(256, _OTHER, np.uint8)
    table[[0xAA, 0xB5, 0xBA]] = _LETTER
    table[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = _DIGIT
    return table


_CLASS, _CLASS_C2 = _classes(), _latin1()
_VALUE = tx.byte_values(np.zeros(256, bool), False)
_VALUE[[9, 10, 13, 32]] = 0
#: Bytes that only the tokenizer itself handles: control characters and those that begin characters beyond U+017F.
_FOREIGN = np.array([b < 32 and b not in (9, 10, 13) or b == 127 or b > 0xC5 for b in range(256)])


def _alphabet() -> dict[int, int]:
    """The model's characters for bytes: printable ones stand for themselves, the others follow from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in shown)}


class _Table:
    """Words by hash, and where their ids lie in a pool."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # in a text their strings are ordinary text
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.simple = _splits_words(path)
        self.model, self.alphabet = self.tokenizer.model, _alphabet()
        self._take(np.zeros(0, bool), *(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int32, np.int32, self.kind)))

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind)

    def word(self, word: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.alphabet))]

    def _take(self, again, keys, marks, start, size, pool) -> None:
        self.again, self.keys, self.marks, self.start, self.size, self.pool = again, keys, marks, start, size, pool

    def __len__(self) -> int:
        return len(self.keys)

    def look_up(self, keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Number of each word in the table, -1 for those it lacks."""
        if not len(self):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self) - 1)
        at[(self.keys[at] != keys) | (self.marks[at] != marks)] = -1
        self.again[at[at >= 0]] = True
        return at

    def shrink(self) -> None:
        """A full table loses the words that were not met again, or where that is too little all."""
        if len(self) <= WORDS:
            return
        stay = np.flatnonzero(self.again) if 2 * self.again.sum() < WORDS else np.zeros(0, np.int64)
        size = self.size[stay]
        upto = np.append(0, np.cumsum(size))
        pool = self.pool[np.repeat(self.start[stay] - upto[:-1], size) + np.arange(upto[-1])]
        self._take(np.zeros(len(stay), bool), self.keys[stay], self.marks[stay], upto[:-1].astype(np.int32), size, pool)

    def add(self, keys: np.ndarray, marks: np.ndarray, ids: list[list[int]]) -> None:
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        start = (len(self.pool) + np.cumsum(size) - size).astype(np.int32)
        pool = np.concatenate([self.pool, np.fromiter((x for w in ids for x in w), self.kind, int(size.sum()))])
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        put = lambda old, new: np.insert(old, at, new[order])
        self._take(put(self.again, np.zeros(len(keys), bool)), put(self.keys, keys), put(self.marks, marks), put(self.start, start), put(self.size, size), pool)


def _splits_words(path: str) -> bool:
    """Whether the file describes the word splitter that this module knows."""
    import json

    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    kinds = [x.get("type") for x in (j.get("normalizer") or {}).get("normalizers", [])]
    parts = (j.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    split = parts[0].get("pattern", {}).get("Regex", "")
    return kinds == ["NFC", "Replace", "Lowercase"] and split == "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" and parts[0].get("invert") is True


@lru_cache(maxsize=2)
def table(path: str) -> _Table:
    return _Table(path)


def foreign(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows with anything that the split below doesn't know."""
    bad = _FOREIGN[data]
    if len(data):
        pair = data[1:]
        bad[:-1] |= (data[:-1] == 0xC2) & (pair <= 0xA0) | (data[:-1] == 0xC4) & (pair == 0xB0) | (data[:-1] == 60) & (pair == 124)
    return np.unique(np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1)


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of all words of lower-cased texts: runs of letters, single digits, runs of anything else but blanks, and the endings 's 't 're 've 'm 'll 'd."""
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inner = np.zeros(0, np.int64)
    if (data >= 0x80).any():
        at = np.flatnonzero(data[:-1] == 0xC2)
        kind[at] = kind[at + 1] = _CLASS_C2[data[at + 1]]
        at = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        kind[at] = kind[at + 1] = _OTHER
        inner = np.flatnonzero((data & 0xC0) == 0x80)
    fresh = kind == _DIGIT
    fresh[1:] |= kind[1:] != kind[:-1]
    fresh |= edge[:-1]
    fresh[inner] = False
    mark = np.flatnonzero((data == 39) & fresh)
    mark = mark[mark + 1 < len(data)]
    mark = mark[~edge[mark + 1]]
    one, two = data[mark + 1], np.where((mark + 2 < len(data)) & ~edge[np.minimum(mark + 2, len(data))], data[np.minimum(mark + 2, len(data) - 1)], 0)
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long = (one == 114) & (two == 101) | (one == 118) & (two == 101) | (one == 108) & (two == 108)
    mark, width = mark[short | long], np.where(short, 2, 3)[short | long]
    fresh[mark + 1] = False
    after = mark + width
    after = after[after < len(data)]
    fresh[after] = True
    bounds = np.flatnonzero(fresh)
    ends = np.append(bounds[1:], len(data))
    word = kind[bounds] != _SPACE
    return bounds[word], ends[word]


def _marks(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Length and first bytes of words, as a number."""
    out = (end - begin).astype(np.uint64) << np.uint64(56)
    for k in range(8):
        out ^= np.where(begin + k < end, data[np.minimum(begin + k, len(data) - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
    return out


def _encoded(data: np.ndarray, offsets: np.ndarray, words: _Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and n + 1 offsets."""
    begin, end = split(data, offsets)
    if not begin.size:
        return np.zeros(0, words.kind), np.zeros(len(offsets), np.int64)
    run = np.diff(begin, append=len(data))
    power = np.cumprod(np.full(int(run.max()), tx._POWER, np.uint64))
    place = np.arange(begin[0], len(data))
    place -= np.repeat(begin, run)
    body = power[place]
    body *= _VALUE[data[begin[0] :]]
    which, keys = pd.factorize(np.add.reduceat(body, begin - begin[0]))
    del body, place
    first = np.empty(len(keys), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    low, high = begin[first], end[first]
    marks = _marks(data, low, high)
    words.shrink()
    at = words.look_up(keys, marks)
    new = np.flatnonzero(at < 0)
    if new.size:
        flat = data.tobytes()
        words.add(keys[new], marks[new], [words.word(flat[b:e]) for b, e in zip(low[new].tolist(), high[new].tolist(), strict=True)])
        at = words.look_up(keys, marks)
    start, length = words.start[at], words.size[at][which]
    upto = np.append(0, np.cumsum(length))
    ids = words.pool[np.repeat(start[which] - upto[:-1], length) + np.arange(upto[-1])]
    return ids, upto[np.searchsorted(begin, offsets)]


def encode_all(column: pa.Array, words: _Table) -> list[list[np.ndarray]]:
    """Parts of the ids of each text of a column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    out: list[list[np.ndarray]] = [[] for _ in range(len(column))]
    data, offsets = tx.flat(column)
    other = set(foreign(data, offsets).tolist()) if words.simple else set(range(len(column)))
    for k in sorted(other):
        out[k].append(words.encode(column[k].as_py()))
    plain = [k for k in range(len(column)) if k not in other]
    if not plain:
        return out
    if other:
        column = column.take(pa.array(plain, pa.int64()))
    data, offsets = tx.flat(pc.utf8_lower(column))
    for low, high, part, at in tx.pieces_of_texts(data, offsets):
        ids, upto = _encoded(part, at, words)
        if high - low == 1:
            out[plain[low]].append(ids)
        else:
            for k in range(high - low):
                out[plain[low + k]].append(ids[upto[k] : upto[k + 1]])
    return out


def encode(text: str | None, words: _Table) -> bytes:
    return b"".join(x.tobytes() for x in encode_all(pa.array([text], pa.string()), words)[0])


def unpacked(ids: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(ids)


def tokenized(docs: DataFrame, text: str, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """docs with the text replaced by n_tokens and ids (little-endian, 2 bytes an id for vocabularies below 65,537, else 4; Zstandard). Every document
    ends with end_id; a null text is empty and thus one token long."""
    path = vocabulary(tokenizer)
    rest = [f for f in docs.schema if f.name != text]

    def run(batches):
        words = table(path)
        end = np.array([end_id], words.kind).tobytes()
        codec = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            n, ids = [], []
            for low, high in tx.runs_of_rows(tx.flat(batch.column(text))[1]):
                for parts in encode_all(batch.column(text).slice(low, high - low), words):
                    got = b"".join([*(p.tobytes() for p in parts), end])
                    n.append(len(got) // words.kind.itemsize)
                    ids.append(codec.compress(got))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in rest), pa.array(n, pa.int64()), pa.array(ids, pa.large_binary()).cast(pa.binary())],
                names=[*(f.name for f in rest), "n_tokens", "ids"],
            )

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]))


def id_bytes(tokenizer: str = TOKENIZER) -> int:
    return table(vocabulary(tokenizer)).kind.itemsize

