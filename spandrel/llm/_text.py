"""Vectorised work on the UTF-8 bytes of a column of texts.

Everything here takes the flat Arrow buffer of a batch, so no Python object is made per word.
Intermediate arrays are bounded: long buffers are cut at separators into slices of ``SLICE`` bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
_U = np.uint64
_POWER = _U(0x9E3779B97F4A7C15)


def separators(keep) -> np.ndarray:
    """Table of 256 booleans, true where a byte separates words; bytes of other characters never do."""
    return np.array([b < 128 and not keep(b) for b in range(256)])


#: Words are runs of anything but ASCII white space.
BLANK = separators(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: Words are runs of ASCII letters, digits and all characters beyond ASCII.
NOT_ALNUM = separators(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def byte_values(separator: np.ndarray, fold: bool) -> np.ndarray:
    """A random odd number for each byte, 0 for separators; with fold, A-Z count as a-z."""
    table = mix(np.arange(1, 257, dtype=_U)) | _U(1)
    if fold:
        table[65:91] = table[97:123]
    table[separator] = 0
    return table


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)), at - at[0]


def slices(data: np.ndarray, separator: np.ndarray):
    """(begin, end) of consecutive parts of about SLICE bytes; each ends behind a separator or at the end."""
    begin = 0
    while begin < len(data):
        end = min(begin + SLICE, len(data))
        if end < len(data):
            cuts = np.flatnonzero(separator[data[begin:end]])
            while not cuts.size and end < len(data):
                step = data[end : end + SLICE]
                cuts = np.flatnonzero(separator[step])[:1] + (end - begin)
                end += len(step)
            end = begin + int(cuts[-1]) + 1 if cuts.size else len(data)
        yield begin, end
        begin = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and n + 1 offsets that tell which are whose."""
    values = byte_values(separator, fold)
    edge = np.unique(offsets)
    hashes, starts = [], []
    for begin, end in slices(data, separator):
        part = data[begin:end]
        fresh = np.ones(len(part), bool)
        fresh[1:] = separator[part[:-1]]
        inner = edge[np.searchsorted(edge, begin) : np.searchsorted(edge, end)] - begin
        fresh[inner] = True
        first = np.flatnonzero(fresh & ~separator[part])
        if not first.size:
            continue
        run = np.diff(first, append=len(part))
        power = np.cumprod(np.full(int(run.max()), _POWER, _U))
        body = values[part[first[0] :]]
        body *= power[np.arange(len(body)) - np.repeat(first - first[0], run)]
        # what follows a word up to the next one adds 0; a document's edge inside a run of letters starts a word of its own
        hashes.append(mix(np.add.reduceat(body, first - first[0])))
        starts.append(first + begin)
    if not hashes:
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets).astype(np.int64)


def runs_of_rows(offsets: np.ndarray, size: int = 1 << 20):
    """(first, last) of runs of texts of some megabytes, one text at least."""
    row, n = 0, len(offsets) - 1
    while row < n:
        last = min(n, max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1))
        yield row, last
        row = last


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words of one document; of the whole sequence where it is shorter."""
    if not len(words):
        return np.zeros(0, _U)
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, _U(width), _U)
    for k in range(width):
        total *= _POWER
        total += words[k : k + len(total)]
    return mix(total)


def characters(data: np.ndarray, offsets: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """A random odd number for each character of some UTF-8 texts, and n + 1 offsets that tell which are whose."""
    table = byte_values(np.zeros(256, bool), fold)
    if not (data >= 0x80).any():
        return table[data], offsets
    start = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[start]
    values = table[lead]
    wide = np.flatnonzero(lead >= 0xC0)
    code = lead[wide].astype(_U)
    for k, least in ((1, 0xC0), (2, 0xE0), (3, 0xF0)):
        more = lead[wide] >= least
        code[more] = code[more] << _U(8) | data[np.minimum(start[wide[more]] + k, len(data) - 1)]
    values[wide] = mix(code) | _U(1)
    return values, np.searchsorted(start, offsets).astype(np.int64)


def feature_ids(data: np.ndarray, offsets: np.ndarray, bits: int, grams: tuple[int, ...], fold: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed features of some texts: (ids, n + 1 offsets) of the words, in the lower half of 2**bits, and of the character n-grams for each n, in the upper half.

    An n-gram lies inside one text; blanks are characters too.
    """
    shift, half = _U(65 - bits), 1 << (bits - 1)
    words, at = word_hashes(data, offsets, BLANK, fold)
    kinds = [((words >> shift).astype(np.int32), at)]
    values, of = characters(data, offsets, fold)
    for n in grams:
        if len(values) < n:
            continue
        total = np.full(len(values) - n + 1, _U(n), _U)
        for k in range(n):
            total *= _POWER
            total += values[k : k + len(total)]
        # a text of c characters has c - n + 1; those that begin near its end belong to none
        inside = np.ones(len(total), bool)
        for k in range(1, n):
            last = of[1:] - k
            inside[last[(last >= of[:-1]) & (last < len(total))]] = False
        size = np.append(0, np.cumsum(np.maximum(np.diff(of) - n + 1, 0)))
        kinds.append(((mix(total[inside]) >> shift).astype(np.int32) + half, size))
    return kinds


def pieces_of_texts(data: np.ndarray, offsets: np.ndarray):
    """(first row, last row, bytes, offsets) of runs of rows of about SLICE bytes; a longer text comes in several, each as one row."""
    n, row = len(offsets) - 1, 0
    while row < n:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE, "right")) - 1)
        last = min(last, n)
        part = data[offsets[row] : offsets[last]]
        if len(part) <= SLICE:
            yield row, last, part, offsets[row : last + 1] - offsets[row]
        else:  # one long text
            for begin, end in slices(part, BLANK):
                yield row, last, part[begin:end], np.array([0, end - begin])
        row = last
