"""Best-fit-decreasing packing into sequences, written as binary files.

Documents are dealt by hash into groups of bounded size, packed one by one, so no task holds more than a group. In a group, a document longer than a
sequence is split: all but its last part fill sequences of their own. The rest, longest first, each go to the open sequence with the least sufficient room, found in a
segment tree over capacities in as many steps as the window has binary digits.

A group is three files: the matrix of ids (one row per sequence, padded), the cumulative lengths of the segments (their ends on the matrix's flat axis), and the
position resets: the places on that axis where positions start again from 0, from which ``positions`` makes those of all ids.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _files, tokens
from ._common import new_folder

WINDOW = 2048
#: Bytes of text of a group, on average: at least and at most. In between there is a group per shuffle partition.
GROUP_BYTES = (1 << 20, 32 << 20)


class Capacities:
    """Open sequences by free room; the least sufficient room is found in a segment tree of counts."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, bin_: int) -> None:
        self.open[room].append(bin_)
        self._add(room, 1)

    def _add(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, bin) with the least room >= size, removed; None if there is none."""
        node = size + self.leaves
        if not self.count[node]:
            # up to the first right sibling with any, then down to its first leaf
            while node > 1 and not (node % 2 == 0 and self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node + (self.count[2 * node] == 0)
        room = node - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit(sizes: list[int], window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (item, start, length, bin, offset) of items of the given sizes, and the number of bins."""
    pieces, bins, rest = [], 0, []
    for k, size in enumerate(sizes):
        start = 0
        while size - start > window:
            pieces.append((k, start, window, bins, 0))
            bins, start = bins + 1, start + window
        if size > start:
            rest.append((size - start, k, start))
    rooms = Capacities(window)
    for size, k, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        found = rooms.take(size)
        if found is None:
            room, bin_, bins = window, bins, bins + 1
        else:
            room, bin_ = found
        pieces.append((k, start, size, bin_, window - room))
        rooms.put(room - size, bin_)
    return pieces, bins


def positions(resets: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Position of each id in its segment, on the flat axis of a matrix of that size; 0 for padding."""
    out = np.zeros(size, np.int64)
    for start, end in zip(resets.tolist(), ends.tolist(), strict=True):
        out[start:end] = np.arange(end - start)
    return out


_INDEX = [("key", None), ("doc_tokens", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("group", pa.int64()), ("bin", pa.int64()), ("offset", pa.int64()), ("bins", pa.int64()), ("file", pa.string())]


def _write(uri: str, window: int, kind: np.dtype, sizes: list[int], ids: list[bytes], pad: int):
    pieces, bins = best_fit(sizes, window)
    matrix = np.full((bins, window), pad, kind)
    ends, resets = np.zeros(len(pieces), "<u8"), np.zeros(len(pieces), "<u8")
    order = sorted(range(len(pieces)), key=lambda p: (pieces[p][3], pieces[p][4]))
    for n, p in enumerate(order):
        k, start, length, bin_, offset = pieces[p]
        matrix[bin_, offset : offset + length] = np.frombuffer(ids[k], kind)[start : start + length]
        resets[n] = bin_ * window + offset
        ends[n] = resets[n] + length
    for name, data in (("ids", matrix), ("segments", ends), ("resets", resets)):
        with _files.create(f"{uri}.{name}") as out:
            out.write(data.tobytes())
    return [pieces[p] for p in order], bins


def write(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = tokens.END_ID, pad_id: int = 0, tokenizer: str = tokens.TOKENIZER, group_bytes: int | None = None) -> DataFrame:
    """Writes the packed groups below folder and returns the index of pieces: key, doc_tokens, start, length, group, bin, offset, bins (of the group), file.

    Null and empty texts are one token, end_id. Repeated rows are packed as often as they come; no rows write nothing. A file's name is new for every attempt of a
    task; only those in the index count. Texts of any length are packed whole; other columns play no part, whatever their names.
    """
    plain = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    total = plain.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    group_bytes = group_bytes or min(max(total // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), GROUP_BYTES[0]), GROUP_BYTES[1])
    groups = int(total // group_bytes) + 1
    dealt = plain.withColumn("group", F.pmod(F.xxhash64(F.col("key").cast("string"), "text"), F.lit(groups)))
    kind = np.dtype(f"<u{tokens.id_bytes(tokenizer)}")
    made = tokens.tokenized(dealt, "text", end_id, tokenizer)
    key_type = plain.schema["key"].dataType
    fields = [T.StructField("key", key_type)] + [T.StructField(n, T.LongType()) for n, _ in _INDEX[1:-1]] + [T.StructField("file", T.StringType())]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = pc.sort_indices(table, [("key", "ascending"), ("n_tokens", "ascending")])
        table = table.take(order)
        sizes, ids = table.column("n_tokens").to_pylist(), [tokens.unpacked(x.as_py()) for x in table.column("ids")]
        group = table.column("group")[0].as_py()
        uri = f"{folder}/group-{group:08d}-{uuid.uuid4().hex}"
        pieces, bins = _write(uri, window, kind, sizes, ids, pad_id)
        item = pa.array([p[0] for p in pieces], pa.int64())
        columns = [table.column("key").take(item), pa.array([sizes[p[0]] for p in pieces], pa.int64()), *(pa.array([p[c] for p in pieces], pa.int64()) for c in (1, 2))]
        columns += [pa.array([group] * len(pieces), pa.int64()), *(pa.array([p[c] for p in pieces], pa.int64()) for c in (3, 4)), pa.array([bins] * len(pieces), pa.int64()), pa.array([uri] * len(pieces), pa.string())]
        return pa.table(columns, names=[n for n, _ in _INDEX])

    made.groupBy("group").applyInArrow(run, T.StructType(fields)).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.parquet(f"{folder}/index")


def read(index: DataFrame, window: int = WINDOW, tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """Pieces read back from the files: key, start, length, ids_crc32 (of little-endian 32-bit ids), doc_tokens, sequence_id (over all groups), offset."""
    running = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)  # one row per group
    first = index.groupBy(F.col("group").alias("g"), F.col("file").alias("f")).agg(F.max("bins").alias("n")).select("g", "f", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("first"))
    kind = np.dtype(f"<u{tokens.id_bytes(tokenizer)}")
    key_type = index.schema["key"].dataType

    def run(table: pa.Table) -> pa.Table:
        uri, first = table.column("file")[0].as_py(), table.column("first")[0].as_py()
        rows = table.select(["bin", "offset", "length"]).to_pydict()
        with _files.open_input(f"{uri}.ids") as f:
            flat = np.frombuffer(f.read(), kind)
        with _files.open_input(f"{uri}.segments") as f, _files.open_input(f"{uri}.resets") as g:
            place = positions(np.frombuffer(g.read(), "<u8"), np.frombuffer(f.read(), "<u8"), len(flat))
        crc = []
        for bin_, offset, length in zip(rows["bin"], rows["offset"], rows["length"], strict=True):
            at = bin_ * window + offset
            # positions begin anew with the piece and nowhere inside it
            if place[at] != 0 or place[at + length - 1] != length - 1 or (np.diff(place[at : at + length]) != 1).any():
                raise ValueError(f"{uri}: no segment of {length} ids lies at {at}")
            crc.append(zlib.crc32(flat[at : at + length].astype("<u4").tobytes()))
        sequence = pa.array(np.array(rows["bin"], np.int64) + first)
        return pa.table([*(table.column(c) for c in ("key", "start", "length")), pa.array(crc, pa.int64()), table.column("doc_tokens"), sequence, table.column("offset")], names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    out = T.StructType([T.StructField("key", key_type)] + [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])
    return index.join(first, F.col("file") == F.col("f")).drop("f", "g").groupBy("file").applyInArrow(run, out)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs docs into files in the shared folder and reads their pieces back."""
    return read(write(docs, new_folder(docs.sparkSession, "packed"), key, text)).withColumnRenamed("key", key)
