"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

In each round every source earns a quantum, its target share of one window, and sends what its savings (the deficit, carried over
from round to round) pay for. A source's savings after r rounds are r quanta less what it has sent, so the round of a piece follows
from the place of its last token in its source's queue alone: the first round whose sum of quanta reaches that place. No state passes
from task to task; deficits carry across windows and partitions because places in queues are prefix sums over all data.

Pieces in order of rounds are one long tape that is cut into windows, each full but the last. Prefix sums are two-level (bucket totals, then
inside a bucket), so a busy source is many tasks' work.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from ._common import kept

WINDOW, PIECE = 2048, 256
BUCKET_DOCS, BLOCK_ROUNDS = 1024, 2048

_OUT = T.StructType(
    [T.StructField("doc_tokens", T.LongType())]
    + [T.StructField(n, T.LongType()) for n in ("start", "length", "sequence_id", "offset")]
    + [T.StructField("ids", T.BinaryType()), T.StructField("ids_crc32", T.LongType())]
)


def _shares(queues: DataFrame, weights: dict | None) -> DataFrame:
    """(source, queue, share, after): the share of a window that a source earns each round, and the rounds before its first.

    With weights, sources of a positive weight share the windows by weight; all others begin when those have ended, and share by size.
    """
    weights = {k: float(w) for k, w in (weights or {}).items() if w > 0}
    name = F.col("source")
    given = F.lit(None).cast("double")
    for source, w in weights.items():
        given = F.when(name.eqNullSafe(F.lit(source)), F.lit(w / sum(weights.values()))).otherwise(given)
    queues = queues.withColumn("given", given)
    # two numbers for all sources together
    rest, last = queues.agg(F.sum(F.when(F.col("given").isNull(), F.col("queue"))), F.max(F.col("queue") / F.col("given"))).first()
    return queues.select("source", "queue", F.coalesce("given", F.col("queue") / F.lit(float(rest or 1))).alias("share"), F.when(F.col("given").isNull(), F.lit(float(last or 0))).otherwise(F.lit(0.0)).alias("after"))


def plan(sizes: DataFrame, window: int = WINDOW, piece: int = PIECE, weights: dict | None = None) -> DataFrame:
    """(row, pieces) for rows of (row, order, source, n_tokens): where each run of a document's tokens lies. Documents queue by order, a 64-bit number.

    weights are target shares by source; sources left out and those of weight 0 are packed after all others, by their own size. By default each source's share is that of all tokens,
    so that all queues end together. A queue that ends early leaves its room to the others.
    """
    docs = sizes.count()
    if not docs:
        return sizes.select("row", F.array().cast("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>").alias("pieces"))
    bits = max(0, (docs // BUCKET_DOCS).bit_length())
    spread = sizes.withColumnRenamed("order", "h").withColumn("b", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    # place of each document in its source's queue
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = spread.groupBy("source", "b").agg(F.sum("n_tokens").alias("t"))
    queues = _shares(sizes.groupBy("source").agg(F.sum("n_tokens").alias("queue")), weights).withColumnRenamed("source", "q")
    buckets = buckets.select("source", "b", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base")).join(queues, F.col("source").eqNullSafe(F.col("q")))
    buckets = buckets.select(F.col("source").alias("s"), F.col("b").alias("c"), "base", "share", "after")
    inside = Window.partitionBy("source", "b").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = spread.withColumn("upto", F.sum("n_tokens").over(inside)).join(buckets, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("c")))
    start = F.col("base") + F.col("upto") - F.col("n_tokens")
    cut = placed.select("row", "source", "n_tokens", start.alias("at"), (F.col("share") * window).alias("quantum"), F.ceil(F.col("after") / window).alias("after"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1, F.lit(piece).cast("long"))).alias("start"))
    length = F.least(F.lit(piece).cast("long"), F.col("n_tokens") - F.col("start"))
    rounds = cut.select("row", "source", "start", length.alias("length"), F.col("at"), (F.col("after") + F.ceil((F.col("at") + F.col("start") + length) / F.col("quantum")) - 1).alias("round"))
    rounds = kept(rounds.withColumn("block", F.floor(F.col("round") / BLOCK_ROUNDS)))
    # place of each piece on the tape
    blocks = rounds.groupBy("block").agg(F.sum("length").alias("t"))
    running = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one short row for millions of tokens
    blocks = blocks.select(F.col("block").alias("k"), F.coalesce(F.sum("t").over(running), F.lit(0)).alias("base"))
    inside = Window.partitionBy("block").orderBy("round", F.xxhash64("source", "round"), "source", "at", "start", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tape = rounds.withColumn("upto", F.sum("length").over(inside)).join(blocks, F.col("block") == F.col("k"))
    tape = tape.select("row", "start", "length", (F.col("base") + F.col("upto") - F.col("length")).alias("g"))
    first = F.least(F.col("length"), window - F.col("g") % window)
    piece_of = lambda start, length, g: F.struct(start.alias("start"), length.alias("length"), F.floor(g / window).alias("sequence_id"), (g % window).alias("offset"))
    one, two = piece_of(F.col("start"), first, F.col("g")), piece_of(F.col("start") + first, F.col("length") - first, F.col("g") + first)
    tape = tape.select("row", F.explode(F.when(first < F.col("length"), F.array(one, two)).otherwise(F.array(one))).alias("p"))
    return tape.groupBy("row").agg(F.collect_list("p").alias("pieces"))


def _emit(size: int, keep: list[str], with_ids: bool):
    kind = np.dtype(f"<u{size}")

    def run(batches):
        for batch in batches:
            lists = batch.column("pieces")
            flat = lists.flatten()
            start, length, sequence, offset = (flat.field(c).to_numpy() for c in ("start", "length", "sequence_id", "offset"))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            order = np.lexsort((start, row))
            row, start, length, sequence, offset = (x[order] for x in (row, start, length, sequence, offset))
            # neighbours on the tape are one piece
            fresh = np.append(True, (row[1:] != row[:-1]) | (sequence[1:] != sequence[:-1]) | (offset[:-1] + length[:-1] != offset[1:]))[: len(row)]
            first = np.flatnonzero(fresh)
            if len(first):
                length = np.add.reduceat(length, first)
            row, start, sequence, offset = (x[first] for x in (row, start, sequence, offset))
            at, ids, sizes, parts, crc = -1, b"", [], [], []
            for k, low, n in zip(row.tolist(), start.tolist(), length.tolist(), strict=True):
                if k != at:
                    at, ids = k, np.frombuffer(tokens.unpacked(batch.column("ids")[k].as_py()), kind).astype("<u4")
                part = ids[low : low + n].tobytes()
                sizes.append(len(ids))
                parts.append(part if with_ids else None)
                crc.append(zlib.crc32(part))
            arrays = [pa.array(x, pa.int64()) for x in (sizes, start, length, sequence, offset)] + [pa.array(parts, pa.binary()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row, pa.int64())) for c in keep), *arrays], names=[*keep, *_OUT.names])

    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", window: int = WINDOW, weights: dict | None = None, end_id: int = tokens.END_ID, tokenizer: str = tokens.TOKENIZER, with_ids: bool = True) -> DataFrame:
    """One row per piece of a document: key, doc_tokens, start (tokens of the document before it), length, sequence_id, offset (in the sequence), ids (unsigned little-endian
    32-bit) and their ids_crc32.

    All sequences but the last are full, so padding is below one window in all. Null and empty texts are one token, end_id; long texts are packed whole. A null source is a
    source of its own; repeated rows and keys are packed as often as they come; no rows give no rows. Other columns play no part, whatever their names. Documents queue by a
    hash of key and text, however they are partitioned; among rows equal in both it does not matter which is which.
    """
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.xxhash64(F.col(f"`{key}`").cast("string"), f"`{text}`").alias("order"), F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").alias("text"))
    ids = kept(tokens.tokenized(plain, "text", end_id, tokenizer))
    where = plan(ids.select("row", "order", "source", "n_tokens"), window, min(PIECE, window), weights)
    whole = ids.select("row", "key", "ids").join(where, "row").select("key", "ids", "pieces")
    out = whole.mapInArrow(_emit(tokens.id_bytes(tokenizer), ["key"], with_ids), T.StructType([whole.schema["key"], *_OUT.fields]))
    return out.withColumnRenamed("key", key)
