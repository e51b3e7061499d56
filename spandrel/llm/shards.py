"""Weighted rendezvous hashing of record keys over shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import spare

SHARDS = 16
#: Rows of a shard that one task numbers at most, on average.
SLOT_ROWS = 2_000


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard with the highest draw for this key; shard s draws from the MD5 of key and s, to the power 1 / its weight.

    With one more shard (or a larger weight) only rows that draw highest there move, all of them into it. With equal weights the digests themselves are
    compared. A null key counts as the text null.
    """
    text = F.coalesce(key.cast("string"), F.lit("null"))
    draw = [F.md5(F.concat(text, F.lit(f":{s}")).cast("binary")) for s in range(len(weights))]
    if len(set(weights)) > 1:
        # log(u) / w, u in (0, 1) from the leading 52 bits; a weight of 0 never draws
        u = [(F.conv(F.substring(d, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52) for d in draw]
        draw = [F.log(x) / F.lit(float(w)) if w else F.lit(-math.inf) for x, w in zip(u, weights, strict=True)]
    best = F.greatest(*[F.struct(d.alias("d"), F.lit(-s).alias("s")) for s, d in enumerate(draw)]) if len(draw) > 1 else F.struct(F.lit(0).alias("d"), F.lit(0).alias("s"))
    return (-best["s"]).cast("int")


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, weights: list[float] | None = None) -> DataFrame:
    """docs without the text, with size (UTF-8 bytes and 1), text_crc32, shard, slot (0, 1, 2, ... within the shard) and grown_shard (with one more shard, of mean weight).

    Key and number of shards alone decide; slots go by the digest of the key. A null text has no bytes (size 1, crc32 0). Repeated rows share a shard and
    get slots of their own. Columns of docs that clash with an added one are dropped; no rows give no rows.
    """
    weights = list(weights or [1.0] * shards)
    shards = len(weights)
    more = [*weights, sum(weights) / len(weights)]
    made = {"size", "text_crc32", "shard", "grown_shard", "slot"}
    rest = [c for c in docs.columns if c != text and c.lower() not in made]
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    slim = docs.select(*[F.col(f"`{c}`") for c in rest], (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), shard_of(F.col(key), weights).alias("shard"), shard_of(F.col(key), more).alias("grown_shard"))
    h, b, base = spare("h", "b", "base", taken=[*rest, *made])
    # slots: rows in order of their key's digest; a shard is cut by leading hexadecimal digits into buckets whose sizes are summed up, so no task numbers a whole shard
    rows, digits = docs.count(), 0
    while shards * 16**digits * SLOT_ROWS < rows:
        digits += 1
    slim = slim.withColumn(h, F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")).cast("binary"))).withColumn(b, F.substring(h, 1, digits))
    before = Window.partitionBy("shard").orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = slim.groupBy("shard", b).agg(F.count("*").alias("_n")).select("shard", b, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy("shard", b).orderBy(h, f"`{key}`", "size", "text_crc32")
    numbered = slim.withColumn("slot", F.row_number().over(inside).cast("long") - 1)
    return numbered.join(sizes, ["shard", b]).withColumn("slot", F.col("slot") + F.col(base)).select(*rest, "size", "text_crc32", "shard", "slot", "grown_shard")
