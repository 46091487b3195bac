"""Sharding by a keyed permutation of the global row numbers, in DataFrame expressions only.

The rows are numbered without a global sort: by hash bucket, and inside a bucket by id. A Feistel network over a grid
just larger than the table permutes the numbers; a value outside the table walks on along its cycle until it is inside.
Shard and slot of any row follow from its number alone, and the shards differ by one row at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUNDS = 8
MOST_BUCKETS = 16_384


def round_keys(seed: int) -> list[int]:
    """One key for each round; even keys change the left half, odd ones the right."""
    return [(seed * 1_000_003 + 7919 * r) * 2 + r % 2 for r in range(ROUNDS)]


def permuted(x: Column, rows: int, seed: int) -> Column:
    """The image of each number in 0..rows-1 under the permutation of that range which the seed names."""
    left = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    right = max(1, -(-rows // left))
    keys = F.array(*[F.lit(k).cast("long") for k in round_keys(seed)])

    def turn(s: Column, key: Column) -> Column:
        to_left = (s["l"] + F.pmod(F.xxhash64(s["r"], key), F.lit(left).cast("long"))) % left
        to_right = (s["r"] + F.pmod(F.xxhash64(s["l"], key), F.lit(right).cast("long"))) % right
        even = key % 2 == 0
        return F.struct(F.when(even, to_left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(to_right).alias("r"))

    def network(v: Column) -> Column:
        start = F.struct((v / right).cast("long").alias("l"), (v % right).alias("r"))
        return F.aggregate(keys, start, turn, lambda s: s["l"] * right + s["r"])

    # A walk visits values outside the table only, fewer than the side of the grid; a share below 1/side of all values is
    # outside, so that even 64 steps are never used up in a large table. Nothing is dropped: an unfinished walk raises.
    steps = min(left * right - rows + 1, 64)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), network(x), lambda v, _: F.when(v < rows, v).otherwise(network(v)))
    return F.when(walked < rows, walked).otherwise(F.raise_error("the walk did not end")).cast("long")


def numbered(rows: DataFrame, total: int, key: str, ties: list[str]) -> DataFrame:
    """`rows` with `row_no`, a gapless number from 0 that depends on the contents only."""
    buckets = max(64, min(MOST_BUCKETS, total // 20_000))
    at = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    counts = rows.select(at.alias("bucket")).groupBy("bucket").count()
    before = counts.select("bucket", (F.sum("count").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("count")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy(key, *ties)) - 1
    placed = rows.withColumn("bucket", at).withColumn("inside", inside)
    # one row for each bucket, MOST_BUCKETS at most
    return placed.join(F.broadcast(before), "bucket").withColumn("row_no", F.col("before") + F.col("inside")).drop("bucket", "inside", "before")


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 2) -> DataFrame:
    """Shard, slot and row number of every document; shards take turns along the permuted order.

    A null text has no bytes (crc32 of nothing: 0). Rows with equal or null ids are numbered by size and checksum, equal
    rows in any order; an empty table gives no rows. Other columns are not read. Adding rows moves others: the law is
    `rows` (counts at most one apart), so `grown_shard` is null.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    total = docs.count()
    place = numbered(slim, total, "doc_id", ["size", "text_crc32"]).withColumn("place", permuted(F.col("row_no"), total, seed))
    return place.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        (F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_no",
    )
