"""Exact deduplication with a heavy-hitter split.

Misra-Gries counters, one set for each task and merged once, name every digest that can hold more than 1/(k+1) of the
rows. Their exact counts and winners are found by a partial aggregation and broadcast (k rows at most), so that copies
of a heavy text go where they are read; all other digests meet in an ordinary shuffle, in which none is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, stored

COUNTERS = 4096


def misra_gries(counts: dict, more: dict, k: int) -> dict:
    """Merge two summaries of k counters; each count is too low by at most total/(k+1)."""
    for key, n in more.items():
        counts[key] = counts.get(key, 0) + n
    if len(counts) <= k:
        return counts
    cut = sorted(counts.values(), reverse=True)[k]
    return {key: n - cut for key, n in counts.items() if n > cut}


def heavy_digests(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """Exact (digest, keep_id, group_size) of every digest with more than 1/(k+1) of the rows; k rows at most."""

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        counts: dict = {}
        for batch in batches:
            found = batch.column(0).value_counts()
            counts = misra_gries(counts, dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist(), strict=True)), k)
        if counts:
            yield [list(counts), list(counts.values())]

    parts = in_arrow(digests.select("digest"), summaries, "digest binary, n long", [pa.binary(), pa.int64()])
    named = parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(k).select("digest")
    exact = digests.join(F.broadcast(named), "digest").groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return exact.where(F.col("group_size") * (k + 1) > digests.count())


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def exact_groups(docs: DataFrame) -> DataFrame:
    """For every row: the id that stays of its group of equal texts, the group's size and whether the row stays.

    A null text equals an empty one. The largest id stays; a null id stays only where a group has no other, and of rows
    that share the winning id one stays. An empty table gives no rows; other columns are not read.
    """
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest")), "digests")
    heavy = stored(heavy_digests(rows), "heavy")
    marked = rows.join(F.broadcast(heavy), "digest", "left")
    loses = F.coalesce(F.col("doc_id") < F.col("keep_id"), F.col("keep_id").isNotNull())
    gone = marked.where(loses).withColumn("kept", F.lit(False))
    group = Window.partitionBy("digest")
    rest = marked.where(~loses).select(
        "digest", "doc_id", F.coalesce("keep_id", F.max("doc_id").over(group)).alias("keep_id"),
        F.coalesce("group_size", F.count(F.lit(1)).over(group)).alias("group_size"),
        (F.row_number().over(group.orderBy(F.desc_nulls_last("doc_id"))) == 1).alias("kept"),
    )
    return rest.unionByName(gone).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without copies, all columns as they are, whatever their names; the rules of `exact_groups` hold.

    Only rows that may stay travel: a heavy group's losers go before the shuffle.
    """
    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), digest(docs["text"]).alias("digest"), F.struct("*").alias("row"))
    heavy = stored(heavy_digests(stored(named.select("doc_id", "digest"), "digests")), "heavy").select("digest", "keep_id")
    marked = named.join(F.broadcast(heavy), "digest", "left")
    stays = ~F.coalesce(F.col("doc_id") < F.col("keep_id"), F.col("keep_id").isNotNull())
    first = F.row_number().over(Window.partitionBy("digest").orderBy(F.desc_nulls_last("doc_id")))
    return marked.where(stays).withColumn("place", first).where("place = 1").select("row.*")
