"""Incremental refresh of a landed table and daily totals of an event stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import Rule, indicator_state, merge_states, state_score
from ..sources.store import list_snapshots, save_snapshot


def landed_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", **options) -> DataFrame:
    reader = spark.readStream.schema(schema)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.format(fmt).load(path)


def flag_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Mark rows that break a range rule or miss a ruled value."""
    bad = F.lit(False)
    for r in rules:
        c = F.col(r.indicator)
        bad = bad | c.isNull() | (c < r.low) | (c > r.high)
    return df.withColumn("is_bad", bad)


def refresh(source: DataFrame, rules: Sequence[Rule], out: str, checkpoint: str) -> None:
    """Take what has landed, check it, append good and bad rows apart, and log one score per batch.

    The batch id is the partition of all three sinks and each batch overwrites its own
    partition, so a batch that is replayed after a failure leaves no duplicates.
    """

    def one_batch(df: DataFrame, batch_id: int) -> None:
        flagged = flag_rows(df, rules).persist()
        sink = f"batch_id={batch_id}"
        try:
            flagged.filter("not is_bad").drop("is_bad").write.mode("overwrite").parquet(f"{out}/accepted/{sink}")
            flagged.filter("is_bad").drop("is_bad").write.mode("overwrite").parquet(f"{out}/rejected/{sink}")
            share = F.coalesce(F.try_divide(F.count_if("is_bad") * 100.0, F.count("*")), F.lit(0.0))
            flagged.agg(
                F.count("*").alias("rows"), F.count_if("is_bad").alias("bad"), F.round(F.greatest(F.lit(0.0), 100.0 - share * 5), 1).alias("score")
            ).write.mode("overwrite").parquet(f"{out}/scores/{sink}")
        finally:
            flagged.unpersist()

    query = source.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def refresh_scores(source: DataFrame, rules: Sequence[Rule], out: str, checkpoint: str, as_of: Column) -> None:
    """Keep a quality score of a landed long indicator table (indicator, ds, value) up to date, batch by batch.

    The state is one row per indicator: rows, missing and outlying values, last date. Each batch merges its own counts into the state
    of the batch before, writes both the new state and its score under its batch id, and saves what landed as a snapshot. A
    batch that is replayed starts from the same state and writes the same rows again; late rows count like all others.
    """

    def one_batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        states = [indicator_state(df, rules)]
        if batch_id:
            states.append(spark.read.parquet(f"{out}/state/batch_id={batch_id - 1}"))
        merge_states(*states).write.mode("overwrite").parquet(f"{out}/state/batch_id={batch_id}")
        state = spark.read.parquet(f"{out}/state/batch_id={batch_id}")
        state_score(state, as_of).write.mode("overwrite").parquet(f"{out}/scores/batch_id={batch_id}")
        stamp = f"batch_{batch_id:09d}"
        if list_snapshots(spark, f"{out}/snapshots").where(F.col("snapshot_id") == f"{stamp}_landed").isEmpty():
            save_snapshot(df, f"{out}/snapshots", stamp, "landed")

    query = source.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def daily_totals(events: DataFrame, value: str = "value", ts: str = "ts", by: Sequence[str] = (), lateness: str = "1 day") -> DataFrame:
    """Sum per day and key of a stream; rows later than `lateness` are dropped, a day is emitted once it is closed."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", lateness)
    return (
        timed.groupBy(F.window("_ts", "1 day"), *by)
        .agg(F.sum(value).alias("total"), F.count("*").alias("n"))
        .select(F.col("window.start").cast("date").alias("ds"), *by, "total", "n")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Drain a stream into a parquet folder in append mode and read it back."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def monthly_from_daily(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Months are no fixed-length windows: they are a batch roll-up of the daily sink."""
    return daily.groupBy(*by, F.last_day("ds").alias("ds")).agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
