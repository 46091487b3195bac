"""Sinks, snapshots and corrections."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException


def export_csv(df: DataFrame, root: str, stamp: str, name: str = "forecast") -> str:
    """CSV folder with a header, named by stamp."""
    path = f"{root}/{name}_{stamp}"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def export_parts(root: str, forecast: DataFrame, parts: Mapping[str, DataFrame], key: str = "series") -> list[str]:
    """The forecast partitioned by series and each further table as its own folder.

    Rows of one series are brought together first, so a series is not one file per task; the
    rebalance hint lets Spark split a series that is much larger than the others.
    """
    forecast.hint("rebalance", key).write.mode("overwrite").partitionBy(key).parquet(f"{root}/forecast")
    for name, df in parts.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    return [f"{root}/forecast", *[f"{root}/{name}" for name in parts]]


MANIFEST = "snapshot_id string, description string, rows long, schema string, saved_at timestamp"


def save_snapshot(df: DataFrame, root: str, stamp: str, description: str = "auto") -> str:
    """Write an immutable copy under `data/snapshot_id=stamp_description`, then add its line to the manifest.

    A snapshot is there once its line is: a write that failed half way is not listed and can be repeated.
    """
    spark = df.sparkSession
    snapshot_id = f"{stamp}_{re.sub(r'[^A-Za-z0-9]+', '_', description).strip('_')}"
    if not list_snapshots(spark, root).where(F.col("snapshot_id") == snapshot_id).isEmpty():
        raise ValueError(f"snapshot {snapshot_id} exists")
    seen = Observation()
    df.observe(seen, F.count("*").alias("rows")).write.mode("overwrite").parquet(f"{root}/data/snapshot_id={snapshot_id}")
    line = spark.sql("SELECT :id AS snapshot_id, :text AS description, :rows AS rows, :schema AS schema, current_timestamp() AS saved_at",
                     args={"id": snapshot_id, "text": description, "rows": int(seen.get["rows"]), "schema": df.schema.json()})
    line.select("snapshot_id", "description", F.col("rows").cast("long"), "schema", "saved_at").write.mode("append").parquet(f"{root}/manifest")
    return snapshot_id


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """The manifest (snapshot_id, description, rows, schema, saved_at), newest first; no rows where nothing was saved yet."""
    try:
        lines = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    except AnalysisException:
        lines = spark.createDataFrame([], MANIFEST)
    return lines.orderBy(F.col("snapshot_id").desc())


def load_snapshot(spark: SparkSession, root: str, snapshot_id: str) -> DataFrame:
    """One snapshot with the schema it was saved with, also if it has no rows; ValueError if there is none."""
    line = list_snapshots(spark, root).where(F.col("snapshot_id") == snapshot_id).first()
    if line is None:
        raise ValueError(f"no snapshot {snapshot_id}")
    schema = T.StructType.fromJson(json.loads(line["schema"]))
    every = spark.read.schema(T.StructType([*schema.fields, T.StructField("snapshot_id", T.StringType())])).parquet(f"{root}/data")
    return every.filter(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")  # the other snapshots' files are not opened


def restore_snapshot(spark: SparkSession, root: str, snapshot_id: str, active: str) -> DataFrame:
    load_snapshot(spark, root, snapshot_id).write.mode("overwrite").parquet(active)
    return spark.read.parquet(active)


def preview(df: DataFrame, *order: str, rows: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(rows)


def apply_corrections(df: DataFrame, corrections: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Set single cells: corrections are (keys..., column, new_value), one join for all columns."""
    wide = corrections.groupBy(*keys).agg(
        *[F.max(F.when(F.col("column") == c, F.col("new_value"))).alias(f"_fix_{c}") for c in columns]
    )
    out = df.join(wide, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(f"_fix_{c}"), F.col(c)) for c in columns}).drop(*[f"_fix_{c}" for c in columns])
