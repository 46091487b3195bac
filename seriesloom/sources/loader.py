"""Load a history and an optional indicator file into one merged, filled panel."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import indicator_columns
from ..operators.align import merge_indicators
from ..operators.quality import structure_problems
from ..spec import DEFAULT, PanelSpec
from . import files


class PanelLoader:
    """`load()` gives (series, ds, y, indicators...); facts about the load are in `metadata()`."""

    def __init__(self, spark: SparkSession, history: str, indicators: str | None = None, indicator_names: list[str] | None = None,
                 date_column: str = "Tanggal", min_rows: int = 12, spec: PanelSpec = DEFAULT):
        self.spark, self.spec = spark, spec
        self.history_path, self.indicator_path = history, indicators
        self.indicator_names, self.date_column, self.min_rows = indicator_names or [], date_column, min_rows
        self.indicators: DataFrame | None = None
        self._seen = Observation("load")

    def load(self) -> DataFrame:
        started = time.time()
        history = files.read_history(self.spark, self.history_path).filter(F.col("ds").isNotNull())
        problems = structure_problems(history, [*self.spec.keys, self.spec.ds, self.spec.y], self.min_rows)
        if problems:
            raise ValueError("; ".join(problems))
        if self.indicator_path:
            self.indicators = files.read_indicators(self.spark, self.indicator_path, self.date_column, self.indicator_names)
        merged = history if self.indicators is None else merge_indicators(history, self.indicators, fill=True, spec=self.spec)
        self.panel = merged.observe(
            self._seen, F.count("*").alias("rows"), F.min(self.spec.ds).alias("first"), F.max(self.spec.ds).alias("last")
        )
        self._duration = round(time.time() - started, 2)
        return self.panel

    def metadata(self) -> dict:
        """Rows and dates as seen by the first action on the panel, number of series, has-indicators, duration."""
        n = self.panel.select(*self.spec.keys).distinct().count()
        return {**self._seen.get, "n_series": n, "has_indicators": self.indicators is not None, "load_duration": self._duration}

    def series_names(self) -> DataFrame:
        return self.panel.select(*self.spec.keys).distinct()

    def one_series(self, name: str) -> DataFrame:
        return self.panel.filter(F.col(self.spec.keys[0]) == name).orderBy(self.spec.ds)

    def indicator_columns(self) -> list[str]:
        return indicator_columns(self.panel, (*self.spec.keys, self.spec.ds, self.spec.y))
