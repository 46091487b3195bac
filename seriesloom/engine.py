"""The whole chain in one object: load, clean, fit, rank, predict, replay, check drift, save."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .models import board, factor, smoothing
from .operators import align, clean, drift, report, scenario, selection
from .session import ensure_checkpoint_dir
from .spec import DEFAULT, PanelSpec


class PanelEngine:
    """Works on a panel (series, ds, y) and an optional monthly indicator table (ds, ...).

    The cleaned panel and the hold-out predictions are kept as checkpoints: they are read by every
    later step, are small next to the raw data and survive lost executors.
    """

    def __init__(self, panel: DataFrame, indicators: DataFrame | None = None, spec: PanelSpec = DEFAULT):
        self.spec, self.indicators = spec, indicators
        ensure_checkpoint_dir(panel.sparkSession)
        # one row per series and date: amounts of the same date add up, nulls stay null
        grain = panel.groupBy(*spec.keys, spec.ds).agg(F.sum(spec.y).alias(spec.y))
        self.panel = clean.densify(grain, "ffill", spec).checkpoint()
        self.cols = [c for c in indicators.columns if c != spec.ds] if indicators is not None else []

    def repair(self, threshold: float = 2.5) -> int:
        """Replace outliers in the panel; gives their number."""
        fixed = clean.repair_outliers(self.panel, threshold, self.spec).checkpoint()
        self.panel = fixed.withColumn(self.spec.y, F.col("y_fixed")).drop("y_fixed", "is_fixed")
        return fixed.filter("is_fixed").count()

    def families(self, grid: Sequence[tuple[float, float, float]] = smoothing.GRID) -> tuple[board.Family, ...]:
        """The closed-form families, with the indicators' one where there are indicators."""
        known = board.closed_form(grid)
        return (*known, board.seasonal_x(self.indicators, self.cols)) if self.indicators is not None else known

    def fit(self, horizon: int = 12, grid: Sequence[tuple[float, float, float]] = smoothing.GRID, families: Sequence[board.Family] | None = None, ahead: int = 24) -> DataFrame:
        """Hold-out and future predictions of all families, kept as one candidate table; gives the leaderboard.

        `gate` holds the reason where a series is too short for a family or for its ranking. Learners that are trained over all series
        can be added: `fit(families=[*engine.families(), board.pooled_learner("gbt")])`.
        """
        families = tuple(families or self.families(grid))
        self.ahead = ahead
        self.gate = board.gate(self.panel, families, horizon, self.spec)
        self.board = board.candidates(self.panel, families, horizon, ahead, self.spec).checkpoint()
        self.holdout = board.holdout_rows(self.board, self.spec)
        return selection.leaderboard(self.holdout, self.spec)

    def candidates(self, horizon: int) -> DataFrame:
        """Future rows of all families, as far as they were made by `fit`."""
        if horizon > self.ahead:
            raise ValueError(f"fit() looked {self.ahead} steps ahead")
        return board.future_rows(self.board, horizon, self.spec)

    def predict(self, horizon: int = 12, levels: DataFrame | None = None, strategy: str = "auto", manual: str | None = None,
                members: Sequence[str] = (), weights: Mapping[str, float] | None = None) -> DataFrame:
        """Forecast frame (series, ds, yhat, lo, hi, model, reason).

        With `levels` (scenario, indicator, op, arg) the forecast is moved by the indicator response
        and gets a `scenario` column.
        """
        preds = self.candidates(horizon).drop("step")
        out = selection.forecast_by_strategy(preds, self.holdout, strategy, manual, members, weights, spec=self.spec)
        if levels is None:
            return out
        moved = scenario.score(out, self.betas(), scenario.apply_levels(self.levels(), levels), self.spec)
        keep = out.select(*self.spec.keys, self.spec.ds, "model", "reason")
        return moved.join(keep, [*self.spec.keys, self.spec.ds])

    def levels(self) -> DataFrame:
        return report.last_row_levels(self.indicators, self.cols, self.spec.ds)

    def betas(self) -> DataFrame:
        merged = align.merge_indicators(self.panel, self.indicators, "inner", spec=self.spec)
        return scenario.response(merged, self.cols, self.spec)

    def replay(self, horizon: int = 12) -> DataFrame:
        """Mean and percentile bands of the forecast over all past moves of the indicators."""
        long = self.indicators.unpivot([self.spec.ds], self.cols, "indicator", "value")
        fc = factor.trend_factor(self.panel, horizon, self.spec)
        paths = scenario.replay_paths(long, self.levels(), horizon, self.spec.ds)
        return scenario.bands_of_cube(scenario.replay_cube(fc, self.betas(), self.levels(), paths, self.spec), self.spec)

    def tornado(self, horizon: int = 12) -> DataFrame:
        return scenario.tornado(self.betas(), self.levels(), horizon)

    def check_drift(self, future: DataFrame, threshold: float = 0.05) -> DataFrame:
        """KS report of every indicator that the history and a future table share."""
        cols = [c for c in self.cols if c in future.columns]
        past = self.indicators.select(F.lit(0).alias("sample"), *cols)
        both = past.unionByName(future.select(F.lit(1).alias("sample"), *cols))
        return drift.drift_report(both.unpivot(["sample"], cols, "feature", "value"), threshold)

    def combined(self, forecast: DataFrame) -> DataFrame:
        return report.combine(self.panel, forecast.withColumnRenamed("yhat", self.spec.y))

    def save_results(self, forecast: DataFrame, path: str) -> None:
        self.combined(forecast).write.mode("overwrite").parquet(path)
