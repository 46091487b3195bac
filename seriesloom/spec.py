"""How a table is read as a panel: which columns are the series key, the period and the value."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PanelSpec:
    """Column roles of a panel that holds one row per (series, period).

    Operators that order a whole series in one window rely on that grain: after the
    (series, period) aggregation a series can never hold more rows than the calendar has
    periods, so no hot series can blow up a task.
    """

    keys: tuple[str, ...] = ("series",)
    ds: str = "ds"
    y: str = "y"
    season: int = 12

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.ds)

    def latest_first(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(F.col(self.ds).desc())

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    @property
    def value(self) -> Column:
        return F.col(self.y)

    @property
    def period(self) -> Column:
        return F.col(self.ds)


DEFAULT = PanelSpec()
