import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panels import month_end  # noqa: E402
from seriesloom import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session(
        "tests", master="local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def make_panel(spark):
    """Panel from {series: [values]}; None skips the month."""

    def make(data, year=2020, keep_none=False):
        rows = [
            (s, month_end(i, year), None if v is None else float(v))
            for s, values in data.items()
            for i, v in enumerate(values)
            if keep_none or v is not None
        ]
        return spark.createDataFrame(rows, "series string, ds date, y double")

    return make
