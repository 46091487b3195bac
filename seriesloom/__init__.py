"""Keyed time-series analytics and forecasting as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the job, so that executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from .engine import PanelEngine  # noqa: E402
from .session import build_session  # noqa: E402
from .spec import PanelSpec  # noqa: E402

__all__ = ["PanelEngine", "PanelSpec", "build_session"]
