"""Dates of the hand-made panels."""

import datetime as dt


def month_end(i, year=2020):
    """The i-th month end counted from January of `year`."""
    y, m = year + (i + 1) // 12, (i + 1) % 12
    return dt.date(y, m + 1, 1) - dt.timedelta(days=1)
