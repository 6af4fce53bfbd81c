"""Periods of a report, fixed while a plan is built. `as_of` is always a parameter."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Period:
    """The days before as_of, or one calendar day."""

    as_of: dt.date
    days: int
    day: dt.date | None = None

    def holds(self, ts: Column) -> Column:
        """A range that a scan can use."""
        midnight = lambda d: F.lit(dt.datetime.combine(d, dt.time()))
        if self.day is None:
            return ts >= midnight(self.as_of - dt.timedelta(days=self.days))
        return (ts >= midnight(self.day)) & (ts < midnight(self.day + dt.timedelta(days=1)))

    def label(self) -> str:
        if self.day is not None or self.days == 1:
            day = self.day or self.as_of
            return f"{'сегодня' if day == self.as_of else 'вчера'}, {day:%d.%m.%Y}"
        return f"последние {self.days} {'дня' if self.days == 3 else 'дней'}"


def period(token: str | None, as_of: dt.date, default_days: int = 7) -> Period:
    """today, yesterday, or a number of days from 1 to 365; anything else is the default."""
    word = (token or "").strip().lower()
    if word in ("today", "yesterday"):
        back = int(word == "yesterday")
        return Period(as_of, 1 + back, as_of - dt.timedelta(days=back))
    return Period(as_of, max(1, min(int(word) if word.isdigit() else default_days, 365)))
