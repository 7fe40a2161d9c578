"""Periods and calendar buckets, worked out before a plan is made; the present is always passed in."""

from __future__ import annotations

from calendar import monthrange
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

STEPS = ("day", "week", "month", "year")


@dataclass(frozen=True)
class Timeframe:
    """A half-open period [start, stop) as naive UTC times."""

    start: datetime
    stop: datetime

    @property
    def days(self) -> tuple[date, date]:
        """The period on rollups of a day: both ends cut to the UTC day."""
        return self.start.date(), self.stop.date()

    def before(self) -> Timeframe:
        """The period of equal length that ends where this one starts."""
        return Timeframe(self.start - (self.stop - self.start), self.start)

    @staticmethod
    def resolve(
        now: datetime,
        tz: str = "UTC",
        start: datetime | None = None,
        stop: datetime | None = None,
        year: int | None = None,
        month: int | None = None,
        week: int | None = None,
        period: str = "all_time",
    ) -> Timeframe:
        """Explicit ends before year and month, year and ISO week, year alone, then a named period."""
        zone = ZoneInfo(tz)

        def utc(d: datetime) -> datetime:
            return d.replace(tzinfo=zone).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)

        if start is not None and stop is not None:
            return Timeframe(start, stop)
        if year and month:
            a = datetime(year, month, 1)
            return Timeframe(utc(a), utc(add(a, "month")))
        if year and week:
            a = datetime.fromisocalendar(year, week, 1)
            return Timeframe(utc(a), utc(a + timedelta(7)))
        if year:
            return Timeframe(utc(datetime(year, 1, 1)), utc(datetime(year + 1, 1, 1)))
        local = now.replace(tzinfo=ZoneInfo("UTC")).astimezone(zone).replace(tzinfo=None)
        if period in STEPS:
            a = truncate(local, period)
            return Timeframe(utc(a), utc(add(a, period)))
        return Timeframe(datetime(1970, 1, 1), now + timedelta(1))


def add(t: datetime, step: str, n: int = 1) -> datetime:
    """``t`` moved by steps; months keep the day of the month as far as the month has it."""
    if step in ("day", "week"):
        return t + timedelta(n * (7 if step == "week" else 1))
    months = t.month - 1 + n * (12 if step == "year" else 1)
    y, m = t.year + months // 12, months % 12 + 1
    return t.replace(year=y, month=m, day=min(t.day, monthrange(y, m)[1]))


def truncate(t: datetime, step: str) -> datetime:
    """Start of the calendar unit; weeks begin on Monday."""
    day = t.replace(hour=0, minute=0, second=0, microsecond=0)
    if step == "week":
        return day - timedelta(day.weekday())
    return day.replace(day=1, **({"month": 1} if step == "year" else {})) if step in ("month", "year") else day


def bucket_starts(start: datetime, stop: datetime, step: str) -> list[datetime]:
    """Starts from ``start`` to ``stop``, that included, each one step from the last (so 31 January, 29 February, 29 March)."""
    out = [start]
    while (after := add(out[-1], step)) <= stop:
        out.append(after)
    return out if start <= stop else []


def calendar_weeks(start: date, stop: date) -> list[list[date]]:
    """The Monday-aligned weeks that cover [start, stop)."""
    first = start - timedelta(start.weekday())
    weeks = -(-(stop - first).days // 7)
    return [[first + timedelta(7 * w + d) for d in range(7)] for w in range(weeks)]
