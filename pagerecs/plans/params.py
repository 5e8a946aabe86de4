"""Driver-side run parameters (D3-D5): validated before any Spark work."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


def running_date(today: dt.date | None = None, num_days: int = 1) -> dt.date:
    """The day a daily job processes: ``today - num_days`` (default:
    yesterday). ``today`` is evaluated per call, not at import."""
    if today is None:
        today = dt.date.today()
    if isinstance(today, dt.datetime):
        today = today.date()
    return today - dt.timedelta(days=num_days)


@dataclass(frozen=True)
class Snapshot:
    """A daily snapshot ``YYYY-MM-DD``; ``month`` gives the monthly
    ``YYYY-MM`` snapshot that names production partitions."""

    date: dt.date

    @classmethod
    def parse(cls, text: str) -> "Snapshot":
        if not isinstance(text, str):
            raise ValueError(f"snapshot must be a 'YYYY-MM-DD' string, got {text!r}")
        try:
            day = dt.datetime.strptime(text, "%Y-%m-%d").date()
        except ValueError as err:
            raise ValueError(f"snapshot must be 'YYYY-MM-DD', got {text!r}") from err
        return cls(day)

    @property
    def day_string(self) -> str:
        return self.date.isoformat()

    @property
    def month(self) -> str:
        return f"{self.date.year:04d}-{self.date.month:02d}"

    @property
    def year(self) -> int:
        return self.date.year

    @property
    def month_number(self) -> int:
        return self.date.month

    @property
    def day(self) -> int:
        return self.date.day

    def __str__(self) -> str:
        return self.day_string


def month_of(snapshot: "str | Snapshot") -> str:
    """Monthly snapshot ``YYYY-MM`` from a daily snapshot (``YYYY-MM-DD`` or a
    ``Snapshot``) or a monthly one, validated either way."""
    if isinstance(snapshot, Snapshot):
        return snapshot.month
    if isinstance(snapshot, str) and len(snapshot) == 7:
        try:
            dt.datetime.strptime(snapshot, "%Y-%m")
        except ValueError as err:
            raise ValueError(f"monthly snapshot must be 'YYYY-MM', got {snapshot!r}") from err
        return snapshot
    return Snapshot.parse(snapshot).month
