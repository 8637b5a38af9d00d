"""Periods of months: validation, clamping to the archive, presets."""

from __future__ import annotations

import re
from dataclasses import dataclass

_MONTH = re.compile(r"\d{4}-(?:0[1-9]|1[0-2])")


@dataclass(frozen=True)
class Period:
    """Months from ``first`` to ``last``, both included."""

    first: str
    last: str

    def __post_init__(self) -> None:
        for month in (self.first, self.last):
            if not _MONTH.fullmatch(month):
                raise ValueError(f"{month!r} is no month")
        if self.first > self.last:
            raise ValueError("a period ends before it begins")

    def within(self, archive: Period) -> Period | None:
        """The part of the period that the archive covers; None if it covers none."""
        first, last = max(self.first, archive.first), min(self.last, archive.last)
        return Period(first, last) if first <= last else None


def shifted(month: str, by: int) -> str:
    number = int(month[:4]) * 12 + int(month[5:]) - 1 + by
    return f"{number // 12:04d}-{number % 12 + 1:02d}"


def presets(archive: Period) -> dict[str, Period]:
    """The whole archive, its last year and quarter, and its last session (from October), within the archive."""
    last = archive.last
    session = f"{int(last[:4]) - (last[5:] < '10'):04d}-10"
    named = {"all": archive.first, "year": shifted(last, -11), "quarter": shifted(last, -2), "session": session}
    return {name: Period(max(first, archive.first), last) for name, first in named.items()}
