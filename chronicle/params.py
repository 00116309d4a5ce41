"""Parameters shared by every insight operator."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from zoneinfo import ZoneInfo

GRANULARITIES = ("day", "week", "month", "year")


@dataclass(frozen=True)
class Params:
    """Inclusive local dates, a result limit, a bucket size, a zone and a currency.

    `currency=None` means the most frequent currency in range. `as_of` replaces "today" where a
    result depends on it, so that a run can be repeated.
    """

    date_from: date | None = None
    date_to: date | None = None
    top_n: int = 10
    granularity: str = "month"
    tz: str = "UTC"
    currency: str | None = None
    as_of: date | None = None

    def __post_init__(self) -> None:
        if self.top_n < 1:
            raise ValueError("top_n must be at least 1")
        if self.granularity not in GRANULARITIES:
            raise ValueError(f"granularity must be one of {', '.join(GRANULARITIES)}")
        if self.date_from and self.date_to and self.date_from > self.date_to:
            raise ValueError("date_from must not be after date_to")
        ZoneInfo(self.tz)
