"""Encoder of dates and times."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.errors import require
from quillon.functions.kernels import shifted

from .base import Encoder
from .numeric import ScalarEncoder

DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]


@dataclass
class DateEncoder(Encoder):
    """Blocks for season, day of week, weekend, custom days, holidays and time of day, in this order; width 0 leaves one out.

    A weekend is Saturday, Sunday, or Friday from 18:00. A holiday counts 1 on its day, ramps up over the day before and
    on to 2 over the day after. Holidays are (month, day) of the value's own year, or (year, month, day).
    """

    season_width: int = 0
    day_of_week_width: int = 0
    weekend_width: int = 0
    custom_width: int = 0
    holiday_width: int = 0
    time_of_day_width: int = 0
    season_radius: float = 91.5
    day_of_week_radius: float = 1.0
    time_of_day_radius: float = 4.0
    custom_days: list[str] = field(default_factory=list)
    holidays: list[tuple[int, ...]] = field(default_factory=lambda: [(12, 25)])

    def __post_init__(self):
        for h in self.holidays:
            require(len(h) in (2, 3) and 1 <= h[-2] <= 12 and 1 <= h[-1] <= 31, "holidays", f"bad date {h}")
        require(not self.custom_width or bool(self.custom_days), "custom_days", "give at least one")
        require(all(d.lower() in DAYS for d in self.custom_days), "custom_days", "unknown day")

        def ring(top, width, radius):
            return ScalarEncoder(0.0, top, 0, width, radius, periodic=True) if width else None

        def flag(width):
            return ScalarEncoder(0.0, 1.0, 0, width, category=True) if width else None

        self.blocks = [
            ("season", ring(366.0, self.season_width, self.season_radius)),
            ("day_of_week", ring(7.0, self.day_of_week_width, self.day_of_week_radius)),
            ("weekend", flag(self.weekend_width)),
            ("custom", flag(self.custom_width)),
            ("holiday", ring(2.0, self.holiday_width, 1.0)),
            ("time_of_day", ring(24.0, self.time_of_day_width, self.time_of_day_radius)),
        ]
        self.blocks = [(n, e) for n, e in self.blocks if e is not None]
        require(bool(self.blocks), "width", "give at least one block a width")
        self.size = sum(e.size for _, e in self.blocks)

    def holiday(self, ts: Column) -> Column:
        day, value = 86_400.0, F.lit(0.0)
        seconds = F.unix_timestamp(ts.cast("timestamp"))
        for h in reversed(self.holidays):
            year = F.lit(h[0]) if len(h) == 3 else F.year(ts)
            since = (seconds - F.unix_timestamp(F.make_date(year, F.lit(h[-2]), F.lit(h[-1])).cast("timestamp"))).cast("double")
            near = F.when((since >= 0) & (since < day), F.lit(1.0)).when((since >= day) & (since < 2 * day), since / day).when((since < 0) & (since > -day), 1.0 + since / day)
            value = F.coalesce(near, value)
        return value

    def values(self, ts: Column) -> dict[str, Column]:
        """The number that each block encodes."""
        weekday, hour = F.weekday(ts), F.hour(ts)  # Monday is 0
        custom = [DAYS.index(d.lower()) for d in self.custom_days]
        return {
            "season": (F.dayofyear(ts) - 1).cast("double"),
            "day_of_week": weekday.cast("double"),
            "weekend": ((weekday >= 5) | ((weekday == 4) & (hour >= 18))).cast("double"),
            "custom": weekday.isin(custom).cast("double") if custom else F.lit(0.0),
            "holiday": self.holiday(ts),
            "time_of_day": hour + F.minute(ts) / F.lit(60.0) + F.second(ts) / F.lit(3600.0),
        }

    def encode(self, ts: Column) -> Column:
        """ts: a timestamp; numbers count as epoch seconds if they are cast to timestamp before."""
        parts, offset, values = [], 0, self.values(ts)
        for name, e in self.blocks:
            parts.append(shifted(e.encode(values[name]), offset))
            offset += e.size
        return F.when(ts.isNotNull(), F.concat(*parts))
