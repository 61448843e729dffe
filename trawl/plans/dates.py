"""Date arguments as inclusive bounds in epoch seconds, by the wall clock of a given time zone."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

NOTHING = (0, 0)


def _add_months(year: int, month: int, n: int) -> tuple[int, int]:
    total = year * 12 + month - 1 + n
    return total // 12, total % 12 + 1


class Calendar:
    """Dates relative to a moment (an aware datetime)."""

    def __init__(self, now: datetime, tz: str = "UTC"):
        self.zone = ZoneInfo(tz)
        self.now = now.astimezone(self.zone)

    def _at(self, day: date) -> int:
        return int(datetime(day.year, day.month, day.day, tzinfo=self.zone).timestamp())

    def _span(self, first: date, after: date) -> tuple[int, int]:
        return self._at(first), self._at(after) - 1

    def _period(self, name: str) -> tuple[int, int] | None:
        today = self.now.date()
        day, last = timedelta(days=1), name.startswith("last")
        sunday = today - day * ((today.weekday() + 1) % 7)
        match name:
            case "today":
                return self._span(today, today + day)
            case "yesterday":
                return self._span(today - day, today)
            case "thisweek" | "lastweek":
                first = sunday - day * 7 * last
                return self._span(first, first + day * 7)
            case "thismonth" | "lastmonth":
                months = [date(*_add_months(today.year, today.month, k - last), 1) for k in (0, 1)]
                return self._span(*months)
            case "thisyear" | "lastyear":
                return self._span(date(today.year - last, 1, 1), date(today.year - last + 1, 1, 1))
        return None

    def _relative(self, n: int, unit: str) -> tuple[int, int]:
        d = self.now.date()
        unit = unit.removesuffix("s")
        try:
            if unit in ("day", "week"):
                first = d - timedelta(days=n * (7 if unit == "week" else 1))
            elif unit in ("month", "year"):
                y, m = _add_months(d.year, d.month, -n * (12 if unit == "year" else 1))
                first = date(y, m, 1) + timedelta(days=d.day - 1)  # the 31st of a short month runs over, as in C
            else:
                return NOTHING
        except (OverflowError, ValueError):
            return NOTHING
        return self._at(first), int(self.now.timestamp())

    def bounds(self, text: str) -> tuple[int, int] | None:
        """First and last second of a period; (0, 0) if it is none, None if a month or day is no number."""
        text = text.lower()
        if period := self._period(text):
            return period
        if m := re.match(r"last(\d+)(.*)$", text):
            return self._relative(int(m[1]), m[2])
        if text.startswith("last"):
            return NOTHING
        m = re.match(r"(\d{4})-(..)-(..)", text) or re.match(r"(\d{4})-(..)", text) or re.match(r"(\d{4})", text)
        if not m:
            return NOTHING
        if not all(p.isdigit() for p in m.groups()):
            return None
        year, *rest = map(int, m.groups())
        try:
            if not rest:
                return self._span(date(year, 1, 1), date(year + 1, 1, 1))
            # Months and days out of range run over into the next, as in C's calendar.
            first = date(*_add_months(year, 1, rest[0] - 1), 1)
            if len(rest) == 1:
                return self._span(first, date(*_add_months(first.year, first.month, 1), 1))
            first += timedelta(days=rest[1] - 1)
            return self._span(first, first + timedelta(days=1))
        except (OverflowError, ValueError):
            return NOTHING

    def comparison(self, argument: str) -> tuple[str, int, int] | None:
        """Operator and bounds of a date argument; None stands for an argument that matches nothing."""
        if not argument:
            return "=", 0, 0
        if ".." in argument:
            left, right = (self.bounds(a) for a in argument.split("..", 1))
            return None if left is None or right is None else ("..", left[0], right[1])
        op = re.match(r"[<>]=?|", argument)[0]
        found = self.bounds(argument[len(op) :])
        if found is None:
            return None
        return (op, found[op in (">", "<=")], 0) if op else ("..", *found)
