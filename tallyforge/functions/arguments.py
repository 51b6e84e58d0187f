"""Checks of scalar arguments, made before a plan is built."""

from __future__ import annotations

import re
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

_FORMS = ((r"\d{8}", "%Y%m%d"), (r"\d{14}", "%Y%m%d%H%M%S"), (r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d", "%Y-%m-%dT%H:%M:%S"))


def time_ms(value: int | str | None, tz: str | None = None, is_until: bool = False) -> int | None:
    """A time argument as epoch milliseconds. Integers are milliseconds; texts are those of
    ``normalize_times``. A local time that a clock change makes ambiguous is an error."""
    if value is None or isinstance(value, int):
        return value
    text = value.strip()
    for form, pattern in _FORMS:
        if re.fullmatch(form, text):
            at = datetime.strptime(text, pattern)
            if form == r"\d{8}" and is_until:
                at = at.replace(hour=23, minute=59, second=59)
            zone = ZoneInfo(tz or "UTC")
            first, second = (at.replace(tzinfo=zone, fold=k) for k in (0, 1))
            if first.utcoffset() != second.utcoffset():
                raise ValueError(f"{value} is ambiguous or absent in {tz}")
            return int(first.timestamp() * 1000)
    if re.fullmatch(r"\d{13}", text):
        return int(text)
    if re.fullmatch(r"\d{1,12}", text):
        return int(text) * 1000
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        at = None
    if at is None or at.tzinfo is None:
        raise ValueError(f"not a time: {value!r}")
    return int(at.astimezone(timezone.utc).timestamp() * 1000)
