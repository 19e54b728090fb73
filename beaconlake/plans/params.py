"""Request parameters: times, ranges, steps and limits."""

from __future__ import annotations

import math
import re
from datetime import UTC, datetime, timedelta

from beaconlake.plans.model import ApiError, Window

_EPOCH = datetime(1970, 1, 1)
_RFC3339 = re.compile(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(\.\d+)?([Zz]|[+-]\d\d:\d\d)")


def now() -> datetime:
    return datetime.now(UTC).replace(tzinfo=None)


def parse_time(raw: str) -> datetime | None:
    """RFC 3339; a whole number of seconds, or of nanoseconds above 1e13; or seconds with a fraction. Naive UTC."""
    if m := _RFC3339.fullmatch(raw):
        try:
            at = datetime.fromisoformat(f"{m[1]}T{m[2]}{(m[3] or '')[:7]}{m[4].upper().replace('Z', '+00:00')}")
            return at.astimezone(UTC).replace(tzinfo=None)
        except ValueError:
            return None
    try:
        if re.fullmatch(r"[+-]?\d+", raw):
            n = int(raw)
            if abs(n) >= 1 << 63:
                return None
            return _EPOCH + (timedelta(microseconds=n // 1000) if n > 10**13 else timedelta(seconds=n))
        seconds = float(raw)
        return _EPOCH + timedelta(microseconds=math.trunc(seconds * 1e6)) if math.isfinite(seconds) else None
    except (ValueError, OverflowError):
        return None


def _at(params: dict[str, str], name: str) -> datetime | None:
    raw = params.get(name)
    if not raw:
        return None
    at = parse_time(raw)
    if at is None:
        raise ApiError(400, "invalid_time_range", f"{name} must be RFC 3339, Unix seconds, or Unix nanoseconds")
    return at


def required(params: dict[str, str], name: str) -> str:
    if not params.get(name):
        raise ApiError(400, "missing_parameter", f"{name} is required")
    return params[name]


def time(params: dict[str, str], name: str, default: datetime) -> datetime:
    return _at(params, name) or default


def required_time(params: dict[str, str], name: str) -> datetime:
    required(params, name)
    return _at(params, name)


def check_range(start: datetime, end: datetime, most: timedelta) -> Window:
    if end <= start:
        raise ApiError(400, "invalid_time_range", "the end must be after the start")
    if int((end - start).total_seconds()) > most.total_seconds():
        raise ApiError(400, "range_too_large", f"the range is {end - start}, the most is {most}")
    return Window(start, end)


def optional_range(params: dict[str, str], most: timedelta) -> Window:
    """end or to, now by default; start or from, an hour before by default. Bad values of to and from are as if not given."""
    end = _at(params, "end") or parse_time(params.get("to", "")) or now()
    start = _at(params, "start") or parse_time(params.get("from", "")) or end - timedelta(hours=1)
    return check_range(start, end, most)


def step(raw: str) -> int:
    if not re.fullmatch(r"[+-]?\d+", raw.removesuffix("s")):
        raise ApiError(400, "invalid_step", "step is a number of seconds, with or without s")
    return int(raw.removesuffix("s"))


def limit(raw: str | None, default: int, most: int) -> int:
    n = int(raw) if raw and re.fullmatch(r"\+?\d+", raw) else default
    if not 1 <= n <= most:
        raise ApiError(400, "limit_too_large", f"limit must be from 1 to {most}")
    return n
