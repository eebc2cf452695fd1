"""Times and durations as the query APIs spell them."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from fractions import Fraction

_RFC3339 = re.compile(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d+))?(Z|[+-]\d\d:\d\d)")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
#: Nanoseconds of the units of a duration.
_UNITS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "m": 60_000_000_000, "h": 3_600_000_000_000, "d": 86_400_000_000_000, "w": 604_800_000_000_000, "y": 31_536_000_000_000_000}


class ParamError(ValueError):
    pass


def _rfc3339_ns(text: str) -> int:
    m = _RFC3339.fullmatch(text)
    if not m:
        raise ParamError(f"invalid time {text!r}")
    try:
        at = datetime.fromisoformat(m[1] + m[3].replace("Z", "+00:00"))
    except ValueError as e:
        raise ParamError(f"invalid time {text!r}") from e
    whole = (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(seconds=1)
    return whole * 10**9 + int((m[2] or "0")[:9].ljust(9, "0"))


def prom_time_ms(text: str | None, default: int | None = None) -> int | None:
    """Milliseconds of Unix seconds (with or without a fraction, or an exponent) or of an RFC 3339 time; default for none."""
    text = (text or "").strip()
    if not text:
        return default
    if _NUMBER.fullmatch(text):
        return int(Fraction(text) * 1000)
    return _rfc3339_ns(text) // 10**6


def loki_time_ns(text: str | None, default: int | None = None) -> int | None:
    """Nanoseconds: an integer is taken as it is, a number with a point as seconds (exactly, digits after the ninth are dropped), else RFC 3339."""
    text = (text or "").strip()
    if not text:
        return default
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    m = re.fullmatch(r"([+-]?)(\d+)\.(\d*)", text)
    if m:
        size = int(m[2]) * 10**9 + int(m[3][:9].ljust(9, "0"))
        return -size if m[1] == "-" else size
    return _rfc3339_ns(text)


def duration_ms(text: str) -> int:
    """Milliseconds of 15s, 1m30s, 1.5h, 2d, or of a plain number of seconds."""
    text = text.strip()
    if not text:
        raise ParamError("empty duration")
    if _NUMBER.fullmatch(text):
        return int(Fraction(text) * 1000)
    parts = re.fullmatch(r"([+-]?)((?:(?:\d+\.?\d*|\.\d+)(?:ns|us|µs|ms|s|m|h|d|w|y))+)", text)
    if not parts:
        raise ParamError(f"bad duration {text!r}")
    ns = sum(Fraction(n) * _UNITS[u] for n, u in re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|ms|s|m|h|d|w|y)", parts[2]))
    return int(ns / 10**6) * (-1 if parts[1] == "-" else 1)


def prom_range(start: str | None, end: str | None, step: str, first: int, last: int, most: int = 11_000) -> tuple[int, int, int]:
    """(start, end, step) in milliseconds of a range query; open ends are those of what is stored. At most `most` steps."""
    a, b, s = prom_time_ms(start, first), prom_time_ms(end, last), duration_ms(step)
    if s <= 0:
        raise ParamError("the step must be positive")
    if b < a:
        raise ParamError("the end is before the start")
    if (b - a) // s + 1 > most:
        raise ParamError(f"more than {most} steps")
    return a, b, s
