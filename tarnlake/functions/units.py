"""Sizes and durations in configuration text. Malformed ones raise ValueError and are never taken for zero."""

from __future__ import annotations

import re

SIZES = {"B": 1, "KB": 1024, "MB": 1024**2, "GB": 1024**3}
SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}
_MOST = 2**64 - 1


def _parse(text: str, units: dict[str, int], bare: int) -> int:
    m = re.fullmatch(r"\s*([0-9]+)\s*([A-Za-z]*)\s*", text)
    if not m or (m[2] and m[2] not in units):
        raise ValueError(f"not a quantity: {text!r}")
    n = int(m[1]) * (units[m[2]] if m[2] else bare)
    if n > _MOST:
        raise ValueError(f"too large: {text!r}")
    return n


def parse_size(text: str) -> int:
    """Bytes of a size such as 5MB; a bare number is bytes."""
    return _parse(text.upper(), SIZES, 1)


def parse_duration(text: str) -> int:
    """Seconds of a duration such as 7d; a bare number is seconds."""
    return _parse(text, SECONDS, 1)


def show_duration(seconds: int) -> str:
    """In the largest unit that divides evenly."""
    unit = next(u for u in ("w", "d", "h", "m", "s") if seconds % SECONDS[u] == 0 and (seconds or u == "s"))
    return f"{seconds // SECONDS[unit]}{unit}"
