"""Sizes with suffixes."""

from __future__ import annotations

_POWERS = {"": 0, "k": 1, "m": 2, "g": 3}


def _sized(text: str, base: int) -> int:
    t = text.strip().lower().removesuffix("b").removesuffix("p")
    suffix = t[-1:] if t[-1:].isalpha() else ""
    if suffix not in _POWERS:
        raise ValueError(f"not a size: {text!r}")
    return int(float(t[: len(t) - len(suffix)]) * base ** _POWERS[suffix])


def memory_size(text: str) -> int:
    """`1K` is 1024."""
    return _sized(text, 1024)


def genome_size(text: str) -> int:
    """`1K` is 1000."""
    return _sized(text, 1000)
