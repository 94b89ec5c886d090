"""Settings from the environment: a value that is not of its kind gives the default; so does a number under 1, where other readers take 1."""

from __future__ import annotations

import os
from collections.abc import Mapping

_TRUE, _FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def positive_int(name: str, default: int, values: Mapping[str, str] = os.environ) -> int:
    text = values.get(name, "").strip()
    return int(text) if text.isdecimal() and int(text) > 0 else default


def positive_float(name: str, default: float, values: Mapping[str, str] = os.environ) -> float:
    try:
        value = float(values.get(name, ""))
    except ValueError:
        return default
    return value if 0 < value < float("inf") else default


def boolean(name: str, default: bool, values: Mapping[str, str] = os.environ) -> bool:
    text = values.get(name, "").strip().lower()
    return text in _TRUE if text in _TRUE | _FALSE else default
