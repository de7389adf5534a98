"""FIL-15: arguments that are checked when an operator is called, before any row is read."""

from __future__ import annotations


def positive(**values: float) -> None:
    for name, value in values.items():
        if not value > 0:
            raise ValueError(f"{name} must be above 0")


def non_negative(**values: float) -> None:
    for name, value in values.items():
        if not value >= 0:
            raise ValueError(f"{name} must be 0 or more")


def in_range(low: float, high: float, **values: float) -> None:
    for name, value in values.items():
        if not low <= value <= high:
            raise ValueError(f"{name} must be from {low} to {high}")
