"""Pitch coordinates: every provider's units become 0..100 along and across the attack."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: each provider's pitch length and width
STATSBOMB_PITCH = (120.0, 80.0)
METRICA_PITCH = (1.0, 1.0)
WYSCOUT_PITCH = (100.0, 100.0)


def finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def on_pitch(x: Column, y: Column, length: float, width: float) -> Column:
    """Whether a point lies on the pitch, bounds included; null for a missing point."""
    return finite(x) & finite(y) & x.between(0.0, length) & y.between(0.0, width)


def canonical(x: Column, y: Column, length: float, width: float, right_to_left: Column | None = None) -> tuple[Column, Column]:
    """x / length * 100 and y / width * 100, in this order of operations; attacks to the left are turned around in x."""
    if not (length > 0 and width > 0 and length < float("inf") and width < float("inf")):
        raise ValueError("Pitch dimensions must be finite and positive")
    along = x / F.lit(length) * F.lit(100.0)
    across = y / F.lit(width) * F.lit(100.0)
    return (along if right_to_left is None else F.when(right_to_left, F.lit(100.0) - along).otherwise(along)), across


def attacks_left(team: Column, period: Column, home_left_to_right: Column) -> Column:
    """A side's direction of attack: the visitors' is the other one, and both change for the second half."""
    flips = F.when(team == "Away", 1).otherwise(0) + F.when(period == 2, 1).otherwise(0) + F.when(home_left_to_right, 0).otherwise(1)
    return flips % 2 == 1
