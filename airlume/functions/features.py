"""Column expressions on the flat 1,116-element grid arrays of one sample."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from airlume.functions.geometry import GRID_CELLS, GRID_COLS, GRID_M


def path_step(distance: Column) -> Column:
    """Metres per path step, as the slope and footprint operators use it."""
    return distance / (GRID_M - 1)


def _slope_angle(gradient: Column) -> Column:
    return F.atan(gradient) / (math.pi / 2)


def slope_array(height: Column, step: Column) -> Column:
    """Slope along the path in [-1, 1]: central differences, one-sided at both ends.

    The neighbours come as shifted copies, cut and joined per grid row (31 times a sample);
    only a difference and an angle are left to do per element, since lambdas are interpreted.
    """
    starts = F.sequence(F.lit(1), F.lit(GRID_CELLS), F.lit(GRID_COLS))
    inner = GRID_COLS - 1
    left = F.flatten(F.transform(starts, lambda k: F.concat(F.slice(height, k, 1), F.slice(height, k, inner))))
    right = F.flatten(F.transform(starts, lambda k: F.concat(F.slice(height, k + 1, inner), F.slice(height, k + inner, 1))))
    steps = F.lit([1.0, *[2.0] * (GRID_COLS - 2), 1.0])
    spans = F.flatten(F.array_repeat(F.transform(steps, lambda n: n * F.when(step > 0, step)), GRID_CELLS // GRID_COLS))
    return F.zip_with(F.zip_with(right, left, lambda b, a: b - a), spans, lambda d, span: _slope_angle(d / span))


def scale_height(height: Column) -> Column:
    return (height + 500) / 1000


def scale_slope(slope: Column) -> Column:
    """Divides by pi/2 a second time, as the stored models expect."""
    return slope / (math.pi / 2)


def scale_thousand(value: Column) -> Column:
    return value / 1000


def rotate_grid(values: Column) -> Column:
    """Turn the grid by 180 degrees: both axes reversed."""
    return F.reverse(values)
