"""Scalar helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_round(x: Column, digits: int) -> Column:
    """Round half away from zero, after dropping noise beyond nine digits.

    Distributed sums depend on the order of their partial sums; going through whole billionths
    makes the result the same for every partitioning. All of it is plain arithmetic on doubles, the
    same for values of any size.
    """
    x = x.cast("double")
    step = float(10 ** (9 - digits))
    near = F.abs(x) * F.lit(1e9) + F.lit(0.5)
    billionths = near - F.pmod(near, F.lit(1.0))
    if digits < 9:
        half = billionths + F.lit(step / 2)
        billionths = half - F.pmod(half, F.lit(step))
    # + 0.0 turns a negative zero into zero
    return F.signum(x) * (billionths / F.lit(step)) / F.lit(float(10**digits)) + F.lit(0.0)


def stable_round_array(x: np.ndarray, digits: int) -> np.ndarray:
    """:func:`stable_round` of an array, to the same numbers."""
    step = float(10 ** (9 - digits))
    half = np.floor(np.abs(x) * 1e9 + 0.5) + (step / 2 if digits < 9 else 0.0)
    return np.sign(x) * ((half - np.fmod(half, step) if digits < 9 else half) / step) / float(10**digits) + 0.0


def js_round(x: Column) -> Column:
    """Round half towards positive infinity."""
    return F.floor(x + F.lit(0.5))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def text_or(x: Column, default: str) -> Column:
    """NULL and '' become ``default``."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once.

    Lambdas of array functions evaluate what they capture anew for every element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))
