"""Numeric column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wakeline.schema import KELLY_CAP, KELLY_DIVISOR, PAYBACK_RATE, TICKET_YEN

def interp(value: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise-linear interpolation through the knots, flat outside them.

    The bracket is found by binary search, whatever the number of knots.
    """
    xs, ys = [float(x) for x in xs], [float(y) for y in ys]
    if not xs or len(xs) != len(ys):
        raise ValueError("knots need equally many x and y values")
    if any(b < a for a, b in zip(xs, xs[1:])):
        raise ValueError("x knots must ascend")

    if len(xs) == 1:
        inner = F.lit(ys[0])
    else:
        knots_x, knots_y = F.lit(xs), F.lit(ys)
        # binary search for the last knot at or below the value, by halving steps
        steps = [1 << k for k in reversed(range((len(xs) - 1).bit_length()))]
        i = F.aggregate(F.lit(steps), F.lit(0), lambda lo, step: F.when(
            F.get(knots_x, lo + step) <= value, lo + step).otherwise(lo))

        def segment(i: Column) -> Column:
            x0, x1 = F.get(knots_x, i), F.get(knots_x, i + 1)
            y0, y1 = F.get(knots_y, i), F.get(knots_y, i + 1)
            return F.when(x1 == x0, y1).otherwise(F.try_divide(y1 - y0, x1 - x0) * (value - x0) + y0)

        # a one-element list binds the position for the four reads
        inner = F.get(F.transform(F.array(i), segment), F.lit(0))
    clipped = F.when(value <= xs[0], ys[0]).when(value >= xs[-1], ys[-1]).otherwise(inner)
    return F.when(value.isNotNull() & ~F.isnan(value), clipped).otherwise(value)


def kelly_fraction(
    p: Column, payout: Column, *, divisor: float = KELLY_DIVISOR, cap: float = KELLY_CAP
) -> Column:
    """Fractional Kelly stake as a share of the bankroll, in [0, cap]."""
    b = payout.cast("double") / TICKET_YEN - 1.0
    full = F.when(b > 0, F.try_divide(p * b - (1.0 - p), b))
    usable = F.when(~F.isnan(full) & (F.abs(full) != F.lit(float("inf"))), full)
    return F.least(F.greatest(F.coalesce(usable, F.lit(0.0)) / divisor, F.lit(0.0)), F.lit(cap))


def implied_probability(price: Column, payback: float = PAYBACK_RATE) -> Column:
    """Market probability behind a price; NULL for a price that is not positive."""
    return F.when(price > 0, F.lit(payback) / price)
