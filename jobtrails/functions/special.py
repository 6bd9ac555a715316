"""Special functions as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 8


def lgamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: below 16 the argument is raised by SHIFT with the
    recurrence (one product, one logarithm), then the Stirling series
    (relative error under 1e-12)."""
    def stirling(y: Column) -> Column:
        f = 1 / (y * y)
        series = (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f * (1 / 1680 - f / 1188)))) / y
        return (y - 0.5) * F.log(y) - y + F.lit(0.5 * math.log(2 * math.pi)) + series

    raised = x
    for i in range(1, SHIFT):
        raised = raised * (x + i)
    return F.when(x >= 16, stirling(x)).otherwise(stirling(x + SHIFT) - F.log(raised))


def exact_sum(x: Column) -> Column:
    """Sum of doubles as decimals of 12 places: the same to the last bit
    whatever the order in which tasks add."""
    return F.sum(x.cast("decimal(30,12)")).cast("double")
