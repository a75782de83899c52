"""Value ranges of a hyperparameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def linear_range(low: Column, high: Column, n: int) -> Column:
    """``n`` evenly spaced values from low to high, both included, as an array."""
    low, span = low.cast("double"), high.cast("double") - low.cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + (i * span) / F.lit(n - 1))


def geometric_range(low: Column, high: Column, n: int) -> Column:
    """``n`` values from low to high in constant ratio, as an array."""
    low, high = low.cast("double"), high.cast("double")
    ratio = F.pow(high / low, F.lit(1.0 / (n - 1)))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low * F.pow(ratio, i))
