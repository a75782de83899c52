"""Seeded draws. A row's draw depends on the seed and its key only, never on partitioning or retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int | str, *keys: Column | str) -> Column:
    """Uniform text key: 32 hex digits. Rows sorted by it are in random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in keys]))


def draw_int(key: Column, n: int | Column) -> Column:
    """Uniform integer in ``[0, n)`` from a draw (its first 32 bits)."""
    top = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    return F.pmod(top, (F.lit(n) if isinstance(n, int) else n).cast("bigint"))
