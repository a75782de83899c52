"""The two dictionaries behind the entry point."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions as F

from fluxloom.session import ship_package

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function ``(spark, sf_dir) -> DataFrame`` and its SQL twin."""

    def wrap(fn):
        if name in QUERIES:
            raise KeyError(f"{name} is registered twice")

        @wraps(fn)
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


# Reported decimals: six. Means of short decimals often end in an exact half at the seventh place; the
# nudge keeps both engines on the same side of it. Adding 0 turns -0 into 0.
def r6(column):
    return F.round(column + F.lit(1e-10), 6) + F.lit(0.0)


def R6(sql: str) -> str:
    return f"(round(({sql}) + 1e-10::double, 6) + 0.0::double)"
