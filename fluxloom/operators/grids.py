"""Hyperparameter grids."""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.functions.text import format_param, param_flag
from fluxloom.session import bounded_rows

# Values of one hyperparameter; the grid itself has no bound.
MAX_VALUES = 10_000


def value_lists(table: DataFrame, names: list[str]) -> dict[str, list]:
    """Sorted distinct values of each named column."""
    return {n: sorted(r[0] for r in bounded_rows(table.select(n).distinct(), MAX_VALUES, n)) for n in names}


def param_grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """All combinations; the last parameter varies fastest and ``run`` is the position.

    A run number is read as digits in a mixed base, one digit per parameter, so runs are made in
    parallel and no join multiplies rows.
    """
    run, stride, columns = F.col("id"), prod(len(v) for v in values.values()), []
    for name, choices in values.items():
        stride //= len(choices)
        digit = F.pmod(F.floor(run / stride), F.lit(len(choices))).cast("int")
        columns.append(F.get(F.array(*[typed(c) for c in choices]), digit).alias(name))
    return spark.range(prod(len(v) for v in values.values())).select(run.alias("run"), *columns)


def typed(value):
    """A literal; whole numbers are 64-bit, as in the tables."""
    return F.lit(value).cast("bigint") if type(value) is int else F.lit(value)


def command_line(grid: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Flags and values of each run, as one text."""
    parts = [p for name, kind in kinds.items() for p in (param_flag(F.lit(name)), format_param(F.col(name), kind))]
    return grid.select("run", F.concat_ws(" ", *parts).alias("arg_str"))


def pending(planned: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """Planned outputs that do not exist yet."""
    return planned.join(done.select(on).distinct(), on, "left_anti")
