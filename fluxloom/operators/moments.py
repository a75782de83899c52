"""Sums of vectors and of their products, by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.vectors import to_lists, to_matrix

# Partial sums that a task holds before it passes them on.
HELD_BYTES = 256 * 1024 * 1024


def group_sums(rows: DataFrame, group: str, v: str = "v") -> DataFrame:
    """Row count and vector sum per group: (group, n, total array).

    A task adds up its rows per group and emits one vector each, so a hot group is spread over all
    tasks; the partial vectors are added by position under a plain aggregate.
    """
    partial = rows.select(F.col(group).cast("string").alias(group), v).mapInArrow(
        _partial_sums(group, v), f"{group} string, n bigint, total array<double>")
    sums = partial.select(group, "n", F.posexplode("total").alias("i", "x")).groupBy(group, "i").agg(
        F.sum("x").alias("x"), F.sum("n").alias("n"))
    return sums.groupBy(group).agg(
        F.max("n").alias("n"),
        F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))


def group_products(rows: DataFrame, group: str, v: str = "v") -> DataFrame:
    """Sums of x_i x_j per group for i <= j: (group, i, j, xx, n). Same plan as ``group_sums``."""
    partial = rows.select(F.col(group).cast("string").alias(group), v).mapInArrow(
        _partial_products(group, v), f"{group} string, n bigint, i int, row array<double>")
    return partial.select(group, "n", "i", F.posexplode("row").alias("k", "xx")).groupBy(
        group, "i", (F.col("i") + F.col("k")).alias("j")).agg(F.sum("xx").alias("xx"), F.sum("n").alias("n"))


def _by_group(batch: pa.RecordBatch, group: str, v: str):
    """Rows of each group in a batch."""
    codes = batch.column(group).dictionary_encode()
    matrix, at = to_matrix(batch.column(v)), codes.indices.to_numpy(zero_copy_only=False)
    for k, name in enumerate(codes.dictionary.to_pylist()):
        yield name, matrix[at == k]


def _partial_sums(group: str, v: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush():
            names = list(held)
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array([held[k][0] for k in names], pa.int64()),
                 to_lists(np.array([held[k][1] for k in names]))], [group, "n", "total"])
            held.clear()
            return out

        for batch in batches:
            for name, rows in _by_group(batch, group, v):
                entry = held.setdefault(name, [0, np.zeros(rows.shape[1])])
                entry[0] += len(rows)
                entry[1] += rows.sum(axis=0)
            if held and len(held) * rows.shape[1] * 8 > HELD_BYTES:
                yield flush()
        if held:
            yield flush()

    return run


def _partial_products(group: str, v: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush():
            for name, (n, gram) in held.items():
                width = len(gram)
                flat = np.concatenate([gram[i, i:] for i in range(width)])
                ends = np.concatenate([[0], np.cumsum(np.arange(width, 0, -1))])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * width, pa.string()), pa.array([n] * width, pa.int64()),
                     pa.array(np.arange(width), pa.int32()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))],
                    [group, "n", "i", "row"])
            held.clear()

        for batch in batches:
            for name, rows in _by_group(batch, group, v):
                entry = held.setdefault(name, [0, np.zeros((rows.shape[1], rows.shape[1]))])
                entry[0] += len(rows)
                entry[1] += rows.T @ rows
                if len(held) * entry[1].nbytes > HELD_BYTES:
                    yield from flush()
        yield from flush()

    return run
