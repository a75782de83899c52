"""Products of wide vectors, and the inverse factors of their covariances, as tables of square tiles.

A matrix of ``d x d`` numbers is never in one place: a tile (i, j) holds ``side x side`` of them (less at the right and lower
edge) as the bytes of its rows, and all matrices of a table, one per group, are worked on together. Products are
symmetric, so only tiles with ``i <= j`` exist.

``whiten`` is block elimination. Beside the covariance A stands the unit matrix. Step ``k`` takes block row ``k``, multiplied
by the inverse Cholesky factor of its diagonal tile, out of all rows below. At the end the unit matrix has become W, lower triangular, with
W A W' the unit matrix, so the squared length of ``W (x - m)`` is the distance of a row in its group's Gaussian.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.vectors import to_matrix
from fluxloom.session import BROADCAST_BYTES, settle

# Rows of a tile: half a million bytes to two million each, so that a handful is an Arrow batch.
SIDE = 512
# Sums that a task holds before it passes them on.
HELD_BYTES = 256 * 1024 * 1024


def side_of(width: int) -> int:
    """Rows of a tile such that a block row of tiles is within the broadcast bound."""
    return max(1, min(SIDE, BROADCAST_BYTES // (8 * max(1, width))))


def group_tiles(rows: DataFrame, group: str, v: str = "v", side: int = SIDE, ordered: bool = False) -> DataFrame:
    """Sums of x_i x_j per group: (group, i, j, n, tile) for tiles with i <= j.

    A task adds up its rows and hands on tiles; those of one place meet sorted and are added one after another, so that no
    task holds more than one. ``ordered`` sorts a task's rows by group first, for groups whose sums do not fit a task together.
    """
    rows = rows.select(F.col(group).cast("string").alias(group), v)
    if ordered:
        rows = rows.sortWithinPartitions(group)
    keys = [group, "i", "j"]
    partial = rows.mapInArrow(_partial(group, v, side), f"{group} string, i int, j int, n bigint, tile binary")
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add_tiles, partial.schema)


def _partial(group: str, v: str, side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, (n, gram) in held.items():
                for i in range(0, len(gram), side):
                    for j in range(i, len(gram), side):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([name], pa.string()), pa.array([i // side], pa.int32()), pa.array([j // side], pa.int32()),
                             pa.array([n], pa.int64()), pa.array([gram[i : i + side, j : j + side].tobytes()])],
                            [group, "i", "j", "n", "tile"])
            held.clear()

        for batch in batches:
            codes = batch.column(group).dictionary_encode()
            matrix, at = to_matrix(batch.column(v)), codes.indices.to_numpy(zero_copy_only=False)
            names = codes.dictionary.to_pylist()
            for k, name in [*enumerate(names), *([(None, None)] if codes.null_count else [])]:
                mine = matrix[np.isnan(at) if k is None else at == k]
                width = mine.shape[1]
                if name not in held and (len(held) + 1) * width * width * 8 > HELD_BYTES:
                    yield from flush()
                entry = held.setdefault(name, [0, np.zeros((width, width))])
                entry[0] += len(mine)
                entry[1] += mine.T @ mine
        yield from flush()

    return run


def add_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the tiles of a place, which stand together. Works on any table of (keys, n, tile)."""
    held, names = None, None

    def out() -> pa.RecordBatch:
        key, n, tile = held
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.string()), *(pa.array([x], pa.int32()) for x in key[1:]), pa.array([n], pa.int64()),
             pa.array([tile.tobytes()])], names)

    for batch in batches:
        names = batch.schema.names
        *keys, counts, tiles = batch.columns
        for at, key in enumerate(zip(*(k.to_pylist() for k in keys), strict=True)):
            tile = np.frombuffer(tiles[at].as_buffer())
            if held is not None and held[0] == key:
                held[1] += counts[at].as_py()
                held[2] += tile
            else:
                if held is not None:
                    yield out()
                held = [key, counts[at].as_py(), tile.copy()]
    if held is not None:
        yield out()


def cells(tiles: DataFrame, group: str, width: int, side: int) -> DataFrame:
    """Tiles as single numbers: (group, i, j, n, x) for i <= j."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                name, i, j, n = (batch.column(c)[at].as_py() for c in range(4))
                tile = _matrix(batch.column(4)[at], i, width, side)
                a, b = np.indices(tile.shape)
                a, b = a.ravel() + i * side, b.ravel() + j * side
                keep = a <= b
                size = int(keep.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * size, pa.string()), pa.array(a[keep], pa.int32()), pa.array(b[keep], pa.int32()),
                     pa.array(np.full(size, n)), pa.array(tile.ravel()[keep])], [group, "i", "j", "n", "x"])

    return tiles.select(group, "i", "j", "n", "tile").mapInArrow(spread, f"{group} string, i int, j int, n bigint, x double")


def _matrix(value: pa.Scalar, i: int, width: int, side: int) -> np.ndarray:
    return np.frombuffer(value.as_buffer()).reshape(min(side, width - i * side), -1)


def covariances(tiles: DataFrame, offsets: DataFrame, group: str, width: int, side: int, ridge: float) -> DataFrame:
    """Tiles of products / n - m m' + ridge on the diagonal; ``offsets`` has (group, m) with m the group's mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                name, i, j, n = (batch.column(c)[at].as_py() for c in range(4))
                tile = _matrix(batch.column(4)[at], i, width, side) / n
                tile -= np.outer(batch.column(5)[at].values.to_numpy(), batch.column(6)[at].values.to_numpy())
                if i == j:
                    tile += ridge * np.eye(len(tile))
                yield _row(group, name, i, j, tile)

    part = [F.slice("m", F.col(c) * side + 1, side).alias(f"m_{c}") for c in ("i", "j")]
    rows = tiles.join(offsets, F.col(group).eqNullSafe(F.col("at"))).select(group, "i", "j", "n", "tile", *part)
    return rows.mapInArrow(run, f"{group} string, i int, j int, tile binary")


def _row(group: str, name: str | None, i: int, j: int, tile: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([name], pa.string()), pa.array([i], pa.int32()), pa.array([j], pa.int32()),
         pa.array([np.ascontiguousarray(tile).tobytes()])], [group, "i", "j", "tile"])


def whiten(tiles: DataFrame, group: str, width: int, side: int) -> DataFrame:
    """Tiles (group, i, j, tile), j <= i, of the inverse Cholesky factor of every group's matrix.

    One step per block row, for all groups at once; each step is written, so a lost executor goes back one step only.
    """
    blocks = -(-width // side)
    schema = f"{group} string, i int, j int, tile binary"

    def solve(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    name, j = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                    factor = np.linalg.inv(np.linalg.cholesky(_matrix(batch.column(3)[at], k, width, side)))
                    if j == k:  # the unit matrix beside it; the tile itself becomes the unit matrix, and is not needed
                        yield _row(group, name, k, blocks + k, factor)
                    else:
                        yield _row(group, name, k, j, factor @ _matrix(batch.column(2)[at], k, width, side))

        return run

    def take_out(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    name, i, j = (batch.column(c)[at].as_py() for c in range(3))
                    across, beside = (_matrix(batch.column(c)[at], k, width, side) for c in (3, 4))
                    tile = -across.T @ beside
                    if batch.column(5)[at].is_valid:
                        tile += _matrix(batch.column(5)[at], i, width, side)
                    yield _row(group, name, i, j, tile)

        return run

    left, done = tiles.select(group, "i", "j", "tile"), []
    for k in range(blocks):
        row = left.filter(F.col("i") == k)
        corner = row.filter(F.col("j") == k).select(F.col(group).alias("at"), F.col("tile").alias("corner"))
        row = row.join(corner, F.col(group).eqNullSafe(F.col("at"))).select(group, "j", "tile", "corner")
        row = settle(row.mapInArrow(solve(k), schema), "tiles")
        done.append(row.filter(F.col("j") >= blocks))
        if k + 1 < blocks:
            across = row.filter(F.col("j") < blocks).select(F.col(group).alias("at"), F.col("j").alias("i"), F.col("tile").alias("across"))
            beside = row.select(F.col(group).alias("of"), "j", F.col("tile").alias("beside"))
            pairs = across.join(beside, F.col("at").eqNullSafe(F.col("of")) & (F.col("j") >= F.col("i"))).drop("of")
            below = left.filter(F.col("i") > k).select(group, F.col("i").alias("i0"), F.col("j").alias("j0"), "tile")
            pairs = pairs.join(below, F.col("at").eqNullSafe(F.col(group)) & (F.col("i") == F.col("i0"))
                               & (F.col("j") == F.col("j0")), "left").select(F.col("at").alias(group), "i", "j", "across", "beside", "tile")
            left = settle(pairs.mapInArrow(take_out(k), schema), "tiles")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    return found.withColumn("j", F.col("j") - blocks)
