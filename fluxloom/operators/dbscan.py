"""Density clustering (DBSCAN) with exact results.

Equal vectors are one weighted point, so a hot group of copies costs one row. Two bounds say which points can be neighbours:

- Points are placed in grid cells of side eps along their widest axes; only the same and adjacent cells can hold neighbours.
- Points go to the nearest of some pivots, points drawn from the table. Between the groups of two pivots lies their bisecting
  plane. The least distances of either group to it, added up, are a lower bound of all distances between them; groups further
  apart than eps are not compared. This holds in any number of dimensions, where a grid on a few axes does not cut.

A part (cell and pivot) is cut into blocks of bounded size. Blocks are written once, on shelves of bounded size, and shelves are
dealt to lanes, a fixed number. A task has two lanes: it reads their shelves two at a time and compares the blocks that may hold
neighbours, so vectors are not shuffled to every block that they meet. It returns a count per point, then a spanning forest of the core
points of its lanes. Each point is in as many tasks as there are lanes, so what is shuffled and written grows with the points, not
with the pairs of blocks.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fluxloom.functions.vectors import to_matrix
from fluxloom.operators.distance import within
from fluxloom.operators.ranking import dense_index
from fluxloom.session import settle, write
from fluxloom.sources.heads import file_system

BLOCK_ROWS = 2_000
MAX_AXES = 3
# Pivots: some per block, so that most groups are smaller than a block; their number bounds what tasks hold.
PIVOTS_PER_BLOCK = 4
MAX_PIVOTS = 4_096
# Bytes of vectors on a shelf, of which a task holds two, and lanes: two make a task, so 12 make 78 tasks.
SHELF_BYTES = 16 << 20
LANES = 12


def dbscan(rows: DataFrame, key: str, v: str, eps: float, min_samples: int, out: str = "cluster",
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the cluster of each row; noise is -1.

    A row is a core row if at least ``min_samples`` rows, itself included, are within eps. Clusters are
    numbered by their least core row; a border row joins the least cluster that it touches.
    """
    points = settle(
        rows.groupBy(F.col(v).alias("v")).agg(F.count(F.lit(1)).alias("w"), F.min(key).alias("pid")), "points")
    blocked, pairs = block_pairs(points, eps, block_rows)
    shelves = shelf_number(blocked)
    work = tiles(pairs, shelves)
    stored = write(on_shelves(blocked, shelves), "shelves", ["shelf"])
    counts = work(_count_neighbours(stored, eps), "pid bigint, n bigint").groupBy("pid").agg(F.sum("n").alias("n"))
    counted = blocked.join(counts, "pid").withColumn("core", F.col("n") >= min_samples).drop("n")
    stored = write(on_shelves(counted, shelves), "core", ["shelf"])
    flagged = rows.sparkSession.read.parquet(stored)
    links = settle(work(_links(stored, eps), "a bigint, b bigint, border boolean"), "links")
    parts = components(flagged.filter("core").select("pid"), links.filter("NOT border").select("a", "b"))
    numbers = dense_index(parts, "root", "number")
    cores = settle(parts.join(numbers, "root").select("pid", F.col("number").alias(out)), "clusters")
    borders = (
        links.filter("border").join(cores, F.col("b") == F.col("pid")).groupBy(F.col("a").alias("pid"))
        .agg(F.min(out).alias(out))
    )
    assigned = points.select("v", "pid").join(cores.unionByName(borders), "pid", "left").drop("pid")
    found = rows.withColumn("_v", F.col(v)).join(assigned.withColumnRenamed("v", "_v"), "_v", "left").drop("_v")
    return found.withColumn(out, F.coalesce(out, F.lit(-1)).cast("bigint"))


def block_pairs(points: DataFrame, eps: float, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Points with their block, and the pairs of blocks that may hold neighbours: (pair, block, side)."""
    spread = points.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"))
    widest = (
        spread.filter(F.col("hi") - F.col("lo") > eps).orderBy((F.col("lo") - F.col("hi")), "i").limit(MAX_AXES)
    ).collect()  # at most MAX_AXES rows
    cell = F.array(*[F.floor((F.col("v")[r["i"]] - r["lo"]) / eps).cast("bigint") for r in widest],
                   *([] if widest else [F.lit(0).cast("bigint")]))
    pivots = draw_pivots(points, block_rows)
    grouped = nearest_pivot(points.withColumn("cell", cell), pivots)
    parts = settle(grouped.groupBy("cell", "pivot").agg(
        F.ceil(F.count(F.lit(1)) / block_rows).cast("bigint").alias("n_blocks")), "parts")
    blocked = settle(
        grouped.join(parts, ["cell", "pivot"])
        .withColumn("block", block_id(F.col("cell"), F.col("pivot"), F.pmod(F.xxhash64("pid"), F.col("n_blocks"))))
        .drop("cell", "pivot", "n_blocks"), "blocked")
    near_pivots = settle(pivot_pairs(grouped, pivots, eps), "pivot-pairs")
    steps = itertools.product((-1, 0, 1), repeat=max(1, len(widest)))
    offsets = F.explode(F.array(*[F.array(*[F.lit(x).cast("bigint") for x in o]) for o in steps])).alias("offset")
    near = (
        parts.join(near_pivots, "pivot").select("cell", "pivot", "n_blocks", F.col("other").alias("other_pivot"), offsets)
        .withColumn("other", F.zip_with("cell", "offset", lambda a, b: a + b))
        .join(parts.select(F.col("cell").alias("other"), F.col("pivot").alias("other_pivot"),
                           F.col("n_blocks").alias("n_other")), ["other", "other_pivot"])
    )
    listed = (
        near.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_blocks") - 1)))
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_other") - 1)))
        .select(block_id(F.col("cell"), F.col("pivot"), F.col("i")).alias("first"),
                block_id(F.col("other"), F.col("other_pivot"), F.col("j")).alias("second"))
        .filter("first <= second")  # every pair of blocks once
    )
    sides = F.array(F.struct(F.col("first").alias("block"), F.lit(0).alias("side")),
                    F.struct(F.col("second").alias("block"), F.lit(1).alias("side")))
    pairs = (
        listed.withColumn("pair", F.concat_ws("~", "first", "second"))
        .select("pair", (F.col("first") == F.col("second")).alias("same"), F.explode(sides).alias("s"))
        .filter(~F.col("same") | (F.col("s.side") == 0)).select("pair", "s.block", "s.side")
    )
    return blocked, settle(pairs, "pairs")


def block_id(cell, pivot, number):
    return F.concat_ws("|", F.concat_ws(",", cell.cast("array<string>")), pivot.cast("string"), number.cast("string"))


def draw_pivots(points: DataFrame, block_rows: int) -> np.ndarray:
    """Points drawn by a hash of their id: some for every block, at most ``MAX_PIVOTS``."""
    wanted = min(MAX_PIVOTS, PIVOTS_PER_BLOCK * -(-points.count() // block_rows))
    drawn = points.orderBy(F.xxhash64("pid"), "pid").limit(wanted).select("v").toArrow()
    return to_matrix(drawn["v"].combine_chunks()) if drawn.num_rows else np.zeros((0, 1))


def _squares(matrix: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances of rows and pivots, and a bound of their rounding."""
    middle = pivots.mean(axis=0)
    matrix, pivots = matrix - middle, pivots - middle
    own, their = (matrix**2).sum(axis=1), (pivots**2).sum(axis=1)
    return own[:, None] + their[None, :] - 2.0 * matrix @ pivots.T, 1e-12 * (own.max(initial=0) + their.max(initial=0))


def nearest_pivot(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds the number of the nearest pivot, written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            squares, _ = _squares(to_matrix(batch.column("v")), pivots)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(squares.argmin(axis=1).astype(np.int32))],
                                             [*batch.schema.names, "pivot"])

    return settle(points.mapInArrow(run, T.StructType([*points.schema, T.StructField("pivot", T.IntegerType())])), "grouped")


def pivot_pairs(grouped: DataFrame, pivots: np.ndarray, eps: float) -> DataFrame:
    """(pivot, other) of the groups that may hold neighbours of each other, both ways round, and of each with itself."""
    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart, rounding = _squares(pivots, pivots)
        apart = np.sqrt(np.maximum(apart, 0.0))
        least = np.full(apart.shape, np.inf, np.float64)
        for batch in batches:
            squares, slack = _squares(to_matrix(batch.column("v")), pivots)
            own = batch.column("pivot").to_numpy()
            for pivot in np.unique(own):
                mine = squares[own == pivot]
                to_plane = (mine - mine[:, [pivot]]).min(axis=0) - 4.0 * (slack + rounding)
                with np.errstate(divide="ignore", invalid="ignore"):
                    found = np.where(apart[pivot] > 0, to_plane / (2.0 * apart[pivot]), 0.0)
                least[pivot] = np.minimum(least[pivot], np.maximum(found, 0.0))
        first, second = np.nonzero(least <= eps)
        yield pa.record_batch({"pivot": pa.array(first.astype(np.int32)), "other": pa.array(second.astype(np.int32)),
                               "margin": pa.array(least[first, second])})

    found = grouped.select("v", "pivot").mapInArrow(margins, "pivot int, other int, margin double")
    found = settle(found.groupBy("pivot", "other").agg(F.min("margin").alias("margin")), "margins")
    back = found.select(F.col("pivot").alias("other"), F.col("other").alias("pivot"), F.col("margin").alias("back"))
    return found.join(back, ["pivot", "other"]).filter(F.col("margin") + F.col("back") <= eps).select("pivot", "other")


def shelf_number(blocked: DataFrame) -> Column:
    """The shelf of a block: as many shelves as bytes ask for, and a lane at least while there are blocks for it."""
    extent = blocked.agg(F.countDistinct("block").alias("blocks"), F.sum(F.size("v") * 8).alias("bytes")).first()
    n = max(1, min(LANES, extent["blocks"]), -(-(extent["bytes"] or 0) // SHELF_BYTES))
    return F.pmod(F.xxhash64("block"), F.lit(n))


def on_shelves(blocked: DataFrame, shelf: Column) -> DataFrame:
    return blocked.withColumn("shelf", shelf).hint("rebalance", F.col("shelf")).sortWithinPartitions("shelf", "block")


def tiles(pairs: DataFrame, shelf: Column):
    """Runs a function on the pairs of blocks of every tile (two lanes): rows (x, y, first, second), shelves and blocks."""
    listed = pairs.filter("side = 0").select(F.col("block").alias("first"), F.substring_index("pair", "~", -1).alias("second"))
    listed = listed.withColumn("block", F.col("first")).withColumn("x", shelf)
    listed = listed.withColumn("block", F.col("second")).withColumn("y", shelf).drop("block")
    lanes = F.col("x") % LANES, F.col("y") % LANES
    listed = listed.withColumn("tile", F.least(*lanes) * LANES + F.greatest(*lanes))
    # The number of partitions is named: rows are few and small, their work is not.
    dealt = listed.repartition(LANES * (LANES + 1) // 2, "tile")
    return lambda fn, schema: dealt.groupBy("tile").applyInArrow(fn, schema)


class Shelf:
    """Points of a shelf, its blocks one after the other: ``of`` has the slice of each."""

    def __init__(self, path: str, number: int):
        system, place = file_system(f"{path}/shelf={number}")
        table = ds.dataset(place, filesystem=system, format="parquet").to_table().sort_by("block").combine_chunks()
        self.pid, self.w = table["pid"].to_numpy(), table["w"].to_numpy()
        self.matrix = to_matrix(table["v"].combine_chunks())
        self.core = table["core"].to_numpy() if "core" in table.column_names else None
        blocks = table["block"].to_numpy()
        starts = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
        self.of = {blocks[a]: slice(a, b) for a, b in zip(starts, np.r_[starts[1:], len(blocks)])}


def _compared(path: str, pairs: pa.Table) -> Iterator[tuple[int, Shelf, slice, int, Shelf, slice]]:
    """Both sides of the pairs of blocks, shelf by shelf; two shelves are held at a time."""
    held: dict[int, Shelf] = {}
    rows = pairs.select(["x", "y", "first", "second"]).sort_by([("x", "ascending"), ("y", "ascending")])
    for x, y, first, second in zip(*[c.to_pylist() for c in rows.columns]):
        held = {k: shelf for k, shelf in held.items() if k in (x, y)}
        for k in (x, y):
            if k not in held:
                held[k] = Shelf(path, k)
        yield x, held[x], held[x].of[first], y, held[y], held[y].of[second]


def _count_neighbours(path: str, eps: float):
    def run(pairs: pa.Table) -> pa.Table:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for x, a, i, y, b, j in _compared(path, pairs):
            for k, shelf in ((x, a), (y, b)):
                if k not in found:
                    found[k] = shelf.pid, np.zeros(len(shelf.pid), np.int64)
            close = within(a.matrix[i], b.matrix[j], eps)
            found[x][1][i] += close @ b.w[j]
            if (x, i) != (y, j):
                found[y][1][j] += a.w[i] @ close
        pid, n = (np.concatenate(parts) for parts in zip(*found.values()))
        return pa.table({"pid": pa.array(pid[n > 0]), "n": pa.array(n[n > 0])})

    return run


def _links(path: str, eps: float):
    def run(pairs: pa.Table) -> pa.Table:
        first: dict[int, int] = {}  # where the points of a shelf start
        pids, parent = [], np.zeros(0, np.int64)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, a, i, y, b, j in _compared(path, pairs):
            for k, shelf in ((x, a), (y, b)):
                if k not in first:
                    first[k] = len(parent)
                    pids.append(shelf.pid)
                    parent = np.concatenate([parent, np.arange(len(parent), len(parent) + len(shelf.pid))])
            sides = [(x, a, i, y, b, j)] if (x, i) == (y, j) else [(x, a, i, y, b, j), (y, b, j, x, a, i)]
            # A border point has fewer than min_samples neighbours, so these stay few.
            for _, s, own, _, t, other in sides:
                edge, core = own.start + np.flatnonzero(~s.core[own]), other.start + np.flatnonzero(t.core[other])
                if len(edge) and len(core):
                    p, q = np.nonzero(within(s.matrix[edge], t.matrix[core], eps))
                    left.append(s.pid[edge[p]])
                    right.append(t.pid[core[q]])
            p, q = i.start + np.flatnonzero(a.core[i]), j.start + np.flatnonzero(b.core[j])
            one, two = find(parent, first[x] + p), find(parent, first[y] + q)
            if len(p) and len(q) and not (one[0] == one).all() & (one[0] == two).all():  # else they are linked already
                g, h = np.nonzero(within(a.matrix[p], b.matrix[q], eps) & (one[:, None] != two))
                unite(parent, one[g], two[h])
        pid, roots = np.concatenate(pids), find(parent, np.arange(len(parent)))
        linked = np.flatnonzero(roots != np.arange(len(parent)))
        borders = sum(map(len, left))
        return pa.table({"a": pa.array(np.concatenate([*left, pid[linked]])),
                         "b": pa.array(np.concatenate([*right, pid[roots[linked]]])),
                         "border": pa.array(np.arange(borders + len(linked)) < borders)})

    return run


def find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Roots of some points; those points then stand right below them."""
    up = parent[x]
    while (parent[up] != up).any():
        up = parent[up]
    parent[x] = up
    return up


def unite(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the trees of x and y, pair by pair: the greater root goes below the least."""
    while True:
        x, y = find(parent, x), find(parent, y)
        apart = x != y
        if not apart.any():
            return
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Least node of each node's component: (pid, root).

    Each round takes the least root around a node and then follows roots of roots, so the number of
    rounds grows with the logarithm of a component's length. A round ends in a written table.
    """
    both = settle(edges.union(edges.select("b", "a")).distinct(), "edges")
    state = settle(nodes.select("pid", F.col("pid").alias("root")), "roots")
    while True:
        around = (
            both.join(state.select(F.col("pid").alias("b"), "root"), "b").groupBy(F.col("a").alias("pid"))
            .agg(F.min("root").alias("near"))
        )
        closer = state.join(around, "pid", "left").select(
            "pid", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root"))
        closer = settle(closer, "closer")
        jumped = closer.join(
            closer.select(F.col("pid").alias("root"), F.col("root").alias("further")), "root").select(
            "pid", "old", F.col("further").alias("root"))
        state = settle(jumped, "roots")
        if state.filter("old <> root").isEmpty():
            return state.select("pid", "root")
        state = state.select("pid", "root")
