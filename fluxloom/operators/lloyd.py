"""K-means for many (k, seed) at once: every iteration reads the rows once for all fits.

Scores over repeated clusterings need dozens of fits of the same rows; one fit at a time would read
them once per fit and iteration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.functions.draws import draw
from fluxloom.functions.vectors import row_blocks, to_lists, to_matrix
from fluxloom.session import BROADCAST_BYTES, TooLarge

# Rounds that draw candidates for the starting centres, from all rows.
START_ROUNDS = 3
# Rows of partial sums that the driver adds up itself.
DIRECT_ROWS = 2_000


@dataclass
class Fit:
    k: int
    seed: int
    centres: np.ndarray
    cost: float = np.inf
    done: bool = False


def start_centres(rows: DataFrame, specs: list[tuple[int, int]], key: str, v: str) -> tuple[list[np.ndarray], float]:
    """Starting centres of every (k, seed) from all rows, and the mean variance of a column.

    The first candidate is the row with the least draw of its key. Each round adds ``2 k`` rows, drawn without
    replacement by squared distance to the candidates so far: a row's place in line is the logarithm of its draw by
    its distance, so a task only hands on its first ``2 k``. At last every candidate is weighed by the rows nearest
    to it, and k of them are chosen by k-means++ with these weights.
    """
    seeds = sorted({seed for _, seed in specs})
    least = rows.agg(*[F.min(F.struct(draw(seed, key).alias("d"), F.col(v).alias("v"))).alias(f"s{i}")
                       for i, seed in enumerate(seeds)]).first()
    first = {seed: np.array(least[f"s{i}"]["v"], dtype=np.float64) for i, seed in enumerate(seeds)}
    held = [first[seed][None, :] for _, seed in specs]
    width = held[0].shape[1]
    if sum((1 + START_ROUNDS * 2 * k) * width * 8 for k, _ in specs) > BROADCAST_BYTES:
        raise TooLarge("the candidates of all fits are above the broadcast bound; fit them in turns")
    hashed = rows.select(F.xxhash64(key).alias("h"), F.col(v).alias("v"))
    wanted = F.array(*[F.lit(2 * k) for k, _ in specs])
    inline = Window.partitionBy("fit").orderBy("place", "v")
    for round_n in range(START_ROUNDS):
        found = hashed.mapInArrow(_next_in_line(held, specs, round_n), "fit int, place double, v array<double>")
        found = found.withColumn("rank", F.row_number().over(inline)).filter(F.col("rank") <= wanted[F.col("fit")])
        table = found.select("fit", "v").toArrow().combine_chunks()
        fit_of = table["fit"].to_numpy()
        vectors = to_matrix(table["v"].combine_chunks(), width) if table.num_rows else np.zeros((0, width))
        held = [np.concatenate([own, vectors[fit_of == i]]) for i, own in enumerate(held)]
    total, squares, weights = 0, np.zeros((2, width)), [np.zeros(len(own)) for own in held]
    for row in hashed.mapInArrow(_weigh(held), "fit int, sums array<double>").toLocalIterator():
        if row["fit"] < 0:
            total += row["sums"][0]
            squares += np.array(row["sums"][1:]).reshape(2, width)
        else:
            weights[row["fit"]] += row["sums"]
    variance = np.maximum(squares[1] / total - (squares[0] / total) ** 2, 0).mean()
    return [_choose(own, w, k, seed) for own, w, (k, seed) in zip(held, weights, specs)], float(variance)


def _choose(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means++ on weighted candidates. Rows with fewer than k different values give repeated centres."""
    rng = np.random.default_rng(seed)
    centres = [candidates[rng.choice(len(candidates), p=weights / weights.sum())]]
    d2 = ((candidates - centres[0]) ** 2).sum(axis=1)
    while len(centres) < k:
        share = d2 * weights
        if share.sum() == 0:
            share = d2 if d2.sum() > 0 else weights
        centres.append(candidates[rng.choice(len(candidates), p=share / share.sum())])
        d2 = np.minimum(d2, ((candidates - centres[-1]) ** 2).sum(axis=1))
    return np.array(centres)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, taken about the first centre so that large offsets cancel before they are squared."""
    x, m = x - centres[0], centres - centres[0]
    return np.maximum((x**2).sum(axis=1)[:, None] - 2.0 * (x @ m.T) + (m**2).sum(axis=1), 0.0)


def _next_in_line(held: list[np.ndarray], specs: list[tuple[int, int]], round_n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros((0, m.shape[1]))) for m in held]
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)
            rows = to_matrix(batch.column(1), held[0].shape[1])
            for i, (own, (k, seed)) in enumerate(zip(held, specs)):
                for part in row_blocks(len(rows), 2 * len(own)):
                    near = _distances(rows[part], own).min(axis=1)
                    u = (_mix(hashes[part] ^ _mix(np.uint64([seed * 64 + round_n]))) >> np.uint64(11)).astype(float) + 1.0
                    with np.errstate(divide="ignore"):
                        place = -np.log(u / 2.0**53) / near
                    place = np.where(near > 0, place, np.inf)
                    place = np.concatenate([best[i][0], place])
                    vectors = np.concatenate([best[i][1], rows[part]])
                    first = np.argsort(place, kind="stable")[: 2 * k]
                    first = first[np.isfinite(place[first])]
                    best[i] = place[first], vectors[first]
        for i, (place, vectors) in enumerate(best):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(place), i), pa.int32()), pa.array(place), to_lists(vectors)], ["fit", "place", "v"])

    return run


def _weigh(held: list[np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = [np.zeros(len(m)) for m in held]
        total, squares = 0, np.zeros((2, held[0].shape[1]))
        for batch in batches:
            rows = to_matrix(batch.column(1), held[0].shape[1])
            about = rows - held[0][0]
            total, squares = total + len(rows), squares + np.array([about.sum(axis=0), (about**2).sum(axis=0)])
            for own, w in zip(held, weights):
                for part in row_blocks(len(rows), 2 * len(own)):
                    w += np.bincount(_distances(rows[part], own).argmin(axis=1), minlength=len(own))
        sums = [*weights, np.concatenate([[total], squares.ravel()])]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*range(len(held)), -1], pa.int32()), pa.array(sums, pa.list_(pa.float64()))], ["fit", "sums"])

    return run


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a uniform draw from a hash."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fit_many(rows: DataFrame, specs: list[tuple[int, int]], key: str, v: str = "v", max_iter: int = 100,
             tol: float = 1e-4) -> list[Fit]:
    """One fit per (k, seed).

    A fit stops when the squared moves of its centres add up to at most ``tol`` times the mean variance
    of a column.
    """
    starts, variance = start_centres(rows, specs, key, v)
    fits = [Fit(k, seed, centres) for (k, seed), centres in zip(specs, starts)]
    still = tol * variance
    kept = rows.select(v).persist(StorageLevel.MEMORY_AND_DISK)
    tasks = kept.rdd.getNumPartitions()
    try:
        for _ in range(max_iter):
            open_fits = [f for f in fits if not f.done]
            if not open_fits:
                break
            advance(kept, tasks, open_fits, v, still)
        advance(kept, tasks, fits, v, None)  # the cost of the final centres
    finally:
        kept.unpersist()
    return fits


def advance(rows: DataFrame, tasks: int, fits: list[Fit], v: str, still: float | None) -> None:
    """Assign all rows under every fit, then move the centres (or only take the cost, if still is None)."""
    matrices = [f.centres for f in fits]
    partial = rows.mapInArrow(_assign(matrices, v), "fit int, cluster int, n bigint, cost double, total array<double>")
    # Tasks emit one row per (fit, cluster). Rows of many tasks meet by key first, so the driver receives
    # no more than the size of the models; those of a few tasks come to it as they are.
    clusters = sum(len(m) for m in matrices)
    if tasks * clusters > DIRECT_ROWS:
        partial = partial.repartition(max(1, min(200, clusters // 64)), "fit", "cluster").mapInArrow(
            _add, partial.schema)
    costs = np.zeros(len(fits))
    sizes = [np.zeros(len(m)) for m in matrices]
    totals = [np.zeros(m.shape) for m in matrices]
    table = partial.toArrow().combine_chunks()
    vectors = to_matrix(table["total"].combine_chunks(), matrices[0].shape[1])
    for i, j, n, cost, total in zip(*(table[c].to_pylist() for c in ("fit", "cluster", "n", "cost")), vectors):
        costs[i] += cost
        sizes[i][j] += n
        totals[i][j] += total
    # A cluster without rows keeps its centre.
    moved = [np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], f.centres)
             for n, total, f in zip(sizes, totals, fits)]
    for i, f in enumerate(fits):
        f.cost = float(costs[i])
        if still is not None:
            f.done = float(((moved[i] - f.centres) ** 2).sum()) <= still
            f.centres = moved[i]


def _assign(matrices: list[np.ndarray], v: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.zeros(len(m), dtype=np.int64), np.zeros(len(m)), np.zeros(m.shape)] for m in matrices]
        norms = [(m**2).sum(axis=1) for m in matrices]
        for batch in batches:
            rows = to_matrix(batch.column(v), matrices[0].shape[1])
            for m, norm, (n, cost, total) in zip(matrices, norms, held):
                for part in row_blocks(len(rows), 2 * len(m)):
                    x = rows[part]
                    best = (norm - 2.0 * (x @ m.T)).argmin(axis=1)
                    n += np.bincount(best, minlength=len(m))
                    cost += np.bincount(best, ((x - m[best]) ** 2).sum(axis=1), minlength=len(m))
                    chosen = np.zeros((len(m), len(x)))
                    chosen[best, np.arange(len(x))] = 1.0
                    total += chosen @ x
        for i, (n, cost, total) in enumerate(held):
            yield _rows(np.full(len(n), i), np.arange(len(n)), n, cost, total)

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = zip(batch.column("fit").to_pylist(), batch.column("cluster").to_pylist())
        for key, n, cost, total in zip(keys, batch.column("n").to_pylist(), batch.column("cost").to_pylist(),
                                       to_matrix(batch.column("total"))):
            entry = held.setdefault(key, [0, 0.0, 0.0])
            entry[0], entry[1], entry[2] = entry[0] + n, entry[1] + cost, entry[2] + total
    if held:
        fit, cluster = np.array(list(held)).T
        n, cost, total = zip(*held.values())
        yield _rows(fit, cluster, np.array(n), np.array(cost), np.array(total))


def _rows(fit, cluster, n, cost, total) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(fit, pa.int32()), pa.array(cluster, pa.int32()), pa.array(n, pa.int64()),
         pa.array(cost, pa.float64()), to_lists(total)], ["fit", "cluster", "n", "cost", "total"])
