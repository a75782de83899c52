"""Nearest centre of each row."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.vectors import row_blocks, to_lists, to_matrix
from fluxloom.session import BROADCAST_BYTES, TooLarge, bounded_rows, settle

MAX_CENTRES = 100_000


def squared_distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Rows x centres, from differences (no cancellation as in the expanded square)."""
    out = np.empty((len(rows), len(centres)))
    for j, centre in enumerate(centres):
        diff = rows - centre
        out[:, j] = np.einsum("ij,ij->i", diff, diff)
    return out


# Distances by matrix product are off by far less than this share of the squared norms.
SLACK = 1e-9


def by_product(rows: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and the error bound of each row."""
    a, b = np.einsum("ij,ij->i", rows, rows), np.einsum("ij,ij->i", others, others)
    return a[:, None] + b[None, :] - 2.0 * (rows @ others.T), SLACK * (a + b.max(initial=0.0))


def nearest_rows(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of the nearest centre (least on ties) and the squared distance to it, exact as by differences.

    The product names the nearest; rows where others come within its error are settled by differences.
    """
    best, least = np.empty(len(rows), dtype=np.int64), np.empty(len(rows))
    for part in row_blocks(len(rows), len(centres) + rows.shape[1]):
        x = rows[part]
        rough, error = by_product(x, centres)
        found = rough.argmin(axis=1)
        near = rough <= (rough.min(axis=1) + 2.0 * error)[:, None]
        for i in np.flatnonzero(near.sum(axis=1) > 1):
            rivals = np.flatnonzero(near[i])
            found[i] = rivals[((centres[rivals] - x[i]) ** 2).sum(axis=1).argmin()]
        diff = x - centres[found]
        best[part], least[part] = found, np.einsum("ij,ij->i", diff, diff)
    return best, least


def within(rows: np.ndarray, others: np.ndarray, radius: float) -> np.ndarray:
    """Which rows are within the radius of which others; close calls are settled by differences."""
    rough, error = by_product(rows, others)
    limit = radius * radius
    close = rough <= limit
    i, j = np.nonzero(np.abs(rough - limit) <= error[:, None])
    diff = rows[i] - others[j]
    close[i, j] = np.einsum("ij,ij->i", diff, diff) <= limit
    return close


@dataclass
class Centres:
    """A bounded model: sorted ids and one vector each. Sent to executors inside the function."""

    ids: list
    matrix: np.ndarray
    extra: list | None = None
    name: tuple = ()

    def __post_init__(self):
        if self.matrix.nbytes > BROADCAST_BYTES:
            raise TooLarge(f"{self.matrix.nbytes} bytes of centres; use nearest_in_turns")

    @classmethod
    def from_rows(cls, rows, id_col, v_col, extra=None, name=()):
        rows = sorted(rows, key=lambda r: r[id_col])
        return cls([r[id_col] for r in rows], np.array([r[v_col] for r in rows], dtype=np.float64),
                   [r[extra] for r in rows] if extra else None, name)

    @classmethod
    def collect(cls, centres: DataFrame, id_col: str, v_col: str) -> Centres:
        return cls.from_rows(bounded_rows(centres.select(id_col, v_col), MAX_CENTRES, "centres"), id_col, v_col)

    @classmethod
    def collect_many(cls, centres: DataFrame, model_cols: list[str], id_col: str, v_col: str,
                     extra: str | None = None) -> list[Centres]:
        """One model per value of ``model_cols``, in sorted order."""
        columns = [*model_cols, id_col, v_col, *([extra] if extra else [])]
        grouped: dict[tuple, list] = {}
        for row in bounded_rows(centres.select(*columns), MAX_CENTRES, "centres"):
            grouped.setdefault(tuple(row[c] for c in model_cols), []).append(row)
        models = [cls.from_rows(grouped[name], id_col, v_col, extra, name) for name in sorted(grouped)]
        if sum(m.matrix.nbytes for m in models) > BROADCAST_BYTES:
            raise TooLarge("the models together are above the broadcast bound; score them in turns")
        return models


def nearest(df: DataFrame, v_col: str, centres: Centres, out: str = "cluster", d2: str | None = None) -> DataFrame:
    """Add the id of the nearest centre (least id on ties) and, if named, the squared distance."""
    ids, matrix = pa.array(centres.ids), centres.matrix
    kind = "bigint" if pa.types.is_integer(ids.type) else "string"

    @F.arrow_udf(f"struct<id {kind}, d2 double>")
    def find(v: pa.Array) -> pa.Array:
        best, least = nearest_rows(to_matrix(v, matrix.shape[1]), matrix)
        return pa.StructArray.from_arrays([ids.take(pa.array(best)), pa.array(least)], ["id", "d2"])

    found = df.withColumn("_near", find(v_col)).withColumn(out, F.col("_near.id"))
    if d2:
        found = found.withColumn(d2, F.col("_near.d2"))
    return found.drop("_near")


def nearest_of_each(df: DataFrame, v_col: str, models: list[Centres]) -> DataFrame:
    """Assign each row under every model in one pass; one output row per (model, row)."""
    matrices = [m.matrix for m in models]
    ids = [pa.array([str(i) for i in m.ids]) for m in models]
    extra = [pa.array(m.extra) if m.extra else pa.nulls(len(m.ids), pa.string()) for m in models]
    n = len(models)

    @F.arrow_udf("array<struct<cluster string, seed_label string>>")
    def find(v: pa.Array) -> pa.Array:
        rows = to_matrix(v, matrices[0].shape[1])
        best = [pa.array(nearest_rows(rows, m)[0]) for m in matrices]
        # Row-major order: all models of row 0, then of row 1, ...
        order = pa.array((np.arange(n)[None, :] * len(rows) + np.arange(len(rows))[:, None]).ravel())
        clusters = pa.concat_arrays([i.take(b) for i, b in zip(ids, best)]).take(order)
        labels = pa.concat_arrays([e.take(b) for e, b in zip(extra, best)]).take(order)
        offsets = pa.array(np.arange(len(rows) + 1) * n, type=pa.int32())
        return pa.ListArray.from_arrays(
            offsets, pa.StructArray.from_arrays([clusters, labels], ["cluster", "seed_label"]))

    names = F.array(*[F.struct(F.lit(m.name[0]).alias("set_name"), F.lit(m.name[1]).cast("bigint").alias("rep"))
                      for m in models])
    pairs = F.arrays_zip(names.alias("n"), find(v_col).alias("c"))
    return df.select("row_id", F.explode_outer(pairs).alias("p")).select(
        F.col("p.n.set_name").alias("set_name"), F.col("p.n.rep").alias("rep"), "row_id",
        F.col("p.c.cluster").alias("cluster"), F.col("p.c.seed_label").alias("seed_label"))


def nearest_in_turns(df: DataFrame, v_col: str, centres: DataFrame, id_col: str, c_col: str,
                     out: str = "cluster", turn_rows: int | None = None, d2: str | None = None) -> DataFrame:
    """Nearest centre when the centres together exceed the broadcast bound.

    The centres are cut into parts that each fit; the rows are scored against one part at a time and the
    least ``(distance, id)`` so far is written with them. Rows are never shuffled or multiplied.
    """
    stored = settle(centres.select(F.col(id_col).alias("id"), F.col(c_col).alias("c")), "centres")
    size = stored.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("c")).alias("d")).first()
    # Parts are cut by hash, so they are aimed at half of the bound.
    per_turn = turn_rows or max(1, min(MAX_CENTRES, BROADCAST_BYTES // (8 * (size["d"] or 1))) // 2)
    turns = max(1, -(-size["n"] // per_turn))
    best = df.withColumn("_best", F.lit(None).cast(f"struct<d2 double, id {dict(stored.dtypes)['id']}>"))
    for turn in range(turns):
        part = stored.filter(F.pmod(F.xxhash64("id"), F.lit(turns)) == turn)
        if part.isEmpty():
            continue
        scored = nearest(best, v_col, Centres.collect(part, "id", "c"), "_id", d2="_d2")
        found = F.struct(F.col("_d2").alias("d2"), F.col("_id").alias("id"))
        best = settle(scored.withColumn("_best", F.least("_best", found)).drop("_d2", "_id"), "nearest")
    found = best.withColumn(out, F.col("_best.id"))
    if d2:
        found = found.withColumn(d2, F.col("_best.d2"))
    return found.drop("_best")


def nearest_given(df: DataFrame, v_col: str, centres: DataFrame, id_col: str, c_col: str, out: str = "cluster",
                  d2: str | None = None, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Nearest of the centres of a table: at once while they are within the bound, else in turns. Equal results."""
    stored = settle(centres.select(id_col, c_col), "centres")
    size = stored.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(c_col)).alias("width")).first()
    if size["n"] <= MAX_CENTRES and size["n"] * (size["width"] or 0) * 8 <= limit:
        return nearest(df, v_col, Centres.collect(stored, id_col, c_col), out, d2)
    turn_rows = max(1, min(MAX_CENTRES, limit // (8 * size["width"])) // 2)
    return nearest_in_turns(df, v_col, stored, id_col, c_col, out, turn_rows, d2)


def distances(df: DataFrame, v_col: str, centres: Centres, keys: list[str], out: str = "centre") -> DataFrame:
    """Distance of each row to every centre of a bounded model, long: (keys, centre, distance)."""
    ids, matrix = pa.array(centres.ids), centres.matrix
    kind = "bigint" if pa.types.is_integer(ids.type) else "string"

    @F.arrow_udf(f"array<struct<id {kind}, distance double>>")
    def measure(v: pa.Array) -> pa.Array:
        found = to_lists(np.sqrt(squared_distances(to_matrix(v, matrix.shape[1]), matrix)))
        named = pa.StructArray.from_arrays(
            [ids.take(pa.array(np.tile(np.arange(len(ids)), len(v)))), found.values], ["id", "distance"])
        return pa.ListArray.from_arrays(found.offsets, named)

    return df.select(*keys, F.explode_outer(measure(v_col)).alias("p")).select(
        *keys, F.col("p.id").alias(out), F.col("p.distance").alias("distance"))
