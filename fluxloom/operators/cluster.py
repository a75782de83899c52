"""K-means, PCA and assignment to given centres."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.vectors import row_blocks, to_lists, to_matrix
from fluxloom.operators.distance import Centres, nearest, nearest_given, nearest_of_each
from fluxloom.operators.lloyd import fit_many
from fluxloom.operators.moments import group_sums
from fluxloom.operators.tiles import add_tiles
from fluxloom.session import BROADCAST_BYTES, TooLarge

# What the driver holds of a space of columns and their images while it looks for leading components.
SPACE_BYTES = 4 * BROADCAST_BYTES


class fitting_input:
    """Rows as ML vectors, kept in memory or on disk for the passes of a fit and released after."""

    def __init__(self, rows: DataFrame, *keep: str, v: str = "v"):
        self.df = rows.select(*keep, array_to_vector(F.col(v)).alias("features"))

    def __enter__(self) -> DataFrame:
        return self.df.persist(StorageLevel.MEMORY_AND_DISK)

    def __exit__(self, *_):
        self.df.unpersist()


def n_labels(rows: DataFrame, column: str = "label") -> int:
    """Default number of clusters: as many as there are labels."""
    return rows.agg(F.count_distinct(column)).first()[0]


def kmeans_fit(vectors: DataFrame, k: int, seed: int, max_iter: int = 100) -> tuple[np.ndarray, float]:
    """Centres and the sum of squared distances to them."""
    model = KMeans(k=k, seed=seed, maxIter=max_iter, tol=1e-4).fit(vectors)
    return np.array(model.clusterCenters()), float(model.summary.trainingCost)


def kmeans_cluster(rows: DataFrame, k: int | None = None, seed: int = 0, out: str = "cluster") -> DataFrame:
    """Add the k-means cluster of each row."""
    with fitting_input(rows) as vectors:
        centres, _ = kmeans_fit(vectors, k or n_labels(rows), seed)
    return nearest(rows, "v", Centres(list(range(len(centres))), centres), out)


def kmeans_repeats(rows: DataFrame, set_name: str, n: int, k: int | None = None, seed: int = 0) -> DataFrame:
    """``n`` independent clusterings, long: (set_name, rep, row_id, cluster).

    All fits advance together, and one pass assigns the rows under every fit.
    """
    k = k or n_labels(rows)
    fits = fit_many(rows, [(k, seed + rep) for rep in range(n)], "row_id")
    models = [Centres(list(range(k)), f.centres, name=(set_name, rep)) for rep, f in enumerate(fits)]
    return nearest_of_each(rows.select("row_id", "v"), "v", models).drop("seed_label")


def wcss_curve(stages: DataFrame, max_k: int, n: int = 1, seed: int = 0) -> DataFrame:
    """Sum of squares within clusters per row, for k = 1..max_k at each stage: mean and spread over n fits."""
    found = []
    names = sorted(r["stage"] for r in stages.select("stage").distinct().collect())  # at most three stages
    for stage in names:
        rows = stages.filter(F.col("stage") == stage)
        count = rows.count()
        # One cluster is the mean, whatever the seed.
        specs = [(1, seed)] + [(k, seed + rep) for k in range(2, max_k + 1) for rep in range(n)]
        fits = fit_many(rows, specs, "row_id")
        for k in range(1, max_k + 1):
            scaled = np.array([f.cost for f in fits if f.k == k]) / count
            found.append((stage, k, float(scaled.mean()), float(scaled.std())))
    return stages.sparkSession.createDataFrame(found, "stage string, k bigint, wcss double, wcss_std double")


def identity_clustering(rows: DataFrame, label: str = "label") -> DataFrame:
    """The clustering that the labels are."""
    return rows.select("row_id", F.col(label).alias("cluster"))


def kmeans_assign(rows: DataFrame, centres: DataFrame, out: str = "cluster") -> DataFrame:
    """Nearest of given centres (cluster, c), however many, with the squared distance; the sum of it is the WCSS."""
    return nearest_given(rows, "v", centres, "cluster", "c", out, d2="d2")


class Components:
    """Principal components of the rows: all of them, or the leading ``k``.

    While the d x d moments are within the broadcast bound they are taken directly. Wider rows need ``k``; their leading
    components come from `leading`, and the driver never sees more than some multiples of d x k numbers.
    """

    def __init__(self, rows: DataFrame, v: str = "v", k: int | None = None):
        total = group_sums(rows.withColumn("_all", F.lit("all")), "_all", v).first()
        self.mean = np.array(total["total"]) / total["n"]
        width = len(self.mean)
        most = min(width, total["n"])
        k = most if k is None else min(k, most)
        if width * width * 8 <= BROADCAST_BYTES:
            with fitting_input(rows, v=v) as vectors:
                model = PCA(k=k, inputCol="features", outputCol="pca").fit(vectors)
            axes, self.ratio = np.array(model.pc.toArray()), np.array(model.explainedVariance.toArray())
        else:
            kept = rows.select(v).persist(StorageLevel.MEMORY_AND_DISK)
            try:
                axes, self.ratio = leading(kept, self.mean, k, v)
            finally:
                kept.unpersist()
        # Sign rule: the largest loading of a component is positive.
        self.axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])

    def transform(self, rows: DataFrame, v: str = "v", out: str = "pca") -> DataFrame:
        """Rows in the components, centred (the library's own transform does not centre)."""
        mean, axes = self.mean, self.axes

        @F.arrow_udf("array<double>")
        def project(values: pa.Array) -> pa.Array:
            return to_lists((to_matrix(values, len(mean)) - mean) @ axes)

        return rows.withColumn(out, project(v))

    def scree(self, spark) -> DataFrame:
        """Share of variance per component, and the share of those before it."""
        before = np.concatenate([[0.0], np.cumsum(self.ratio)[:-1]])
        rows = [(i, float(r), float(b)) for i, (r, b) in enumerate(zip(self.ratio, before))]
        return spark.createDataFrame(rows, "component bigint, ratio double, cumulative double")


def _scatter(rows: DataFrame, v: str, mean: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, float]:
    """X' X B for the centred rows X, and their sum of squares: one pass. Tasks hand on tiles of their sums, which are added up by
    place before the driver receives them, once."""
    width, many = block.shape
    side = max(1, (1 << 21) // (8 * many))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares, n = np.zeros(block.shape), 0.0, 0
        for batch in batches:
            matrix = to_matrix(batch.column(0), width)
            for part in row_blocks(len(matrix), 2 * width):
                x = matrix[part] - mean
                total += x.T @ (x @ block)
                squares += float(np.einsum("ij,ij->", x, x))
                n += len(x)
        parts = [*(total[i : i + side] for i in range(0, width, side)), np.array([squares])] if n else []
        for i, part in enumerate(parts):
            yield pa.RecordBatch.from_arrays(
                [pa.array([""]), pa.array([i], pa.int32()), pa.array([n], pa.int64()), pa.array([part.tobytes()])],
                ["all", "i", "n", "tile"])

    sums = rows.select(v).mapInArrow(run, "all string, i int, n bigint, tile binary")
    sums = sums.repartition("all", "i").sortWithinPartitions("all", "i").mapInArrow(add_tiles, sums.schema)
    found = [np.frombuffer(r["tile"]) for r in sorted(sums.collect(), key=lambda r: r["i"])]
    return np.concatenate(found[:-1]).reshape(block.shape), float(found[-1][0])


def leading(rows: DataFrame, mean: np.ndarray, k: int, v: str = "v", block: int = 16, seed: int = 0, tol: float = 1e-10,
            max_passes: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """The leading ``k`` axes (columns) and their shares of the variance, without the d x d moments.

    A random block of columns and its images under the moments span a space that grows by a block per pass; the axes are those
    of the moments within it. It is complete when every wanted axis is off by less than ``tol`` of the greatest variance, or
    when nothing is left to add. A space of ``3 (k + block)`` columns is cut back to its best ``k + block`` and goes on.
    """
    width = len(mean)
    keep = k + block
    if 2 * 3 * keep * width * 8 > SPACE_BYTES:
        raise TooLarge(f"{k} axes of {width} columns; ask for fewer")
    rng = np.random.default_rng(seed)
    fresh = np.linalg.qr(rng.normal(size=(width, min(block, width))))[0]
    basis, images = np.zeros((width, 0)), np.zeros((width, 0))
    for _ in range(max_passes):
        image, squares = _scatter(rows, v, mean, fresh)
        basis, images = np.concatenate([basis, fresh], axis=1), np.concatenate([images, image], axis=1)
        inner = basis.T @ images
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        wanted = min(k, len(values))
        off = images @ turn[:, :wanted] - (basis @ turn[:, :wanted]) * values[:wanted]
        scale = max(abs(values[0]), np.finfo(float).tiny)
        if len(values) >= k and np.linalg.norm(off, axis=0).max() <= tol * scale:
            break
        for _ in range(2):  # once more, as the first leaves rounding behind
            image = image - basis @ (basis.T @ image)
        left, size, _ = np.linalg.svd(image, full_matrices=False)
        fresh = left[:, size > 1e-14 * scale]
        if not fresh.shape[1] and len(values) < k:  # the rows vary in fewer directions; any others complete the axes
            fresh = rng.normal(size=(width, min(block, width - len(values))))
            for _ in range(2):
                fresh = np.linalg.qr(fresh - basis @ (basis.T @ fresh))[0]
        if not fresh.shape[1]:
            break
        if basis.shape[1] + fresh.shape[1] > 3 * keep:
            basis, images = basis @ turn[:, :keep], images @ turn[:, :keep]
        fresh = np.linalg.qr(fresh - basis @ (basis.T @ fresh))[0]
    else:
        raise RuntimeError(f"the axes did not settle in {max_passes} passes")
    return basis @ turn[:, :k], np.maximum(values[:k], 0.0) / squares
