"""One Gaussian per label, and classification by density: at once while the covariances are within the broadcast bound, beyond it
in turns over the tiles of their inverse factors (`tiles`)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import GaussianMixture
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.vectors import row_blocks, to_lists, to_matrix
from fluxloom.operators import tiles
from fluxloom.operators.cluster import fitting_input
from fluxloom.operators.moments import group_sums
from fluxloom.session import BROADCAST_BYTES, TooLarge, bounded_rows, settle

# Fixed value: added to the diagonal of every covariance.
RIDGE = 1e-6
MAX_LABELS = 100_000


def _moments(rows: DataFrame, group: str, v: str, side: int | None = None) -> tuple[dict[str, np.ndarray], DataFrame, int]:
    """Means per label, tiles of the covariances and the side of a tile.

    Products are taken about the overall mean, so large offsets do not cancel digits.
    """
    sums = bounded_rows(group_sums(rows, group, v), MAX_LABELS, "list of labels")
    means = {r[group]: np.array(r["total"]) / r["n"] for r in sums}
    centre = sum(np.array(r["total"]) for r in sums) / sum(r["n"] for r in sums)
    width = len(centre)
    side = side or tiles.side_of(width)

    @F.arrow_udf("array<double>")
    def centred(values: pa.Array) -> pa.Array:
        return to_lists(to_matrix(values, width) - centre)

    wide = len(means) * width * width * 8 > tiles.HELD_BYTES
    products = tiles.group_tiles(rows.select(group, centred(v).alias("v")), group, "v", side, ordered=wide)
    # The offsets hold one vector per label: the size of a model, checked by bounded_rows above.
    names = sorted(means)
    offsets = rows.sparkSession.createDataFrame(pa.table({
        "at": pa.array(names, pa.string()), "m": pa.array([means[n] - centre for n in names], pa.list_(pa.float64()))}))
    return means, tiles.covariances(products, offsets, group, width, side, RIDGE), side


def fit_moments(rows: DataFrame, group: str = "label", v: str = "v") -> tuple[dict[str, np.ndarray], DataFrame]:
    """Means per label, and covariances in long form: (label, i, j, cov) for i <= j."""
    means, found, side = _moments(rows, group, v)
    width = len(next(iter(means.values())))
    found = tiles.cells(found.withColumn("n", F.lit(1).cast("bigint")), group, width, side)
    return means, found.select(group, "i", "j", F.col("x").alias("cov"))


class Densities:
    """Bounded model: mean, inverse Cholesky factor and log determinant per label, sorted by label."""

    def __init__(self, labels: list[str], means: np.ndarray, covariances: np.ndarray):
        if covariances.nbytes > BROADCAST_BYTES:
            raise TooLarge(f"{covariances.nbytes} bytes of covariances; use classify_in_turns")
        self.labels, self.means = labels, means
        factors = np.linalg.cholesky(covariances)
        self.whiten = np.linalg.inv(factors)
        self.log_det = 2.0 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)

    @classmethod
    def fit(cls, rows: DataFrame, group: str = "label", v: str = "v") -> Densities:
        means, cov = fit_moments(rows, group, v)
        labels = sorted(means)
        d = len(means[labels[0]])
        if len(labels) * d * d * 8 > BROADCAST_BYTES:
            raise TooLarge("covariances of all labels are above the broadcast bound; use classify_in_turns")
        table = cov.toArrow()  # labels x d x d / 2 numbers, checked above
        at = pc.index_in(table[group], value_set=pa.array(labels, pa.string())).to_numpy()
        i, j = table["i"].to_numpy(), table["j"].to_numpy()
        full = np.zeros((len(labels), d, d))
        full[at, i, j] = full[at, j, i] = table["cov"].to_numpy()
        return cls(labels, np.array([means[n] for n in labels]), full)

    def log_density(self, rows: np.ndarray) -> np.ndarray:
        d = rows.shape[1]
        out = np.empty((len(rows), len(self.labels)))
        for k in range(len(self.labels)):
            z = (rows - self.means[k]) @ self.whiten[k].T
            out[:, k] = -0.5 * (d * np.log(2.0 * np.pi) + self.log_det[k] + np.einsum("ij,ij->i", z, z))
        return out

    def classify(self, rows: DataFrame, v: str = "v", out: str = "pred") -> DataFrame:
        """Label of the greatest density, without priors; ties go to the least label."""
        names, width = pa.array(self.labels), self.means.shape[1]

        @F.arrow_udf("string")
        def best(values: pa.Array) -> pa.Array:
            matrix, found = to_matrix(values, width), np.empty(len(values), dtype=np.int64)
            for part in row_blocks(len(matrix), width + len(names)):
                found[part] = self.log_density(matrix[part]).argmax(axis=1)
            return names.take(pa.array(found))

        return rows.withColumn(out, best(v))


class Turns:
    """Part of the inverse factors: block rows of some labels, in order, as they fit the broadcast bound."""

    def __init__(self, parts: list[tuple[str, bool, np.ndarray, np.ndarray]]):
        self.parts = parts  # label, whether it is the label's last block row, its mean, the block row

    def score(self, rows: np.ndarray, held: np.ndarray, best: np.ndarray, pred: np.ndarray) -> None:
        """Adds to each row's sum for the label at hand; when the label is complete, keeps the denser one."""
        for label, last, mean, w in self.parts:
            diagonal = np.diagonal(w, offset=w.shape[1] - len(w))
            z = (rows[:, : w.shape[1]] - mean[: w.shape[1]]) @ w.T
            held += np.einsum("ij,ij->i", z, z) - 2.0 * np.log(diagonal).sum()
            if last:
                density = -0.5 * (rows.shape[1] * np.log(2.0 * np.pi) + held)
                denser = density > best
                best[denser], pred[denser] = density[denser], label
                held[:] = 0.0


def _pass_by(model: Turns, width: int):
    @F.arrow_udf("struct<held double, best double, pred string>")
    def run(values: pa.Array, state: pa.Array) -> pa.Array:
        matrix = to_matrix(values, width)
        held, best = (np.array(state.field(c), dtype=np.float64) for c in ("held", "best"))
        pred = np.array(state.field("pred").to_pylist(), dtype=object)
        for part in row_blocks(len(matrix), 2 * width):
            model.score(matrix[part], held[part], best[part], pred[part])
        return pa.StructArray.from_arrays([pa.array(held), pa.array(best), pa.array(pred, pa.string())], ["held", "best", "pred"])

    return run


def classify_in_turns(train: DataFrame, rows: DataFrame, group: str = "label", v: str = "v", out: str = "pred",
                      side: int | None = None, turn_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """`classify` for covariances of any width: no process holds more than ``turn_bytes`` of them.

    The rows pass by the block rows of one label after another, in turns, and carry the sum of the label at hand and the
    densest label so far. Ties go to the least label, as there.
    """
    means, found, side = _moments(train, group, v, side)
    width = len(next(iter(means.values())))
    factors = settle(tiles.whiten(settle(found, "tiles"), group, width, side), "factors")
    blocks = -(-width // side)
    # Block rows in order, and the turn that each belongs to.
    turns: list[list[tuple[str, int]]] = [[]]
    size = 0
    for label in sorted(means):
        for i in range(blocks):
            more = min(side, width - i * side) * min(width, (i + 1) * side) * 8
            if turns[-1] and size + more > turn_bytes:
                turns.append([])
                size = 0
            turns[-1].append((label, i))
            size += more
    found = rows.withColumn("_state", F.struct(F.lit(0.0).alias("held"), F.lit(float("-inf")).alias("best"),
                                               F.lit(None).cast("string").alias("pred")))
    for turn in turns:
        at = F.struct(F.col(group), F.col("i"))
        wanted = at.between(F.struct(F.lit(turn[0][0]), F.lit(turn[0][1])), F.struct(F.lit(turn[-1][0]), F.lit(turn[-1][1])))
        held: dict[tuple[str, int], list] = {}
        for row in factors.filter(wanted).collect():  # one turn's tiles, at most turn_bytes or one block row
            held.setdefault((row[group], row["i"]), []).append((row["j"], row["tile"]))
        parts = []
        for label, i in turn:
            height = min(side, width - i * side)
            line = [np.frombuffer(tile).reshape(height, -1) for _, tile in sorted(held.pop((label, i)))]
            parts.append((label, i + 1 == blocks, means[label], np.concatenate(line, axis=1)))
        pass_by = _pass_by(Turns(parts), width)
        found = settle(found.withColumn("_state", pass_by(v, "_state")), "densest")
    return found.withColumn(out, F.col("_state.pred")).drop("_state")


def classify(train: DataFrame, rows: DataFrame, group: str = "label", v: str = "v", out: str = "pred") -> DataFrame:
    """Label of the greatest density among one Gaussian per training label; ties go to the least label."""
    size = train.agg(F.count_distinct(group).alias("labels"), F.max(F.size(v)).alias("width")).first()
    if size["labels"] * size["width"] ** 2 * 8 > BROADCAST_BYTES:
        return classify_in_turns(train, rows, group, v, out)
    return Densities.fit(train, group, v).classify(rows, v, out)


def fit_mixture(rows: DataFrame, label: str, k: int, seed: int = 0, group: str = "label"):
    """Mixture of k Gaussians for the rows of one label."""
    with fitting_input(rows.filter(F.col(group) == label)) as vectors:
        return GaussianMixture(k=k, seed=seed).fit(vectors)
