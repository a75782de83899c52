"""Per-reaction mean and spread, the feature dictionary, and dense vectors."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.functions.vectors import row_blocks, to_lists, to_matrix
from fluxloom.operators.harmonise import ROW_KEY
from fluxloom.session import bounded_table

# A dense vector must fit a row, so its dictionary is bounded; the long form has no such bound.
MAX_REACTIONS = 1_000_000


def totals(flux: DataFrame):
    """Number of files and of samples, as a scalar struct for use in an expression; reads the keys only."""
    return flux.select(*ROW_KEY).distinct().agg(F.struct(
        F.count_distinct("file_name").alias("n_files"), F.count(F.lit(1)).alias("n_samples"))).scalar()


def mean_and_spread(n, cells, mean, variance, ddof: int = 0):
    """Mean and spread over ``n`` samples, of which ``cells`` have the given mean and variance and the others are 0.

    Squares of large values are never subtracted: the zeros are merged in closed form. A spread of 0, up to
    rounding of the mean, is given as 1.
    """
    squares = cells * variance + mean * mean * cells * (n - cells) / n
    variance, mean = F.try_divide(squares, n - ddof) if ddof else squares / n, mean * cells / n
    return mean, F.when(F.coalesce(F.sqrt(variance), F.lit(0.0)) <= 1e-12 * F.abs(mean), F.lit(1.0)).otherwise(F.sqrt(variance))


def flux_stats(flux: DataFrame, ddof: int = 0) -> DataFrame:
    """Mean and spread per reaction over the samples of all files.

    A sample without the cell counts as 0, so N is the sample count and not the cell count.
    ``ddof=1`` gives the sample spread.
    """
    mean, spread = mean_and_spread(F.col("n_samples"), F.col("_cells"), F.col("_mean"), F.col("_variance"), ddof)
    return (
        flux.groupBy("reaction").agg(*flux_moments()).withColumn("n_samples", totals(flux)["n_samples"])
        .select("reaction", "n_samples", mean.alias("mu"), spread.alias("sd"))
    )


def flux_moments():
    """Of the cells that are there: their number, mean and variance."""
    return F.count("flux").alias("_cells"), F.avg("flux").alias("_mean"), F.var_pop("flux").alias("_variance")


def reaction_dim(flux: DataFrame) -> DataFrame:
    """The dictionary: reaction, number of files, core flag, mean, spread.

    Sums and the count of files come from one pass over the cells, the totals from one over the keys.
    """
    mean, spread = mean_and_spread(F.col("n_samples"), F.col("_cells"), F.col("_mean"), F.col("_variance"))
    return (
        flux.groupBy("reaction").agg(F.count_distinct("file_name").alias("n_files"), *flux_moments())
        .withColumn("t", totals(flux)).withColumn("n_samples", F.col("t.n_samples"))
        .select("reaction", "n_files", (F.col("n_files") == F.col("t.n_files")).alias("is_core"), "n_samples",
                mean.alias("mu"), spread.alias("sd"))
    )


@dataclass
class Dictionary:
    """Sorted reactions with their mean and spread: the layout of a dense vector."""

    reactions: list[str]
    mu: np.ndarray
    sd: np.ndarray
    index: dict[str, int] = field(init=False)

    def __post_init__(self):
        self.index = {r: i for i, r in enumerate(self.reactions)}

    @classmethod
    def collect(cls, dim: DataFrame) -> Dictionary:
        table = bounded_table(dim.select("reaction", "mu", "sd"), MAX_REACTIONS, "the reaction dictionary")
        table = table.sort_by("reaction")
        return cls(table["reaction"].to_pylist(), table["mu"].to_numpy(), table["sd"].to_numpy())

    def table(self, spark: SparkSession) -> DataFrame:
        """The layout as a table (reaction, at). Its size is known, so Catalyst broadcasts it only if small."""
        at = pa.array(range(len(self.reactions)), pa.int32())
        return spark.createDataFrame(pa.table({"reaction": pa.array(self.reactions, pa.string()), "at": at}))

    def subset(self, reactions: list[str]) -> Dictionary:
        """Chosen reactions, in the given order; unknown ones are left out."""
        keep = [r for r in reactions if r in self.index]
        at = [self.index[r] for r in keep]
        return Dictionary(keep, self.mu[at], self.sd[at])


def dense_samples(flux: DataFrame, dictionary: Dictionary, keys: list[str] | None = None,
                  scaled: bool = False, out: str = "v") -> DataFrame:
    """One row per sample with its dense vector; absent cells are 0 before scaling.

    Long reaction names are swapped for positions first, so the one shuffle on the sample key carries
    (position, value) pairs; the scatter into vectors is per batch. Reactions outside the dictionary are
    left out, but their samples stay.
    """
    keys = keys or ["file_name", "label", "sample_n"]
    cells = (
        flux.join(dictionary.table(flux.sparkSession), "reaction", "left")
        .groupBy(*keys).agg(F.collect_list(F.when(F.col("at").isNotNull(), F.struct(
            "at", F.coalesce("flux", F.lit(0.0)).alias("flux")))).alias("_cells"))
    )
    return cells.withColumn(out, scatter(dictionary, scaled)("_cells.at", "_cells.flux")).drop("_cells")


def scatter(dictionary: Dictionary, scaled: bool = False):
    """UDF (positions, values) -> dense vector; values at the same position add up."""
    mu, sd, width = dictionary.mu, dictionary.sd, len(dictionary.reactions)

    @F.arrow_udf("array<double>")
    def build(at: pa.Array, values: pa.Array) -> pa.Array:
        parts = []
        for part in row_blocks(len(at), width):
            k, v = (c.slice(part.start, part.stop - part.start) for c in (at, values))
            rows = np.repeat(np.arange(len(k)), k.value_lengths().to_numpy(zero_copy_only=False))
            flat = rows * width + k.flatten().to_numpy(zero_copy_only=False)
            dense = np.bincount(flat, v.flatten().to_numpy(zero_copy_only=False), minlength=len(k) * width)
            dense = dense.reshape(len(k), width)
            parts.append(to_lists((dense - mu) / sd if scaled else dense))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))

    return build


def affine(v: Column, mu: np.ndarray, sd: np.ndarray, inverse: bool = False) -> Column:
    """Scale a dense vector by mean and spread, or undo it. A spread near 0 counts as 1."""
    sd = np.where(np.isclose(sd, 0.0), 1.0, sd)

    @F.arrow_udf("array<double>")
    def apply(rows: pa.Array) -> pa.Array:
        matrix = to_matrix(rows, len(mu))
        return to_lists(matrix * sd + mu if inverse else (matrix - mu) / sd)

    return apply(v)


def convert(v: Column, source: Dictionary, target: list[str]) -> Column:
    """Dense vector in the layout of another reaction list; reactions the source lacks are 0."""
    pairs = [(source.index[r], j) for j, r in enumerate(target) if r in source.index]
    taken, placed = (np.array(x, dtype=int) for x in (zip(*pairs) if pairs else ([], [])))
    width_in, width_out = len(source.reactions), len(target)

    @F.arrow_udf("array<double>")
    def apply(rows: pa.Array) -> pa.Array:
        out = np.zeros((len(rows), width_out))
        out[:, placed] = to_matrix(rows, width_in)[:, taken]
        return to_lists(out)

    return apply(v)


def explode_vectors(samples: DataFrame, dictionary: Dictionary, keys: list[str], v: str = "v",
                    out: str = "flux") -> DataFrame:
    """Dense vectors back to long rows, zeros included."""
    cells = samples.select(*keys, F.posexplode_outer(v).alias("at", out))  # outer: else v is made twice
    return cells.join(dictionary.table(samples.sparkSession), "at").select(*keys, "reaction", out)
