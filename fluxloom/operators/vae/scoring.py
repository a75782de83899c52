"""Scoring rows: embedding, reconstruction and losses, in Arrow batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.vectors import row_blocks, to_lists, to_matrix
from fluxloom.operators.harmonise import restrict_rows
from fluxloom.operators.vae.model import Vae
from fluxloom.operators.vae.network import normals
from fluxloom.session import bounded_table

PRE, EMB, REC = "pre", "emb", "rec"
STAGES = (PRE, EMB, REC)
MAX_COEFFICIENTS = 5_000_000


@dataclass
class SparseRows:
    """Coefficients in coordinate form: rows (metabolites) by columns (reactions of a layout)."""

    row: np.ndarray
    col: np.ndarray
    value: np.ndarray

    def __post_init__(self):
        order = np.lexsort((self.col, self.row))
        self.row, self.col, self.value = self.row[order], self.col[order], self.value[order]
        self.starts = np.flatnonzero(np.r_[True, np.diff(self.row) != 0]) if len(self.row) else np.empty(0, int)

    @classmethod
    def collect(cls, stoich: DataFrame, reactions: list[str]) -> SparseRows:
        """From (metabolite, reaction, stoich); reactions outside the layout are left out."""
        table = bounded_table(stoich.select("metabolite", "reaction", "stoich"), MAX_COEFFICIENTS, "coefficient table")
        at = pc.index_in(table["reaction"], value_set=pa.array(reactions, pa.string()))
        table = table.append_column("at", at).filter(pc.is_valid(at))
        names = pc.unique(table["metabolite"]).sort() if table.num_rows else pa.array([], pa.string())
        row = pc.index_in(table["metabolite"], value_set=names)
        return cls(row.to_numpy().astype(int), table["at"].to_numpy().astype(int), table["stoich"].to_numpy())

    def times(self, v: np.ndarray) -> np.ndarray:
        """Net production: rows x metabolites that have a coefficient."""
        if not len(self.row):
            return np.zeros((len(v), 0))
        return np.add.reduceat(v[:, self.col] * self.value, self.starts, axis=1)

    def times_transposed(self, net: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(net), width))
        if len(self.row):
            at = np.repeat(np.arange(len(self.starts)), np.diff(np.r_[self.starts, len(self.row)]))
            np.add.at(out, (slice(None), self.col), net[:, at] * self.value)
        return out


class Scorer:
    """A model applied to rows of a dataset layout.

    ``reactions`` is the dataset's layout (by default the model's). Model reactions that the data lacks
    are 0; data reactions that the model lacks pass through unchanged.
    """

    def __init__(self, vae: Vae, reactions: list[str] | None = None, sample: bool = False, eps: str = "normal",
                 coefficients: SparseRows | None = None, beta_s: float = 0.0):
        if eps not in ("normal", "ones"):
            raise ValueError("eps is 'normal' or 'ones'")
        self.vae, self.sample, self.eps = vae, sample, eps
        self.coefficients, self.beta_s = coefficients, beta_s
        if reactions is None or vae.reaction_names is None:
            self.taken = self.placed = np.arange(vae.n_in)
            self.width = vae.n_in
        else:
            at = {r: i for i, r in enumerate(reactions)}
            pairs = [(at[r], j) for j, r in enumerate(vae.reaction_names) if r in at]
            self.taken = np.array([p[0] for p in pairs], dtype=int)
            self.placed = np.array([p[1] for p in pairs], dtype=int)
            self.width = len(reactions)
        self.missing = vae.n_in - len(self.taken)

    def to_model(self, v: np.ndarray) -> np.ndarray:
        out = np.zeros((len(v), self.vae.n_in))
        out[:, self.placed] = v[:, self.taken]
        return out

    def to_data(self, v_model: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = v.copy()
        out[:, self.taken] = v_model[:, self.placed]
        return out

    def noise(self, keys: np.ndarray | None, rows: int) -> np.ndarray:
        if self.eps == "ones" or keys is None:
            return np.ones((rows, self.vae.n_emb))
        return normals(keys, self.vae.n_emb)

    def embed(self, v: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
        _, mu, _, std = self.vae.latent(self.to_model(v))
        return mu + std * self.noise(keys, len(v)) if self.sample else mu

    def rebuild(self, z: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self.to_data(self.vae.reconstruct(z)[1], v)

    def losses(self, v: np.ndarray, keys: np.ndarray | None = None) -> np.ndarray:
        """Per row: total, reconstruction, divergence, stoichiometry."""
        x, mu, log_var, std = self.vae.latent(self.to_model(v))
        x_out, v_out = self.vae.reconstruct(mu + std * self.noise(keys, len(v)))
        rec = ((x - x_out) ** 2).sum(axis=1)
        div = 0.5 * (np.exp(log_var) + mu**2 - log_var - 1.0).sum(axis=1)
        s = np.zeros(len(v))
        if self.coefficients is not None and self.beta_s:
            s = self.beta_s * (self.coefficients.times(self.to_data(v_out, v)) ** 2).sum(axis=1)
        return np.stack([rec + div + s, rec, div, s], axis=1)

    # Columns. ``keys`` is a 64-bit key of the row; the noise of a row depends on it only.

    def encode(self, v: Column | str, keys: Column) -> Column:
        @F.arrow_udf("array<double>")
        def run(rows: pa.Array, row_keys: pa.Array) -> pa.Array:
            return self._by_block(rows, row_keys, self.embed)

        return run(v, keys)

    def decode(self, z: Column | str, v: Column | str) -> Column:
        @F.arrow_udf("array<double>")
        def run(latent: pa.Array, rows: pa.Array) -> pa.Array:
            return to_lists(self.rebuild(to_matrix(latent, self.vae.n_emb), to_matrix(rows, self.width)))

        return run(z, v)

    def row_losses(self, v: Column | str, keys: Column) -> Column:
        names = ["loss", "reconstruction_loss", "divergence_loss", "stoicheometry_loss"]

        @F.arrow_udf(f"struct<{', '.join(n + ' double' for n in names)}>")
        def run(rows: pa.Array, row_keys: pa.Array) -> pa.Array:
            out = [self.losses(m, k) for m, k in self._blocks(rows, row_keys)]
            table = np.concatenate(out) if out else np.empty((0, 4))
            return pa.StructArray.from_arrays([pa.array(c) for c in table.T.copy()], names)

        return run(v, keys)

    def stages(self, v: Column | str, keys: Column, stages: tuple[str, ...]) -> Column:
        """All asked stages in one pass over the row, as an array of (stage, v)."""
        @F.arrow_udf("struct<" + ", ".join(f"{s}: array<double>" for s in stages) + ">")
        def run(rows: pa.Array, row_keys: pa.Array) -> pa.Array:
            made: dict[str, list] = {s: [] for s in stages}
            for m, k in self._blocks(rows, row_keys):
                z = self.embed(m, k) if EMB in made or REC in made else None
                for s in stages:
                    made[s].append(to_lists(m if s == PRE else z if s == EMB else self.rebuild(z, m)))
            empty = pa.array([], pa.list_(pa.float64()))
            return pa.StructArray.from_arrays(
                [pa.concat_arrays(made[s]) if made[s] else empty for s in stages], list(stages))

        out = run(v, keys)
        return F.array(*[F.struct(F.lit(s).alias("stage"), out[s].alias("v")) for s in stages])

    def _blocks(self, rows: pa.Array, row_keys: pa.Array):
        keys = row_keys.to_numpy(zero_copy_only=False)
        for part in row_blocks(len(rows), self.width):
            yield to_matrix(rows.slice(part.start, part.stop - part.start), self.width), keys[part]

    def _by_block(self, rows, row_keys, fn):
        parts = [to_lists(fn(m, k)) for m, k in self._blocks(rows, row_keys)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.float64()))


def row_key(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def stage_view(samples: DataFrame, scorer: Scorer, stages: tuple[str, ...] = STAGES,
               restrictions: dict[str, object] | None = None, keys: list[str] = ("row_id",), seed: int = 0,
               v: str = "v") -> DataFrame:
    """Rows at each stage: (keys, stage, v). Rows are restricted before they are scored."""
    kept = restrict_rows(samples, restrictions or {})
    scored = kept.withColumn("_stages", scorer.stages(v, row_key(seed, *keys), tuple(stages)))
    return scored.select(*keys, F.explode_outer("_stages").alias("s")).select(*keys, "s.stage", "s.v")


def dataset_loss(losses: DataFrame, by: list[str] = (), with_stoich: bool = False) -> DataFrame:
    """Mean of the row losses; the total leaves the stoichiometry part out unless asked."""
    total = F.avg("loss") if with_stoich else F.avg(F.col("loss") - F.col("stoicheometry_loss"))
    return losses.groupBy(*by).agg(
        total.alias("loss"), *[F.avg(c).alias(c) for c in
                               ("reconstruction_loss", "divergence_loss", "stoicheometry_loss")])


def cross_model_loss(samples: DataFrame, scorers: dict[str, Scorer], test_set: str, keys: list[str] = ("row_id",),
                     seed: int = 0, v: str = "v") -> DataFrame:
    """Mean losses of every model on every test set, in one pass over the rows."""
    scored = F.array(*[F.struct(F.lit(name).alias("model"), s.row_losses(v, row_key(seed, *keys)).alias("l"))
                       for name, s in scorers.items()])
    flat = samples.select(test_set, F.explode_outer(scored).alias("s")).select(test_set, "s.model", "s.l.*")
    return dataset_loss(flat, ["model", test_set])
