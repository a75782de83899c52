"""Data-parallel fitting. Tasks compute gradient sums of a batch; the driver holds weights and Adam moments.

Normalisation uses the statistics of the whole batch: for every normalised layer there is one pass over the batch's rows whose
sums are added up before the next pass goes through that layer, on the way forward and again on the way back
(`batch_steps`). So a fit does not depend on how rows fall into files, tasks and Arrow batches.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.draws import draw
from fluxloom.functions.vectors import to_lists, to_matrix
from fluxloom.operators.ranking import rank_by_draw
from fluxloom.operators.sampling import shuffled_batches
from fluxloom.operators.vae.model import Vae, save
from fluxloom.operators.vae.network import BN_MOMENTUM, batch_stats, train_backward, train_forward
from fluxloom.operators.vae.scoring import Scorer, row_key
from fluxloom.session import scratch_path, settle

# Values per row of the gradient table: sums of one stretch of the gradient meet in one task.
SLOT = 65_536
# Bytes of vectors in a store: the batches that are read together. Their number follows the data, not the batch size.
STORE_BYTES = 1 << 30
# Up to so many values a model's sums go from the tasks that hold rows of the batch straight to the driver.
DIRECT = 16_384
# Evaluations that share a pass over the test rows: at most so many, and models of so many bytes.
EVALUATIONS = 64
EVALUATION_BYTES = 64 << 20
# A chunk of a file, as the rotation of samples names it.
CHUNK = ["file_name", "chunk"]


def batch_steps(scorer: Scorer, v: np.ndarray, keys: np.ndarray):
    """Sums over some rows of a batch: a generator that yields those of each normalised layer, forward and back, and is sent the
    sums of the whole batch. It yields last: number of rows, the four losses, the gradient, and the weighted statistics."""
    vae = scorer.vae
    x = (scorer.to_model(v) - vae.v_mu) / vae.v_std
    y, enc = yield from train_forward(vae.encoder, x, vae.lrelu_slope, vae.dropout_p, keys, 1)
    mu, log_var, std = vae.split_latent(y)
    eps = scorer.noise(keys, len(v))
    x_out, dec = yield from train_forward(vae.decoder, mu + std * eps, vae.lrelu_slope, vae.dropout_p, keys, 1 + len(vae.encoder))
    rec = ((x - x_out) ** 2).sum()
    div = 0.5 * (np.exp(log_var) + mu**2 - log_var - 1.0).sum()
    d_out, s = 2.0 * (x_out - x), 0.0
    if scorer.coefficients is not None and scorer.beta_s:
        net = scorer.coefficients.times(scorer.to_data(x_out * vae.v_std + vae.v_mu, v))
        s = scorer.beta_s * (net**2).sum()
        d_data = scorer.coefficients.times_transposed(2.0 * scorer.beta_s * net, v.shape[1])
        d_model = np.zeros_like(x)
        d_model[:, scorer.placed] = d_data[:, scorer.taken]
        d_out = d_out + d_model * vae.v_std
    g_dec, dz = yield from train_backward(vae.decoder, dec, d_out)
    d_log_var = dz * eps * 0.5 * std + 0.5 * (np.exp(log_var) - 1.0)
    if vae.legacy_vae:
        d_log_var = d_log_var / np.exp(log_var)
    g_enc, _ = yield from train_backward(vae.encoder, enc, np.concatenate([dz + mu, d_log_var], axis=1))
    stats = [len(v) * t for t in batch_stats(vae.encoder, enc) + batch_stats(vae.decoder, dec)]
    yield np.concatenate([[len(v), rec + div + s, rec, div, s], *[g.ravel() for g in [*g_enc, *g_dec]],
                          *[t.ravel() for t in stats]])


def local_sums(scorer: Scorer, v: np.ndarray, keys: np.ndarray, known: list[np.ndarray]) -> np.ndarray:
    """What the rows add to the next total, where ``known`` holds the totals so far."""
    steps = batch_steps(scorer, v, keys)
    found = next(steps)
    for total in known:
        found = steps.send(total)
    return found


def passes(vae: Vae) -> int:
    """Passes over a batch: one, and two more for every normalised layer."""
    return 1 + 2 * sum(layer.gamma is not None for layer in [*vae.encoder, *vae.decoder])


def batch_sums(scorer: Scorer, v: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The last sums, of a batch that is here as a whole."""
    known: list[np.ndarray] = []
    for _ in range(passes(scorer.vae)):
        known.append(local_sums(scorer, v, keys, known))
    return known[-1]


def sum_over_batch(batch: DataFrame, scorer: Scorer) -> np.ndarray | None:
    """`batch_sums` of the rows (v, k) of a batch, wherever they are; nothing if there are none.

    Each task adds its own rows, pass by pass. The sums are cut into slots, each slot is added in one task, and the driver receives
    one vector per pass, at most of the size of the model. Sums of a model of at most ``DIRECT`` values are added on the driver, one
    vector per task that has rows: a shuffle of so little only takes time.
    """
    known: list[np.ndarray] = []
    for _ in range(passes(scorer.vae)):
        total = _one_pass(batch, scorer, list(known))
        if total is None:
            return None
        known.append(total)
    return known[-1]


def _one_pass(batch: DataFrame, scorer: Scorer, known: list[np.ndarray]) -> np.ndarray | None:
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column("k").to_numpy(zero_copy_only=False)
            part = local_sums(scorer, to_matrix(b.column("v"), scorer.width), keys, known)
            total = part if total is None else total + part
        if total is not None:
            for slot, start in enumerate(range(0, len(total), SLOT)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([slot], pa.int32()), to_lists(total[None, start:start + SLOT])], ["slot", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, row in zip(b.column("slot").to_pylist(), b.column("sums")):
                values = row.values.to_numpy(zero_copy_only=False)
                held[slot] = held[slot] + values if slot in held else values
        for slot, values in held.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([slot], pa.int32()), to_lists(values[None, :])], ["slot", "sums"])

    schema = "slot int, sums array<double>"
    size = sum(p.size for p in scorer.vae.params())
    sums = batch.mapInArrow(local, schema)
    if size <= DIRECT:
        parts = sums.toArrow()["sums"]
        return sum(row.values.to_numpy(zero_copy_only=False) for row in parts) if len(parts) else None
    sums = sums.repartition(max(1, min(200, -(-size // SLOT))), "slot")
    table = sums.mapInArrow(add, schema).toArrow().sort_by("slot")  # one row per slot: the size of the model
    if not table.num_rows:
        return None
    return table["sums"].combine_chunks().flatten().to_numpy(zero_copy_only=False).copy()


def mean_losses(rows: DataFrame, keys: list[str], models: list[tuple[Scorer, int]], with_stoich: bool = False) -> list[list[float]]:
    """The four mean losses of the rows (keys, v) by each of some models with its seed, as `scoring.dataset_loss` has them, in one pass."""
    seeds = F.array(*[row_key(seed, *keys) for _, seed in models])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(models), 5))
        for batch in batches:
            own = batch.column("k").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(models))
            for at, (scorer, _) in enumerate(models):
                for v, k in scorer._blocks(batch.column("v"), pa.array(own[:, at])):
                    total[at] += [len(v), *scorer.losses(v, k).sum(axis=0)]
        yield pa.record_batch({"model": pa.array(np.arange(len(models), dtype=np.int32)),
                               **{c: pa.array(x) for c, x in zip("nlrds", total.T.copy())}})

    sums = rows.select("v", seeds.alias("k")).mapInArrow(local, "model int, n double, l double, r double, d double, s double")
    found = {r["model"]: r for r in sums.groupBy("model").agg(*[F.sum(c).alias(c) for c in "nlrds"]).collect()}
    if not found or not found[0]["n"]:
        raise ValueError("the test set has no rows")
    out = []
    for at in range(len(models)):
        r = found[at]
        total = r["l"] if with_stoich else r["l"] - r["s"]
        out.append([total / r["n"], r["r"] / r["n"], r["d"] / r["n"], r["s"] / r["n"]])
    return out


@dataclass
class Adam:
    """Adam with the weight decay added to the gradient."""

    lr: float
    weight_decay: float = 0.0
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    t: int = 0
    m: list = field(default_factory=list)
    v: list = field(default_factory=list)

    def step(self, params: list[np.ndarray], grads: list[np.ndarray]) -> None:
        if not self.m:
            self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        self.t += 1
        for p, g, m, v in zip(params, grads, self.m, self.v):
            g = g + self.weight_decay * p
            m += (1 - self.betas[0]) * (g - m)
            v += (1 - self.betas[1]) * (g * g - v)
            p -= self.lr * (m / (1 - self.betas[0] ** self.t)) / (
                np.sqrt(v / (1 - self.betas[1] ** self.t)) + self.eps)


def apply_sums(vae: Vae, adam: Adam, sums: np.ndarray) -> np.ndarray:
    """One optimiser step from batch sums; returns the four mean losses."""
    n, at, grads = sums[0], 5, []
    for p in vae.params():
        grads.append(sums[at:at + p.size].reshape(p.shape) / n)
        at += p.size
    for layer in [*vae.encoder, *vae.decoder]:
        for running in layer.stats():
            running += BN_MOMENTUM * (sums[at:at + running.size] / n - running)
            at += running.size
    adam.step(vae.params(), grads)
    return sums[1:5] / n


LOG_SCHEMA = ("eval_n bigint, epoch bigint, batch bigint, loss double, reconstruction_loss double, "
              "divergence_loss double, stoicheometry_loss double, test_loss double, test_reconstruction_loss double, "
              "test_divergence_loss double, test_stoicheometry_loss double")


class Batches:
    """The rows of a fit, written once as stores: folders of many batches, as many as the data's bytes ask for. A store's files
    are sorted by batch, so a batch is found by row-group statistics, and it is held while its steps run.

    Without ``turns`` a batch has ``batch_size`` rows of a seeded shuffle of all (`shuffled_batches`). With ``turns``
    (`sampling.epoch_rotation`: epoch, file_name, chunk) an epoch's rows are those of the chunks whose turn it is. Every
    chunk is cut into as many parts as an epoch has batches, in seeded order, so a batch has its share of each
    chunk and about ``batch_size`` rows, and no epoch writes anything.
    """

    def __init__(self, train: DataFrame, keys: list[str], batch_size: int, seed: int, turns: DataFrame | None = None,
                 store_bytes: int | None = None):
        self.turns = None if turns is None else settle(turns.select("epoch", *CHUNK), "turns")
        if turns is None:
            rows = shuffled_batches(train.select(*keys, "v"), batch_size, seed, keys)
            self.keep = [*keys, "v", "batch"]
            self.n = None
        else:
            columns = [*keys, *[c for c in CHUNK if c not in keys]]
            sizes = settle(train.groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("rows")), "chunk-sizes")
            epochs = self.turns.join(sizes, CHUNK).groupBy("epoch").agg(F.sum("rows").alias("rows"))
            self.n = max(1, -(-(epochs.agg(F.max("rows")).first()[0] or 0) // batch_size))
            ranked = rank_by_draw(train.select(*columns, "v"), CHUNK, draw(seed, *keys))
            part = F.floor((F.col("rn") - 1) * self.n / F.col("n_rows")).cast("bigint")
            rows = ranked.withColumn("batch", part).drop("rn", "n_rows")
            self.keep = [*columns, "v", "batch"]
        extent = train.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("v") * 8).alias("bytes")).first()
        batches = self.n or max(1, -(-extent["rows"] // batch_size))
        stores = max(1, -(-(extent["bytes"] or 0) // (store_bytes or STORE_BYTES)))
        self.per_store = max(1, -(-batches // stores))
        self.n = batches
        rows = rows.select(*self.keep, F.floor(F.col("batch") / self.per_store).alias("store"))
        rows = rows.hint("rebalance", F.col("store")).sortWithinPartitions("store", "batch")
        self.stored = settle(rows, "batches", ["store"])

    def epoch(self, epoch: int, seed: int, turn: int | None = None) -> Iterator[tuple[int, DataFrame]]:
        """(batch, its rows) in the seeded order of the epoch: stores one after the other, their batches mixed."""
        rng = np.random.default_rng([seed, epoch])
        for store in rng.permutation(-(-self.n // self.per_store)):
            rows = self.stored.filter(F.col("store") == int(store))
            if self.turns is not None:
                now = self.turns.filter(F.col("epoch") == (epoch if turn is None else turn)).select(*CHUNK)
                rows = rows.join(now, CHUNK, "left_semi")
            rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
            first = int(store) * self.per_store
            for batch in first + rng.permutation(min(self.per_store, self.n - first)):
                yield int(batch), rows.filter(F.col("batch") == int(batch))
            rows.unpersist()


def fit(train: DataFrame, vae: Vae, epochs: int, batch_size: int, lr: float, seed: int, keys: list[str],
        reactions: list[str] | None = None, test: DataFrame | None = None, eps: str = "normal",
        coefficients=None, beta_s: float = 0.0, test_beta_s: float | None = None, with_stoich: bool = False,
        save_losses_on: int = 1, save_on: int = 0, save_test_min: bool = True, folder: str | None = None,
        test_coefficients=None, turns: DataFrame | None = None, reload_on: int = 1,
        store_bytes: int | None = None) -> tuple[Vae, DataFrame]:
    """Fit ``vae`` in place to rows (keys, v); returns it with the loss log.

    Rows are written once as stores of batches (`Batches`). With ``turns``, rows need file_name and chunk, and every ``reload_on``
    epochs the sample becomes the next turn's; 0 keeps the first. A lost task repeats its part of a sum from the
    stores' files, so a step is never half done. With ``folder`` given, versions are stored every ``save_on`` epochs, at the end,
    and at each new least test loss. An evaluation keeps the model of its step, and up to ``EVALUATIONS`` of them, an epoch's at
    most, share one pass over the test rows; then they are added to the log, ``<folder>/losses``. A fit that ends by an error adds those it
    has, so it leaves its log; that of an earlier fit in the folder is replaced.
    """
    spark = train.sparkSession
    scorer = Scorer(vae, reactions, sample=True, eps=eps, coefficients=coefficients, beta_s=beta_s)
    tester = Scorer(vae, reactions, sample=True, eps=eps, coefficients=test_coefficients or coefficients,
                    beta_s=beta_s if test_beta_s is None else test_beta_s)
    batches = Batches(train, keys, batch_size, seed, turns, store_bytes)
    held_out = None if test is None else settle(test.select(*keys, "v"), "test")
    adam, evaluations, step, least = Adam(lr, vae.weight_decay), 0, 0, np.inf
    losses = f"{folder.rstrip('/')}/losses" if folder else scratch_path(spark, "losses")
    spark.createDataFrame([], LOG_SCHEMA).write.mode("overwrite").parquet(losses)
    model_bytes = 8 * sum(p.size for p in vae.params())
    together = max(1, min(EVALUATIONS, EVALUATION_BYTES // max(1, model_bytes)))
    waiting: list[tuple[Scorer | None, int, tuple]] = []  # model at its step, seed of its noise, and its part of the log

    def add_to_log() -> float:
        """Evaluates the models that wait; returns their least test loss."""
        tested = [[0.0] * 4] * len(waiting)
        if held_out is not None and waiting:
            tested = mean_losses(held_out, keys, [(model, at) for model, at, _ in waiting], with_stoich)
        rows = [(*row, *map(float, t)) for (_, _, row), t in zip(waiting, tested)]
        waiting.clear()
        if rows:
            spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(losses)
        return min((t[0] for t in tested), default=np.inf)

    for epoch in range(epochs):
        best_here = np.inf
        try:
            for i, (batch, rows) in enumerate(batches.epoch(epoch, seed, epoch // reload_on if reload_on else 0)):
                sums = sum_over_batch(rows.select("v", row_key(seed + step, *keys).alias("k")), scorer)
                if sums is None:  # no row of this turn falls into the batch
                    continue
                train_losses = apply_sums(vae, adam, sums)
                if save_losses_on and i % save_losses_on == 0:
                    now = None
                    if held_out is not None:
                        now = copy.copy(tester)
                        now.vae = copy.deepcopy(vae)
                    waiting.append((now, seed + step, (evaluations, epoch, batch, *map(float, train_losses))))
                    evaluations += 1
                    if len(waiting) == together:
                        best_here = min(best_here, add_to_log())
                step += 1
        finally:
            best_here = min(best_here, add_to_log())
        if folder and save_on and epoch % save_on == 0:
            save(spark, vae, folder, epoch)
        if folder and save_test_min and held_out is not None and best_here < least:
            least = best_here
            save(spark, vae, folder, epoch, test_min=True)
    if folder:
        save(spark, vae, folder, epochs - 1)
    return vae, spark.read.schema(LOG_SCHEMA).parquet(losses)
