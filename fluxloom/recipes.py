"""Whole tasks, from a folder of sample files to a result table.

``load`` harmonises a folder, ``train`` fits the autoencoder, ``process`` gives rows at a stage with their
losses, and the score functions compare clusterings, classifiers and training runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.operators import classify, cluster, gmm, harmonise, logs, metrics, sampling, stats, stoich
from fluxloom.operators.vae.fit import fit
from fluxloom.operators.vae.model import Vae
from fluxloom.operators.vae.scoring import EMB, PRE, STAGES, Scorer, SparseRows, row_key, stage_view
from fluxloom.session import bounded_rows, settle
from fluxloom.sources import flux_csv, sbml, tables

KEYS = ["file_name", "sample_n"]


@dataclass
class Dataset:
    """A harmonised folder: cells, their dictionary, and the coefficients of its models (empty without models)."""

    flux: DataFrame
    dim: DataFrame
    stoich: DataFrame

    def __post_init__(self):
        self.layout = stats.Dictionary.collect(self.dim)

    def reactions(self, join: str = "inner") -> list[str]:
        """Core reactions (``inner``) or all (``outer``), sorted."""
        kept = harmonise.select_reaction_set(self.dim, join)
        return stats.Dictionary.collect(kept).reactions

    def sample(self, n: int | None = None, seed: int = 0) -> DataFrame:
        """Dense rows (file_name, label, sample_n, row_id, v): all of them, or about ``n``, as many from each file."""
        return self.dense(self.layout, n, seed).withColumn("row_id", F.concat_ws("/", *KEYS))

    def rotation(self, n: int, epochs: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
        """Dense rows with the chunk that each belongs to, and the chunk that every file serves in every epoch."""
        samples = settle(sampling.sample_rows(self.flux), "samples")
        files = samples.select("file_name").distinct().count()
        per_file = max(1, n // max(1, files))
        chunks = settle(sampling.random_chunks(samples, per_file, seed), "chunks")
        turns = sampling.epoch_rotation(sampling.chunk_table(samples, per_file), epochs, seed)
        return self.sample(None, seed).join(chunks, KEYS), turns

    def dense(self, layout: stats.Dictionary, n: int | None, seed: int) -> DataFrame:
        cells = self.flux
        if n is not None:
            keys = settle(sampling.sample_rows(self.flux), "samples")
            drawn = settle(sampling.balanced_sample(keys, n, seed), "drawn")
            cells = cells.join(drawn, KEYS, "left_semi")
        return stats.dense_samples(cells, layout)

    def coefficients(self) -> SparseRows:
        return SparseRows.collect(self.stoich, self.layout.reactions)


def load(spark: SparkSession, path: str, models: str | None = None) -> Dataset:
    """Read a folder (or one file) of sample CSVs. With a folder of SBML models, reactions get canonical
    names, cells of one name are summed, and the models' coefficients are kept; a file without a model
    keeps its own names."""
    flux = flux_csv.read(spark, path)
    entries = spark.createDataFrame([], "model_n string, metabolite string, reaction string, stoich double")
    try:
        found = sbml.read_coefficients(spark, models) if models else None
    except AnalysisException:  # the folder has no model files: names stay as they are
        found = None
    if found is not None:
        species = settle(sbml.read_species(spark, models).distinct(), "species")
        named = settle(sbml.canonical_names(found, species, sbml.read_reactions(spark, models)), "names")
        known = settle(found.join(named, ["model", "reaction_id"]), "models")
        renames = named.select(F.col("model").alias("label"), F.col("reaction_id").alias("reaction"),
                               F.col("reaction").alias("new_name")).distinct()
        flux = harmonise.collapse_duplicates(harmonise.rename_reactions(flux, renames))
        entries = known.join(species, ["model", "metabolite"]).select(
            F.col("model").alias("model_n"), F.col("metabolite_name").alias("metabolite"), "reaction", "stoich")
    flux = settle(flux, "flux")
    dim = settle(stats.reaction_dim(flux), "dictionary")
    return Dataset(flux, dim, stoich.for_reactions(stoich.stoich_matrix(entries), dim))


def train(data: Dataset, folder: str, epochs: int = 1, batch_size: int = 64, n_emb: int = 128, n_lay: int = 5,
          lr: float = 1e-4, join: str = "inner", n: int | None = None, seed: int = 0, test: Dataset | None = None,
          test_size: int | None = None, beta_s: float = 0.0, test_beta_s: float | None = None, use_beta_s_in_test_loss: bool = False, save_on: int = 10,
          save_losses_on: int = 1, lrelu_slope: float = 0.0, reload_on: int = 1, **model) -> tuple[Vae, DataFrame]:
    """Fit a model to all rows (or a balanced sample of ``n``) and store its versions and loss log under ``folder``.

    Every ``reload_on`` epochs the sample is drawn anew: each file gives its next unused chunk; 0 keeps the first sample.
    The test set is laid out by the training reactions; what it lacks is 0.
    """
    reactions = data.reactions(join)
    scale = data.layout.subset(reactions)
    vae = Vae(len(reactions), n_emb, n_lay, lrelu_slope, reaction_names=reactions, v_mu=scale.mu, v_std=scale.sd,
              seed=seed, **model)
    held_out = None
    if test is not None:
        held_out = test.dense(data.layout, test_size, seed)
    coefficients = data.coefficients() if beta_s else None
    # The test set's own models, in the layout of the training set.
    weight = beta_s if test_beta_s is None else test_beta_s
    own = SparseRows.collect(test.stoich, data.layout.reactions) if test is not None and weight else None
    rows, turns = data.rotation(n, epochs, seed) if n is not None and reload_on else (data.sample(n, seed), None)
    vae, log = fit(rows, vae, epochs, batch_size, lr, seed, KEYS, data.layout.reactions, held_out, coefficients=coefficients,
                   test_coefficients=own, beta_s=beta_s, test_beta_s=test_beta_s, with_stoich=use_beta_s_in_test_loss,
                   save_on=save_on, save_losses_on=save_losses_on, folder=folder, turns=turns, reload_on=reload_on)
    return vae, log


def process(data: Dataset, vae: Vae | None = None, stage: str = PRE, n: int | None = None, join: str = "inner",
            sample: bool = False, prep: str = "none", add_losses: bool = False, beta_s: float = 0.0,
            restrictions: dict | None = None, seed: int = 0, components: int | None = None) -> DataFrame:
    """Rows of a sample at a stage: (file_name, label, sample_n, v), with ``prep='pca'`` in components (all, or the
    leading ``components``) and with the four losses of each row if asked."""
    if prep not in ("none", "pca"):
        raise ValueError("prep is 'none' or 'pca'")
    rows = harmonise.restrict_rows(data.sample(n, seed), restrictions or {})
    source, chosen = data.layout, data.reactions(join)
    keys = ["file_name", "label", "sample_n", "row_id"]
    if vae is None or stage == PRE:
        view = rows.select(*keys, stats.convert(F.col("v"), source, chosen).alias("v"))
    else:
        view = stage_view(rows, Scorer(vae, source.reactions, sample=sample), (stage,), keys=keys, seed=seed)
        view = view.drop("stage")
        if stage != EMB:
            view = view.withColumn("v", stats.convert(F.col("v"), source, chosen))
    if prep == "pca":
        view = settle(view, "view")
        view = cluster.Components(view, k=components).transform(view, out="v")
    if add_losses and vae is not None:
        scorer = Scorer(vae, source.reactions, sample=True, beta_s=beta_s,
                        coefficients=data.coefficients() if beta_s else None)
        scored = rows.select("row_id", scorer.row_losses("v", row_key(seed, *KEYS)).alias("l"))
        view = view.join(scored.select("row_id", "l.*"), "row_id")
    return view


def ari_score(data: Dataset, vae: Vae | None = None, stages=STAGES, k: int | None = None, n: int = 64,
              bootstrap_n: int = 128, rows: int | None = None, join: str = "inner", truth: str = "label",
              seed: int = 0) -> DataFrame:
    """Bootstrapped agreement of k-means at each stage and of the true labels: (set_a, set_b, mean, std)."""
    found = []
    for stage in stages:
        view = settle(process(data, vae, stage, rows, join, seed=seed), "view")
        found.append(cluster.kmeans_repeats(view, stage, n, k or cluster.n_labels(view, truth), seed))
        labels = view.select(F.lit("label").alias("set_name"), F.lit(0).cast("bigint").alias("rep"), "row_id",
                             F.col(truth).cast("string").alias("cluster"))
    sets = labels
    for each in found:
        sets = sets.unionByName(each)
    return metrics.bootstrap_ari(settle(sets, "sets"), bootstrap_n, seed)


def wcss_score(data: Dataset, vae: Vae | None = None, stages=STAGES, max_k: int | None = None, n: int = 8,
               rows: int | None = None, join: str = "inner", seed: int = 0) -> DataFrame:
    """Elbow curve per stage; by default up to as many clusters as there are files."""
    views = [process(data, vae, s, rows, join, seed=seed).select("row_id", F.lit(s).alias("stage"), "v") for s in stages]
    stacked = views[0]
    for view in views[1:]:
        stacked = stacked.unionByName(view)
    top = max_k or data.flux.agg(F.count_distinct("file_name")).first()[0]
    return cluster.wcss_curve(settle(stacked, "stages"), top, n, seed)


def _train_test_views(train_set: Dataset, test_set: Dataset, vae, stage, join, rows, seed):
    """Both sets at a stage, in the layout of the training set."""
    aligned = Dataset(test_set.flux, train_set.dim, train_set.stoich)
    return (settle(process(train_set, vae, stage, rows, join, seed=seed), "view"),
            settle(process(aligned, vae, stage, rows, join, seed=seed + 1), "view"))


def _matrix(predicted: DataFrame, classes: list[str], truth: str) -> DataFrame:
    return metrics.prediction_matrix(predicted, truth, "pred", classes)


def nearest_centroid_score(train_set: Dataset, test_set: Dataset, vae: Vae | None = None, stage: str = PRE,
                           join: str = "inner", group: str = "label", rows: int | None = None, seed: int = 0) -> DataFrame:
    """Per test group, the share of rows predicted as each training group."""
    fitted, tested = _train_test_views(train_set, test_set, vae, stage, join, rows, seed)
    classes = sorted(r[0] for r in bounded_rows(fitted.select(group).distinct(), metrics.MAX_COLUMNS, "classes"))
    return _matrix(classify.nearest_centroid(fitted, tested, group), classes, group)


def gmm_score(train_set: Dataset, test_set: Dataset, vae: Vae | None = None, stage: str = PRE, join: str = "inner",
              rows: int | None = None, seed: int = 0) -> DataFrame:
    """The same by the densest of one Gaussian per training label."""
    fitted, tested = _train_test_views(train_set, test_set, vae, stage, join, rows, seed)
    classes = sorted(r[0] for r in bounded_rows(fitted.select("label").distinct(), metrics.MAX_COLUMNS, "classes"))
    return _matrix(gmm.classify(fitted, tested), classes, "label")


def loss_scoring(log: DataFrame, args: DataFrame, average_over: int = 128, by_epoch: bool = False) -> DataFrame:
    """One row per run (tail mean) or per run and epoch, with the run's arguments."""
    scores = logs.epoch_mean(log) if by_epoch else logs.tail_average(log, average_over)
    return logs.attach_run_args(scores, args)
