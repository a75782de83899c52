"""The autoencoder against plain formulas, its gradient against differences, and its fit."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.operators.sampling import epoch_rotation
from fluxloom.operators.vae import Scorer, SparseRows, Vae
from fluxloom.operators.vae import model as store
from fluxloom.operators.vae.fit import Adam, Batches, apply_sums, batch_sums, fit
from fluxloom.operators.vae.network import forward, layer_sizes, normals
from fluxloom.operators.vae.scoring import dataset_loss, row_key, stage_view
from fluxloom.session import settle

NAMES = [f"r{i}" for i in range(6)]


def data(n=40, d=6, seed=0):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, 2)) @ rng.normal(size=(2, d)) + 0.1 * rng.normal(size=(n, d))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(data())],
                                 "row_id bigint, label string, v array<double>").repartition(3).cache()


def values(df, column):
    return np.array([r[column] for r in df.orderBy("row_id").collect()])


def test_sizes_fall_evenly():
    assert layer_sizes(64, 8, 3) == [64, 36, 8]
    assert layer_sizes(4, 64, 3) == [4, 34, 64]


@pytest.mark.parametrize("how", [{}, {"legacy_vae": True}, {"batch_norm": True, "n_lay": 4},
                                 {"batch_norm": True, "n_lay": 5, "dropout_p": 0.3}])
def test_gradient_equals_differences(how):
    rng = np.random.default_rng(3)
    vae = Vae(**{"n_in": 6, "n_emb": 2, "n_lay": 3, "reaction_names": NAMES, "v_mu": rng.normal(size=6),
                 "v_std": rng.uniform(0.5, 2, size=6), "seed": 4, **how})
    if vae.legacy_vae:  # keep 1 + output positive, as the logarithm needs
        for layer in vae.encoder[-1:]:
            layer.w *= 0.05
            layer.b[2:] = 0.5
    coefficients = SparseRows(np.array([0, 0, 1]), np.array([0, 2, 5]), np.array([1.0, -2.0, 0.5]))
    scorer = Scorer(vae, [*NAMES[::-1], "extra"], eps="normal", coefficients=coefficients, beta_s=0.3)
    v = np.c_[data(seed=5), np.ones(40)]
    keys = np.arange(40)

    def run():
        return batch_sums(scorer, v, keys)

    sums, at = run(), 5
    for p in vae.params():
        grad = sums[at:at + p.size].reshape(p.shape)
        at += p.size
        for index in [tuple(rng.integers(s) for s in p.shape) for _ in range(6)]:
            keep, h = p[index], 1e-6
            p[index] = keep + h
            up = run()[1]
            p[index] = keep - h
            down = run()[1]
            p[index] = keep
            assert grad[index] == pytest.approx((up - down) / (2 * h), rel=1e-3, abs=1e-4)


def test_sums_over_tasks_equal_one_batch(spark, rows):
    from fluxloom.operators.vae.fit import sum_over_batch

    vae = Vae(6, 2, 3, reaction_names=NAMES, seed=1)
    scorer = Scorer(vae, NAMES, sample=True)
    keyed = rows.select("v", F.col("row_id").alias("k"))
    found = sum_over_batch(keyed, scorer)
    v, keys = values(rows, "v"), np.arange(40)
    assert np.allclose(found, batch_sums(scorer, v, keys))


def test_encode_decode_and_passthrough(rows):
    vae = Vae(4, 2, 3, reaction_names=["r5", "r1", "absent", "r2"], v_mu=np.ones(4), v_std=np.full(4, 2.0), seed=2)
    s = Scorer(vae, NAMES)
    assert s.missing == 1
    v = values(rows, "v")
    x = np.stack([v[:, 5], v[:, 1], np.zeros(len(v)), v[:, 2]], axis=1)
    y = forward(vae.encoder, (x - 1) / 2, 0.01)
    coded = rows.withColumn("z", s.encode("v", row_key(0, "row_id")))
    assert np.allclose(values(coded, "z"), y[:, :2])
    rebuilt = values(coded.withColumn("r", s.decode("z", "v")), "r")
    out = forward(vae.decoder, y[:, :2], 0.01) * 2 + 1
    assert np.allclose(rebuilt[:, [5, 1, 2]], out[:, [0, 1, 3]])
    assert np.allclose(rebuilt[:, [0, 3, 4]], v[:, [0, 3, 4]])


def test_sampling_depends_on_the_row_only(rows):
    s = Scorer(Vae(6, 2, 3, reaction_names=NAMES, seed=1), NAMES, sample=True)
    one = values(rows.withColumn("z", s.encode("v", row_key(0, "row_id"))), "z")
    two = values(rows.repartition(11).withColumn("z", s.encode("v", row_key(0, "row_id"))), "z")
    assert np.array_equal(one, two)
    assert not np.allclose(one, values(rows.withColumn("z", s.encode("v", row_key(1, "row_id"))), "z"))
    draws = normals(np.arange(20000), 3)
    assert abs(draws.mean()) < 0.02 and abs(draws.std() - 1) < 0.02


def test_batch_of_rows_is_the_mean_of_row_losses(rows):
    vae = Vae(6, 2, 3, reaction_names=NAMES, seed=1)
    s = Scorer(vae, NAMES, eps="ones")
    found = rows.withColumn("l", s.row_losses("v", row_key(0, "row_id"))).select("l.*")
    x, mu, log_var, std = vae.latent(values(rows, "v"))
    out = forward(vae.decoder, mu + std, 0.01)
    rec = ((x - out) ** 2).sum() / len(x)
    div = 0.5 * (np.exp(log_var) + mu**2 - log_var - 1).sum() / len(x)
    mean = dataset_loss(found).first()
    assert (mean.loss, mean.reconstruction_loss) == (pytest.approx(rec + div), pytest.approx(rec))


def test_stoichiometry_loss_is_zero_for_balanced_rows():
    coefficients = SparseRows(np.array([0, 0]), np.array([0, 1]), np.array([1.0, -1.0]))
    assert np.allclose(coefficients.times(np.array([[2.0, 2.0, 7.0]])), 0)
    assert np.allclose(coefficients.times_transposed(np.array([[3.0]]), 3), [[3.0, -3.0, 0.0]])


def test_restrictions_come_before_scoring(rows):
    view = stage_view(rows, Scorer(Vae(6, 2, 3, reaction_names=NAMES), NAMES), ("pre", "rec"), {"label": "a", "no": 1})
    assert view.count() == 2 * 20
    assert {r.stage for r in view.collect()} == {"pre", "rec"}


def test_adam_first_step_is_the_learning_rate():
    p = [np.array([1.0, -2.0])]
    Adam(0.1).step(p, [np.array([5.0, -0.01])])
    assert np.allclose(p[0], [0.9, -1.9], atol=1e-5)


def test_fit_lowers_the_loss_and_repeats(spark, rows, tmp_path):
    def run(**how):
        vae = Vae(6, 2, 3, reaction_names=NAMES, seed=1, **how.pop("vae", {}))
        return fit(rows, vae, keys=["row_id"], reactions=NAMES, **how)

    vae, log = run(epochs=3, batch_size=20, lr=0.02, seed=1, test=rows, folder=str(tmp_path), save_on=1)
    first, last = (log.orderBy(o).first().test_loss for o in (F.col("eval_n"), F.col("eval_n").desc()))
    assert log.count() == 6 and last < first
    assert store.versions(spark, str(tmp_path)) == ["0", "1", "2", "testmin"]
    again = store.load(spark, str(tmp_path))
    assert all(np.array_equal(a, b) for a, b in zip(vae.params(), again.params()))
    same, _ = run(epochs=3, batch_size=20, lr=0.02, seed=1)
    assert all(np.allclose(a, b) for a, b in zip(vae.params(), same.params()))
    assert run(epochs=1, batch_size=20, lr=0.02, seed=1, save_losses_on=2)[1].count() == 1
    run(epochs=1, batch_size=40, lr=0.02, seed=1, vae={"batch_norm": True, "dropout_p": 0.2, "weight_decay": 0.1})


@pytest.mark.parametrize("files,batch", [(1, 10_000), (7, 10_000), (3, 4)])
def test_fit_does_not_depend_on_files_or_arrow_batches(spark, rows, files, batch):
    """Normalisation over the whole batch and dropout by row: equal to one batch in numpy, however the rows are dealt."""
    vae = Vae(6, 2, 4, reaction_names=NAMES, seed=1, batch_norm=True, dropout_p=0.2)
    plain = Vae(6, 2, 4, reaction_names=NAMES, seed=1, batch_norm=True, dropout_p=0.2)
    scorer, v = Scorer(plain, NAMES, sample=True), values(rows, "v")
    adam, adam_losses = Adam(0.02), []
    for step in range(3):
        keys = values(rows.select("row_id", row_key(1 + step, "row_id").alias("k")), "k")
        adam_losses.append(apply_sums(plain, adam, batch_sums(scorer, v, keys)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        dealt = settle(rows.repartition(files), "dealt")
        _, log = fit(dealt, vae, 3, 40, 0.02, 1, ["row_id"], NAMES)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert np.allclose([r.loss for r in log.orderBy("eval_n").collect()], [x[0] for x in adam_losses], rtol=1e-9)
    for a, b in zip(vae.params(), plain.params()):
        assert np.allclose(a, b, rtol=1e-7, atol=1e-9)
    for a, b in zip([*vae.encoder, *vae.decoder], [*plain.encoder, *plain.decoder]):
        assert all(np.allclose(x, y) for x, y in zip(a.stats(), b.stats()))


def chunked(spark):
    """Three files of 2, 3 and 5 chunks of 8, 6 and 7 rows."""
    found = [(f"f{f}", s, s // size, data(80, seed=f)[s].tolist()) for f, (n, size) in enumerate(((2, 8), (3, 6), (5, 7)))
             for s in range(n * size)]
    return spark.createDataFrame(found, "file_name string, sample_n bigint, chunk bigint, v array<double>")


def test_rows_of_an_epoch_are_those_of_the_rotation(spark):
    rows = settle(chunked(spark), "chunked")
    sizes = spark.createDataFrame([("f0", 2), ("f1", 3), ("f2", 5)], "file_name string, n_chunks bigint")
    turns = settle(epoch_rotation(sizes, 6, 3), "turns")
    batches = Batches(rows, ["file_name", "sample_n"], 5, 1, turns, store_bytes=700)
    assert batches.per_store < batches.n  # several stores
    served = {(r.epoch, r.file_name): r.chunk for r in turns.collect()}
    every = rows.collect()
    for epoch in range(6):
        parts = [(batch, [(r.file_name, r.sample_n) for r in part.collect()]) for batch, part in batches.epoch(epoch, 9)]
        assert sorted(batch for batch, _ in parts) == list(range(batches.n))
        assert max(len(own) for _, own in parts) <= 5 + 3
        assert sorted(k for _, own in parts for k in own) == sorted(
            (r.file_name, r.sample_n) for r in every if served[epoch, r.file_name] == r.chunk)
    held = [[r.sample_n for _, part in batches.epoch(e, 9, turn=0) for r in part.collect()] for e in (0, 3)]
    assert sorted(held[0]) == sorted(held[1])  # a sample that is not reloaded


def test_stores_follow_bytes_and_a_killed_fit_leaves_its_log(spark, rows, tmp_path, monkeypatch):
    for size in (40, 4, 1):
        stored = Batches(rows, ["row_id"], size, 1, store_bytes=1 << 20)
        assert stored.n == 40 // size and stored.stored.select("store").distinct().count() == 1
        assert len(stored.stored.inputFiles()) <= 8
    assert Batches(rows, ["row_id"], 4, 1, store_bytes=640).stored.select("store").distinct().count() == 3
    from fluxloom.operators.vae import fit as module

    whole, calls = module.apply_sums, []

    def killed(*given):
        calls.append(1)
        if len(calls) == 4:
            raise KeyboardInterrupt
        return whole(*given)

    monkeypatch.setattr(module, "apply_sums", killed)
    with pytest.raises(KeyboardInterrupt):
        fit(rows, Vae(6, 2, 3, reaction_names=NAMES), 2, 10, 0.01, 1, ["row_id"], NAMES, folder=str(tmp_path))
    assert [r.eval_n for r in spark.read.parquet(f"{tmp_path}/losses").orderBy("eval_n").collect()] == [0, 1, 2]


def test_newest_version_is_by_number(spark, tmp_path):
    for seed, epoch in ((1, 9), (2, 31)):
        store.save(spark, Vae(6, 2, 3, seed=seed, batch_norm=True), str(tmp_path), epoch)
    store.save(spark, Vae(6, 2, 3, seed=3), str(tmp_path), 9, test_min=True)
    assert np.array_equal(store.load(spark, str(tmp_path)).params()[0], Vae(6, 2, 3, seed=2).params()[0])
    assert np.array_equal(store.load(spark, str(tmp_path), "testmin").params()[0], Vae(6, 2, 3, seed=3).params()[0])
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path), 5)
    with pytest.raises(FileNotFoundError):
        store.load(spark, str(tmp_path / "none"))


def test_evaluations_share_passes_and_equal_single_ones(spark, rows, monkeypatch):
    """Losses of a pass over several models are those of one model at a time, and a fit makes few passes."""
    from fluxloom.operators.vae import fit as module

    models = [(Scorer(Vae(6, 2, 3, reaction_names=NAMES, seed=s), NAMES, sample=True), s) for s in (1, 2, 3)]
    found = module.mean_losses(rows.select("row_id", "v"), ["row_id"], models)
    for (scorer, seed), losses in zip(models, found):
        plain = dataset_loss(rows.select(scorer.row_losses("v", row_key(seed, "row_id")).alias("l")).select("l.*")).first()
        assert np.allclose(losses, list(plain), rtol=1e-12)
    whole, passes = module.mean_losses, []

    def counted(rows, keys, models, *given):
        passes.append(len(models))
        return whole(rows, keys, models, *given)

    monkeypatch.setattr(module, "mean_losses", counted)
    monkeypatch.setattr(module, "EVALUATIONS", 3)
    _, log = fit(rows, Vae(6, 2, 3, reaction_names=NAMES, seed=1), 1, 10, 0.01, 1, ["row_id"], NAMES, test=rows)
    assert passes == [3, 1] and log.count() == 4
