"""Clustering, classifiers, densities and scores against plain numpy."""

import itertools
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import classify, cluster, gmm, lloyd, metrics, tiles
from fluxloom.operators.dbscan import block_pairs, dbscan
from fluxloom.operators.distance import Centres, nearest, nearest_given, nearest_in_turns, nearest_rows, within
from fluxloom.operators.moments import group_products, group_sums
from fluxloom.plans import fixtures as fx
from fluxloom.session import TooLarge, settle


def blobs(seed=0, n=150, d=3, k=4, spread=0.4):
    rng = np.random.default_rng(seed)
    at = rng.integers(k, size=n)
    return rng.normal(size=(k, d))[at] * 4 + rng.normal(size=(n, d)) * spread, at


@pytest.fixture(scope="module")
def rows(spark):
    x, at = blobs()
    return spark.createDataFrame([(i, f"l{a}", v.tolist()) for i, (v, a) in enumerate(zip(x, at))],
                                 "row_id bigint, label string, v array<double>").repartition(5).cache()


def arrays(rows):
    got = sorted(rows.collect(), key=lambda r: r.row_id)
    return np.array([r.v for r in got]), np.array([r.label for r in got])


def brute_dbscan(x, eps, least):
    near = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    out, number = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if out[i] >= 0:
            continue
        stack, out[i] = [i], number
        while stack:
            for j in np.flatnonzero(near[stack.pop()] & core & (out < 0)):
                out[j] = number
                stack.append(j)
        number += 1
    for i in np.flatnonzero(~core):
        touched = out[near[i] & core]
        out[i] = touched.min() if len(touched) else -1
    return out


@pytest.mark.parametrize("eps, least, block_rows", [(0.5, 5, 2000), (0.9, 4, 7), (0.35, 3, 20), (50.0, 5, 30)])
def test_dbscan_equals_brute_force(rows, eps, least, block_rows):
    found = dbscan(rows, "row_id", "v", eps, least, block_rows=block_rows).orderBy("row_id").collect()
    assert [r.cluster for r in found] == brute_dbscan(arrays(rows)[0], eps, least).tolist()


def test_pivots_prune_clustered_rows_in_many_dimensions(spark):
    """Unit vectors of 64 axes in 30 tight groups: a grid on three axes cuts little, pivots leave few pairs of blocks."""
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(30, 64))
    x = centres[draw.integers(0, 30, 1500)] + 0.03 * draw.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, v array<double>").repartition(4)
    blocked, pairs = block_pairs(df.select(F.col("row_id").alias("pid"), "v", F.lit(1).alias("w")), 0.2, 20)
    blocks = blocked.select("block").distinct().count()
    compared = pairs.select("pair").distinct().count()
    assert blocks >= 75 and compared < 0.15 * blocks * (blocks + 1) / 2
    found = dbscan(df, "row_id", "v", 0.2, 5, block_rows=20).orderBy("row_id").collect()
    assert [r.cluster for r in found] == brute_dbscan(x, 0.2, 5).tolist()


@pytest.mark.parametrize("eps", [1e-6, 0.1, 0.5, 2.0])
def test_no_neighbours_are_pruned(spark, eps):
    """Every pair within eps meets in a pair of blocks, far from 0 and at near ties too."""
    draw = np.random.default_rng(7)
    x = 1000.0 + np.concatenate([draw.normal(size=(150, 5)), draw.integers(0, 3, (60, 5))])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "pid bigint, v array<double>, w bigint")
    blocked, pairs = block_pairs(df, eps, 9)
    of = {r.pid: r.block for r in blocked.collect()}
    kept = {r.pair for r in pairs.collect()}
    near = np.argwhere(((x[:, None] - x[None]) ** 2).sum(-1) <= eps**2)
    assert all("~".join(sorted((of[i], of[j]))) in kept for i, j in near)


def test_dbscan_counts_copies(spark):
    """Most rows are copies of one vector; they weigh in as rows but are compared once."""
    x = np.concatenate([np.zeros((40, 2)), [[0.3, 0.0], [0.6, 0.0], [9.0, 9.0]]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, v array<double>")
    found = dbscan(df, "row_id", "v", 0.4, 5).orderBy("row_id").collect()
    assert [r.cluster for r in found] == brute_dbscan(x, 0.4, 5).tolist()


def test_dbscan_without_core_rows_is_all_noise(rows):
    assert {r.cluster for r in dbscan(rows, "row_id", "v", 1e-9, 2).collect()} == {-1}


def test_group_moments(rows):
    x, label = arrays(rows)
    for r in group_sums(rows, "label").collect():
        assert r.n == (label == r.label).sum()
        assert np.allclose(r.total, x[label == r.label].sum(axis=0))
    for r in group_products(rows, "label").collect():
        mine = x[label == r.label]
        assert r.xx == pytest.approx(mine[:, r.i] @ mine[:, r.j])


def test_gaussians_per_label(rows):
    x, label = arrays(rows)
    model = gmm.Densities.fit(rows)
    expected = np.empty((len(x), len(model.labels)))
    for k, name in enumerate(model.labels):
        mine = x[label == name]
        cov = np.cov(mine.T, ddof=0) + 1e-6 * np.eye(x.shape[1])
        diff = x - mine.mean(axis=0)
        expected[:, k] = -0.5 * (np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff)
                                 + np.linalg.slogdet(cov)[1] + x.shape[1] * np.log(2 * np.pi))
    assert np.allclose(model.log_density(x), expected)
    found = model.classify(rows).orderBy("row_id").collect()
    assert [r.pred for r in found] == [model.labels[k] for k in expected.argmax(axis=1)]


@pytest.mark.parametrize("side, turn_bytes", [(1, 1), (2, 40), (512, 100)])
def test_gaussians_in_turns_equal_the_direct_path(rows, side, turn_bytes):
    direct = gmm.Densities.fit(rows).classify(rows).select("row_id", "pred").orderBy("row_id").collect()
    turns = gmm.classify_in_turns(rows, rows, side=side, turn_bytes=turn_bytes)
    assert turns.select("row_id", "pred").orderBy("row_id").collect() == direct
    assert turns.columns == [*rows.columns, "pred"]


def test_inverse_factors_of_tiles(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 11)) @ rng.normal(size=(11, 11)) + 1e3
    rows = spark.createDataFrame([("a" if i % 3 else "b", v.tolist()) for i, v in enumerate(x)],
                                 "label string, v array<double>").repartition(4)
    for side in (4, 5, 20):
        means, cov, _ = gmm._moments(rows, "label", "v", side)
        table = tiles.whiten(settle(cov), "label", 11, side).collect()
        for name, mine in (("a", x[np.arange(90) % 3 > 0]), ("b", x[np.arange(90) % 3 == 0])):
            w = np.zeros((11, 11))
            for r in table:
                if r["label"] == name:
                    tile = np.frombuffer(r["tile"]).reshape(min(side, 11 - r["i"] * side), -1)
                    w[r["i"] * side : r["i"] * side + tile.shape[0], r["j"] * side : r["j"] * side + tile.shape[1]] = tile
            expected = np.linalg.inv(np.linalg.cholesky(np.cov(mine.T, ddof=0) + 1e-6 * np.eye(11)))
            assert np.allclose(w, expected, rtol=1e-6, atol=1e-9)
            assert np.allclose(means[name], mine.mean(axis=0))


def test_mixture_of_two(rows):
    assert gmm.fit_mixture(rows, "l0", 2).getK() == 2


def test_components_equal_svd(rows):
    x, _ = arrays(rows)
    parts = cluster.Components(rows)
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    axes = vt.T * np.sign(vt.T[np.abs(vt.T).argmax(axis=0), np.arange(len(vt))])
    found = np.array([r.pca for r in parts.transform(rows).orderBy("row_id").collect()])
    assert np.allclose(found, centred @ axes, atol=1e-8)
    assert np.allclose(found.mean(axis=0), 0)
    scree = parts.scree(rows.sparkSession).orderBy("component").collect()
    assert np.allclose([r.ratio for r in scree], s**2 / (s**2).sum())
    assert np.allclose([r.cumulative for r in scree], np.r_[0, np.cumsum(s**2 / (s**2).sum())[:-1]])


@pytest.mark.parametrize("d, k, n", [(40, 3, 300), (40, 40, 300), (60, 25, 20), (30, 5, 8)])
def test_leading_components_equal_svd(spark, d, k, n):
    rng = np.random.default_rng(d + k)
    x = rng.normal(size=(n, d)) * np.linspace(3, 0.5, d) + 100
    rows = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(3)
    centred = x - x.mean(axis=0)
    axes, ratio = cluster.leading(rows, x.mean(axis=0), k, block=4)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    s = np.r_[s, np.zeros(max(0, k - len(s)))]
    assert axes.shape == (d, k) and np.allclose(axes.T @ axes, np.eye(k), atol=1e-10)
    assert np.allclose(ratio, (s**2 / (s**2).sum())[:k], atol=1e-9)
    real = int((s[:k] > 1e-6).sum())
    assert np.allclose(np.abs((centred @ axes)[:, :real]), np.abs(centred @ vt.T[:, :real]), atol=1e-6)


def test_wide_components_take_the_other_path(rows, monkeypatch):
    plain = cluster.Components(rows, k=2)
    monkeypatch.setattr(cluster, "BROADCAST_BYTES", 71)  # three columns have 72 bytes of moments
    monkeypatch.setattr(cluster, "PCA", None)
    wide = cluster.Components(rows, k=2)
    assert np.allclose(wide.axes, plain.axes) and np.allclose(wide.ratio, plain.ratio)
    monkeypatch.setattr(cluster, "SPACE_BYTES", 71)
    with pytest.raises(TooLarge):
        cluster.Components(rows, k=2)


def test_nearest_given_goes_in_turns_beyond_the_bound(spark, rows):
    x, _ = blobs(9, n=60)
    table = spark.createDataFrame([(f"c{i:02d}", v.tolist()) for i, v in enumerate(x)], "id string, c array<double>")
    plain, turns = (nearest_given(rows, "v", table, "id", "c", "cluster", "d2", limit).select("row_id", "cluster", "d2")
                    for limit in (1 << 20, 300))
    assert sorted(plain.collect()) == sorted(turns.collect())


def brute_cost(x, centres):
    return ((x[:, None, :] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_lloyd_steps_do_not_raise_the_cost_and_end_at_a_fixed_point(rows):
    x, _ = arrays(rows)
    costs = [lloyd.fit_many(rows, [(3, 5)], "row_id", max_iter=n)[0].cost for n in (1, 2, 4, 50)]
    assert all(a >= b - 1e-9 for a, b in zip(costs, costs[1:]))
    fits = lloyd.fit_many(rows, [(1, 0), (3, 5), (4, 6)], "row_id")
    assert fits[1].cost == pytest.approx(costs[-1])  # the same alone and among others
    for f in fits:
        assert f.cost == pytest.approx(brute_cost(x, f.centres))
        at = ((x[:, None, :] - f.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(f.k):
            assert np.allclose(x[at == k].mean(axis=0), f.centres[k], atol=1e-3)


def test_kmeans_finds_the_blobs(rows):
    _, label = arrays(rows)
    found = cluster.kmeans_cluster(rows, seed=3).orderBy("row_id").collect()
    assert len({r.cluster for r in found}) == len(set(label))
    repeats = cluster.kmeans_repeats(rows, "pre", 3, seed=3)
    assert repeats.groupBy("rep").count().collect() and repeats.count() == 3 * len(label)


def test_wcss_curve(rows):
    x, _ = arrays(rows)
    curve = cluster.wcss_curve(rows.withColumn("stage", F.lit("pre")), 4, n=2).orderBy("k").collect()
    assert [r.k for r in curve] == [1, 2, 3, 4]
    assert curve[0].wcss == pytest.approx(((x - x.mean(axis=0)) ** 2).sum() / len(x))
    assert curve[0].wcss_std == 0 and curve[3].wcss < curve[0].wcss


def test_nearest_of_equals_is_the_least_id(spark):
    df = spark.createDataFrame([(0, [0.0])], "row_id bigint, v array<double>")
    assert nearest(df, "v", Centres(["b", "c"], np.array([[1.0], [-1.0]])), "c").first().c == "b"


def test_nearest_in_turns_equals_broadcast(spark, rows):
    x, _ = blobs(9, n=60)
    table = spark.createDataFrame([(f"c{i:02d}", v.tolist()) for i, v in enumerate(x)], "id string, c array<double>")
    plain = nearest(rows, "v", Centres.collect(table, "id", "c"), "cluster").select("row_id", "cluster")
    turns = nearest_in_turns(rows, "v", table, "id", "c", turn_rows=9).select("row_id", "cluster")
    assert sorted(plain.collect()) == sorted(turns.collect())


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_products_agree_with_differences(offset):
    rng = np.random.default_rng(7)
    x, c = rng.integers(0, 3, size=(80, 3)) + offset, rng.integers(0, 3, size=(9, 3)) + offset  # many ties
    exact = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    best, least = nearest_rows(x, c)
    assert np.array_equal(best, exact.argmin(axis=1)) and np.array_equal(least, exact.min(axis=1))
    for radius in (1.0, np.sqrt(2.0), 2.5):
        assert np.array_equal(within(x, c, radius), exact <= radius * radius)


def test_too_many_centres_are_refused():
    with pytest.raises(TooLarge):
        Centres([0], np.zeros((1, 9_000_000)))


def test_classifiers_learn_the_blobs(rows):
    _, label = arrays(rows)
    for fn in (classify.nearest_centroid, classify.random_forest, classify.mlp_classifier):
        found = fn(rows, rows, "label") if fn is classify.nearest_centroid else fn(rows, rows, "label", seed=1)
        assert found.filter("pred = label").count() > 0.9 * len(label)
    both = classify.repeated({"NC": lambda a, b, s: classify.nearest_centroid(a, b, "label")}, rows, rows, 2)
    assert both.groupBy("rep", "classifier").count().count() == 2


def sets(spark, **labels):
    return spark.createDataFrame(
        [(name, rep, i, str(c)) for name, reps in labels.items() for rep, xs in enumerate(reps) for i, c in enumerate(xs)],
        "set_name string, rep bigint, row_id bigint, cluster string")


def brute_ari(a, b):
    pairs = list(itertools.combinations(range(len(a)), 2))
    same_a, same_b = [np.array([s[i] == s[j] for i, j in pairs]) for s in (a, b)]
    cells, ra, rb = (same_a & same_b).sum(), same_a.sum(), same_b.sum()
    expected = ra * rb / len(pairs)
    return 1.0 if (ra + rb) / 2 == expected else (cells - expected) / ((ra + rb) / 2 - expected)


def test_ari_is_symmetric_and_one_for_equals(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(3, size=30), rng.integers(4, size=30)
    found = {(r.set_a, r.set_b): r.score for r in metrics.ari(sets(spark, a=[a], b=[b], flat=[[0] * 30])).collect()}
    assert found[("a", "b")] == pytest.approx(brute_ari(a, b))
    assert found[("a", "a")] == pytest.approx(1.0)
    assert found[("flat", "flat")] == 1.0  # all rows in one cluster on both sides
    ways = metrics.both_ways(metrics.ari(sets(spark, a=[a], b=[b])))
    assert {(r.set_a, r.set_b): round(r.score, 9) for r in ways.collect()}[("b", "a")] == round(found[("a", "b")], 9)


@pytest.mark.parametrize("held", [16_000_000, 0])
def test_pair_counts_equal_plain_ones(spark, monkeypatch, held):
    """Clusterings with labels of their own, rows that some lack, and labels that come only in later batches."""
    monkeypatch.setattr(metrics, "HELD_COUNTS", held)
    draw = np.random.default_rng(8)
    sets = [("a", 0), ("a", 1), ("b", 0), ("c", 3)]
    rows = [(name, rep, i, str(draw.integers(0, 3 + i // 20)) if name != "c" else f"x{i % 2}")
            for name, rep in sets for i in range(80) if draw.random() < 0.9]
    pairs = [(sets[0], sets[2]), (sets[0], sets[0]), (sets[1], sets[3]), (sets[2], sets[3]), (sets[1], sets[2])]
    clusterings = spark.createDataFrame(rows, "set_name string, rep bigint, row_id bigint, cluster string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    try:
        found = metrics.pair_counts(clusterings, pairs).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    of = {s: {i: c for name, rep, i, c in rows if (name, rep) == s} for s in sets}
    plain = Counter((*a, *b, of[a][i], of[b][i]) for a, b in pairs for i in of[a] if i in of[b])
    assert {tuple(r)[:6]: r.n for r in found} == plain and len(found) == len(plain)


def test_many_clusterings_are_counted_together():
    """193 clusterings, all pairs: one pass per clustering and batch."""
    draw = np.random.default_rng(9)
    rows, width = 400, 193
    places = np.array([(i, j) for i in range(width) for j in range(i, width)])
    at = pa.array([list(range(width))] * rows, pa.list_(pa.int32()))
    labels = draw.integers(0, 8, (rows, width))
    batch = pa.RecordBatch.from_arrays([at, pa.array(labels.astype(str).tolist(), pa.list_(pa.string()))], ["at", "cluster"])
    start = time.perf_counter()
    found = pa.Table.from_batches(list(metrics._count_pairs(places, width)(iter([batch] * 3))))
    assert time.perf_counter() - start < 20
    assert found["n"].to_numpy().sum() == 3 * rows * len(places)
    one = found.filter(pa.compute.equal(found["p"], int(np.flatnonzero((places == (5, 9)).all(1))[0])))
    plain = Counter(zip(labels[:, 5].astype(str), labels[:, 9].astype(str), strict=True))
    assert {(r["a"], r["b"]): r["n"] for r in one.to_pylist()} == {k: 3 * n for k, n in plain.items()}


def test_other_scores_fit_the_matrix(spark):
    both = sets(spark, a=[[0, 0, 1, 1]], b=[[0, 1, 1, 1], [0, 0, 1, 1]])
    found = {(r.set_a, r.set_b): (r.mean, r.std) for r in metrics.score_matrix(both, metrics.rand_agreement).collect()}
    assert found[("a", "b")] == (0.875, 0.125)
    assert found[("b", "b")] == pytest.approx((0.875, 0.125))


def greedy(counts):
    left, out = {c: dict(ls) for c, ls in counts.items()}, {}
    while left:
        c = min(left, key=lambda c: (-max([*left[c].values(), -1]), c))
        labels = left.pop(c)
        if not labels:
            out[c] = None
            continue
        out[c] = min(labels, key=lambda l: (-labels[l], l))
        for other in left.values():
            other.pop(out[c], None)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_match_in_rounds_equals_one_by_one(spark, seed):
    rng = np.random.default_rng(seed)
    counts = {f"c{i}": {f"l{j}": int(n) for j, n in enumerate(rng.integers(0, 6, size=4)) if n} for i in range(6)}
    counts = {c: ls for c, ls in counts.items() if ls}
    table = spark.createDataFrame([(c, l, n) for c, ls in counts.items() for l, n in ls.items()],
                                  "cluster string, label string, n bigint")
    rounds = {r.cluster: r.label for r in metrics.greedy_match(table).collect()}
    assert rounds == greedy(counts)
    assert None in rounds.values()  # more clusters than labels


def test_prediction_rows_add_up_to_one(spark, sf):
    from fluxloom.plans import registry

    matrix = registry()[0]["prediction_matrix"](spark, sf).collect()
    assert all(sum(r[1:]) == pytest.approx(1.0, abs=1e-4) for r in matrix)


def test_single_row_group_has_no_spread(spark):
    df = spark.createDataFrame([("a", 2.0)], "g string, x double")
    assert metrics.group_mean_std(df, ["g"], "x").first().std == 0.0


def test_fixture_split_uses_every_row(spark, sf):
    rows = fx.emb(spark, sf)
    assert rows.filter("split in ('train', 'test')").count() == rows.count()


def test_bootstrap_draws_any_repeat_numbers(spark):
    rows = [(s, rep, i, str((i + rep) % 3)) for s, reps in (("a", (1, 2)), ("b", (5,))) for rep in reps for i in range(12)]
    sets = spark.createDataFrame(rows, "set_name string, rep bigint, row_id bigint, cluster string")
    shifted = sets.withColumn("rep", F.when(F.col("set_name") == "a", F.col("rep") - 1).otherwise(F.lit(0)).cast("bigint"))
    found, expected = ([tuple(r) for r in sorted(metrics.bootstrap_ari(s, 64, 3).collect())] for s in (sets, shifted))
    assert found == expected and len(found) == 4
    draws = metrics.bootstrap_draws(spark, {"a": [1, 2], "b": [5]}, 64, 3)
    assert draws.count() == 4 * 64 and {r.rep_b for r in draws.filter("set_b = 'b'").collect()} == {5}


def test_starting_centres_come_from_all_rows(spark):
    """Three rows far from 20,000 others: a start from a sample would miss them."""
    rng = np.random.default_rng(0)
    points = np.concatenate([rng.normal(size=(20_000, 2)), rng.normal(size=(3, 2)) + 1000])
    rows = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "row_id bigint, v array<double>")
    fits = lloyd.fit_many(rows.repartition(8), [(2, s) for s in range(4)], "row_id")
    again = lloyd.fit_many(rows.repartition(3), [(2, s) for s in range(4)], "row_id")
    for fit, other in zip(fits, again):
        assert fit.cost < 50_000 and sorted(c.max() > 500 for c in fit.centres) == [False, True]
        assert fit.cost == pytest.approx(other.cost)
    starts, variance = lloyd.start_centres(rows, [(6, 1)], "row_id", "v")
    assert len(np.unique(starts[0], axis=0)) == 6
    assert variance == pytest.approx(points.var(axis=0).mean())


def test_fewer_values_than_clusters(spark):
    rows = spark.createDataFrame([(i, [float(i % 2)]) for i in range(8)], "row_id bigint, v array<double>")
    (fit,) = lloyd.fit_many(rows, [(3, 0)], "row_id")
    assert fit.cost == 0.0 and set(fit.centres.ravel()) <= {0.0, 1.0}


def test_dbscan_writes_by_points_not_by_pairs_of_blocks(spark, monkeypatch):
    """All rows near each other, in many blocks: links are a few per row, though every block meets every other."""
    from fluxloom.operators import dbscan as module

    written = {}

    def seen(df, tag, *given):
        written[tag] = settle(df, tag, *given)
        return written[tag]

    monkeypatch.setattr(module, "settle", seen)
    x = np.random.default_rng(5).normal(size=(300, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "row_id bigint, v array<double>")
    found = dbscan(df, "row_id", "v", 50.0, 5, block_rows=5).collect()
    assert {r.cluster for r in found} == {0}
    assert written["pairs"].select("pair").distinct().count() > 1500
    assert written["links"].count() <= 300 * module.LANES
