"""Edge cases of harmonising, statistics and dense vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom.operators import harmonise as H
from fluxloom.operators import histogram, logs, stats, stoich


def flux_of(spark, rows):
    return spark.createDataFrame(
        [(f, f.split("_")[0], s, r, float(x)) for f, s, r, x in rows],
        "file_name string, label string, sample_n bigint, reaction string, flux double")


@pytest.fixture(scope="module")
def two_files(spark):
    return flux_of(spark, [
        ("a_1", 0, "r1", 2), ("a_1", 1, "r1", 4), ("a_1", 0, "r2", 0), ("a_1", 1, "r2", 0),
        ("b_1", 0, "r1", 6), ("b_1", 1, "r1", 0), ("b_1", 0, "only_b", 8), ("b_1", 1, "only_b", 8),
    ])


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_union_contains_core_and_one_file_is_all_core(spark, two_files):
    sets = by(H.reaction_sets(two_files), "reaction")
    assert {r for r, row in sets.items() if row.is_core} == {"r1"}
    assert set(sets) == {"r1", "r2", "only_b"}
    alone = H.reaction_sets(two_files.filter("file_name = 'a_1'"))
    assert all(r.is_core for r in alone.collect())


def test_absent_cells_count_as_zero_and_flat_spread_is_one(two_files):
    found = by(stats.flux_stats(two_files), "reaction")
    assert found["r1"].mu == 3.0
    assert found["only_b"].mu == 4.0  # divided by the samples of all files
    assert found["only_b"].sd == pytest.approx(4.0)
    assert (found["r2"].mu, found["r2"].sd) == (0.0, 1.0)  # all zero


def test_constant_reaction_has_spread_one(spark):
    found = stats.flux_stats(flux_of(spark, [("a_1", s, "r", 0.1) for s in range(3)])).first()
    assert found.sd == 1.0


def test_null_cell_is_zero_in_dense_rows(spark):
    flux = flux_of(spark, [("a_1", 0, "r1", 5)]).unionByName(
        spark.createDataFrame([("a_1", "a", 0, "r2", None)],
                              "file_name string, label string, sample_n bigint, reaction string, flux double"))
    layout = stats.Dictionary(["r1", "r2"], np.zeros(2), np.ones(2))
    assert stats.dense_samples(flux, layout).first().v == [5.0, 0.0]


def test_dense_rows_match_pandas(spark, two_files):
    layout = stats.Dictionary.collect(stats.flux_stats(two_files))
    scaled = stats.dense_samples(two_files, layout, scaled=True)
    wide = two_files.toPandas().pivot_table(index=["file_name", "sample_n"], columns="reaction", values="flux",
                                            fill_value=0.0)
    sd = wide.std(ddof=0).replace(0, 1)
    expected = ((wide - wide.mean()) / sd)[layout.reactions].to_numpy()
    found = np.array([r.v for r in scaled.orderBy("file_name", "sample_n").collect()])
    assert np.allclose(found, expected)
    back = scaled.withColumn("v", stats.affine(F.col("v"), layout.mu, layout.sd, inverse=True))
    again = np.array([r.v for r in back.orderBy("file_name", "sample_n").collect()])
    assert np.allclose(again, wide[layout.reactions].to_numpy())


def test_ids_with_one_canonical_name_are_summed(spark, two_files):
    names = spark.createDataFrame([("b", "r1", "x"), ("b", "only_b", "x")],
                                  "label string, reaction string, new_name string")
    merged = H.collapse_duplicates(H.rename_reactions(two_files, names))
    found = {(r.file_name, r.sample_n, r.reaction): r.flux for r in merged.collect()}
    assert found[("b_1", 0, "x")] == 14.0
    assert found[("a_1", 1, "r1")] == 4.0
    assert [r.new_name for r in H.rename_collisions(names).collect()] == ["x"]


def test_convert_fills_missing_with_zero(spark):
    source = stats.Dictionary(["a", "b", "c"], np.zeros(3), np.ones(3))
    df = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<double>")
    assert df.select(stats.convert(F.col("v"), source, ["c", "new", "a"]).alias("v")).first().v == [3.0, 0.0, 1.0]


def test_combine_drops_zero_and_uncommon_reactions(two_files):
    kept = {(r.file_name, r.reaction) for r in H.combine_samples(two_files, "U").collect()}
    assert kept == {("a_1", "r1"), ("b_1", "r1"), ("b_1", "only_b")}
    assert {r.reaction for r in H.combine_samples(two_files, "I").collect()} == {"r1"}
    with pytest.raises(ValueError):
        H.combine_samples(two_files, "X")


def test_unknown_restriction_is_skipped(two_files):
    assert H.restrict_rows(two_files, {"colour": 1, "label": "a"}).count() == 4


def test_last_model_wins_and_balance_is_zero(spark):
    entries = spark.createDataFrame([(1, "m", "r1", 9.0), (2, "m", "r1", 1.0), (1, "m", "r2", -2.0)],
                                    "model_n int, metabolite string, reaction string, stoich double")
    s = stoich.stoich_matrix(entries)
    assert {(r.reaction, r.stoich) for r in s.collect()} == {("r1", 1.0), ("r2", -2.0)}
    balanced = flux_of(spark, [("a_1", 0, "r1", 4), ("a_1", 0, "r2", 2)])
    assert [r.net for r in stoich.mass_balance(balanced, s).collect()] == [0.0]


def test_histogram_equals_numpy(two_files):
    found = {(r.reaction, r.label, r.bin): r.n for r in histogram.histogram(two_files, 40).collect()}
    dense = two_files.toPandas().pivot_table(index=["label", "sample_n"], columns="reaction", values="flux", fill_value=0)
    assert not any(reaction == "r2" for reaction, _, _ in found)  # all zero: no histogram
    for reaction in ("r1", "only_b"):
        edges = np.histogram_bin_edges(dense[reaction], 40)
        for label in ("a", "b"):
            counts, _ = np.histogram(dense.loc[label][reaction], edges)
            assert {b: n for (r, l, b), n in found.items() if (r, l) == (reaction, label)} == {
                i: n for i, n in enumerate(counts) if n}


def log_of(spark, losses):
    return spark.createDataFrame([(r, i, float(x)) for r, xs in losses.items() for i, x in enumerate(xs)],
                                 "run bigint, eval_n bigint, loss double")


@pytest.mark.parametrize("beta", [0.1, 0.5, 1.0])
def test_ema_is_the_same_for_any_block(spark, beta):
    xs = {0: np.random.default_rng(0).normal(size=57), 1: [3.0]}
    found = {(r.run, r.eval_n): r.y for r in logs.ema_smooth(log_of(spark, xs), "loss", beta, "y", block=5).collect()}
    for run, values in xs.items():
        y = values[0]
        for i, x in enumerate(values):
            y = y * (1 - beta) + beta * x if i else x
            assert found[(run, i)] == pytest.approx(y)


def test_ema_carries_come_from_a_tree(spark, monkeypatch):
    """Blocks of 3 evaluations, maps of 2 blocks in a row: many levels, and runs with gaps as long as several blocks."""
    monkeypatch.setattr(logs, "FOLD_BLOCKS", 2)
    spans = {0: range(50), 1: [*range(5), *range(31, 40), 70], 2: range(2)}
    log = spark.createDataFrame([(run, n, float(n)) for run, span in spans.items() for n in span],
                                "run bigint, eval_n bigint, loss double")
    found = logs.ema_smooth(log, "loss", 0.3, "y", 3).orderBy("run", "eval_n").collect()
    assert [(r.run, r.eval_n) for r in found] == [(run, n) for run, span in spans.items() for n in span]
    for run, span in spans.items():
        expected, at = [], None
        for n in span:
            at = float(n) if at is None else at * 0.7 + 0.3 * n
            expected.append(at)
        assert [r.y for r in found if r.run == run] == pytest.approx(expected)


def test_running_best_is_the_same_for_any_block(spark):
    xs = {0: np.random.default_rng(1).normal(size=41)}
    found = sorted(r.eval_n for r in logs.running_best(log_of(spark, xs), "loss", block=4).collect())
    assert found == [i for i, x in enumerate(xs[0]) if i == 0 or x < min(xs[0][:i])]


def test_tied_minimum_takes_the_first_evaluation(spark):
    log = log_of(spark, {0: [5, 1, 1]})
    grouped = log.withColumn("g", F.lit("x"))
    assert logs.best_row(grouped, ["g"], "loss").first().eval_n == 1


def test_every_nth_of_zero_is_empty(spark):
    log = log_of(spark, {0: range(5)})
    assert logs.every_nth(log, 0).count() == 0
    assert [r.eval_n for r in logs.every_nth(log, 2).orderBy("eval_n").collect()] == [0, 2, 4]


def test_short_runs_have_no_tail(spark):
    found = logs.tail_average(log_of(spark, {0: range(10), 1: range(3)}), 4, ["loss"]).collect()
    assert [(r.run, r.loss) for r in found] == [(0, 7.5)]


def test_tail_of_a_filtered_log(spark):
    found = logs.tail_average(logs.every_nth(log_of(spark, {0: range(10)}), 2), 4, ["loss"]).collect()
    assert [(r.run, r.loss) for r in found] == [(0, 5.0)]  # evaluations 2, 4, 6, 8


def test_spread_of_a_large_constant_is_one(spark):
    from fluxloom.operators import stats

    cells = [("f", "l", i, "constant", 1000.1) for i in range(1000)] + [("f", "l", i, "half", 1000.1) for i in range(500)]
    flux = spark.createDataFrame(cells, "file_name string, label string, sample_n bigint, reaction string, flux double")
    for found in (stats.flux_stats(flux), stats.reaction_dim(flux)):
        rows = {r.reaction: r for r in found.collect()}
        assert rows["constant"].sd == 1.0 and rows["constant"].mu == pytest.approx(1000.1)
        assert rows["half"].sd == pytest.approx(500.05) and rows["half"].mu == pytest.approx(500.05)
    assert {r.reaction: r.sd for r in stats.flux_stats(flux, ddof=1).collect()}["half"] == pytest.approx(500.05 * (1000 / 999) ** 0.5)
