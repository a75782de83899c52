"""Comparing clusterings and predictions."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.functions.draws import draw, draw_int
from fluxloom.session import TooLarge, bounded_rows, settle

MAX_CLUSTERINGS = 10_000
MAX_PAIRS = 100_000
MAX_COLUMNS = 2_000
# Counts that a task holds from batch to batch.
HELD_COUNTS = 16_000_000
PAIR = ["set_a", "rep_a", "set_b", "rep_b"]


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def cluster_summary(clusters: DataFrame, by: list[str], cluster: str = "cluster", noise: str = "-1") -> DataFrame:
    """Number of clusters and of outliers."""
    c = F.col(cluster)
    return clusters.groupBy(*by).agg(
        F.count_distinct(F.when(c != noise, c)).alias("n_clusters"), F.count_if(c == noise).alias("n_outliers"))


def pair_counts(clusterings: DataFrame, pairs: list[tuple]) -> DataFrame:
    """Contingency of every named pair of clusterings in one job.

    ``clusterings``: (set_name, rep, row_id, cluster); ``pairs``: ((set, rep), (set, rep)). The labels of
    a row are brought together by one shuffle on the row id. Each task then counts label pairs for every
    named pair of clusterings (never pairs of rows), so only counts are shuffled after that.
    """
    if len(pairs) > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} pairs of clusterings; score them in turns")
    used = sorted({c for pair in pairs for c in pair})
    at = {c: i for i, c in enumerate(used)}
    place = F.array_position(
        F.array(*[clustering_id(F.lit(s), F.lit(int(r))) for s, r in used]), clustering_id("set_name", "rep")) - 1
    rows = (
        clusterings.select("row_id", place.cast("int").alias("at"), F.col("cluster").cast("string").alias("cluster"))
        .filter(F.col("at") >= 0).groupBy("row_id").agg(F.collect_list(F.struct("at", "cluster")).alias("c"))
        .select(F.col("c.at").alias("at"), F.col("c.cluster").alias("cluster"))
    )
    places = np.array([(at[a], at[b]) for a, b in pairs], dtype=np.int64).reshape(-1, 2)
    counted = rows.mapInArrow(_count_pairs(places, len(used)), "p int, a string, b string, n bigint").groupBy(
        "p", "a", "b").agg(F.sum("n").alias("n"))
    # An Arrow table becomes a local relation, whose size Catalyst knows.
    named = clusterings.sparkSession.createDataFrame(pa.table({
        "p": pa.array(range(len(pairs)), pa.int32()),
        "set_a": pa.array([a[0] for a, _ in pairs], pa.string()), "rep_a": pa.array([int(a[1]) for a, _ in pairs], pa.int64()),
        "set_b": pa.array([b[0] for _, b in pairs], pa.string()), "rep_b": pa.array([int(b[1]) for _, b in pairs], pa.int64())}))
    return counted.join(named, "p").select(*PAIR, "a", "b", "n")


def _count_pairs(places: np.ndarray, width: int):
    """Counts per (pair, label, label) of a task's rows.

    Every label of every clustering has a number in the task. For one clustering and all its partners together, the numbers
    of a batch are counted in one pass into a table of its labels by all labels; nothing is sorted or looped over per pair.
    Tables are held from batch to batch while they are small, else passed on after each.
    """
    partners = [places[places[:, 0] == i, 1] for i in range(width)]
    pair_of = np.full((width, width), -1, dtype=np.int64)
    pair_of[places[:, 0], places[:, 1]] = np.arange(len(places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[int, str], int] = {}  # (clustering, label) -> number among all
        owner, local, names = [], [], []  # per number: clustering, place among its labels, label
        size = [0] * width
        held: dict[int, np.ndarray] = {}

        def emit(i: int, table: np.ndarray) -> pa.RecordBatch:
            own, other = np.nonzero(table)
            mine = np.array([names[g] for g in range(len(names)) if owner[g] == i], dtype=object)
            labels = np.array(names, dtype=object)
            return pa.RecordBatch.from_arrays(
                [pa.array(pair_of[i, np.array(owner)[other]].astype(np.int32)), pa.array(mine[own], pa.string()),
                 pa.array(labels[other], pa.string()), pa.array(table[own, other], pa.int64())], ["p", "a", "b", "n"])

        for batch in batches:
            at, cluster = batch.column("at"), batch.column("cluster").flatten().dictionary_encode()
            rows = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy(zero_copy_only=False))
            places_at, text = at.flatten().to_numpy(), cluster.dictionary.to_pylist()
            cells = places_at.astype(np.int64) * max(1, len(text)) + cluster.indices.to_numpy(zero_copy_only=False)
            seen, back = np.unique(cells, return_inverse=True)
            for cell in seen.tolist():
                i, label = cell // len(text), text[cell % len(text)]
                if (i, label) not in number:
                    number[i, label] = len(names)
                    owner.append(i)
                    local.append(size[i])
                    names.append(label)
                    size[i] += 1
            labels = np.full((len(at), width), -1, dtype=np.int64)
            labels[rows, places_at] = np.array(
                [number[c // len(text), text[c % len(text)]] for c in seen.tolist()], dtype=np.int64)[back]
            total, place = len(names), np.array(local, dtype=np.int64)
            hold = total * sum(n for n, others in zip(size, partners) if len(others)) <= HELD_COUNTS
            for i, others in enumerate(partners):
                if not len(others) or not size[i]:
                    continue
                both = (labels[:, [i]] >= 0) & (labels[:, others] >= 0)
                keys = place[labels[:, [i]]] * total + labels[:, others]
                table = np.bincount(keys[both], minlength=size[i] * total).reshape(size[i], total)
                if i in held:  # with fewer labels then
                    table[:held[i].shape[0], :held[i].shape[1]] += held.pop(i)
                if hold:
                    held[i] = table
                else:
                    yield emit(i, table)
        for i, table in held.items():
            yield emit(i, table)

    return run


def clustering_id(set_name, rep):
    return F.concat_ws("#", set_name, rep)


def ari_from_counts(counts: DataFrame, pair: list[str] = PAIR) -> DataFrame:
    """Adjusted Rand index per pair from contingency rows (pair..., a, b, n). A zero denominator gives 1."""

    def choose2(n):
        return n.cast("double") * (n.cast("double") - 1) / 2

    # The marginals are sums of the same small table: one grouping-set pass finds cells, rows and columns.
    keys = [F.col(c) for c in pair]
    sums = counts.groupingSets([[*keys, F.col("a"), F.col("b")], [*keys, F.col("a")], [*keys, F.col("b")], keys],
                               *keys, F.col("a"), F.col("b")).agg(
        F.sum("n").alias("n"), F.grouping_id(*keys, F.col("a"), F.col("b")).alias("g"))
    pick = {name: F.sum(F.when(F.col("g") == g, choose2(F.col("n")))) for name, g in
            {"cells": 0, "rows": 1, "cols": 2, "all": 3}.items()}
    parts = sums.groupBy(*pair).agg(*[c.alias(name) for name, c in pick.items()])
    expected = F.coalesce(F.try_divide(F.col("rows") * F.col("cols"), F.col("all")), F.lit(0.0))
    top, bottom = F.col("cells") - expected, (F.col("rows") + F.col("cols")) / 2 - expected
    return parts.select(*pair, F.when(bottom == 0, F.lit(1.0)).otherwise(F.try_divide(top, bottom)).alias("score"))


def list_clusterings(clusterings: DataFrame) -> list[tuple]:
    rows = bounded_rows(clusterings.select("set_name", "rep").distinct(), MAX_CLUSTERINGS, "list of clusterings")
    return sorted((r["set_name"], r["rep"]) for r in rows)


def unordered(pairs) -> list[tuple]:
    """Scores are symmetric: keep each pair once, in sorted order."""
    return sorted({(min(p), max(p)) for p in pairs})


def both_ways(scores: DataFrame) -> DataFrame:
    """Give a symmetric score for (b, a) as well as (a, b)."""
    flipped = scores.select(F.col("set_b").alias("set_a"), F.col("rep_b").alias("rep_a"),
                            F.col("set_a").alias("set_b"), F.col("rep_a").alias("rep_b"), "score")
    same = (F.col("set_a") == F.col("set_b")) & (F.col("rep_a") == F.col("rep_b"))
    return scores.unionByName(flipped.filter(~same))


def ari(clusterings: DataFrame, pairs: list[tuple] | None = None) -> DataFrame:
    """Adjusted Rand index of each pair of clusterings (by default all pairs, each once)."""
    if pairs is None:
        pairs = itertools.combinations_with_replacement(list_clusterings(clusterings), 2)
    return ari_from_counts(pair_counts(clusterings, unordered(pairs)))


def bootstrap_draws(spark, reps: dict[str, list[int]], n: int, seed: int) -> DataFrame:
    """``n`` draws with replacement of a repeat of either set, for every ordered pair of sets.

    ``reps``: the sorted repeats of each set; a draw is a position among them.
    """
    sets = sorted(reps)
    names, sizes = F.array(*[F.lit(s) for s in sets]), F.array(*[F.lit(len(reps[s])) for s in sets])
    held = F.array(*[F.array(*[F.lit(int(r)).cast("bigint") for r in reps[s]]) for s in sets])
    k = len(sets)
    at = spark.range(k * k * n).select(
        F.floor(F.col("id") / (k * n)).cast("int").alias("i"),
        F.pmod(F.floor(F.col("id") / n), F.lit(k)).cast("int").alias("j"), F.pmod("id", F.lit(n)).alias("draw_n"))
    drawn = at.select(F.get(names, "i").alias("set_a"), F.get(names, "j").alias("set_b"), "draw_n",
                      F.get(sizes, "i").alias("n_a"), F.get(sizes, "j").alias("n_b"),
                      F.get(held, "i").alias("reps_a"), F.get(held, "j").alias("reps_b"))
    return drawn.select(
        "set_a", "set_b", "draw_n",
        F.get("reps_a", draw_int(draw(seed, "set_a", "set_b", "draw_n", F.lit("a")), F.col("n_a"))).alias("rep_a"),
        F.get("reps_b", draw_int(draw(seed, "set_a", "set_b", "draw_n", F.lit("b")), F.col("n_b"))).alias("rep_b"))


def bootstrap_ari(clusterings: DataFrame, n: int, seed: int) -> DataFrame:
    """Mean and population spread of the index over random pairs of two sets' clusterings.

    Only the distinct drawn pairs are scored. Repeats of a set may have any numbers.
    """
    reps: dict[str, list[int]] = {}
    for set_name, rep in list_clusterings(clusterings):
        reps.setdefault(set_name, []).append(rep)
    draws = settle(bootstrap_draws(clusterings.sparkSession, reps, n, seed), "draws")
    wanted = bounded_rows(draws.select(*PAIR).distinct(), MAX_PAIRS, "list of drawn pairs")
    # Written before it is mirrored, else both sides would count.
    scores = both_ways(settle(ari(clusterings, [((r.set_a, r.rep_a), (r.set_b, r.rep_b)) for r in wanted]), "scores"))
    return mean_std(draws.join(scores, PAIR))


def mean_std(scores: DataFrame) -> DataFrame:
    return scores.groupBy("set_a", "set_b").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def score_matrix(clusterings: DataFrame, score=ari_from_counts) -> DataFrame:
    """Mean and population spread of a symmetric score over all combinations of two sets' clusterings.

    ``score`` maps contingency rows to one ``score`` per pair.
    """
    pairs = unordered(itertools.combinations_with_replacement(list_clusterings(clusterings), 2))
    return mean_std(both_ways(settle(score(pair_counts(clusterings, pairs)), "scores")))


def rand_agreement(counts: DataFrame, pair: list[str] = PAIR) -> DataFrame:
    """A second score: the plain share of rows on equal labels."""
    same = F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(F.lit(0)))
    return counts.groupBy(*pair).agg((same / F.sum("n")).alias("score"))


def greedy_match(counts: DataFrame) -> DataFrame:
    """Give clusters labels, largest count first; a label is used once. A cluster with none left has null.

    ``counts``: (cluster, label, n). Ties go to the least cluster, then the least label. The match is made in
    rounds: an entry that is first for both its cluster and its label is final.
    """
    counts = settle(counts.select("cluster", "label", "n"), "contingency")
    order = F.struct((-F.col("n")).alias("m"), "cluster", "label")
    left, chosen = counts, None
    while True:
        first_c, first_l = Window.partitionBy("cluster"), Window.partitionBy("label")
        final = (
            left.withColumn("o", order)
            .withColumn("c", F.min("o").over(first_c)).withColumn("l", F.min("o").over(first_l))
            .filter((F.col("o") == F.col("c")) & (F.col("o") == F.col("l"))).select("cluster", "label")
        )
        final = settle(final, "match")
        if final.isEmpty():
            break
        chosen = final if chosen is None else chosen.union(final)
        left = settle(
            left.join(final.select("cluster"), "cluster", "left_anti")
            .join(final.select("label"), "label", "left_anti"), "unmatched")
    clusters = counts.select("cluster").distinct()
    if chosen is None:
        return clusters.withColumn("label", F.lit(None).cast("string"))
    return clusters.join(chosen, "cluster", "left")


def purity(assigned: DataFrame) -> DataFrame:
    """Per mapped label, share of its rows that carry that label. ``assigned``: (label, mapped)."""
    return assigned.groupBy("mapped").agg(
        F.avg((F.col("label") == F.col("mapped")).cast("double")).alias("purity"),
        F.count_if(F.col("label") != F.col("mapped")).alias("n_mismatch"))


def prediction_matrix(predicted: DataFrame, truth: str, pred: str, classes: list[str], prefix: str = "") -> DataFrame:
    """Per true group, the share of its rows predicted as each class; classes never predicted are 0.

    One column per class, so their number is bounded; ``contingency`` has no bound.
    """
    if len(classes) > MAX_COLUMNS:
        raise TooLarge(f"{len(classes)} classes are too many columns; use contingency")
    return predicted.groupBy(truth).agg(
        *[F.avg((F.col(pred) == F.lit(c)).cast("double")).alias(f"{prefix}{c}") for c in classes])


def accuracy(predicted: DataFrame, by: list[str], truth: str = "label", pred: str = "pred") -> DataFrame:
    return predicted.groupBy(*by).agg(F.avg((F.col(truth) == F.col(pred)).cast("double")).alias("accuracy"))


def group_mean_std(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample spread per group; a group of one row has spread 0."""
    return values.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def macro_mean_std(values: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """Mean over groups of their means and of their spreads."""
    return group_mean_std(values, [*by, group], value).groupBy(*by).agg(
        F.avg("mean").alias("mean"), F.avg("std").alias("std"))
