"""Mixing sources to target weights, by a splitting tree of multivariate hypergeometric draws.

A source's target is its weight's share of ``share`` times all words, at most ``cap`` times its own words; what is
cut off goes to the other sources by weight. A source whose target is 1.3 times its words is taken once as a whole, and
then documents of three tenths of its words a second time.

Documents of a source stand in the order of an md5 draw of seed and key. Their running word count cuts that order
into blocks of ``block_words``; the last, partial pass takes the documents that end before the target. The gap that is
left, as behind a document longer than it, is filled in rounds by documents that are not yet taken ``cap`` times: the largest
that fits, then, of the least often taken that fit, all in the order of the draw that end before the target. A round
halves the gap or takes the last of those. When none fits any more, the smallest is taken if the target is missed by
less with it than without.
The block quotas of all sources are then divided over the output shards: a node of a binary tree with quotas K gives
its left half a multivariate hypergeometric draw from K, the right half the rest, down to single shards. So every
block goes to one shard, every shard gets its share of every source, and all quotas hold exactly. A source's blocks
go to its shards in permuted order; inside a shard documents are sorted by a second draw.

All draws depend on seeds, keys and tree nodes only: reruns agree, lost tasks repeat their results. Running sums are
computed per leading digits of the draw (`functions/draws.py`), so no task holds a source. Words are counted once, in the
pass that writes sizes by source and draw. Text is shuffled only by `mix`, to its shard.

Null texts and texts without words have size 0; they are taken as their place in the order says. Null sources are a
source of their own, after all others. A null key is a key. Rows of a source that repeat a key are taken together.
Sources without words have target 0. An empty table gives no rows. Columns of the input cannot clash: rows travel as one struct.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, gcd, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.functions.draws import draw
from fluxloom.llm.common import SPACE
from fluxloom.session import bounded_rows, settle

SEED = 8
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
BLOCK_WORDS = 16_384
SHARD_WORDS = 4_000_000
# Documents in a bucket of the running sums, at most.
BUCKET_ROWS = 16_384
# Sources are labels, not data.
MAX_SOURCES = 100_000
# numpy draws hypergeometric numbers from fewer than 1e9 items; larger mixes use larger blocks.
MAX_UNITS = 1 << 29
# Levels of the tree that one task computes before its nodes are spread.
TOP_LEVELS = 10


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = WEIGHTS
    share: float = SHARE
    cap: float = CAP
    seed: int = SEED
    block_words: int = BLOCK_WORDS
    shard_words: int = SHARD_WORDS


def words(text: Column) -> Column:
    """Number of words (runs without ASCII white space); 0 for null."""
    trimmed = F.regexp_replace(text, rf"^{SPACE}|{SPACE}\z", "")
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, SPACE))).otherwise(0).cast("bigint")


def targets(sizes: list[int], weights: tuple[float, ...], share: float, cap: float) -> list[float]:
    """Targets of sources in order. Sources reach their cap in order of cap / weight; the rest split what is left."""
    weight = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    order = sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weight[i], i))
    left, open_weight = share * sum(sizes), sum(weight)
    level = 0.0
    for i in order:
        level = left / open_weight
        if cap * sizes[i] / weight[i] >= level:
            break
        left -= cap * sizes[i]
        open_weight -= weight[i]
    return [round(min(cap * size, w * level), 6) for size, w in zip(sizes, weight, strict=True)]


def split(quotas: np.ndarray, node: int, levels: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """Leaves below a node, numbered as in a heap, with their part of the quotas."""
    if not levels:
        yield node, quotas
        return
    draws = np.random.Generator(np.random.Philox(key=[seed, node]))
    half = (int(quotas.sum()) + int(draws.integers(0, 2))) // 2  # an odd unit goes to either side
    left = draws.multivariate_hypergeometric(quotas, half, method="marginals")
    yield from split(left, 2 * node, levels - 1, seed)
    yield from split(quotas - left, 2 * node + 1, levels - 1, seed)


def assign(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text",
           source: str = "source") -> DataFrame:
    """Every row as ``row``, with size, source_size, target and ``shards``: one entry for each time it is taken."""
    spark = docs.sparkSession
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), F.col(text).alias("text"),
                       draw(mix.seed, F.coalesce(F.col(key).cast("string"), F.lit("null"))).alias("draw"),
                       F.xxhash64(text).alias("print"))  # tells apart the texts of rows that repeat a key
    sizes = settle(rows.groupBy("source", "draw", "print").agg(
        F.first(words(F.col("text"))).alias("size"), F.count(F.lit(1)).alias("rows")), "sizes")
    keyed = rows.drop("text")
    keys = sizes.groupBy("source", "draw").agg(F.sum(F.col("size") * F.col("rows")).alias("size"))
    sources = bounded_rows(keys.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")),
                           MAX_SOURCES, "the table of sources")
    sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    plan, block_words, levels = _plan(sources, mix)
    plan = spark.createDataFrame(plan)

    # A key's place in its source: words before it, by bucket of the draw.
    small = plan.select(F.col("source").alias("s"), "digits", "source_size", "target", "passes", "part", "blocks",
                        "units", "step", "shift")
    units = keys.join(small, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    units = _running(units, "size", "before")
    whole = (F.col("before") + F.col("size") <= F.col("part")) & (F.col("part") > 0)
    units = units.withColumn("times", F.col("passes") + whole.cast("int")).withColumn("spots", F.array().cast("array<bigint>"))
    units = _fill_gaps(settle(units, "places"), mix)

    # Each time it is taken, a key stands in a block; the block's permuted place tells its shard.
    block = F.least(F.floor(F.col("before") / F.lit(block_words)), F.col("blocks") - 1)
    taken = units.filter("times > 0").withColumn("block", block)
    none = F.array().cast("array<bigint>")
    passed = F.when(F.col("times") > F.size("spots"), F.transform(
        F.sequence(F.lit(0), F.col("times") - F.size("spots") - 1), lambda t: t * F.col("blocks") + F.col("block")))
    filled = F.transform("spots", lambda at: F.col("passes") * F.col("blocks") + F.floor(
        (at - F.col("passes") * F.col("source_size")) / F.lit(block_words)))
    taken = (taken.withColumn("unit", F.explode(F.concat(F.coalesce(passed.cast("array<bigint>"), none), filled)))
             .withColumn("unit", F.least("unit", F.col("units") - 1))
             .withColumn("place", (F.col("unit") * F.col("step") + F.col("shift")) % F.col("units")))
    shards = _shards(plan, levels, mix.seed).select(F.col("source").alias("s"), F.col("place").alias("p"), "shard")
    taken = (taken.join(shards, F.col("source").eqNullSafe(F.col("s")) & (F.col("place") == F.col("p")))
             .groupBy("source", "draw").agg(F.sort_array(F.collect_list("shard")).alias("shards")))

    taken = units.join(taken.select(F.col("source").alias("s"), F.col("draw").alias("d"), "shards"),
                       F.col("source").eqNullSafe(F.col("s")) & (F.col("draw") == F.col("d")), "left")
    taken = taken.select(F.col("source").alias("s"), F.col("draw").alias("d"), "source_size", "target", "shards")
    facts = sizes.join(taken, F.col("source").eqNullSafe(F.col("s")) & (F.col("draw") == F.col("d"))).select(
        "s", "d", F.col("print").alias("p"), "size", "source_size", "target", "shards")
    return (keyed.join(facts, F.col("source").eqNullSafe(F.col("s")) & (F.col("draw") == F.col("d")) & (F.col("print") == F.col("p")))
            .select("row", "size", "source_size", "target", "draw",
                    F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards")))


def _running(units: DataFrame, of: str, name: str) -> DataFrame:
    """Adds the sum of a column over the earlier keys of the source, by bucket of the draw."""
    units = units.withColumn("bucket", F.substr("draw", F.lit(1), F.col("digits")))
    below = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (units.groupBy("source", "bucket").agg(F.sum(of).alias("words"))
               .select(F.col("source").alias("s"), F.col("bucket").alias("b"),
                       F.coalesce(F.sum("words").over(below), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("source", "bucket").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    return (units.withColumn(name, F.coalesce(F.sum(of).over(inside), F.lit(0)))
            .join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
            .withColumn(name, F.col(name) + F.col("offset")).drop("offset", "bucket"))


def _fill_gaps(units: DataFrame, mix: Mix) -> DataFrame:
    """One more time for keys that still fit, in rounds until none does, then for the smallest if that is nearer. ``spots``
    holds the words of the source taken before each of these times, which places them in its blocks. Only a row per source
    is collected."""
    spark = units.sparkSession
    more = (F.col("times") < int(mix.cap)) & (F.col("size") > 0) & (F.col("part") > 0)

    def state_of(columns: dict[str, pa.Array]) -> DataFrame:
        return spark.createDataFrame(pa.table(columns))

    def with_spots(turn: DataFrame, spot: Column) -> DataFrame:
        turn = turn.withColumn("spot", spot.cast("bigint"))
        turn = (turn.withColumn("times", F.col("times") + F.col("spot").isNotNull().cast("int"))
                .withColumn("spots", F.when(F.col("spot").isNotNull(), F.concat("spots", F.array("spot")))
                            .otherwise(F.col("spots"))))
        return settle(turn.select(*units.columns), "fill")

    while True:
        gaps = (units.filter(F.col("part") > 0).groupBy("source").agg(
            F.max("target").alias("target"), F.sum(F.col("times") * F.col("size")).alias("taken"))
                .select(F.col("source").alias("s"), "taken", (F.col("target") - F.col("taken")).alias("gap")))
        fits = (units.filter(more).select("source", "times", "size", "draw")
                .join(gaps, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") <= F.col("gap")))
                .groupBy("source").agg(F.first("taken").alias("taken"), F.first("gap").alias("gap"),
                                       F.min("times").alias("least"), F.max(F.struct("size", "draw")).alias("best")))
        rows = bounded_rows(fits, MAX_SOURCES, "the table of sources")
        if not rows:
            break
        state = state_of({
            "s": pa.array([r["source"] for r in rows], pa.string()), "best": [r["best"]["draw"] for r in rows],
            "taken": pa.array([r["taken"] + r["best"]["size"] for r in rows], pa.int64()),
            "gap": pa.array([r["gap"] - r["best"]["size"] for r in rows], pa.float64()),
            "least": pa.array([r["least"] for r in rows], pa.int32())})
        best = F.coalesce(F.col("draw") == F.col("best"), F.lit(False))
        open_now = more & ~best & (F.col("times") == F.col("least")) & (F.col("size") <= F.col("gap"))
        turn = units.join(state, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        turn = turn.withColumn("wanted", F.when(open_now, F.col("size")).otherwise(F.lit(0)))
        turn = _running(turn, "wanted", "reach")
        units = with_spots(turn, F.when(best, F.col("taken") - F.col("size")).when(
            (F.col("wanted") > 0) & (F.col("reach") + F.col("wanted") <= F.col("gap")), F.col("taken") + F.col("reach")))

    least = (units.filter(more).join(gaps, F.col("source").eqNullSafe(F.col("s"))).groupBy("source").agg(
        F.min(F.struct("size", "draw")).alias("least"), F.first("taken").alias("taken"), F.first("gap").alias("gap"))
             .filter(F.col("least.size") - F.col("gap") < F.col("gap")))
    rows = bounded_rows(least, MAX_SOURCES, "the table of sources")
    if not rows:
        return units
    state = state_of({"s": pa.array([r["source"] for r in rows], pa.string()), "best": [r["least"]["draw"] for r in rows],
                      "taken": pa.array([r["taken"] for r in rows], pa.int64())})
    turn = units.join(state, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return with_spots(turn, F.when(F.col("draw") == F.col("best"), F.col("taken")))


def mix(docs: DataFrame, mix: Mix = Mix(), key: str = "doc_id", text: str = "text",
        source: str = "source") -> DataFrame:
    """The mixed rows, with ``shard`` and ``place``: shards come together, each in its shuffled order."""
    rows = assign(docs, mix, key, text, source).select(
        "row", "draw", F.posexplode("shards").alias("time", "shard"))
    rows = rows.withColumn("place", F.md5(F.concat_ws("|", "shard", "time", "draw")))
    return rows.repartition("shard").sortWithinPartitions("shard", "place").select("row", "shard", "place")


def _plan(sources: list, mix: Mix) -> tuple[pa.Table, int, int]:
    sizes = [row["source_size"] for row in sources]
    goals = targets(sizes, mix.weights, mix.share, mix.cap) if sources else []
    block_words = max(mix.block_words, ceil(sum(goals) / MAX_UNITS))
    levels = max(0, ceil(log2(max(1.0, sum(goals) / mix.shard_words))))
    columns: dict[str, list] = {name: [] for name in (
        "source", "source_size", "target", "digits", "passes", "part", "blocks", "units", "step", "shift")}
    for i, (row, size, goal) in enumerate(zip(sources, sizes, goals, strict=True)):
        passes = int(goal // size) if size else 0
        part = goal - passes * size
        blocks = max(1, ceil(size / block_words))
        units = max(1, passes * blocks + ceil(part / block_words))
        draws = np.random.Generator(np.random.Philox(key=[mix.seed, (1 << 63) + i]))
        step = int(draws.integers(1, units + 1))
        while gcd(step, units) != 1:
            step = step % units + 1
        digits, rows = 0, row["n"]
        while rows > BUCKET_ROWS:
            digits, rows = digits + 1, rows / 16
        for name, value in (("source", row["source"]), ("source_size", size), ("target", goal), ("digits", digits),
                            ("passes", passes), ("part", part), ("blocks", blocks), ("units", units), ("step", step),
                            ("shift", int(draws.integers(0, units)))):
            columns[name].append(value)
    kinds = {"source": pa.string(), "target": pa.float64(), "part": pa.float64(), "digits": pa.int32(),
             "passes": pa.int32()}
    return pa.table({name: pa.array(values, kinds.get(name, pa.int64())) for name, values in columns.items()}), \
        block_words, levels


def _shards(plan: DataFrame, levels: int, seed: int) -> DataFrame:
    """Shard of every (source, place): the tree's quotas, laid end to end in the order of shards."""
    top = min(levels, TOP_LEVELS)
    whole = plan.agg(F.array_sort(F.collect_list(F.struct(
        F.col("source").isNull().alias("last"), "source", "units"))).alias("all"))
    root = whole.select(F.lit(1).cast("bigint").alias("node"), F.col("all.source").alias("sources"),
                        F.col("all.units").alias("quotas"))

    def descend(by: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    quotas = np.array(row["quotas"], np.int64)
                    if not len(quotas):
                        continue
                    for node, part in split(quotas, row["node"], by, seed):
                        yield pa.record_batch({"node": pa.array([node], pa.int64()),
                                               "sources": pa.array([row["sources"]], pa.list_(pa.string())),
                                               "quotas": pa.array([part.tolist()], pa.list_(pa.int64()))})
        return run

    schema = "node bigint, sources array<string>, quotas array<bigint>"
    nodes = root.mapInArrow(descend(top), schema)
    if levels > top:
        nodes = nodes.repartition("node").mapInArrow(descend(levels - top), schema)
    cells = nodes.select((F.col("node") - (1 << levels)).alias("shard"), F.explode_outer(
        F.arrays_zip("sources", "quotas")).alias("cell")).select("shard", F.col("cell.sources").alias("source"),
                                                                 F.col("cell.quotas").alias("quota"))
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("start", F.coalesce(F.sum("quota").over(before), F.lit(0))).filter("quota > 0")
    return cells.select("source", "shard", F.explode(F.sequence(
        F.col("start"), F.col("start") + F.col("quota") - 1)).alias("place"))
