"""Training-loss logs over runs: (run, eval_n, epoch, losses...)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxloom.session import settle

LOSSES = ["loss", "reconstruction_loss", "divergence_loss", "stoicheometry_loss",
          "test_loss", "test_reconstruction_loss", "test_divergence_loss", "test_stoicheometry_loss"]

# Evaluations of one run that are folded in one array; longer runs take more arrays.
FOLD_ROWS = 4096
# Blocks whose maps are folded in one row.
FOLD_BLOCKS = 1_000


def attach_run_args(log: DataFrame, args: DataFrame) -> DataFrame:
    """Every argument of a run becomes a column of its log rows."""
    return log.join(args, "run", "left")


def epoch_mean(log: DataFrame, columns: list[str] = LOSSES) -> DataFrame:
    return log.groupBy("run", "epoch").agg(*[F.avg(c).alias(c) for c in columns])


def epoch_bucket(epoch: Column, width: int) -> Column:
    return F.floor(epoch / width).cast("bigint")


def group_min(log: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return log.groupBy(*by).agg(*[F.min(c).alias(f"min_{c}") for c in columns])


def final_epoch(log: DataFrame) -> DataFrame:
    """Rows of the last epoch of each run."""
    last = log.groupBy("run").agg(F.max("epoch").alias("epoch"))
    return log.join(last, ["run", "epoch"], "left_semi")


def best_row(log: DataFrame, by: list[str], loss: str) -> DataFrame:
    """Whole row with the least loss of each group; ties go to the least (run, eval_n).

    ``min_by`` keeps one row per group and task before the shuffle, so a hot group costs nothing more.
    """
    rest = [c for c in log.columns if c not in by]
    order = F.struct(F.col(loss), F.col("run"), F.col("eval_n"))
    return log.groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*by, "r.*")


def grid_argmin(log: DataFrame, row: str, column: str, values: list, pick: str, least: str) -> DataFrame:
    """Matrix row x column of ``pick`` at the least ``least``; an empty cell is 0."""
    best = log.groupBy(row).pivot(column, values).agg(
        F.min_by(pick, F.struct(F.col(least), F.col("run"), F.col("eval_n"))))
    return best.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).alias(f"{column}_{v}") for v in values])


def column_means(log: DataFrame, columns: list[str] = LOSSES) -> DataFrame:
    return log.agg(*[F.avg(c).alias(c) for c in columns])


def selected_sums(matrix: DataFrame, condition: str, columns: list[str]) -> DataFrame:
    """Sums of the rows of a result matrix that a condition selects."""
    return matrix.filter(condition).agg(*[F.sum(c).alias(c) for c in columns])


def run_labels(args: DataFrame, columns: list[str], out: str = "label") -> DataFrame:
    """A run's arguments joined by hyphens."""
    return args.withColumn(out, F.concat_ws("-", *columns))


def tail_average(log: DataFrame, last: int, columns: list[str] = LOSSES) -> DataFrame:
    """Mean of the last evaluations of each run that has enough of them; evaluations may be filtered or have gaps."""
    # Spark keeps ``last`` rows per run and task before the shuffle of this rank.
    from_end = Window.partitionBy("run").orderBy(F.col("eval_n").desc())
    tail = log.withColumn("_from_end", F.row_number().over(from_end)).filter(F.col("_from_end") <= last)
    means = tail.groupBy("run").agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(c) for c in columns])
    return means.filter(F.col("_n") == last).drop("_n")


def loss_correction(log: DataFrame) -> DataFrame:
    """Logs that lack the constant of the divergence: take off ``n_emb / 2`` and add the parts up again."""
    half = F.col("n_emb") / 2
    return (
        log.withColumn("divergence_loss", F.col("divergence_loss") - half)
        .withColumn("loss", F.col("divergence_loss") + F.col("reconstruction_loss"))
        .withColumn("test_divergence_loss", F.col("test_divergence_loss") - half)
        .withColumn("test_loss", F.col("test_divergence_loss") + F.col("test_reconstruction_loss"))
    )


def every_nth(log: DataFrame, n: int, index: str = "eval_n") -> DataFrame:
    """Rows whose index n divides; n = 0 keeps none."""
    return log.filter(F.lit(False)) if n == 0 else log.filter(F.col(index) % n == 0)


def run_slice(log: DataFrame, start: int, end: int, step: int, fields: list[str]) -> DataFrame:
    run = F.col("run")
    return log.filter((run >= start) & (run < end) & ((run - start) % step == 0)).select("run", "eval_n", *fields)


def drop_rows(log: DataFrame, *conditions: Column) -> DataFrame:
    """Drop the rows that meet any condition."""
    return log.filter(~reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions]))


def running_best(log: DataFrame, loss: str, block: int = FOLD_ROWS) -> DataFrame:
    """Rows whose loss is below every earlier one of the run.

    Blocks of evaluations are scanned in parallel; only the least loss of each block is carried over.
    """
    blocked = log.withColumn("_block", F.floor(F.col("eval_n") / block))
    before = Window.partitionBy("run").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.groupBy("run", "_block").agg(F.min(loss).alias("_least"))
        .withColumn("_carried", F.min("_least").over(before)).drop("_least")
    )
    inside = Window.partitionBy("run", "_block").orderBy("eval_n").rowsBetween(Window.unboundedPreceding, -1)
    scanned = blocked.withColumn("_inside", F.min(loss).over(inside)).join(carried, ["run", "_block"])
    best = F.least("_inside", "_carried")  # least() skips nulls
    return scanned.filter(best.isNull() | (F.col(loss) < best)).drop("_block", "_inside", "_carried")


def ema_smooth(log: DataFrame, column: str, beta: float, out: str, block: int = FOLD_ROWS) -> DataFrame:
    """Exponential moving average along each run: y0 = x0, y = y_prev (1 - beta) + beta x.

    Blocks of a run are smoothed in parallel, each as if it began the run. The recurrence is linear, so
    the true value is ``local + (1 - beta)^(i + 1) * (carry - x0)``, with the carry from the block before. So a block
    maps the carry linearly, and carries come from a tree of such maps (`_carries`).
    """
    if not 0 < beta <= 1:
        raise ValueError("beta is above 0 and at most 1")
    keep = 1.0 - beta

    @F.arrow_udf("array<double>")
    def smooth(xs: pa.Array) -> pa.Array:
        return pa.array([pd.Series(x.values.to_numpy(zero_copy_only=False)).ewm(alpha=beta, adjust=False).mean()
                         .to_numpy() for x in xs], pa.list_(pa.float64()))

    blocks = (
        log.select("run", "eval_n", F.col(column).cast("double").alias("x"))
        .groupBy("run", F.floor(F.col("eval_n") / block).alias("_block"))
        .agg(F.sort_array(F.collect_list(F.struct("eval_n", "x"))).alias("_xs"))
        .withColumn("_ys", smooth(F.col("_xs.x")))
        .withColumn("_x0", F.col("_xs.x")[0])
    )
    blocks = settle(blocks, "blocks")  # read twice
    slope, end = F.pow(F.lit(keep), F.size("_ys")), F.element_at("_ys", -1)
    maps = blocks.select("run", F.col("_block").alias("at"), slope.alias("m"), (end - slope * F.col("_x0")).alias("c"), end.alias("e"))
    carried = _carries(maps, FOLD_BLOCKS).select("run", F.col("at").alias("_block"), F.col("carry").alias("_carry"))
    return (
        blocks.join(carried, ["run", "_block"])
        .select("run", "_x0", "_carry", F.posexplode_outer(F.arrays_zip(F.col("_xs.eval_n").alias("eval_n"),
                                                                   F.col("_ys").alias("y"))).alias("_i", "_p"))
        .select("run", F.col("_p.eval_n").alias("eval_n"),
                (F.col("_p.y") + F.pow(F.lit(keep), F.col("_i") + 1) * (F.coalesce("_carry", "_x0") - F.col("_x0"))).alias(out))
    )


def _carries(maps: DataFrame, fan: int) -> DataFrame:
    """(run, at, carry): what comes into each block of a run; null into the first.

    ``maps``: (run, at, m, c, e); a block turns a carry x into m x + c, and no carry into e. ``fan`` neighbouring blocks are one map on
    the next level, whose carries are found in the same way, so a row holds ``fan`` maps however long a run is.
    """
    @F.arrow_udf("struct<m:double,c:double,e:double>")
    def compose(m: pa.Array, c: pa.Array, e: pa.Array) -> pa.Array:
        out = []
        for ms, cs, es in zip(m.to_pylist(), c.to_pylist(), e.to_pylist()):
            slope, offset, value = 1.0, 0.0, es[0]
            for at, (a, b) in enumerate(zip(ms, cs)):
                slope, offset = slope * a, offset * a + b
                value = value if at == 0 else a * value + b
            out.append({"m": slope, "c": offset, "e": value})
        return pa.array(out, pa.struct([("m", pa.float64()), ("c", pa.float64()), ("e", pa.float64())]))

    @F.arrow_udf("array<double>")
    def scan(m: pa.Array, c: pa.Array, e: pa.Array, start: pa.Array) -> pa.Array:
        out = []
        for ms, cs, es, carry in zip(m.to_pylist(), c.to_pylist(), e.to_pylist(), start.to_pylist()):
            row = []
            for a, b, alone in zip(ms, cs, es):
                row.append(carry)
                carry = alone if carry is None else a * carry + b
            out.append(row)
        return pa.array(out, pa.list_(pa.float64()))

    last = maps.agg(F.max("at")).first()[0] or 0
    groups = maps.groupBy("run", F.floor(F.col("at") / fan).alias("up")).agg(
        F.sort_array(F.collect_list(F.struct("at", "m", "c", "e"))).alias("s"))
    if last >= fan:
        groups = settle(groups, "maps")
        above = groups.select("run", F.col("up").alias("at"), compose(F.col("s.m"), F.col("s.c"), F.col("s.e")).alias("f"))
        starts = _carries(settle(above.select("run", "at", "f.*"), "composed"), fan)
        groups = groups.join(starts.select("run", F.col("at").alias("up"), F.col("carry").alias("start")), ["run", "up"])
    else:
        groups = groups.withColumn("start", F.lit(None).cast("double"))
    found = scan(F.col("s.m"), F.col("s.c"), F.col("s.e"), F.col("start"))
    return groups.select("run", F.explode_outer(F.arrays_zip(F.col("s.at").alias("at"), found.alias("carry"))).alias("p")).select(
        "run", "p.*")


def runs_side_by_side(log: DataFrame, runs: list, columns: list[str]) -> DataFrame:
    """One row per evaluation, columns ``run{i}_{c}``. The runs are named, so no extra scan finds them."""
    wide = log.groupBy("eval_n").pivot("run", runs).agg(*[F.first(c).alias(c) for c in columns])
    if len(columns) == 1:  # Spark then names a pivot column by its value only
        return wide.select("eval_n", *[F.col(f"`{r}`").alias(f"run{r}_{columns[0]}") for r in runs])
    return wide.select("eval_n", *[F.col(f"`{r}_{c}`").alias(f"run{r}_{c}") for r in runs for c in columns])


def outer_concat(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables; a column that a table lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def global_max(tables: list[DataFrame], column: str) -> DataFrame:
    """Largest value over several tables; each is reduced before the union."""
    parts = [t.agg(F.max(column).alias("m")) for t in tables]
    return reduce(DataFrame.union, parts).agg(F.max("m").alias(f"max_{column}"))
