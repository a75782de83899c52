"""Queries: windows, order, sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.operators import logs, sampling
from fluxloom.operators.harmonise import ROW_KEY
from fluxloom.operators.vae.fit import CHUNK, Batches
from fluxloom.plans import fixtures as fx
from fluxloom.plans.joins import RUNS
from fluxloom.plans.register import R6, query, r6
from fluxloom.session import settle

SAMPLES = f"""{fx.FLUX},
samples as (select distinct file_name, sample_n from flux)"""


def ranked(seed: int) -> str:
    """Samples with their place in the random order of their file."""
    return f"""{SAMPLES},
ranked as (select file_name, sample_n, md5('{seed}|' || file_name || '|' || cast(sample_n as varchar)) as draw,
                  row_number() over (partition by file_name
                    order by md5('{seed}|' || file_name || '|' || cast(sample_n as varchar))) as rn,
                  count(*) over (partition by file_name) as n_rows
           from samples)"""


def samples(spark, sf):
    """The sample keys, written once: ranking reads them for sizes, for bucket counts and for rows."""
    return settle(sampling.sample_rows(fx.flux(spark, sf)), "samples")


@query("ema_smooth", f"""
with {fx.LOSS_LOG},
series as (select run, list(loss order by eval_n) as xs from loss_log group by 1),
folded as (
  select run, list_reduce(list_transform(xs, lambda x: [x]),
                          lambda a, b: list_append(a, a[len(a)] * (1 - 0.1::double) + 0.1::double * b[1])) as ys
  from series)
select run, cast(generate_subscripts(ys, 1) - 1 as bigint) as eval_n, {R6('unnest(ys)')} as smooth from folded""")
def ema_smooth(spark, sf):
    return logs.ema_smooth(fx.loss_log(spark, sf), "loss", 0.1, "smooth").withColumn("smooth", r6(F.col("smooth")))


# 45 rows per chunk: files of 200 samples give 5 chunks of 40, files of 193 give 4 of 39 and one of 37.
CHUNKS = f"""{ranked(3)},
sized as (select *, cast(ceil(n_rows / (case when n_rows <= 45 then 1 else ceil(n_rows / 45.0) end)) as bigint) as size
          from ranked),
cut as (select file_name, sample_n, (rn - 1) // size as chunk, size, n_rows from sized),
chunks as (select file_name, sample_n, chunk from cut where least(size, n_rows - chunk * size) >= 0.8 * size)"""


@query("random_chunks", f"with {CHUNKS} select file_name, sample_n, chunk from chunks")
def random_chunks(spark, sf):
    return sampling.random_chunks(samples(spark, sf), 45, seed=3)


@query("balanced_sample", f"""
with {ranked(5)},
spf as (select greatest(3000 // count(distinct file_name), 1) as spf from samples),
act as (select distinct file_name, ceil(n_rows / ceil(n_rows / spf)) as act from ranked, spf)
select file_name, sample_n from ranked join act using (file_name) where rn <= act""")
def balanced_sample(spark, sf):
    return sampling.balanced_sample(samples(spark, sf), 3000, seed=5)


@query("epoch_rotation", f"""
with {CHUNKS},
kept as (select file_name, count(distinct chunk) as n_chunks from chunks group by 1),
turns as (select file_name, e as epoch, e // n_chunks as cycle, e % n_chunks as pos
          from kept, generate_series(0, 11) t(e)),
perm as (
  select file_name, cycle, chunk,
         row_number() over (partition by file_name, cycle
           order by md5('9|' || file_name || '|' || cast(cycle as varchar) || '|' || cast(chunk as varchar))) - 1 as pos
  from (select distinct t.file_name, t.cycle, c.chunk from turns t join chunks c using (file_name)) t)
select epoch, file_name, chunk from turns join perm using (file_name, cycle, pos)""")
def epoch_rotation(spark, sf):
    return sampling.epoch_rotation(sampling.chunk_table(samples(spark, sf), 45), 12, seed=9)


@query("sample_reload", f"""
with {CHUNKS},
kept as (select file_name, count(distinct chunk) as n_chunks from chunks group by 1),
turns as (select file_name, e as epoch, e // n_chunks as cycle, e % n_chunks as pos from kept, generate_series(0, 2) t(e)),
perm as (
  select file_name, cycle, chunk,
         row_number() over (partition by file_name, cycle
           order by md5('9|' || file_name || '|' || cast(cycle as varchar) || '|' || cast(chunk as varchar))) - 1 as pos
  from (select distinct t.file_name, t.cycle, c.chunk from turns t join chunks c using (file_name)) t),
served as (select epoch, file_name, chunk from turns join perm using (file_name, cycle, pos)),
filled as (select file_name, chunk, count(*) as n from chunks group by 1, 2),
batches as (select cast(ceil(max(n) / 64.0) as bigint) as n_batches
            from (select epoch, sum(n) as n from served join filled using (file_name, chunk) group by 1)),
parts as (
  select file_name, sample_n, chunk,
         ((row_number() over (partition by file_name, chunk
             order by md5('2|' || file_name || '|' || cast(sample_n as varchar))) - 1) * n_batches) // n as batch
  from chunks join filled using (file_name, chunk), batches)
select cast(epoch as bigint) as epoch, cast(batch as bigint) as batch, file_name, sample_n
from served join parts using (file_name, chunk)""")
def sample_reload(spark, sf):
    """The rows that a fit sees in three epochs when its sample is drawn anew for each, batch by batch."""
    keys = samples(spark, sf)
    rows = sampling.random_chunks(keys, 45, seed=3).withColumn("v", F.array(F.lit(0.0)))
    turns = sampling.epoch_rotation(sampling.chunk_table(keys, 45), 3, seed=9)
    batches = Batches(rows, ROW_KEY, 64, 2, turns)
    return batches.stored.join(batches.turns, CHUNK).select("epoch", "batch", *ROW_KEY)


@query("sample_cap", f"""
with {SAMPLES}
select file_name, sample_n from samples
order by md5('4|' || file_name || '|' || cast(sample_n as varchar)) limit 1500""")
def sample_cap(spark, sf):
    return sampling.sample_cap(samples(spark, sf), 1500, seed=4, keys=ROW_KEY)


@query("mix_split", f"""
with {ranked(6)}
select file_name, sample_n, 7 - ntile(7) over (partition by file_name order by draw desc) as mix from ranked""")
def mix_split(spark, sf):
    return sampling.mix_split(samples(spark, sf), 7, seed=6)


@query("nested_train_test", f"""
with {SAMPLES},
files as (select file_name, row_number() over (order by file_name) as rn from (select distinct file_name from samples) t),
split as (select file_name, 'train_0' as split from files where rn <= 3
          union all select file_name, 'train_1' from files where rn <= 6
          union all select file_name, 'test' from files where rn > 6)
select split, file_name, sample_n from samples join split using (file_name)""")
def nested_train_test(spark, sf):
    rows = samples(spark, sf)
    return rows.join(sampling.nested_train_test(rows, [3, 6]), "file_name").select("split", "file_name", "sample_n")


@query("running_best", f"""
with {fx.LOSS_LOG},
before as (select run, eval_n, test_loss, min(test_loss) over (partition by run order by eval_n
             rows between unbounded preceding and 1 preceding) as best from loss_log)
select run, eval_n, test_loss from before where best is null or test_loss < best""")
def running_best(spark, sf):
    return logs.running_best(fx.loss_log(spark, sf), "test_loss").select("run", "eval_n", "test_loss")


@query("every_nth", f"""
with {fx.LOSS_LOG} select run, eval_n, loss, test_loss from loss_log where eval_n % 8 = 0""")
def every_nth(spark, sf):
    return logs.every_nth(fx.loss_log(spark, sf), 8).select("run", "eval_n", "loss", "test_loss")


@query("epoch_bucket", f"""
with {fx.LOSS_LOG}
select epoch // 8 as epoch, {R6('avg(loss)')} as loss, {R6('avg(test_loss)')} as test_loss from loss_log group by 1""")
def epoch_bucket(spark, sf):
    return fx.loss_log(spark, sf).groupBy(logs.epoch_bucket(F.col("epoch"), 8).alias("epoch")).agg(
        r6(F.avg("loss")).alias("loss"), r6(F.avg("test_loss")).alias("test_loss"))


@query("run_slice", f"""
with {fx.LOSS_LOG}
select run, eval_n, loss, divergence_loss from loss_log where run in (1, 4, 7)""")
def run_slice(spark, sf):
    return logs.run_slice(fx.loss_log(spark, sf), 1, len(RUNS), 3, ["loss", "divergence_loss"])


@query("shuffled_batches", f"""
with {SAMPLES}
select file_name, sample_n,
       (row_number() over (order by md5('8|' || file_name || '|' || cast(sample_n as varchar))) - 1) // 256 as batch
from samples""")
def shuffled_batches(spark, sf):
    return sampling.shuffled_batches(samples(spark, sf), 256, seed=8)


@query("sorted_output", f"""
with {fx.FLUX} select reaction, count(*) as n_cells from flux group by 1 order by 1""")
def sorted_output(spark, sf):
    # orderBy range-partitions the names; no single task sorts them all.
    return fx.flux(spark, sf).groupBy("reaction").agg(F.count(F.lit(1)).alias("n_cells")).orderBy("reaction")
