"""Queries: scaling, ranges, names and draws."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.functions import ranges, text
from fluxloom.functions.draws import draw
from fluxloom.operators import distance, grids, harmonise, logs, sampling, stats
from fluxloom.operators.harmonise import ROW_KEY
from fluxloom.plans import fixtures as fx
from fluxloom.plans.aggregates import STATS_SQL
from fluxloom.plans.joins import FILES, files
from fluxloom.plans.register import R6, query, r6

DENSE = """samples as (select distinct file_name, sample_n from flux),
dense as (select s.file_name, s.sample_n, d.reaction, coalesce(f.flux, 0) as x, mu, sd
          from samples s cross join stats d
          left join flux f on f.file_name = s.file_name and f.sample_n = s.sample_n and f.reaction = d.reaction)"""


def dictionary(flux, ddof=0):
    return stats.Dictionary.collect(stats.flux_stats(flux, ddof))


@query("zscore", f"""
with {fx.FLUX}, {STATS_SQL}, {DENSE}
select file_name, sample_n, reaction, {R6('(x - mu) / sd')} as z from dense""")
def zscore(spark, sf):
    flux = fx.flux_table(spark, sf)
    layout = dictionary(flux)
    scaled = stats.dense_samples(flux, layout, ROW_KEY, scaled=True)
    return stats.explode_vectors(scaled, layout, ROW_KEY, out="z").withColumn("z", r6(F.col("z")))


@query("zscore_inverse", f"""
with {fx.FLUX}, {STATS_SQL}, {DENSE}
select file_name, sample_n, count(*) as n, {R6('sum(x)')} as total, {R6('sum(x * x)')} as squares from dense
group by 1, 2""")
def zscore_inverse(spark, sf):
    """Scaling and its inverse give the dense samples back."""
    flux = fx.flux_table(spark, sf)
    layout = dictionary(flux)
    scaled = stats.dense_samples(flux, layout, ROW_KEY, scaled=True)
    back = scaled.withColumn("v", stats.affine(F.col("v"), layout.mu, layout.sd, inverse=True))
    return back.select("file_name", "sample_n", F.size("v").cast("bigint").alias("n"),
                       r6(total("v")).alias("total"), r6(total("v", square=True)).alias("squares"))


def total(v, square=False):
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + (x * x if square else x))


@query("zscore_sample_std", f"""
with {fx.FLUX}, n as (select count(*) as n_samples from (select distinct file_name, sample_n from flux) t),
raw as (select reaction, n_samples, sum(flux) / n_samples as mu,
               greatest((sum(flux * flux) - n_samples * (sum(flux) / n_samples) * (sum(flux) / n_samples))
                        / (n_samples - 1), 0) as var
        from flux, n group by reaction, n_samples),
stats as (select reaction, n_samples, mu, case when var = 0 then 1.0::double else sqrt(var) end as sd from raw),
{DENSE}
select file_name, sample_n, {R6('min((x - mu) / sd)')} as least, {R6('max((x - mu) / sd)')} as most,
       {R6('sum((x - mu) / sd)')} as total
from dense group by 1, 2""")
def zscore_sample_std(spark, sf):
    flux = fx.flux_table(spark, sf)
    scaled = stats.dense_samples(flux, dictionary(flux, ddof=1), ROW_KEY, scaled=True)
    return scaled.select("file_name", "sample_n", r6(F.array_min("v")).alias("least"),
                         r6(F.array_max("v")).alias("most"), r6(total("v")).alias("total"))


def price_bounds(spark, sf):
    """Least and largest price of each brand: the bounds of its ranges."""
    return fx.table(spark, sf, "part").groupBy("p_brand").agg(
        F.min("p_retailprice").alias("low"), F.max("p_retailprice").alias("high"))


BOUNDS = "b as (select p_brand, min(p_retailprice) as low, max(p_retailprice) as high from part group by 1)"


@query("linear_range", f"""
with {BOUNDS}
select p_brand, i as pos, {R6('low + i * (high - low) / 9')} as value, cast(trunc(low + i * (high - low) / 9) as bigint) as whole
from b, generate_series(0, 9) t(i)""")
def linear_range(spark, sf):
    values = ranges.linear_range(F.col("low"), F.col("high"), 10)
    return price_bounds(spark, sf).select("p_brand", F.posexplode(values).alias("pos", "x")).select(
        "p_brand", F.col("pos").cast("bigint").alias("pos"), r6(F.col("x")).alias("value"),
        F.col("x").cast("bigint").alias("whole"))


@query("geometric_range", f"""
with {BOUNDS}
select p_brand, i as pos, {R6('low * pow(pow(high / low, 1.0::double / 9), i)')} as value
from b, generate_series(0, 9) t(i)""")
def geometric_range(spark, sf):
    values = ranges.geometric_range(F.col("low"), F.col("high"), 10)
    return price_bounds(spark, sf).select("p_brand", F.posexplode(values).alias("pos", "x")).select(
        "p_brand", F.col("pos").cast("bigint").alias("pos"), r6(F.col("x")).alias("value"))


@query("format_param", f"""
with {fx.RUN_ARGS}
select run, '--lr ' || printf('%.4e', lr) || ' --n_emb ' || cast(n_emb as varchar) || ' -b ' || cast(b as varchar) as arg_str
from (select row_number() over (order by lr, n_emb, b) - 1 as run, lr, n_emb, b
      from (select distinct lr from run_args) x, (select distinct n_emb from run_args) y,
           (select distinct batch_size as b from run_args) z) t""")
def format_param(spark, sf):
    args = fx.run_args(spark, sf).withColumnRenamed("batch_size", "b")
    grid = grids.param_grid(spark, grids.value_lists(args, ["lr", "n_emb", "b"]))
    return grids.command_line(grid, {"lr": "float", "n_emb": "int", "b": "int"})


@query("dataset_paths", f"""
with {FILES} select file_name, n_lines, 'data/samples/' || file_name || '.csv' as path from files""")
def dataset_paths(spark, sf):
    return harmonise.file_paths(files(spark, sf), "data/samples")


@query("join_labels", f"""
with {fx.RUN_ARGS}
select run, cast(n_emb as varchar) || '-' || cast(n_lay as varchar) || '-' || cast(batch_size as varchar) as label
from run_args""")
def join_labels(spark, sf):
    return logs.run_labels(fx.run_args(spark, sf), ["n_emb", "n_lay", "batch_size"]).select("run", "label")


@query("parse_boolean", """
select event_id, case event_id % 4 when 0 then true when 1 then true else false end as flag from events""")
def parse_boolean(spark, sf):
    events = fx.table(spark, sf, "events").select("event_id")
    word = F.get(F.array(*[F.lit(w) for w in ("true", "TRUE", "False", "false")]), (F.col("event_id") % 4).cast("int"))
    return events.select("event_id", text.parse_boolean(word).alias("flag"))


@query("loss_correction", f"""
with {fx.LOSS_LOG}, {fx.RUN_ARGS}
select run, eval_n, {R6('divergence_loss - n_emb / 2')} as divergence_loss,
       {R6('divergence_loss - n_emb / 2 + reconstruction_loss')} as loss,
       {R6('test_divergence_loss - n_emb / 2')} as test_divergence_loss,
       {R6('test_divergence_loss - n_emb / 2 + test_reconstruction_loss')} as test_loss
from loss_log join run_args using (run)""")
def loss_correction(spark, sf):
    log = logs.loss_correction(logs.attach_run_args(fx.loss_log(spark, sf), fx.run_args(spark, sf)))
    return log.select("run", "eval_n", *[r6(F.col(c)).alias(c) for c in
                                         ("divergence_loss", "loss", "test_divergence_loss", "test_loss")])


@query("euclidean_distance", f"""
with {fx.EMB}, mean as (select label, i, avg(x) as c from cells group by 1, 2)
select row_id, m.label as centre, {R6('sqrt(sum((x - c) * (x - c)))')} as distance
from cells join mean m using (i) group by 1, 2""")
def euclidean_distance(spark, sf):
    from fluxloom.operators.classify import centroids

    rows = fx.emb(spark, sf)
    centres = distance.Centres.collect(centroids(rows, "label"), "label", "v")
    return distance.distances(rows.select("row_id", "v"), "v", centres, ["row_id"], "centre").withColumn(
        "distance", r6(F.col("distance")))


@query("seeded_draw", f"""
with {fx.FLUX}, samples as (select distinct file_name, sample_n from flux)
select file_name, sample_n, md5('42|' || file_name || '|' || cast(sample_n as varchar)) as draw from samples""")
def seeded_draw(spark, sf):
    return sampling.sample_rows(fx.flux(spark, sf)).withColumn("draw", draw(42, *ROW_KEY))
