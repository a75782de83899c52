"""Queries: sources and sinks. Each writes a view of the given tables to a new shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.functions.text import model_name
from fluxloom.operators import sampling
from fluxloom.operators.logs import LOSSES
from fluxloom.plans import fixtures as fx
from fluxloom.plans.joins import FILES, files
from fluxloom.plans.register import R6, query, r6
from fluxloom.plans.sampling import SAMPLES, ranked
from fluxloom.session import scratch_path, settle
from fluxloom.sources import flux_csv, sbml, tables


def written_csv(spark, sf):
    path = scratch_path(spark, "flux-csv")
    flux_csv.write(fx.flux_table(spark, sf), path, rows_per_part=128)
    return path


# A wide file has a value for each of its reactions in each of its rows.
WIDE = f"""{SAMPLES},
wide as (select s.file_name, s.sample_n, r.reaction, coalesce(f.flux, 0) as flux
         from samples s join (select distinct file_name, reaction from flux) r on s.file_name = r.file_name
         left join flux f on f.file_name = s.file_name and f.sample_n = s.sample_n and f.reaction = r.reaction)"""


@query("scan_flux_csv", f"""
with {WIDE}
select file_name, regexp_replace(file_name, '_100$', '') as label, reaction, count(*) as n_rows,
       count(*) filter (where flux = 0) as n_zero, sum(flux) as total, sum(flux * flux) as squares,
       sum(flux * sample_n) as placed
from wide group by 1, 2, 3""")
def scan_flux_csv(spark, sf):
    flux = F.col("flux")
    return flux_csv.read(spark, written_csv(spark, sf)).groupBy("file_name", "label", "reaction").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(flux == 0).alias("n_zero"), F.sum(flux).alias("total"),
        F.sum(flux * flux).alias("squares"), F.sum(flux * F.col("sample_n")).alias("placed"))


@query("discover_flux_files", f"""
with {fx.FLUX} select distinct file_name, regexp_replace(file_name, '_100$', '') as label from flux""")
def discover_flux_files(spark, sf):
    return flux_csv.discover(spark, written_csv(spark, sf)).select("file_name", "label")


@query("model_name_from_file", f"""
with {FILES}
select file_name, regexp_replace(file_name, '_([0-9]|k)+(\\([0-9]*\\))?$', '') as label, n_lines from files""")
def model_name_from_file(spark, sf):
    return files(spark, sf).select("file_name", model_name(F.col("file_name")).alias("label"), "n_lines")


@query("scan_header_union", f"""
with {fx.FLUX} select reaction, count(distinct file_name) as n_files from flux group by 1""")
def scan_header_union(spark, sf):
    return flux_csv.header_union(spark, written_csv(spark, sf))


@query("scan_head_n", f"""
with {WIDE},
first as (select file_name, sample_n from samples
          qualify row_number() over (partition by file_name order by sample_n) <= 25)
select file_name, regexp_replace(file_name, '_100$', '') as label, sample_n, reaction, flux
from wide join first using (file_name, sample_n)""")
def scan_head_n(spark, sf):
    return flux_csv.read_head(spark, written_csv(spark, sf), 25).select("file_name", "label", "sample_n", "reaction", "flux")


SPECIES = """species as (
  select distinct 'model' || cast(p_partkey % 4 as varchar) as model, 'm' || cast(p_size as varchar) as metabolite,
         'size ' || cast(p_size as varchar) || ' & more' as name, 'C' || cast(p_size as varchar) as formula,
         p_size % 5 - 2 as charge, 'c' as compartment
  from part)"""


def species(spark, sf):
    size = F.col("p_size").cast("string")
    return fx.table(spark, sf, "part").select(
        F.concat(F.lit("model"), (F.col("p_partkey") % 4).cast("string")).alias("model"),
        F.concat(F.lit("m"), size).alias("metabolite"), F.concat(F.lit("size "), size, F.lit(" & more")).alias("name"),
        F.concat(F.lit("C"), size).alias("formula"), (F.col("p_size") % 5 - 2).alias("charge"),
        F.lit("c").alias("compartment")).distinct()


@query("scan_sbml_model", f"""
with {fx.MODEL_STOICH}, {SPECIES},
named as (select model, metabolite, 'm[n[' || name || ']f[' || formula || ']ch[' || cast(charge as varchar) || ']co['
                 || compartment || ']]' as metabolite_name from species),
parts as (select model, reaction_id, string_agg(metabolite_name || 's[' || cast(stoich as varchar) || ']', ''
                   order by metabolite_name || 's[' || cast(stoich as varchar) || ']') as body
          from model_stoich join named using (model, metabolite) group by 1, 2)
select model, reaction_id, metabolite, stoich, replace('r[' || body || ']', ',', '.') as reaction
from model_stoich join parts using (model, reaction_id)""")
def scan_sbml_model(spark, sf):
    path = scratch_path(spark, "gems")
    sbml.write(fx.model_stoich(spark, sf), species(spark, sf), path, parts=2)
    found = sbml.read_coefficients(spark, path)
    names = sbml.canonical_names(found, sbml.read_species(spark, path).distinct())
    return found.join(names, ["model", "reaction_id"])


@query("snapshot_cache", f"with {fx.FLUX} select file_name, label, sample_n, reaction, flux from flux")
def snapshot_cache(spark, sf):
    return tables.snapshot(fx.flux(spark, sf), scratch_path(spark, "snapshot"))


@query("scan_run_args", f"""
with {fx.RUN_ARGS}
select run, lr, n_emb, n_lay, case when run % 4 = 0 then 64 else batch_size end as batch_size from run_args""")
def scan_run_args(spark, sf):
    path = scratch_path(spark, "args")
    args = fx.run_args(spark, sf)
    tables.write_run_args(args.withColumn("batch_size", F.when(F.col("run") % 4 != 0, F.col("batch_size"))), path)
    schema = "run bigint, lr double, n_emb bigint, n_lay bigint, batch_size bigint"
    return tables.read_run_args(spark, path, schema, {"batch_size": 64})


@query("append_loss_log", f"""
with {fx.LOSS_LOG} select run, eval_n, epoch, {', '.join(LOSSES)} from loss_log""")
def append_loss_log(spark, sf):
    path, log = scratch_path(spark, "losses"), fx.loss_log(spark, sf)
    # Three sessions of training: each adds its own evaluations.
    epoch = F.col("epoch")
    for session in (epoch < 4, (epoch >= 4) & (epoch < 16), epoch >= 16):
        tables.append_log(log.filter(session), path)
    return spark.read.schema(log.schema).parquet(path)


@query("sink_csv", f"""
with {fx.LOSS_LOG}
select run, epoch, {R6('avg(loss)')} as loss, min(test_loss) as test_loss from loss_log group by 1, 2""")
def sink_csv(spark, sf):
    result = fx.loss_log(spark, sf).groupBy("run", "epoch").agg(
        r6(F.avg("loss")).alias("loss"), F.min("test_loss").alias("test_loss"))
    path = scratch_path(spark, "result")
    tables.write_csv(result, path)
    return tables.read_csv(spark, path, result.schema)


@query("write_mixes", f"""
with {ranked(6)},
mixed as (select file_name, sample_n, 7 - ntile(7) over (partition by file_name order by draw desc) as mix from ranked)
select mix, file_name, count(*) as n_cells, sum(flux) as total from mixed join flux using (file_name, sample_n)
group by 1, 2""")
def write_mixes(spark, sf):
    flux, path = fx.flux_table(spark, sf), scratch_path(spark, "mixes")
    mixes = sampling.mix_split(settle(sampling.sample_rows(flux), "samples"), 7, seed=6)
    tables.write_mixes(flux.join(mixes, ["file_name", "sample_n"]), path)
    return spark.read.parquet(path).groupBy(F.col("mix").cast("bigint").alias("mix"), "file_name").agg(
        F.count(F.lit(1)).alias("n_cells"), F.sum("flux").alias("total"))
