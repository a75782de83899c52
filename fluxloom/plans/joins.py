"""Queries: joins, products and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.operators import grids, logs, stoich
from fluxloom.operators import harmonise as H
from fluxloom.plans import fixtures as fx
from fluxloom.plans.harmonise import SETS_SQL
from fluxloom.plans.register import R6, query, r6


def halves(spark, sf):
    """Logs of two kinds of run: even runs recorded test losses, odd runs did not."""
    log = fx.loss_log(spark, sf).select("run", "eval_n", "loss", "test_loss")
    return log.filter(F.col("run") % 2 == 0), log.filter(F.col("run") % 2 == 1).drop("test_loss")


@query("union_fill_zero", f"""
with {fx.LOSS_LOG}
select run, eval_n, loss, case when run % 2 = 0 then test_loss else 0 end as test_loss from loss_log""")
def union_fill_zero(spark, sf):
    return logs.outer_concat(list(halves(spark, sf))).fillna(0, ["test_loss"])


@query("outer_concat_runs", f"""
with {fx.LOSS_LOG}
select run, epoch, {R6('avg(loss)')} as loss,
       case when run % 2 = 0 then {R6('avg(test_loss)')} end as test_loss
from loss_log group by 1, 2""")
def outer_concat_runs(spark, sf):
    log = fx.loss_log(spark, sf)
    even = log.filter(F.col("run") % 2 == 0).groupBy("run", "epoch").agg(
        r6(F.avg("loss")).alias("loss"), r6(F.avg("test_loss")).alias("test_loss"))
    odd = log.filter(F.col("run") % 2 == 1).groupBy("run", "epoch").agg(r6(F.avg("loss")).alias("loss"))
    return logs.outer_concat([odd, even])


@query("reaction_sets", f"with {fx.FLUX}, {SETS_SQL} select reaction, n_files, is_core from sets")
def reaction_sets(spark, sf):
    return H.reaction_sets(fx.flux_table(spark, sf))


@query("combine_samples", f"""
with {fx.FLUX}, {SETS_SQL},
live as (select file_name, reaction, count(*) as n_cells, sum(flux) as total from flux
         group by 1, 2 having bool_or(flux <> 0))
select 'U' as action, file_name, reaction, n_cells, total from live
union all
select 'I', file_name, reaction, n_cells, total from live where reaction in (select reaction from sets where is_core)""")
def combine_samples(spark, sf):
    flux = fx.flux_table(spark, sf)

    def summary(action):
        return H.combine_samples(flux, action).groupBy(
            F.lit(action).alias("action"), "file_name", "reaction").agg(
            F.count(F.lit(1)).alias("n_cells"), F.sum("flux").alias("total"))

    return summary("U").union(summary("I"))


FILES = """files as (
  select 'model' || cast(s_nationkey as varchar) ||
         case s_nationkey % 3 when 0 then '_100' when 1 then '_10k' else '_10k(3)' end as file_name,
         count(*) as n_lines
  from lineitem join supplier on l_suppkey = s_suppkey group by 1)"""


def files(spark, sf):
    """Sample files with names of every form."""
    key = F.col("s_nationkey")
    suffix = F.when(key % 3 == 0, "_100").when(key % 3 == 1, "_10k").otherwise("_10k(3)")
    return (
        fx.table(spark, sf, "lineitem").select("l_suppkey")
        .join(fx.table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.concat(F.lit("model"), key.cast("string"), suffix).alias("file_name"))
        .agg(F.count(F.lit(1)).alias("n_lines"))
    )


@query("files_to_models", f"""
with {FILES}, models as (
  select 'model' || cast(n_nationkey as varchar) as model_name from nation where n_regionkey <> 2)
select file_name, n_lines, regexp_replace(file_name, '_([0-9]|k)+(\\([0-9]*\\))?$', '') as model_name,
       regexp_replace(file_name, '_([0-9]|k)+(\\([0-9]*\\))?$', '') in (select model_name from models) as has_model
from files""")
def files_to_models(spark, sf):
    models = fx.table(spark, sf, "nation").filter("n_regionkey <> 2").select(
        F.concat(F.lit("model"), F.col("n_nationkey").cast("string")).alias("model"))
    return H.files_to_models(files(spark, sf), models)


@query("attach_run_args", f"""
with {fx.LOSS_LOG}, {fx.RUN_ARGS}
select run, eval_n, loss, test_loss, lr, n_emb, n_lay, batch_size from loss_log left join run_args using (run)""")
def attach_run_args(spark, sf):
    joined = logs.attach_run_args(fx.loss_log(spark, sf), fx.run_args(spark, sf))
    return joined.select("run", "eval_n", "loss", "test_loss", "lr", "n_emb", "n_lay", "batch_size")


RUNS = list(range(10))


@query("runs_side_by_side", f"""
with {fx.LOSS_LOG}
select eval_n, {', '.join(f"max(case when run = {r} then {c} end) as run{r}_{c}"
                          for r in RUNS for c in ('loss', 'test_loss'))}
from loss_log group by 1""")
def runs_side_by_side(spark, sf):
    return logs.runs_side_by_side(fx.loss_log(spark, sf), RUNS, ["loss", "test_loss"])


@query("label_rename_join", f"""
with {fx.FLUX}
select label, n_name as display, sum(flux) as total
from flux join nation on label = 'model' || cast(n_nationkey as varchar) group by 1, 2""")
def label_rename_join(spark, sf):
    shown = fx.table(spark, sf, "nation").select(
        F.concat(F.lit("model"), F.col("n_nationkey").cast("string")).alias("label"), F.col("n_name").alias("display"))
    totals = fx.flux(spark, sf).groupBy("label").agg(F.sum("flux").alias("total"))
    return H.rename_labels(totals, shown).select("label", "display", "total")


@query("row_align_join", f"""
with {fx.FLUX}
select file_name, sample_n, sum(flux) as total, max(case when flux > 0 then flux end) as top
from flux group by 1, 2""")
def row_align_join(spark, sf):
    flux = fx.flux_table(spark, sf)
    totals = flux.groupBy(*H.ROW_KEY).agg(F.sum("flux").alias("total"))
    tops = flux.filter("flux > 0").groupBy(*H.ROW_KEY).agg(F.max("flux").alias("top"))
    return H.align_rows(totals, tops)


@query("param_grid", f"""
with {fx.RUN_ARGS}
select row_number() over (order by lr, n_emb, n_lay, batch_size) - 1 as run, lr, n_emb, n_lay, batch_size
from (select distinct lr from run_args) a, (select distinct n_emb from run_args) b,
     (select distinct n_lay from run_args) c, (select distinct batch_size from run_args) d""")
def param_grid(spark, sf):
    values = grids.value_lists(fx.run_args(spark, sf), ["lr", "n_emb", "n_lay", "batch_size"])
    return grids.param_grid(spark, values)


@query("pending_work", f"""
with {fx.FLUX}
select 'model' || cast(n_nationkey as varchar) || '_' || cast(n as varchar) as file_name
from nation, (values (100), (1000)) t(n)
where 'model' || cast(n_nationkey as varchar) || '_' || cast(n as varchar) not in (select file_name from flux)""")
def pending_work(spark, sf):
    planned = (
        fx.table(spark, sf, "nation")
        .select("n_nationkey", F.explode(F.array(F.lit("100"), F.lit("1000"))).alias("n"))
        .select(F.concat(F.lit("model"), F.col("n_nationkey").cast("string"), F.lit("_"), "n").alias("file_name"))
    )
    return grids.pending(planned, fx.flux(spark, sf), "file_name")


@query("missing_model_reactions", f"""
with {fx.FLUX}, {SETS_SQL}
select p_partkey % 4 as model, count(distinct p_brand || '/' || p_type) as n_missing
from part where p_brand || '/' || p_type not in (select reaction from sets where is_core) group by 1""")
def missing_model_reactions(spark, sf):
    model = fx.table(spark, sf, "part").select(
        (F.col("p_partkey") % 4).alias("model"), F.concat_ws("/", "p_brand", "p_type").alias("reaction")).distinct()
    core = H.select_reaction_set(H.reaction_sets(fx.flux_table(spark, sf)), "inner")
    return H.unknown_reactions_by(model, core, "model")


@query("stoich_matrix", f"with {fx.STOICH_LAST} select metabolite, reaction, stoich from stoich")
def stoich_matrix(spark, sf):
    return stoich.stoich_matrix(fx.stoich_entries(spark, sf))


@query("mass_balance", f"""
with {fx.FLUX}, {fx.STOICH_LAST}
select file_name, sample_n, metabolite, sum(flux * stoich) as net
from flux join stoich using (reaction) where flux <> 0 and stoich <> 0 group by 1, 2, 3""")
def mass_balance(spark, sf):
    flux = fx.flux(spark, sf)
    return stoich.mass_balance(flux, stoich.stoich_matrix(fx.stoich_entries(spark, sf)))


@query("reaction_consistency", f"""
with {fx.MODEL_STOICH},
maps as (select model, reaction_id, string_agg(metabolite || '=' || cast(stoich as varchar), ';' order by metabolite)
           as parts from model_stoich group by 1, 2)
select reaction_id, count(distinct parts) as n_forms, count(*) as n_models
from maps group by 1 having count(distinct parts) > 1""")
def reaction_consistency(spark, sf):
    return stoich.reaction_consistency(fx.model_stoich(spark, sf))
