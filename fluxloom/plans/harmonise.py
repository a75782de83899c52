"""Queries: projections, filters and schema harmonising."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.functions import text
from fluxloom.operators import harmonise as H
from fluxloom.operators import logs, stats
from fluxloom.operators.ranking import dense_index
from fluxloom.operators.sampling import nested_train_test
from fluxloom.plans import fixtures as fx
from fluxloom.plans.register import query
from fluxloom.session import settle


@query("metabolite_name", """
select p_partkey, 'm[n[' || p_name || ']f[' || p_type || ']ch[' || cast(p_size as varchar) || ']co[' || p_brand || ']]'
  as metabolite
from part""")
def metabolite_name(spark, sf):
    return fx.table(spark, sf, "part").select(
        "p_partkey",
        text.metabolite_name(F.col("p_name"), F.col("p_type"), F.col("p_size"), F.col("p_brand")).alias("metabolite"))


@query("reaction_name", f"""
with {fx.MODEL_STOICH}
select model, reaction_id,
       replace('r[' || string_agg(part, '' order by part) || ']', ',', '.') as reaction
from (select model, reaction_id, metabolite || 's[' || cast(stoich as varchar) || ']' as part from model_stoich) t
group by 1, 2""")
def reaction_name(spark, sf):
    part = F.concat(F.col("metabolite"), F.lit("s["), text.decimal_text(F.col("stoich")), F.lit("]"))
    return (
        fx.model_stoich(spark, sf).groupBy("model", "reaction_id").agg(F.collect_list(part).alias("parts"))
        .select("model", "reaction_id", text.reaction_name(F.col("parts")).alias("reaction"))
    )


# Half of the models rename brand/type to the type alone, so several ids of a file share a name.
NAMES = """names as (
  select distinct label, reaction, split_part(reaction, '/', 2) as new_name from flux where length(label) % 2 = 0)"""


def names(flux):
    return (
        flux.filter(F.length("label") % 2 == 0).select("label", "reaction").distinct()
        .withColumn("new_name", F.split_part("reaction", F.lit("/"), F.lit(2)))
    )


@query("rename_reactions", f"""
with {fx.FLUX}, {NAMES}
select file_name, label, sample_n, coalesce(new_name, reaction) as reaction, flux
from flux left join names using (label, reaction)""")
def rename_reactions(spark, sf):
    flux = fx.flux_table(spark, sf)
    renamed = H.rename_reactions(flux, names(flux))
    return renamed.select("file_name", "label", "sample_n", "reaction", "flux")


@query("collapse_duplicates", f"""
with {fx.FLUX}, {NAMES}
select file_name, label, sample_n, coalesce(new_name, reaction) as reaction, sum(flux) as flux
from flux left join names using (label, reaction) group by 1, 2, 3, 4""")
def collapse_duplicates(spark, sf):
    flux = fx.flux_table(spark, sf)
    return H.collapse_duplicates(H.rename_reactions(flux, names(flux)))


@query("rename_collision_check", f"""
with {fx.FLUX}, {NAMES}
select label, new_name, count(distinct reaction) as n_ids from names group by 1, 2 having count(distinct reaction) > 1""")
def rename_collision_check(spark, sf):
    return H.rename_collisions(names(fx.flux(spark, sf)))


@query("add_source_columns", f"""
with {fx.FLUX}
select label, dense_rank() over (order by file_name) - 1 as file_n, sample_n, file_name, reaction, flux from flux""")
def add_source_columns(spark, sf):
    bare = fx.flux_table(spark, sf).drop("label")
    return H.add_source_columns(bare).select(*H.SOURCE_COLUMNS, "reaction", "flux")


@query("numeric_only", "select o_orderkey, o_totalprice from orders")
def numeric_only(spark, sf):
    return H.numeric_only(fx.table(spark, sf, "orders"), drop=["o_custkey"])


@query("project_fluxes", f"""
with {fx.FLUX}
select file_name, label, sample_n, reaction, flux from flux
where reaction in (select p_brand || '/' || p_type from part where p_size <= 10)""")
def project_fluxes(spark, sf):
    wanted = fx.table(spark, sf, "part").filter("p_size <= 10").select(
        F.concat_ws("/", "p_brand", "p_type").alias("reaction"))
    return H.project_fluxes(fx.flux(spark, sf), wanted).select("file_name", "label", "sample_n", "reaction", "flux")


SETS_SQL = """sets as (
  select reaction, count(distinct file_name) as n_files,
         count(distinct file_name) = (select count(distinct file_name) from flux) as is_core
  from flux group by 1)"""


@query("select_reaction_set", f"""
with {fx.FLUX}, {SETS_SQL}
select 'inner' as kind, reaction from sets where is_core union all select 'outer', reaction from sets""")
def select_reaction_set(spark, sf):
    sets = H.reaction_sets(fx.flux_table(spark, sf))
    return H.select_reaction_set(sets, "inner").select(F.lit("inner").alias("kind"), "reaction").union(
        H.select_reaction_set(sets, "outer").select(F.lit("outer"), "reaction"))


@query("extract_fluxes", f"""
with {fx.FLUX},
named as (select 'named' as choice, p_brand || '/' || p_type as reaction from part where p_retailprice > 1500
          union select 'named', 'unknown/' || p_type from part),
drawn as (select 'drawn' as choice, reaction from (select distinct reaction from flux) t
          order by md5('7|' || reaction) limit 12)
select choice, file_name, label, sample_n, reaction, flux
from flux join (select * from named union all select * from drawn) r using (reaction)""")
def extract_fluxes(spark, sf):
    flux, part = fx.flux_table(spark, sf), fx.table(spark, sf, "part")
    named = part.filter("p_retailprice > 1500").select(F.concat_ws("/", "p_brand", "p_type").alias("reaction")).union(
        part.select(F.concat_ws("/", F.lit("unknown"), "p_type")))
    columns = ["file_name", "label", "sample_n", "reaction", "flux"]
    return (
        H.extract_fluxes(flux, named).select(F.lit("named").alias("choice"), *columns)
        .union(H.extract_fluxes(flux, n=12, seed=7).select(F.lit("drawn"), *columns))
    )


@query("restrict_rows", f"""
with {fx.FLUX} select file_name, label, sample_n, reaction, flux from flux where label = 'model7'""")
def restrict_rows(spark, sf):
    kept = H.restrict_rows(fx.flux(spark, sf), {"label": "model7", "no_such_column": 1})
    return kept.select("file_name", "label", "sample_n", "reaction", "flux")


@query("nonzero_columns", f"""
with {fx.FLUX} select file_name, reaction from flux group by 1, 2 having bool_or(flux <> 0)""")
def nonzero_columns(spark, sf):
    return H.nonzero_reactions(fx.flux(spark, sf))


@query("column_max_threshold", f"""
with {fx.FLUX} select reaction, max(flux) as max_value from flux group by 1 having max(flux) > 75""")
def column_max_threshold(spark, sf):
    return H.columns_above(fx.flux(spark, sf), "reaction", "flux", 75).orderBy("reaction")


@query("drop_runs", f"""
with {fx.LOSS_LOG}, {fx.RUN_ARGS}
select run, eval_n, epoch, loss, lr, n_lay from loss_log join run_args using (run)
where not (lr > 0.00025 or n_lay = 2 or epoch = 0)""")
def drop_runs(spark, sf):
    log = logs.attach_run_args(fx.loss_log(spark, sf), fx.run_args(spark, sf))
    kept = logs.drop_rows(log, F.col("lr") > 0.00025, F.col("n_lay") == 2, F.col("epoch") == 0)
    return kept.select("run", "eval_n", "epoch", "loss", "lr", "n_lay")


@query("label_index", f"""
with {fx.EMB} select row_id, label, dense_rank() over (order by label) - 1 as label_n from emb""")
def label_index(spark, sf):
    rows = fx.emb(spark, sf).select("row_id", "label")
    return rows.join(dense_index(rows, "label", "label_n"), "label").select("row_id", "label", "label_n")


@query("convert_reactions", f"""
with {fx.FLUX}, {SETS_SQL},
target as (select reaction, row_number() over (order by reaction desc) as pos from sets where is_core)
select file_name, sample_n, (select count(*) from target) + 1 as n,
       coalesce(sum(flux * pos), 0) as ordered_sum
from flux left join target using (reaction) group by 1, 2""")
def convert_reactions(spark, sf):
    flux = fx.flux_table(spark, sf)
    dim = settle(stats.reaction_dim(flux), "dictionary")
    source = stats.Dictionary.collect(dim)
    core = stats.Dictionary.collect(dim.filter("is_core")).reactions
    # The model wants the core reactions in reverse order, and one that the data lacks.
    target = [*reversed(core), "not/measured"]
    dense = stats.dense_samples(flux, source, H.ROW_KEY)
    converted = dense.withColumn("v", stats.convert(F.col("v"), source, target))
    return converted.select("file_name", "sample_n", F.size("v").cast("bigint").alias("n"), ordered_sum("v"))


def ordered_sum(v):
    """Sum of value x position: equal only if every value is in its place."""
    return F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x).alias("ordered_sum")


@query("passthrough_mask", f"""
with {fx.FLUX}
select file_name, label, sample_n, reaction, flux from flux
where reaction not in (select p_brand || '/' || p_type from part where p_size > 45)""")
def passthrough_mask(spark, sf):
    model = fx.table(spark, sf, "part").filter("p_size > 45").select(
        F.concat_ws("/", "p_brand", "p_type").alias("reaction"))
    return H.passthrough(fx.flux(spark, sf), model).select("file_name", "label", "sample_n", "reaction", "flux")


@query("columns_by_pattern", f"""
with {fx.LOSS_LOG}
select run, eval_n, divergence_loss, test_divergence_loss from loss_log""")
def columns_by_pattern(spark, sf):
    log = fx.loss_log(spark, sf)
    return log.select("run", "eval_n", *H.columns_containing(log, "divergence"))


@query("align_test_to_train", f"""
with {fx.FLUX},
files as (select file_name, row_number() over (order by file_name) as rn from (select distinct file_name from flux) t),
train as (select reaction, row_number() over (order by reaction) as pos
          from (select distinct reaction from flux join files using (file_name) where rn <= 6) t)
select file_name, sample_n, (select count(*) from train) as n, coalesce(sum(flux * pos), 0) as ordered_sum
from flux join files using (file_name) left join train using (reaction) where rn > 6 group by 1, 2""")
def align_test_to_train(spark, sf):
    flux = fx.flux_table(spark, sf)
    splits = nested_train_test(flux, [6])
    tagged = flux.join(splits, "file_name")
    train, test = tagged.filter("split = 'train_0'"), tagged.filter("split = 'test'")
    layout = stats.Dictionary.collect(stats.flux_stats(train))
    return stats.dense_samples(test, layout, H.ROW_KEY).select(
        "file_name", "sample_n", F.size("v").cast("bigint").alias("n"), ordered_sum("v"))
