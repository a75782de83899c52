"""Queries: statistics, group summaries and score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.operators import classify, harmonise, histogram, logs, metrics, stats
from fluxloom.plans import fixtures as fx
from fluxloom.plans.register import R6, query, r6

STATS_SQL = """n as (select count(*) as n_samples from (select distinct file_name, sample_n from flux) t),
raw as (select reaction, n_samples, sum(flux) / n_samples as mu,
               greatest(sum(flux * flux) / n_samples - (sum(flux) / n_samples) * (sum(flux) / n_samples), 0) as var
        from flux, n group by reaction, n_samples),
stats as (select reaction, n_samples, mu, case when var = 0 then 1.0::double else sqrt(var) end as sd from raw)"""


@query("flux_stats", f"""
with {fx.FLUX}, {STATS_SQL}
select reaction, n_samples, {R6('mu')} as mu, {R6('sd')} as sd from stats""")
def flux_stats(spark, sf):
    return stats.flux_stats(fx.flux_table(spark, sf)).select("reaction", "n_samples", r6(F.col("mu")).alias("mu"),
                                                       r6(F.col("sd")).alias("sd"))


@query("flux_stats_subset", f"""
with {fx.FLUX}, {STATS_SQL},
asked as (select p_brand || '/' || p_type as reaction, min(p_partkey) as pos from part where p_size <= 5 group by 1)
select pos, reaction, {R6('mu')} as mu, {R6('sd')} as sd from stats join asked using (reaction)""")
def flux_stats_subset(spark, sf):
    asked = fx.table(spark, sf, "part").filter("p_size <= 5").groupBy(
        F.concat_ws("/", "p_brand", "p_type").alias("reaction")).agg(F.min("p_partkey").alias("pos"))
    found = stats.flux_stats(fx.flux_table(spark, sf)).join(asked, "reaction")
    return found.select("pos", "reaction", r6(F.col("mu")).alias("mu"), r6(F.col("sd")).alias("sd")).orderBy("pos")


@query("distinct_labels", f"""
with {fx.FLUX}
select count(distinct label) as n_labels, count(distinct file_name) as n_files from flux""")
def distinct_labels(spark, sf):
    return harmonise.count_labels(fx.flux(spark, sf))


@query("group_centroids", f"""
with {fx.FLUX}, n as (select label, count(*) as n_rows from (select distinct label, file_name, sample_n from flux) t
                      group by 1)
select label, reaction, {R6('sum(flux) / n_rows')} as mean from flux join n using (label) group by label, reaction, n_rows""")
def group_centroids(spark, sf):
    centroids = classify.centroids_long(fx.flux_table(spark, sf), "label")
    return centroids.select("label", "reaction", r6(F.col("mean")).alias("mean"))


@query("group_mean_std", f"""
with {fx.LOSS_LOG}
select run, epoch, {R6('avg(loss)')} as mean, {R6('coalesce(stddev_samp(loss), 0)')} as std from loss_log group by 1, 2""")
def group_mean_std(spark, sf):
    return metrics.group_mean_std(fx.loss_log(spark, sf), ["run", "epoch"], "loss").select(
        "run", "epoch", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query("macro_mean_std", f"""
with {fx.LOSS_LOG},
g as (select run, epoch, avg(loss) as m, coalesce(stddev_samp(loss), 0) as s from loss_log group by 1, 2)
select run, {R6('avg(m)')} as mean, {R6('avg(s)')} as std from g group by 1""")
def macro_mean_std(spark, sf):
    return metrics.macro_mean_std(fx.loss_log(spark, sf), ["run"], "epoch", "loss").select(
        "run", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query("column_means", f"""
with {fx.LOSS_LOG}
select {', '.join(f"{R6(f'avg({c})')} as {c}" for c in logs.LOSSES)} from loss_log""")
def column_means(spark, sf):
    return logs.column_means(fx.loss_log(spark, sf)).select(*[r6(F.col(c)).alias(c) for c in logs.LOSSES])


@query("group_min", f"""
with {fx.LOSS_LOG}, {fx.RUN_ARGS}
select lr, batch_size, min(loss) as min_loss, min(test_loss) as min_test_loss
from loss_log join run_args using (run) group by 1, 2""")
def group_min(spark, sf):
    log = logs.attach_run_args(fx.loss_log(spark, sf), fx.run_args(spark, sf))
    return logs.group_min(log, ["lr", "batch_size"], ["loss", "test_loss"])


@query("epoch_mean", f"""
with {fx.LOSS_LOG}
select run, epoch, {', '.join(f"{R6(f'avg({c})')} as {c}" for c in logs.LOSSES)} from loss_log group by 1, 2""")
def epoch_mean(spark, sf):
    means = logs.epoch_mean(fx.loss_log(spark, sf))
    return means.select("run", "epoch", *[r6(F.col(c)).alias(c) for c in logs.LOSSES])


@query("final_epoch_mean", f"""
with {fx.LOSS_LOG}, {fx.RUN_ARGS}, last as (select run, max(epoch) as epoch from loss_log group by 1)
select lr, {R6('avg(loss)')} as loss, {R6('avg(test_loss)')} as test_loss, min(test_loss) as min_test_loss
from loss_log join last using (run, epoch) join run_args using (run) group by 1""")
def final_epoch_mean(spark, sf):
    final = logs.attach_run_args(logs.final_epoch(fx.loss_log(spark, sf)), fx.run_args(spark, sf))
    return final.groupBy("lr").agg(r6(F.avg("loss")).alias("loss"), r6(F.avg("test_loss")).alias("test_loss"),
                                   F.min("test_loss").alias("min_test_loss"))


@query("best_row_per_group", f"""
with {fx.LOSS_LOG}, {fx.RUN_ARGS}
select n_emb, run, eval_n, epoch, loss, test_loss from (
  select *, row_number() over (partition by n_emb order by test_loss, run, eval_n) as rn
  from loss_log join run_args using (run)) t where rn = 1""")
def best_row_per_group(spark, sf):
    log = logs.attach_run_args(fx.loss_log(spark, sf), fx.run_args(spark, sf))
    best = logs.best_row(log, ["n_emb"], "test_loss")
    return best.select("n_emb", "run", "eval_n", "epoch", "loss", "test_loss")


LAYERS = [2, 3, 4, 5, 6]


@query("grid_argmin_pivot", f"""
with {fx.LOSS_LOG}, {fx.RUN_ARGS},
best as (select n_emb, n_lay, loss, row_number() over (partition by n_emb, n_lay order by test_loss, run, eval_n) as rn
         from loss_log join run_args using (run))
select n_emb, {', '.join(f"coalesce(max(case when n_lay = {v} then loss end), 0) as n_lay_{v}" for v in LAYERS)}
from best where rn = 1 group by 1""")
def grid_argmin_pivot(spark, sf):
    log = logs.attach_run_args(fx.loss_log(spark, sf), fx.run_args(spark, sf))
    return logs.grid_argmin(log, "n_emb", "n_lay", LAYERS, "loss", "test_loss")


@query("tail_average", f"""
with {fx.LOSS_LOG}, kept as (
    select *, row_number() over (partition by run order by eval_n desc) as from_end from loss_log)
select run, {R6('avg(loss)')} as loss, {R6('avg(test_loss)')} as test_loss
from kept where from_end <= 128 group by 1 having count(*) = 128""")
def tail_average(spark, sf):
    tail = logs.tail_average(fx.loss_log(spark, sf), 128, ["loss", "test_loss"])
    return tail.select("run", r6(F.col("loss")).alias("loss"), r6(F.col("test_loss")).alias("test_loss"))


ONE = "set_name = 'c0' and rep = 0"


@query("contingency", f"""
with {fx.CLUSTERING}
select set_name, rep, cluster, emb.label as label, count(*) as n from clustering join emb using (row_id)
group by 1, 2, 3, 4""")
def contingency(spark, sf):
    joined = labelled(spark, sf)
    return joined.groupBy("set_name", "rep", "cluster", "label").agg(F.count(F.lit(1)).alias("n"))


def labelled(spark, sf):
    """The sixteen clusterings with the true label of each row."""
    return fx.clustering(spark, sf).join(fx.emb(spark, sf).select("row_id", "label"), "row_id")


# A cluster of fewer than 30 rows counts as noise here, so that both counts are put to use.
@query("cluster_summary", f"""
with {fx.CLUSTERING},
sizes as (select set_name, rep, cluster, count(*) as n from clustering group by 1, 2, 3),
marked as (select set_name, rep, row_id, case when n < 30 then '-1' else cluster end as cluster
           from clustering join sizes using (set_name, rep, cluster))
select set_name, rep, count(distinct case when cluster <> '-1' then cluster end) as n_clusters,
       count(*) filter (where cluster = '-1') as n_outliers
from marked group by 1, 2""")
def cluster_summary(spark, sf):
    clusters = fx.clustering(spark, sf)
    by = ["set_name", "rep", "cluster"]
    sizes = clusters.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    marked = clusters.join(sizes, by).withColumn("cluster", F.when(F.col("n") < 30, "-1").otherwise(F.col("cluster")))
    return metrics.cluster_summary(marked, ["set_name", "rep"])


# The matching takes the best remaining entry of the contingency table until a cluster or label runs out.
GREEDY = f"""{fx.CLUSTERING},
counts as (select cluster, emb.label as label, count(*) as n
           from clustering join emb using (row_id) where {ONE} group by 1, 2),
picks as (
  select 1 as step, [cluster] as cs, [label] as ls, cluster, label
  from (select * from counts order by n desc, cluster, label limit 1) t
  union all
  select step + 1, list_append(cs, cluster), list_append(ls, label), cluster, label from (
    select p.step, p.cs, p.ls, c.cluster, c.label,
           row_number() over (order by c.n desc, c.cluster, c.label) as rn
    from picks p, counts c where not list_contains(p.cs, c.cluster) and not list_contains(p.ls, c.label)) t
  where rn = 1),
matched as (select c.cluster, coalesce(p.label, '-1') as label
            from (select distinct cluster from counts) c left join picks p using (cluster))"""


@query("cluster_purity", f"""
with recursive {GREEDY}
select m.label as mapped, {R6('avg(case when emb.label = m.label then 1.0::double else 0 end)')} as purity,
       count(*) filter (where emb.label <> m.label) as n_mismatch
from clustering join emb using (row_id) join matched m using (cluster) where {ONE} group by 1""")
def cluster_purity(spark, sf):
    rows = labelled(spark, sf).filter(ONE)
    match = metrics.greedy_match(metrics.contingency(rows, "cluster", "label"))
    mapped = match.select("cluster", F.coalesce("label", F.lit("-1")).alias("mapped"))
    found = metrics.purity(rows.join(mapped, "cluster"))
    return found.withColumn("purity", r6(F.col("purity")))


@query("greedy_cluster_match", f"with recursive {GREEDY} select cluster, label from matched")
def greedy_cluster_match(spark, sf):
    rows = labelled(spark, sf).filter(ONE)
    match = metrics.greedy_match(metrics.contingency(rows, "cluster", "label"))
    return match.select("cluster", F.coalesce("label", F.lit("-1")).alias("label"))


CLASSES = [str(i) for i in range(10)]


@query("prediction_matrix", f"""
with {fx.CLUSTERING}
select emb.label as label,
       {', '.join(f"{R6(f'avg(case when seed_label = {c!r} then 1.0::double else 0 end)')} as pred_{c}" for c in CLASSES)}
from clustering join emb using (row_id) group by 1""")
def prediction_matrix(spark, sf):
    matrix = metrics.prediction_matrix(labelled(spark, sf), "label", "seed_label", CLASSES, "pred_")
    return matrix.select("label", *[r6(F.col(f"pred_{c}")).alias(f"pred_{c}") for c in CLASSES])


@query("label_accuracy", f"""
with {fx.CLUSTERING}
select rep, emb.label as label, set_name as classifier,
       {R6('avg(case when seed_label = emb.label then 1.0::double else 0 end)')} as accuracy
from clustering join emb using (row_id) group by 1, 2, 3""")
def label_accuracy(spark, sf):
    predicted = labelled(spark, sf).withColumnsRenamed({"set_name": "classifier", "seed_label": "pred"})
    scores = metrics.accuracy(predicted, ["rep", "label", "classifier"])
    return scores.withColumn("accuracy", r6(F.col("accuracy")))


@query("histogram", f"""
with {fx.FLUX}, samples as (select distinct label, file_name, sample_n from flux),
dense as (select s.label, r.reaction, coalesce(f.flux, 0) as x
          from samples s cross join (select distinct reaction from flux) r
          left join flux f on f.file_name = s.file_name and f.sample_n = s.sample_n and f.reaction = r.reaction),
bounds as (select reaction, min(x) as lo, max(x) as hi from dense group by 1 having bool_or(x <> 0)),
wide as (select reaction, case when lo = hi then lo - 0.5 else lo end as lo,
                case when lo = hi then hi + 0.5 else hi end as hi from bounds)
select reaction, label, cast(least(floor((x - lo) / (hi - lo) * 40), 39) as bigint) as bin, count(*) as n
from dense join wide using (reaction) group by 1, 2, 3""")
def histogram_query(spark, sf):
    return histogram.histogram(fx.flux_table(spark, sf), 40)


@query("global_bounds", f"""
with {fx.LOSS_LOG}
select max(m) as max_test_loss from (
  select max(test_loss) as m from loss_log where run < 3
  union all select max(test_loss) from loss_log where run between 3 and 6
  union all select max(test_loss) from loss_log where run > 6) t""")
def global_bounds(spark, sf):
    log = fx.loss_log(spark, sf)
    run = F.col("run")
    return logs.global_max([log.filter(run < 3), log.filter(run.between(3, 6)), log.filter(run > 6)], "test_loss")


@query("select_and_sum", f"""
with {fx.LOSS_LOG}
select sum(case when epoch = 0 then loss end) as loss, sum(case when epoch = 0 then test_loss end) as test_loss
from (select epoch, round(sum(loss), 4) as loss, round(sum(test_loss), 4) as test_loss from loss_log group by 1) t""")
def select_and_sum(spark, sf):
    matrix = fx.loss_log(spark, sf).groupBy("epoch").agg(
        F.round(F.sum("loss"), 4).alias("loss"), F.round(F.sum("test_loss"), 4).alias("test_loss"))
    return logs.selected_sums(matrix, "epoch = 0", ["loss", "test_loss"])
