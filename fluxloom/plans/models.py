"""Queries: clustering, classification and their scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from fluxloom.operators import classify, cluster, gmm, metrics
from fluxloom.operators.dbscan import dbscan
from fluxloom.plans import fixtures as fx
from fluxloom.plans.aggregates import ONE
from fluxloom.plans.register import R6, query, r6
from fluxloom.session import settle


def train_rows(spark, sf):
    return fx.emb(spark, sf).filter("split = 'train'")


@query("nearest_centroid", f"""
with {fx.EMB},
mean as (select label, i, avg(x) as c from cells where split = 'train' group by 1, 2),
near as (select row_id, m.label as pred, sum((x - c) * (x - c)) as d2 from cells join mean m using (i) group by 1, 2)
select row_id, label, split, pred from emb join (
  select row_id, pred, row_number() over (partition by row_id order by d2, pred) as rn from near) t using (row_id)
where rn = 1""")
def nearest_centroid(spark, sf):
    rows = fx.emb(spark, sf)
    predicted = classify.nearest_centroid(train_rows(spark, sf), rows, "label")
    return predicted.select("row_id", "label", "split", "pred")


@query("random_forest")
def random_forest(spark, sf):
    rows = fx.emb(spark, sf)
    predicted = classify.random_forest(train_rows(spark, sf), rows, max_depth=4, seed=1)
    return predicted.select("row_id", "label", "split", "pred")


@query("mlp_classifier")
def mlp_classifier(spark, sf):
    rows = fx.emb(spark, sf)
    predicted = classify.mlp_classifier(train_rows(spark, sf), rows, seed=1, max_iter=50)
    return predicted.select("row_id", "label", "split", "pred")


@query("gmm_fit_per_label", f"""
with {fx.EMB}, mean as (select label, i, avg(x) as m from cells group by 1, 2),
centred as (select row_id, label, i, x - m as x from cells join mean using (label, i))
select a.label as label, a.i - 1 as i, b.i - 1 as j,
       {R6('avg(a.x * b.x) + max(case when a.i = b.i then 0.000001 else 0 end)')} as cov
from centred a join centred b on a.row_id = b.row_id and a.i <= b.i group by 1, 2, 3""")
def gmm_fit_per_label(spark, sf):
    _, cov = gmm.fit_moments(fx.emb(spark, sf))
    return cov.select("label", F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"),
                      r6(F.col("cov")).alias("cov"))


# Rows of a covariance beside those of the unit matrix; every step takes the first row out of the rest. What is left
# beside it are the factors: pivots, and combinations of columns that do not vary together.
@query("gmm_classify", f"""
with recursive {fx.EMB},
mean as (select label, i, avg(x) as m from cells where split = 'train' group by 1, 2),
centred as (select row_id, label, i, x - m as x from cells join mean using (label, i) where split = 'train'),
cov as (select a.label as label, a.i as i, b.i as j, avg(a.x * b.x) + max(case when a.i = b.i then 0.000001 else 0 end) as c
        from centred a join centred b on a.row_id = b.row_id group by 1, 2, 3),
lines as (select label, i, list(c order by j) || list(case when i = j then 1::double else 0::double end order by j) as line
          from cov group by 1, 2),
steps(label, k, m) as (
  select label, 1, list(line order by i) from lines group by 1
  union all
  select label, k + 1,
         list_transform(m[2:], lambda r: list_transform(list_zip(r, m[1]), lambda z: z[1] - r[k] / m[1][k] * z[2]))
  from steps where len(m) > 1),
factors as (select label, m[1][k] as head, m[1][len(m[1]) // 2 + 1:] as w from steps),
apart as (select row_id, c.label as label, list(x - m order by i) as diff
          from cells join (select label, i, m from mean) c using (i) group by 1, 2),
scored as (select row_id, label as pred, sum(ln(head) + pow(list_dot_product(w, diff), 2) / head) as s
           from apart join factors using (label) group by 1, 2)
select row_id, label, split, pred from emb join (
  select row_id, pred, row_number() over (partition by row_id order by s, pred) as rn from scored) t using (row_id)
where rn = 1""")
def gmm_classify(spark, sf):
    return gmm.classify(train_rows(spark, sf), fx.emb(spark, sf)).select("row_id", "label", "split", "pred")


@query("kmeans_cluster")
def kmeans_cluster(spark, sf):
    rows = fx.emb(spark, sf)
    return cluster.kmeans_cluster(rows, seed=1).select("row_id", "label", "cluster")


@query("kmeans_repeats")
def kmeans_repeats(spark, sf):
    return cluster.kmeans_repeats(fx.emb(spark, sf), "pre", 4, seed=1)


@query("kmeans_wcss_curve")
def kmeans_wcss_curve(spark, sf):
    from fluxloom.operators.vae.scoring import stage_view
    from fluxloom.plans.scoring import scorer

    stages = settle(stage_view(fx.emb(spark, sf), scorer(), ("pre", "emb")), "stages")
    return cluster.wcss_curve(stages, max_k=4, n=2)


@query("kmeans_assign", f"""
with {fx.CLUSTERING},
dist as (select row_id, cast(cluster as bigint) as cluster, list_distance(v, c) as d from emb, seeds where {ONE})
select row_id, cluster, {R6('d * d')} as d2 from dist
qualify row_number() over (partition by row_id order by d, cluster) = 1""")
def kmeans_assign(spark, sf):
    centres = fx.seed_rows(spark, sf).filter(ONE).withColumn("cluster", F.col("cluster").cast("bigint"))
    return cluster.kmeans_assign(fx.emb(spark, sf), centres).select("row_id", "cluster", r6(F.col("d2")).alias("d2"))


@query("identity_clustering", f"with {fx.EMB} select row_id, label as cluster from emb")
def identity_clustering(spark, sf):
    return cluster.identity_clustering(fx.emb(spark, sf))


@query("dbscan", f"""
with recursive {fx.EMB},
near as (select a.row_id as a, b.row_id as b from emb a, emb b where list_distance(a.v, b.v) <= 1.15),
core as (select a as id from near group by 1 having count(*) >= 5),
edges as (select a, b from near where a in (select id from core) and b in (select id from core)),
reach(src, dst) as (select id, id from core union select r.src, e.b from reach r join edges e on r.dst = e.a),
roots as (select src as id, min(dst) as root from reach group by 1),
numbered as (select id, dense_rank() over (order by root) - 1 as cluster from roots),
touched as (select a as id, min(cluster) as cluster from near join numbered on b = id
            where a not in (select id from core) group by 1)
select row_id, coalesce(n.cluster, t.cluster, -1) as cluster
from emb left join numbered n on row_id = n.id left join touched t on row_id = t.id""")
def dbscan_query(spark, sf):
    return dbscan(fx.emb(spark, sf), "row_id", "v", eps=1.15, min_samples=5).select("row_id", "cluster")


# Jacobi rotations of the covariance: in a turn every column p is paired with one other, q, as in a tournament, and all
# pairs are turned at once by the angles that clear their products. Twelve tournaments clear all of them.
SWEEPS = "12 * (len(a) - 1)"
COMPONENTS = f"""{fx.EMB},
mean as (select i, avg(x) as m from cells group by 1),
centred as (select row_id, i, x - m as x from cells join mean using (i)),
cov as (select a.i as i, b.i as j, sum(a.x * b.x) as c from centred a join centred b on a.row_id = b.row_id group by 1, 2),
turns(t, a, v) as (
  select 0, list(line order by i), list(unit order by i) from (
    select i, list(c order by j) as line, list(case when i = j then 1::double else 0::double end order by j) as unit
    from cov group by 1) l
  union all
  select t + 1,
         list_transform(
           list_transform(list_zip(a, q, c, s), lambda z: list_transform(list_zip(z[1], a[z[2]]), lambda y: z[3] * y[1] + z[4] * y[2])),
           lambda r: list_transform(list_zip(r, q, c, s), lambda y: y[3] * y[1] + y[4] * r[y[2]])),
         list_transform(list_zip(v, q, c, s), lambda z: list_transform(list_zip(z[1], v[z[2]]), lambda y: z[3] * y[1] + z[4] * y[2]))
  from (
    select t, a, v, q, list_transform(tangent, lambda x: 1 / sqrt(1 + x * x)) as c,
           list_transform(list_zip(tangent, q), lambda z, p:
             case when p < z[2] then -z[1] else z[1] end / sqrt(1 + z[1] * z[1])) as s
    from (
      select t, a, v, q, list_transform(list_zip(q, tau), lambda z, p:
               case when a[least(p, z[1])][greatest(p, z[1])] = 0 then 0::double
                    else (case when z[2] >= 0 then 1 else -1 end) / (abs(z[2]) + sqrt(1 + z[2] * z[2])) end) as tangent
      from (
        select t, a, v, q, list_transform(list_zip(q, a), lambda z, p:
                 case when p < z[1] then (a[z[1]][z[1]] - z[2][p]) / (2 * z[2][z[1]])
                      else (z[2][p] - a[z[1]][z[1]]) / (2 * a[z[1]][p]) end) as tau
        from (
          select t, a, v, list_transform(range(0, len(a)), lambda p:
                   case when p = len(a) - 1 then t % (len(a) - 1) when p = t % (len(a) - 1) then len(a) - 1
                        else (2 * (t % (len(a) - 1)) - p + len(a) - 1) % (len(a) - 1) end + 1) as q
          from turns where t < {SWEEPS}) paired) angled) slopes) rotations),
axes as (select generate_subscripts(v, 1) as i, unnest(v) as axis, a from turns where t = {SWEEPS}),
parts as (
  select a[i][i] / sum(a[i][i]) over () as ratio, row_number() over (order by a[i][i] desc) - 1 as component,
         case when list_max(axis) >= -list_min(axis) then axis else list_transform(axis, lambda x: -x) end as axis
  from axes)"""


@query("pca_transform", f"""
with recursive {COMPONENTS},
moved as (select row_id, list(x order by i) as x from centred group by 1)
select row_id, component, {R6('list_dot_product(x, axis)')} as value
from moved, parts where component < (select count(*) from emb)""")
def pca_transform(spark, sf):
    rows = fx.emb(spark, sf)
    moved = cluster.Components(rows).transform(rows).select("row_id", F.posexplode_outer("pca").alias("component", "value"))
    return moved.select("row_id", F.col("component").cast("bigint").alias("component"), r6(F.col("value")).alias("value"))


@query("pca_scree", f"""
with recursive {COMPONENTS}
select component, {R6('ratio')} as ratio,
       {R6('coalesce(sum(ratio) over (order by component rows between unbounded preceding and 1 preceding), 0)')} as cumulative
from parts where component < (select count(*) from emb)""")
def pca_scree(spark, sf):
    found = cluster.Components(fx.emb(spark, sf)).scree(spark)
    return found.select("component", r6(F.col("ratio")).alias("ratio"), r6(F.col("cumulative")).alias("cumulative"))


# --- comparing clusterings ------------------------------------------------------------------------

ALL_SETS = f"""{fx.CLUSTERING},
sets as (select set_name, rep, row_id, cluster from clustering
         union all select 'label', 0, row_id, label from emb)"""

ARI = f"""{ALL_SETS},
cells_ab as (
  select a.set_name as set_a, a.rep as rep_a, b.set_name as set_b, b.rep as rep_b, a.cluster as a, b.cluster as b,
         cast(count(*) as double) as n
  from sets a join sets b using (row_id) group by 1, 2, 3, 4, 5, 6),
s_cells as (select set_a, rep_a, set_b, rep_b, sum(n * (n - 1) / 2) as s, sum(n) as total from cells_ab group by 1, 2, 3, 4),
s_rows as (select set_a, rep_a, set_b, rep_b, sum(n * (n - 1) / 2) as s from (
  select set_a, rep_a, set_b, rep_b, a, sum(n) as n from cells_ab group by 1, 2, 3, 4, 5) t group by 1, 2, 3, 4),
s_cols as (select set_a, rep_a, set_b, rep_b, sum(n * (n - 1) / 2) as s from (
  select set_a, rep_a, set_b, rep_b, b, sum(n) as n from cells_ab group by 1, 2, 3, 4, 5) t group by 1, 2, 3, 4),
parts as (select c.set_a, c.rep_a, c.set_b, c.rep_b, c.s as cells, r.s as rows, k.s as cols,
                 r.s * k.s / (total * (total - 1) / 2) as expected
          from s_cells c join s_rows r using (set_a, rep_a, set_b, rep_b)
          join s_cols k using (set_a, rep_a, set_b, rep_b)),
ari as (select set_a, rep_a, set_b, rep_b,
               case when (rows + cols) / 2 = expected then 1
                    else (cells - expected) / ((rows + cols) / 2 - expected) end as score from parts)"""


def all_sets(spark, sf):
    """The sixteen clusterings and the true labels as one more set."""
    truth = fx.emb(spark, sf).select(F.lit("label").alias("set_name"), F.lit(0).cast("bigint").alias("rep"), "row_id",
                                     F.col("label").alias("cluster"))
    return fx.clustering(spark, sf).drop("seed_label").unionByName(truth)


@query("ari", f"""
with {ARI}
select set_a, rep_a, set_b, rep_b, {R6('score')} as score from ari
where set_a < set_b or (set_a = set_b and rep_a <= rep_b)""")
def ari(spark, sf):
    return metrics.ari(settle(all_sets(spark, sf), "sets")).withColumn("score", r6(F.col("score")))


def sql_draw(side: str) -> str:
    key = f"md5('11|' || a.set_name || '|' || b.set_name || '|' || cast(d as varchar) || '|{side}')"
    return f"cast('0x' || substr({key}, 1, 8) as bigint) % {side}.n"


@query("bootstrap_ari", f"""
with {ARI},
reps as (select set_name, count(distinct rep) as n from sets group by 1),
draws as (select a.set_name as set_a, b.set_name as set_b, {sql_draw('a')} as rep_a, {sql_draw('b')} as rep_b
          from reps a, reps b, generate_series(0, 127) t(d))
select set_a, set_b, {R6('avg(score)')} as mean, {R6('stddev_pop(score)')} as std
from draws join ari using (set_a, rep_a, set_b, rep_b) group by 1, 2""")
def bootstrap_ari(spark, sf):
    scores = metrics.bootstrap_ari(settle(all_sets(spark, sf), "sets"), 128, seed=11)
    return scores.select("set_a", "set_b", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


@query("score_matrix", f"""
with {ARI}
select set_a, set_b, {R6('avg(score)')} as mean, {R6('stddev_pop(score)')} as std from ari group by 1, 2""")
def score_matrix(spark, sf):
    scores = metrics.score_matrix(settle(all_sets(spark, sf), "sets"))
    return scores.select("set_a", "set_b", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))
