"""The given tables, seen as the library's inputs. Each view has a Spark form and the same rows in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fluxloom.operators.ranking import rank_in_buckets
from fluxloom.session import settle


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


# --- flux samples -------------------------------------------------------------------------------

FLUX = """flux as (
  select 'model' || cast(s_nationkey as varchar) || '_100' as file_name,
         'model' || cast(s_nationkey as varchar) as label,
         l_orderkey % 200 as sample_n,
         p_brand || '/' || p_type as reaction,
         sum(case when l_returnflag = 'R' then -l_quantity else l_quantity end) as flux
  from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey
  group by 1, 2, 3, 4)"""


def flux(spark: SparkSession, sf: str) -> DataFrame:
    """One row per cell of the sample tables: a file per nation, a reaction per brand and type."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_returnflag", "l_quantity")
    suppliers = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    parts = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("reaction"))
    flux = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    # Keys are short numbers until the sums are done; the names of file and model follow from the nation.
    cells = (
        lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy("s_nationkey", (F.col("l_orderkey") % 200).alias("sample_n"), "reaction")
        .agg(F.sum(flux).alias("flux"))
    )
    name = F.concat(F.lit("model"), F.col("s_nationkey").cast("string"))
    return cells.select(F.concat(name, F.lit("_100")).alias("file_name"), name.alias("label"), "sample_n", "reaction",
                        "flux")


def flux_table(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows, written once: for queries that read them more than once."""
    return settle(flux(spark, sf), "flux")


# --- models ---------------------------------------------------------------------------------------

MODEL_STOICH = """model_stoich as (
  select 'model' || cast(p_partkey % 4 as varchar) as model, p_name as reaction_id,
         'm' || cast(p_size as varchar) as metabolite, cast(sum(p_partkey % 5 - 2) as double) as stoich
  from part group by 1, 2, 3 having sum(p_partkey % 5 - 2) <> 0)"""


def model_stoich(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients per (model, reaction id, metabolite)."""
    return (
        table(spark, sf, "part")
        .groupBy(
            F.concat(F.lit("model"), (F.col("p_partkey") % 4).cast("string")).alias("model"),
            F.col("p_name").alias("reaction_id"),
            F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("metabolite"),
        )
        .agg(F.sum(F.col("p_partkey") % 5 - 2).cast("double").alias("stoich"))
        .filter(F.col("stoich") != 0)
    )


STOICH_LAST = """stoich as (
  select metabolite, reaction, stoich from (
    select 'm' || cast(p_size as varchar) as metabolite, p_brand || '/' || p_type as reaction,
           cast(p_partkey % 5 - 2 as double) as stoich,
           row_number() over (partition by p_size, p_brand, p_type order by p_partkey desc) as rn
    from part) t
  where rn = 1)"""


def stoich_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Every stated coefficient, with the order in which models state them."""
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("model_n"),
        F.concat(F.lit("m"), F.col("p_size").cast("string")).alias("metabolite"),
        F.concat_ws("/", "p_brand", "p_type").alias("reaction"),
        (F.col("p_partkey") % 5 - 2).cast("double").alias("stoich"),
    )


# --- training logs --------------------------------------------------------------------------------

LOSS_LOG = """loss_log as (
  select run, cast(eval_n as bigint) as eval_n, cast(least(floor(eval_n / 32), 31) as bigint) as epoch,
         value as loss, value * 0.75 as reconstruction_loss, value * 0.25 as divergence_loss,
         cast(0 as double) as stoicheometry_loss,
         value + event_id % 7 as test_loss,
         (value + event_id % 7) * 0.75 as test_reconstruction_loss,
         (value + event_id % 7) * 0.25 as test_divergence_loss,
         cast(0 as double) as test_stoicheometry_loss
  from (select user_id % 10 as run, event_id, value,
               row_number() over (partition by user_id % 10 order by ts, event_id) - 1 as eval_n
        from events) t)"""


def loss_log(spark: SparkSession, sf: str) -> DataFrame:
    """Ten training runs; the evaluations of a run are its events in time order."""
    events = table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("run"), "event_id", "ts", F.col("value"),
    )
    ranked = rank_in_buckets(events, ["run"], F.date_trunc("day", "ts"), ["ts", "event_id"], "eval_n")
    eval_n = F.col("eval_n") - 1
    test = F.col("value") + F.col("event_id") % 7
    return ranked.select(
        "run",
        eval_n.alias("eval_n"),
        F.least(F.floor(eval_n / 32), F.lit(31)).cast("bigint").alias("epoch"),
        F.col("value").alias("loss"),
        (F.col("value") * 0.75).alias("reconstruction_loss"),
        (F.col("value") * 0.25).alias("divergence_loss"),
        F.lit(0.0).alias("stoicheometry_loss"),
        test.alias("test_loss"),
        (test * 0.75).alias("test_reconstruction_loss"),
        (test * 0.25).alias("test_divergence_loss"),
        F.lit(0.0).alias("test_stoicheometry_loss"),
    )


RUN_ARGS = """run_args as (
  select distinct run, cast(0.0001 * (1 + run % 3) as double) as lr, cast(power(2, 3 + run % 4) as bigint) as n_emb,
         cast(2 + run % 5 as bigint) as n_lay, cast(64 * (1 + run % 2) as bigint) as batch_size
  from (select user_id % 10 as run from events) t)"""


def run_args(spark: SparkSession, sf: str) -> DataFrame:
    """Arguments of each run."""
    run = F.col("run")
    return (
        table(spark, sf, "events").select((F.col("user_id") % 10).alias("run")).distinct()
        .select(
            "run",
            ((1 + run % 3) / F.lit(10000.0)).alias("lr"),
            F.pow(F.lit(2), 3 + run % 4).cast("bigint").alias("n_emb"),
            (2 + run % 5).cast("bigint").alias("n_lay"),
            (64 * (1 + run % 2)).cast("bigint").alias("batch_size"),
        )
    )


# --- embedded samples -----------------------------------------------------------------------------

EMB = """emb as (
  select vec_id as row_id, cast(label as varchar) as label, cast(embedding as double[]) as v,
         case when substr(md5('split|' || cast(vec_id as varchar)), 1, 1) < 'c' then 'train' else 'test' end as split
  from embeddings),
cells as (
  select row_id, label, split, generate_subscripts(v, 1) as i, unnest(v) as x from emb)"""


def emb(spark: SparkSession, sf: str) -> DataFrame:
    """One dense vector per sample; a quarter of the rows, by draw, is the test split."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"),
        F.when(F.substring(F.md5(F.concat_ws("|", F.lit("split"), F.col("vec_id"))), 1, 1) < "c", "train")
        .otherwise("test").alias("split"),
    )


N_SEEDS = 10
SETS = ("c0", "c1", "c2", "c3")
REPS = 4

# Seeds of a clustering are its least draws; a row joins its nearest seed (least seed number on ties).
CLUSTERING = EMB + """,
tries as (select 'c' || cast(s as varchar) as set_name, r as rep
          from generate_series(0, 3) a(s), generate_series(0, 3) b(r)),
seeds as (
  select set_name, rep, rank - 1 as cluster, row_id as seed_id, label as seed_label, v as c from (
    select set_name, rep, row_id, label, v,
           row_number() over (partition by set_name, rep
             order by md5(set_name || '|' || cast(rep as varchar) || '|' || cast(row_id as varchar))) as rank
    from emb, tries) t
  where rank <= 10),
near as (
  select set_name, rep, row_id, cluster, seed_label,
         row_number() over (partition by set_name, rep, row_id order by list_distance(v, c), cluster) as rn
  from emb, seeds),
clustering as (
  select set_name, cast(rep as bigint) as rep, row_id, cast(cluster as varchar) as cluster, seed_label
  from near where rn = 1)"""


def seed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The seed rows of every clustering: set, repeat, cluster number, vector."""
    tries = F.explode(F.array(*[F.struct(F.lit(s).alias("set_name"), F.lit(r).alias("rep"))
                                for s in SETS for r in range(REPS)]))
    drawn = emb(spark, sf).select("row_id", "label", "v", tries.alias("t")).select(
        "t.*", "row_id", "label", "v", F.md5(F.concat_ws("|", "t.set_name", "t.rep", "row_id")).alias("draw"))
    # row_number() <= k: Spark keeps k rows per group and task before the shuffle.
    by_draw = Window.partitionBy("set_name", "rep").orderBy("draw")
    return (
        drawn.withColumn("rank", F.row_number().over(by_draw)).filter(F.col("rank") <= N_SEEDS)
        .select("set_name", "rep", (F.col("rank") - 1).alias("cluster"), F.col("row_id").alias("seed_id"),
                F.col("label").alias("seed_label"), F.col("v").alias("c"))
    )


def clustering(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen clusterings of the rows (four sets of four), long: set, repeat, row, cluster, seed label."""
    from fluxloom.operators.distance import Centres, nearest_of_each

    seeds = seed_rows(spark, sf).withColumn("id", F.struct("set_name", "rep"))
    models = Centres.collect_many(seeds, ["set_name", "rep"], "cluster", "c", extra="seed_label")
    return nearest_of_each(emb(spark, sf).select("row_id", "v"), "v", models)
