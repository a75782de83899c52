"""Queries: the variational autoencoder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from fluxloom.operators.vae import model as store
from fluxloom.operators.vae.fit import fit
from fluxloom.operators.vae.model import Vae
from fluxloom.operators.vae.network import Layer, layer_sizes
from fluxloom.operators.vae.scoring import (Scorer, SparseRows, cross_model_loss, dataset_loss, row_key, stage_view)
from fluxloom.plans import fixtures as fx
from fluxloom.plans.register import R6, query, r6
from fluxloom.session import scratch_path

N_IN, N_EMB, N_LAY, SLOPE = 64, 4, 3, 0.01
NAMES = [f"d{i}" for i in range(N_IN)]


def model(shift: int = 0) -> Vae:
    """A fixed model whose weights follow a formula, so that SQL can hold the same one."""
    def layers(n_in, n_out, first):
        sizes = layer_sizes(n_in, n_out, N_LAY)
        made = []
        for at, (a, b) in enumerate(zip(sizes, sizes[1:])):
            i, j, number = np.arange(b)[:, None], np.arange(a)[None, :], first + at + shift
            made.append(Layer(((7 * i + 13 * j + 3 * number) % 11 - 5) / (10 * np.sqrt(a)),
                              ((3 * np.arange(b) + number) % 5 - 2) / 50.0))
        return made

    return Vae(N_IN, N_EMB, N_LAY, SLOPE, reaction_names=NAMES, encoder=layers(N_IN, 2 * N_EMB, 0),
               decoder=layers(N_EMB, N_IN, N_LAY - 1))


def scorer(shift: int = 0, **how) -> Scorer:
    return Scorer(model(shift), NAMES, **how)


def sql_layer(source: str, n_in: int, n_out: int, number: int, hidden: bool) -> str:
    """One layer over (row_id, i, x) with 0-based i."""
    total = (f"sum(((7 * o + 13 * i + {3 * number}) % 11 - 5) / (10 * sqrt({n_in}::double)) * x)"
             f" + ((3 * o + {number}) % 5 - 2) / 50.0::double")
    x = f"case when {total} > 0 then {total} else {SLOPE}::double * ({total}) end" if hidden else total
    return f"select row_id, o as i, {x} as x from {source}, generate_series(0, {n_out - 1}) t(o) group by row_id, o"


def sql_model(shift: int = 0, sample: bool = False) -> str:
    """CTEs of the model: latent mean and spread, z, reconstruction."""
    e, d = layer_sizes(N_IN, 2 * N_EMB, N_LAY), layer_sizes(N_EMB, N_IN, N_LAY)
    m = f"m{shift}"
    z = "mu + exp(0.5 * lv)" if sample else "mu"  # a sampled row with unit noise
    return f"""{m}_in as (select row_id, i - 1 as i, x from cells),
{m}_h as ({sql_layer(f'{m}_in', e[0], e[1], shift, True)}),
{m}_y as ({sql_layer(f'{m}_h', e[1], e[2], 1 + shift, False)}),
{m}_latent as (select a.row_id, a.i, a.x as mu, b.x as lv from {m}_y a join {m}_y b
               on a.row_id = b.row_id and b.i = a.i + {N_EMB} where a.i < {N_EMB}),
{m}_z as (select row_id, i, {z} as x from {m}_latent),
{m}_g as ({sql_layer(f'{m}_z', d[0], d[1], 2 + shift, True)}),
{m}_out as ({sql_layer(f'{m}_g', d[1], d[2], 3 + shift, False)}),
{m}_rec as (select row_id, sum((a.x - b.x) * (a.x - b.x)) as rec from {m}_in a join {m}_out b using (row_id, i) group by 1),
{m}_div as (select row_id, 0.5 * sum(exp(lv) + mu * mu - lv - 1) as div from {m}_latent group by 1)"""


def exploded(df, column, out="x"):
    return df.select("row_id", F.posexplode_outer(column).alias("i", out)).select(
        "row_id", F.col("i").cast("bigint").alias("i"), r6(F.col(out)).alias(out))


def key():
    return row_key(0, "row_id")


@query("vae_encode", f"""
with {fx.EMB}, {sql_model()}
select row_id, i, {R6('mu')} as mu, {R6('mu + exp(0.5 * lv)')} as sampled from m0_latent""")
def vae_encode(spark, sf):
    rows = fx.emb(spark, sf)
    # Unit noise makes the sampled form repeatable in SQL; the default noise is normal, by row key.
    both = F.arrays_zip(scorer().encode("v", key()).alias("mu"),
                        scorer(sample=True, eps="ones").encode("v", key()).alias("sampled"))
    return rows.select("row_id", F.posexplode_outer(both).alias("i", "z")).select(
        "row_id", F.col("i").cast("bigint").alias("i"), r6(F.col("z.mu")).alias("mu"),
        r6(F.col("z.sampled")).alias("sampled"))


@query("vae_decode", f"""
with {fx.EMB}, {sql_model()} select row_id, i, {R6('x')} as x from m0_out""")
def vae_decode(spark, sf):
    s = scorer()
    coded = fx.emb(spark, sf).withColumn("z", s.encode("v", key()))
    return exploded(coded.withColumn("r", s.decode("z", "v")), "r")


@query("stage_view", f"""
with {fx.EMB}, {sql_model()},
stages as (select 'pre' as stage, * from m0_in union all select 'emb', * from m0_z union all select 'rec', * from m0_out)
select row_id, label, stage, s.i as i, {R6('s.x')} as x from stages s join emb using (row_id) where split = 'test'""")
def stage_view_query(spark, sf):
    view = stage_view(fx.emb(spark, sf), scorer(), restrictions={"split": "test"}, keys=["row_id", "label"])
    return view.select("row_id", "label", "stage", F.posexplode_outer("v").alias("i", "x")).select(
        "row_id", "label", "stage", F.col("i").cast("bigint").alias("i"), r6(F.col("x")).alias("x"))


BETA_S = 0.01
COEFFICIENTS = """coef as (
  select p_size % 8 as metabolite, p_partkey % 64 as i, sum(p_partkey % 5 - 2) as stoich from part group by 1, 2)"""


def coefficients(spark, sf):
    return fx.table(spark, sf, "part").groupBy(
        (F.col("p_size") % 8).cast("string").alias("metabolite"),
        F.concat(F.lit("d"), (F.col("p_partkey") % 64).cast("string")).alias("reaction"),
    ).agg(F.sum(F.col("p_partkey") % 5 - 2).cast("double").alias("stoich"))


LOSS_SQL = f"""{fx.EMB}, {sql_model(sample=True)}, {COEFFICIENTS},
net as (select row_id, metabolite, sum(x * stoich) as net from m0_out join coef using (i) group by 1, 2),
s as (select row_id, {BETA_S}::double * sum(net * net) as s from net group by 1),
losses as (select row_id, rec + div + s as loss, rec as reconstruction_loss, div as divergence_loss,
                  s as stoicheometry_loss
           from m0_rec join m0_div using (row_id) join s using (row_id))"""


def row_losses(spark, sf):
    s = scorer(eps="ones", coefficients=SparseRows.collect(coefficients(spark, sf), NAMES), beta_s=BETA_S)
    return fx.emb(spark, sf).withColumn("l", s.row_losses("v", key())).select("row_id", "label", "split", "l.*")


PARTS = ["loss", "reconstruction_loss", "divergence_loss", "stoicheometry_loss"]


@query("vae_row_losses", f"""
with {LOSS_SQL} select row_id, {', '.join(f"{R6(c)} as {c}" for c in PARTS)} from losses""")
def vae_row_losses(spark, sf):
    return row_losses(spark, sf).select("row_id", *[r6(F.col(c)).alias(c) for c in PARTS])


@query("vae_dataset_loss", f"""
with {LOSS_SQL}
select split, {R6('avg(loss - stoicheometry_loss)')} as loss,
       {', '.join(f"{R6(f'avg({c})')} as {c}" for c in PARTS[1:])}
from losses join emb using (row_id) group by 1""")
def vae_dataset_loss(spark, sf):
    return dataset_loss(row_losses(spark, sf), ["split"]).select("split", *[r6(F.col(c)).alias(c) for c in PARTS])


@query("cross_model_loss", f"""
with {fx.EMB}, {', '.join(sql_model(k, sample=True) for k in range(3))},
scored as ({' union all '.join(f"select 'm{k}' as model, row_id, rec, div from m{k}_rec join m{k}_div using (row_id)"
                               for k in range(3))})
select model, label, {R6('avg(rec + div)')} as loss, {R6('avg(rec)')} as reconstruction_loss,
       {R6('avg(div)')} as divergence_loss
from scored join emb using (row_id) group by 1, 2""")
def cross_model_loss_query(spark, sf):
    scorers = {f"m{k}": scorer(k, eps="ones") for k in range(3)}
    found = cross_model_loss(fx.emb(spark, sf), scorers, "label")
    return found.select("model", "label", *[r6(F.col(c)).alias(c) for c in PARTS[:3]])


@query("save_load_model", f"""
with {fx.EMB}, {sql_model(2)} select row_id, i, {R6('mu')} as mu from m2_latent""")
def save_load_model(spark, sf):
    """Three versions are stored; the one of the greatest epoch comes back, by number and not by name."""
    folder = scratch_path(spark, "model")
    for shift, epoch in ((0, 2), (2, 10), (1, 9)):
        store.save(spark, model(shift), folder, epoch)
    store.save(spark, model(1), folder, 9, test_min=True)
    loaded = Scorer(store.load(spark, folder), NAMES)
    return exploded(fx.emb(spark, sf).withColumn("z", loaded.encode("v", key())), "z", "mu")


@query("vae_fit")
def vae_fit(spark, sf):
    rows = fx.emb(spark, sf)
    vae = Vae(N_IN, N_EMB, N_LAY, SLOPE, reaction_names=NAMES, seed=1)
    _, log = fit(rows.filter("split = 'train'"), vae, epochs=2, batch_size=256, lr=1e-3, seed=1, keys=["row_id"],
                 test=rows.filter("split = 'test'"))
    return log
