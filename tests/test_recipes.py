"""From a folder of files and models to each kind of result."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxloom import recipes
from fluxloom.functions import text
from fluxloom.operators import stoich
from fluxloom.operators.vae import model as store
from fluxloom.sources import flux_csv

SBML = """<sbml xmlns:fbc="http://www.sbml.org/sbml/level3/version1/fbc/version2"><model><listOfSpecies>
<species id="A" name="a" compartment="c" fbc:charge="0" fbc:chemicalFormula="X"/>
<species id="B" name="b" compartment="c" fbc:charge="0" fbc:chemicalFormula="Y"/></listOfSpecies><listOfReactions>
<reaction id="{p}1"><listOfProducts><speciesReference species="A" stoichiometry="1"/></listOfProducts></reaction>
<reaction id="{p}2"><listOfReactants><speciesReference species="A" stoichiometry="1"/></listOfReactants>
<listOfProducts><speciesReference species="B" stoichiometry="1"/></listOfProducts></reaction>
<reaction id="{p}3"><listOfReactants><speciesReference species="B" stoichiometry="1"/></listOfReactants></reaction>
</listOfReactions></model></sbml>"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two models name the same three reactions differently; flux through the chain is balanced."""
    root = tmp_path_factory.mktemp("samples")
    (root / "gems").mkdir()
    rng = np.random.default_rng(0)
    for name, p, level in (("liver", "L", 2.0), ("muscle", "M", 9.0)):
        (root / "gems" / f"{name}.xml").write_text(SBML.format(p=p))
        lines = [f",{p}1,{p}2,{p}3,{name}_only"]
        for i in range(30):
            x = level + rng.normal() * 0.2
            lines.append(f"{i},{x!r},{x!r},{x!r},{rng.normal()!r}")
        (root / f"{name}_100.csv").write_text("\n".join(lines) + "\n")
    return root


@pytest.fixture(scope="module")
def data(spark, folder):
    return recipes.load(spark, str(folder), str(folder / "gems"))


def test_names_agree_across_models_and_balance_holds(data):
    assert len(data.reactions("inner")) == 3 and len(data.reactions("outer")) == 5
    assert all(abs(r.net) < 1e-9 for r in stoich.mass_balance(data.flux, data.stoich).collect())
    assert data.coefficients().times(np.array([[0.0] * 5])).shape == (1, 2)


def test_without_models_names_stay(spark, folder):
    plain = recipes.load(spark, str(folder))
    assert plain.reactions("inner") == [] and "L1" in plain.reactions("outer")
    assert recipes.load(spark, str(folder), str(folder / "none")).reactions("outer") == plain.reactions("outer")


def test_same_seed_same_rows(data):
    one, two, other = (sorted((r.file_name, r.sample_n) for r in data.sample(20, s).collect()) for s in (1, 1, 2))
    assert one == two != other and len(one) == 20


def test_train_then_score(spark, data, tmp_path):
    vae, log = recipes.train(data, str(tmp_path), epochs=2, batch_size=16, n_emb=2, n_lay=3, lr=0.01, n=60, test=data,
                             test_size=20, beta_s=0.1, lrelu_slope=0.01)
    assert log.count() == 2 * 4 and store.versions(spark, str(tmp_path)) == ["0", "1", "testmin"]
    assert spark.read.parquet(f"{tmp_path}/losses").count() == 8
    loaded = store.load(spark, str(tmp_path))
    emb = recipes.process(data, loaded, "emb", n=40, add_losses=True, beta_s=0.1)
    row = emb.first()
    assert len(row.v) == 2 and row.loss == pytest.approx(
        row.reconstruction_loss + row.divergence_loss + row.stoicheometry_loss)
    assert recipes.process(data, loaded, "rec", n=40, join="outer").select(F.size("v")).distinct().collect()[0][0] == 5
    assert recipes.process(data, None, "pre", n=40, prep="pca", restrictions={"label": "liver"}).count() == 15  # 30 rows in two chunks
    matrix = recipes.nearest_centroid_score(data, data, loaded, "pre", rows=40).orderBy("label").collect()
    assert [(r.liver, r.muscle) for r in matrix] == [(1.0, 0.0), (0.0, 1.0)]
    matrix = recipes.gmm_score(data, data, None, "pre", rows=40).orderBy("label").collect()
    assert [(r.liver, r.muscle) for r in matrix] == [(1.0, 0.0), (0.0, 1.0)]


def test_ari_and_elbow(data):
    scores = {(r.set_a, r.set_b): r.mean for r in
              recipes.ari_score(data, stages=("pre",), n=2, bootstrap_n=8, rows=40).collect()}
    assert scores[("pre", "label")] == pytest.approx(1.0)
    curve = recipes.wcss_score(data, stages=("pre",), n=2, rows=40).orderBy("k").collect()
    assert [r.k for r in curve] == [1, 2] and curve[1].wcss < curve[0].wcss


def test_several_datasets(spark, folder):
    both = flux_csv.read_datasets(spark, {"a": str(folder), "b": str(folder / "liver_100.csv")})
    counts = {r.dataset: r["count"] for r in both.groupBy("dataset").count().collect()}
    assert counts == {"a": 2 * 30 * 4, "b": 30 * 4}


def test_other_name_forms(spark):
    df = spark.createDataFrame([("liver cells_10k.csv",)], "f string")
    assert df.select(text.leading_label(F.col("f")).alias("l")).first().l == "liver cells"
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.lit("c").alias("compartment"), F.lit(s).alias("stoich"))
                      for n, s in (("b, x", "1.0"), ("a", "-2.0"))])
    assert df.select(text.short_reaction_name(parts).alias("r")).first().r == "a(c)[-2.0]b. x(c)[1.0]"
