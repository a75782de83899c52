"""Metabolic models as SBML files, ``<folder>/<model>.xml``, read by Spark's XML source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxloom.functions.text import decimal_text, metabolite_name, reaction_name

# One child and many children have the same type only under a stated schema.
REFERENCE_LIST = "array<struct<_species: string, _stoichiometry: double>>"
REFERENCES = f"struct<speciesReference: {REFERENCE_LIST}>"
REACTION = f"_id string, listOfReactants {REFERENCES}, listOfProducts {REFERENCES}"
SPECIES = "_id string, _name string, _compartment string, `_fbc:charge` bigint, `_fbc:chemicalFormula` string"


def model_of_path():
    return F.regexp_extract(F.url_decode("_metadata.file_path"), r"([^/=]+)\.xml(/.*)?$", 1)


def read_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    rows = spark.read.format("xml").option("rowTag", tag).option("recursiveFileLookup", True).schema(schema)
    return rows.load(f"{path.rstrip('/')}/*.xml").withColumn("model", model_of_path())


def read_species(spark: SparkSession, path: str) -> DataFrame:
    """Metabolites of every model with their canonical names."""
    return read_rows(spark, path, "species", SPECIES).select(
        "model", F.col("_id").alias("metabolite"),
        metabolite_name(F.col("_name"), F.col("`_fbc:chemicalFormula`"), F.col("`_fbc:charge`"),
                        F.col("_compartment")).alias("metabolite_name"))


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """Coefficients (model, reaction_id, metabolite, stoich); reactants count as negative."""
    raw = read_rows(spark, path, "reaction", REACTION)

    def side(column: str, sign: float):
        refs = F.coalesce(F.col(f"{column}.speciesReference"), F.array().cast(REFERENCE_LIST))
        return F.transform(refs, lambda r: F.struct(
            r["_species"].alias("metabolite"), (F.coalesce(r["_stoichiometry"], F.lit(1.0)) * sign).alias("stoich")))

    both = F.concat(side("listOfReactants", -1.0), side("listOfProducts", 1.0))
    return (
        raw.select("model", F.col("_id").alias("reaction_id"), F.explode(both).alias("r"))
        .groupBy("model", "reaction_id", "r.metabolite").agg(F.sum("r.stoich").alias("stoich"))
    )


def read_reactions(spark: SparkSession, path: str) -> DataFrame:
    """Ids of all reactions of every model (model, reaction_id), those without metabolites too."""
    return read_rows(spark, path, "reaction", "_id string").select("model", F.col("_id").alias("reaction_id")).distinct()


def canonical_names(coefficients: DataFrame, species: DataFrame, reactions: DataFrame | None = None) -> DataFrame:
    """Reaction id -> canonical name, per model.

    A metabolite that the model does not list is an error. With the list of reactions, one without metabolites
    gets the name of an empty list.
    """
    listed = species.select("model", "metabolite", "metabolite_name", F.lit(True).alias("known"))
    unknown = F.raise_error(F.concat(F.lit("unknown species "), F.col("metabolite"), F.lit(" in model "), F.col("model")))
    name = F.when(F.col("known"), F.col("metabolite_name")).otherwise(unknown)
    part = F.concat(name, F.lit("s["), decimal_text(F.col("stoich")), F.lit("]"))
    named = (
        coefficients.join(listed, ["model", "metabolite"], "left").groupBy("model", "reaction_id")
        .agg(reaction_name(F.collect_list(part)).alias("reaction"))
    )
    if reactions is None:
        return named
    empty = reaction_name(F.array().cast("array<string>"))
    return reactions.join(named, ["model", "reaction_id"], "left").withColumn("reaction", F.coalesce("reaction", empty))


def write(coefficients: DataFrame, species: DataFrame, path: str, parts: int = 1) -> None:
    """Write models as SBML: ``<path>/model=<name>.xml/part=<k>/``, each part a whole document."""

    def escaped(c):
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
            c = F.replace(c, F.lit(plain), F.lit(entity))
        return c

    def attribute(name, column):
        return F.concat(F.lit(f' {name}="'), escaped(F.col(column).cast("string")), F.lit('"'))

    def refs(tag, keep):
        chosen = F.filter("m", keep)
        body = F.concat_ws("", F.transform(chosen, lambda r: F.concat(
            F.lit('<speciesReference species="'), escaped(r["metabolite"]), F.lit('" stoichiometry="'),
            F.abs(r["stoich"]).cast("string"), F.lit('"/>'))))
        return F.when(F.size(chosen) > 0, F.concat(F.lit(f"<{tag}>"), body, F.lit(f"</{tag}>"))).otherwise(F.lit(""))

    part = F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")
    reactions = coefficients.groupBy("model", F.col("reaction_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("metabolite", "stoich"))).alias("m"))
    reactions = reactions.select("model", part, F.lit(4).alias("at"), F.concat(
        F.lit("<reaction"), attribute("id", "id"), F.lit(">"),
        refs("listOfReactants", lambda r: r["stoich"] < 0), refs("listOfProducts", lambda r: r["stoich"] >= 0),
        F.lit("</reaction>")).alias("value"))
    listed = species.withColumn("id", F.col("metabolite")).select("model", part, F.lit(2).alias("at"), F.concat(
        F.lit("<species"), attribute("id", "id"), attribute("name", "name"), attribute("compartment", "compartment"),
        attribute("fbc:charge", "charge"), attribute("fbc:chemicalFormula", "formula"), F.lit("/>")).alias("value"))
    rows = reactions.unionByName(listed)
    frame = F.array(*[F.struct(F.lit(at).alias("at"), F.lit(text).alias("value")) for at, text in (
        (1, '<sbml xmlns:fbc="http://www.sbml.org/sbml/level3/version1/fbc/version2"><model><listOfSpecies>'),
        (3, "</listOfSpecies><listOfReactions>"), (5, "</listOfReactions></model></sbml>"))])
    tags = rows.select("model", "part").distinct().select("model", "part", F.explode(frame).alias("f")).select(
        "model", "part", "f.at", "f.value")
    (
        rows.unionByName(tags).withColumn("model", F.concat("model", F.lit(".xml")))
        .repartition("model", "part").sortWithinPartitions("model", "part", "at")
        .select("model", "part", "value").write.partitionBy("model", "part").text(path)
    )
