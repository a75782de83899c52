"""Stoichiometry as coordinate tables, and mass balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.operators.harmonise import ROW_KEY


def stoich_matrix(entries: DataFrame) -> DataFrame:
    """One coefficient per (metabolite, reaction); of differing statements the last model's stays."""
    return entries.groupBy("metabolite", "reaction").agg(F.max_by("stoich", "model_n").alias("stoich"))


def for_reactions(stoich: DataFrame, reactions: DataFrame) -> DataFrame:
    """Coefficients of the reactions that the data has."""
    return stoich.join(reactions.select("reaction").distinct(), "reaction", "left_semi")


def mass_balance(flux: DataFrame, stoich: DataFrame) -> DataFrame:
    """Net production of every metabolite in every sample: the non-zero part of ``S v``.

    Cells and coefficients of 0 add nothing and are dropped before the join. No broadcast hint: the
    coefficient table is broadcast while its measured size allows and shuffled (with skew splits) beyond.
    """
    cells = flux.filter(F.col("flux") != 0).select(*ROW_KEY, "reaction", "flux")
    return (
        cells.join(stoich.filter(F.col("stoich") != 0), "reaction")
        .groupBy(*ROW_KEY, "metabolite")
        .agg(F.sum(F.col("flux") * F.col("stoich")).alias("net"))
    )


def reaction_consistency(coefficients: DataFrame) -> DataFrame:
    """Reaction ids whose coefficient map differs between models."""
    maps = coefficients.groupBy("model", "reaction_id").agg(
        F.sort_array(F.collect_list(F.struct("metabolite", "stoich"))).alias("parts"))
    return (
        maps.groupBy("reaction_id")
        .agg(F.count_distinct("parts").alias("n_forms"), F.count(F.lit(1)).alias("n_models"))
        .filter(F.col("n_forms") > 1)
    )
