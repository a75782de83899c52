"""Histograms of every reaction by label, zeros of absent cells included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.operators.harmonise import ROW_KEY
from fluxloom.session import settle


def histogram(flux: DataFrame, bins: int = 40) -> DataFrame:
    """Rows per (reaction, label, bin); all labels of a reaction share its range, all-zero reactions have none.

    The table is never made dense. Present cells are binned and counted; the absent ones of a label all
    fall in the bin of 0, and their number is its sample count less its cells.
    """
    # Three passes over the cells: samples of labels, cells of (reaction, label), and at last the bins.
    samples = flux.select("label", *ROW_KEY).distinct()
    per_label = settle(samples.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows")), "labels")
    # One small row: the labels with their sample counts, and the count of all.
    known = per_label.agg(F.struct(
        F.collect_list(F.struct("label", "n_rows")).alias("labels"), F.sum("n_rows").alias("n_all"))).scalar()
    cells = settle(flux.groupBy("reaction", "label").agg(
        F.min("flux").alias("lo"), F.max("flux").alias("hi"), F.count(F.lit(1)).alias("n_cells")), "cells")
    bounds = cells.groupBy("reaction").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n_cells").alias("n_cells"))
    absent = F.col("n_cells") < F.col("n_all")
    lo = F.when(absent, F.least("lo", F.lit(0.0))).otherwise(F.col("lo"))
    hi = F.when(absent, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi"))
    bounds = (
        bounds.withColumn("n_all", known["n_all"]).select("reaction", lo.alias("lo"), hi.alias("hi"))
        .filter((F.col("lo") != 0) | (F.col("hi") != 0))
    )
    flat = F.col("lo") == F.col("hi")
    bounds = settle(bounds.select("reaction", (F.col("lo") - F.when(flat, 0.5).otherwise(0.0)).alias("lo"),
                                  (F.col("hi") + F.when(flat, 0.5).otherwise(0.0)).alias("hi")), "bounds")

    def bin_of(x):
        return F.least(F.floor((x - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("bigint")

    present = flux.join(bounds, "reaction").groupBy("reaction", "label", bin_of(F.col("flux")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = bounds.withColumn("l", F.explode(known["labels"])).select(
        "reaction", "l.label", "l.n_rows", bin_of(F.lit(0.0)).alias("bin"))
    zeros = (
        grid.join(cells.select("reaction", "label", "n_cells"), ["reaction", "label"], "left")
        .withColumn("n", F.col("n_rows") - F.coalesce("n_cells", F.lit(0)))
        .filter(F.col("n") > 0).select("reaction", "label", "bin", "n")
    )
    return present.unionByName(zeros).groupBy("reaction", "label", "bin").agg(F.sum("n").alias("n"))
