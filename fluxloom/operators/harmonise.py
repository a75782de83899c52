"""Tables of samples with differing columns, in one long form: (file_name, label, sample_n, reaction, flux).

A reaction is a value, never a column. An absent cell means 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxloom.functions.text import model_name
from fluxloom.operators.ranking import dense_index
from fluxloom.session import settle

ROW_KEY = ["file_name", "sample_n"]
SOURCE_COLUMNS = ["label", "file_n", "sample_n", "file_name"]


def rename_reactions(flux: DataFrame, names: DataFrame) -> DataFrame:
    """Give each reaction its canonical name; unknown ids keep theirs. ``names``: (label, reaction, new_name).

    The names are settled, here as in the other operators that match cells with a table derived from
    them: while that table is small the cells are not shuffled for the match.
    """
    known = settle(names.select("label", "reaction", "new_name"), "names")
    return (
        flux.join(known, ["label", "reaction"], "left")
        .withColumn("reaction", F.coalesce("new_name", "reaction"))
        .drop("new_name")
    )


def collapse_duplicates(flux: DataFrame) -> DataFrame:
    """Cells that share a reaction after renaming are summed."""
    return flux.groupBy("file_name", "label", "sample_n", "reaction").agg(F.sum("flux").alias("flux"))


def rename_collisions(names: DataFrame, key: str = "label") -> DataFrame:
    """Canonical names that more than one id of the same model maps to."""
    return (
        names.groupBy(key, "new_name").agg(F.count_distinct("reaction").alias("n_ids"))
        .filter(F.col("n_ids") > 1)
    )


def add_source_columns(flux: DataFrame) -> DataFrame:
    """Add the label (the file's model) and ``file_n`` (position of the file in sorted order)."""
    files = dense_index(flux, "file_name", "file_n")
    return flux.withColumn("label", model_name(F.col("file_name"))).join(files, "file_name")


def reaction_sets(flux: DataFrame) -> DataFrame:
    """Union of all reactions with the number of files that carry each; core = carried by every file."""
    # Both uses of the distinct pairs share one shuffle.
    carried = flux.select("reaction", "file_name").distinct()
    files = carried.agg(F.count_distinct("file_name")).scalar()
    return (
        carried.groupBy("reaction").agg(F.count(F.lit(1)).alias("n_files"))
        .withColumn("is_core", F.col("n_files") == files)
    )


def select_reaction_set(sets: DataFrame, join: str) -> DataFrame:
    """``inner``: core reactions; ``outer``: all of them."""
    if join not in ("inner", "outer"):
        raise ValueError(f"join is 'inner' or 'outer', not {join!r}")
    return sets.filter("is_core") if join == "inner" else sets


def project_fluxes(flux: DataFrame, reactions: list[str] | DataFrame) -> DataFrame:
    """Keep the named reactions. A list becomes a filter that reaches the scan; a table is a semi join."""
    if isinstance(reactions, DataFrame):
        return flux.join(listed(reactions), "reaction", "left_semi")
    return flux.filter(F.col("reaction").isin(reactions))


def listed(reactions: DataFrame) -> DataFrame:
    """Distinct reactions of a table, written once."""
    return settle(reactions.select("reaction").distinct(), "reactions")


def unknown_reactions(requested: DataFrame, flux: DataFrame) -> DataFrame:
    """Requested reactions that the data does not have."""
    return unknown_in(requested.select("reaction"), flux)


def unknown_reactions_by(requested: DataFrame, known: DataFrame, by: str) -> DataFrame:
    """Number of a model's reactions that the data does not have."""
    return unknown_in(requested, known).groupBy(by).agg(F.count(F.lit(1)).alias("n_missing"))


def unknown_in(requested: DataFrame, known: DataFrame) -> DataFrame:
    return requested.join(known.select("reaction").distinct(), "reaction", "left_anti")


def rename_labels(rows: DataFrame, shown: DataFrame, label: str = "label") -> DataFrame:
    """Rows with the ``display`` name of their label; labels without one are left out."""
    return rows.join(shown.select(label, "display"), label)


def align_rows(left: DataFrame, right: DataFrame, keys: list[str] = ROW_KEY) -> DataFrame:
    """Columns of both tables by row key; all rows of the left one stay."""
    return left.join(right, keys, "left")


def count_labels(rows: DataFrame) -> DataFrame:
    """Numbers of different labels and files. One narrow distinct, then a count; labels are not collected."""
    return rows.select("label", "file_name").distinct().agg(
        F.count_distinct("label").alias("n_labels"), F.count_distinct("file_name").alias("n_files"))


def file_paths(files: DataFrame, folder: str) -> DataFrame:
    """Path of every file name of a dataset."""
    return files.withColumn("path", F.concat(F.lit(f"{folder.rstrip('/')}/"), F.col("file_name"), F.lit(".csv")))


def restrict_rows(df: DataFrame, restrictions: dict[str, object]) -> DataFrame:
    """Keep rows equal to every given value; a column that the table lacks is skipped."""
    for column, value in restrictions.items():
        if column in df.columns:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def nonzero_reactions(flux: DataFrame) -> DataFrame:
    """Reactions with any value other than 0, per file."""
    return (
        flux.groupBy("file_name", "reaction").agg(F.bool_or(F.col("flux") != 0).alias("non_zero"))
        .filter("non_zero").select("file_name", "reaction")
    )


def columns_above(cells: DataFrame, column: str, value: str, threshold: float) -> DataFrame:
    """Columns whose maximum is above a threshold."""
    return cells.groupBy(column).agg(F.max(value).alias("max_value")).filter(F.col("max_value") > threshold)


def numeric_only(df: DataFrame, drop: list[str] = SOURCE_COLUMNS) -> DataFrame:
    """Drop the source columns and every column that is not a number."""
    kinds = ("tinyint", "smallint", "int", "bigint", "float", "double")
    return df.select(*[name for name, kind in df.dtypes
                       if name not in drop and (kind in kinds or kind.startswith("decimal"))])


def columns_containing(df: DataFrame, *texts: str) -> list[str]:
    """Column names that hold any of the texts."""
    return [c for c in df.columns if any(t in c for t in texts)]


def combine_samples(flux: DataFrame, action: str) -> DataFrame:
    """``U`` keeps all reactions, ``I`` those of every file; a file's all-zero reactions are dropped from it."""
    if action not in ("U", "I"):
        raise ValueError(f"action is 'U' or 'I', not {action!r}")
    # One pass finds both facts per (file, reaction): that the file carries it, and whether it is ever non-zero.
    carried = settle(
        flux.groupBy("file_name", "reaction").agg(F.bool_or(F.col("flux") != 0).alias("non_zero")), "carried")
    if action == "I":
        files = carried.agg(F.count_distinct("file_name")).scalar()
        core = carried.groupBy("reaction").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == files)
        carried = carried.join(core, "reaction", "left_semi")
    kept = settle(carried.filter("non_zero").select("file_name", "reaction"), "kept")
    return flux.join(kept, ["file_name", "reaction"], "left_semi")


def files_to_models(files: DataFrame, models: DataFrame) -> DataFrame:
    """Pair each file with its model by name; a file without a model has null."""
    return files.withColumn("model_name", model_name(F.col("file_name"))).join(
        models.select(F.col("model").alias("model_name"), F.lit(True).alias("has_model")), "model_name", "left"
    ).withColumn("has_model", F.coalesce("has_model", F.lit(False)))


def align_to(test: DataFrame, train_reactions: DataFrame) -> DataFrame:
    """Test cells limited to the reactions of the training set; its missing ones are 0, so need no rows."""
    return test.join(listed(train_reactions), "reaction", "left_semi")


def passthrough(flux: DataFrame, model_reactions: DataFrame) -> DataFrame:
    """Cells of reactions that a model does not cover; they bypass it unchanged."""
    return flux.join(listed(model_reactions), "reaction", "left_anti")


def extract_fluxes(flux: DataFrame, requested: DataFrame | None = None, n: int = 0, seed: int = 0) -> DataFrame:
    """Cells of the requested reactions (unknown ones fall away), or of ``n`` reactions drawn by seed."""
    from fluxloom.functions.draws import draw

    if requested is None:
        requested = flux.select("reaction").distinct().orderBy(draw(seed, "reaction")).limit(n)
    return project_fluxes(flux, requested)
