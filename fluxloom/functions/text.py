"""Names: files, models, metabolites, reactions and hyperparameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a sample file is named <model>_<count>[k][(<repeat>)].
SIZE_SUFFIX = r"_([0-9]|k)+(\([0-9]*\))?$"


def model_name(file_name: Column) -> Column:
    """Model that a sample file came from."""
    return F.regexp_replace(file_name, SIZE_SUFFIX, "")


def metabolite_name(name: Column, formula: Column, charge: Column, compartment: Column) -> Column:
    """Canonical metabolite text; equal in all models that hold the same chemical.

    The frame of brackets is a fixed format. A part that a model does not state reads None (fixed value), so that
    species without formula or charge keep a name of their own.
    """
    stated = [F.coalesce(part.cast("string"), F.lit("None")) for part in (name, formula, charge, compartment)]
    return F.concat(F.lit("m[n["), stated[0], F.lit("]f["), stated[1], F.lit("]ch["), stated[2], F.lit("]co["),
                    stated[3], F.lit("]]"))


def decimal_text(stoich: Column) -> Column:
    """A coefficient as text: one decimal for whole numbers, as in ``-1.0``."""
    return stoich.cast("double").cast("string")


def reaction_name(parts: Column) -> Column:
    """Canonical reaction text from an array of ``<metabolite>s[<stoich>]`` parts."""
    body = F.concat_ws("", F.array_sort(parts))
    return F.replace(F.concat(F.lit("r["), body, F.lit("]")), F.lit(","), F.lit("."))


def format_param(value: Column, kind: str) -> Column:
    """Hyperparameter as it is put on a command line."""
    return F.format_string("%.4e", value.cast("double")) if kind == "float" else value.cast("string")


def param_flag(name: Column) -> Column:
    """``-x`` for a one-letter name, ``--name`` otherwise."""
    return F.concat(F.when(F.length(name) == 1, F.lit("-")).otherwise(F.lit("--")), name)


def parse_boolean(text: Column) -> Column:
    """``true`` / ``false`` in any case; anything else is an error."""
    low = F.lower(text)
    return (
        F.when(low == "true", F.lit(True))
        .when(low == "false", F.lit(False))
        .otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(text, F.lit("null")))))
    )


def leading_label(file_name: Column) -> Column:
    """Label from the small letters (and blanks, commas, hyphens, underscores) that open a file name."""
    return F.regexp_extract(file_name, r"^[a-z ,\-_]*[a-z]", 0)


def short_reaction_name(parts: Column) -> Column:
    """Older reaction text: ``<name>(<compartment>)[<stoich>]`` by metabolite name.

    ``parts``: array of (name, compartment, stoich text).
    """
    ordered = F.array_sort(parts)
    texts = F.transform(ordered, lambda p: F.concat(p["name"], F.lit("("), p["compartment"], F.lit(")["), p["stoich"],
                                                    F.lit("]")))
    return F.replace(F.concat_ws("", texts), F.lit(","), F.lit("."))
