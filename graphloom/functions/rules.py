"""Rules that give a node its semantic type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of names that mark errors and recipes.
ERROR_WORDS = ["error", "exception", "fault", "failure", "warning"]
RECIPE_STARTS = ["main", "example", "demo", "test_", "run_", "execute_"]
RECIPE_NAMES = ["test", "run", "execute"]


def semantic_type(kind: Column, name: Column) -> Column:
    """The semantic type of a structural type and name; a semantic type stays as it is."""
    low = F.lower(name)
    is_error = low.rlike("|".join(ERROR_WORDS))
    is_recipe = low.rlike("^(" + "|".join(RECIPE_STARTS) + ")") | low.isin(*RECIPE_NAMES)
    return (
        F.when(kind == "file", "module")
        .when((kind == "class") & is_error, "error")
        .when((kind == "function") & is_recipe, "recipe")
        .when((kind == "function") & ~name.startswith("_"), "capability")
        .when(kind.isin("class", "function", "variable"), "concept")
        .otherwise(kind)
    )
