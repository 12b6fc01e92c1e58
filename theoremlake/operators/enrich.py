"""Enrichment and first-wins dedupe (F14, F15, R8), facets and profiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from theoremlake.functions.declarations import rule_based_docstring
from theoremlake.functions.text import text


def enrich(df: DataFrame, describe: Callable[[], Column] = rule_based_docstring) -> DataFrame:
    """empty docstrings filled, and whether they were. df has canonical columns."""
    missing = text("docstring") == ""
    return df.withColumns({"docstring": F.when(missing, describe()).otherwise(F.col("docstring")), "docstring_generated": missing})


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of the rows of each key the first in the given order. Only the best row of a task is shuffled."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def dedupe_declarations(df: DataFrame, order: list[Column]) -> DataFrame:
    """Declarations of one library, kind, name and type are one; the first stays."""
    return first_wins(df, ["library", "kind", "name", "type_signature"], order)


def facet_counts(df: DataFrame, *facets: str) -> DataFrame:
    """A1: (facet, value, n); a missing value is unknown. One scan for all facets."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.lit("unknown")).alias("value")) for f in facets)))
    return df.select(each.alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def stats(df: DataFrame) -> DataFrame:
    """A2: one row with total_points and the maps libraries and kinds."""
    counts = facet_counts(df, "library", "kind")
    of = lambda f: F.filter("x", lambda e: e.facet == f)
    counted = lambda f: F.map_from_entries(F.array_sort(F.transform(of(f), lambda e: F.struct(e.value, e.n))))
    total = F.aggregate(of("library"), F.lit(0).cast("long"), lambda a, e: a + e.n)
    # as many structs as there are libraries and kinds
    return counts.agg(F.collect_list(F.struct("facet", "value", "n")).alias("x")).select(total.alias("total_points"), counted("library").alias("libraries"), counted("kind").alias("kinds"))


def inspect(df: DataFrame, library: str | None = None, kind: str | None = None, search: str | None = None) -> DataFrame:
    """Rows of a library (exact) and kind (any case) with a text in name, type or docstring (any case)."""
    if library:
        df = df.where(F.col("library") == library)
    if kind:
        df = df.where(F.lower("kind") == kind.lower())
    if search:
        has = lambda c: F.contains(F.lower(text(c)), F.lit(search.lower()))
        df = df.where(has("name") | has("type_signature") | has("docstring"))
    return df


def profile(df: DataFrame) -> DataFrame:
    """A3: total and rows with docstring."""
    return df.agg(F.count("*").alias("total"), F.count_if(text("docstring") != "").alias("with_docstring"))


def top_kinds(df: DataFrame, seq: str, k: int = 10) -> DataFrame:
    """A3: the k commonest kinds; of equals the one seen first, by seq."""
    counted = df.groupBy("kind").agg(F.count("*").alias("n"), F.min(seq).alias("first_seen"))
    return counted.orderBy(F.desc("n"), "first_seen").limit(k).select("kind", "n")
