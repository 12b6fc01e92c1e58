"""Attaching informal descriptions by name, and corpora and evaluation sets without leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from theoremlake.functions.text import hash_sample, jaccard, module_head, signature_tokens, text


def best_descriptions(decls: DataFrame, informal: DataFrame, key: str) -> DataFrame:
    """(key, description, overlap): for each declaration the description under its name whose signature overlaps most
    with statement or type; the first by seq of equals. informal: seq, informal_name, informal_description, signature.
    A best one that is blank gives no row."""
    own = F.coalesce(F.nullif(text("statement"), F.lit("")), text("type_signature"))
    d = decls.where("name is not null").select(F.col(key), F.col("name").alias("informal_name"), signature_tokens(own).alias("a"))
    i = informal.select("seq", "informal_name", "informal_description", signature_tokens("signature").alias("b"))
    joined = d.join(i, "informal_name").withColumn("overlap", jaccard(F.col("a"), F.col("b")))
    w = Window.partitionBy(key).orderBy(F.desc("overlap"), "seq")
    best = joined.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return best.select(key, F.trim("informal_description").alias("description"), "overlap").where("description <> ''")


def eval_candidates(decls: DataFrame, descriptions: DataFrame, key: str) -> DataFrame:
    """Described declarations whose name is unique in the library and not part of the description."""
    unique = decls.groupBy("library", "name").agg(F.count("*").alias("n")).where("n = 1").select("library", "name")
    leak = F.contains(F.lower("description"), F.lower("name"))
    return decls.join(unique, ["library", "name"]).join(descriptions.select(key, "description"), key).where(~leak)


def eval_set(candidates: DataFrame, fraction: float) -> DataFrame:
    """(query, gold, hint) of the candidates picked by name."""
    return candidates.where(hash_sample("name", fraction)).select(F.col("description").alias("query"), F.array("name").alias("gold"), module_head("module_path", "mathcomp").alias("hint"))


def corpus_variants(decls: DataFrame, descriptions: DataFrame, held_names: DataFrame, key: str) -> DataFrame:
    """K9: decls with three descriptions: base has none, enriched all but those of held-out names, ship all."""
    held = held_names.select("name").distinct().withColumn("_held", F.lit(True))
    told = F.coalesce("description", F.lit(""))
    j = decls.join(descriptions.select(key, "description"), key, "left").join(held, "name", "left")
    return j.withColumns({"base": F.lit(""), "enriched": F.when(F.col("_held"), F.lit("")).otherwise(told), "ship": told}).drop("_held", "description")


def leaks_identifier(query: str = "query", gold: str = "gold") -> object:
    """Whether a query names its first gold identifier, in any case."""
    first = F.coalesce(F.try_element_at(gold, F.lit(1)), F.lit(""))
    return (first != "") & F.contains(F.lower(text(query)), F.lower(first))


def latest_by_name(decls: DataFrame, seq: str) -> DataFrame:
    """The last declaration of each name."""
    w = Window.partitionBy("name").orderBy(F.desc(seq))
    return decls.where("name <> ''").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def coverage(decls: DataFrame, descriptions: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Declarations, how many are described, their share, and evaluation candidates."""
    flags = decls.select(key).join(descriptions.select(key, F.lit(1).alias("d")), key, "left").join(candidates.select(key, F.lit(1).alias("c")), key, "left")
    return flags.agg(F.count("*").alias("declarations"), F.count("d").alias("described"), F.round(F.count("d") / F.count("*"), 6).alias("share"), F.count("c").alias("candidates"))
