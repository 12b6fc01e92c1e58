"""The pN_ queries; each reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from theoremlake.plans.scratch import written


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _leak_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Corpus and items."""
    from theoremlake.llm.content import split_kind

    decls = _read(spark, d, "declarations").where(split_kind(F.col("split")) == "train")
    corpus = (
        _read(spark, d, "documents")
        .select(F.lit("documents").alias("corpus"), F.col("doc_id").alias("id"), "text")
        .unionByName(decls.select(F.lit("declarations").alias("corpus"), F.col("decl_id").alias("id"), F.col("nl_description").alias("text")))
    )
    return corpus, _read(spark, d, "nl_queries").select(F.col("query_id").alias("id"), F.col("query").alias("text"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that hold eight consecutive words, or all, of an evaluation query."""
    from theoremlake.llm.leak import leaked_items

    return leaked_items(*_leak_tables(spark, d)).where("same").select(F.col("item_id").alias("query_id"), "corpus", "record_id").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """For each evaluation query that leaked, a passage word for word or the whole nearly, the number of records that give it
    away."""
    from theoremlake.llm.leak import leaked_items, near_items

    tables = _leak_tables(spark, d)
    both = leaked_items(*tables).drop("likeness").unionByName(near_items(*tables).drop("likeness").withColumn("same", F.lit(False)))
    each = both.groupBy("corpus", "record_id", "item_id").agg(F.max("same").alias("same"))
    return each.groupBy(F.col("item_id").alias("query_id"), "corpus").agg(F.count("*").alias("records"), F.count_if("same").alias("word_for_word"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of declarations whose contents have a likeness of 0.7 or more."""
    from theoremlake.llm.neardup import near_duplicates, pairs_of_rows

    return pairs_of_rows(*near_duplicates(_read(spark, d, "declarations"), 0.7))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """For each declaration with a content its class of near-duplicates and the number of rows it is linked with."""
    from theoremlake.llm.neardup import duplicate_classes, near_duplicates

    members, links = near_duplicates(_read(spark, d, "declarations"), 0.7)
    return duplicate_classes(members, written(links, "p2-links")).withColumnRenamed("id", "decl_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training and an evaluation declaration with a likeness of 0.7 or more."""
    from theoremlake.llm.crosssplit import cross_split_overlaps, overlapping_rows

    pairs = overlapping_rows(*cross_split_overlaps(_read(spark, d, "declarations"), 0.7, 1))
    return pairs.select(F.least("train_id", "eval_id").alias("left_id"), F.greatest("train_id", "eval_id").alias("right_id"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """For each split and library, the evaluation declarations that a training one overlaps, and all of them."""
    from theoremlake.llm.content import split_kind
    from theoremlake.llm.crosssplit import cross_split_overlaps, overlapping_rows

    decls = _read(spark, d, "declarations")
    hit = overlapping_rows(*cross_split_overlaps(decls, 0.7, 1)).select(F.col("eval_id").alias("decl_id")).distinct().withColumn("hit", F.lit(1))
    rows = decls.select("decl_id", split_kind(F.col("split")).alias("split"), "library").where("split in ('validation', 'test')")
    return rows.join(hit, "decl_id", "left").groupBy("split", "library").agg(F.count("*").alias("records"), F.count("hit").alias("overlapping"))


def _groups(spark: SparkSession, d: str) -> DataFrame:
    from theoremlake.llm.splits import related_groups

    return written(related_groups(_read(spark, d, "declarations"), _read(spark, d, "relation_words")), "p4-groups")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Declarations in a group of two or more that must stay together."""
    from theoremlake.llm.splits import grouped_rows

    return grouped_rows(_groups(spark, d))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """A split for each declaration, the same for all of a group."""
    from theoremlake.llm.splits import assign_splits

    return assign_splits(_groups(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of points of which one is among the five most similar to the other."""
    from theoremlake.llm.knn import most_similar, neighbour_pairs

    return neighbour_pairs(most_similar(_read(spark, d, "index_points")))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    from theoremlake.llm.tokens import encode_texts

    return encode_texts(_read(spark, d, "documents"))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document, in tokens of byte_bpe_50k, in a container of 2,048 tokens."""
    from theoremlake.llm.packing import pack_documents

    return pack_documents(_read(spark, d, "documents"), 2048)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose content never arrived."""
    from theoremlake.llm.residue import residue_pages

    return residue_pages(_read(spark, d, "documents")).distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_classes, p3_found, p3_report, p4_found, p4_splits, p5_found, p6_ids, p7_containers, p8_found)}


def oracle_sql() -> dict[str, str]:
    from theoremlake.llm.oracle import oracle_sql as sql

    return sql()
