"""Reranking of retrieved candidates."""

from __future__ import annotations

import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from theoremlake.functions.text import query_terms, token_set
from theoremlake.operators.search import top_by

RRF_CONSTANT = 60
PASSTHROUGH = frozenset({"0", "false", "no", "off", "none", "dense"})


def _prefix(c: str):
    """What two tokens share if they are equal, or if one begins with the other and both have five characters or more."""
    return F.substring(c, 1, 5)


def lexical_scores(hits: DataFrame) -> DataFrame:
    """(query_id, id, lexical): functions.text.lexical_score of each hit, by an equi-join of terms and tokens on the first
    five characters in place of comparing all of them. Hits without a match are left out."""
    terms = hits.select("query_id", "query").dropDuplicates(["query_id"]).select("query_id", F.explode(query_terms("query")).alias("term"))
    terms = terms.groupBy("query_id", "term").agg(F.count("*").alias("times")).withColumn("key", _prefix("term"))
    texts = hits.select("id", "name", "type_signature", "docstring", "statement").dropDuplicates(["id"])
    tokens = texts.select("id", F.explode(token_set("name", "type_signature", "docstring", "statement")).alias("token")).withColumn("key", _prefix("token"))
    met = hits.select("query_id", "id").join(terms, "query_id").join(tokens, ["id", "key"])
    near = (F.length("term") >= 5) & (F.length("token") >= 5) & (F.startswith("term", "token") | F.startswith("token", "term"))
    worth = F.when(F.col("term") == F.col("token"), 1.0).when(near, 0.5).otherwise(0.0)
    best = met.groupBy("query_id", "id", "term", "times").agg(F.max(worth).alias("worth"))
    return best.groupBy("query_id", "id").agg(F.sum(F.col("worth") * F.col("times")).alias("lexical"))


def reciprocal_rank(hits: DataFrame, limit: int, constant: int = RRF_CONSTANT) -> DataFrame:
    """Hits (query_id, id, rank, query, name, type_signature, docstring, statement) in the order of the sum of the
    reciprocal dense and lexical ranks, ties by dense rank; display_score is relative to the query's best. hits is read
    several times, so it should be stored."""
    lex = hits.join(lexical_scores(hits), ["query_id", "id"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc("lexical"), "rank")
    fused = lex.withColumn("fused", 1.0 / (constant + F.col("rank") - 1) + 1.0 / (constant + F.row_number().over(w) - 1))
    top = top_by(fused.withColumnRenamed("rank", "dense_rank"), ["query_id"], [F.desc("fused"), F.asc("dense_rank")], limit)
    return top.withColumn("display_score", F.col("fused") / F.max("fused").over(Window.partitionBy("query_id")))


def passthrough(hits: DataFrame, limit: int) -> DataFrame:
    """The first hits, scores relative to the best; a best of 0 counts as 1."""
    top = hits.where(F.col("rank") <= limit)
    best = F.max("score").over(Window.partitionBy("query_id"))
    return top.withColumn("display_score", F.col("score") / F.when(best == 0, F.lit(1.0)).otherwise(best))


def cross_encode(hits: DataFrame, limit: int, score: Callable[[list[tuple[str, str]]], list[float]]) -> DataFrame:
    """Hits (query_id, id, rank, query, document) in the order of a model's score, shown through the logistic function.
    score gets (query, document) pairs of a batch."""
    @F.pandas_udf("double")
    def scored(query: pd.Series, document: pd.Series) -> pd.Series:
        return pd.Series(score(list(zip(query, document, strict=True))), dtype="float64")

    raw = hits.withColumn("raw", scored("query", "document")).withColumnRenamed("rank", "dense_rank")
    return top_by(raw, ["query_id"], [F.desc("raw"), F.asc("dense_rank")], limit).withColumn("display_score", 1.0 / (1.0 + F.exp(-F.col("raw"))))


def rerank(hits: DataFrame, limit: int, mode: str = "auto", **options) -> DataFrame:
    """Cross, a passthrough mode, or anything else for reciprocal ranks. Where cross is asked for without a model, or its
    model fails on a trial pair, hits keep the order of retrieval; other mistakes are raised."""
    mode = mode.strip().lower()
    if mode in PASSTHROUGH:
        return passthrough(hits, limit)
    if mode != "cross":
        return reciprocal_rank(hits, limit, **options)
    try:
        options["score"]([("query", "document")])
    except Exception:
        logging.getLogger(__name__).warning("no model to rerank with, hits keep the order of retrieval", exc_info=True)
        return passthrough(hits, limit)
    return cross_encode(hits, limit, **options)
