"""Retrieval metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def drop_self(ranked: DataFrame, own: str = "own_name") -> DataFrame:
    """Ranked (query_id, rank, name, own) without the query's own name, ranks closed up."""
    w = Window.partitionBy("query_id").orderBy("rank")
    return ranked.where(~F.col("name").eqNullSafe(F.col(own))).withColumn("rank", F.row_number().over(w))


def relevance(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Ranked (query_id, rank, name) with hit, whether the name is one of the query's gold (query_id, name)."""
    return ranked.join(gold.select("query_id", "name").distinct().withColumn("hit", F.lit(1)), ["query_id", "name"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def per_query(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, n_gold, best_rank, recall5, recallk, rrk, rr, apk) for each query with gold; W9: others are left out.

    Recall counts gold names once; a name that is ranked twice counts twice in apk, which can so exceed 1. rr has no
    cut, rrk is 0 beyond k."""
    golds = gold.where("name is not null").select("query_id", "name").distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hits = relevance(ranked, gold).where("hit = 1").select("query_id", "name", "rank")
    w = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("nth", F.row_number().over(w))
    names = lambda n: F.count_distinct(F.when(F.col("rank") <= n, F.col("name")))
    found = hits.groupBy("query_id").agg(F.min("rank").alias("best_rank"), names(5).alias("h5"), names(k).alias("hk"), F.sum(F.when(F.col("rank") <= k, F.col("nth") / F.col("rank")).otherwise(0.0)).alias("sum_p"))
    n = F.col("n_gold")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return golds.join(found, "query_id", "left").select(
        "query_id",
        "n_gold",
        "best_rank",
        zero(F.col("h5") / n).alias("recall5"),
        zero(F.col("hk") / n).alias("recallk"),
        F.when(F.col("best_rank") <= k, 1.0 / F.col("best_rank")).otherwise(0.0).alias("rrk"),
        zero(1.0 / F.col("best_rank")).alias("rr"),
        zero(F.col("sum_p") / F.least(n, F.lit(k))).alias("apk"),
    )


def summary(rows: DataFrame, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """The means of per_query rows, over all or by columns."""
    mean = lambda c: F.round(F.avg(c), digits)
    hit = lambda n: mean(F.when(F.col("best_rank") <= n, 1.0).otherwise(0.0))
    columns: dict[str, Column] = {"queries": F.count("*"), "hit1": hit(1), "hit5": hit(5), "hit10": hit(10), "recall5": mean("recall5"), "recall10": mean("recallk"), "mrr10": mean("rrk"), "mrr": mean("rr"), "map10": mean("apk")}
    return rows.groupBy(*(by or [])).agg(*(c.alias(k) for k, c in columns.items()))


def gold_ranks(ranked: DataFrame, gold: DataFrame, depth: int = 50, top: int = 3) -> DataFrame:
    """(query_id, gold_rank, top_names): the best rank of a gold name within depth, null if none, and the first names."""
    near = relevance(ranked.where(F.col("rank") <= depth), gold)
    best = F.min(F.when(F.col("hit") == 1, F.col("rank")))
    first = F.sort_array(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "name"))))
    return near.groupBy("query_id").agg(best.alias("gold_rank"), F.transform(first, lambda x: x["name"]).alias("top_names"))
