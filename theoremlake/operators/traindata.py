"""Contrastive training rows with hard negatives, split without leaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from theoremlake.functions.declarations import declaration_text, query_side
from theoremlake.functions.text import cluster_key, concept_stem, hash_split_is_test, relation_signature, text

LOOKALIKE = "characterization|postulate"
#: Characters of a stem by which look-alike names are found.
STEM_KEY = 5


def features(df: DataFrame, seq: str) -> DataFrame:
    """Canonical declarations with seq, stem, cluster, relation and whether the name is of the look-alike family."""
    return df.select(
        F.col(seq).alias("seq"),
        "library",
        text("name").alias("name"),
        concept_stem("name").alias("stem"),
        cluster_key("library", "statement", "type_signature", "name").alias("cluster"),
        relation_signature("name").alias("relation"),
        F.lower(text("name")).rlike(LOOKALIKE).alias("lookalike"),
    )


def holdout_clusters(f: DataFrame, gold: DataFrame) -> DataFrame:
    """The clusters of declarations named in gold (name)."""
    return f.join(gold.select("name").distinct(), "name", "left_semi").select("cluster").distinct()


def with_side(f: DataFrame, test_fraction: float, holdout: DataFrame | None = None) -> DataFrame:
    """f with is_test; clusters of holdout are on the test side."""
    by_hash = hash_split_is_test(F.col("cluster"), test_fraction)
    if holdout is None:
        return f.withColumn("is_test", by_hash)
    forced = holdout.select("cluster").distinct().withColumn("_held", F.lit(True))
    return f.join(forced, "cluster", "left").withColumn("is_test", F.coalesce("_held", by_hash)).drop("_held")


def _first_by(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def _names(f: DataFrame) -> DataFrame:
    """A row for each (library, name): of its clusters the one with the first row and the one with the last (f1c, f1 and l1c,
    l1), and the first and last row of any other cluster (f2, l2; null if there is none)."""
    per = f.groupBy("library", "name", "stem", "relation", "lookalike", "cluster").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    w = Window.partitionBy("library", "name")
    ranked = per.withColumns({"a": F.row_number().over(w.orderBy("first")), "z": F.row_number().over(w.orderBy(F.desc("last")))}).where("a <= 2 or z <= 2")
    at = lambda flag, n, c: F.max(F.when(F.col(flag) == n, F.col(c)))
    return ranked.groupBy("library", "name", "stem", "relation", "lookalike").agg(
        at("a", 1, "cluster").alias("f1c"), at("a", 1, "first").alias("f1"), at("a", 2, "first").alias("f2"), at("z", 1, "cluster").alias("l1c"), at("z", 1, "last").alias("l1"), at("z", 2, "last").alias("l2")
    )


def _holding(stems: DataFrame, names: DataFrame) -> DataFrame:
    """Stems (library, stem) with the names (library, name, ...) that hold them, without case: by an equi-join of the first
    characters of a stem and all runs of so many characters in a name, in place of comparing all of a library."""
    low, short = F.lower("name"), F.least(F.length("stem"), F.lit(STEM_KEY))

    def runs(n: int) -> Column:
        """The runs of n characters that begin at each place."""
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1))), lambda i: F.substr(low, i, F.lit(n)))

    each = names.withColumn("key", F.explode(F.array_distinct(F.concat(*map(runs, range(1, STEM_KEY + 1))))))
    return stems.withColumn("key", F.substr("stem", F.lit(1), short)).join(each, ["library", "key"]).where(F.contains(F.lower("name"), "stem")).drop("key")


def hard_negatives(f: DataFrame, k: int = 5) -> DataFrame:
    """(seq, neg_seq, neg_name, class, place): up to k negatives of each declaration with a stem.

    Candidates are other names of other clusters in the library that have the stem, or are look-alikes whose name holds
    it. Of rows of one name the last stands at the place of the first. Classes: 0 look-alike of the stem, 1 other
    relation, 2 none, 3 the same. f: features() with unique seq, best stored.

    No stem's rows meet each other. Candidates are first cut to those that can be among any anchor's k best: an anchor
    leaves out one name, one cluster and (for class 1) one relation, so of each list as many more are kept as these can
    take away, at most k + 1 of each cluster. That is some dozens for a stem, whatever its size, and loses nothing."""
    from theoremlake.plans.scratch import written

    names = written(_names(f), "names")  # this and the two lists below are read several times
    own = names.where("stem <> ''").withColumn("g", F.lit(0)).withColumn("is_look", F.col("lookalike") & F.contains(F.lower("name"), "stem"))
    stems = own.select("library", "stem").distinct()
    look = _holding(stems, names.where("lookalike").withColumnRenamed("stem", "own_stem"))
    look = look.withColumns({"g": F.when(F.col("own_stem") == F.col("stem"), 0).otherwise(1), "is_look": F.lit(True)}).drop("own_stem")
    all_ = own.where("not is_look").unionByName(look)
    group = F.when(F.col("is_look"), F.array(F.lit("0"))).otherwise(F.concat(F.array(F.lit("r")), "relation"))
    all_ = all_.withColumn("list", F.concat_ws(" ", group))
    key = ["library", "stem"]
    base = written(_first_by(_first_by(all_, [*key, "list", "f1c"], ["g", "f1", "name"], k + 1), [*key, "list"], ["g", "f1", "name"], 2 * k + 2), "base")
    related = base.where("not is_look and size(relation) > 0")
    other = _first_by(_first_by(related, [*key, "f1c"], ["f1", "name"], 3 * k + 3), key, ["f1", "name"], 6 * k + 6)
    # names whose first row is in the anchor's own cluster count from their first row in another
    moved = written(_first_by(all_.where("f2 is not null"), [*key, "list", "f1c"], ["g", "f2", "name"], k + 1), "moved")
    moved_other = _first_by(moved.where("not is_look and size(relation) > 0"), [*key, "f1c"], ["f2", "name"], 2 * k + 2)
    any_relation = base.where("is_look or size(relation) = 0").unionByName(other)
    moved_any = moved.where("is_look or size(relation) = 0").unionByName(moved_other)

    anchors = f.where("stem <> ''").groupBy("library", "stem", "name", "cluster", "relation").agg(F.min("seq").alias("anchor"))
    anchors = anchors.withColumnsRenamed({"name": "a_name", "relation": "a_relation"})
    same_relation = lambda df: df.where("not is_look and size(relation) > 0").withColumn("a_relation", F.col("relation"))
    met = (
        anchors.join(any_relation, key)
        .unionByName(anchors.join(same_relation(base), [*key, "a_relation"]))
        .unionByName(anchors.join(moved_any.withColumn("cluster", F.col("f1c")), [*key, "cluster"]))
        .unionByName(anchors.join(same_relation(moved).withColumn("cluster", F.col("f1c")), [*key, "a_relation", "cluster"]))
    )
    first = F.when(F.col("f1c") != F.col("cluster"), F.col("f1")).otherwise(F.col("f2"))
    last = F.when(F.col("l1c") != F.col("cluster"), F.col("l1")).otherwise(F.col("l2"))
    kind = F.when(F.col("is_look"), 0).when(F.size("relation") == 0, 2).when(F.col("relation") == F.col("a_relation"), 3).otherwise(1)
    each = met.select(*key, "a_name", "cluster", "anchor", F.col("name").alias("neg_name"), "g", first.alias("first"), last.alias("neg_seq"), kind.alias("class"))
    each = each.where("first is not null and neg_name <> a_name").dropDuplicates([*key, "a_name", "cluster", "neg_name"])
    w = Window.partitionBy(*key, "a_name", "cluster").orderBy("class", "g", "first", "neg_name")
    best = each.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(*key, "a_name", "cluster", "neg_seq", "neg_name", "class", "place")
    rows = f.where("stem <> ''").select("seq", "library", "stem", F.col("name").alias("a_name"), "cluster")
    return rows.join(best, [*key, "a_name", "cluster"]).select("seq", "neg_seq", "neg_name", "class", "place")


def same_side(negatives: DataFrame, sides: DataFrame) -> DataFrame:
    """Negatives whose anchor is on their side; taken out after the k best were chosen, so fewer may stay."""
    s = sides.select("seq", "is_test")
    return negatives.join(s, "seq").join(s.toDF("neg_seq", "neg_test"), "neg_seq").where("is_test = neg_test").drop("neg_test")


def training_rows(df: DataFrame, seq: str, test_fraction: float = 0.1, k: int = 5, holdout_gold: DataFrame | None = None) -> DataFrame:
    """(seq, is_test, query, real_query, positive, name, library, negatives, neg_names) for each canonical declaration."""
    from theoremlake.plans.scratch import written

    f = written(features(df, seq), "features")
    f = written(with_side(f, test_fraction, None if holdout_gold is None else holdout_clusters(f, holdout_gold)), "sides")
    negatives = same_side(hard_negatives(f, k), f)
    query, real = query_side()
    rows = df.select(F.col(seq).alias("seq"), query.alias("query"), real.alias("real_query"), declaration_text().alias("positive"), "name", "library")
    texts = rows.select(F.col("seq").alias("neg_seq"), F.col("positive").alias("neg_text"))
    listed = negatives.join(texts, "neg_seq").groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("place", "neg_text", "neg_name"))).alias("n"))  # k at most
    empty = F.array().cast("array<string>")
    out = rows.join(f.select("seq", "is_test"), "seq").join(listed, "seq", "left")
    return out.select("seq", "is_test", "query", "real_query", "positive", "name", "library", F.coalesce(F.col("n.neg_text"), empty).alias("negatives"), F.coalesce(F.col("n.neg_name"), empty).alias("neg_names"))


def triplets(rows: DataFrame) -> DataFrame:
    """(query, positive, negative), one row for each negative that is not blank."""
    return rows.select("query", "positive", F.explode("negatives").alias("negative")).where("trim(negative) <> ''")


def training_summary(rows: DataFrame) -> DataFrame:
    """Rows, share of real queries and of rows with negatives, mean number of negatives of these."""
    n: Column = F.size("negatives")
    share = lambda c: F.round(100.0 * F.count_if(c) / F.count("*"), 4)
    return rows.groupBy("is_test").agg(F.count("*").alias("n_rows"), share(F.col("real_query")).alias("pct_real"), share(n > 0).alias("pct_with_negatives"), F.round(F.avg(F.when(n > 0, n)), 4).alias("avg_negatives"))
