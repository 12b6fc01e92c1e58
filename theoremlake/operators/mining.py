"""Premise mining (R9, W4, W5, J9) and strided samples (T4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from theoremlake.functions.text import compact_ws, text

# Kinds with proofs, what closes one, and words of proofs that are no premise.
PROOF_KINDS = ("Lemma", "Theorem", "Corollary", "Remark", "Fact", "Proposition")
CLOSER = r"(?i)^\s*(Qed|Defined|Admitted|Abort)\b"
TACTICS = (
    "forall exists fun let in match with end if then else Type Prop Set by move apply rewrite exact intro intros destruct induction case split left right "
    "assumption reflexivity symmetry transitivity auto eauto simpl unfold Proof Qed Defined Admitted Abort as using have suff wlog pose set elim red cbn now "
    "trivial congruence lia ring field omega discriminate"
).split()
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_']*"


def group_proofs(statements: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Rows (keys, owner, order, code) of the bodies of closed proofs. statements: keys, order, code, name and kind (null
    where a statement declares nothing). A declaration of a kind with proofs owns what follows up to the first closer; it
    owns nothing if another declaration comes first or there is no closer."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = statements.withColumn("_decl", F.sum(F.when(F.col("kind").isNotNull(), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy(*keys, "_decl")
    closer = F.min(F.when(F.col("kind").isNull() & F.col("code").rlike(CLOSER), F.col(order))).over(group)
    first = lambda c: F.max(F.when(F.col("kind").isNotNull(), F.col(c))).over(group)
    placed = marked.withColumns({"_closer": closer, "owner": first(order), "owner_name": first("name"), "owner_kind": first("kind")})
    return placed.where(F.col("kind").isNull() & (F.col("_decl") > 0) & (F.col(order) < F.col("_closer")) & F.col("owner_kind").isin(*PROOF_KINDS)).select(*keys, "owner", "owner_name", "owner_kind", order, "code")


def premises(bodies: DataFrame, names: DataFrame, keys: list[str], own: str = "owner_name", code: str = "code") -> DataFrame:
    """Keys and the sorted premises: identifiers of three characters or more in code that are names of the corpus,
    not the own name and no tactic. names: one column, distinct; its size is left to the planner."""
    token = F.explode(F.array_distinct(F.regexp_extract_all(text(code), F.lit(IDENTIFIER), F.lit(0))))
    tokens = bodies.select(*keys, own, token.alias("token")).where((F.length("token") >= 3) & ~F.col("token").isin(*TACTICS) & (F.col("token") != text(own)))
    known = tokens.join(names.toDF("token"), "token", "left_semi")
    return known.groupBy(*keys).agg(F.array_sort(F.collect_set("token")).alias("premises"))


def mine(statements: DataFrame, names: DataFrame, low: int = 1, high: int = 15) -> DataFrame:
    """The premise pairs of parsed statements (library, file_path, seq, code, name, kind, type_signature), W5 included."""
    keys = ["library", "file_path"]
    found = premises(group_proofs(statements, keys), names, [*keys, "owner", "owner_name"]).where(F.size("premises").between(low, high))
    heads = statements.where("kind is not null").select(*keys, F.col("seq").alias("owner"), "name", "kind", "type_signature", compact_ws("code").alias("statement"))
    return found.drop("owner_name").join(heads, [*keys, "owner"]).select("name", "kind", "library", "file_path", "type_signature", "statement", "premises")


def strided_sample(df: DataFrame, cap: int, order: list[Column], within: list[str] | None = None) -> DataFrame:
    """T4: rows int(i n / cap) of each group of n rows in order, for i below cap; all rows of a group of cap or fewer.

    Without `within` positions come from a range-partitioned sort, so that no task holds all rows."""
    if within:
        w = Window.partitionBy(*within)
        numbered = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count("*").over(w)})
    else:
        numbered = with_positions(df, order, "_i", "_n")
    # row i is taken if k = ceil(i cap / n), the first that can lead to it, does: int(k n / cap) = i; whole numbers throughout
    k = f"((_i * {cap}L + _n - 1) div _n)"
    taken = F.expr(f"_n <= {cap}L or ({k} * _n div {cap}L = _i and {k} < {cap}L)")
    return numbered.where(taken).drop("_i", "_n")


def with_positions(df: DataFrame, order: list[Column], position: str = "position", total: str = "total") -> DataFrame:
    """df with the place of each row in the order, from 0, and the number of rows. Sorted by ranges; per-range counts, as
    many as there are partitions, are summed up apart."""
    from theoremlake.plans.scratch import written

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    counts = {r["_p"]: r["count"] for r in ranged.groupBy("_p").count().collect()}
    before, starts = 0, []
    for p in sorted(counts):
        starts.append((p, before))
        before += counts[p]
    offsets = spark.createDataFrame(starts, "_p int, _before long")
    local = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.withColumn(position, local - 1).join(F.broadcast(offsets), "_p").withColumns({position: F.col(position) + F.col("_before"), total: F.lit(before).cast("long")}).drop("_p", "_before")
