"""Near-duplicate declarations (problem 2) by tensored banding of minhashes.

Two small collections of half keys are made from minhashes: A of `a_keys` keys of `a_rows` minhashes each and B of
`b_keys` keys of `b_rows`. Every pair (A key, B key) is the key of one of a_keys * b_keys tables, so that
a_keys * a_rows + b_keys * b_rows minhashes do for tables that would otherwise take a_keys * b_keys * (a_rows + b_rows).
The tables of one A key are kept together: rows meet by A key, and there by A and B key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremlake.llm.content import Hasher, content_of, word_set
from theoremlake.llm.pairs import HOT_ROWS, Keys, candidate_pairs, likeness, mix, with_representative
from theoremlake.plans.scratch import written


@dataclass(frozen=True)
class Tensor:
    """With the defaults a pair of likeness 0.7, 0.75, 0.8 or 0.9 shares a table with probability 0.989, 0.997, 0.9995 or 1."""

    a_keys: int = 12
    a_rows: int = 3
    b_keys: int = 8
    b_rows: int = 2

    def keys(self, flat: np.ndarray, offsets: np.ndarray) -> Keys:
        n = len(offsets) - 1

        def half(count: int, rows: int, salt: int) -> np.ndarray:
            out = np.zeros((n, count), np.uint64)
            for i in range(count):
                for j in range(rows):
                    a, b = (int.from_bytes(xxhash.xxh3_64_digest(f"{salt}.{i}.{j}.{x}"), "big") for x in "ab")
                    low = np.minimum.reduceat(mix((flat ^ np.uint64(b)) * np.uint64(a | 1)), offsets[:-1])
                    out[:, i] = mix(out[:, i] * np.uint64(0x9E3779B97F4A7C15) + low)
                out[:, i] += np.uint64(i)
            return out

        a = mix(half(self.a_keys, self.a_rows, 1))
        b = (half(self.b_keys, self.b_rows, 2) >> np.uint64(32)).astype(np.uint32)
        return Keys(a.ravel(), np.repeat(np.arange(n), self.a_keys), b)


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashed = Hasher()
    for b in batches:
        ids, sets, sigs = [], [], []
        for i, s, t in zip(b.column("id").to_pylist(), b.column("statement").to_pylist(), b.column("type_signature").to_pylist(), strict=True):
            content, _ = content_of(s, t)
            if i is None or content is None:
                continue
            w = hashed(word_set(content))
            if len(w):
                ids.append(i)
                sets.append(w)
                sigs.append(xxhash.xxh3_128_digest(w.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sigs, pa.binary()), list_array(sets)], names=["id", "sig", "words"])


def list_array(sets: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)))


def word_sets(df: DataFrame, id_col: str = "decl_id", statement_col: str = "statement", type_col: str = "type_signature") -> DataFrame:
    """(id, sig, words): the hashed word set of each content that has a word."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(statement_col).alias("statement"), F.col(type_col).alias("type_signature")).mapInArrow(_featurize, "id long, sig binary, words array<long>")


def near_duplicates(df: DataFrame, threshold: float = 0.8, id_col: str = "decl_id", tensor: Tensor = Tensor(), hot_rows: int = HOT_ROWS, **columns: str) -> tuple[DataFrame, DataFrame]:
    """(members, links). members (id, rep): for each row with a content the smallest id that has the same set of words.
    links (l, r, likeness): pairs l < r of such representatives with different sets and a likeness of threshold or more.

    Rows without content, without a word in it or without an id are left out; an empty table gives empty results.
    Ids should be unique. Copies are one set from the start, so a text that a third of all rows has costs one row."""
    sets = written(word_sets(df, id_col, **columns), "p2-sets")
    reps = written(sets.groupBy("sig").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "p2-reps")
    members = with_representative(sets.select("id", "sig"), reps, ["sig"]).select("id", "rep")
    unique = written(sets.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "words"), "p2-unique")
    links = likeness(candidate_pairs(unique, tensor.keys, threshold, sub_width=tensor.b_keys, hot_rows=hot_rows), unique)
    return members, links.where(F.col("likeness") >= threshold).select("l", "r", "likeness")


#: Makes 64-bit ids positive.
_SHIFT = Decimal(1 << 63)


def duplicate_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, links): for each row the smallest id that copies and links connect it with, and how many rows are copies
    of it or linked with it. One row for each of members, however large the classes."""
    from theoremlake.llm.splits import spanning_forest

    copies = members.groupBy("rep").agg(F.count("*").alias("n"))
    ends = links.select(F.col("l").alias("rep"), F.col("r").alias("to")).unionByName(links.select(F.col("r").alias("rep"), F.col("l").alias("to")))
    linked = ends.join(copies.withColumnRenamed("rep", "to"), "to").groupBy("rep").agg(F.sum("n").alias("more"))
    # the forest's vertices are ordered as strings, so ids are padded
    name = lambda c: F.lpad(F.col(c).cast("decimal(20,0)") + F.lit(_SHIFT), 20, "0")
    labels, _ = spanning_forest(links.select(name("l").alias("u"), name("r").alias("v")))
    back = (F.col("root").cast("decimal(20,0)") - F.lit(_SHIFT)).cast("long")
    classes = copies.withColumn("vertex", name("rep")).join(labels, "vertex", "left").join(linked, "rep", "left")
    classes = classes.select("rep", "n", F.coalesce(back, "rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"))
    return with_representative(members, classes, ["rep"]).select("id", "class_id", "links")


#: Copies of one set are paired in parts of so many.
_PART = 2_000


def pairs_of_rows(members: DataFrame, links: DataFrame) -> DataFrame:
    """(left_id, right_id): every pair of rows that have one set of words or linked sets, the smaller id first. Copies are
    paired part by part, so no task pairs all copies of one set."""
    m = members
    a, b = m.toDF("a", "l"), m.toDF("b", "r")
    shared = m.groupBy("rep").count().where("count > 1").select("rep", F.ceil(F.col("count") / _PART).alias("parts"))
    copies = m.join(shared, "rep").select("id", "rep", "parts")
    left = copies.select(F.col("id").alias("a"), "rep", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    right = copies.select(F.col("id").alias("b"), "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    within = left.join(right, ["rep", "part"]).where("a < b").select("a", "b")
    across = links.select("l", "r").join(a, "l").join(b, "r").select("a", "b")
    return within.unionByName(across).select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))
