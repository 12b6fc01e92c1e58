"""Evaluation records that training records have too, exactly or almost (problem 3).

A record is the set of hashes of its word n-grams. Grams are ordered from rare to common by a bounded table of
counters over both splits; of a record of n grams only the first n - ceil(t n) + 1 are looked up, since two sets whose
likeness is t or more share one of those. Evaluation and training rows meet by gram hash, whole sets then give the
shared grams, the containment of the evaluation record and the likeness.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremlake.llm.content import Hasher, WORD, bound_variables, content_of, split_kind
from theoremlake.llm.neardup import list_array
from theoremlake.llm.pairs import HOT_ROWS, Keys, candidate_pairs, likeness, mix, sets_of, with_representative
from theoremlake.plans.scratch import written

#: Counters that order the grams; any order gives the same result, one close to the true counts the fewest candidates.
ORDER_SLOTS = 1 << 16


def _featurize(gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher()
        for b in batches:
            ids, side, sets, sigs = [], [], [], []
            for i, s, t, e in zip(*(b.column(c).to_pylist() for c in ("id", "statement", "type_signature", "side")), strict=True):
                content, is_statement = content_of(s, t)
                if i is None or content is None:
                    continue
                bound = bound_variables(content)
                words = [w.lower() for w in WORD.findall(content)[2 if is_statement else 0 :] if w not in bound]
                k = min(gram, len(words))
                grams = words if gram == 1 else [" ".join(words[j : j + k]) for j in range(len(words) - k + 1)]
                w = hashed(list(set(grams)))
                if len(w):
                    ids.append(i)
                    side.append(e)
                    sets.append(w)
                    sigs.append(xxhash.xxh3_128_digest(w.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(side, pa.int32()), pa.array(sigs, pa.binary()), list_array(sets)], names=["id", "side", "sig", "words"])

    return run


def _slot_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(ORDER_SLOTS, np.int64)
    for b in batches:
        if b.num_rows:
            total += np.bincount((sets_of(b)[0] % np.uint64(ORDER_SLOTS)).astype(np.int64), minlength=ORDER_SLOTS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["slot", "n"])


def prefix_keys(count: np.ndarray, threshold: float):
    """Key function: the rarest grams of each set that a set alike must share one of."""

    def keys(flat: np.ndarray, offsets: np.ndarray) -> Keys:
        n = np.diff(offsets)
        row = np.repeat(np.arange(len(n)), n)
        o = np.lexsort((flat, count[(flat % np.uint64(len(count))).astype(np.int64)], row))
        # the small number keeps ceil() from rounding a whole number up
        need = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
        place = np.arange(len(flat)) - np.repeat(offsets[:-1], n)
        first = place < np.repeat(need, n)
        return Keys(mix(flat[o][first]), row[first])

    return keys


def cross_split_overlaps(df: DataFrame, threshold: float = 0.8, gram: int = 5, id_col: str = "decl_id", split_col: str = "split", statement_col: str = "statement", type_col: str = "type_signature", hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(members, overlaps). members (id, side, rep): side 0 for training, 1 for validation and test; rep is the smallest id
    of the side with the same grams. overlaps (train_rep, eval_rep, shared, containment, likeness): pairs of representatives
    whose likeness, of the sets of grams without bound variables and leading keyword and name, is threshold or more;
    containment is the share of the evaluation record's grams that the training record has.

    Rows without split, content, words or id are in neither; an empty table gives empty results."""
    kind = split_kind(F.col(split_col))
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(statement_col).alias("statement"), F.col(type_col).alias("type_signature"), F.when(kind == "train", 0).when(kind.isNotNull(), 1).alias("side")).where("side is not null")
    sets = written(src.mapInArrow(_featurize(gram), "id long, side int, sig binary, words array<long>"), "p3-sets")
    reps = written(sets.groupBy("side", "sig").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "p3-reps")
    members = with_representative(sets.select("id", "side", "sig"), reps, ["side", "sig"]).select("id", "side", "rep")
    unique = written(sets.join(reps.select(F.col("rep").alias("id")), "id", "left_semi").select("id", "side", "words"), "p3-unique")
    count = np.zeros(ORDER_SLOTS, np.int64)
    for r in unique.select("words").mapInArrow(_slot_counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        count[r.slot] = r.n
    found = likeness(candidate_pairs(unique, prefix_keys(count, threshold), threshold, sided=True, hot_rows=hot_rows), unique).where(F.col("likeness") >= threshold)
    side = unique.select(F.col("id").alias("l"), "side")
    return members, found.join(side, "l").select(
        F.when(F.col("side") == 0, F.col("l")).otherwise(F.col("r")).alias("train_rep"),
        F.when(F.col("side") == 0, F.col("r")).otherwise(F.col("l")).alias("eval_rep"),
        "shared",
        (F.col("shared") / F.when(F.col("side") == 0, F.col("n_r")).otherwise(F.col("n_l"))).alias("containment"),
        "likeness",
    )


def overlapping_rows(members: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(train_id, eval_id): every pair of rows, copies included."""
    train = members.where("side = 0").select(F.col("rep").alias("train_rep"), F.col("id").alias("train_id"))
    evaluation = members.where("side = 1").select(F.col("rep").alias("eval_rep"), F.col("id").alias("eval_id"))
    return overlaps.select("train_rep", "eval_rep").join(train, "train_rep").join(evaluation, "eval_rep").select("train_id", "eval_id")
