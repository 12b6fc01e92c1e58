"""The most similar vectors of every vector (problem 5).

A forest of random-projection trees is fitted on a bounded sample and sent to every task; every vector is indexed by
it. Where the sample is too small for as many leaves as there must be, the tasks fit the lower levels, each leaf of the
upper ones on a bounded sample of its own, so leaves stay of one size however many vectors there are. Each vector visits the `visits` leaves that come first in one priority queue shared by all trees, its own leaf of
each tree among them. Leaves are then searched whole, and what they give is merged per vector. Vectors travel as
16-bit fixed-point numbers; wherever the rounding could change who is among the k, exact cosines of the
stored vectors decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from theoremlake.plans.scratch import written

#: Pairs that are decided by exact cosines are broadcast up to this number, joined beyond it.
BROADCAST_PAIRS = 1_000_000
_STEP = np.float32(1 / 32767)
#: Candidates a leaf keeps beyond k at least.
_SPARE = 3


@dataclass(frozen=True)
class Forest:
    """trees and visits: leaves a vector is indexed in, and searched for in, the latter in trees of up to `shallow` levels;
    each further level takes `more` visits more, so that recall stays alike. leaf: vectors in a leaf that is aimed at.
    sample: vectors the upper levels are fitted on; at each fit a leaf holds at least min_sample of them. most: levels at
    most; with 18 the forest of 64 dimensions takes 201 MB, for a billion vectors, and more than that make larger leaves."""

    trees: int = 3
    visits: int = 5
    shallow: int = 5
    more: int = 2
    leaf: int = 4000
    sample: int = 16_384
    min_sample: int = 32
    most: int = 18
    seed: int = 7

    def levels(self, total: int, sampled: int) -> tuple[int, int]:
        """(levels of the trees, levels that the first sample can tell apart)."""
        depth = min(self.most, max(0, math.ceil(math.log2(max(1, total / self.leaf)))))
        return depth, min(depth, int(math.log2(max(1, sampled / self.min_sample))))

    def visits_at(self, depth: int) -> int:
        return self.visits + self.more * max(0, depth - self.shallow)


def fit_planes(sample: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Directions and thresholds of the inner nodes of a complete binary tree, the root at 1."""
    w, cut = np.zeros((1 << depth, sample.shape[1]), np.float32), np.zeros(1 << depth, np.float32)
    todo = [(1, np.arange(len(sample)))]
    while todo:
        node, at = todo.pop()
        if node >= 1 << depth:
            continue
        w[node], cut[node], p = split_plane(sample[at], rng)
        todo += [(2 * node, at[p < cut[node]]), (2 * node + 1, at[p >= cut[node]])]
    return w, cut


class _Trees:
    """Complete binary trees of one depth: direction and threshold of each inner node, the root at 1."""

    def __init__(self, sample: np.ndarray, depth: int, f: Forest) -> None:
        rng = np.random.default_rng(f.seed)
        self.depth, self.trees = depth, f.trees
        self.w, self.cut = (np.stack(x) for x in zip(*(fit_planes(sample, depth, rng) for _ in range(f.trees)), strict=True))

    def deepen(self, depth: int, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Add the levels below: (leaf, directions, thresholds) as from fit_planes for each leaf. A leaf without a part, which
        no sampled vector is in, keeps its vectors on one side."""
        more = depth - self.depth
        w = np.zeros((self.trees, 1 << depth, self.w.shape[2]), np.float32)
        cut = np.full((self.trees, 1 << depth), -1, np.float32)
        w[:, : 1 << self.depth], cut[:, : 1 << self.depth] = self.w, self.cut
        for leaf, pw, pc in parts:
            tree, root = leaf >> self.depth, (1 << self.depth) + (leaf & ((1 << self.depth) - 1))
            for level in range(more):
                at = slice(root << level, (root + 1) << level)
                w[tree, at], cut[tree, at] = pw[1 << level : 2 << level], pc[1 << level : 2 << level]
        self.w, self.cut, self.depth = w, cut, depth

    def visit(self, x: np.ndarray, visits: int) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, own) for each vector and visit. The queue orders leaves by the least margin by which the vector missed
        them on the way; level by level, only nodes that can still lead to the first `visits` leaves are kept."""
        n = len(x)
        tree = np.tile(np.arange(self.trees), (n, 1))
        node, rank = np.ones((n, self.trees), np.int64), np.zeros((n, self.trees), np.float32)
        for _ in range(self.depth):
            m = np.einsum("nvd,nd->nv", self.w[tree, node], x) - self.cut[tree, node]
            node = np.concatenate([2 * node + (m >= 0), 2 * node + (m < 0)], 1)
            rank = np.concatenate([rank, np.minimum(rank, -np.maximum(np.abs(m), 1e-12))], 1)
            tree = np.concatenate([tree, tree], 1)
            if node.shape[1] > visits:
                k = np.argsort(-rank, axis=1, kind="stable")[:, :visits]
                tree, node, rank = (np.take_along_axis(z, k, 1) for z in (tree, node, rank))
        return (tree << self.depth) + node - (1 << self.depth), rank == 0


def split_plane(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.float32, np.ndarray]:
    """Of three random directions between two vectors the one along which x spreads most, its median, and the projections."""
    best = None
    for _ in range(3):
        w = x[rng.integers(len(x))] - x[rng.integers(len(x))] if len(x) else np.zeros(x.shape[1], np.float32)
        if not w.any():
            w = rng.standard_normal(x.shape[1]).astype(np.float32)
        w = w / np.linalg.norm(w)
        p = x @ w
        if best is None or (len(p) and p.std() > best[0].std()):
            best = (p, w)
    p, w = best
    return w, np.float32(np.median(p)) if len(p) else np.float32(0), p


def _usable(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a = b.column("v")
            lengths = np.asarray(a.value_lengths().fill_null(0))
            rows = np.flatnonzero((lengths == dims) & np.asarray(b.column("id").is_valid()))
            x = np.asarray(a.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(float("nan"))).reshape(-1, dims)
            ok = np.isfinite(x).all(1) & x.any(1)
            ids, x = np.asarray(b.column("id").take(pa.array(rows)))[ok], np.ascontiguousarray(x[ok] + 0.0)
            unit = x / np.abs(x).max(1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            q = np.rint(unit * 32767).astype(np.int16)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([xxhash.xxh3_128_digest(r.tobytes()) for r in x], pa.binary()), pa.array([r.tobytes() for r in q], pa.binary())], names=["id", "key", "q"]
            )

    return run


def _doubt(dims: int) -> float:
    """The gap of two rounded cosines up to which exact ones decide: two vectors, each at most sqrt(dims) half steps off, on
    both sides of the gap."""
    return 4 * math.sqrt(dims) * float(_STEP) / 2


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, dims) * _STEP


def _route(trees, visits: int, dims: int, rows: int = 4096):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                leaf, own = trees.value.visit(_vectors(b.column("q"), dims), visits)
                row = np.repeat(np.arange(b.num_rows), leaf.shape[1])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(leaf.ravel().astype(np.int32)), pa.array(own.ravel()), b.column("id").take(at), b.column("q").take(at)], names=["leaf", "own", "id", "q"])

    return run


def _best(s: np.ndarray, k: int, width: int = 16) -> np.ndarray:
    """Columns of the k highest of each row, in any order: first the k blocks of `width` columns with the highest maxima."""
    n, m = s.shape
    if m <= k:
        return np.tile(np.arange(m), (n, 1))
    if m % width or m <= 4 * k * width:
        return np.argpartition(s, m - k, axis=1)[:, m - k :]
    stride = m // width  # a block is every stride-th column, so that maxima run along rows
    tops = s.reshape(n, width, stride).max(1)
    blocks = np.argpartition(tops, stride - k, axis=1)[:, stride - k :]
    at = (blocks[:, :, None] + np.arange(width) * stride).reshape(n, -1)
    v = np.take_along_axis(s, at, 1)
    return np.take_along_axis(at, np.argpartition(v, v.shape[1] - k, axis=1)[:, v.shape[1] - k :], 1)


def _search(k: int, dims: int, rows: int = 512):
    """applyInArrow function of a leaf: for each visitor the k best members, a few more, and all whose rounded cosine
    leaves in doubt whether they are among the k, as packed ids and scores."""
    doubt = _doubt(dims)

    def brute(member: np.ndarray, visitor: np.ndarray, x: np.ndarray, ids: np.ndarray, out: list) -> None:
        member = member[np.argsort(ids[member], kind="stable")]
        y_ids, width = ids[member], 16
        # a whole number of blocks; what is added scores -3 and is dropped with the vector itself, which scores -2
        y = np.zeros((len(member) + -len(member) % width, x.shape[1]), np.float32)
        y[: len(member)] = x[member]
        for i in range(0, len(visitor), rows):
            v = visitor[i : i + rows]
            s = x[v] @ y.T
            s[:, len(member) :] = -3
            at = np.searchsorted(y_ids, ids[v]).clip(max=len(member) - 1)
            self_ = np.flatnonzero(y_ids[at] == ids[v])
            s[self_, at[self_]] = -2
            at = _best(s, min(k + _SPARE, len(member)), width)
            best = np.take_along_axis(s, at, 1)
            full = np.zeros(len(v), bool)
            if len(member) > k + _SPARE:
                floor = np.partition(best, _SPARE, axis=1)[:, _SPARE] - doubt  # the k-th less what is in doubt
                full = (best.min(1) >= floor) & (floor > -1.5)
                for r in np.flatnonzero(full):
                    c = np.flatnonzero(s[r, : len(member)] >= floor[r])
                    out.append((v[r : r + 1], y_ids[c][None], s[r, c][None]))
            out.append((v[~full], y_ids[at[~full].clip(max=len(member) - 1)], best[~full]))

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        x = _vectors(t.column("q"), dims)
        ids, own, out = np.asarray(t.column("id")), np.asarray(t.column("own")), []
        member = np.flatnonzero(own)
        if len(member):
            brute(member, np.arange(len(ids)), x, ids, out)
        return pa.table(
            {
                "id": pa.array(np.concatenate([ids[v] for v, _, _ in out]) if out else [], pa.int64()),
                "near": pa.array([r.tobytes() for _, c, _ in out for r in c], pa.binary()),
                "score": pa.array([r.astype(np.float32).tobytes() for _, _, s in out for r in s], pa.binary()),
            }
        )

    return run


def _merge(k: int, dims: int):
    """Rows sorted by id to (id, near, rank, score, slots): the k nearest; where slots is above 0, exact cosines must choose
    so many of the rows of this id that have it."""
    doubt = _doubt(dims)

    def best(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        near = [np.frombuffer(x, np.int64) for x in t.column("near").to_pylist()]
        score = np.concatenate([np.frombuffer(x, np.float32) for x in t.column("score").to_pylist()]) if near else np.empty(0, np.float32)
        q, c = np.repeat(np.asarray(t.column("id")), [len(x) for x in near]), np.concatenate(near) if near else np.empty(0, np.int64)
        ok = score > -1.5
        q, c, score = q[ok], c[ok], score[ok]
        o = np.lexsort((c, q))
        q, c, score = q[o], c[o], score[o]
        if len(q):
            new = np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])]
            q, c, score = q[new], c[new], score[new]
        o = np.lexsort((c, -score, q))
        q, c, score = q[o], c[o], score[o]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
        size = np.diff(np.r_[first, len(q)])
        place = np.arange(len(q)) - np.repeat(first, size)
        more = size > k
        kth, after = np.full(len(first), -9.0), np.full(len(first), -9.0)
        kth[more], after[more] = score[first[more] + k - 1], score[first[more] + k]
        open_ = np.repeat(more & (kth - after <= doubt), size)
        kth, after = np.repeat(kth, size), np.repeat(after, size)
        unsure = open_ & (score >= kth - doubt) & (score <= after + doubt)
        sure = np.where(open_, score > after + doubt, place < k)
        slots = k - np.repeat(np.add.reduceat(sure.astype(np.int64), first) if len(first) else [], size).astype(np.int64)
        keep = sure | unsure
        return pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(c[keep]), pa.array(score[keep].astype(np.float64)), pa.array(np.where(unsure, slots, 0)[keep].astype(np.int32))], names=["id", "near", "score", "slots"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.asarray(b.column("id"))
            cut = int(np.searchsorted(ids, ids[-1]))  # the last id may go on in the next batch
            if cut or (kept and kept[-1].column("id")[-1].as_py() != ids[0]):
                yield best([*kept, b.slice(0, cut)])
                kept = []
            kept.append(b.slice(cut))
        if kept:
            yield best(kept)

    return run


def _exact_cosine():
    x, y = F.col("x"), F.col("y")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return dot(x, y) / F.sqrt(dot(x, x) * dot(y, y))


def _some(vectors: DataFrame, share: float) -> DataFrame:
    """About the share of the rows that it is, the same ones at each call."""
    return vectors if share >= 1 else vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40)))


def _fit_part(depth: int, dims: int, seed: int):
    """applyInArrow function of the sampled vectors of a leaf: its planes of `depth` more levels."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        leaf = t.column("leaf")[0].as_py()
        o = np.argsort(np.asarray(t.column("id")), kind="stable")
        w, cut = fit_planes(_vectors(t.column("q"), dims)[o], depth, np.random.default_rng([seed, leaf]))
        return pa.table({"leaf": pa.array([leaf], pa.int32()), "w": pa.array([w.tobytes()], pa.binary()), "cut": pa.array([cut.tobytes()], pa.binary())})

    return run


def _fitted(unique: DataFrame, total: int, dims: int, forest: Forest) -> _Trees:
    """The forest for the stored vectors unique (id, q). The driver gets forest.sample of them, and the planes."""
    first = _some(unique.select("id", "q"), forest.sample / max(1, total)).toPandas().sort_values("id")
    x = np.frombuffer(b"".join(first["q"]), np.int16).reshape(-1, dims) * _STEP
    depth, upper = forest.levels(total, len(x))
    trees = _Trees(x, upper, forest)
    while trees.depth < depth:
        more = min(depth - trees.depth, int(math.log2(max(2, forest.sample / forest.min_sample))))
        sent = unique.sparkSession.sparkContext.broadcast(trees)
        some = _some(unique.select("id", "q"), forest.min_sample * (1 << (trees.depth + more)) / total)
        homes = some.mapInArrow(_route(sent, forest.trees, dims), "leaf int, own boolean, id long, q binary").where("own")
        parts = homes.groupBy("leaf").applyInArrow(_fit_part(more, dims, forest.seed), "leaf int, w binary, cut binary").toArrow()
        planes = zip(*(parts.column(c).to_pylist() for c in ("leaf", "w", "cut")), strict=True)
        trees.deepen(trees.depth + more, [(n, np.frombuffer(w, np.float32).reshape(-1, dims), np.frombuffer(c, np.float32)) for n, w, c in planes])
    return trees


def most_similar(df: DataFrame, k: int = 5, dims: int = 64, id_col: str = "point_id", vector_col: str = "dense", forest: Forest = Forest()) -> DataFrame:
    """(id, near, place): the k vectors of the highest cosine found for each usable vector, place 1 to k.

    Usable is a vector of dims finite numbers, not all zero; others, nulls and null ids are left out of both sides. Equal
    vectors are one in the index and come out for each other first; ties go by the smaller id. Fewer than k + 1 usable
    vectors give fewer neighbours; an empty table gives none. Norms make no difference. Ids must be unique."""
    spark = df.sparkSession
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    usable = src.mapInArrow(_usable(dims), "id long, key binary, q binary")
    unique = written(usable.groupBy("key").agg(F.min("id").alias("id"), F.first("q").alias("q"), F.count("*").alias("n")), "p5-unique")
    total = unique.count()
    forest_ = _fitted(unique, total, dims, forest)
    depth, trees = forest_.depth, spark.sparkContext.broadcast(forest_)
    routed = unique.select("id", "q").mapInArrow(_route(trees, forest.visits_at(depth), dims), "leaf int, own boolean, id long, q binary")
    found = routed.groupBy("leaf").applyInArrow(_search(k, dims), "id long, near binary, score binary")
    merged = written(found.repartition("id").sortWithinPartitions("id").mapInArrow(_merge(k, dims), "id long, near long, score double, slots int"), "p5-merged")
    open_ = merged.where("slots > 0").select("id", "near", "slots")
    if open_.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
        # both scans keep only rows of open pairs; the left vectors are then few enough to be joined by shuffle
        ends = lambda c: src.join(F.broadcast(open_.select(F.col(c).alias("id")).distinct()), "id", "left_semi")
    else:
        ends = lambda c: src
    exact = open_.join(ends("id").toDF("id", "x"), "id").join(ends("near").toDF("near", "y"), "near")
    w = Window.partitionBy("id").orderBy(F.desc("score"), "near")
    chosen = exact.select("id", "near", _exact_cosine().alias("score"), "slots").withColumn("r", F.row_number().over(w)).where("r <= slots")
    near = merged.where("slots = 0").select("id", "near", "score").unionByName(chosen.select("id", "near", "score"))
    return _with_copies(near, unique, usable, k)


def _with_copies(near: DataFrame, unique: DataFrame, usable: DataFrame, k: int) -> DataFrame:
    """Neighbours of representatives to neighbours of all points. Of each group of equal vectors the k + 1 smallest ids are
    all that can be anybody's neighbour."""
    groups = unique.where("n > 1").select("key", F.col("id").alias("rep"), "n")
    members = written(usable.select("key", "id").join(groups, "key").select("id", "rep", "n"), "p5-copies")
    salted = Window.partitionBy("rep", "salt").orderBy("id")
    first = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1)
    copies = first.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k + 1 at most
    spread = near.join(copies.withColumnRenamed("rep", "near"), "near", "left").select("id", F.explode(F.coalesce("ids", F.array("near"))).alias("near"), "score")
    ranked = spread.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "near"))).where(F.col("place") <= k).select("id", "near", "place")
    single = ranked.join(copies.select(F.col("rep").alias("id")), "id", "left_anti").select("id", "near", "place")
    each = members.join(copies, "rep").select("id", "rep", F.slice(F.array_remove("ids", F.col("id")), 1, k).alias("own"))
    own = each.select("id", F.posexplode("own").alias("pos", "near")).select("id", "near", (F.col("pos") + 1).alias("place"))
    others = each.select("id", "rep", F.size("own").alias("m")).join(ranked.withColumnRenamed("id", "rep"), "rep").select("id", "near", (F.col("place") + F.col("m")).alias("place")).where(F.col("place") <= k)
    return single.unionByName(own).unionByName(others)


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(left_id, right_id): each pair of which one is a neighbour of the other, once, the smaller id first."""
    return near.select(F.least("id", "near").alias("left_id"), F.greatest("id", "near").alias("right_id")).distinct()
