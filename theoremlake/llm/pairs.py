"""Pairs of rows that share a table key: the part that problems 2 and 3 have in common.

Rows hold a set of 64-bit word hashes. A key function gives each row its table keys; rows of one key meet in one task
and leave it as candidate pairs, in parts of bounded size. A key that many rows share is refined by the half keys of
which a pair must share one, where there are any; a key that is still hot is split: its rows are dealt to g blocks, and
each pair of blocks is a task of its own, so no task holds more than about twice `hot_rows` rows of a key, and no pair is
lost. Hot keys are counted each by itself. Pairs within a key are compared in place by a bound that never drops a pair at
or above the threshold: of two sets whose 64-bit bitmaps differ in d bits, at least d elements are in one only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters with which keys that may be hot are told from the others, at least and at most; their number grows with the rows.
SLOTS, MAX_SLOTS = 1 << 18, 1 << 22
#: Rows of a key that meet in one task, about half of the most.
HOT_ROWS = 8_000
#: Copies of one set beyond which their rows are joined by broadcast of the few sets that have so many.
HOT_COPIES = 1_000_000
#: Pairs that a task holds before it passes them on.
_CHUNK = 1 << 20
#: Rows of a run from which it may be compared row by row with all others instead of by half keys.
_DENSE_ROWS = 256


@dataclass
class Keys:
    """Keys of a batch: key[i] belongs to row[i]; sub, if given, holds half keys of which a pair must share one."""

    key: np.ndarray
    row: np.ndarray
    sub: np.ndarray | None = None


KeyFunction = Callable[[np.ndarray, np.ndarray], Keys]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64 constants, fixed values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sets_of(batch: pa.RecordBatch, column: str = "words") -> tuple[np.ndarray, np.ndarray]:
    """Flat uint64 hashes and offsets of a list<int64> column without nulls."""
    a = batch.column(column)
    offsets = np.asarray(a.offsets)
    return np.asarray(a.values)[offsets[0] : offsets[-1]].view(np.uint64), (offsets - offsets[0]).astype(np.int64)


def bitmaps(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduceat(np.uint64(1) << (flat & np.uint64(63)), offsets[:-1]) if len(flat) else np.zeros(len(offsets) - 1, np.uint64)


def _count_slots(keys_of: KeyFunction, slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for b in batches:
            if b.num_rows:
                k = keys_of(*sets_of(b))
                total += np.bincount((k.key % np.uint64(slots)).astype(np.int64), minlength=slots)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["slot", "n"])

    return run


def _refined(k: Keys, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, whole) of a batch: hot keys (sorted) are replaced by one key for each half key; whole tells the others."""
    if k.sub is None or not len(hot):
        return k.key, k.row, np.ones(len(k.key), bool)
    is_hot = _is_in(k.key, hot)
    key, row = k.key[is_hot], k.row[is_hot]
    m = k.sub.shape[1]
    fine = mix(np.repeat(key, m) * np.uint64(0x9E3779B97F4A7C15) + np.tile(np.arange(1, m + 1, dtype=np.uint64), len(key))) ^ mix(k.sub[row].ravel().astype(np.uint64))
    out = np.concatenate([k.key[~is_hot], fine])
    return out, np.concatenate([k.row[~is_hot], np.repeat(row, m)]), np.arange(len(out)) < len(out) - len(fine)


def _is_in(key: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(key), bool)
    return among[np.searchsorted(among, key).clip(max=len(among) - 1)] == key


def _keys_in_slots(keys_of: KeyFunction, slots: int, full: np.ndarray, hot: np.ndarray):
    """mapInArrow function: the keys of hot slots, or with hot the refined ones of hot keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                k = keys_of(*sets_of(b))
                key, _, whole = _refined(k, hot)
                key = key[~whole] if len(hot) else key[full[(key % np.uint64(slots)).astype(np.int64)]]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return run


def _hot_keys(rows: DataFrame, keys_of: KeyFunction, hot_rows: int, refine: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hot, split, blocks): keys to be refined, and keys to be split with the number of their blocks; both sorted, at most
    (all keys) / hot_rows of each. Counters over slots say which keys can be hot; only those are counted one by one."""
    slots = SLOTS
    total = rows.count()
    while slots < MAX_SLOTS and total * 64 > slots * hot_rows:
        slots *= 2
    counted = rows.select("words").mapInArrow(_count_slots(keys_of, slots), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > hot_rows).toArrow()
    none = np.empty(0, np.uint64)
    if not counted.num_rows:
        return none, none, np.empty(0, np.int64)
    full = np.zeros(slots, bool)
    full[np.asarray(counted.column("slot"))] = True

    def many(hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = rows.select("words").mapInArrow(_keys_in_slots(keys_of, slots, full, hot), "key long").groupBy("key").count().where(F.col("count") > hot_rows).toArrow()
        key = np.asarray(t.column("key").combine_chunks()).astype(np.int64).view(np.uint64)
        o = np.argsort(key)
        return key[o], -(-np.asarray(t.column("count"))[o] // hot_rows)

    hot, blocks = many(none)
    if not refine or not len(hot):
        return none, hot, blocks
    return hot, *many(hot)


def _emit(keys_of: KeyFunction, hot: np.ndarray, split: np.ndarray, blocks: np.ndarray, sided: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            flat, offsets = sets_of(b)
            k = keys_of(flat, offsets)
            ids, bits, n = np.asarray(b.column("id")), bitmaps(flat, offsets), np.diff(offsets).astype(np.int32)
            key, row, _ = _refined(k, hot)
            bi, bj = np.zeros(len(key), np.int32), np.zeros(len(key), np.int32)
            mine = np.zeros(len(key), np.int32)
            if len(split):
                at = np.searchsorted(split, key).clip(max=len(split) - 1)
                g = np.where(split[at] == key, blocks[at], 1)
                own = (mix(ids[row].view(np.uint64)) % g.astype(np.uint64)).astype(np.int32)
                copy = np.repeat(np.arange(len(key)), g)
                other = (np.arange(len(copy)) - np.repeat(np.cumsum(g) - g, g)).astype(np.int32)
                key, row, mine = key[copy], row[copy], own[copy]
                bi, bj = np.minimum(mine, other), np.maximum(mine, other)
            cols = [pa.array(key.view(np.int64)), pa.array(bi), pa.array(bj), pa.array(mine), pa.array(ids[row]), pa.array(bits[row].view(np.int64)), pa.array(n[row])]
            names = ["key", "bi", "bj", "mine", "id", "bits", "n"]
            if sided:
                cols.append(pa.array(np.asarray(b.column("side"))[row]))
                names.append("side")
            if k.sub is not None:
                width = k.sub.shape[1] * 4
                cols.append(pa.Array.from_buffers(pa.binary(width), len(row), [None, pa.py_buffer(np.ascontiguousarray(k.sub[row]))]).cast(pa.binary()))
                names.append("sub")
            whole = pa.RecordBatch.from_arrays(cols, names=names)
            for start in range(0, len(row), _CHUNK):
                yield whole.slice(start, _CHUNK)

    return run


def _same_runs(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _able(c: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, threshold: float, sided: bool) -> np.ndarray:
    """Whether rows x and y, of shapes that fit each other, may make a pair."""
    nx, ny = c["n"][x].astype(np.int32), c["n"][y].astype(np.int32)
    apart = np.bitwise_count(c["bits"][x] ^ c["bits"][y]).astype(np.int32)
    ok = (nx + ny - apart >= threshold * (nx + ny + apart)) & (np.minimum(nx, ny) >= threshold * np.maximum(nx, ny)) & (c["id"][x] != c["id"][y])
    ok &= (c["bi"][x] == c["bj"][x]) | (c["mine"][x] != c["mine"][y])
    return ok & (c["side"][x] != c["side"][y]) if sided else ok


def _dense(c: dict[str, np.ndarray], rows: np.ndarray, threshold: float, sided: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one run, each row with all that follow: takes long for rows that have little in common, but no room, and
    meets no pair twice."""
    step = max(1, _CHUNK // len(rows))
    for i in range(0, len(rows), step):
        x, y = rows[i : i + step, None], rows[None, i + 1 :]
        if not y.size:
            return
        ok = np.arange(i, i + len(x))[:, None] < np.arange(i + 1, len(rows))[None]
        if "sub" in c:
            share = np.zeros(ok.shape, bool)
            for j in range(c["sub"].shape[1]):
                share |= c["sub"][x[:, 0], j][:, None] == c["sub"][y[0], j][None]
            ok &= share
        ok &= _able(c, x, y, threshold, sided)
        a, b = np.nonzero(ok)
        yield x[a, 0], y[0, b]


def _by_groups(c: dict[str, np.ndarray], group: np.ndarray, row: np.ndarray, threshold: float, sided: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that share a group, a pair once for each group; group is sorted."""
    at, d = np.arange(len(group) - 1), 1
    while True:
        at = at[: np.searchsorted(at, len(group) - d)]
        at = at[group[at] == group[at + d]]
        if not len(at):
            return
        for i in range(0, len(at), _CHUNK):
            x, y = row[at[i : i + _CHUNK]], row[at[i : i + _CHUNK] + d]
            ok = _able(c, x, y, threshold, sided)
            yield x[ok], y[ok]
        d += 1


def _pairs_in_runs(c: dict[str, np.ndarray], threshold: float, sided: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of (rows x, rows y) of candidate pairs; runs are the rows with one key and pair of blocks."""
    start = _same_runs(c["key"], c["bi"], c["bj"])
    run = np.cumsum(start) - 1
    size = np.bincount(run)
    keep = np.flatnonzero(size[run] > 1)
    if not len(keep):
        return
    group, row, of = run[keep].astype(np.uint64), keep, run[keep]
    if "sub" in c:
        m = c["sub"].shape[1]
        group = mix((np.repeat(group, m) * np.uint64(m) + np.tile(np.arange(m, dtype=np.uint64), len(keep))) * np.uint64(0x9E3779B97F4A7C15) + c["sub"][keep].ravel().astype(np.uint64))
        row, of = np.repeat(keep, m), np.repeat(of, m)
    o = np.argsort(group, kind="stable")
    group, row, of = group[o], row[o], of[o]
    # a run whose groups hold about as many pairs as the run itself is compared without them
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    n = np.diff(np.r_[first, len(group)]).astype(np.float64)
    met = np.bincount(of[first], weights=n * (n - 1), minlength=len(size))
    dense = np.flatnonzero((size >= _DENSE_ROWS) & (met >= 0.5 * size * (size - 1.0)))
    if len(dense):
        begin = np.flatnonzero(start)
        for r in dense:
            yield from _dense(c, np.arange(begin[r], begin[r] + size[r]), threshold, sided)
        left = ~np.isin(of, dense)
        group, row = group[left], row[left]
    yield from _by_groups(c, group, row, threshold, sided)


def _distinct_ids(ids: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    x, y = (ids[np.concatenate(p)] for p in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 2
    l, r = np.minimum(x, y), np.maximum(x, y)
    o = np.lexsort((r, l))
    l, r = l[o], r[o]
    new = np.ones(len(l), bool)
    new[1:] = (l[1:] != l[:-1]) | (r[1:] != r[:-1])
    return pa.RecordBatch.from_arrays([pa.array(l[new], pa.int64()), pa.array(r[new], pa.int64())], names=["l", "r"])


def _match(threshold: float, sided: bool, sub_width: int):
    def columns(b: pa.RecordBatch) -> dict[str, np.ndarray]:
        c = {k: np.asarray(b.column(k)) for k in ("key", "bi", "bj", "mine", "id", "n", *(["side"] if sided else []))}
        c["bits"] = np.asarray(b.column("bits")).view(np.uint64)
        if sub_width:
            c["sub"] = np.frombuffer(b"".join(b.column("sub").to_pylist()), np.uint32).reshape(b.num_rows, sub_width)
        return c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[str, np.ndarray]] = []

        def out(parts: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            c = parts[0] if len(parts) == 1 else {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            held, n = [], 0
            for x, y in _pairs_in_runs(c, threshold, sided):
                held.append((x, y))
                n += len(x)
                if n >= _CHUNK:
                    yield _distinct_ids(c["id"], held)
                    held, n = [], 0
            yield _distinct_ids(c["id"], held)

        for b in batches:
            if not b.num_rows:
                continue
            c = columns(b)
            starts = np.flatnonzero(_same_runs(c["key"], c["bi"], c["bj"]))
            if kept and all(kept[-1][k][-1] == c[k][0] for k in ("key", "bi", "bj")):
                starts = starts[1:]
            if len(starts):  # the last run that begins here may go on in the next batch
                cut = starts[-1]
                if kept or cut:
                    yield from out([*kept, {k: v[:cut] for k, v in c.items()}])
                kept = [{k: v[cut:] for k, v in c.items()}]
            else:
                kept.append(c)
        if kept:
            yield from out(kept)

    return run


def candidate_pairs(rows: DataFrame, keys_of: KeyFunction, threshold: float, *, sided: bool = False, sub_width: int = 0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Distinct pairs (l < r) of ids of rows (id BIGINT unique, words ARRAY<BIGINT> not empty, with sided also side INT)
    that share a key and may reach the threshold; with sided only pairs of different sides. rows is read several times, so
    it should be stored."""
    hot, split, blocks = _hot_keys(rows, keys_of, hot_rows, bool(sub_width))
    schema = "key long, bi int, bj int, mine int, id long, bits long, n int" + ", side int" * sided + ", sub binary" * bool(sub_width)
    keyed = rows.mapInArrow(_emit(keys_of, hot, split, blocks, sided), schema)
    met = keyed.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj")
    return met.mapInArrow(_match(threshold, sided, sub_width), "l long, r long").distinct()


def likeness(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """pairs with shared, n_l, n_r and likeness, from the whole word sets."""
    sets = rows.select("id", "words")
    both = pairs.join(sets.toDF("l", "a"), "l").join(sets.toDF("r", "b"), "r")
    shared = F.size(F.array_intersect("a", "b"))
    return both.select("l", "r", shared.alias("shared"), F.size("a").alias("n_l"), F.size("b").alias("n_r")).withColumn("likeness", F.col("shared") / (F.col("n_l") + F.col("n_r") - F.col("shared")))


def with_representative(rows: DataFrame, reps: DataFrame, on: list[str], hot_copies: int = HOT_COPIES) -> DataFrame:
    """rows joined with reps (on, rep, n), where n rows have each key. Keys of more than hot_copies rows, of which there are
    at most (all rows) / hot_copies, are sent to the tasks, so their rows are not shuffled to one."""
    hot = F.broadcast(reps.where(F.col("n") > hot_copies).drop("n"))
    rest = rows.join(hot.select(*on), on, "left_anti").join(reps.where(F.col("n") <= hot_copies).drop("n"), on)
    return rest.unionByName(rows.join(hot, on))
