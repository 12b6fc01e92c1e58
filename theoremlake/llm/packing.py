"""Filling containers of fixed capacity (problem 7).

Sizes are whole numbers up to the capacity, so the instance is a histogram of at most `capacity` numbers however many
documents there are. The driver solves the histogram: dominance reduction after Martello and Toth fixes sets of up to
three items that dominate all other sets with their largest item, best fit in decreasing order packs the rest. Containers
of one make-up are handled as a group with a multiplicity, so the steps depend on the number of sizes only. The cluster
then ranks the items of each size and looks their container up.
"""

from __future__ import annotations

import bisect
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from theoremlake.plans.scratch import written

#: Ranks within one size are made in slices of about so many items, so that a size that a third of the items has is no
#: single task's.
SLICE_ROWS = 1_000_000

Pattern = tuple[tuple[int, int], ...]


class _Sizes:
    """The sizes of which items are left, with their counts, in order."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.sorted = sorted(self.count)

    def take(self, s: int, n: int) -> None:
        self.count[s] -= n
        if not self.count[s]:
            del self.count[s]
            self.sorted.pop(bisect.bisect_left(self.sorted, s))

    def largest(self, most: int) -> int | None:
        i = bisect.bisect_right(self.sorted, most)
        return self.sorted[i - 1] if i else None

    def smallest(self, k: int) -> list[int]:
        out: list[int] = []
        for s in self.sorted:
            out += [s] * min(k - len(out), self.count[s])
            if len(out) == k:
                break
        return out


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Groups of containers that may be fixed without loss, and the counts of the items left.

    A set with item j dominates another if the other's items beside j can be dealt to its own, those dealt to one being
    together no larger than it; then they can change places. For the items of each size j, from the largest, a set that
    dominates all that fit is fixed, as often as its items last: other items' going only takes alternatives away."""
    left, fixed = _Sizes(counts), []
    for j in sorted(left.count, reverse=True):
        while left.count.get(j, 0) > 0:
            beside = _Sizes(left.count)
            beside.take(j, 1)
            chosen = _dominating(beside, capacity - j)
            if chosen is None:
                break
            make_up = Counter((j, *chosen))
            m = min(left.count[s] // n for s, n in make_up.items())
            fixed.append((tuple(sorted(make_up.items(), reverse=True)), m))
            for s, n in make_up.items():
                left.take(s, n * m)
    return fixed, dict(left.count)


def _dominating(beside: _Sizes, room: int) -> tuple[int, ...] | None:
    """Up to two of the items beside that dominate all sets that fit into room; None if no such choice is known.

    The largest item k that fits dominates sets that are together no larger than it, so all if it fills the room or is
    alone; with b, the largest that fits beside k, it dominates the pairs of which one is no larger than b."""
    k, low = beside.largest(room), beside.smallest(3)
    if k is None:
        return ()
    if k == room or len(low) < 2 or low[0] + low[1] > room or (len(low) < 3 or sum(low) > room) and _best_pair(beside, room) <= k:
        return (k,)
    if len(low) == 3 and sum(low) <= room:
        return None
    beside.take(k, 1)
    b = beside.largest(room - k)
    beside.count[k] = beside.count.get(k, 0) + 1
    if b is None or _best_pair(beside, room, b) > k:
        return None
    return (k, b)


def _best_pair(left: _Sizes, room: int, above: int = 0) -> int:
    """The largest sum of two items, both larger than above, that is at most room; 0 if there is none."""
    sizes = left.sorted if len(left.sorted) == len(left.count) else sorted(left.count)
    a, b, best = bisect.bisect_right(sizes, above), len(sizes) - 1, 0
    while a <= b:
        x = sizes[a] + sizes[b]
        if x > room:
            b -= 1
        elif a == b and left.count[sizes[a]] < 2:
            break
        else:
            best, a = max(best, x), a + 1
    return best


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit over groups of containers of one make-up: each item, the largest first, goes where least room stays."""
    open_: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    room, done = [], []

    def put(pattern: Pattern, n: int, free: int) -> None:
        if free == 0:
            done.append((pattern, n))
            return
        if not open_[free]:
            bisect.insort(room, free)
        open_[free].append((pattern, n))

    for s in sorted(counts, reverse=True):
        todo = counts[s]
        while todo:
            i = bisect.bisect_left(room, s)
            if i == len(room):
                each = capacity // s
                full, rest = divmod(todo, each)
                if full:
                    put(((s, each),), full, capacity - each * s)
                if rest:
                    put(((s, rest),), 1, capacity - rest * s)
                break
            free = room[i]
            pattern, n = open_[free].pop()
            if not open_[free]:
                room.pop(i)
            each = free // s
            full, rest = divmod(todo, each)
            m = min(n, full)
            if m:
                put((*pattern, (s, each)), m, free - each * s)
            used = m
            if m < n and m == full and rest:
                put((*pattern, (s, rest)), 1, free - rest * s)
                used, todo = m + 1, todo - rest
            todo -= m * each
            if used < n:
                put(pattern, n - used, free)
    return done + [(p, n) for f in room for p, n in open_[f]]


def pack_histogram(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """(make-up of a container, how many containers have it), for all items of the histogram."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    merged: dict[Pattern, int] = defaultdict(int)
    for p, n in [*fixed, *best_fit_decreasing(rest, capacity)]:
        merged[p] += n
    return sorted(merged.items(), reverse=True)


def pack(sizes: DataFrame, capacity: int, id_col: str = "doc_id", size_col: str = "n_tokens", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Rows (id_col, piece, piece_start, piece_size, container_id): every item of sizes in a container.

    An item larger than capacity is cut into full containers and a rest (piece numbers its parts, piece_start is
    where a part begins); no other is cut. Items of size 0 or null need no room and get container_id null. Rows that
    occur twice are two items. Containers are numbered from 0 without gaps. An empty table gives no rows. Other columns
    are dropped. sizes is read three times, so it should be a stored table; the result for the same rows is the same."""
    spark = sizes.sparkSession
    n = F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    items = sizes.select(F.col(id_col).alias("id"), F.greatest(n, F.lit(0).cast("long")).alias("n")).select(
        "id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0).cast("long")))).alias("piece")
    )
    items = items.select("id", "piece", (F.col("piece") * capacity).alias("piece_start"), F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity).cast("long")).alias("piece_size"))
    # at most capacity rows, whatever the number of items
    counts = {r.piece_size: r["count"] for r in items.where("piece_size > 0").groupBy("piece_size").count().collect()}
    # an element for each size up to the capacity
    slices = F.array(*(F.lit(-(-counts.get(s, 1) // slice_rows)) for s in range(capacity + 1))) if any(c > slice_rows for c in counts.values()) else None
    number = F.lit(0) if slices is None else F.pmod(F.xxhash64("id", "piece"), F.get(slices, F.col("piece_size").cast("int")).cast("long")).cast("int")
    items = items.withColumn("slice", number)
    ranges, base, given = [], 0, defaultdict(int)
    for pattern, m in pack_histogram(counts, capacity):
        for s, k in pattern:
            ranges.append((s, given[s], given[s] + m * k, base, k))
            given[s] += m * k
        base += m
    range_df = spark.createDataFrame(ranges, "piece_size long, from_rank long, to_rank long, first_container long, each long")
    w = Window.partitionBy("piece_size", "slice").orderBy("id", "piece")
    ranked = items.where("piece_size > 0").withColumn("rank", (F.row_number().over(w) - 1).cast("long"))
    if slices is not None:
        # at most capacity + (all items) / slice_rows rows of 20 bytes
        found = items.where("piece_size > 0").groupBy("piece_size", "slice").count()
        offsets = found.withColumn("first_rank", F.sum("count").over(Window.partitionBy("piece_size").orderBy("slice")) - F.col("count")).drop("count")
        ranked = ranked.join(F.broadcast(offsets), ["piece_size", "slice"]).withColumn("rank", F.col("rank") + F.col("first_rank"))
    # bounded by the capacity: there are about two make-ups for each size, of a few sizes each; 40 bytes a row
    placed = ranked.join(F.broadcast(range_df), "piece_size").where("rank >= from_rank and rank < to_rank").select("id", "piece", "piece_start", "piece_size", (F.col("first_container") + F.floor((F.col("rank") - F.col("from_rank")) / F.col("each"))).cast("long").alias("container_id"))
    empty = items.where("piece_size = 0").select("id", "piece", "piece_start", "piece_size", F.lit(None).cast("long").alias("container_id"))
    return placed.unionByName(empty).withColumnRenamed("id", id_col)


def pack_documents(documents: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", **encode) -> DataFrame:
    """pack() over the token counts of texts; the texts are encoded once and the counts stored."""
    from theoremlake.llm.tokens import encode_texts

    return pack(written(encode_texts(documents, id_col, text_col, counts=True, **encode), "sizes"), capacity, id_col)
