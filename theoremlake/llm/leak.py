"""Evaluation texts that leak into training text (problem 1).

An item is a held-out text; its passages are all its runs of `window` words, or the whole item if it is shorter. Every
window of a corpus text that is as long as some passage gets a SimHash; blocks of the 64 bits are looked up in tables
of the passages' blocks. With one block more than the radius, two fingerprints within the radius agree in a block, so
none is missed. The shingles of candidate windows and passages are then compared exactly.

Items that stand in a text with small changes are looked for by windows as long as the item: a window of the wanted
likeness has at least one of a few pairs of neighbours of the item, and most of the item's pairs.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremlake.llm.pairs import mix

_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|<[!?][^<>]*>", re.S)
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE_CHARS = [chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf"]
_INVISIBLE = re.compile("[" + "".join(map(re.escape, _INVISIBLE_CHARS)) + "]+")
#: Passages that one pass over the corpus looks for; more are looked for in further passes.
PASSAGES_A_PASS = 200_000
#: Items that one pass over the corpus compares whole.
ITEMS_A_PASS = 20_000
#: Words of which windows are made at once.
_CHUNK = 1 << 15
_MEMO_WORDS = 1 << 20


def holds_any(text: str, parts: list[str] | tuple[str, ...]) -> bool:
    """Whether one of parts is in text; a plain loop, as a generator costs more than the search."""
    for p in parts:  # noqa: SIM110
        if p in text:
            return True
    return False


def visible(text: str) -> str:
    """text without format characters; looking for each is much faster than a pass of the pattern."""
    return _INVISIBLE.sub("", text) if not text.isascii() and holds_any(text, _INVISIBLE_CHARS) else text


def words_of(text: str) -> list[str]:
    """Runs of letters and digits; case, markup tags, character entities, compatibility forms and invisible characters
    make no difference."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", visible(text))
    return _WORD.findall(text.casefold())


class _Memo(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _sliding(bits: np.ndarray, size: int) -> np.ndarray:
    """Sums over all runs of size rows, from sums of runs of 1, 2, 4, ... rows."""
    n, power, total, at = len(bits) - size + 1, bits, None, 0
    step = 1
    while True:
        if size & step:
            part = power[at : at + n]
            total = part if total is None else total + part
            at += step
        step *= 2
        if step > size:
            return total
        power = power[: -(step // 2)] + power[step // 2 :]


def simhashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of each window of size words: a bit is 1 where more than half of the words' hashes have it."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    if size > 255:
        bits = bits.astype(np.int32)
    return np.packbits(_sliding(bits, size) > size // 2, axis=1).view(np.uint64).ravel()


def shingle_likeness(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    """Weighted likeness of two word runs: shared over all shingles, a word weighing 1, two words in order 2."""
    x, y = (Counter(w) + Counter({p: 2 * n for p, n in Counter(zip(w, w[1:], strict=False)).items()}) for w in (a, b))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


@dataclass
class Passages:
    """Passages of one length: item[i] holds words[i]; block tables of their fingerprints."""

    size: int
    item: np.ndarray
    words: np.ndarray
    radius: int

    def __post_init__(self) -> None:
        self.print = np.concatenate([simhashes(np.ascontiguousarray(w), self.size) for w in self.words])
        cuts = np.linspace(0, 64, self.radius + 2).astype(int)
        self.blocks = [(np.uint64(lo), np.uint64((1 << int(hi - lo)) - 1)) for lo, hi in zip(cuts, cuts[1:], strict=False)]
        self.tables = []
        for shift, mask in self.blocks:
            v = (self.print >> shift) & mask
            o = np.argsort(v, kind="stable")
            known = np.zeros(1 << 20, bool)  # a first look, by the low bits
            known[(v & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.tables.append((v[o], o, known))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, passage) of all fingerprints within the radius."""
        found = []
        for (shift, mask), (values, order, known) in zip(self.blocks, self.tables, strict=True):
            v = (prints >> shift) & mask
            w = np.flatnonzero(known[(v & np.uint64((1 << 20) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(values, v[w], "left"), np.searchsorted(values, v[w], "right")
            n = hi - lo
            w, at = np.repeat(w, n), np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            p = order[at]
            near = np.bitwise_count(prints[w] ^ self.print[p]) <= self.radius
            found.append(np.stack([w[near], p[near]], 1))
        both = np.unique(np.concatenate(found), axis=0)
        return both[:, 0], both[:, 1]


def _item_passages(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo()
        for b in batches:
            ids, out = [], []
            for i, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = [memo[x] for x in words_of(t)] if t and i is not None else []
                for at in range(len(w) - min(window, len(w)) + 1 if w else 0):
                    ids.append(i)
                    out.append(np.array(w[at : at + window], np.uint64).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["item_id", "words"])

    return run


def _scan(passages, min_likeness: float, rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, groups = _Memo(), passages.value
        names = ["corpus", "record_id", "item_id", "likeness", "same"]
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                if len(memo) > _MEMO_WORDS:
                    memo.clear()
                words = [words_of(t) if t else [] for t in b.column("text").to_pylist()]
                flat = np.fromiter(map(memo.__getitem__, (w for x in words for w in x)), np.uint64)
                record = np.repeat(np.arange(b.num_rows), [len(x) for x in words])
                found: dict[tuple[int, int], tuple[float, bool]] = {}
                for p in groups:
                    for lo in range(0, max(0, len(flat) - p.size + 1), _CHUNK):
                        part = flat[lo : lo + _CHUNK + p.size - 1]
                        w, k = p.candidates(simhashes(part, p.size))
                        w += lo
                        one = record[w] == record[w + p.size - 1]
                        for i, j in zip(w[one].tolist(), k[one].tolist(), strict=True):
                            here, there = flat[i : i + p.size], p.words[j]
                            same = bool((here == there).all())
                            like = 1.0 if same else shingle_likeness(tuple(here.tolist()), tuple(there.tolist()))
                            if like >= min_likeness:
                                key = (int(record[i]), int(p.item[j]))
                                best = found.get(key, (0.0, False))
                                found[key] = (max(best[0], like), best[1] or same)
                at = pa.array([k[0] for k in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("corpus").take(at), b.column("id").take(at), pa.array([k[1] for k in found], pa.int64()), pa.array([v[0] for v in found.values()], pa.float64()), pa.array([v[1] for v in found.values()], pa.bool_())], names=names
                )

    return run


def leaked_items(corpus: DataFrame, items: DataFrame, *, window: int = 8, radius: int = 2, min_likeness: float = 0.8, passages_a_pass: int = PASSAGES_A_PASS) -> DataFrame:
    """(corpus, record_id, item_id, likeness, same): for each record of corpus (corpus STRING, id BIGINT, text STRING) and
    item of items (id BIGINT, text STRING) that share a passage, the highest likeness of a window to a passage, and whether
    some passage stands in the record word for word. Fingerprints more than radius bits apart are not compared; equal
    passages never are. A record comes once for each row of corpus, so twice if it is stored twice.

    Null, empty and wordless texts and null item ids are in no pair; whole texts are read, however long; empty tables give
    an empty result. The items' passages are sent to all tasks, at most passages_a_pass at a time; a larger set of items
    takes more passes over the corpus."""
    spark = corpus.sparkSession
    each = items.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(_item_passages(window), "item_id long, words binary").distinct()
    out = spark.createDataFrame([], "corpus string, record_id long, item_id long, likeness double, same boolean")
    src = corpus.select(F.col("corpus").cast("string").alias("corpus"), F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    passes = -(-each.count() // passages_a_pass)
    for n in range(passes):
        mine = each if passes == 1 else each.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(passes)) == n)
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for r in mine.toLocalIterator():
            groups.setdefault(len(r.words) // 8, []).append((r.item_id, bytes(r.words)))
        tables = [Passages(size, np.array([i for i, _ in g], np.int64), np.frombuffer(b"".join(w for _, w in g), np.uint64).reshape(-1, size), radius) for size, g in sorted(groups.items())]
        out = out.unionByName(src.mapInArrow(_scan(spark.sparkContext.broadcast(tables), min_likeness), out.schema))
    return out if passes < 2 else out.groupBy("corpus", "record_id", "item_id").agg(F.max("likeness").alias("likeness"), F.max("same").alias("same"))


def _pairs_of(words: np.ndarray) -> np.ndarray:
    """A hash of each two neighbours."""
    return mix(words[:-1] + np.uint64(3) * words[1:])


class _Whole:
    """Items compared whole. Of an item of weight w a window of the likeness t lacks w * (1 - t) at most, and each pair that
    it lacks weighs 2; so it has one of any `lacking` + 1 pairs, here those that the fewest items have."""

    def __init__(self, items: list[tuple[int, bytes]], min_likeness: float) -> None:
        self.item = [i for i, _ in items]
        self.words = [np.frombuffer(w, np.uint64) for _, w in items]
        self.pairs = [np.unique(_pairs_of(w)) for w in self.words]
        self.lacking = [int((3 * len(w) - 2) * (1 - min_likeness) / 2 + 1e-9) for w in self.words]
        common, keyed = Counter(x for p in self.pairs for x in p.tolist()), []
        for n, p in enumerate(self.pairs):
            keyed += [(x, n) for x in sorted(p.tolist(), key=lambda x: (common[x], x))[: self.lacking[n] + 1]]
        keyed.sort()
        self.key, self.of = np.array([k for k, _ in keyed], np.uint64), np.array([n for _, n in keyed], np.int64)
        self.known = np.zeros(1 << 20, bool)  # a first look, by the low bits
        self.known[(self.key & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def likeness(self, text: np.ndarray, pairs: np.ndarray, n: int) -> float:
        """The highest likeness of a window of text (all of it, if it is shorter) to item n; 0 if it is surely below the wanted."""
        words, size = self.words[n], min(len(self.words[n]), len(text))
        has = np.concatenate([[0], np.cumsum(np.isin(pairs, self.pairs[n]))])
        starts = np.flatnonzero(has[size - 1 :] - has[: len(has) - size + 1] >= len(words) - 1 - self.lacking[n])
        return max((shingle_likeness(tuple(text[i : i + size].tolist()), tuple(words.tolist())) for i in starts.tolist()), default=0.0)

    def found(self, flat: np.ndarray, record: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(record, item number, likeness) of those that share a key; flat holds the words of the records one after the other."""
        pairs = _pairs_of(flat)
        at = np.flatnonzero(self.known[(pairs & np.uint64((1 << 20) - 1)).astype(np.int64)] & (record[:-1] == record[1:]))
        lo, hi = np.searchsorted(self.key, pairs[at], "left"), np.searchsorted(self.key, pairs[at], "right")
        n = hi - lo
        at, of = np.repeat(at, n), self.of[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        for r, k in np.unique(np.stack([record[at], of], 1), axis=0).tolist():
            i, j = np.searchsorted(record, [r, r + 1])
            if j - i > 1:
                yield r, k, self.likeness(flat[i:j], pairs[i : j - 1], k)


def _scan_whole(whole_items, min_likeness: float, rows: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, items = _Memo(), whole_items.value
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                if len(memo) > _MEMO_WORDS:
                    memo.clear()
                words = [words_of(t) if t else [] for t in b.column("text").to_pylist()]
                flat = np.fromiter(map(memo.__getitem__, (w for x in words for w in x)), np.uint64)
                record = np.repeat(np.arange(b.num_rows), [len(x) for x in words])
                found = [x for x in items.found(flat, record) if x[2] >= min_likeness] if len(flat) > 1 else []
                at = pa.array([x[0] for x in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column("corpus").take(at), b.column("id").take(at), pa.array([items.item[x[1]] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.float64())], names=["corpus", "record_id", "item_id", "likeness"]
                )

    return run


def near_items(corpus: DataFrame, items: DataFrame, *, min_likeness: float = 0.8, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """(corpus, record_id, item_id, likeness): for each record of corpus and item of two words or more, shaped as in
    leaked_items, the highest likeness of the item and a window of as many words, where it is min_likeness or more. None is
    missed. A text shorter than the item is one window. Nulls, empty texts and tables, and the passes are as there."""
    spark = corpus.sparkSession
    each = items.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(_item_passages(1 << 30), "item_id long, words binary").distinct().where(F.length("words") > 8)
    out = spark.createDataFrame([], "corpus string, record_id long, item_id long, likeness double")
    src = corpus.select(F.col("corpus").cast("string").alias("corpus"), F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    passes = -(-each.count() // items_a_pass)
    for n in range(passes):
        mine = each if passes == 1 else each.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(passes)) == n)
        table = _Whole([(r.item_id, bytes(r.words)) for r in mine.toLocalIterator()], min_likeness)
        out = out.unionByName(src.mapInArrow(_scan_whole(spark.sparkContext.broadcast(table), min_likeness), out.schema))
    return out
