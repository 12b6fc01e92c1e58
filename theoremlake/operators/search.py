"""Retrieval: dense, sparse and fused top-k, with filters applied before ranking.

Queries are a stated set that is sent to all tasks in blocks of bounded size; points are scanned once for each block
and never shuffled: a task keeps the best k of each query, and only those meet.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from theoremlake.functions.text import WORD

#: Queries that are sent to the tasks at once.
QUERY_BLOCK = 4096
#: Candidates that a reranking mode retrieves at least.
POOL = 40


def facet_filter(**facets: str | None) -> Column:
    """Each value is a comma list, any of which may match; all facets must. Blank means no filter, only commas none."""
    out = F.lit(True)
    for name, value in facets.items():
        if isinstance(value, str) and value.strip():
            terms = [x.strip() for x in value.split(",") if x.strip()]
            out = out & (F.col(name).isin(*terms) if terms else F.lit(False))
    return out


def candidate_pool(limit: int, passthrough: bool = False, pool: int = POOL) -> int:
    """T1."""
    return limit if passthrough else max(limit, pool)


def top_by(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, ranked from 1; partial top-k before the shuffle comes from the planner."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def _first(k: int, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of parallel arrays the k of each row with the highest scores, ties by id."""
    o = np.lexsort((ids, -score, row))
    row, ids, score = row[o], ids[o], score[o]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    keep = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)])) < k
    return row[keep], ids[keep], score[keep]


def _block_best(query_ids, scores: Callable[[pa.RecordBatch], np.ndarray], k: int, rows: int = 1024):
    """mapInArrow function over points: each task's best k for each query. scores gives a (query, point) matrix for a batch;
    points with -inf are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                s, x_ids = scores(b), np.asarray(b.column("id"))
                n = s.shape[1]
                kth = np.partition(s, n - k, axis=1)[:, n - k, None] if n > k else np.full((len(s), 1), -np.inf)
                row, column = np.nonzero((s >= kth) & (s > -np.inf))
                best = _first(k, *(np.concatenate(p) for p in zip(best, (row, x_ids[column], s[row, column]), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(query_ids.value[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "id", "score"])

    return run


def _in_blocks(queries: DataFrame, block: int) -> Iterator[DataFrame]:
    """queries (id, ...) in parts of about block rows."""
    parts = max(1, -(-queries.count() // block))
    for n in range(parts):
        yield queries if parts == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == n)


def _merged(parts: list[DataFrame], spark, k: int) -> DataFrame:
    out = spark.createDataFrame([], "query_id long, id long, score double")
    for p in parts:
        out = out.unionByName(p)
    return top_by(out, ["query_id"], [F.desc("score"), F.asc("id")], k)


def dense_topk(queries: DataFrame, points: DataFrame, k: int, *, vectors: Callable[[pa.RecordBatch], np.ndarray], digits: int = 6, skip_self: bool = False, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): the k points of the highest cosine for each query.

    queries (id, v) and points (id, v) are turned into rows of a matrix by `vectors`; scores are rounded, ties go by id.
    A zero vector has cosine 0. Empty tables give an empty result. Ids must not be null."""
    spark, parts = points.sparkSession, []
    for part in _in_blocks(queries, block):
        found = part.toArrow().combine_chunks().to_batches()
        if not found:
            continue
        ids = spark.sparkContext.broadcast(np.asarray(found[0].column("id")))
        q = spark.sparkContext.broadcast(vectors(found[0]))

        def scores(b: pa.RecordBatch, q=q, ids=ids) -> np.ndarray:
            x = vectors(b)
            norms = np.outer(np.sqrt((q.value * q.value).sum(1)), np.sqrt((x * x).sum(1)))
            with np.errstate(divide="ignore", invalid="ignore"):
                s = np.round((q.value @ x.T) / norms, digits)
            s[~np.isfinite(s)] = 0.0  # a zero vector is like nothing
            if skip_self:
                s[ids.value[:, None] == np.asarray(b.column("id"))] = -np.inf
            return s

        parts.append(points.select("id", "v").mapInArrow(_block_best(ids, scores, k), "query_id long, id long, score double"))
    return _merged(parts, spark, k)


def array_vectors(dim: int) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Matrix of an array<float> column v; rows of another length, with nulls or NaN count as zero vectors."""

    def vectors(b: pa.RecordBatch) -> np.ndarray:
        a = b.column("v")
        rows = np.flatnonzero(np.asarray(a.value_lengths().fill_null(-1)) == dim)
        x = np.asarray(a.take(pa.array(rows)).flatten().cast(pa.float64()).fill_null(float("nan"))).reshape(-1, dim)
        whole = ~np.isnan(x).any(1)
        out = np.zeros((b.num_rows, dim))
        out[rows[whole]] = x[whole]
        return out

    return vectors


class _TokenIds(dict):
    """A word's token numbers; each distinct word is split and hashed once in a task."""

    _camel = re.compile("[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 1 << 20:
            self.clear()
        low = word.lower()
        parts = [low, *(p for p in map(str.lower, self._camel.findall(word)) if p != low)]
        ids = self[word] = tuple(int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "big") % 2**31 for t in parts if len(t) >= 2)
        return ids


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, word = _TokenIds(), re.compile(WORD)
    for b in batches:
        sizes, tokens, counts = [], [], []
        for t in b.column("text").to_pylist():
            c = Counter(i for w in word.findall(t) for i in memo[w]) if t else {}
            sizes.append(len(c))
            tokens += c.keys()
            counts += c.values()
        at = pa.array(np.repeat(np.arange(b.num_rows), sizes))
        yield pa.RecordBatch.from_arrays([b.column("id").take(at), pa.array(tokens, pa.int64()), pa.array(counts, pa.int64())], names=["id", "token_id", "tf"])


def postings(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, token_id, tf) for each row of texts; tokens whose numbers collide count as one.

    The tokens are those of functions.text.identifier_tokens; as words repeat, a table of the words met makes this several
    times faster than hashing every occurrence in the JVM, and nothing is shuffled. Null and empty texts have no rows."""
    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_count_tokens, "id long, token_id long, tf long")


def idf(posts: DataFrame, total: int) -> DataFrame:
    """A5: (token_id, df, idf)."""
    n = F.col("df").cast("double")
    return posts.groupBy("token_id").agg(F.count("*").alias("df")).withColumn("idf", F.log((F.lit(float(total)) - n + 0.5) / (n + 0.5) + 1.0))


def sparse_topk(queries: DataFrame, points: DataFrame, weights: DataFrame, k: int, digits: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank) by the sum of query count, point count and weight over shared tokens.

    queries and points (id, text); weights (token_id, idf) as from idf(). Points that share no token don't come out. The
    queries' tokens are sent to the tasks and points scanned: a join would make a row for each point with a common word."""
    spark, parts = points.sparkSession, []
    for part in _in_blocks(queries, block):
        tokens = postings(part).toPandas()
        if not len(tokens):
            continue
        wanted = spark.createDataFrame([(int(t),) for t in tokens["token_id"].unique()], "token_id long")
        known = {r.token_id: r.idf for r in weights.join(F.broadcast(wanted), "token_id", "left_semi").select("token_id", "idf").toLocalIterator()}
        tokens = tokens[tokens["token_id"].isin(known)]
        columns = {t: i for i, t in enumerate(sorted(known))}
        q_ids, row = np.unique(tokens["id"].to_numpy(), return_inverse=True)
        # the queries of each token and what the token is worth there, token by token
        column = np.array([columns[t] for t in tokens["token_id"]], np.int64)
        worth = tokens["tf"].to_numpy() * np.array([known[t] for t in tokens["token_id"]])
        o = np.argsort(column, kind="stable")
        start = np.searchsorted(column[o], np.arange(len(columns) + 1))
        ids, sent = spark.sparkContext.broadcast(q_ids), spark.sparkContext.broadcast((columns, start, row[o], worth[o]))
        memo: list[_TokenIds] = []

        def scores(b: pa.RecordBatch, sent=sent, ids=ids, memo=memo) -> np.ndarray:
            columns, start, row, worth = sent.value
            memo or memo.append(_TokenIds())
            word, point, met = re.compile(WORD), [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                at = [c for w in word.findall(t) for j in memo[0][w] if (c := columns.get(j)) is not None] if t else []
                met += at
                point += [i] * len(at)
            # every token met with every query that has it
            met, point = np.array(met, np.int64), np.array(point, np.int64)
            n = start[met + 1] - start[met]
            at = np.arange(n.sum()) + np.repeat(start[met] - np.cumsum(n) + n, n)
            s = np.bincount(row[at] * b.num_rows + np.repeat(point, n), weights=worth[at], minlength=len(ids.value) * b.num_rows).astype(np.float64).reshape(-1, b.num_rows)
            s = np.round(s, digits)
            s[s <= 0] = -np.inf
            return s

        parts.append(points.select("id", "text").mapInArrow(_block_best(ids, scores, k, 512), "query_id long, id long, score double"))
    return _merged(parts, spark, k)


def fuse(dense: DataFrame, sparse: DataFrame, k: int, constant: int = 2, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank) by the sum of 1 / (constant + rank from 0) over both lists."""
    both = dense.select("query_id", "id", "rank").unionByName(sparse.select("query_id", "id", "rank"))
    score = F.round(F.sum(1.0 / (constant + F.col("rank") - 1)), digits)
    return top_by(both.groupBy("query_id", "id").agg(score.alias("score")), ["query_id"], [F.desc("score"), F.asc("id")], k)
