"""The search service as a library: validation, retrieval, reranking, results; a transport can call it in-process."""

from __future__ import annotations

import time
from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremlake.functions.declarations import result_text
from theoremlake.operators import embed, rerank, search
from theoremlake.operators.enrich import stats
from theoremlake.plans.scratch import written
from theoremlake.streaming.ratelimit import decide

MAX_LIMIT = 50
FIELDS = ("name", "kind", "type_signature", "statement", "docstring", "module_path", "library", "file_path", "line_number", "github_url", "chapter")


class Rejected(ValueError):
    """A request that is not served; status as in HTTP."""

    def __init__(self, status: int, detail: str) -> None:
        super().__init__(detail)
        self.status = status


@dataclass
class Service:
    """points: canonical declarations with id and search_text (operators.index.to_points), stored. With an embedder the
    points' stored vectors, dense, are searched (operators.index.Index with the same one); without, texts are hashed."""

    points: DataFrame
    collection: str = "declarations"
    mode: str = "auto"
    fusion: bool = False
    rate_limit: int = 60
    window_seconds: float = 60.0
    embedder: embed.Embedder | None = None
    _calls: dict[str, deque] = field(default_factory=dict)
    _weights: DataFrame | None = None

    def health(self) -> dict:
        return {"status": "ok", "collection": self.collection}

    def admit(self, client: str | None, now: float | None = None) -> None:
        """Rejected(429) beyond the rate limit."""
        at = int((time.time() if now is None else now) * 1e6)
        if not decide(self._calls.setdefault(client or "unknown", deque()), at, self.rate_limit, int(self.window_seconds * 1e6)):
            raise Rejected(429, "rate limit exceeded")

    def retrieve(self, queries: DataFrame, pool: int, lib: str | None = None, kind: str | None = None, chapter: str | None = None) -> DataFrame:
        """(query_id, id, score, rank) for queries (id, text): filtered, then dense or fused."""
        rows = self.points.where(search.facet_filter(library=lib, kind=kind, chapter=chapter))
        keyed = rows.select(F.col("id").cast("string").alias("point"), F.xxhash64(F.col("id").cast("string")).alias("id"), F.col("search_text").alias("v"))
        if self.embedder is None:
            dense = search.dense_topk(queries.select("id", F.col("text").alias("v")), keyed.select("id", "v"), pool, vectors=embed.hash_vectors())
        else:
            asked = queries.select("id", "text").collect()  # a stated query set
            vectors = self.embedder.embed([r.text or "" for r in asked])
            q = queries.sparkSession.createDataFrame([(r.id, v) for r, v in zip(asked, vectors, strict=True)], "id long, v array<float>")
            stored = rows.select(F.xxhash64(F.col("id").cast("string")).alias("id"), F.col("dense").alias("v"))
            dense = search.dense_topk(q, stored, pool, vectors=search.array_vectors(self.embedder.dim))
        if not self.fusion:
            return dense
        from theoremlake.functions.declarations import sparse_text

        texts = lambda df: df.select(F.xxhash64(F.col("id").cast("string")).alias("id"), sparse_text().alias("text"))
        if self._weights is None:  # of the whole collection, once
            self._weights = written(search.idf(search.postings(texts(self.points)), self.points.count()), "idf")
        return search.fuse(dense, search.sparse_topk(queries, texts(rows), self._weights, pool), pool)

    def search(self, q: str, limit: int = 10, lib: str | None = None, kind: str | None = None, chapter: str | None = None, client: str | None = None) -> dict:
        """The reply to one query; W8: Rejected(400) for a blank query, Rejected(422) for a limit outside 1 to 50,
        Rejected(503) if the index fails."""
        self.admit(client)
        if not q or not q.strip():
            raise Rejected(400, "empty query")
        if not 1 <= limit <= MAX_LIMIT:
            raise Rejected(422, f"limit must be 1 to {MAX_LIMIT}")
        began, mode = time.time(), self.mode.strip().lower()
        spark = self.points.sparkSession
        query = spark.createDataFrame([(0, q)], "id long, text string")
        try:
            return self._reply(q, query, limit, mode, began, lib, kind, chapter)
        except Exception as e:
            raise Rejected(503, "search is not available") from e

    def _reply(self, q: str, query: DataFrame, limit: int, mode: str, began: float, lib: str | None, kind: str | None, chapter: str | None) -> dict:
        hits = self.retrieve(query, search.candidate_pool(limit, mode in rerank.PASSTHROUGH), lib, kind, chapter)
        payload = self.points.withColumn("_k", F.xxhash64(F.col("id").cast("string"))).select(*FIELDS, "_k")
        full = payload.join(F.broadcast(hits), F.col("_k") == F.col("id")).withColumn("query", F.lit(q)).drop("_k")
        ranked = rerank.rerank(written(full, "hits"), limit, mode)
        shown = ranked.orderBy("rank").select(*FIELDS, F.round("display_score", 4).alias("score")).collect()
        return {"query": q, "results": [r.asDict() for r in shown], "total": len(shown), "elapsed_ms": round((time.time() - began) * 1000, 1)}

    def stats(self) -> dict:
        r = stats(self.points).first()
        return {"total_points": r.total_points, "libraries": dict(sorted(r.libraries.items())), "kinds": dict(sorted(r.kinds.items()))}

    def search_text(self, q: str, limit: int = 10, lib: str | None = None, kind: str | None = None) -> str:
        """The agent tool: results as text; the limit is brought into its bounds."""
        found = self.search(q, max(1, min(MAX_LIMIT, limit)), lib, kind)["results"]
        if not found:
            return f"No results for {q!r}."
        rows = self.points.sparkSession.createDataFrame([(i, *(r[c] for c in FIELDS), r["score"]) for i, r in enumerate(found)], "i int, " + ", ".join(f"{c} {'long' if c == 'line_number' else 'string'}" for c in FIELDS) + ", score double")
        return "\n\n".join(x.t for x in rows.orderBy("i").select(result_text(F.col("score")).alias("t")).collect())
