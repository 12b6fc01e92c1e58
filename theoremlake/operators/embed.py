"""Embedders (M1-M6): a registry of factories whose products turn texts into vectors."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


HASH_DIM = 384
#: Words that transformer embedders read of a text; theirs is a limit of the model, the hash embedder has none.
MODEL_TOKENS = 512


class Embedder(Protocol):
    """M1."""

    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class _Buckets(dict):
    def __init__(self, dim: int) -> None:
        self.dim = dim

    def __missing__(self, token: str) -> int:
        b = self[token] = int.from_bytes(hashlib.sha256(token.encode()).digest()[:4], "big") % self.dim
        if len(self) > 1 << 20:
            self.clear()
        return b


class HashEmbedder:
    """Counts of hashed tokens; embed() scales them to length 1, a text without tokens stays zero."""

    _space = re.compile(r"\s+")

    def __init__(self, dim: int = HASH_DIM) -> None:
        self.dim, self._bucket = dim, _Buckets(dim)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            tokens = (t or "").lower().replace("_", " ").split()
            if tokens:
                out[i] = np.bincount([self._bucket[x] for x in tokens], minlength=self.dim)
        return out

    def embed(self, texts: list[str]) -> list[list[float]]:
        c = self.counts(texts)
        n = np.sqrt((c * c).sum(1, keepdims=True))
        return (c / np.where(n == 0, 1, n)).tolist()


def _local(model: str = "sentence-transformers/all-MiniLM-L6-v2") -> Embedder:
    """M3: a local transformer, if its library is installed."""
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError as e:
        raise RuntimeError("the local embedder needs the package sentence-transformers") from e
    m = SentenceTransformer(model)
    m.max_seq_length = MODEL_TOKENS

    class Local:
        dim = m.get_sentence_embedding_dimension()

        def embed(self, texts: list[str]) -> list[list[float]]:
            return m.encode(texts, normalize_embeddings=True).tolist()

    return Local()


def _onnx(model: str = "sentence-transformers/all-MiniLM-L6-v2") -> Embedder:
    """M4: an ONNX model, if its library is installed; the dimension is probed."""
    try:
        from fastembed import TextEmbedding
    except ImportError as e:
        raise RuntimeError("the onnx embedder needs the package fastembed") from e
    m = TextEmbedding(model)

    class Onnx:
        dim = len(next(iter(m.embed(["probe"]))))

        def embed(self, texts: list[str]) -> list[list[float]]:
            return [v.tolist() for v in m.embed(texts)]

    return Onnx()


def _hosted(model: str = "text-embedding-3-small") -> Embedder:
    """M5: a hosted service; needs a key and a network."""
    if not os.environ.get("OPENAI_API_KEY"):
        raise RuntimeError("the hosted embedder needs OPENAI_API_KEY")
    try:
        from openai import OpenAI
    except ImportError as e:
        raise RuntimeError("the hosted embedder needs the package openai") from e
    client = OpenAI()

    class Hosted:
        dim = 1536 if model.endswith("small") else 3072

        def embed(self, texts: list[str]) -> list[list[float]]:
            return [d.embedding for d in client.embeddings.create(model=model, input=texts).data]

    return Hosted()


REGISTRY: dict[str, Callable[..., Embedder]] = {"hash": HashEmbedder, "fastembed": _onnx, "openai": _hosted, "local": _local}


def make_embedder(name: str, **options) -> Embedder:
    """M6: unknown names mean the local transformer."""
    return REGISTRY.get(name, _local)(**options)


def hash_vectors(dim: int = HASH_DIM) -> Callable[[pa.RecordBatch], np.ndarray]:
    """Matrix of token counts of a string column v, for dense_topk; cosines need no scaling."""
    made: list[HashEmbedder] = []

    def vectors(b: pa.RecordBatch) -> np.ndarray:
        if not made:
            made.append(HashEmbedder(dim))
        return made[0].counts(b.column("v").to_pylist())

    return vectors


def embed_column(df: DataFrame, text_col: str, factory: Callable[[], Embedder], out_col: str = "dense", batch: int = 64) -> DataFrame:
    """df with a vector of text_col by any embedder, made once in each task and fed in batches."""
    from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(out_col, ArrayType(FloatType()))])

    def run(batches):
        e = factory()
        for b in batches:
            texts, out = b.column(text_col).to_pylist(), []
            for i in range(0, len(texts), batch):
                out += e.embed([t or "" for t in texts[i : i + batch]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32()))], names=[*b.schema.names, out_col])

    return df.mapInArrow(run, schema)


def bucket_counts(texts: DataFrame, dim: int = HASH_DIM, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """F12, F13 in sparse form: (id, bucket, tf) for each row of texts; null and empty texts have no rows."""

    def run(batches):
        e = HashEmbedder(dim)
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                b = whole.slice(start, 2048)
                c = e.counts(b.column("text").to_pylist())
                row, bucket = np.nonzero(c)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array(bucket.astype(np.int32)), pa.array(c[row, bucket].astype(np.int64))], names=["id", "bucket", "tf"])

    return texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, bucket int, tf long")
