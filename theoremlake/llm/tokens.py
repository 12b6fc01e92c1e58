"""Encoding of texts with a public tokenizer (problem 6).

Long texts are cut into pieces that are encoded in parallel; the pieces' ids are then joined in a tree: around each
join a window is encoded again, and grown until both sides agree exactly. Vocabulary files stay where they are;
every worker loads them once.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: GPT-2 style pre-token pattern that belongs to the byte_bpe_50k vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points of a piece; texts beyond it are cut, encoded in parallel and joined.
PIECE_CHARS = 8192


class Codec:
    """A byte-level BPE vocabulary with exact joins of neighbouring encodings."""

    def __init__(self, path: str, pattern: str = PATTERN) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.encoding.encode_ordinary
        self.token_bytes = self.encoding.decode_single_token_bytes

    @staticmethod
    def _kind(c: str) -> str:
        return "L" if c.isalpha() else "N" if c.isnumeric() else "S" if c.isspace() else "O"

    def _inside_one_run(self, text: str) -> bool:
        """Whether text, its first and last two characters included, lies inside one letter, digit or sign run of ASCII."""
        return text.isascii() and (text.isalpha() or text.isdigit() or all(33 <= ord(c) < 127 and not c.isalnum() for c in text))

    def join(self, left: list[int], right: list[int], window: int = 8) -> list[int]:
        """The ids of the joined text, from the ids of its two parts.

        An anchor is a token border at which old and new ids meet and that no context can move: a place between a
        sign and white space, or one inside a run of one kind where the first (last) window token is the old one; a
        window that reaches the end of a part needs no anchor there. Without anchors on both sides it doubles."""
        if not left or not right:
            return left or right
        while True:
            k, m = min(window, len(left)), min(window, len(right))
            a, b = self._bytes(left[len(left) - k :]), self._bytes(right[:m])
            # whole characters only: a token may hold part of one
            try:
                text = (a + b).decode()
            except UnicodeDecodeError:
                if k == len(left) and m == len(right):
                    raise
                window *= 2
                continue
            new = self.encode(text)
            lo = 0 if k == len(left) else self._anchor(left[len(left) - k :], new, text, len(a), False)
            hi = 0 if m == len(right) else self._anchor(right[:m][::-1], new[::-1], text, len(b), True)
            if lo is not None and hi is not None:
                keep_left, new_left = (len(left) - k, 0) if k == len(left) else (len(left) - k + lo[0], lo[1])
                keep_right, new_right = (m, len(new)) if m == len(right) else (m - hi[0], len(new) - hi[1])
                if new_left <= new_right:
                    return left[:keep_left] + new[new_left:new_right] + right[keep_right:]
            window *= 2

    def _bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes, ids))

    def _anchor(self, old: list[int], new: list[int], text: str, limit: int, reverse: bool) -> tuple[int, int] | None:
        """(old tokens, new tokens) before the anchor, counted from the outer end of the window; None if there is none."""
        whole = text.encode()
        ends, at = {}, 0
        for i, t in enumerate(new):
            at += len(self.token_bytes(t))
            ends[at] = i + 1
        best, at = None, 0
        for i, t in enumerate(old):
            at += len(self.token_bytes(t))
            if at > limit:
                break
            if at in ends:
                p = len(whole) - at if reverse else at
                if 0 < p < len(whole) and whole[p : p + 1] in (b" ", b"\n") and 33 <= whole[p - 1] < 127:
                    best = best or (i + 1, ends[at])
        # two characters on this side of the join: a contraction such as 'll was then seen whole
        if best is None and old and new and limit >= 2 and old[0] == new[0] and self._inside_one_run(text):
            best = (1, 1)
        return best

    def join_all(self, parts: list[list[int]]) -> list[int]:
        """Pairs of neighbours, then pairs of pairs, until one is left."""
        while len(parts) > 1:
            parts = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []


@functools.cache
def codec(path: str, pattern: str = PATTERN) -> Codec:
    return Codec(path, pattern)


def _encoder(path: str, keep: list[str], counts: bool, rows: int = 256):
    """mapInArrow function: the columns keep, and ids (or n_tokens) of the column text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        c = codec(path)
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                b = whole.slice(start, rows)
                arrays = [np.asarray(c.encode(t), np.int32) if t else np.empty(0, np.int32) for t in b.column("text").to_pylist()]
                sizes = np.fromiter(map(len, arrays), np.int32, len(arrays))
                if counts:
                    out, name = pa.array(sizes.astype(np.int64)), "n_tokens"
                else:
                    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    out, name = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32))), "ids"
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), out], names=[*keep, name])

    return run


def encode_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocabulary: str = DEFAULT_VOCABULARY, piece_chars: int = PIECE_CHARS, counts: bool = False) -> DataFrame:
    """One row for each row of df: id_col and ids ARRAY<INT> (with counts, n_tokens BIGINT instead).

    Null and empty texts give the empty list; a null id stays null; rows that occur twice come out twice; what looks
    like a special token is ordinary text. Other columns of df are dropped, whatever their names. A text of more than
    piece_chars code points is cut, its pieces are encoded by different tasks and joined exactly; no text is cut
    short. Pieces of one text meet in one task, as the text itself did before."""
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.char_length("text"), F.lit(0)) > piece_chars
    value = "n_tokens long" if counts else "ids array<int>"
    short = src.filter(~long).mapInArrow(_encoder(vocabulary, ["id"], counts), f"id long, {value}")
    pieces = (
        src.filter(long)
        .groupBy("id", F.sha2("text", 256).alias("sha"))
        .agg(F.count("*").alias("copies"), F.first("text").alias("whole"))
        .select("id", "sha", "copies", "whole", F.explode(F.sequence(F.lit(0), F.floor((F.char_length("whole") - 1) / piece_chars))).alias("part"))
        .select("id", "sha", "copies", "part", F.expr(f"substring(whole, cast(part * {piece_chars} + 1 as int), {piece_chars})").alias("text"))
    )
    # pieces of one text go to different tasks
    spread = pieces.repartition("sha", "part")
    encoded = spread.mapInArrow(_encoder(vocabulary, ["id", "sha", "copies", "part"], False), "id long, sha string, copies long, part long, ids array<int>")

    def combine(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")
        ids = codec(vocabulary).join_all(t.column("ids").to_pylist())
        n = t.column("copies")[0].as_py()
        out = pa.array([len(ids)] * n, pa.int64()) if counts else pa.array([ids] * n, pa.list_(pa.int32()))
        return pa.table({"id": pa.array([t.column("id")[0].as_py()] * n, pa.int64()), value.split()[0]: out})

    joined = encoded.groupBy("id", "sha").applyInArrow(combine, f"id long, {value}")
    return short.unionByName(joined).withColumnRenamed("id", id_col)
