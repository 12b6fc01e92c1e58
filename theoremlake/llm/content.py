"""Words, bound variables and canonical forms of declaration contents, shared by problems 2 to 4.

The content of a declaration is its statement, or its type signature where the statement is null or blank; with
neither there is none. A word is a longest run of letters, digits, `_` and `'`; words compare without case.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[\w']+")
_TOKEN = re.compile(r"[\w']+|\S")
#: `(a b : T)`: names before a colon that is no `:=`, `::` or `:>`.
_BINDER = re.compile(r"\(\s*([\w'\s]+?)\s*:(?![:=>])")
_QUANTIFIED = re.compile(r"(?:(?<![\w'])exists(?![\w'])|∃)\s*([\w'][\w'\s]*)")
_FUNCTION = re.compile(r"(?<![\w'])fun(?![\w'])\s*([\w'][\w'\s]*)")
#: ASCII and Unicode spellings of one symbol (fixed values); longer ones first.
SYMBOLS = (("->", "→"), ("/\\", "∧"), ("<=", "≤"), (">=", "≥"), ("<>", "≠"))
SYMBOL_WORDS = {"forall": "∀", "exists": "∃"}
_MEMO_WORDS = 1 << 20

#: Spellings of the three splits (fixed values), trimmed and in lower case.
SPLIT_NAMES = {
    "train": ("train", "training"),
    "validation": ("validation", "valid", "val", "dev", "development"),
    "test": ("test", "testing"),
}


def split_kind(split: Column) -> Column:
    """train, validation or test, however spelt; null for null, blank and unknown ones."""
    s = F.lower(F.regexp_replace(split, r"(?U)^\s+|\s+$", ""))
    out = F.lit(None).cast("string")
    for kind, names in SPLIT_NAMES.items():
        out = F.when(s.isin(*names), kind).otherwise(out)
    return out


def content_of(statement: str | None, type_signature: str | None) -> tuple[str | None, bool]:
    """The content, and whether it is a statement."""
    if statement is not None and statement.strip():
        return statement, True
    if type_signature is not None and type_signature.strip():
        return type_signature, False
    return None, False


def bound_variables(content: str) -> set[str]:
    """The names bound before the colon in `(a b : T)`, after `exists` or `∃`, and after `fun`."""
    out: set[str] = set()
    for pattern in (_BINDER, _QUANTIFIED, _FUNCTION):
        for names in pattern.findall(content):
            out.update(names.split())
    return out


def word_set(content: str) -> list[str]:
    return list({w.lower() for w in WORD.findall(content)})


def free_word_set(content: str, is_statement: bool) -> list[str]:
    """The words without bound variables and, in a statement, without its first two words (keyword and name)."""
    bound = bound_variables(content)
    return list({w.lower() for w in WORD.findall(content)[2 if is_statement else 0 :] if w not in bound})


def canonical_content(content: str, is_statement: bool) -> str:
    """A spelling that contents share if they differ at most in leading keyword, declared name and the colon after it,
    consistent naming of bound variables, white space, final full stop and ASCII or Unicode symbols."""
    for ascii_, symbol in SYMBOLS:
        content = content.replace(ascii_, symbol)
    tokens = _TOKEN.findall(content)
    if tokens and tokens[-1] == ".":
        tokens.pop()
    if is_statement:
        words = [i for i, t in enumerate(tokens) if WORD.match(t)][:2]
        if len(words) == 2:
            tokens = tokens[words[1] + 1 :]
            if tokens[:1] == [":"] and tokens[1:2] != ["="]:
                tokens = tokens[1:]
    bound, names = bound_variables(content), {}
    return " ".join(names.setdefault(t, f"#{len(names)}") if t in bound else SYMBOL_WORDS.get(t, t) for t in tokens)


class Hasher:
    """64-bit hashes of words; remembers a bounded number of them."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > _MEMO_WORDS:
            memo.clear()
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = memo.get(w)
            if h is None:
                h = memo[w] = xxhash.xxh3_64_intdigest(w)
            out[i] = h
        out.sort()
        return out
