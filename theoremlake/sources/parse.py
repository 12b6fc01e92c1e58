"""The declaration parser (P1-P8): source texts to declarations. Comments nest, so this is the one part that needs Python;
it reads (library, root, file_path, source_path, text) rows with mapInArrow, each file on its own.

Behaviour that may surprise is kept on purpose (SURVEY 2.2.1); strict=False mends what is evidently wrong: primes at the
end of names, and types that begin with the `=` of `:=`."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from theoremlake.functions.declarations import source_url

# Fixed value: the kinds of declarations, and the modifiers that may precede them.
KINDS = (
    "Theorem", "Lemma", "Remark", "Fact", "Corollary", "Proposition", "Definition", "Let", "Fixpoint", "CoFixpoint", "Inductive", "CoInductive", "Record",
    "Structure", "Class", "Instance", "Program Definition", "Program Fixpoint", "Program Instance",
)
MODIFIERS = ("Local", "Global", "Polymorphic", "Monomorphic", "Canonical")

_BY_LENGTH = sorted(KINDS, key=len, reverse=True)


def _head(name_end: str) -> re.Pattern[str]:
    modifiers = "|".join(rf"{m}\s+" for m in MODIFIERS)
    return re.compile(rf"^\s*(?:{modifiers})*(?P<kind>{'|'.join(map(re.escape, _BY_LENGTH))})\s+(?P<name>[A-Za-z_][A-Za-z0-9_']*){name_end}(?P<rest>.*)\.\s*$", re.S)


DECLARATION = _head(r"\b")
_DECLARATION_PRIMES = _head(r"(?![\w'])")
_MARK = re.compile(r'\(\*|\*\)|["\n.]')
_DOC = re.compile(r"\s*\(\*\*(.*)\*\)\s*", re.S)

SCHEMA = "name string, kind string, type_signature string, statement string, docstring string, module_path string, library string, file_path string, source_path string, line_number long, statement_no long"


class Statement(NamedTuple):
    text: str
    doc: str
    line: int


def compact(text: str) -> str:
    return " ".join(text.split())


def clean_doc(comment: str) -> str:
    """The text of a doc comment, without its marks and a star in front of each line, on one line."""
    m = _DOC.fullmatch(comment)
    lines = (line.strip() for line in (m.group(1) if m else comment).splitlines())
    return " ".join(x for x in (s[1:].strip() if s.startswith("*") else s for s in lines) if x).strip()


def statements(text: str) -> Iterator[Statement]:
    """Statements end at each full stop outside strings and comments; what follows the last one is dropped.

    A statement's line is that of the last comment that began before any of its text, or else of the stop before it."""
    code: list[str] = []  # of this statement, without comments
    at = depth = opened = 0
    line, start, doc, string = 1, 1, "", False
    for m in _MARK.finditer(text):
        mark = m.group()
        if mark == "\n":
            line += 1
        elif mark == '"':
            if not depth:
                string = not string
        elif string:
            continue
        elif mark == "(*":
            if not depth:
                code.append(text[at : m.start()])
                opened = m.start()
            if not any(map(str.strip, code)):
                start = line
            depth += 1
        elif mark == "*)" and depth:
            depth -= 1
            if not depth:
                at = m.end()
                if text.startswith("(**", opened):
                    doc = text[opened:at]
        elif mark == "." and not depth:
            code.append(text[at : m.end()])
            whole = "".join(code).strip()
            yield Statement(whole, clean_doc(doc) if doc else "", start)
            code, at, doc, start = [], m.end(), "", line


def strip_comments(text: str) -> str:
    """Text without comments; a quote only counts outside them."""
    kept: list[str] = []
    at, depth, string = 0, 0, False
    for m in _MARK.finditer(text):
        mark = m.group()
        if mark == '"' and not depth:
            string = not string
        elif string:
            continue
        elif mark == "(*":
            if not depth:
                kept.append(text[at : m.start()])
            depth += 1
        elif mark == "*)" and depth:
            depth -= 1
            at = m.end()
    return "".join(kept) + ("" if depth else text[at:])


def type_of(tail: str, strict: bool = True) -> str:
    """P5: the type in what follows a name."""
    tail = compact(tail)
    head, assigned, _ = tail.partition(":=")
    if tail.startswith(":") and (strict or not tail.startswith(":=")):
        return tail[1:].strip()
    if assigned:
        return head.rpartition(":")[2].strip() if ":" in head else ""
    return tail


def module_of(path: str) -> str:
    """The path without its suffix, with dots."""
    folder, _, file = path.rpartition("/")
    stem = file.rpartition(".")[0] or file
    return (f"{folder}/{stem}" if folder else stem).replace("/", ".")


def declarations(text: str, strict: bool = True) -> Iterator[tuple[int, str, str, str, str, str, int]]:
    """(number of the statement, name, kind, type, statement, doc, line)."""
    pattern = DECLARATION if strict else _DECLARATION_PRIMES
    for no, s in enumerate(statements(text)):
        code = strip_comments(s.text)
        m = pattern.match(code)
        if m:
            yield no, m["name"], m["kind"], type_of(m["rest"].removesuffix("."), strict), compact(code), s.doc, s.line


def parse_sources(files: DataFrame, strict: bool = True) -> DataFrame:
    """Declarations of files (library, file_path, source_path, text), each with its github_url.

    A null text has none; null paths count as empty. Whole texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for library, path, source, text in zip(*(b.column(c).to_pylist() for c in ("library", "file_path", "source_path", "text")), strict=True):
                path = path or ""
                for no, name, kind, type_, statement, doc, line in declarations(text or "", strict):
                    rows.append((name, kind, type_, statement, doc, module_of(path), library, path, source, line, no))
            columns = list(zip(*rows, strict=True)) or [()] * 11
            kinds = [pa.string()] * 9 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    found = files.select("library", "file_path", "source_path", "text").mapInArrow(run, SCHEMA)
    return found.withColumn("github_url", source_url(F.col("library"), F.col("file_path"), F.col("line_number")))


def parse_statements(files: DataFrame) -> DataFrame:
    """(library, file_path, seq, code, name, kind, type_signature): every statement of files, with the declaration it makes."""
    schema = "library string, file_path string, seq long, code string, name string, kind string, type_signature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for library, path, text in zip(*(b.column(c).to_pylist() for c in ("library", "file_path", "text")), strict=True):
                for no, s in enumerate(statements(text or "")):
                    code = strip_comments(s.text)
                    m = DECLARATION.match(code)
                    rows.append((library, path, no, code.strip(), m and m["name"], m and m["kind"], m and type_of(m["rest"].removesuffix("."))))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 2 else pa.string()) for i, c in enumerate(columns)], names=["library", "file_path", "seq", "code", "name", "kind", "type_signature"])

    return files.select("library", "file_path", "text").mapInArrow(run, schema)
