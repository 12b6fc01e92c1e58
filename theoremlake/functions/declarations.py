"""Columns of declarations: the canonical shape, identity, source links, texts for search and display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from theoremlake.functions.text import compact_ws, hash_int, text

CANONICAL = ("name", "kind", "type_signature", "statement", "docstring", "nl_description", "module_path", "library", "file_path", "line_number", "github_url", "chapter")
#: Older names of fields.
LEGACY = {"type_signature": "type", "docstring": "doc", "module_path": "module", "file_path": "file", "line_number": "line"}
# Fixed value: where the sources of public libraries can be read.
SOURCE_BASES = {
    "stdlib": "https://github.com/rocq-prover/stdlib/blob/master/theories",
    "coq": "https://github.com/coq/coq/blob/master/theories",
    "mathcomp": "https://github.com/math-comp/math-comp/blob/master",
    "unimath": "https://github.com/UniMath/UniMath/blob/master/UniMath",
    "hott": "https://github.com/HoTT/Coq-HoTT/blob/master/theories",
    "iris": "https://gitlab.mpi-sws.org/iris/iris/-/blob/master",
    "geocoq": "https://github.com/GeoCoq/GeoCoq/blob/master/theories",
    "mathcomp-analysis": "https://github.com/math-comp/analysis/blob/master",
}
# Fixed value: leading folders that those links already hold.
SOURCE_SUBDIRS = {"stdlib": "theories", "coq": "theories", "unimath": "UniMath", "hott": "theories"}


def source_url(library: Column, file_path: Column, line: Column, bases: dict[str, str] | None = None, subdirs: dict[str, str] | None = None) -> Column:
    """A link to the line, empty for an unknown library."""
    out = F.lit("")
    for lib, base in (SOURCE_BASES if bases is None else bases).items():
        folder = (SOURCE_SUBDIRS if subdirs is None else subdirs).get(lib)
        rel = F.regexp_replace(file_path, rf"^\Q{folder}/\E", "") if folder else file_path
        out = F.when(library == lib, F.concat(F.lit(base + "/"), rel, F.lit("#L"), line.cast("string"))).otherwise(out)
    return out


def chapter_of(file_path: Column) -> Column:
    """the first Ch and one or two digits of a path."""
    return F.regexp_extract(file_path, r"(?U)(Ch\d{1,2})", 1)


def normalize(df: DataFrame) -> DataFrame:
    """the canonical columns, from either historical shape; other columns of df are kept behind them under their names.

    The first value that is neither null nor empty (a number: nor 0) counts. Missing texts are empty, a missing library is
    unknown, a missing line 0."""
    have = set(df.columns)

    def pick(name: str, default: str = "") -> Column:
        fields = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (name, LEGACY.get(name)) if c in have]
        return F.coalesce(*fields, F.lit(default))

    lines = [F.nullif(F.col(f"`{c}`").cast("long"), F.lit(0)) for c in ("line_number", "line") if c in have]
    line, library, path, url = F.coalesce(*lines, F.lit(0).cast("long")), pick("library", "unknown"), pick("file_path"), pick("github_url")
    values = {c: compact_ws(pick(c)) for c in ("type_signature", "statement", "docstring", "nl_description")}
    values |= {c: pick(c) for c in ("name", "kind", "module_path")} | {"library": library, "file_path": path, "line_number": line}
    values["github_url"] = F.when((url == "") & (path != "") & (line != 0), source_url(library, path, line)).otherwise(url)
    values["chapter"] = F.coalesce(F.nullif(pick("chapter"), F.lit("")), chapter_of(path))
    rest = [F.col(f"`{c}`") for c in df.columns if c not in values and c not in LEGACY.values()]
    return df.select(*(values[c].alias(c) for c in CANONICAL), *rest)


def canonical_key() -> Column:
    """F2, over canonical columns."""
    return F.concat_ws(":", "library", "file_path", F.col("line_number").cast("string"), "name")


def stable_id() -> Column:
    """an unsigned 64-bit number as DECIMAL(20,0)."""
    return hash_int(canonical_key(), 16)


def _filled(c: Column | str) -> Column:
    return F.nullif(text(c), F.lit(""))


def declaration_text() -> Column:
    """what the dense vector is made of."""
    module = F.when(text("module_path") != "", F.concat(F.lit("module "), "module_path"))
    kind_name = F.concat(F.col("kind"), F.lit(" "), F.col("name"))
    return F.concat_ws(" | ", _filled("nl_description"), kind_name, _filled("type_signature"), _filled("docstring"), _filled("statement"), module, F.concat(F.lit("library "), "library"))


def sparse_text() -> Column:
    """F8: what keyword search looks at."""
    return F.concat_ws(" ", *(_filled(c) for c in ("name", "type_signature", "statement", "docstring")))


def rule_based_docstring() -> Column:
    """F14."""
    what = F.coalesce(_filled("type_signature"), _filled("statement"))
    return (
        F.when(what.isNotNull(), F.concat("kind", F.lit(" "), "name", F.lit(": "), what))
        .when(F.col("kind").isin("Inductive", "CoInductive"), F.concat(F.lit("Defines the inductive type "), "name", F.lit(".")))
        .when(F.col("kind").isin("Definition", "Fixpoint", "CoFixpoint"), F.concat(F.lit("Defines "), "name", F.lit(".")))
        .otherwise(F.concat("kind", F.lit(" "), "name", F.lit(" from "), "library", F.lit(".")))
    )


def prompt_line(index: Column) -> Column:
    """F16: a declaration as a line of a prompt."""
    body = F.coalesce(_filled("type_signature"), F.substring(text("statement"), 1, 320))
    return F.concat(F.lit("["), index.cast("string"), F.lit("] "), text("kind"), F.lit(" "), text("name"), F.lit(" :: "), body)


def rerank_text() -> Column:
    """F20, over columns with search_text."""
    head = F.nullif(F.trim(F.concat(text("kind"), F.lit(" "), text("name"))), F.lit(""))
    return F.coalesce(_filled("search_text"), F.concat_ws(" | ", head, *(_filled(c) for c in ("type_signature", "docstring", "statement"))))


def result_text(score: Column) -> Column:
    """a search result in several lines."""
    where = F.coalesce(_filled("github_url"), F.concat(text("file_path"), F.lit(":"), F.col("line_number").cast("string")))
    line = lambda before, c: F.when(text(c) != "", F.concat(F.lit(before), c))
    head = F.concat(F.lit("### "), text("kind"), F.lit(" "), text("name"), F.lit("  ("), text("library"), F.lit(")  score="), score.cast("string"))
    return F.concat_ws("\n", head, line("    : ", "type_signature"), line("    ", "statement"), line("    — ", "docstring"), F.concat(F.lit("    "), where))


def query_side() -> tuple[Column, Column]:
    """(query, whether it is a real description)."""
    from theoremlake.functions.text import identifier_tokens

    real = F.trim(F.regexp_replace(text("nl_description"), r"(?U)^[\s]+|[\s]+$", ""))
    made = F.array_join(F.filter(identifier_tokens("name"), lambda t: ~t.rlike("^[0-9]+$")), " ")
    return F.when(real != "", real).when(made != "", made).otherwise(text("name")), real != ""


def display_columns(score: Column) -> dict[str, Column]:
    """F32: last word of the kind, score as a whole percentage within 0 to 100, file name."""
    return {
        "kind_word": F.substring_index(text("kind"), " ", -1),
        "percent": F.greatest(F.lit(0), F.least(F.lit(100), F.round(score * 100))).cast("int"),
        "file_name": F.substring_index(text("file_path"), "/", -1),
    }
