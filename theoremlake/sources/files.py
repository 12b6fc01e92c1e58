"""Scans and writes (S1-S10, K1): source trees, JSON lines, JSON arrays, caches and evaluation sets."""

from __future__ import annotations

import os
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from theoremlake.functions.declarations import CANONICAL, LEGACY, normalize


class Library(NamedTuple):
    """Where a public library is fetched from, outside Spark (git clone --depth 1, sparse where stated)."""

    repo: str
    subdir: str
    branch: str = "master"
    sparse: bool = False


# Fixed value: the libraries that can be fetched by name.
LIBRARIES = {
    "stdlib": Library("https://github.com/rocq-prover/stdlib.git", "theories", sparse=True),
    "mathcomp": Library("https://github.com/math-comp/math-comp.git", "."),
    "unimath": Library("https://github.com/UniMath/UniMath.git", "UniMath"),
    "hott": Library("https://github.com/HoTT/Coq-HoTT.git", "theories"),
    "iris": Library("https://gitlab.mpi-sws.org/iris/iris.git", "."),
    "geocoq": Library("https://github.com/GeoCoq/GeoCoq.git", "theories"),
    "mathcomp-analysis": Library("https://github.com/math-comp/analysis.git", "."),
}


def fetch(library: str, target: str) -> str:
    """Clone a library, or bring a clone up to date, and return the folder of its sources. Needs git and a network."""
    import subprocess

    lib, folder = LIBRARIES[library], os.path.join(target, library)
    git = lambda *a, at=None: subprocess.run(["git", *(["-C", at] if at else []), *a], check=True)
    if os.path.isdir(os.path.join(folder, ".git")):
        git("fetch", "--depth", "1", "origin", lib.branch, at=folder)
        git("checkout", lib.branch, at=folder)
        git("pull", "--ff-only", at=folder)
    else:
        git("clone", "--depth", "1", "--branch", lib.branch, *(["--sparse"] if lib.sparse else []), lib.repo, folder)
        if lib.sparse:
            git("sparse-checkout", "set", lib.subdir, at=folder)
    return os.path.normpath(os.path.join(folder, lib.subdir))


def parse_source(spec: str) -> tuple[str, str]:
    """PATH=label, split at the last `=`; without one the folder's name is the label. ValueError for an empty label."""
    path, equals, label = spec.rpartition("=")
    if not equals:
        path, label = spec, os.path.basename(os.path.normpath(spec))
    if not label.strip():
        raise ValueError(f"empty library label in {spec!r}")
    return path, label.strip()


def under(rel: Column, prefixes: list[str] | None) -> Column:
    """S3: whether a path is one of the prefixes or below it, whole segments only."""
    out = None
    for p in prefixes or []:
        here = (rel == p) | rel.startswith(p.rstrip("/") + "/")
        out = here if out is None else out | here
    return F.lit(True) if out is None else out


def read_sources(spark: SparkSession, specs: list[str], include: list[str] | None = None, glob: str = "*.v") -> DataFrame:
    """(library, file_path, source_path, text) of all files below the given roots. Bytes that are no UTF-8 are
    replaced. FileNotFoundError for a missing local root. Paths are chosen before any content is read."""
    out = None
    for spec in specs:
        root, library = parse_source(spec)
        if "://" not in root and not os.path.isdir(root):
            raise FileNotFoundError(root)
        base = root if "://" in root else os.path.abspath(root)
        full = F.regexp_replace("path", r"^file:/+", "/")
        files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(base)
        rel = F.substring(full, len(base.rstrip("/")) + 2, 1 << 20)
        part = files.where(under(rel, include)).select(F.lit(library).alias("library"), rel.alias("file_path"), full.alias("source_path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no source given")
    return out


def extract(spark: SparkSession, specs: list[str], out: str, include: list[str] | None = None, kinds: list[str] | None = None, append: bool = False) -> int:
    """Parse all sources and write their declarations as JSON lines; returns how many."""
    from theoremlake.sources.parse import parse_sources

    found = parse_sources(read_sources(spark, specs, include))
    if kinds:
        found = found.where(F.lower("kind").isin(*(k.lower() for k in kinds)))
    write_jsonl(found.drop("statement_no"), out, append)
    return spark.read.json(out).count() if not append else found.count()


def read_declarations(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines in either historical shape, in canonical columns; blank lines are skipped."""
    names = [*CANONICAL, *LEGACY.values()]
    schema = ", ".join(f"`{n}` {'long' if n in ('line_number', 'line') else 'string'}" for n in names)
    return normalize(spark.read.schema(schema + ", docstring_generated boolean").json(path))


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """Informal descriptions as one JSON array."""
    return spark.read.schema("informal_name string, informal_description string, signature string").option("multiLine", True).json(path)


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """Natural-language evaluation rows."""
    return spark.read.schema("query string, gold array<string>, hint string, source string, source_statement string").json(path)


def read_premises(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation rows that ask for the premises of a declaration, as operators.mining.mine gives them."""
    return spark.read.schema("name string, kind string, library string, file_path string, type_signature string, statement string, premises array<string>").json(path)


LOG_SCHEMA = "id decimal(20,0), name string, nl_description string, described_at timestamp"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on whatever store the path names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_description_log(spark: SparkSession, path: str) -> DataFrame:
    """The append-only description cache; empty where there is none yet."""
    return spark.read.schema(LOG_SCHEMA).json(path) if exists(spark, path) else spark.createDataFrame([], LOG_SCHEMA)


def describe_log(rows: DataFrame, path: str, describer=None, chunk: int = 10_000) -> None:
    """M7, K8: describe the rows (id, name, line, canonical columns) that the cache lacks and append them, about chunk rows at
    a time, so that a failure loses no more than these and a further run goes on from there. describer as in
    operators.describe.describe; without one the rule-based text is taken."""
    from theoremlake.functions.declarations import rule_based_docstring
    from theoremlake.operators.describe import describe
    from theoremlake.plans.scratch import written

    todo = rows.dropDuplicates(["id"]).join(read_description_log(rows.sparkSession, path).select("id").distinct(), "id", "left_anti")
    todo = written(todo.select("id", "name", "line", rule_based_docstring().alias("nl_description")), "todo")
    parts = -(-todo.count() // chunk)
    for n in range(parts):
        part = todo if parts == 1 else todo.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == n)
        told = part.select("id", "name", "nl_description") if describer is None else describe(part, describer, "line")
        write_jsonl(told.withColumn("described_at", F.current_timestamp()), path, append=True)


def corpus_names(df: DataFrame) -> DataFrame:
    """The distinct names that are not empty."""
    return df.select("name").where("name <> ''").distinct()


def latest_descriptions(log: DataFrame, order: list[Column]) -> DataFrame:
    """Of an append-only log (id, nl_description, ...) the last row of each id, by the given descending order."""
    w = Window.partitionBy("id").orderBy(*order)
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """K1, K8: JSON lines; characters beyond ASCII stay as they are. Fields keep their place even when null."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)
