"""Tables written in the folder all executors share.

Iterative and multi-pass operators cut their lineage here: a written Parquet table survives the loss of any
executor, keeps column pruning, and gives the planner real sizes.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}
#: Folders below this process's, of the scopes that are open.
_scopes: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode only, one made for this process where it is unset."""
    named = spark.conf.get(_KEY, None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_KEY} to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="theoremlake-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return _own["dir"]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return "/".join([shared_dir(spark), _mine(), *_scopes, f"{name}-{uuid.uuid4().hex[:12]}"])


def _mine() -> str:
    return f"theoremlake-{os.getpid()}"


def _delete(spark: SparkSession, below: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{below}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables written within are deleted at its end, so results have to be written elsewhere or read before."""
    _scopes.append(f"scope-{uuid.uuid4().hex[:12]}")
    below = "/".join([_mine(), *_scopes])
    try:
        yield
    finally:
        _scopes.pop()
        _delete(spark, below)


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete every table this process wrote. Only when no result built on them is still to be read."""
    _delete(spark, _mine())
