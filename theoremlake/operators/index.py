"""The index: versioned Parquet files of points in a folder.

Points are dealt to buckets by id. A change writes new files of the buckets it touches and then replaces a pointer file,
which names the files of each bucket, in one step; so readers see the old or the new state and never a part, and a small
batch rewrites few buckets. Within a bucket points are partitioned by library, which serves as index of that facet, and
sorted by kind and chapter, so that Parquet's statistics skip row groups for these. Vectors are stored with the points."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from theoremlake.functions.declarations import canonical_key, declaration_text, normalize, stable_id
from theoremlake.operators.embed import Embedder, embed_column
from theoremlake.operators.enrich import first_wins


def missing_from(df: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in existing."""
    return df.join(existing.select(*keys).distinct(), keys, "left_anti")


def still_in(index: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """Index rows whose key is still in df."""
    return index.join(df.select(*keys).distinct(), keys, "left_semi")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """K4: the rows of both by key; a new row replaces an old one, of several new ones the first in the given (descending)
    order wins. Columns are matched by name."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), *order)
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def write_back(df: DataFrame, cache: DataFrame, key: str, column: str = "nl_description") -> DataFrame:
    """Df with column replaced where the cache (one row for each key) has a value that is not blank."""
    told = cache.select(key, F.col(column).alias("_told")).where(F.trim(F.coalesce("_told", F.lit(""))) != "")
    return df.join(told, key, "left").withColumn(column, F.coalesce("_told", column)).drop("_told")


def to_points(declarations: DataFrame) -> DataFrame:
    """Canonical declarations with id and search_text; of one id the first by text stays, whatever the order of rows."""
    rows = normalize(declarations).withColumns({"id": stable_id(), "search_text": declaration_text()})
    return first_wins(rows, ["id"], [F.xxhash64("search_text").asc(), F.col("search_text").asc()])


class Index:
    """A collection in a folder. With an embedder (made once in each task) every new point gets its vector, dense."""

    def __init__(self, spark: SparkSession, folder: str, embedder: Callable[[], Embedder] | None = None, buckets: int = 16) -> None:
        self.spark, self.folder, self.embedder, self.buckets = spark, folder.rstrip("/"), embedder, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def _state(self) -> dict:
        """{"count": number of buckets, "files": {bucket: snapshot}}; empty files before the first build."""
        pointer = self._path(f"{self.folder}/CURRENT")
        if not self._fs.exists(pointer):
            return {"count": self.buckets, "files": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/CURRENT").first().value)

    def _read(self, files: dict[str, str]) -> DataFrame | None:
        if not files:
            return None
        paths = [f"{self.folder}/snapshot={name}/bucket={b}" for b, name in sorted(files.items())]
        return self.spark.read.option("basePath", self.folder).parquet(*paths).drop("snapshot", "bucket").withColumn("library", F.col("library").cast("string"))

    def points(self) -> DataFrame | None:
        """All points; column pruning takes the place of paging."""
        return self._read(self._state()["files"])

    def _bucket(self, count: int) -> Column:
        return F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(count)).cast("int")

    def _point_to(self, state: dict) -> None:
        """K7: replace the pointer in one step."""
        new = self._path(f"{self.folder}/CURRENT-{uuid.uuid4().hex[:12]}")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self._conf).rename(self._fs.makeQualified(new), self._fs.makeQualified(self._path(f"{self.folder}/CURRENT")), how)

    def reset(self) -> None:
        """K2: drop everything."""
        self._fs.delete(self._path(self.folder), True)

    def build(self, declarations: DataFrame, resume: bool = True, prune: bool = False, points=to_points) -> int:
        """K4-K6: add declarations, returning how many points there then are. With resume, keys that are indexed stay as
        they are even if their content changed; without, new content replaces old. With prune, points that are not among
        the declarations go. Only buckets that change are read whole and written."""
        from theoremlake.plans.scratch import written

        state = self._state()
        count, files = state["count"], dict(state["files"])
        new, all_ = points(declarations), self._read(files)
        added = new if all_ is None or not resume else missing_from(new, all_.select("id"), ["id"])
        added = added if self.embedder is None else embed_column(added, "search_text", self.embedder)
        added = written(added.withColumn("bucket", self._bucket(count)), "added")
        touched = {str(r.bucket) for r in added.select("bucket").distinct().collect()}  # at most count rows
        kept = new.select("id") if prune else None
        if prune and all_ is not None:
            kept = written(kept, "kept")
            touched |= {str(r.b) for r in all_.join(kept, "id", "left_anti").select(self._bucket(count).alias("b")).distinct().collect()}
        if touched:
            old = self._read({b: f for b, f in files.items() if b in touched})
            out = added.drop("bucket")
            if old is not None:
                out = old.unionByName(out, allowMissingColumns=True) if resume else upsert(old, out, ["id"], [F.col("id").asc()])
            out = out if kept is None else still_in(out, kept, ["id"])
            name = uuid.uuid4().hex[:12]
            rows = out.withColumn("bucket", self._bucket(count)).repartition("bucket", "library").sortWithinPartitions("bucket", "library", "kind", "chapter")
            rows.write.partitionBy("bucket", "library").parquet(f"{self.folder}/snapshot={name}")
            there = {x.getPath().getName().removeprefix("bucket=") for x in self._fs.listStatus(self._path(f"{self.folder}/snapshot={name}")) if x.isDirectory()}
            files = {b: f for b, f in files.items() if b not in touched} | {b: name for b in there}
            self._point_to({"count": count, "files": files})
        found = self.points()
        return 0 if found is None else found.count()

    def vacuum(self) -> None:
        """Delete files that the pointer no longer names; not while others still read them."""
        current = self._state()["files"]
        named = {f"{f}/{b}" for b, f in current.items()}
        for snapshot in self._fs.listStatus(self._path(self.folder)):
            name = snapshot.getPath().getName()
            if name.startswith("snapshot="):
                if name.removeprefix("snapshot=") not in current.values():
                    self._fs.delete(snapshot.getPath(), True)
                    continue
                for part in self._fs.listStatus(snapshot.getPath()):
                    bucket = part.getPath().getName()
                    if bucket.startswith("bucket=") and f"{name.removeprefix('snapshot=')}/{bucket.removeprefix('bucket=')}" not in named:
                        self._fs.delete(part.getPath(), True)


def key_column() -> Column:
    return canonical_key()
