"""Splits that keep related declarations together (problem 4).

Declarations are related by entity (from the name) and by canonical content. Entities are the vertices, two of them
under one content an edge. Borůvka's method contracts the graph: in each round every component takes its smallest
edge, components joined by such edges become one, and the edges taken are added to a spanning forest that is stored and
returned. Groups are then put into bands of size and dealt to the splits within each band.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from theoremlake.llm.content import canonical_content, content_of
from theoremlake.llm.pairs import HOT_COPIES, with_representative
from theoremlake.plans.scratch import written

_SEPARATORS = re.compile(r"[_'\d]+")
#: A list of up to so many relation words is sent to the tasks; a longer one is joined with the parts of the names.
SENT_RELATION_WORDS = 10_000
#: Groups with more than this share of all rows are dealt one by one, the largest first; there are fewer than its inverse.
LARGE_SHARE = 0.001
#: Dealing runs in independent slices of a band, of about so many groups, so that no task orders all groups.
SLICE_GROUPS = 100_000


def name_parts(name: str | None) -> Iterator[str]:
    """The parts of the unqualified name in lower case."""
    for chunk in _SEPARATORS.split(name.strip().rpartition(".")[2]) if name is not None else ():
        start = 0
        for i in range(1, len(chunk) + 1):
            if i == len(chunk) or (chunk[i].isupper() and chunk[i - 1].islower()):
                part = chunk[start:i].strip().lower()
                start = i
                if part:
                    yield part


def entity_of(name: str | None, relation_words: set[str]) -> str | None:
    """The first part of the unqualified name that is no relation word, in lower case; None if there is none."""
    return next((p for p in name_parts(name) if p not in relation_words), None)


def _featurize(relation_words: set[str] | None):
    """mapInArrow function: entity and content of each row; without relation_words the parts of the name instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            entities, sigs = [], []
            for n, s, t in zip(*(b.column(c).to_pylist() for c in ("name", "statement", "type_signature")), strict=True):
                content, is_statement = content_of(s, t)
                entities.append(list(dict.fromkeys(name_parts(n))) if relation_words is None else entity_of(n, relation_words))
                sigs.append(None if content is None else xxhash.xxh3_128_digest(canonical_content(content, is_statement)))
            named = pa.array(entities, pa.list_(pa.string()) if relation_words is None else pa.string())
            yield pa.RecordBatch.from_arrays([b.column("id"), named, pa.array(sigs, pa.binary())], names=["id", "entity", "sig"])

    return run


def _rows(src: DataFrame, words: DataFrame) -> DataFrame:
    """(id, entity, sig) of src (id, name, statement, type_signature), stored."""
    few = words.limit(SENT_RELATION_WORDS + 1).collect()
    if len(few) <= SENT_RELATION_WORDS:
        return written(src.mapInArrow(_featurize({r.w for r in few}), "id long, entity string, sig binary"), "p4-rows")
    parts = src.mapInArrow(_featurize(None), "id long, entity array<string>, sig binary")
    parts = written(parts.withColumn("row", F.monotonically_increasing_id()), "p4-parts")
    each = parts.select("row", F.posexplode("entity").alias("pos", "w")).join(words, "w", "left_anti")
    first = each.groupBy("row").agg(F.min(F.struct("pos", "w")).alias("m")).select("row", F.col("m.w").alias("entity"))
    return written(parts.drop("entity").join(first, "row", "left").select("id", "entity", "sig"), "p4-rows")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, forest) of the undirected graph edges (u STRING, v STRING). labels (vertex, root): vertices of one
    component have the smallest vertex of it as root. forest (u, v): one edge less than vertices for each component.

    Null ends, loops and repeated edges make no difference. An empty table gives empty results. Each round's tables are
    stored; nothing but counts comes to the driver. At least half of the components that still have an edge vanish in
    a round."""
    spark = edges.sparkSession
    e = edges.where("u is not null and v is not null and u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    e = written(e.select("a", "b", F.struct(F.xxhash64("a", "b").alias("h"), F.col("a").alias("u"), F.col("b").alias("v")).alias("w")), "edges")
    labels = written(e.select(F.explode(F.array("a", "b")).alias("vertex")).distinct().select("vertex", F.col("vertex").alias("comp")), "labels")
    forest = spark.createDataFrame([], "u string, v string")
    while not e.isEmpty():
        ends = e.select("a", "b", "w").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
        least = ends.groupBy("a").agg(F.min(F.struct("w", "b")).alias("m")).select("a", F.col("m.b").alias("p"), F.col("m.w").alias("w"))
        least = written(least, "least")
        forest = forest.unionByName(least.select("w.u", "w.v").distinct())
        # two components that chose each other: the smaller one stays the root
        back = least.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = least.join(back, "p").select("a", F.when((F.col("pp") == F.col("a")) & (F.col("a") < F.col("p")), F.col("a")).otherwise(F.col("p")).alias("p"))
        parent = written(parent, "parents")
        while True:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = written(parent.join(up, "p").select("a", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "parents")
            parent = jumped.select("a", "p")
            if jumped.where("moved").isEmpty():
                break
        root_of = lambda name: parent.select(F.col("a").alias(name), F.col("p").alias(f"{name}_root"))
        labels = written(labels.join(root_of("comp"), "comp", "left").select("vertex", F.coalesce("comp_root", "comp").alias("comp")), "labels")
        e = e.join(root_of("a"), "a").join(root_of("b"), "b").where("a_root <> b_root")
        e = written(e.groupBy(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).agg(F.min("w").alias("w")), "edges")
    root = labels.groupBy("comp").agg(F.min("vertex").alias("root"))
    return labels.join(root, "comp").select("vertex", "root"), written(forest, "forest")


def relations(df: DataFrame, relation_words: DataFrame, id_col: str = "decl_id", name_col: str = "name", statement_col: str = "statement", type_col: str = "type_signature", word_col: str = "word", hot_copies: int = HOT_COPIES) -> tuple[DataFrame, DataFrame]:
    """(groups, forest). groups (id, group_id, group_key): rows with one group_id belong together; group_key is the
    alphabetically first entity of the group, null if it has none. forest (u, v), stored: the entities that contents
    connect, one edge less than entities for each group.

    Rows without entity and content, and null ids, are kept as rows of their own group (group_id by their id). Repeated
    rows fall into one group. An empty table gives empty results. Entities and contents that more than hot_copies rows
    have are sent to the tasks, so their rows are not shuffled to one."""
    words = relation_words.select(F.lower(F.trim(word_col)).alias("w")).where("w is not null").distinct()
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(name_col).alias("name"), F.col(statement_col).alias("statement"), F.col(type_col).alias("type_signature"))
    rows = _rows(src, words)
    named = written(rows.where("entity is not null and sig is not null").groupBy("sig", "entity").agg(F.count("*").alias("n")), "p4-named")
    hubs = written(named.groupBy("sig").agg(F.min("entity").alias("hub"), F.max("entity").alias("last"), F.count("*").alias("n")), "p4-hubs")
    edges = with_representative(named.select("sig", "entity"), hubs.where("hub <> last").select("sig", "hub", "n"), ["sig"], hot_copies)
    labels, forest = spanning_forest(edges.select(F.col("hub").alias("u"), F.col("entity").alias("v")))
    labels = written(labels, "p4-labels")
    entities = rows.where("entity is not null").groupBy("entity").agg(F.count("*").alias("n")).join(labels.withColumnRenamed("vertex", "entity"), "entity", "left")
    entities = written(entities.select("entity", F.coalesce("root", "entity").alias("group_key"), "n"), "p4-entities")
    with_entity = with_representative(rows.where("entity is not null").select("id", "entity"), entities, ["entity"], hot_copies).select("id", "group_key", F.lit(None).cast("binary").alias("sig"))
    contents = rows.where("entity is null and sig is not null").groupBy("sig").agg(F.count("*").alias("n")).join(hubs.select("sig", "hub"), "sig", "left")
    contents = contents.join(labels.withColumnRenamed("vertex", "hub"), "hub", "left").select("sig", F.coalesce("root", "hub").alias("group_key"), "n")
    without = with_representative(rows.where("entity is null and sig is not null").select("id", "sig"), written(contents, "p4-contents"), ["sig"], hot_copies).select("id", "group_key", "sig")
    alone = rows.where("entity is null and sig is null").select("id", F.lit(None).cast("string").alias("group_key"), F.lit(None).cast("binary").alias("sig"))
    group_id = F.when(F.col("group_key").isNotNull(), F.concat(F.lit("e:"), "group_key")).when(F.col("sig").isNotNull(), F.concat(F.lit("c:"), F.hex("sig"))).otherwise(F.concat(F.lit("r:"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    return with_entity.unionByName(without).unionByName(alone).select("id", group_id.alias("group_id"), "group_key"), forest


def related_groups(df: DataFrame, relation_words: DataFrame, **options) -> DataFrame:
    """The groups of relations()."""
    return relations(df, relation_words, **options)[0]


def grouped_rows(groups: DataFrame, hot_copies: int = HOT_COPIES) -> DataFrame:
    """(decl_id, group_key) of the rows in a group of two or more. groups should be a stored table."""
    sizes = written(groups.groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1"), "p4-sizes")
    return with_representative(groups, sizes, ["group_id"], hot_copies).select(F.col("id").alias("decl_id"), "group_key")


def _deal(r: Column, proportions: dict[str, float]) -> Column:
    """A split for each number in [0, 1)."""
    names, out, below = list(proportions), None, 0.0
    total = sum(proportions.values())
    for name in names[:-1]:
        below += proportions[name] / total
        out = F.when(r < below, name) if out is None else out.when(r < below, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def assign_splits(groups: DataFrame, proportions: dict[str, float] | None = None, slice_groups: int = SLICE_GROUPS) -> DataFrame:
    """(decl_id, group_id, split): one split for all rows of a group; splits get their proportions of the rows as nearly as
    the groups allow.

    Groups of more than LARGE_SHARE of the rows go, from the largest, to the split that lacks the most rows; what is
    then lacking is dealt with the other groups, systematically within bands of similar size. groups should be stored."""
    proportions = proportions or {"train": 0.8, "validation": 0.1, "test": 0.1}
    sizes = written(groups.groupBy("group_id").agg(F.count("*").alias("n")), "p4-sizes")
    total, n_groups = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    slices = max(1, -(-n_groups // slice_groups))
    limit = max(1, math.floor(total * LARGE_SHARE))
    large = sizes.where(F.col("n") > limit).orderBy(F.desc("n"), "group_id").collect()  # fewer than 1 / LARGE_SHARE rows
    lack = {k: v * total / sum(proportions.values()) for k, v in proportions.items()}
    chosen = []
    for r in large:
        to = max(lack, key=lambda k: (lack[k], k))
        lack[to] -= r.n
        chosen.append((r.group_id, to))
    lack = {k: max(v, 0.0) for k, v in lack.items()}
    if not sum(lack.values()):
        lack = proportions
    h = F.xxhash64("group_id")
    w = Window.partitionBy("band", "slice").orderBy("h", "group_id")
    rest = sizes.where(F.col("n") <= limit).select("group_id", F.floor(F.log2("n")).alias("band"), F.pmod(h, F.lit(slices)).alias("slice"), h.alias("h"))
    # multiples of the golden ratio fill [0, 1) evenly from any start, so each slice has the proportions to within a group or two
    place = (F.row_number().over(w) * F.lit((math.sqrt(5) - 1) / 2) + F.pmod(F.xxhash64("band", "slice"), F.lit(1000)) / 1000) % 1
    dealt = rest.withColumn("place", place).select("group_id", _deal(F.col("place"), lack).alias("split"))
    # the large groups are few and sent to the tasks, so their rows are not shuffled to one
    few = F.broadcast(dealt.sparkSession.createDataFrame(chosen, "group_id string, split string"))
    rows = groups.select("id", "group_id")
    out = rows.join(few, "group_id").unionByName(rows.join(few.select("group_id"), "group_id", "left_anti").join(dealt, "group_id"))
    return out.select(F.col("id").alias("decl_id"), "group_id", "split")
