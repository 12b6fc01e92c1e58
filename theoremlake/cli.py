"""python -m theoremlake.cli COMMAND: fetch, extract, enrich, index, validate, describe, mine, finetune, eval."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from theoremlake.functions.declarations import declaration_text, prompt_line
from theoremlake.operators import embed, enrich, index, metrics, mining, search, traindata
from theoremlake.plans.scratch import scope, written
from theoremlake.sources import files
from theoremlake.sources.parse import parse_statements


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple[str, dict]) -> None:
        c = sub.add_parser(name)
        for flag, kw in options:
            c.add_argument(flag, **kw)

    in_, out = ("--input", {"required": True}), ("--out", {"required": True})
    command("fetch", ("library", {"choices": sorted(files.LIBRARIES)}), ("--target", {"default": "repos"}))
    command("extract", ("--source", {"action": "append", "required": True}), out, ("--include", {"action": "append"}), ("--kind", {"action": "append"}), ("--append", {"action": "store_true"}))
    command("enrich", in_, out, ("--dedupe", {"action": "store_true"}))
    command("index", in_, ("--index", {"required": True}), ("--no-resume", {"action": "store_true"}), ("--prune", {"action": "store_true"}), ("--reset", {"action": "store_true"}))
    command("validate", in_, ("--search", {}), ("--lib", {}), ("--kind", {}), ("--limit", {"type": int, "default": 10}))
    command("describe", in_, ("--cache", {"required": True}), out, ("--describer", {"help": "MODULE:FUNCTION that makes a describer; rules without"}), ("--chunk", {"type": int, "default": 10_000}))
    command("mine", ("--source", {"action": "append", "required": True}), in_, out, ("--cap", {"type": int, "default": 1500}))
    command("finetune", in_, out, ("--k", {"type": int, "default": 5}), ("--test-fraction", {"type": float, "default": 0.1}))
    command("eval", in_, ("--queries", {"required": True}), ("--premises", {"action": "store_true"}), ("--k", {"type": int, "default": 50}))
    a = p.parse_args(argv)
    if a.command == "fetch":
        print(files.fetch(a.library, a.target))
        return 0
    spark = spark or SparkSession.builder.appName("theoremlake").getOrCreate()
    if a.command == "extract":
        print(files.extract(spark, a.source, a.out, a.include, a.kind, a.append))
        return 0
    with scope(spark):
        _run(spark, a)
    return 0


def _run(spark: SparkSession, a: argparse.Namespace) -> None:
    decls = files.read_declarations(spark, a.input).withColumn("seq", F.monotonically_increasing_id())
    if a.command == "enrich":
        rows = enrich.enrich(decls)
        if a.dedupe:
            rows = enrich.dedupe_declarations(rows, [F.asc("seq")]).drop("docstring_generated")
        files.write_jsonl(rows.drop("seq"), a.out)
    elif a.command == "index":
        i = index.Index(spark, a.index)
        if a.reset:
            i.reset()
        print(i.build(decls.drop("seq", "docstring_generated"), not a.no_resume, a.prune))
    elif a.command == "validate":
        found = enrich.inspect(decls, a.lib, a.kind, a.search)
        enrich.profile(decls).show()
        enrich.facet_counts(decls, "library").orderBy("value").show()
        enrich.top_kinds(decls, "seq").show()
        found.orderBy("seq").limit(a.limit).select("kind", "name", "library", F.substring("type_signature", 1, 120).alias("type"), "github_url").show(a.limit, False)
    elif a.command == "describe":
        rows = decls.withColumns({"id": index.stable_id(), "line": prompt_line(F.lit(0))})
        files.describe_log(rows, a.cache, _describer(a.describer) if a.describer else None, a.chunk)
        told = files.latest_descriptions(files.read_description_log(spark, a.cache), [F.desc_nulls_last("described_at"), F.desc("nl_description")])
        files.write_jsonl(index.write_back(rows, told, "id").drop("id", "line", "seq"), a.out)
    elif a.command == "mine":
        pairs = mining.mine(parse_statements(files.read_sources(spark, a.source)), files.corpus_names(decls))
        files.write_jsonl(mining.strided_sample(pairs, a.cap, [F.asc("file_path"), F.asc("name")], ["library"]), a.out)
    elif a.command == "finetune":
        files.write_jsonl(traindata.training_rows(decls, "seq", a.test_fraction, a.k), a.out)
    elif a.command == "eval":
        _evaluate(spark, decls, a.queries, a.premises, a.k).show(1, False)


def _describer(name: str):
    """The factory MODULE:FUNCTION."""
    import importlib

    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _evaluate(spark: SparkSession, decls: DataFrame, path: str, premises: bool, k: int) -> DataFrame:
    """Metrics of dense retrieval over decls. With premises the rows of path are declarations that ask for their premises; a
    declaration never finds itself (R12)."""
    points = decls.select(F.col("seq").alias("id"), F.substring_index("name", ".", -1).alias("name"), declaration_text().alias("v"))
    if premises:
        rows = files.read_premises(spark, path).withColumn("query_id", F.monotonically_increasing_id())
        rows = rows.select("query_id", F.concat_ws(" ", "name", "type_signature", "statement").alias("query"), F.col("name").alias("own_name"), F.col("premises").alias("gold"))
    else:
        rows = files.read_eval(spark, path).withColumn("query_id", F.monotonically_increasing_id()).select("query_id", "query", F.lit(None).cast("string").alias("own_name"), "gold")
    rows = written(rows, "eval")
    found = search.dense_topk(rows.select(F.col("query_id").alias("id"), F.col("query").alias("v")), points.select("id", "v"), k, vectors=embed.hash_vectors())
    ranked = found.join(points.select("id", "name"), "id").join(rows.select("query_id", "own_name"), "query_id").select("query_id", "rank", "name", "own_name")
    ranked = metrics.drop_self(ranked) if premises else ranked
    return metrics.summary(metrics.per_query(written(ranked, "ranked"), rows.select("query_id", F.explode("gold").alias("name"))))


if __name__ == "__main__":
    raise SystemExit(main())

