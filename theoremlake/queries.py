"""The queries of the core operators over the driver's tables, and the SQL that gives the same results in DuckDB.

Declarations stand for indexed points (their ids for source order), evaluation queries for searches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from theoremlake.functions import declarations as D
from theoremlake.functions import text as T
from theoremlake.operators import attach, embed, enrich, index, metrics, mining, rerank, search, traindata
from theoremlake.plans.scratch import fresh_path, written
from theoremlake.sources import files, parse
from theoremlake.streaming import ratelimit

POOL, SHOWN = 40, 10
#: Links of the libraries in the driver's tables.
BASES = {lib: f"https://example.org/{lib}/blob/main" for lib in ("corelib", "tessera", "ordinate", "lattix")}
SUBDIRS = {"corelib": "theories", "tessera": "src", "ordinate": "theories"}


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def _decls(spark: SparkSession, d: str) -> DataFrame:
    """Canonical columns and decl_id, from both ends of the pipeline."""
    return D.normalize(_read(spark, d, "declarations").drop("docstring_generated", "split", "extracted_at", "loaded_at"))


def _searches(spark: SparkSession, d: str) -> DataFrame:
    q = _read(spark, d, "nl_queries").select(F.col("query_id").alias("id"), F.col("query").alias("text"), "gold")
    return q.where(F.size(T.space_tokens("text")) > 0)


# --- scalars -----------------------------------------------------------------------------------------------------


def compact_ws_documents(spark: SparkSession, d: str) -> DataFrame:
    """F1."""
    return _read(spark, d, "documents").select("doc_id", T.compact_ws("text").alias("compact"))


def stable_id_declarations(spark: SparkSession, d: str) -> DataFrame:
    """F2, F3, F5."""
    return _decls(spark, d).select("decl_id", D.canonical_key().alias("key"), D.stable_id().cast("string").alias("id"))


def normalized_declarations(spark: SparkSession, d: str) -> DataFrame:
    """F5-F8."""
    return _decls(spark, d).select("decl_id", "name", "type_signature", "library", "line_number", "chapter", D.declaration_text().alias("dense_text"), D.sparse_text().alias("keyword_text"))


def url_chapter_extract(spark: SparkSession, d: str) -> DataFrame:
    """F4, F6, J14."""
    url = D.source_url(F.col("library"), F.col("file_path"), F.col("line_number"), BASES, SUBDIRS)
    return _decls(spark, d).select("decl_id", url.alias("url"), D.chapter_of(F.col("file_path")).alias("file_chapter"))


def prompt_and_display(spark: SparkSession, d: str) -> DataFrame:
    """F16, F20, F30-F32."""
    score = (F.col("decl_id") % 150) / 100.0
    rows = _decls(spark, d).withColumn("search_text", F.lit(None).cast("string"))
    return rows.select("decl_id", D.prompt_line(F.col("decl_id")).alias("line"), D.rerank_text().alias("rerank_text"), T.module_head("module_path", "none").alias("head"), *(c.alias(k) for k, c in D.display_columns(score).items()))


def hash_bucket_tokens(spark: SparkSession, d: str) -> DataFrame:
    """F12, F13."""
    return embed.bucket_counts(_decls(spark, d).select("decl_id", D.declaration_text().alias("text")), id_col="decl_id").withColumnRenamed("id", "decl_id")


def sparse_tokens_tf(spark: SparkSession, d: str) -> DataFrame:
    """F9-F11, A4."""
    return search.postings(_read(spark, d, "documents"), "doc_id").withColumnRenamed("id", "doc_id")


def document_frequency_idf(spark: SparkSession, d: str) -> DataFrame:
    """A5."""
    docs = _read(spark, d, "documents")
    return search.idf(search.postings(docs, "doc_id"), docs.count()).select("token_id", "df", F.round("idf", 6).alias("idf"))


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """F28."""
    return _read(spark, d, "customer").select("c_custkey", T.hash_sample("c_name", 0.25).alias("picked"))


def cluster_key_split(spark: SparkSession, d: str) -> DataFrame:
    """F21-F25, F29."""
    f = traindata.with_side(traindata.features(_decls(spark, d), "decl_id"), 0.1)
    return f.select(F.col("seq").alias("decl_id"), "stem", F.concat_ws(" ", "relation").alias("relation"), "cluster", "is_test")


# --- retrieval ---------------------------------------------------------------------------------------------------


def _dense(spark: SparkSession, d: str, k: int, where=None) -> DataFrame:
    points = _decls(spark, d)
    points = points if where is None else points.where(where)
    return search.dense_topk(_searches(spark, d).select("id", F.col("text").alias("v")), points.select(F.col("decl_id").alias("id"), D.declaration_text().alias("v")), k, vectors=embed.hash_vectors())


def _sparse(spark: SparkSession, d: str, k: int) -> DataFrame:
    points = _decls(spark, d).select(F.col("decl_id").alias("id"), D.sparse_text().alias("text"))
    weights = written(search.idf(search.postings(points), _read(spark, d, "declarations").count()), "idf")
    return search.sparse_topk(_searches(spark, d).select("id", "text"), points, weights, k)


def _named(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("id").alias("decl_id"), "score", "rank")


def dense_hash_search_topk(spark: SparkSession, d: str) -> DataFrame:
    """F13, J1, T2."""
    return _named(_dense(spark, d, SHOWN))


def sparse_idf_search_topk(spark: SparkSession, d: str) -> DataFrame:
    """J2, T3."""
    return _named(_sparse(spark, d, SHOWN))


def fusion_rrf_search(spark: SparkSession, d: str) -> DataFrame:
    """R7."""
    return _named(search.fuse(_dense(spark, d, POOL), _sparse(spark, d, POOL), SHOWN))


def faceted_filter_search(spark: SparkSession, d: str) -> DataFrame:
    """Filtered before ranking."""
    return _named(_dense(spark, d, SHOWN, search.facet_filter(library="corelib, tessera", kind="Lemma,Theorem", chapter=" ")))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    payload = _decls(spark, d).select(F.col("decl_id").alias("id"), "name", "type_signature", "docstring", "statement")
    queries = _searches(spark, d).select(F.col("id").alias("query_id"), F.col("text").alias("query"))
    return written(_dense(spark, d, POOL).join(payload, "id").join(queries, "query_id"), "hits")


def lexical_rrf_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The flagship."""
    top = rerank.rerank(_hits(spark, d), SHOWN, "auto")
    return top.select("query_id", F.col("id").alias("decl_id"), "rank", "dense_rank", "lexical", F.round("display_score", 6).alias("display_score"))


def rerank_passthrough(spark: SparkSession, d: str) -> DataFrame:
    """R4, T1."""
    pool = search.candidate_pool(SHOWN, passthrough=True)
    top = rerank.rerank(_dense(spark, d, pool), SHOWN, "off")
    return top.select("query_id", F.col("id").alias("decl_id"), "rank", F.round("display_score", 6).alias("display_score"))


def dense_knn_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """J1 over given vectors: every vector whose id is divisible by 50 against all others."""
    v = _read(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    found = search.dense_topk(v.where("id % 50 = 0"), v, SHOWN, vectors=search.array_vectors(64), skip_self=True)
    return found.select("query_id", F.col("id").alias("vec_id"), "score", "rank")


# --- facets, dedupe, index maintenance ---------------------------------------------------------------------------


def facet_counts(spark: SparkSession, d: str) -> DataFrame:
    """A1."""
    return enrich.facet_counts(_read(spark, d, "declarations"), "library", "kind", "chapter")


def stats_summary(spark: SparkSession, d: str) -> DataFrame:
    """A2."""
    s = enrich.stats(_read(spark, d, "declarations"))
    show = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e.key, e.value.cast("string"))), ";")
    return s.select("total_points", show("libraries").alias("libraries"), show("kinds").alias("kinds"))


def inspect_profile(spark: SparkSession, d: str) -> DataFrame:
    """A3."""
    return enrich.profile(_decls(spark, d))


def inspect_rows(spark: SparkSession, d: str) -> DataFrame:
    """W2, T5."""
    found = enrich.inspect(_decls(spark, d), library="corelib", kind="lemma", search="Unique")
    return found.orderBy("decl_id").limit(10).select("decl_id", "kind", "name", "library")


def top_kinds(spark: SparkSession, d: str) -> DataFrame:
    """A3."""
    return enrich.top_kinds(_decls(spark, d), "decl_id")


def describe_fill(spark: SparkSession, d: str) -> DataFrame:
    """F14, F15."""
    return enrich.enrich(_decls(spark, d)).select("decl_id", "docstring", "docstring_generated")


def dedupe_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """R8."""
    return enrich.dedupe_declarations(_decls(spark, d), [F.asc("decl_id")]).select("decl_id", "library", "kind", "name")


def cache_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each id."""
    last = files.latest_descriptions(_read(spark, d, "description_log"), [F.desc("log_id")])
    return last.select(F.col("id").cast("string").alias("id"), "log_id", "nl_description")


def description_writeback(spark: SparkSession, d: str) -> DataFrame:
    """J6."""
    last = files.latest_descriptions(_read(spark, d, "description_log"), [F.desc("log_id")])
    decls = _read(spark, d, "declarations").join(_read(spark, d, "index_points").select("decl_id", "id"), "decl_id")
    return index.write_back(decls.select("decl_id", "id", "nl_description"), last, "id").select("decl_id", "nl_description")


def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Declarations that are not indexed."""
    return index.missing_from(_read(spark, d, "declarations"), _read(spark, d, "index_points"), ["decl_id"]).select("decl_id", "name")


def prune_stale(spark: SparkSession, d: str) -> DataFrame:
    """Points whose declaration is still in the training split."""
    kept = _read(spark, d, "declarations").where(F.lower(F.trim("split")) == "train")
    return index.still_in(_read(spark, d, "index_points"), kept, ["decl_id"]).select("point_id", "decl_id")


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    """K4: the log's first rows as the old state, its later ones as an update."""
    log = _read(spark, d, "description_log").select(F.col("id").cast("string").alias("id"), "log_id", "name")
    late = F.col("log_id") % 3 == 0
    old = files.latest_descriptions(log.where(~late), [F.asc("log_id")])
    return index.upsert(old, log.where(late), ["id"], [F.desc("log_id")]).select("id", "log_id", "name")


# --- training data, attachment -----------------------------------------------------------------------------------


def hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    """J10, J11, R11."""
    f = written(traindata.features(_decls(spark, d), "decl_id"), "features")
    return traindata.hard_negatives(f).select(F.col("seq").alias("decl_id"), F.col("neg_seq").alias("neg_id"), "neg_name", "class", "place")


def _training(spark: SparkSession, d: str) -> DataFrame:
    gold = _read(spark, d, "nl_queries").select(F.explode("gold").alias("name"))
    return traindata.training_rows(_decls(spark, d), "decl_id", 0.1, 5, gold)


def training_rows(spark: SparkSession, d: str) -> DataFrame:
    """F25, J8, R11 and the split."""
    return _training(spark, d).select(F.col("seq").alias("decl_id"), "is_test", "query", "real_query", F.array_join("neg_names", "|").alias("neg_names"))


def triplet_explode(spark: SparkSession, d: str) -> DataFrame:
    """U5."""
    return traindata.triplets(_training(spark, d).where("not is_test"))


def training_summary(spark: SparkSession, d: str) -> DataFrame:
    """A12."""
    return traindata.training_summary(_training(spark, d))


def _informal(spark: SparkSession, d: str) -> DataFrame:
    q = _read(spark, d, "nl_queries").select("query_id", F.posexplode("gold").alias("pos", "informal_name"), F.col("query").alias("informal_description"), F.col("source_statement").alias("signature"))
    return q.select((F.col("query_id") * 100 + F.col("pos")).alias("seq"), "informal_name", "informal_description", "signature")


def jaccard_best_match(spark: SparkSession, d: str) -> DataFrame:
    """F27, J7."""
    return attach.best_descriptions(_decls(spark, d), _informal(spark, d), "decl_id").select("decl_id", "description", F.round("overlap", 6).alias("overlap"))


def eval_candidates(spark: SparkSession, d: str) -> DataFrame:
    """W6, A10, F28, F30."""
    decls = _decls(spark, d)
    c = attach.eval_candidates(decls, attach.best_descriptions(decls, _informal(spark, d), "decl_id"), "decl_id")
    return attach.eval_set(c, 0.5).select("query", F.col("gold")[0].alias("gold"), "hint")


def corpus_variants(spark: SparkSession, d: str) -> DataFrame:
    """K9."""
    decls = _decls(spark, d)
    told = attach.best_descriptions(decls, _informal(spark, d), "decl_id")
    held = attach.eval_candidates(decls, told, "decl_id").where(T.hash_sample("name", 0.5))
    return attach.corpus_variants(decls, told, held, "decl_id").select("decl_id", "base", "enriched", "ship")


def attach_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A13."""
    decls = _decls(spark, d)
    told = attach.best_descriptions(decls, _informal(spark, d), "decl_id")
    return attach.coverage(decls, told, attach.eval_candidates(decls, told, "decl_id"), "decl_id")


def identifier_leaks(spark: SparkSession, d: str) -> DataFrame:
    """W7."""
    return _read(spark, d, "nl_queries").select("query_id", attach.leaks_identifier().alias("leaks"))


def gold_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The last declaration of each gold name."""
    last = attach.latest_by_name(_read(spark, d, "declarations").select("decl_id", "name"), "decl_id")
    gold = _read(spark, d, "nl_queries").select("query_id", F.explode("gold").alias("name"))
    return gold.join(last, "name").select("query_id", "name", "decl_id")


# --- evaluation, mining, sampling --------------------------------------------------------------------------------


def _ranked(spark: SparkSession, d: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Unqualified names in the order of retrieval, and the gold names."""
    names = _decls(spark, d).select(F.col("decl_id").alias("id"), F.substring_index("name", ".", -1).alias("name"))
    gold = _searches(spark, d).select(F.col("id").alias("query_id"), F.explode("gold").alias("name"))
    return written(_dense(spark, d, k).join(names, "id").select("query_id", "rank", "name"), "ranked"), gold


def eval_recall_mrr_map(spark: SparkSession, d: str) -> DataFrame:
    """A6-A8, J13, W9."""
    return metrics.per_query(*_ranked(spark, d, 50)).select("query_id", "n_gold", "best_rank", *(F.round(c, 6).alias(c) for c in ("recall5", "recallk", "rrk", "rr", "apk")))


def eval_hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    """By topic."""
    rows = metrics.per_query(*_ranked(spark, d, 50))
    hints = _read(spark, d, "nl_queries").select("query_id", F.coalesce("hint", F.lit("?")).alias("hint"))
    return metrics.summary(rows.join(hints, "query_id"), ["hint"])


def gold_rank_depth50(spark: SparkSession, d: str) -> DataFrame:
    """R10."""
    return metrics.gold_ranks(*_ranked(spark, d, 50)).select("query_id", "gold_rank", F.array_join("top_names", "|").alias("top_names"))


def self_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Ranks without the query's own name, here its last gold name."""
    ranked, _ = _ranked(spark, d, 50)
    own = _searches(spark, d).select(F.col("id").alias("query_id"), F.try_element_at("gold", F.lit(-1)).alias("own_name"))
    return metrics.drop_self(ranked.join(own, "query_id")).where("rank <= 10").select("query_id", "rank", "name")


def embedded_points(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by an embedder made once in each task; their directions used and their lengths."""
    texts = _decls(spark, d).select("decl_id", D.declaration_text().alias("text"))
    v = embed.embed_column(texts, "text", embed.HashEmbedder)
    square = F.aggregate("dense", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return v.select("decl_id", F.size(F.filter("dense", lambda x: x != 0)).cast("long").alias("n_used"), F.round(F.sqrt(square), 3).alias("length"))


def index_resume_prune(spark: SparkSession, d: str) -> DataFrame:
    """The ids of an index that held one library, and was then resumed and pruned with all lemmas."""
    decls = _read(spark, d, "declarations").drop("docstring_generated", "split", "extracted_at", "loaded_at", "decl_id")
    i = index.Index(spark, fresh_path(spark, "index"))
    i.build(decls.where("library = 'corelib'"))
    i.build(decls.where("kind = 'Lemma'"), resume=True, prune=True)
    return i.points().select(F.col("id").cast("string").alias("id"), "library")


def premise_edges(spark: SparkSession, d: str) -> DataFrame:
    """Names of declarations that statements mention."""
    decls = _decls(spark, d).withColumn("short", F.substring_index("name", ".", -1))
    stems = decls.select(T.concept_stem("short").alias("name")).where("name <> ''").distinct()
    found = mining.premises(decls, stems, ["decl_id"], "short", "statement").where(F.size("premises").between(1, 15))
    return found.select("decl_id", F.array_join("premises", "|").alias("premises"))


def strided_sample(spark: SparkSession, d: str) -> DataFrame:
    """T4."""
    return mining.strided_sample(_read(spark, d, "orders").select("o_orderkey", "o_totalprice"), 1500, [F.asc("o_orderkey")])


def _source_files(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are sources, and those of unknown kind that hold a declaration."""
    docs = _read(spark, d, "documents").where("doc_kind = 'source' or doc_kind is null")
    files_ = docs.select("doc_kind", F.coalesce("library", F.lit("unknown")).alias("library"), F.concat(F.lit("docs/d"), "doc_id", F.lit(".v")).alias("file_path"), F.col("source").alias("source_path"), "text")
    untold = files_.where("doc_kind is null")
    sources = untold.join(parse.parse_sources(untold).select("file_path"), "file_path", "left_semi")
    return files_.where("doc_kind = 'source'").unionByName(sources).drop("doc_kind")


def parse_declarations(spark: SparkSession, d: str) -> DataFrame:
    """P1-P7."""
    return parse.parse_sources(_source_files(spark, d))


def strip_nested_comments(spark: SparkSession, d: str) -> DataFrame:
    """P2, P3."""
    return parse.parse_statements(_source_files(spark, d))


def proof_grouping(spark: SparkSession, d: str) -> DataFrame:
    """R9."""
    return mining.group_proofs(written(parse.parse_statements(_source_files(spark, d)), "statements"), ["library", "file_path"])


def mine_premises(spark: SparkSession, d: str) -> DataFrame:
    """R9, W4, W5."""
    s = written(parse.parse_statements(_source_files(spark, d)), "statements")
    known = _decls(spark, d).select(F.substring_index("name", ".", -1).alias("name")).unionByName(s.select("name"))
    return mining.mine(s, files.corpus_names(known))


def rate_limit_window_count(spark: SparkSession, d: str) -> DataFrame:
    """X1 as a plain window."""
    return ratelimit.calls_in_window(_read(spark, d, "events").select("event_id", "user_id", "ts"), 86400, "user_id").select("event_id", "user_id", "n_recent")


def rate_limit_stateful(spark: SparkSession, d: str) -> DataFrame:
    """X1."""
    return ratelimit.limit_rate(_read(spark, d, "events"), 3, 86400, "user_id", "ts", "event_id").select(F.col("event_id"), "user_id", "accepted")


_QUERIES = (
    compact_ws_documents, stable_id_declarations, normalized_declarations, url_chapter_extract, prompt_and_display, hash_bucket_tokens, sparse_tokens_tf, document_frequency_idf, hash_sample, cluster_key_split,
    dense_hash_search_topk, sparse_idf_search_topk, fusion_rrf_search, faceted_filter_search, lexical_rrf_rerank, rerank_passthrough, dense_knn_embeddings,
    facet_counts, stats_summary, inspect_profile, inspect_rows, top_kinds, describe_fill, dedupe_first_wins, cache_latest, description_writeback, resume_anti_join, prune_stale, upsert_latest,
    hard_negatives, training_rows, triplet_explode, training_summary, jaccard_best_match, eval_candidates, corpus_variants, attach_coverage, identifier_leaks, gold_lookup,
    eval_recall_mrr_map, eval_hit_at_k, gold_rank_depth50, self_exclusion, embedded_points, index_resume_prune, premise_edges, strided_sample, parse_declarations, strip_nested_comments, proof_grouping, mine_premises, rate_limit_window_count, rate_limit_stateful,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    from theoremlake.oracle import oracle_sql as sql

    return sql()
