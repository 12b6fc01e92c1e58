"""Search, rerank, index, metrics, training data, attachment, rate limits, service and command line."""

import datetime as dt
import json
import math
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from theoremlake import cli
from theoremlake.operators import attach, describe, embed, enrich, index, metrics, rerank, search, traindata
from theoremlake.service import Rejected, Service
from theoremlake.streaming import indexing, ratelimit

DECL = "name string, kind string, type_signature string, statement string, docstring string, library string, file_path string, line_number long"
ROWS = [
    ("add_comm", "Lemma", "a + b = b + a", "Lemma add_comm : a + b = b + a.", "Addition commutes", "std", "A.v", 1),
    ("add_assoc", "Lemma", "x", "Lemma add_assoc : x.", None, "std", "A.v", 2),
    ("mul", "Definition", "", "", "", "alg", "B.v", 3),
]


@pytest.fixture(scope="module")
def points(spark):
    return index.to_points(spark.createDataFrame(ROWS, DECL)).cache()


def test_hash_embedder():
    e = embed.make_embedder("hash")
    a, b, z = e.embed(["foo bar_foo", "foo foo bar", ""])
    assert a == b and math.isclose(sum(x * x for x in a), 1) and not any(z) and len(a) == 384
    with pytest.raises(RuntimeError):
        embed.make_embedder("openai")


def test_embed_column(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id int, t string")
    got = {r.id: r.dense for r in embed.embed_column(df, "t", embed.HashEmbedder).collect()}
    assert len(got[1]) == 384 and not any(got[2])


@pytest.mark.parametrize("block", [4096, 2])
def test_dense_topk(spark, block):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (40, 5)).astype(float)
    x[3] = 0
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<float>").repartition(3)
    got = {}
    for r in search.dense_topk(v.where("id % 8 = 3"), v, 4, vectors=search.array_vectors(5), skip_self=True, block=block).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.id
    norm = np.sqrt((x * x).sum(1))
    for q in range(3, 40, 8):
        s = {i: round(float(x[q] @ x[i] / (norm[q] * norm[i])), 6) if norm[q] * norm[i] else 0.0 for i in range(40) if i != q}
        assert [got[q][r] for r in (1, 2, 3, 4)] == sorted(s, key=lambda i: (-s[i], i))[:4]
    assert search.dense_topk(v.limit(0), v, 4, vectors=search.array_vectors(5)).count() == 0


def test_facet_filter(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "library string, kind string")
    n = lambda **f: df.where(search.facet_filter(**f)).count()
    assert (n(), n(library="", kind="  "), n(library="a"), n(library="a, b", kind="x"), n(library=","), n(kind="X")) == (3, 3, 1, 2, 0, 0)


def test_fusion_and_sparse(spark):
    q = spark.createDataFrame([(1, "red fish"), (2, None)], "id long, text string")
    p = spark.createDataFrame([(1, "red red fish"), (2, "fish"), (3, "blue"), (4, None)], "id long, text string")
    w = search.idf(search.postings(p), 4)
    got = [(r.id, r.score) for r in search.sparse_topk(q, p, w, 5).orderBy("rank").collect()]
    red, fish = math.log(3.5 / 1.5 + 1), math.log(2.5 / 2.5 + 1)
    assert got == [(1, round(2 * red + fish, 6)), (2, round(fish, 6))]
    lists = [spark.createDataFrame(x, "query_id long, id long, rank int") for x in ([(1, 7, 1), (1, 8, 2)], [(1, 8, 1), (1, 9, 2)])]
    assert [r.id for r in search.fuse(*lists, 5).orderBy("rank").collect()] == [8, 7, 9]


def test_rerank_modes(spark):
    hits = spark.createDataFrame([(1, 1, 1, 0.5, "comm", "zzz"), (1, 2, 2, 0.25, "comm", "comm")], "query_id long, id long, rank int, score double, query string, name string")
    hits = hits.withColumns({c: F.lit("") for c in ("type_signature", "docstring", "statement")}).withColumn("document", F.col("name"))
    fused = {r.id: r for r in rerank.rerank(hits, 5).collect()}
    assert fused[1]["rank"] == 1 and fused[2]["lexical"] == 1.0 and fused[1].display_score == 1.0
    assert [r.display_score for r in rerank.rerank(hits, 5, "off").orderBy("rank").collect()] == [1.0, 0.5]
    cross = rerank.rerank(hits, 5, "cross", score=lambda pairs: [float(d == "comm") for _, d in pairs])
    assert [r.id for r in cross.orderBy("rank").collect()] == [2, 1]
    assert rerank.rerank(hits, 1, "cross").count() == 1  # no model: the order of retrieval


def test_enrich_and_profile(spark):
    df = enrich.enrich(spark.createDataFrame(ROWS, DECL))
    got = {r.name: (r.docstring, r.docstring_generated) for r in df.collect()}
    assert got["add_assoc"] == ("Lemma add_assoc: x", True) and got["add_comm"][1] is False and got["mul"][0] == "Defines mul."
    s = enrich.stats(df).first()
    assert (s.total_points, dict(s.libraries), dict(s.kinds)) == (3, {"std": 2, "alg": 1}, {"Lemma": 2, "Definition": 1})
    assert enrich.stats(df.limit(0)).first().total_points == 0
    assert enrich.inspect(df, kind="LEMMA", search="ADDITION").count() == 1
    assert enrich.top_kinds(df, "line_number", 1).first().kind == "Lemma"


def test_index(spark, tmp_path):
    i = index.Index(spark, f"{tmp_path}/ix")
    df = spark.createDataFrame(ROWS, DECL)
    assert i.points() is None and i.build(df) == 3 and i.build(df) == 3
    changed = df.withColumn("docstring", F.lit("new"))
    i.build(changed)
    assert "new" not in {r.docstring for r in i.points().collect()}
    i.build(changed, resume=False)
    assert {r.docstring for r in i.points().collect()} == {"new"}
    assert i.build(df.limit(1), prune=True) == 1
    i.vacuum()
    assert i.points().count() == 1
    i.reset()
    assert i.points() is None


def test_index_stream(spark, tmp_path):
    df = spark.createDataFrame(ROWS, DECL)
    df.write.json(f"{tmp_path}/in")
    i = index.Index(spark, f"{tmp_path}/ix")
    stream = lambda: spark.readStream.schema(df.schema).json(f"{tmp_path}/in")
    indexing.index_stream(stream(), i, f"{tmp_path}/cp").awaitTermination(120)
    assert i.points().count() == 3
    indexing.index_stream(stream(), i, f"{tmp_path}/cp2").awaitTermination(120)
    assert i.points().count() == 3


def test_write_back_and_latest(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, nl_description string")
    c = spark.createDataFrame([(1, "  "), (2, "new")], "id int, nl_description string")
    assert {r.id: r.nl_description for r in index.write_back(d, c, "id").collect()} == {1: "a", 2: "new", 3: "c"}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (1, 4, "c"), (2, 1, "x")], "query_id long, rank int, name string")
    gold = spark.createDataFrame([(1, "a"), (1, "z"), (1, "a"), (2, "y"), (3, None)], "query_id long, name string")
    got = {r.query_id: r for r in metrics.per_query(ranked, gold).collect()}
    assert set(got) == {1, 2} and (got[1].n_gold, got[1].best_rank, got[1].recall5, got[1].rr) == (2, 1, 0.5, 1.0)
    assert math.isclose(got[1].apk, (1 + 2 / 3) / 2) and got[2].rr == 0 and got[2].best_rank is None
    s = metrics.summary(metrics.per_query(ranked, gold)).first()
    assert (s.queries, s.hit1, s.mrr) == (2, 0.5, 0.5)
    own = metrics.drop_self(ranked.withColumn("own_name", F.lit("a")))
    assert [(r["rank"], r.name) for r in own.where("query_id = 1").orderBy("rank").collect()] == [(1, "b"), (2, "c")]
    assert {r.query_id: (r.gold_rank, r.top_names) for r in metrics.gold_ranks(ranked, gold).collect()} == {1: (1, ["a", "b", "a"]), 2: (None, ["x"])}


def brute_negatives(rows, k):
    out = {}
    for a in rows:
        if not a["stem"]:
            continue
        cands = {}
        sib = [c for c in rows if (c["library"], c["stem"]) == (a["library"], a["stem"])]
        look = [c for c in rows if c["library"] == a["library"] and c["lookalike"] and a["stem"] in c["name"].lower()]
        for c in sib + look:
            if c["cluster"] != a["cluster"] and c["name"] != a["name"]:
                cands[c["name"]] = c
        def rank(c):
            if c["lookalike"] and a["stem"] in c["name"].lower():
                return 0
            return 2 if not c["relation"] else 1 if c["relation"] != a["relation"] else 3
        out[a["seq"]] = [(c["seq"], rank(c)) for c in sorted(cands.values(), key=rank)[:k]]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hard_negatives_are_those_of_all_pairs(spark, seed):
    rng = random.Random(seed)
    names = ["foo_sym", "foo_refl", "foo_trans", "foo_x", "foo_y", "characterization_of_foo", "foo_characterization", "bar_sym", "bar", "foo_sym_refl", "sym"]
    rows = [(i, rng.choice(["l", "m"]), rng.choice(names), f"s{rng.randint(0, 5)}") for i in range(120)]
    df = spark.createDataFrame(rows, "seq long, library string, name string, statement string").withColumns({c: F.lit("") for c in ("type_signature",)})
    f = traindata.features(df, "seq").cache()
    want = brute_negatives([r.asDict() for r in f.orderBy("seq").collect()], 3)
    got = {}
    for r in traindata.hard_negatives(f, 3).orderBy("seq", "place").collect():
        got.setdefault(r.seq, []).append((r.neg_seq, r["class"]))
    assert got == {k: v for k, v in want.items() if v}


def test_training_rows_keep_sides_apart(spark):
    from theoremlake.functions.declarations import normalize

    rng = random.Random(5)
    rows = [(i, f"foo_{rng.choice(['sym', 'refl', 'x', 'y'])}{i}", f"T{i // 2}", "l") for i in range(60)]
    df = normalize(spark.createDataFrame(rows, "seq long, name string, statement string, library string"))
    gold = spark.createDataFrame([("foo_none",), (rows[4][1],)], "name string")
    out = traindata.training_rows(df, "seq", 0.3, 4, gold).collect()
    side = {r.name: r.is_test for r in out}
    assert len(out) == 60 and side[rows[4][1]] and all(side[n] == r.is_test for r in out for n in r.neg_names)
    summary = traindata.training_summary(traindata.training_rows(df, "seq", 0.3, 4)).collect()
    assert sum(r.n_rows for r in summary) == 60


def test_attach(spark):
    decls = spark.createDataFrame([(1, "a", "x y z", "l", "m.n"), (2, "b", "p q", "l", ""), (3, "b", "r", "l", ""), (4, None, "r", "l", "")], "k int, name string, statement string, library string, module_path string").withColumn("type_signature", F.lit(""))
    informal = spark.createDataFrame([(1, "a", "about c", "x"), (2, "a", "best", "x y"), (3, "b", "  ", "p q"), (4, "b", "tie", "r")], "seq long, informal_name string, informal_description string, signature string")
    told = attach.best_descriptions(decls, informal, "k")
    assert {r.k: r.description for r in told.collect()} == {1: "best", 3: "tie"}
    cands = attach.eval_candidates(decls, told, "k")
    assert [r.name for r in cands.collect()] == ["a"]
    v = {r.k: (r.base, r.enriched, r.ship) for r in attach.corpus_variants(decls, told, cands, "k").collect()}
    assert v[1] == ("", "", "best") and v[3] == ("", "tie", "tie") and v[2] == ("", "", "")


def test_describe(spark):
    df = spark.createDataFrame([(1, "a", "l1"), (2, "b", "")], "id int, name string, line string")
    got = describe.describe(df, lambda: lambda lines: [x.upper() for x in lines], "line").collect()
    assert [(int(r.id), r.nl_description) for r in got] == [(1, "L1")]
    states = iter([(429, None), (503, None), (200, "ok")])
    assert describe.with_backoff(lambda: next(states), sleep=lambda s: None) == "ok"
    with pytest.raises(RuntimeError):
        describe.with_backoff(lambda: (404, None), sleep=lambda s: None)


def _events(n=300):
    rng = random.Random(2)
    base = dt.datetime(2024, 1, 1)
    return [(i, rng.choice(["a", "a", "b", None]), base + dt.timedelta(seconds=rng.randint(0, 600))) for i in range(n)]


def _brute(rows, limit, seconds):
    out, recent = {}, {}
    for i, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        d = recent.setdefault(k, deque())
        while d and (t - d[0]).total_seconds() > seconds:
            d.popleft()
        out[i] = len(d) < limit
        if out[i]:
            d.append(t)
    return out


def test_rate_limit(spark):
    rows = _events()
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp")
    assert {r.id: r.accepted for r in ratelimit.limit_rate(df, 3, 60).collect()} == _brute(rows, 3, 60)
    assert all(r.accepted for r in ratelimit.limit_rate(df, 0, 60).collect())
    assert ratelimit.limit_rate(df.limit(0), 3, 60).count() == 0
    gap = spark.createDataFrame([(1, "k", dt.datetime(2024, 1, 1)), (2, "k", dt.datetime(2024, 1, 1, 0, 1)), (3, "k", dt.datetime(2024, 1, 1, 0, 1, 0, 1))], "id long, key string, ts timestamp")
    assert [r.accepted for r in ratelimit.limit_rate(gap, 1, 60).orderBy("id").collect()] == [True, False, True]


def test_rate_limit_stream_is_the_batch(spark, tmp_path):
    rows = [r for r in _events(80) if r[1]]
    df = spark.createDataFrame(rows, "id long, key string, ts timestamp")
    df.write.parquet(f"{tmp_path}/e")
    s = ratelimit.limit_rate_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/e"), 3, 60)
    q = s.writeStream.format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    assert {r.id: r.accepted for r in spark.table("limited").collect()} == _brute(rows, 3, 60)


def test_service(spark, points):
    s = Service(points, rate_limit=0)
    found = s.search("addition commutes", limit=2)
    assert found["results"][0]["name"] == "add_comm" and found["total"] == 2
    assert s.search("add", lib="alg")["results"][0]["name"] == "mul"
    assert Service(points, rate_limit=0, fusion=True, mode="off").search("add_comm")["total"] >= 1
    for bad, status in ((dict(q=" "), 400), (dict(q="x", limit=51), 422)):
        with pytest.raises(Rejected) as e:
            s.search(**bad)
        assert e.value.status == status
    assert s.stats()["libraries"] == {"alg": 1, "std": 2} and s.health()["status"] == "ok"
    assert "### Lemma add_comm  (std)" in s.search_text("addition commutes", 99)
    limited = Service(points, rate_limit=1)
    limited.admit("c", 0.0)
    with pytest.raises(Rejected):
        limited.admit("c", 60.0)
    limited.admit("c", 60.1)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/A.v").write_text("(** Doc. *) Lemma aaa : T. Proof. auto. Qed. Lemma bbb : U. Proof. apply aaa. Qed. Lemma aaa : T.")
    run = lambda *a: cli.main(list(a), spark)
    run("extract", "--source", f"{tmp_path}/src=my", "--out", f"{tmp_path}/d")
    run("enrich", "--input", f"{tmp_path}/d", "--out", f"{tmp_path}/e", "--dedupe")
    run("index", "--input", f"{tmp_path}/e", "--index", f"{tmp_path}/ix")
    assert capsys.readouterr().out.split() == ["3", "2"]
    run("validate", "--input", f"{tmp_path}/e", "--search", "aaa")
    run("describe", "--input", f"{tmp_path}/e", "--cache", f"{tmp_path}/cache", "--out", f"{tmp_path}/f")
    run("describe", "--input", f"{tmp_path}/e", "--cache", f"{tmp_path}/cache", "--out", f"{tmp_path}/f")
    assert spark.read.json(f"{tmp_path}/cache").count() == 2
    run("mine", "--source", f"{tmp_path}/src=my", "--input", f"{tmp_path}/e", "--out", f"{tmp_path}/m")
    assert [json.loads(r.value)["premises"] for r in spark.read.text(f"{tmp_path}/m").collect()] == [["aaa"]]
    run("finetune", "--input", f"{tmp_path}/f", "--out", f"{tmp_path}/t")
    assert spark.read.json(f"{tmp_path}/t").count() == 2


def test_index_writes_what_a_batch_touches(spark, tmp_path):
    i = index.Index(spark, f"{tmp_path}/ix", embedder=embed.HashEmbedder, buckets=8)
    df = spark.createDataFrame([(f"n{k}", "Lemma", "t", f"Lemma n{k} : t.", None, ["std", "007"][k % 2], "A.v", k) for k in range(60)], DECL)
    assert i.build(df) == 60
    before = i._state()["files"]
    assert len(before) == 8 and i.build(df) == 60 and i._state()["files"] == before  # nothing new, nothing written
    one = df.limit(1).withColumn("docstring", F.lit("new"))
    assert i.build(one, resume=False) == 60
    after = i._state()["files"]
    assert sum(after[b] != before[b] for b in before) == 1
    i.vacuum()
    rows = i.points().collect()
    assert len(rows) == 60 and {r.library for r in rows} == {"std", "007"} and sum(r.docstring == "new" for r in rows) == 1 and all(len(r.dense) == 384 for r in rows)
    s = Service(i.points(), rate_limit=0, embedder=embed.HashEmbedder())
    plain = Service(i.points(), rate_limit=0)
    assert [r["name"] for r in s.search("lemma n7", 5)["results"]] == [r["name"] for r in plain.search("lemma n7", 5)["results"]]
    with pytest.raises(Rejected) as e:
        Service(i.points().drop("dense"), rate_limit=0, embedder=embed.HashEmbedder()).search("n7")
    assert e.value.status == 503


def test_descriptions_are_kept_chunk_by_chunk(spark, tmp_path):
    from theoremlake.sources import files

    rows = spark.createDataFrame([(k, f"n{k}", f"l{k}", *[""] * 6, "", 0) for k in range(20)], "id int, name string, line string, kind string, type_signature string, statement string, docstring string, library string, module_path string, nl_description string, line_number int").withColumn("id", F.col("id").cast("decimal(20,0)"))

    def loud():
        return lambda lines: [f"told {x}" for x in lines]

    def broken():
        raise RuntimeError("no service")

    files.describe_log(rows.where("id < 5"), f"{tmp_path}/log", loud, 3)
    with pytest.raises(Exception):  # noqa: B017
        files.describe_log(rows, f"{tmp_path}/log", broken, 3)
    assert files.read_description_log(spark, f"{tmp_path}/log").count() == 5
    files.describe_log(rows, f"{tmp_path}/log", loud, 3)
    got = files.latest_descriptions(files.read_description_log(spark, f"{tmp_path}/log"), [F.desc("described_at")]).collect()
    assert {int(r.id): r.nl_description for r in got} == {k: f"told l{k}" for k in range(20)}


def test_evaluation_from_the_command_line(spark, tmp_path, capsys):
    from theoremlake.sources import files

    files.write_jsonl(spark.createDataFrame(ROWS, DECL), f"{tmp_path}/d")
    (tmp_path / "q.jsonl").write_text(json.dumps({"query": "addition commutes", "gold": ["add_comm"]}) + "\n")
    (tmp_path / "p.jsonl").write_text(json.dumps({"name": "add_comm", "statement": "Lemma add_comm : a + b = b + a.", "premises": ["add_assoc"]}) + "\n")
    cli.main(["eval", "--input", f"{tmp_path}/d", "--queries", f"{tmp_path}/q.jsonl"], spark)
    cli.main(["eval", "--input", f"{tmp_path}/d", "--queries", f"{tmp_path}/p.jsonl", "--premises"], spark)
    out = [line.split("|") for line in capsys.readouterr().out.splitlines() if line.startswith("|1")]
    assert [float(x[2]) for x in out] == [1.0, 1.0]  # a declaration isn't its own premise, so the premise comes first


def test_cross_without_a_working_model(spark):
    hits = spark.createDataFrame([(1, 5, 1, 0.5, "q", "d")], "query_id long, id long, rank int, score double, query string, document string")
    assert rerank.rerank(hits, 1, "cross", score=lambda pairs: 1 / 0).first().id == 5


def test_scopes_delete_their_tables(spark):
    from pathlib import Path

    from theoremlake.plans import scratch

    with scratch.scope(spark):
        path = scratch.fresh_path(spark, "x")
        spark.range(3).write.parquet(path)
        with scratch.scope(spark):
            assert scratch.written(spark.range(5), "y").count() == 5
        assert spark.read.parquet(path).count() == 3
    assert not Path(path.removeprefix("file://")).parent.exists()
