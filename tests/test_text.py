"""Column builders against the same rules written in Python."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from theoremlake.functions import declarations as D
from theoremlake.functions import text as T
from theoremlake.operators import rerank, search

SAMPLES = ["addnC", "foo_bar2 HTTPServer ABCd", "", None, "  a  b c\x1c d ", "x", "é fooBar'z Q1", "mulrA_sym Lemma1 fooα", "ABC aB1c 12 a1B2"]


def tokens(text):
    out = []
    for w in re.findall("[A-Za-z][A-Za-z0-9]*", text or ""):
        parts = [w.lower()] + [p.lower() for p in re.findall("[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])", w) if p.lower() != w.lower()]
        out += [p for p in parts if len(p) >= 2]
    return out


def number(t, digits=8):
    return int(hashlib.sha256(t.encode()).hexdigest()[:digits], 16)


def column(spark, values, build):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in df.select("i", build("t").alias("x")).orderBy("i").collect()]


def test_white_space(spark):
    assert column(spark, SAMPLES, T.compact_ws) == [re.sub(r"\s+", " ", t or "").strip() for t in SAMPLES]


def test_identifier_tokens(spark):
    assert column(spark, SAMPLES, T.identifier_tokens) == [tokens(t) for t in SAMPLES]
    found = search.postings(spark.createDataFrame(list(enumerate(SAMPLES)), "id long, text string")).collect()
    for i, t in enumerate(SAMPLES):
        assert {(r.token_id, r.tf) for r in found if r.id == i} == {(number(x) % 2**31, tokens(t).count(x)) for x in tokens(t)}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abcABC019_'é \t.", max_size=30), min_size=1, max_size=20))
def test_tokens_of_any_text(spark, values):
    assert column(spark, values, T.identifier_tokens) == [tokens(t) for t in values]


def test_hashes(spark):
    assert [int(x) for x in column(spark, ["a", "", "ü"], lambda c: T.hash_int(c, 16))] == [number(t, 16) for t in ("a", "", "ü")]
    assert column(spark, ["a", "bc"], T.token_id) == [number("a") % 2**31, number("bc") % 2**31]
    assert column(spark, ["a", "bc"], lambda c: T.hash_sample(c, 0.5)) == [number(t) % 10000 < 5000 for t in ("a", "bc")]


def test_concepts(spark):
    names = ["cong_transitivity", "perp_sym", "col_permutation_1", "sym_refl", "", None]
    assert column(spark, names, T.concept_stem) == ["cong", "perp", "col", "", "", ""]
    assert column(spark, names[:2], T.relation_signature) == [["transitivity"], ["sym"]]


def test_cluster_key(spark):
    rows = [("l", "Lemma a_sym : Cong A B C1 -> P'  x.", "", "a_sym"), ("l", "Lemma other :  Cong C D X2 -> P' x.", "", "other"), ("l", None, None, None), ("l", "", "T -> A", "n")]
    df = spark.createDataFrame(rows, "lib string, s string, t string, n string")
    keys = [r.k for r in df.select(T.cluster_key("lib", "s", "t", "n").alias("k")).collect()]
    assert keys[0] == keys[1] and keys[2] == "name::" and keys[3] == "l::_ -> _"


def test_lexical_score_by_join_is_the_expression(spark):
    docs = [(1, "comm_group", "nat", "A commutative thing", ""), (2, "inj", "", None, "injective maps"), (3, "z", "", "", "")]
    queries = [(1, "commut injec group group"), (2, "inject the of"), (3, "")]
    df = spark.createDataFrame([(q, d[0], t, *d[1:]) for q, t in queries for d in docs], "query_id long, id long, query string, name string, type_signature string, docstring string, statement string")
    want = df.select("query_id", "id", T.lexical_score(T.query_terms("query"), T.token_set("name", "type_signature", "docstring", "statement")).alias("s")).collect()
    got = {(r.query_id, r.id): r.lexical for r in rerank.lexical_scores(df).collect()}
    assert {(r.query_id, r.id): r.s for r in want} == {(r.query_id, r.id): got.get((r.query_id, r.id), 0.0) for r in want}
    assert got[1, 1] == 2.5


def test_normalize_takes_both_shapes(spark):
    df = spark.createDataFrame([("n", "Lemma", " a  b ", "doc", "geocoq", "theories/Ch12_x.v", 7)], "name string, kind string, type string, doc string, library string, file string, line long")
    r = D.normalize(df).first()
    assert (r.type_signature, r.docstring, r.file_path, r.line_number, r.chapter) == ("a b", "doc", "theories/Ch12_x.v", 7, "Ch12")
    assert r.github_url.endswith("/theories/theories/Ch12_x.v#L7")
    bare = D.normalize(spark.createDataFrame([(None, 0)], "library string, line_number long")).first()
    assert (bare.library, bare.line_number, bare.name, bare.github_url) == ("unknown", 0, "", "")


def test_source_url_strips_the_folder_once(spark):
    df = spark.createDataFrame([("stdlib", "theories/theories/A.v"), ("hott", "x/theories/A.v"), ("nowhere", "A.v")], "l string, p string")
    urls = [r.u for r in df.select(D.source_url(F.col("l"), F.col("p"), F.lit(3)).alias("u")).collect()]
    assert urls[0].endswith("master/theories/theories/A.v#L3") and urls[1].endswith("/theories/x/theories/A.v#L3") and urls[2] == ""
