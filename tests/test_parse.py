"""The parser's behaviour, also where it surprises."""

import pytest
from pyspark.sql import functions as F

from theoremlake.operators import mining
from theoremlake.sources import files
from theoremlake.sources.parse import clean_doc, declarations, module_of, parse_sources, parse_statements, statements, strip_comments, type_of


def one(text, **kw):
    return [(n, k, t, d, line) for _, n, k, t, _, d, line in declarations(text, **kw)]


def test_docs_and_lines():
    text = "(* header *)\n(** Adds. (* inner *) more *)\nLemma a :\n  x = x.\nProof. auto. Qed.\n\nDefinition b (n : nat) : nat := n.\n"
    assert one(text) == [("a", "Lemma", "x = x", "Adds. (* inner *) more", 2), ("b", "Definition", "nat", "", 5)]


def test_a_stop_ends_a_statement_anywhere():
    assert [s.text for s in statements('Check Nat.add. Print "a.b (* c". tail')] == ["Check Nat.", "add.", 'Print "a.b (* c".']


def test_doc_before_proof_is_lost_and_latest_doc_wins():
    assert one("(** one *) Lemma a (** two *) : T.\n(** gone *) Proof. Lemma b : T.") == [("a", "Lemma", "T", "two", 1), ("b", "Lemma", "T", "", 2)]


def test_names_and_types():
    assert one("Lemma foo' : a = b.") == [("foo", "Lemma", "' : a = b", "", 1)]
    assert one("Lemma foo' : a = b.", strict=False) == [("foo'", "Lemma", "a = b", "", 1)]
    assert one("Lemma fooα : a.") == [] and one("Axiom a : T.") == []
    assert type_of(":= 3") == "= 3" and type_of(":= 3", strict=False) == "" and type_of("(n : nat) := n") == "nat)" and type_of("(n m : nat)") == "(n m : nat)" and type_of("") == ""
    assert one("Local Program Definition p : T := 1.")[0][:3] == ("p", "Program Definition", "T := 1") and one("Program  Definition p : T.") == []


def test_comments():
    assert strip_comments('a (* b (* c *) "d *) e "(* f *)"') == 'a  e "(* f *)"' and strip_comments("a (* b") == "a "
    assert clean_doc("(** A\n * b\n\n ** c *)") == "A b * c" and clean_doc("(**)") == "(**)" and clean_doc("(*****)") == "*"
    assert module_of("a/b.c/D.v") == "a.b.c.D" and module_of("") == ""


def test_sources(spark, tmp_path):
    (tmp_path / "lib/Axioms").mkdir(parents=True)
    (tmp_path / "lib/AxiomsX").mkdir()
    (tmp_path / "lib/Axioms/A.v").write_bytes(b"Lemma a : T. (* \xff *)\nTHEOREM x. Theorem c : T.")
    (tmp_path / "lib/AxiomsX/B.v").write_text("Fact b : T.")
    (tmp_path / "lib/n.txt").write_text("Fact no : T.")
    spec = f"{tmp_path}/lib=my"
    assert sorted(r.file_path for r in files.read_sources(spark, [spec]).collect()) == ["Axioms/A.v", "AxiomsX/B.v"]
    assert [r.file_path for r in files.read_sources(spark, [spec], ["Axioms"]).collect()] == ["Axioms/A.v"]
    assert files.extract(spark, [spec], f"{tmp_path}/out", kinds=["THEOREM"]) == 1
    row = files.read_declarations(spark, f"{tmp_path}/out").first()
    assert (row.name, row.library, row.module_path, row.line_number) == ("c", "my", "Axioms.A", 2)
    with pytest.raises(FileNotFoundError):
        files.read_sources(spark, [f"{tmp_path}/none"])
    assert files.parse_source("a=b=c") == ("a=b", "c") and files.parse_source("/x/y/") == ("/x/y/", "y")
    with pytest.raises(ValueError):
        files.parse_source("a=")


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([("l", None, None, None), ("l", "a.v", "s", ""), ("l", "b.v", "s", "Lemma q : T.")], "library string, file_path string, source_path string, text string")
    assert [r.name for r in parse_sources(df).collect()] == ["q"]
    assert parse_sources(df.limit(0)).count() == 0


def test_mining(spark):
    text = "Lemma aaa : T. Proof. rewrite bbb; apply aaa. Qed. Lemma bbb : T. Lemma ccc : T. apply aaa bbb zz. Defined. Theorem ddd : T. auto. Definition e : T. apply bbb. Qed. Lemma open : T. apply bbb."
    s = parse_statements(spark.createDataFrame([("l", "f.v", text)], "library string, file_path string, text string"))
    got = {r.name: r.premises for r in mining.mine(s, files.corpus_names(s)).collect()}
    assert got == {"aaa": ["bbb"], "ccc": ["aaa", "bbb"]}
    assert mining.mine(s, files.corpus_names(s), low=2).count() == 1


def test_strided(spark):
    df = spark.range(0, 103).select(F.col("id"), (F.col("id") % 2).alias("g"))
    want = [int(i * 103 / 10) for i in range(10)]
    assert sorted(r.id for r in mining.strided_sample(df, 10, [F.asc("id")]).collect()) == want
    assert sorted(r.id for r in mining.strided_sample(df, 10, [F.asc("id")], ["g"]).collect()) == sorted([2 * int(i * 52 / 10) for i in range(10)] + [2 * int(i * 51 / 10) + 1 for i in range(10)])
    assert mining.strided_sample(df, 500, [F.asc("id")]).count() == 103 and mining.strided_sample(df.limit(0), 5, [F.asc("id")]).count() == 0
