"""That the parser's queries read every document that is a source."""

from theoremlake import queries as Q


def test_sources_of_unknown_kind_are_parsed(spark, tmp_path):
    code = "(* x *) Lemma a_one : forall x, x = x.\nProof. apply b_two. Qed."
    rows = [(1, code, "source"), (2, code.replace("a_one", "b_two"), None), (3, "A sentence. And one more.", None), (4, None, None), (5, "Theorem null: [[count]].", "manual")]
    spark.createDataFrame([(*r, "corelib", "s") for r in rows], "doc_id long, text string, doc_kind string, library string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    assert sorted((r.name, r.file_path) for r in Q.parse_declarations(spark, d).collect()) == [("a_one", "docs/d1.v"), ("b_two", "docs/d2.v")]
    assert {r.file_path for r in Q.strip_nested_comments(spark, d).collect()} == {"docs/d1.v", "docs/d2.v"}
    assert {r.file_path for r in Q.proof_grouping(spark, d).collect()} == {"docs/d1.v", "docs/d2.v"}
