from pathloom.plans import star_queries


def test_untagged_and_indented_prompts_have_a_row(spark, tmp_path):
    texts = ["[system] s\n[user] hello", "\n  [SYSTEM] sys [User] hey", " just text ", "[user] only", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_system, r.n_user) for r in star_queries.prompt_parts_whole(spark, str(tmp_path)).collect()}
    assert got == {0: (1, 5), 1: (3, 3), 2: (None, 9), 3: (None, 4), 4: (None, 0)}
