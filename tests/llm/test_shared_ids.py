"""Near duplicates where rows have no id or share one."""

from gleanguard.llm.ngram_join import drop_near_duplicates


def test_one_row_of_each_class_stays(spark):
    texts = ["a b c d e f", "other words stand here for once", *(f"a text of its own with number {k} {k}" for k in range(4))]
    rows = [(None, texts[0]), (7, texts[0]), (7, texts[1]), (8, texts[1]), (None, texts[2]), (None, texts[3]), (9, texts[4]), (9, texts[5]), (3, texts[5])]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string")
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r["text"], r["doc_id"] or 0) for r in kept.collect()) == sorted(zip(texts, (7, 7, 0, 0, 9, 3), strict=True))


def test_one_row_stays_of_near_rows_that_share_an_id(spark):
    words = [f"w{k}" for k in range(80)]
    near = " ".join([*words[:79], "other"])
    for i in (None, 4):
        df = spark.createDataFrame([(i, " ".join(words)), (i, near), (i, near), (i, near + " ")], "doc_id long, text string")
        assert drop_near_duplicates(df).count() == 1
