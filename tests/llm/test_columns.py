"""Columns and ids of the user's tables stay as they are."""

import corpus_pipeline
from tessella.llm import decontam, ngram_join

TEXT = "one two three four five six seven eight nine ten eleven twelve"


def test_a_column_called_row_is_kept(spark, sf_dir):
    df = spark.createDataFrame([(1, TEXT, 77, 5), (2, "another text of some few words here", 78, 6), (3, TEXT, 79, 7)], "doc_id long, text string, _row long, _ROW_ long")
    assert sorted(r["_row"] for r in corpus_pipeline.without_copies(spark, df, sf_dir).collect()) == [77, 78]
    bench = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    assert [tuple(r) for r in decontam.clean(df, bench).collect()] == [(2, "another text of some few words here", 78, 6)]


def test_rows_without_an_id_are_joined_too(spark):
    df = spark.createDataFrame([(None, TEXT), (5, TEXT), (None, "alone but for this one text of mine"), (None, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.join(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)
    assert got == sorted([(None, 8, 5), (5, 8, 5), (None, 4, None), (None, 0, None)], key=str)
