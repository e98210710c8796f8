"""The pipeline's language stage where no label can be learned."""

import pytest

import corpus_pipeline
from tests.llm.test_pipeline import COLUMNS, SCHEMA


@pytest.mark.parametrize("label", [None, "en"])
def test_documents_with_letters_stay_where_no_label_can_be_learned(spark, label):
    rows = [(1, "clean words", None, "s", 11), (2, "漢字", None, "s", 2), (3, "12 $$", label, "s", 5), (4, None, label, "s", 0), (5, "", None, "s", 0)]
    got = corpus_pipeline.identify_language(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert got.columns == COLUMNS and sorted(map(tuple, got.collect())) == rows[:2]
