"""The language stage without any labelled row."""

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402


def test_no_label_keeps_texts_with_a_letter(spark):
    rows = [(1, "plain words", None), (2, "12 34", None), (3, None, None), (4, "", None), (5, "é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = corpus_pipeline.language_id(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 5]
