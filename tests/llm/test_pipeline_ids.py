"""The pipeline's rows hold the token ids of the mixed corpus, and a corpus without labels isn't emptied."""

from collections import Counter

import corpus_pipeline
import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")


def test_ids_equal_the_library(spark):
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(1, "Some words, and more of them.", "en", "a", 0), (2, "über Straßen 日本 🙂", "de", "b", 0), (3, "", "en", "a", 0), (3, None, None, None, 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.encode(spark, d, "").collect()
    want = Counter((i, tuple(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_no_labels(spark):
    rows = [(1, "clean words", None, "a", 0), (2, "12 34", None, "a", 0), (3, None, None, "a", 0), (4, "日本", None, "a", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.identify_language(spark, d, "").collect()} == {1, 4}
