import numpy as np

from panelspark.llm.catalog import QUERIES
from panelspark.llm.language import _letters, ngram_counts, predict_language, train_language_model, with_known_language


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op9_language"](spark, folder).collect() if r.held_out]
    assert len(rows) > 200 and np.mean([r.lang_pred == lang[r.doc_id] for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_letters():
    assert bytes(_letters("A1b  é!").astype("u1")) == b"\0a\0b\0\xe9\0"
    assert len(_letters("12 !?")) == 0 and len(_letters("")) == 0 and len(ngram_counts(None)[0]) == 0
    assert len(_letters("𝔘")) == 3


def test_odd_documents(odd_documents, no_documents):
    model = train_language_model(odd_documents)
    assert model.languages and set(model.languages) <= {"en", "fr", "de"}
    got = predict_language(odd_documents, model).collect()
    assert len(got) == 12
    assert {(r.lang_pred, r.score) for r in got if r.doc_id in (1, 2, 3)} == {("und", 0.0)}
    kept = with_known_language(odd_documents, model, least=0.0)
    assert kept.columns == odd_documents.columns and kept.where("text is null or trim(text) = ''").count() == 0
    blank = train_language_model(no_documents)
    assert predict_language(no_documents, blank).count() == 0
    assert {r.lang_pred for r in predict_language(odd_documents, blank).collect()} == {"und"}
