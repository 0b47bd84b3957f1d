import numpy as np

from panelspark.llm.catalog import QUERIES
from panelspark.llm.quality import _AGAIN, calibrated_temperature, cooccurrence, index_vectors, score_quality, token_rows, train_quality_model


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op6_quality"](spark, folder).collect()
    known = [r for r in rows if r.held_out and r.doc_id in label]
    assert len(rows) == 10_000 and np.mean([r.predicted == label[r.doc_id] for r in known]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_tokens():
    assert len(token_rows(b"")) == 0 and len(token_rows(b"Ab ab")) == 2
    assert token_rows(b"x y y y")[2:].tolist() == [_AGAIN[0]] * 2
    assert token_rows(b"x. x. x.")[2:].tolist() == [_AGAIN[1]] * 4
    assert token_rows(b"1 22")[0] != token_rows(b"a")[0]


def test_neighbours_stay_within_a_text():
    dims, signs = index_vectors()
    a = np.array([5, 6, 7])
    both = cooccurrence(np.concatenate((a, [-1], a)), dims, signs)
    assert np.allclose(both, 2 * cooccurrence(np.concatenate((a, [-1])), dims, signs))
    want = np.zeros(48)
    for other in (6, 7):
        np.add.at(want, dims[other], signs[other])
    assert np.allclose(both[5], 2 * want)


def test_temperature_undoes_scaling():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-z))).astype(float)
    assert abs(calibrated_temperature(z * 4, y) - 4) < 0.4


def test_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (7, 1, 0), (8, 0, 0), (9, None, 0), (None, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    model = train_quality_model(odd_documents, labels)
    rows = score_quality(odd_documents, model).collect()
    assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert score_quality(no_documents, model).count() == 0
    blank = train_quality_model(no_documents, labels.limit(0))
    assert {r.score for r in score_quality(odd_documents, blank).collect()} == {0.5}
