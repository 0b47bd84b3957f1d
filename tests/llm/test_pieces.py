import random

import pytest
import sentencepiece

from panelspark.llm.catalog import QUERIES
from panelspark.llm.common import vocabulary
from panelspark.llm.pieces import decode, encode, load_model

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_same_ids_as_the_library(library):
    machine = load_model(PATH).transducer()
    rng = random.Random(1)
    alphabet = list("abcdeinorstht   .,\n\t0123é▁|!#$%&*<>\"'()-_=/\\ABTH梦の😀ß​▁")
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(4000)]
    texts += [" " * n for n in range(40)] + ["a" * 5000, "\n" * 3000, " a" * 3000, "----" * 501, "", "é" * 2000]
    for t in texts:
        ids = machine.encode(t).tolist()
        assert ids == library.encode(t), t
        assert machine.decode(ids) == library.decode(ids), t
    noise = [rng.randrange(32000) for _ in range(3000)]
    for k in range(0, 3000, 10):
        assert machine.decode(noise[k:k + 10]) == library.decode(noise[k:k + 10])


def test_query_equals_the_library_and_round_trips(spark, folder, texts, library):
    import hashlib
    rows = QUERIES["op5_sentencepiece"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.ids == library.encode(text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_odd_documents(odd_documents, no_documents, library):
    model = load_model(PATH)
    rows = encode(odd_documents, model)
    for r in rows.join(odd_documents.select("doc_id", "text"), "doc_id").collect():
        assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "")
    assert rows.count() == 12 and encode(no_documents, model).count() == 0
    assert sorted(r.text for r in decode(rows, model).collect()) == sorted(r.decoded for r in rows.collect())


def test_unigram_models_take_the_best_score():
    from panelspark.llm.pieces import PieceModel
    model = PieceModel(["<unk>", "▁", "a", "b", "ab", "▁a"], [0.0, -3.0, -2.0, -2.0, -1.0, -2.5], [2, 1, 1, 1, 1, 1], 1, True, True, "x")
    machine = model.transducer()
    assert [model.pieces[i] for i in machine.encode("  ab ")] == ["▁", "ab"]
    assert [model.pieces[i] for i in machine.encode("aab")] == ["▁a", "ab"]
    assert [model.pieces[i] for i in machine.encode("az")] == ["▁a", "<unk>"]


def test_neighbours_are_judged_as_their_merges_go():
    machine = load_model(PATH).transducer()
    rng = random.Random(4)
    pieces = machine.model.pieces
    some = sorted(machine.ids.values())
    short = [i for i in some if len(pieces[i]) < 4]
    for n in range(20_000):
        u, t = rng.choice((some, short)[n % 2]), rng.choice((some, short)[n % 2])
        whole = pieces[u] + pieces[t]
        assert machine._stay_apart(u, t) == (whole not in machine.ids and machine.merged(whole) == [pieces[u], pieces[t]]), whole
    for t in some:
        assert machine._stay_apart(-1, t) == (machine.merged(pieces[t]) == [pieces[t]])


def test_no_piece_reaches_across_segments_and_small_caches_change_nothing(library, monkeypatch):
    import panelspark.llm.pieces as module
    machine = load_model(PATH).transducer()
    for p in machine.ids:
        assert machine.segments.findall(p) == [p]
    monkeypatch.setattr(module, "CACHE", 8)
    monkeypatch.setattr(module, "FITS", 8)
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choices(list("abcdeinorst ,.éж梦1"), k=40))
        assert machine.encode(text).tolist() == library.encode(text)
