import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelspark.llm.bpe import BpeModel, Cache, TextEncoder, decode_bpe, encode_bpe
from panelspark.llm.common import documents, vocabulary

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


@pytest.fixture(scope="module", params=FILES)
def models(request):
    with open(vocabulary(request.param), encoding="utf-8") as f:
        text = f.read()
    return text, BpeModel(text), Tokenizer.from_str(text)


def encoded(model, text):
    return np.frombuffer(b"".join(model.ids_of(model.words(text))), "<i4").tolist()


def plain_merges(model, word):
    """Merge the leftmost pair of the lowest rank until none is left, looking at all pairs each time."""
    symbols, pairs = model._symbols(word).tolist(), model._pairs
    while known := [(pairs[k][0], i) for i in range(len(symbols) - 1) if (k := symbols[i] << 32 | symbols[i + 1]) in pairs]:
        _, i = min(known)
        symbols[i:i + 2] = [pairs[symbols[i] << 32 | symbols[i + 1]][1]]
    return symbols


def test_both_trees_equal_the_plain_search(models):
    _, model, _ = models
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeths", k=rng.randrange(1, 250))).encode() for _ in range(60)] + [b"a" * n for n in (1, 2, 3, 255, 256)]
    for word in words:
        want = plain_merges(model, word)
        assert np.frombuffer(model.merge_words([word])[0], "<i4").tolist() == want and model.merge_long_word(word).tolist() == want
    together = model.merge_words(words)
    assert [np.frombuffer(x, "<i4").tolist() for x in together] == [plain_merges(model, w) for w in words]


def test_odd_texts_equal_the_library(models):
    _, model, library = models
    rng = random.Random(2)
    plain = [chr(c) for c in [*range(1, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205f), 0x20ac]]
    encoder = TextEncoder(model, model.ids_of)
    texts = ["<|EndOfText|> A", "a\u0301 \u0301b \u00a0C", "", " ", "a" * 5000, "ab" * 900 + " x", "<|endoftext|>a <|endoftext|><|endoftex", "ΣΑΣ é\x1c\x85 b", "日本語テキスト 漢字", "İstanbul é", "٣٤٥ ՘aՙ 😀😀", "\r\n a  b\t\td "]
    texts += ["".join(rng.choices("abcdefghij' éü.,\n12", k=rng.randrange(1, 600))) for _ in range(100)] + ["".join(rng.choices(plain, k=50)) for _ in range(300)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert encoded(model, text) == want, text[:50]
        assert np.frombuffer(encoder.encode([text.encode()])[0], "<i4").tolist() == want, text[:50]
        assert model.decode(want) == library.decode(want, skip_special_tokens=False)


def test_every_document_equals_the_library(spark, folder, models, texts):
    text, model, library = models
    rows = encode_bpe(documents(spark, folder), text).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)


def test_ids_decode_by_themselves(spark, models):
    text, _, library = models
    rows = spark.createDataFrame([(1, [100, 200, 49407, 10 ** 8, None]), (2, []), (3, None), (None, [5])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in decode_bpe(rows, text).collect()}
    assert got == {1: library.decode([100, 200, 49407], skip_special_tokens=False), 2: "", 3: "", None: library.decode([5], skip_special_tokens=False)}


def test_odd_and_empty_tables(odd_documents, no_documents, models):
    text, _, library = models
    want = sorted((str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids) for r in odd_documents.collect())
    assert sorted((str(r.doc_id), r.ids) for r in encode_bpe(odd_documents.withColumn("ids", F.lit(1)), text).collect()) == want
    assert encode_bpe(no_documents, text).count() == 0


def test_cache_keeps_two_generations():
    asked = []
    cache = Cache(lambda words: [asked.append(w) or w.encode() for w in words], 1000)
    cache.join([[f"w{i}" for i in range(1001)]])
    assert cache.join([["w1", "w1", "new"]]) == [b"w1w1new"] and asked.count("w1") == 1
    assert len(cache.young) == 2 and len(cache.old) == 1001


def test_new_pieces_are_split_together(monkeypatch):
    """Of about 3,000 new pieces only those that the library has to split, or that hold a special token, are split one by one."""
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        definition = f.read()
    rng = random.Random(6)
    pieces = [*{"".join(rng.choices(letters, k=9)) + end for letters in ("abcdeths'12", "aeüßñéİ²") for end in (".", "", "***") for _ in range(501)}][:3000]
    pieces += ["x<|endoftext|>Y", "漢字é", "a<b"]
    rng.shuffle(pieces)
    model, library, alone = BpeModel(definition), Tokenizer.from_str(definition), []
    monkeypatch.setattr(BpeModel, "words", lambda self, text, plain=BpeModel.words: alone.append(text) or plain(self, text))
    texts = [" ".join(pieces[at:at + 300]) for at in range(0, len(pieces), 300)] + ["", "a\u0301 Σ"]
    got = TextEncoder(model, model.ids_of).encode([t.encode() for t in texts])
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert set(alone) <= {"x<|endoftext|>Y", "x", "Y", "漢字é", "a\u0301", "Σ", "σ", ""}


def test_other_models_raise():
    with pytest.raises(ValueError):
        BpeModel('{"model": {"type": "Unigram", "vocab": {}}, "added_tokens": [], "normalizer": null}')
