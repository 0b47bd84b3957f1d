import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from panelspark.llm.bpe import worker_encoder
from panelspark.llm.catalog import QUERIES
from panelspark.llm.common import scratch, vocabulary
from panelspark.llm.tokenfile import EliasFano, TokenFile, library_words, read_token_files, write_token_files

PATH = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-5, 1 << 40), max_size=700))
def test_sequences_come_back(values):
    values = sorted(values)
    coded, end = EliasFano.read(b"pad" + EliasFano.of(np.array(values, np.int64)).to_bytes(), 3)
    assert coded.values().tolist() == values
    assert [coded.select(i) for i in range(len(values))] == values
    places = np.arange(len(values))[::-3]
    assert coded.select_many(places).tolist() == [values[i] for i in places]


def test_select_uses_little_space():
    ends = np.cumsum(np.random.default_rng(1).integers(1, 900, 20_000))
    assert len(EliasFano.of(ends).to_bytes()) * 8 / 20_000 < 2 + np.log2(450) + 1
    file = TokenFile.read(TokenFile.of([3, 4, 9], [2, 0, 1], np.array([7, 70_000, 1])).to_bytes())
    assert [file.document(k).tolist() for k in range(3)] == [[7, 70_000], [], [1]] and file.doc_ids.values().tolist() == [3, 4, 9]


def test_query_equals_the_library(spark, folder, texts, tokenizer, monkeypatch):
    start = 0
    rows = {r.doc_id: r for r in QUERIES["op4_token_files"](spark, folder).collect()}
    assert len(rows) == len(texts)
    for d in sorted(texts):
        ids = tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [1]
        r = rows[d]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_words_are_independent(tokenizer):
    words = worker_encoder(open(PATH, encoding="utf-8").read(), library_words)
    for t in ["a b", " 'S  x's\n<|endoftext|> y", "É́ e ́", "Σ ΑΣ a", "", "  ", "x y　z 1 22", "it's don't", "<|ENDOFTEXT|> a<|endoftext|>b", "a\u0301 \u0301 \x1c\x85x\u2028y", "İ X"]:
        assert np.frombuffer(words.encode([t.encode()])[0], "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_odd_documents(spark, odd_documents, no_documents, tokenizer):
    definition = open(PATH, encoding="utf-8").read()
    path = scratch(spark, "t")
    write_token_files(odd_documents, definition, path)
    got = sorted((r.start, r.doc_id, r.ids) for r in read_token_files(spark, path).collect())
    assert [d for _, d, _ in got] == [1, 2, 3, 4, 5, 6, 6, 7, 8, 9]
    assert [s for s, _, _ in got] == np.cumsum([0] + [len(i) for _, _, i in got])[:-1].tolist()
    text = {r.doc_id: r.text for r in odd_documents.collect()}
    assert all(i == tokenizer.encode(text[d] or "", add_special_tokens=False).ids + [1] for _, d, i in got)
    path = scratch(spark, "t")
    write_token_files(no_documents, definition, path)
    assert read_token_files(spark, path).count() == 0
