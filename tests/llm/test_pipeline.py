import hashlib
import re

import corpus_pipeline
import sentencepiece
from test_decontaminate import tokens
from test_pii import base
from test_simhash import plain_components, plain_fingerprint

from panelspark.llm.common import vocabulary
from panelspark.llm.decontaminate import EQUAL, WINDOW
from panelspark.llm.language import UNKNOWN, train_language_model
from panelspark.llm.pii import KINDS


def holds(doc, items):
    for item in items:
        places = {}
        for k, x in enumerate(item):
            places.setdefault(x, []).append(k)
        hits = {}
        for i, x in enumerate(doc):
            for k in places.get(x, ()):
                hits.setdefault(i - k, []).append(k)
        for shift, ks in hits.items():
            low, high = max(0, -shift), min(len(item), len(doc) - shift)
            if any(sum(low <= s <= k < s + WINDOW <= high for k in ks) >= EQUAL for s in range(low, high - WINDOW + 1)):
                return True
    return False


def redacted(text):
    spans = sorted(((a, -b, k) for k, a, b in base(text)))
    out, at = "", 0
    for a, b, k in spans:
        if a >= at:
            out, at = out + text[at:a] + f"[{k.upper()}]", -b
        at = max(at, -b)
    return out + text[at:]


def test_stages_equal_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = train_language_model(docs)
    text = {i: r.text for i, r in rows.items() if (p := model.predict(r.text))[0] != UNKNOWN and p[1] >= 0.3}
    root = plain_components({i: plain_fingerprint(t) for i, t in text.items()})
    text = {i: t for i, t in text.items() if root[i] == i}
    items = [tokens(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    text = {i: t for i, t in text.items() if not holds(tokens(t), items)}
    added = re.compile("|".join(k.pattern for k in KINDS if not k.base))
    assert not any(added.search(t) for t in text.values())  # else redacted() would have to know them
    text = {i: redacted(t) for i, t in text.items()}
    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == set(text) and len(got) == len(text) < len(rows)
    for r in got:
        assert r.ids == library.encode(text[r.doc_id]) and r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_stages_take_odd_documents(spark, odd_documents, no_documents, tmp_path):
    spark.createDataFrame([(1, "the of and")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (odd_documents, no_documents):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            docs = out
        last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert last.count() == docs.count()
