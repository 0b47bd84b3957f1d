import hashlib
import random

from panelspark.llm.catalog import QUERIES
from panelspark.llm.repeats import remove_repeats


def plain(rows, size):
    """Kept words by row, from the first document of every window."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - size + 1):
            key = tuple(w[k:k + size])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k:k + size])] < i:
                gone[k:k + size] = [True] * size
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return out


def test_query_equals_plain_search(spark, folder, texts):
    want = {(i, n, r, hashlib.sha256(k.encode()).hexdigest()) for i, n, r, k in plain(sorted(texts.items()), 13)}
    rows = QUERIES["op2_repeats"](spark, folder).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want and len(rows) == len(texts)


def test_small_alphabets_and_sizes(spark):
    rng = random.Random(6)
    for size, words in ((13, "a b"), (13, "a b c d e f g h"), (4, "a b c d e f g h i j"), (3, "a b c d e f g h i j")):
        rows = [(i, " ".join(rng.choices(words.split(), k=rng.choice([0, 1, size - 1, size, 25, 60])))) for i in range(120)]
        rows += [(200 + i, rows[i][1]) for i in range(20)] + [(300, rows[5][1] + " " + rows[6][1]), (-1, rows[7][1])]
        df = spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, text string")
        got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(df, min_words=size).collect())
        assert got == sorted(plain(rows, size))


def test_odd_documents(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect() if r.doc_id is not None]
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(odd_documents).collect())
    assert got == sorted(plain(rows, 13)) and remove_repeats(no_documents).count() == 0
