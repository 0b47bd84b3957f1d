import random

import numpy as np
import xxhash

from panelspark.llm.catalog import QUERIES
from panelspark.llm.simhash import block_masks, fingerprint, near_links, simhash_components, without_near_duplicates
from panelspark.llm.components import connected_components


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids = sorted(prints)
    root = {i: i for i in ids}
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_equals_all_pairs(spark, folder, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(prints)
    rows = QUERIES["op3_simhash"](spark, folder).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in rows} == {(i, f"{f:016x}", want[i]) for i, f in prints.items()}


def test_short_and_odd_texts():
    for t in ["", " ", "a", "A b", "a b c", "a b c d", "É É é é x", "a b c d e f"]:
        assert fingerprint(t.encode()) == plain_fingerprint(t)


def test_every_close_pair_shares_a_mask():
    rng = random.Random(2)
    masks = block_masks(0, 4, 6)
    deeper = [block_masks(m, 4, 6) for m in masks]
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 4)):
            y ^= 1 << b
        hit = [k for k, m in enumerate(masks) if not (x ^ y) & m & (1 << 64) - 1]
        assert hit and all(any(not (x ^ y) & m & (1 << 64) - 1 for m in deeper[k]) for k in hit)


def test_crowded_blocks_are_split_without_loss(spark):
    rng = random.Random(8)
    base = rng.getrandbits(64)
    values = {base}
    while len(values) < 400:
        v = rng.choice(sorted(values)) if rng.random() < 0.3 else base
        for b in rng.sample(range(64), rng.randint(1, 4)):
            v ^= 1 << b
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(200)}
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {r.node: r.component for r in connected_components(near_links(fps, group=32)).collect()}
    want = plain_components({v: v & (1 << 64) - 1 for v in signed})
    groups = lambda m: {frozenset(k for k in signed if m.get(k, k) == c) for c in {m.get(k, k) for k in signed}}
    assert groups(got) == groups(want)


def test_odd_documents(odd_documents, no_documents):
    got = {(r.doc_id, r.component_id) for r in simhash_components(odd_documents).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5), (7, 5) if (7, 5) in got else (7, 7), (8, 8), (9, 9)}
    kept = without_near_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2 and 2 not in ids and 6 not in ids and {1, 4, 5, 8, 9} <= set(ids)
    assert simhash_components(no_documents).count() == 0 and without_near_duplicates(no_documents).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}
