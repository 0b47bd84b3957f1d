import zlib
from collections import defaultdict

import pytest

from panelspark.llm.catalog import QUERIES
from panelspark.llm.common import scratch
from panelspark.llm.shards import read_shards, shard_digest, write_shards


def check(rows, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[k]) for k in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)


def test_query_is_a_shuffle_of_whole_records(spark, folder, texts):
    rows = QUERIES["op10_shards"](spark, folder).collect()
    check(rows, 40)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
    again = QUERIES["op10_shards"](spark, folder).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert sum(abs(a - b) == 1 for a, b in zip(order, order[1:])) < 8  # neighbours are parted


def test_many_buckets_and_odd_documents(spark, odd_documents, no_documents):
    path = scratch(spark, "s")
    write_shards(odd_documents, path, 5, bucket_bytes=40)
    rows = read_shards(spark, path, odd_documents.schema).collect()
    check(rows, 5)
    key = lambda rs: sorted(map(repr, ((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.id) for r in rs)))
    assert key(rows) == key(odd_documents.collect())
    assert shard_digest(no_documents).count() == 0
    with pytest.raises(ValueError, match="slot"):
        write_shards(odd_documents.withColumnRenamed("id", "slot"), path, 5)
