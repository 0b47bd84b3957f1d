import random
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import audit
from panelspark.llm.audit import audit_filters, maybe_repeated, orders_of, repeat_sketch, slot_count
from panelspark.llm.common import documents


def plain_audit(docs, labels):
    """Apply each order filter by filter to rows (doc_id, text, lang)."""
    words = [[w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t or "") if w] for _, t, _ in docs]
    fails = []
    for (key, text, _), ws in zip(docs, words):
        t = text or ""
        copy = key is not None and any(k is not None and k < key and (o or "") == t for k, o, _ in docs)
        fails.append({"A": len(ws) < 100, "B": 100 * len(set(ws)) < 80 * len(ws), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                      "D": any(c in "#$%&*|" for c in t), "E": copy})
    out = {}
    for part in {lang or "" for _, _, lang in docs}:
        rows = [(k, f) for (k, _, lang), f in zip(docs, fails) if (lang or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order, 1):
                gone, left = [r for r in left if r[1][x]], [r for r in left if not r[1][x]]
                removed_by[x] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(f[x] for _, f in rows) - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in rows),
                    sum(labels.get(k, (0, 0))[0] for k, _ in gone), sum(labels.get(k, (0, 0))[1] for k, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def rows_of(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


LABELS = "doc_id long, quality int, toxic int"


def test_equals_the_plain_way(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choices([f"w{i}" for i in range(rng.choice((20, 400)))], k=rng.choice((5, 99, 100, 150)))) + rng.choice(("", " $", " ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for _ in range(30)]
    docs = [(i, rng.choice(base), rng.choice(("en", "de", None))) for i in range(150)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 150, 2)]
    got = rows_of(audit_filters(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(5), spark.createDataFrame(labels, LABELS)))
    assert got == plain_audit(docs, {k: (q, t) for k, q, t in labels})


def test_odd_and_empty_tables(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(5, 1, None), (5, 0, 1), (None, 1, 1), (6, None, 1)], LABELS)
    odd = odd_documents.withColumn("mask", F.lit(7)).withColumn("key", F.lit(1))
    got = rows_of(audit_filters(odd, labels))
    docs = [(r.doc_id, r.text, r.lang) for r in odd_documents.collect()]
    assert got == plain_audit(docs, {5: (1, 1), 6: (0, 1)})
    assert audit_filters(no_documents, labels).count() == 0


def test_conditions_may_be_others(spark):
    docs = spark.createDataFrame([(1, "a", "x", 5), (2, "b", "x", None), (3, "a", "x", 1)], "doc_id long, text string, lang string, n int")
    got = rows_of(audit_filters(docs, spark.createDataFrame([], LABELS), {"N": F.col("n") > 3, "E": None}))
    assert got["x", "NE", 1][:4] == [2, 1, 0, 1] and got["x", "NE", 2][:4] == [1, 1, 0, 1] and len(got) == 4
    assert rows_of(audit_filters(docs, spark.createDataFrame([], LABELS), {"N": F.col("n") > 3}))["x", "N", 1][:2] == [2, 1]


def test_sketch_misses_no_repeat_and_clears_most_unique(spark, monkeypatch):
    monkeypatch.setattr(audit, "FLUSH", 5000)
    n = 20_000
    hashes = spark.range(n, numPartitions=7).select(F.xxhash64("id").alias("h")).unionByName(spark.range(0, n, 100).select(F.xxhash64("id").alias("h")))
    slots = slot_count(hashes.count())
    sketch = repeat_sketch(hashes, slots)
    marked = spark.range(n).where(maybe_repeated(spark, sketch)(F.xxhash64("id"))).toPandas()["id"]
    assert set(range(0, n, 100)) <= set(marked) and len(marked) < 200 + 0.06 * n
    places, counts = np.unique(audit._slots(np.array([r.h for r in hashes.collect()]), slots), return_counts=True)
    assert np.flatnonzero(np.unpackbits(sketch, bitorder="little")).tolist() == places[counts >= 2].tolist()


def test_full_sketch_changes_no_result(spark, folder, monkeypatch):
    docs, labels = documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet")
    want = rows_of(audit_filters(docs, labels))
    monkeypatch.setattr(audit, "repeat_sketch", lambda hashes, slots: np.full(slots // 8, 255, np.uint8))
    assert rows_of(audit_filters(docs, labels)) == want


@pytest.mark.parametrize("rows, slots", [(0, 1 << 16), (1, 1 << 16), (100_000, 1 << 20), (10 ** 12, 1 << 31)])
def test_slots_grow_with_the_rows(rows, slots):
    assert slot_count(rows) == slots


def test_orders_are_complete():
    assert len(orders_of("ABCDE")) == 600 and ("CAB", 3, 2, 5) in orders_of("ABC")
