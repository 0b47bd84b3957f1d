import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from panelspark.llm.catalog import QUERIES
from panelspark.llm.neighbors import vector_components


def plain(rows):
    ids = [r[0] for r in rows]
    links, root = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ok = [v is not None and lab is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if good else None for (_, v, _), good in zip(rows, ok)]
    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.98:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return sorted((ids[i], links[i], least[find(i)], ids[i] == least[find(i)]) for i in range(len(rows)))


def got(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


def test_query_equals_all_pairs(spark, folder):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert got(QUERIES["op8_vectors"](spark, folder)) == plain(rows)


def test_crowds_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    crowd = rng.normal(size=16)
    rows = [(k, (crowd + rng.normal(scale=0.07, size=16)).tolist(), 1) for k in range(300)]
    rows += [(1000 + k, rows[0][1], 1) for k in range(40)] + [(2000 + k, rows[0][1], 2) for k in range(3)]
    rows += [(3000 + k, rng.normal(size=16).tolist(), int(rng.integers(3))) for k in range(200)]
    v = rows[0][1]
    rows += [(4000, None, 1), (4001, [], 1), (4002, [0.0] * 16, 1), (4003, [float("nan")] + v[1:], 1), (4004, [float("inf")] + v[1:], 1),
             (4005, [None] + v[1:], 1), (4006, v, None), (4007, v[:8], 1), (4008, [x * 1e-200 for x in v], 1), (4009, [x * 1e200 for x in v], 1)]
    df = spark.createDataFrame(rows + [(None, v, 1)], "vec_id long, embedding array<double>, label int")
    scaled = [(i, [x * 1e200 for x in w] if i == 4008 else [x * 1e-200 for x in w] if i == 4009 else w, lab) for i, w, lab in rows]
    assert got(vector_components(df, window=32, tile=64)) == plain(scaled)


def test_every_pair_of_a_crowded_label_is_found(spark, tmp_path):
    """30,000 vectors at mutual cosine 0.9, 400 of them with a partner at 0.982 and no other link."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    axis = unit(rng.normal(size=(1, 64)))
    free = rng.normal(size=(30_000, 64))
    base = np.sqrt(0.9) * axis + np.sqrt(0.1) * unit(free - free @ axis.T * axis)
    side = rng.normal(size=(400, 64))
    side = unit(side - (side * base[:400]).sum(axis=1, keepdims=True) * base[:400])
    every = np.concatenate((base, 0.982 * base[:400] + np.sqrt(1 - 0.982 ** 2) * side))
    table = pa.table({"vec_id": np.arange(len(every)), "embedding": pa.array(list(every)), "label": np.zeros(len(every), np.int32)})
    pq.write_table(table, tmp_path / "crowd.parquet")
    linked = [r for r in got(vector_components(spark.read.parquet(str(tmp_path / "crowd.parquet")))) if r[1]]
    assert linked == [(k, 1, k, True) for k in range(400)] + [(30_000 + k, 1, k, False) for k in range(400)]


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1, 5), (1, [1.0, 0.0], 1, 6)], "vec_id long, embedding array<float>, label int, rep int")
    assert got(vector_components(df)) == [(1, 1, 1, True)] * 2
    assert vector_components(df.limit(0)).count() == 0
