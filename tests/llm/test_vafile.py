from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm.vafile import LARGEST, Block, cluster_vectors, make_block, vector_blocks


def plain_clusters(rows, k=8, rounds=10, dims=64):
    """Rows (id, vector) of whole numbers; exact arithmetic in Python integers."""
    order = sorted((sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, members in groups.items():
            centroids[n] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *nearest(v)) for i, v in rows]
    total = {}
    for _, d, n in found:
        total[n] = total.get(n, 0) + d
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), n, d, total[n], sum(total.values()), digests[n]) for i, d, n in found)


def result(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_equals_the_plain_way(spark):
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 0.1, (12, 64))
    vectors = (middles[rng.integers(0, 12, 400)] + rng.normal(0, 0.04, (400, 64))).astype(np.float32)
    vectors[50:60] = vectors[0]  # ties and copies
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    whole = [(i, np.floor(1024 * v.astype(float)).astype(int).tolist()) for i, v in enumerate(vectors)]
    assert result(cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(6))) == plain_clusters(whole)


def test_odd_and_empty_tables(spark):
    v = [0.5] * 64
    w = [-0.25] * 63 + [0.125]
    rows = [(1, v, 0), (1, v, 0), (2, w, 1), (None, w, 1), (3, None, 1), (4, v[:63], 1), (5, v + v, 1), (6, [None] + v[1:], 1), (7, [float("nan")] + v[1:], 1),
            (8, [float("inf")] + v[1:], 1), (9, [3e38] + v[1:], 1), (10, [], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("cluster", F.lit(1)).withColumn("ids", F.lit("x"))
    whole = [(1, [512] * 64), (1, [512] * 64), (2, [-256] * 63 + [128]), (None, [-256] * 63 + [128])]
    assert result(cluster_vectors(df)) == plain_clusters(whole)
    assert cluster_vectors(df.limit(0)).columns == cluster_vectors(df).columns and cluster_vectors(df.limit(0)).count() == 0


def test_other_shapes(spark):
    rng = np.random.default_rng(5)
    values = rng.integers(-50, 50, (60, 3))
    df = spark.createDataFrame([(i, (v / 8).tolist(), 0) for i, v in enumerate(values)], "vec_id int, embedding array<double>, label int")
    got = result(cluster_vectors(df, k=5, rounds=4, dims=3, scale=8, bits=2))
    assert got == plain_clusters([(i, v.tolist()) for i, v in enumerate(values)], k=5, rounds=4, dims=3)


def block_of(spark, vectors, bits):
    df = spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").coalesce(1)
    return Block(vector_blocks(df, vectors.shape[1], 1, bits).toArrow().combine_chunks().to_batches()[0], 0, vectors.shape[1], bits)


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_intervals_hold_and_narrow_cells_fetch_little(spark, bits):
    rng = np.random.default_rng(bits)
    middles = rng.integers(-400, 400, (8, 16))
    vectors = middles[rng.integers(0, 8, 2000)] + rng.integers(-60, 60, (2000, 16))
    block = block_of(spark, vectors, bits)
    exact = ((vectors[:, None] - middles[None]) ** 2).sum(axis=2)
    least, most = block.intervals(middles)
    assert (least <= exact).all() and (exact <= most).all()
    found, fetched = block.nearest(middles)
    assert found.tolist() == exact.argmin(axis=1).tolist()
    assert bits < 6 or fetched < 0.05 * len(vectors)


def test_largest_components_stay_in_range(spark):
    vectors = np.array([[LARGEST] * 64, [-LARGEST] * 64])
    found, _ = block_of(spark, vectors, 6).nearest(vectors)
    assert found.tolist() == [0, 1]


def test_block_is_compressed():
    norms, cells, low, high, full = make_block(np.arange(640).reshape(10, 64), 6)
    assert len(cells) == 10 * 64 * 6 // 8 and len(full) == 10 * 64 * 4 and len(norms) == 80
