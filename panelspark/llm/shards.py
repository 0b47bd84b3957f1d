"""Shuffled shards by a two-pass external shuffle: scatter into memory-sized buckets, then shuffle each one."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from .common import scratch, stored

SEED = 20
#: Bytes of text a bucket is meant to hold; a task shuffles one bucket after the other in memory.
BUCKET_BYTES = 8 << 20
#: Buckets that one task shuffles, one after the other.
TASK_BUCKETS = 8
#: Buckets whose offsets one task sums; their sums are summed in turn.
FAN = 4096


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 16


def _scatter(id_col: str, text_col: str, buckets: int, seed: int) -> Column:
    """Bucket of a record: a seeded hash of its id and text, so repeated ids spread too."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(buckets)).cast("long")


def _offsets(counts: DataFrame) -> DataFrame:
    """``(bucket, n)`` -> ``(bucket, before, total)``: records in lower buckets and in all, summed in two steps."""
    wide = counts.withColumn("block", F.floor(F.col("bucket") / FAN))
    within = W.partitionBy("block").orderBy("bucket")
    blocks = wide.groupBy("block").agg(F.sum("n").alias("m"))
    lower = blocks.select("block", (F.sum("m").over(W.orderBy("block")) - F.col("m")).alias("lower"), F.sum("m").over(W.partitionBy(F.lit(0))).alias("total"))
    own = wide.select("bucket", "block", (F.sum("n").over(within) - F.col("n")).alias("own"))
    return own.join(lower, "block").select("bucket", (F.col("own") + F.col("lower")).alias("before"), "total")


def write_shards(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text",
                 seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the rows of ``docs`` in random order to ``shards`` folders ``shard=0, 1, ...`` below ``path``.

    Pass one scatters records into buckets of about ``bucket_bytes`` by a seeded hash; pass two shuffles each
    bucket (Fisher-Yates, seeded by the bucket) and writes it. Buckets follow each other, and shard ``s`` takes
    the places from ``s * rows / shards`` on, so row counts differ by one at most (the law ``rows``); ``slot``
    numbers the rows of a shard from 0. A bucket is sorted before it is shuffled, so a task that runs again
    writes the same order. All columns are kept; a column named ``shard`` or ``slot`` raises an error. Null ids
    and texts are records like any other; an empty table writes no shard.
    """
    clash = {"shard", "slot"} & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are added here")
    size = docs.agg(F.sum(record_size(F.col(text_col)))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(_scatter(id_col, text_col, buckets, seed).alias("bucket"), *[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    offsets = stored(_offsets(counts), "bucket-offsets")
    order = [F.xxhash64(F.lit(seed), own[id_col]), F.col(own[id_col]), F.xxhash64(*own.values())]
    # offsets are one row for each bucket; the sort comes after the join, which would be free to drop it
    # tasks follow from the buckets, not from the session: about eight buckets each at any size
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-buckets // TASK_BUCKETS))
    placed = rows.repartition(tasks, "bucket").join(offsets, "bucket").sortWithinPartitions("bucket", *order)
    schema = T.StructType([*[T.StructField(n, docs.schema[c].dataType) for c, n in own.items()], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def shuffled(table: pa.Table):
        bucket, before, total = (table.column(c)[0].as_py() for c in ("bucket", "before", "total"))
        order = np.arange(table.num_rows)
        np.random.default_rng([seed, bucket]).shuffle(order)  # Fisher-Yates in place
        place = before + np.arange(len(order))
        shard = ((place + 1) * shards - 1) // total  # the s with s * total // shards <= place
        out = table.select(list(own.values())).take(pa.array(order))
        out = out.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(place - shard * total // shards))
        yield from out.to_batches(max_chunksize=500)

    def run(batches):
        held, bucket = [], None
        for b in batches:
            ids = b.column("bucket").to_numpy()
            cuts = np.flatnonzero(np.diff(ids)) + 1
            for x, y in zip([0, *cuts], [*cuts, len(ids)]):
                if y == x:
                    continue
                if held and ids[x] != bucket:
                    yield from shuffled(pa.Table.from_batches(held))
                    held = []
                bucket = ids[x]
                held.append(b.slice(x, y - x))
        if held:
            yield from shuffled(pa.Table.from_batches(held))

    placed.mapInArrow(run, schema).withColumnsRenamed({n: c for c, n in own.items()}).write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """Rows of written shards with their shard and slot; ``columns`` is the schema of the records."""
    schema = T.StructType([*columns.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def shard_digest(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards below the shared folder, read them back, and return one row for each record:
    ``(id, size, text_crc32, law, shard, slot, grown_shard)``. ``grown_shard`` is null under the law ``rows``."""
    spark = docs.sparkSession
    records = docs.select(id_col, text_col)
    path = scratch(spark, "shards")
    write_shards(records, path, shards, id_col, text_col)
    text = F.col(text_col)
    return read_shards(spark, path, records.schema).select(
        id_col, record_size(text).alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
