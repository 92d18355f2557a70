"""Word tables of document blocks: the shared way of joining values of distinct words back to texts.

Consecutive documents make a block of about BLOCK_BYTES. A block lists its distinct words once,
dealt by hash to buckets, as one compressed row per bucket; all rows of a bucket meet in one task, which sees
each distinct word of the corpus that falls to it and answers every block in the block's own order. So a
word travels once per block whatever its frequency, and no row per word or position is shuffled.

Blocks are formed anew by each pass over the documents, so the input has to give the same rows in the
same partitions and order each time, as a table scan does. A checksum of each block's words travels
along; a block that came out differently raises instead of giving wrong results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import U, mix

BLOCK_BYTES = 8 << 20


def squeeze(a: np.ndarray | bytes) -> bytes:
    """Compressed bytes; of integers, plane by plane."""
    if isinstance(a, bytes):
        return b"\x00" + zstandard.compress(a, 3)
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T
    return bytes([a.itemsize]) + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 3)


def spread(data: bytes, kind: str = "") -> np.ndarray | bytes:
    size, raw = data[0], zstandard.decompress(data[1:])
    if not size:
        return raw
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind or f"<u{size}")


def block_id(partition: int, number: int) -> int:
    """``partition`` is that of the scan (spark_partition_id), which other stages and unions do not shift."""
    return (partition << 24) + number


def checksum(words: np.ndarray) -> int:
    """Of a block's word hashes in order."""
    with np.errstate(over="ignore"):
        return int((mix(words + np.arange(len(words)).astype(U))).sum(dtype=U).view(np.int64))


def order_by_bucket(words: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts words by bucket, and the buckets' offsets in it."""
    bucket = (words % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def buckets_of(df: DataFrame) -> int:
    """As many buckets as shuffle partitions: both grow with the input, so a bucket's words stay few."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def by_bucket(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")


def meet(answers: DataFrame, bodies: DataFrame, parts: int) -> DataFrame:
    """Rows (block, bucket, sum, data, keys, sizes, more) sorted by block, the answers of all buckets before the body."""
    a = answers.select("block", "bucket", "sum", "data", *[F.lit(None).cast(bodies.schema[c].dataType).alias(c) for c in ("keys", "sizes", "more")])
    b = bodies.select("block", F.lit(1 << 30).alias("bucket"), "sum", "data", "keys", "sizes", "more")
    return a.union(b).repartition(parts, "block").sortWithinPartitions("block", "bucket")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i] for c in batch.columns)
