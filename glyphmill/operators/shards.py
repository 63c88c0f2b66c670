"""Packing samples into shards: rolled by bytes or by count, contiguous chunks, lookups of images.

A byte roll resets when a shard is full, so it is a fold, not a running sum: it runs in parallel over
contiguous chunks of the input (as packing workers do), each with shard numbers of its own range.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.operators.order import numbered

MEMBER_HEADER = 512
CHUNK_SHARDS = 50_000
#: rows of a chunk that a task folds
CHUNK_ROWS = 100_000


def chunked(df: DataFrame, order: list[Column], workers: int | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with pos, chunk and base (the chunk's first shard number). Chunks have ``rows`` rows each, so
    their number grows with the input; with ``workers`` they are as many, of ceil(total / workers) rows."""
    size = max(1, math.ceil(df.count() / max(1, workers)) if workers else rows)
    chunk = F.floor(F.col("pos") / size).cast("bigint")
    return numbered(df, order, "pos").withColumn("chunk", chunk).withColumn("base", F.col("chunk") * _numbers(size))


def _numbers(size: int) -> int:
    """Shard numbers kept for a chunk of so many rows."""
    return size // CHUNK_SHARDS + 100


def roll_sizes(sizes: list[int], limit: int) -> list[int]:
    """Shard of each sample: a new shard after the sample that brings the sum to ``limit`` or more."""
    out, shard, total = [], 0, 0
    for s in sizes:
        out.append(shard)
        total += s
        if total >= limit:
            shard, total = shard + 1, 0
    return out


def roll_bytes(df: DataFrame, order: list[Column], size: Column, limit: int, workers: int | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with pos, chunk and shard. ``size`` is the bytes a sample takes (null counts as 0). Chunks are
    contiguous ranges of positions (see ``chunked``), folded one by one in a task. A chunk that needs more
    shards than numbers are kept for it is an error: take a larger limit or smaller chunks."""
    d = chunked(df, order, workers, rows).withColumn("_size", F.coalesce(size, F.lit(0)).cast("bigint"))
    keep = [f for f in d.schema.fields if f.name not in ("_size", "base")]
    names = [f.name for f in keep]
    spare = _numbers(max(1, math.ceil(df.count() / max(1, workers)) if workers else rows))

    def run(batches):
        import pyarrow as pa

        chunk, shard, total, first = None, 0, 0, 0
        for b in batches:
            out = []
            for c, base, s in zip(*[b.column(b.schema.get_field_index(n)).to_pylist() for n in ("chunk", "base", "_size")]):
                if c != chunk:
                    chunk, shard, total, first = c, base, 0, base
                if shard - first >= spare:
                    raise ValueError(f"chunk {c} needs more than {spare} shards")
                out.append(shard)
                total += s
                if total >= limit:
                    shard, total = shard + 1, 0
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [pa.array(out, pa.int64())], [*names, "shard"])

    return d.repartition("chunk").sortWithinPartitions("chunk", "pos").mapInArrow(run, T.StructType([*keep, T.StructField("shard", T.LongType())]))


def roll_count(df: DataFrame, order: list[Column], per_shard: int) -> DataFrame:
    """``df`` with pos and shard = pos // per_shard."""
    return numbered(df, order, "pos").withColumn("shard", F.floor(F.col("pos") / per_shard).cast("bigint"))


def pack_totals(packed: DataFrame, error: Column) -> DataFrame:
    """(packed, shards, errors); only shards that hold samples count."""
    return packed.agg(F.count_if(~error).alias("packed"), F.count_distinct(F.when(~error, F.col("shard"))).alias("shards"), F.count_if(error).alias("errors"))


def with_images(meta: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """``meta`` with ``missing``: no image of the key. Keys of images are made distinct first."""
    have = images.where(F.col(key).isNotNull()).select(F.col(key).alias("_k")).distinct().withColumn("_have", F.lit(1))
    return meta.join(have, meta[key] == F.col("_k"), "left").withColumn("missing", F.col("_have").isNull()).drop("_k", "_have")


def resume(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks whose key isn't done; a null key is never done."""
    return tasks.join(done.where(F.col(key).isNotNull()).select(key).distinct(), key, "left_anti")
