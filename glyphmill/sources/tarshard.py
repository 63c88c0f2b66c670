"""Tar shards of ``<key>.png`` and ``<key>.json`` members as a Spark data source, both ways.

Read: one partition a tar, sorted by path; members of one key are joined as they pass (they are
adjacent), so memory is that of one sample. ``parts=json`` skips the image bytes; ``tail`` keeps the
last shards; a damaged tar gives what precedes the damage and a row with ``_error``, or fails with
``mode=strict``. Write: one tar a task, rolled by bytes or by count, moved to its name on commit.
"""

from __future__ import annotations

import glob
import io
import json
import os
import tarfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

BATCH_ROWS, BATCH_BYTES = 2_000, 32 << 20
SCHEMA = "shard string, pos bigint, key string, png binary, json string, _error string"


def list_shards(*patterns: str) -> list[str]:
    """Files of all patterns, sorted; one that several patterns match occurs for each."""
    return sorted(f for p in patterns for f in glob.glob(p))


@dataclass
class Shard(InputPartition):
    path: str


def samples(path: str, images: bool = True) -> Iterator[tuple[str, bytes | None, str | None, str | None]]:
    """(key, png, json, error) of each sample of a tar, in order."""
    key, png, text = None, None, None
    try:
        with tarfile.open(path, "r|") as tar:
            for m in tar:
                if not m.isfile():
                    continue
                base = os.path.basename(m.name)
                at, _, ext = base.partition(".")
                at = os.path.join(os.path.dirname(m.name), at)
                if key is not None and at != key:
                    yield key, png, text, None
                    png = text = None
                key = at
                if ext == "json":
                    text = tar.extractfile(m).read().decode("utf-8", "replace")
                elif ext == "png":
                    png = tar.extractfile(m).read() if images else b""
        if key is not None:
            yield key, png, text, None
    except (tarfile.TarError, OSError, EOFError) as e:
        if key is not None and text is not None:
            yield key, png, text, None
        yield "", None, None, f"{type(e).__name__}: {e}"


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        self.shards = list_shards(*[os.path.join(p, "*.tar") if os.path.isdir(p) else p for p in paths])
        if "tail" in options:
            self.shards = self.shards[max(0, len(self.shards) - int(options["tail"])) :]
        if not self.shards:
            raise ValueError("no shards")
        self.images = options.get("parts", "all") != "json"
        self.strict = options.get("mode", "skip") == "strict"

    def partitions(self) -> list[Shard]:
        return [Shard(s) for s in self.shards]

    def read(self, partition: Shard):
        """Arrow batches of at most ``BATCH_ROWS`` samples and ``BATCH_BYTES`` of images, one sample at least."""
        import pyarrow as pa

        name = os.path.basename(partition.path)
        schema = pa.schema([("shard", pa.string()), ("pos", pa.int64()), ("key", pa.string()), ("png", pa.binary()), ("json", pa.string()), ("_error", pa.string())])
        rows, size = [], 0
        for pos, (key, png, text, error) in enumerate(samples(partition.path, self.images)):
            if error and self.strict:
                raise ValueError(f"{partition.path}: {error}")
            rows.append((name, pos, key, png, text, error))
            size += len(png or b"")
            if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


@dataclass
class _Done(WriterCommitMessage):
    files: list[str]
    packed: int
    errors: int


class _Writer(DataSourceArrowWriter):
    """Rows (key, png, json, shard). Rows of one shard must be adjacent and in one task."""

    def __init__(self, options: dict, schema, overwrite: bool):
        self.dir, self.prefix = options["path"], options.get("prefix", "shard-")
        self.digits = int(options.get("digits", 5))
        self.names = [f.name for f in schema.fields]
        self.overwrite = overwrite

    def write(self, rows: Iterator) -> _Done:
        os.makedirs(self.dir, exist_ok=True)
        files, packed, errors, at, tar = [], 0, 0, None, None
        for r in (r for b in rows for r in b.to_pylist()):
            if r["png"] is None or r["json"] is None:
                errors += 1
                continue
            if tar is None or r["shard"] != at:
                if tar is not None:
                    tar.close()
                at = r["shard"]
                files.append(f"{self.prefix}{at:0{self.digits}d}.tar.{uuid.uuid4().hex}.tmp")
                tar = tarfile.open(os.path.join(self.dir, files[-1]), "w")
            for ext, data in (("png", bytes(r["png"])), ("json", r["json"].encode())):
                info = tarfile.TarInfo(f"{r['key']}.{ext}")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
            packed += 1
        if tar is not None:
            tar.close()
        return _Done(files, packed, errors)

    def commit(self, messages: list[_Done]) -> None:
        """New shards take their names, each at once, over older ones of the name; then older ones that no new
        shard replaced go. Breaking off in between leaves shards too many, never too few."""
        new = {f: f[: f.index(".tar.") + 4] for m in messages for f in (m.files if m else [])}
        for f, to in new.items():
            os.replace(os.path.join(self.dir, f), os.path.join(self.dir, to))
        if self.overwrite:
            for f in glob.glob(os.path.join(self.dir, f"{self.prefix}*.tar")):
                if os.path.basename(f) not in new.values():
                    os.remove(f)

    def abort(self, messages: list[_Done]) -> None:
        for f in glob.glob(os.path.join(self.dir, f"{self.prefix}*.tmp")):
            os.remove(f)


class TarShards(DataSource):
    """``spark.read.format("tarshard").load(dir)``; option ``paths``: a JSON list of patterns."""

    @classmethod
    def name(cls) -> str:
        return "tarshard"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options, schema, overwrite)


def register(spark) -> None:
    spark.dataSource.register(TarShards)


def read(spark, *patterns: str, **options):
    """(shard, pos, key, png, json, _error) of all samples of the patterns' tars."""
    register(spark)
    r = spark.read.format("tarshard").option("paths", json.dumps(patterns))
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def write(df, path: str, prefix: str = "shard-", digits: int = 5) -> None:
    """Writes rows (key, png, json, shard), one tar a shard; rows without image or metadata are left out.
    Within a shard, rows keep the order of ``pos`` if there is one."""
    register(df.sparkSession)
    order = ["shard", *(["pos"] if "pos" in df.columns else ["key"])]
    d = df.repartition("shard").sortWithinPartitions(*order).select("key", "png", "json", df["shard"].cast("bigint").alias("shard"))
    d.write.format("tarshard").option("prefix", prefix).option("digits", digits).mode("overwrite").save(path)


def labelled(samples_df, keep=None, limit: int | None = None):
    """Samples with typed metadata (key, src_doc, text, font or empty, bucket, kind, font_px, png, json).
    Samples without a part, with bad JSON or without a numeric src_doc are left out; ``keep`` is a
    Column on the result, ``limit`` the most samples. Column expressions stay visible to the optimizer."""
    from pyspark.sql import functions as F

    v = F.try_parse_json("json")
    d = samples_df.where("_error is null and png is not null and json is not null").withColumn("_v", v).where(F.col("_v").isNotNull())
    get = lambda name, kind: F.try_variant_get("_v", f"$.{name}", kind)
    d = d.select("shard", "pos", "key", get("kind", "string").alias("kind"), get("text", "string").alias("text"), get("src_doc", "bigint").alias("src_doc"), get("bucket", "string").alias("bucket"), F.coalesce(get("font", "string"), F.lit("")).alias("font"), get("font_px", "int").alias("font_px"), "png", "json")
    d = d.where("src_doc is not null and text is not null")
    d = d if keep is None else d.where(keep)
    return d if limit is None else d.limit(limit)
