"""Indexed archive containers for very many small files.

Records (original bytes with the path of the file they stood in) are packed into large containers. The
tasks write the containers themselves into the shared folder, so that no payload passes through the
JVM twice; what they return is a manifest, one small row a container, kept as a Parquet table. Names
are unique for each attempt of a task and only the manifest tells which count, so a lost executor
leaves at most a file that nothing refers to.

A container is self-contained: frames of compressed lines, then an index of bucket, path, key, frame, offset,
length and CRC-32 of every record, then the index's size. A record is found by the index alone and read
by one frame; containers are read in parallel; every record is checked when read. Buckets that follow each
other share containers of ``BLOCK_BYTES``, so their number follows the bytes and not the buckets. A bucket whose bytes
exceed a container is spread over as many by a salt of the record's key, so a task never holds more
than one frame and one index.

Defined results: of a repeated key the record written last stays (ties: the greatest path, then the
greatest bytes); records with a null key can't be told apart by key, so each distinct one stays;
an empty table gives an archive without containers. Null paths are kept as null. Records are lines: they hold no
line feed.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.operators.order import cumulative
from glyphmill.tables import SharedTable, shuffle_partitions

#: bytes of a container before compression, and of a frame
BLOCK_BYTES, FRAME_BYTES = 64 << 20, 1 << 20
MAGIC = b"GMARCH02"
BUCKET_LINES = 10_000
#: larger buckets than these are joined by a shuffle
BROADCAST_BUCKETS = 100_000
MANIFEST = "block bigint, file string, records bigint, bytes bigint, buckets array<struct<bucket:string,records:bigint,bytes:bigint>>"
RECORDS = "bucket string, path string, key string, bytes binary"


def line_number(key: Column) -> Column:
    """The number between the first two underscores of a key (as an integer literal: spaces around and
    a sign allowed), else null."""
    part = F.try_element_at(F.split(key, "_"), F.lit(2))
    return F.when(part.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.regexp_replace(part, r"[\s+]", "").try_cast("bigint"))


def _bucket(number: Column) -> Column:
    n = F.floor(number / F.lit(BUCKET_LINES))
    digits = F.abs(n).cast("string")
    width = F.when(n < 0, 4).otherwise(5)
    return F.coalesce(F.concat(F.when(n < 0, "-").otherwise(""), F.lpad(digits, F.greatest(width, F.length(digits)), "0")), F.lit("00000"))


def bucket_of(key: Column) -> Column:
    """Line number of a key divided by 10,000 (rounded down), five digits at least; ``00000`` when the
    key yields no number."""
    return _bucket(line_number(key))


def rows_of(df: DataFrame, key: str, path: str, written: str) -> DataFrame:
    """(bucket, key, written, path, bytes, size): every row with its other columns as one JSON line (column
    order kept, nulls kept); ``size`` is about its length, known without building it."""
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != path]), {"ignoreNullFields": "false"})
    size = F.lit(0)
    for name, kind in df.dtypes:
        if name != path:
            size = size + len(name) + (F.coalesce(F.octet_length(f"`{name}`"), F.lit(4)) + 6 if kind == "string" else F.lit(16))
    # the key's number is parsed once, in a projection of its own
    d = df.select("*", line_number(F.col(key)).alias("__number"))
    return d.select(_bucket(F.col("__number")).alias("bucket"), F.col(key).alias("key"), F.col(written).cast("timestamp_ntz").alias("written"), F.col(path).alias("path"), F.encode(line, "UTF-8").alias("bytes"), size.cast("bigint").alias("size"))


def _drop_older(batches):
    """Before the shuffle: of a key's rows in a batch, the latest; so a key that holds a third of all rows
    leaves one row a batch. Rows without a key stay."""
    for b in batches:
        key = b.column("key")
        if b.num_rows and pc.count_distinct(key, mode="only_valid").as_py() + key.null_count < b.num_rows:
            # by age only: rows as old as the latest stay, the packing decides between them
            t = b.take(pc.sort_indices(b, [("key", "ascending"), ("written", "descending")], null_placement="at_end"))
            keep, last, newest = [], None, None
            for k, w in zip(t.column("key").to_pylist(), t.column("written").to_pylist()):
                if k is None or k != last:
                    last, newest = k, w
                    keep.append(True)
                else:
                    keep.append(w == newest)
            b = t.filter(pa.array(keep))
        yield b


_INDEX = pa.schema([("bucket", pa.string()), ("path", pa.string()), ("key", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("crc", pa.int64())])


def _file_system(path: str):
    """(file system, path in it) of a URI or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _values(array: pa.Array) -> tuple[np.ndarray, memoryview]:
    """(offsets, bytes) of a binary array, without copying."""
    offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
    return offsets.astype(np.int64), memoryview(array.buffers()[2] or b"")


class _Container:
    """One container being written."""

    def __init__(self, root: str, block: int):
        fs, at = _file_system(root)
        self.block, self.file = block, f"{block % 1000:03d}/{block:012d}-{uuid.uuid4().hex}.gma"
        fs.create_dir(f"{at}/{block % 1000:03d}")
        self.out = fs.open_output_stream(f"{at}/{self.file}", compression=None)
        self.out.write(MAGIC)
        self.at, self.bytes = len(MAGIC), 0
        self.frames: list[tuple[int, int]] = []
        self.frame: list[bytes] = []
        self.framed = 0
        self.index: list[pa.RecordBatch] = []

    def add(self, rows: pa.RecordBatch) -> None:
        """Records of ``rows`` (bucket, path, key, bytes), as many as end a frame at most."""
        offsets, data = _values(rows.column(3))
        size = np.diff(offsets)
        # every record ends with a line feed that doesn't belong to it
        lines = [data[a:z] for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        crc = [zlib.crc32(x) for x in lines]
        start = self.framed + np.cumsum(size + 1) - size - 1
        n = len(rows)
        self.index.append(pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), rows.column(2), pa.array(np.full(n, len(self.frames), np.int32)), pa.array(start), pa.array(size), pa.array(crc, pa.int64())], schema=_INDEX))
        self.frame += [b"\n".join(lines), b"\n"]
        self.framed += int(size.sum()) + n
        self.bytes += int(size.sum())
        if self.framed >= FRAME_BYTES:
            self._end_frame()

    def _end_frame(self) -> None:
        packed = zlib.compress(b"".join(self.frame), 1)
        self.out.write(packed)
        self.frames.append((self.at, len(packed)))
        self.at += len(packed)
        self.frame, self.framed = [], 0

    def close(self) -> tuple:
        if self.frame or not self.frames:
            self._end_frame()
        table = pa.Table.from_batches(self.index, _INDEX).replace_schema_metadata({"frames": json.dumps(self.frames)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(table)
        footer = sink.getvalue()
        self.out.write(footer)
        self.out.write(struct.pack("<Q", footer.size) + MAGIC)
        self.out.close()
        by = table.group_by("bucket", use_threads=False).aggregate([("length", "count"), ("length", "sum")])
        return self.block, self.file, len(table), self.bytes, [dict(zip(("bucket", "records", "bytes"), r)) for r in zip(*[by.column(c).to_pylist() for c in ("bucket", "length_count", "length_sum")])]


def _pack_partition(root: str, block_bytes: int):
    def run(batches):
        at, number, last, c = None, 0, None, None
        done: list[tuple] = []
        for b in batches:
            if not b.num_rows:
                continue
            group, salt, bucket, key, written, path, data = b.columns
            # rows of a key come latest first; those without a key repeat only as a whole
            new = np.ones(len(b), bool)
            if len(b) > 1:
                def same(x, nulls_differ=False):
                    eq = pc.equal(x.slice(1), x.slice(0, len(x) - 1))
                    both = pc.and_(pc.is_null(x.slice(1)), pc.is_null(x.slice(0, len(x) - 1)))
                    return pc.fill_null(eq, False) if nulls_differ else pc.or_(pc.fill_null(eq, False), both)

                place = pc.and_(pc.and_(same(group), same(salt)), same(bucket))
                whole = pc.and_(pc.and_(same(written), same(path)), pc.and_(same(data), pc.is_null(key.slice(1))))
                new[1:] = ~pc.and_(place, pc.or_(same(key, True), pc.and_(same(key), whole))).to_numpy(zero_copy_only=False)
            first = tuple(x[0].as_py() for x in (group, salt, bucket, key, *(() if key[0].is_valid else (written, path, data))))
            new[0] = last is None or first != (last[:4] if key[0].is_valid else last)
            # what the next batch is compared with: the key's latest row, or the row itself
            z = len(b) - 1
            last = tuple(x[z].as_py() for x in (group, salt, bucket, key)) + (tuple(x[z].as_py() for x in (written, path, data)) if not key[z].is_valid else ())
            keep = np.flatnonzero(new)
            rows = pa.RecordBatch.from_arrays([bucket, path, key, data], ["bucket", "path", "key", "bytes"]).take(pa.array(keep))
            size = np.diff(_values(rows.column(3))[0])
            here = np.stack([group.to_numpy()[keep], salt.to_numpy()[keep]])
            i = 0
            while i < len(rows):
                this = (int(here[0, i]), int(here[1, i]))
                if c is not None and (this != at or c.bytes + int(size[i]) > block_bytes):
                    done.append(c.close())
                    c, number = None, number + 1
                if this != at:
                    at, number = this, (this[0] << 20) + (this[1] << 8)  # further containers follow
                if c is None:
                    c = _Container(root, number)
                # as many rows as belong here, to the end of the frame or the container
                stop = int(np.argmax((here[:, i:] != here[:, i : i + 1]).any(0))) or len(rows) - i
                total = np.cumsum(size[i : i + stop])
                ends_frame = int(np.searchsorted(total + np.arange(1, stop + 1), FRAME_BYTES - c.framed)) + 1
                n = max(1, min(stop, ends_frame, int(np.searchsorted(total, block_bytes - c.bytes, "right"))))
                c.add(rows.slice(i, n))
                i += n
        if c is not None:
            done.append(c.close())
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("bucket", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done) if done else [[]] * 5, kinds)], ["block", "file", "records", "bytes", "buckets"])

    return run


def _index(stream) -> pa.Table:
    """The index of an open container."""
    size = stream.size()
    tail = stream.read_at(16, size - 16)
    if tail[8:] != MAGIC:
        raise ValueError("damaged container: no end mark")
    n = struct.unpack("<Q", tail[:8])[0]
    return pa.ipc.open_stream(stream.read_at(n, size - 16 - n)).read_all()


def _records(root: str, file: str, pick=None):
    """Batches of (bucket, path, key, bytes) of a container, a frame each; ``pick`` filters the index."""
    fs, at = _file_system(root)
    with fs.open_input_file(f"{at}/{file}") as stream:
        index = _index(stream)
        frames = json.loads(index.schema.metadata[b"frames"])
        if pick is not None:
            index = pick(index)
        index = index.combine_chunks()
        number = index.column("frame").to_numpy()
        for f in np.unique(number).tolist():
            start, n = frames[f]
            try:
                data = zlib.decompress(stream.read_at(n, start))
            except zlib.error as e:
                raise ValueError(f"damaged container {file}: {e}") from None
            part = index.filter(pa.array(number == f)).combine_chunks()
            o, length, crc = (part.column(c).to_numpy() for c in ("offset", "length", "crc"))
            view = memoryview(data)
            out = [view[a:z] for a, z in zip(o.tolist(), (o + length).tolist())]
            for i, (piece, want) in enumerate(zip(out, crc.tolist())):
                if zlib.crc32(piece) != want:
                    raise ValueError(f"damaged record {part.column('key')[i].as_py()} in {file}")
            joined = pa.py_buffer(b"".join(out))
            ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            held = pa.Array.from_buffers(pa.binary(), len(out), [None, pa.py_buffer(ends), joined])
            names = [part.column(c).combine_chunks() for c in ("bucket", "path", "key")]
            names = [x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) if x.num_chunks else pa.array([], pa.string()) for x in names]
            yield pa.RecordBatch.from_arrays([*names, held], ["bucket", "path", "key", "bytes"])


def write(rows: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Packs rows (bucket, key, written, path, bytes, size) into containers below ``path``, one record a key, in
    the order of buckets and keys; returns the manifest (block, file, records, bytes, buckets).

    Buckets are grouped by the running sum of their bytes. The rows are shuffled once, by group and salt: a key's salt
    depends on the key, so its rows meet where they are packed, and the latest is chosen there. Salts are needed only in
    buckets larger than a container. The map of buckets is broadcast as long as it has at most ``BROADCAST_BUCKETS`` rows."""
    sizes = rows.groupBy("bucket").agg(F.sum("size").alias("s"))
    map_ = cumulative(sizes, [F.col("bucket")], "s").select(F.col("bucket").alias("_b"), F.floor((F.col("upto") - F.col("s")) / F.lit(block_bytes)).alias("grp"), F.ceil(F.col("s") / F.lit(block_bytes)).cast("int").alias("n"))
    held = SharedTable(map_)
    found, large = held.df.agg(F.count("*"), F.count_if(F.col("n") > 1)).first()
    rows = rows.drop("size")
    d = rows.mapInArrow(_drop_older, rows.schema) if large else rows  # else no key can have many rows
    d = d.join(F.broadcast(held.df) if found <= BROADCAST_BUCKETS else held.df, F.col("bucket") == F.col("_b"))
    # rows without a key are told apart by all they have, so equal ones meet and others spread
    salt = F.pmod(F.when(F.col("key").isNull(), F.xxhash64("bytes", "path", "written")).otherwise(F.xxhash64("key")), F.greatest("n", F.lit(1))).cast("int")
    order = ["grp", "salt", "bucket", "key", F.desc_nulls_last("written"), F.desc_nulls_last("path"), F.desc("bytes")]
    put = d.select("grp", salt.alias("salt"), "bucket", "key", "written", "path", "bytes").repartition(shuffle_partitions(rows.sparkSession), "grp", "salt").sortWithinPartitions(*order)
    put.mapInArrow(_pack_partition(path, block_bytes), MANIFEST).write.parquet(f"{path}/_manifest")
    held.drop()
    return open_archive(rows.sparkSession, path)


def open_archive(spark: SparkSession, path: str) -> DataFrame:
    """The manifest of a written archive, with the archive's folder as ``root``."""
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest").withColumn("root", F.lit(path))


def _spread(manifest: DataFrame) -> DataFrame:
    """A row a container, over all tasks."""
    return manifest.select("root", "file").repartition(shuffle_partitions(manifest.sparkSession), "file")


def unpack(manifest: DataFrame) -> DataFrame:
    """All records of an archive, each checked against its length and checksum."""
    def run(batches):
        for b in batches:
            for root, file in zip(*[c.to_pylist() for c in b.columns]):
                yield from _records(root, file)

    return _spread(manifest).mapInArrow(run, RECORDS)


def lines_of(manifest: DataFrame, fields: str) -> DataFrame:
    """(bucket, path, fields...): all records of an archive of JSON lines, each checked against its length and checksum, with
    the fields wanted (a DDL string of strings and integers), parsed a frame at a time."""
    schema = T.StructType.fromDDL(fields)
    kinds = pa.schema([(f.name, pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for f in schema])

    def run(batches):
        from pyarrow import json as arrow_json

        options = arrow_json.ParseOptions(explicit_schema=kinds, unexpected_field_behavior="ignore")
        for b in batches:
            for root, file in zip(*[c.to_pylist() for c in b.columns]):
                for r in _records(root, file):
                    data = b"\n".join(r.column(3).to_pylist())
                    t = arrow_json.read_json(pa.BufferReader(data), arrow_json.ReadOptions(use_threads=False, block_size=len(data) + 1), options)
                    if len(t) != len(r):
                        raise ValueError(f"{len(r)} records of {file} hold {len(t)} lines")
                    got = [t.column(f.name).combine_chunks() for f in kinds]
                    got = [x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in got]
                    yield pa.RecordBatch.from_arrays([r.column(0), r.column(1), *got], ["bucket", "path", *kinds.names])

    out = ", ".join(f"`{f.name}` {'string' if isinstance(f.dataType, T.StringType) else 'bigint'}" for f in schema)
    got = _spread(manifest).mapInArrow(run, f"bucket string, path string, {out}")
    return got.select("bucket", "path", *[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])


def lookup(manifest: DataFrame, path: str | None = None, key: str | None = None) -> DataFrame:
    """Records of one path, one key or both: the indexes are searched, and only frames with a hit read."""
    if key is not None:
        manifest = manifest.where(F.array_contains("buckets.bucket", bucket_of(F.lit(key))))

    def pick(index: pa.Table) -> pa.Table:
        for name, value in (("path", path), ("key", key)):
            if value is not None:
                index = index.filter(pc.equal(index.column(name), value))
        return index

    def run(batches):
        for b in batches:
            for root, file in zip(*[c.to_pylist() for c in b.columns]):
                yield from _records(root, file, pick)

    return _spread(manifest).mapInArrow(run, RECORDS)


def layout(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(bucket, files_before, bytes_before, blocks, records): each bucket before and after; blocks are the
    containers that hold records of it. Files listed twice count once; a null bucket before is that of the path's folder."""
    folder = F.nullif(F.element_at(F.split("path", "/"), -2), F.lit(""))
    before = files.where("path is not null").groupBy("path").agg(F.max("bucket").alias("bucket"), F.max("n_bytes").alias("n_bytes")).groupBy(F.coalesce("bucket", folder).alias("bucket")).agg(F.count("*").alias("files_before"), F.sum("n_bytes").alias("bytes_before"))
    after = manifest.select(F.inline("buckets")).groupBy("bucket").agg(F.count("*").alias("blocks"), F.sum("records").alias("records"))
    return before.join(after, "bucket", "full").select("bucket", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("files_before", "bytes_before", "blocks", "records")])
