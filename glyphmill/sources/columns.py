"""Directories of numbered images with their labels: ``<idx>.png`` and ``<idx>.json``."""

from __future__ import annotations

import itertools
import json
import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.png import decode_gray, encode_gray
from glyphmill.operators.imaging import IMAGE, pack, unpack
from glyphmill.tables import local_path, shuffle_partitions

BATCH_ROWS, BATCH_BYTES = 2_000, 32 << 20
LABEL = "text string, n_lines int, src_doc bigint, line_texts array<string>"


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """(idx, image, text, n_lines, src_doc, line_texts) of pairs, in the order of the number, not of the
    name; a label without image is left out; none at all is an error. Names are paired and sorted before
    files are read, so neither files nor pixels are shuffled; a task holds ``BATCH_BYTES`` of pixels, one image at
    least. A mounted folder is listed by one task and read by all; other paths go through Spark's file index."""
    mounted = _mounted(path)
    stem = F.regexp_extract("name", r"^(\d+)\.", 1).alias("s")

    def kind(ext: str) -> DataFrame:
        files = _listed(spark, mounted, ext) if mounted else _indexed(spark, path, ext)
        return files.select(stem, F.struct("*").alias(ext)).where("s <> ''")

    d = kind("json").join(kind("png"), "s").select(F.col("s").cast("bigint").alias("idx"), "json", "png")
    if d.select("idx").isEmpty():
        raise ValueError("no columns")
    d = d.repartitionByRange(shuffle_partitions(spark), "idx").sortWithinPartitions("idx")
    read = d.mapInArrow(_reader(mounted), f"idx bigint, image {IMAGE}, label binary")
    return read.select("idx", "image", F.from_json(F.decode("label", "UTF-8"), LABEL).alias("l")).select("idx", "image", "l.*")


def _mounted(path: str) -> str | None:
    """The mounted folder of a path; None for other file systems and patterns."""
    at = local_path(path) if "://" not in path or path.startswith("file:") else ""
    return at if os.path.isdir(at) else None


def _indexed(spark: SparkSession, path: str, ext: str) -> DataFrame:
    """(name, content) of the files of an extension, by Spark's file index."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def _listed(spark: SparkSession, path: str, ext: str) -> DataFrame:
    """(name) of the files of an extension in a folder, listed by one task, a batch at a time."""
    def run(batches):
        import pyarrow as pa

        for _ in batches:
            with os.scandir(path) as files:
                names = (f.name for f in files if f.name.endswith(f".{ext}") and f.is_file())
                while part := list(itertools.islice(names, BATCH_ROWS)):
                    yield pa.RecordBatch.from_pydict({"name": pa.array(part, pa.string())})

    return spark.range(0, 1, 1, 1).mapInArrow(run, "name string")


def _reader(mounted: str | None):
    """Arrow batches (idx, png, json) to (idx, image, label); png and json hold a name, and the content where the folder
    isn't mounted. No image for bytes that aren't a PNG this codec reads."""
    def content(file: dict) -> bytes:
        if mounted is None:
            return file["content"]
        with open(os.path.join(mounted, file["name"]), "rb") as f:
            return f.read()

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("idx", pa.int64()), ("image", pa.struct([("h", pa.int32()), ("w", pa.int32()), ("data", pa.binary())])), ("label", pa.binary())])
        out, size = [], 0
        for b in batches:
            for at in range(len(b)):
                r = {n: c[at].as_py() for n, c in zip(b.schema.names, b.columns)}
                out.append({"idx": r["idx"], "image": _unpacked(content(r["png"])), "label": content(r["json"])})
                size += len(out[-1]["image"]["data"] or b"") + len(out[-1]["label"])
                if size >= BATCH_BYTES or len(out) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _unpacked(png: bytes) -> dict:
    try:
        return pack(decode_gray(bytes(png)))
    except (ValueError, TypeError):
        return {"h": None, "w": None, "data": None}


def decoded(column: str):
    """PNG bytes to image; null for bytes that aren't a PNG this codec reads."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(IMAGE)
    def run(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_unpacked(b) for b in data], columns=["h", "w", "data"])

    return run(F.col(column))


def encoded(column: str):
    """Image to PNG bytes; null for null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("binary")
    def run(images: pd.DataFrame) -> pd.Series:
        return pd.Series([encode_gray(unpack(r)) if r["data"] is not None else None for r in images.to_dict("records")], dtype=object)

    return run(F.col(column))


def write_columns(df: DataFrame, path: str) -> None:
    """Writes (idx, image, text, n_lines, src_doc, line_texts), two files a column, from the tasks; ``png``, its bytes,
    may stand for image. The folder must be shared by all executors. A file is complete once it has its name."""
    image = "png" if "png" in df.columns else "image"

    def run(rows):
        os.makedirs(path, exist_ok=True)
        for r in rows:
            label = {"text": r["text"], "n_lines": r["n_lines"], "src_doc": r["src_doc"], "line_texts": r["line_texts"]}
            for ext, data in (("png", bytes(r["png"]) if image == "png" else encode_gray(unpack(r["image"]))), ("json", json.dumps(label, ensure_ascii=False).encode())):
                tmp = os.path.join(path, f".{r['idx']}.{ext}.{os.getpid()}")
                with open(tmp, "wb") as f:
                    f.write(data)
                os.replace(tmp, os.path.join(path, f"{r['idx']}.{ext}"))

    df.select("idx", image, "text", "n_lines", "src_doc", "line_texts").foreachPartition(run)
