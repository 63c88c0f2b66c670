"""Pages for text detection: one PNG a page and one JSON line a page with its boxes."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.png import encode_gray
from glyphmill.operators.imaging import unpack
from glyphmill.tables import local_path

FOLDER, ROWS = "det_pages", "det.jsonl"
BOX = "struct<x:int,y:int,w:int,h:int,text:string,render_text:string>"
ROW = f"page_id string, image string, image_size array<int>, font string, bboxes array<{BOX}>"


def write_pages(df: DataFrame, path: str, page_id: Column, font: Column, image: Column, bboxes: Column) -> DataFrame:
    """Writes ``<path>/det_pages/<page_id>.png`` and ``<path>/det.jsonl`` (a folder of parts); returns the rows read back.
    Tasks write the images and pass on the rows, so each image crosses once; a repeated task writes the same file."""
    import pyarrow as pa

    to = os.path.join(local_path(path), FOLDER)
    os.makedirs(to, exist_ok=True)

    def run(batches):
        for b in batches:
            sizes = []
            for name, img in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                part = os.path.join(to, f".{name}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(encode_gray(unpack(img)))
                os.replace(part, os.path.join(to, f"{name}.png"))
                sizes.append([img["h"], img["w"]])
            names = pa.array([f"{FOLDER}/{n}.png" for n in b.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), names, pa.array(sizes, pa.list_(pa.int32())), b.column(1), b.column(3)], ["page_id", "image", "image_size", "font", "bboxes"])

    d = df.select(page_id.cast("string").alias("page_id"), font.cast("string").alias("font"), image.alias("image"), bboxes.cast(f"array<{BOX}>").alias("bboxes"))
    d.where("image.data is not null").mapInArrow(run, ROW).write.mode("overwrite").json(os.path.join(path, ROWS))
    return read_pages(df.sparkSession, path)


def read_pages(spark, path: str) -> DataFrame:
    """(page_id, image, image_size, font, bboxes) of written pages."""
    return spark.read.schema(ROW).json(os.path.join(path, ROWS))
