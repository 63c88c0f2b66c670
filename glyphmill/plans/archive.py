"""Queries of the archive operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import archive
from glyphmill.tables import shared_dir, table


def _consolidated(spark: SparkSession, d: str) -> DataFrame:
    """The archive of meta, written to the shared folder."""
    rows = archive.rows_of(table(spark, d, "meta"), "doc_id", "part_file", "written_at")
    return archive.write(rows, f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Bucket and doc_id of every record as the consolidated files hold it: read from the record's own
    bytes, not from the index."""
    return archive.lines_of(_consolidated(spark, d), "doc_id string").where("doc_id is not null").select("bucket", "doc_id")


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """Every record of the consolidated files, all its columns."""
    held = archive.lines_of(_consolidated(spark, d), "doc_id string, kind string, text string, src_doc bigint, font string, font_px int, written_at string")
    return held.select("bucket", F.col("path").alias("part_file"), "doc_id", "kind", "text", "src_doc", "font", "font_px", F.date_format(F.col("written_at").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("written_at"))


def p5_layout(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes of each bucket before and after."""
    return archive.layout(table(spark, d, "page_files"), _consolidated(spark, d))


QUERIES = {f.__name__: f for f in (p5_found, p5_records, p5_layout)}

_BUCKET = """coalesce(case when regexp_matches(split_part(doc_id, '_', 2), '^\\s*[+-]?[0-9]+\\s*$')
  then lpad((try_cast(trim(split_part(doc_id, '_', 2)) as bigint) // 10000)::varchar, greatest(5, length((try_cast(trim(split_part(doc_id, '_', 2)) as bigint) // 10000)::varchar))::int, '0') end, '00000')"""
_LAST = f"""select {_BUCKET} as bucket, part_file, doc_id, kind, text, src_doc, font, font_px, strftime(written_at, '%Y-%m-%d %H:%M:%S') as written_at from meta
  qualify row_number() over (partition by doc_id order by written_at desc nulls last, part_file desc nulls last,
    to_json(struct_pack(doc_id := doc_id, kind := kind, text := text, src_doc := src_doc, bucket := bucket, font := font, font_px := font_px)) desc) = 1"""
SQL = {
    "p5_found": f"select distinct {_BUCKET} as bucket, doc_id from meta where doc_id is not null",
    "p5_records": _LAST,
    # at this size a container holds all buckets
    "p5_layout": f"""with f as (select path, max(bucket) as bucket, max(n_bytes) as n_bytes from page_files where path is not null group by path),
      b as (select coalesce(bucket, nullif(list_extract(string_split(path, '/'), -2), '')) as bucket, count(*) as files_before, sum(n_bytes) as bytes_before from f group by 1),
      r as (select bucket, count(*) as records from (select distinct {_BUCKET} as bucket, doc_id from meta where doc_id is not null) group by bucket)
      select bucket, coalesce(files_before, 0) as files_before, coalesce(bytes_before, 0)::bigint as bytes_before, (case when records is null then 0 else 1 end)::bigint as blocks, coalesce(records, 0) as records from b full join r using (bucket)""",
}
