import datetime
import json

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import archive

T = datetime.datetime(2031, 1, 1)
SCHEMA = "doc_id string, text string, bucket string, part_file string, written_at timestamp_ntz, path string, key string, payload int"


def meta(spark):
    rows = [
        ("line_00012345_v0", "a", "00009", "meta/1", T, "p", "k", 1),
        ("line_00012345_v0", "b", None, "meta/2", T + datetime.timedelta(days=2), "p", "k", 1),
        ("line_00012345_v0", "b", None, "meta/2", T + datetime.timedelta(days=2), "p", "k", 1),
        ("line_41_v0", None, "", None, None, None, None, None),
        ("strip-7-0", "ᠠ\U0001f338" * 3, "x", "meta/1", T, None, None, None),
        ("line_00000372x_v1", "", "x", "meta/3", T, None, None, None),
        ("line_1234567890_v0", "big", "x", "meta/3", T, None, None, None),
        (None, "n", None, "meta/3", T, None, None, None),
        (None, "n", None, "meta/3", T, None, None, None),
        (None, "m", None, "meta/3", T, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_buckets(spark):
    def direct(d):
        try:
            return f"{int(d.split('_')[1]) // 10000:05d}"
        except (IndexError, ValueError):
            return "00000"

    ids = ["line_00012345_v0", "line_41_v0", "x", "line_", "line_x_v0", "line_-5_v0", "line_+20000", "line_ 30000 _v1", "line_1234567890_v0", "_9999", "_10000"]
    got = spark.createDataFrame([(i,) for i in [*ids, None]], "d string").select("d", archive.bucket_of(F.col("d")).alias("b")).collect()
    for r in got:
        assert r["b"] == (direct(r["d"]) if r["d"] is not None else "00000"), r


@pytest.mark.parametrize("size", [1, 150, 1 << 20])
def test_round_trip(spark, tmp_path, monkeypatch, size):
    records = archive.rows_of(meta(spark), "doc_id", "part_file", "written_at")
    monkeypatch.setattr(archive, "FRAME_BYTES", 100)
    archive.write(records, str(tmp_path / "a"), size)
    blocks = archive.open_archive(spark, str(tmp_path / "a"))
    latest = {}
    for r in records.collect():  # one row a key, by brute force
        key = r["key"] if r["key"] is not None else tuple(r)
        rank = (r["written"] is not None, r["written"] or T, r["path"] is not None, r["path"] or "", bytes(r["bytes"]))
        if key not in latest or rank > latest[key][0]:
            latest[key] = (rank, (r["bucket"], r["path"] or "", r["key"] or "", bytes(r["bytes"])))
    want = sorted(v for _, v in latest.values())
    got = sorted((r["bucket"], r["path"] or "", r["key"] or "", bytes(r["bytes"])) for r in archive.unpack(blocks).collect())
    assert got == want and len(got) == 7
    assert blocks.groupBy("block").count().where("count > 1").count() == 0
    b = [r for r in got if r[2] == "line_00012345_v0"]
    assert len(b) == 1 and b[0][0] == "00001" and b'"text":"b"' in b[0][3]
    one = archive.lookup(blocks, key="line_00012345_v0").collect()
    assert [bytes(r["bytes"]) for r in one] == [b[0][3]]
    assert archive.lookup(blocks, path="meta/3").count() == 4
    if size == 1 << 20:
        assert blocks.count() == 1  # small buckets share a container
    by = {}
    for bucket, _, _, data in want:
        n, size_ = by.get(bucket, (0, 0))
        by[bucket] = (n + 1, size_ + len(data))
    assert {r["bucket"]: (r["n"], r["b"]) for r in blocks.select(F.inline("buckets")).groupBy("bucket").agg(F.sum("records").alias("n"), F.sum("bytes").alias("b")).collect()} == by
    parsed = archive.lines_of(blocks, "text string, payload int, doc_id string").collect()
    assert sorted((r["bucket"], r["doc_id"] or "", r["text"] or "") for r in parsed) == sorted((b, k, json.loads(d)["text"] or "") for b, _, k, d in want)


def test_hot_key(spark, tmp_path):
    """A third of all rows are one key, written again and again."""
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, "line_0_v0").otherwise(F.concat(F.lit("line_"), "id", F.lit("_v0"))).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("p").alias("part_file"), F.timestamp_seconds(F.col("id") % 4000).alias("written_at"))
    rows = archive.rows_of(df, "doc_id", "part_file", "written_at")
    assert rows.mapInArrow(archive._drop_older, rows.schema).count() < 6100
    got = archive.unpack(archive.write(rows, f"file://{tmp_path}/a")).collect()
    assert len(got) == 6001
    assert [bytes(r["bytes"]) for r in got if r["key"] == "line_0_v0"][0].count(b'"t3999"') == 1


def test_damage_is_found(spark, tmp_path):
    records = archive.rows_of(meta(spark), "doc_id", "part_file", "written_at")
    m = archive.write(records, str(tmp_path / "a"))
    for how in (lambda d: d[:12] + bytes([d[12] ^ 1]) + d[13:], lambda d: d[:-4], lambda d: d[:9] + bytes([d[9] ^ 4]) + d[10:]):
        f = next((tmp_path / "a").glob("*/*.gma"))
        whole = f.read_bytes()
        f.write_bytes(how(whole))
        with pytest.raises(Exception, match="damaged"):
            archive.unpack(m).collect()
        f.write_bytes(whole)
    assert archive.unpack(m).count() == 7


def test_files_of_lost_attempts_don_t_count(spark, tmp_path):
    records = archive.rows_of(meta(spark), "doc_id", "part_file", "written_at")
    m = archive.write(records, str(tmp_path / "a"))
    f = next((tmp_path / "a").glob("*/*.gma"))
    f.with_name("00000000-other.gma").write_bytes(f.read_bytes()[:50])
    assert archive.unpack(m).count() == 7


def test_empty(spark, tmp_path):
    records = archive.rows_of(meta(spark).where("false"), "doc_id", "part_file", "written_at")
    assert archive.unpack(archive.write(records, str(tmp_path / "a"))).count() == 0


def test_hot_bucket_is_spread(spark, tmp_path):
    df = spark.range(3000).select(F.concat(F.lit("strip-"), "id").alias("doc_id"), F.lit("x" * 50).alias("text"), F.lit("one").alias("part_file"), F.lit(None).cast("timestamp").alias("written_at"))
    blocks = archive.write(archive.rows_of(df, "doc_id", "part_file", "written_at"), str(tmp_path / "a"), 20_000)
    s = blocks.agg(F.count("*").alias("n"), F.max("bytes").alias("m"), F.sum("records").alias("r")).first()
    assert s["r"] == 3000 and s["n"] > 10 and s["m"] <= 20_000


def test_layout(spark, tmp_path):
    files = spark.createDataFrame([("meta/00000/a", "00000", 10), ("meta/00000/a", "00000", 10), ("meta/00001/b", None, None), (None, None, 1)], "path string, bucket string, n_bytes bigint")
    blocks = archive.write(archive.rows_of(meta(spark), "doc_id", "part_file", "written_at"), str(tmp_path / "a"))
    got = {r["bucket"]: r for r in archive.layout(files, blocks).collect()}
    assert got["00000"]["files_before"] == 1 and got["00001"]["files_before"] == 1 and got["00001"]["records"] == 1


def test_containers_follow_bytes_not_buckets(spark, tmp_path):
    """Four hundred buckets of a few records each fill few containers, every bucket found by key."""
    df = spark.range(2000).select(F.format_string("line_%08d_v0", F.col("id") * 2000).alias("doc_id"), F.lit("x" * 40).alias("text"), F.lit("f").alias("part_file"), F.lit(None).cast("timestamp").alias("written_at"))
    m = archive.write(archive.rows_of(df, "doc_id", "part_file", "written_at"), str(tmp_path / "a"), 50_000)
    s = m.agg(F.count("*").alias("n"), F.sum("records").alias("r"), F.max("bytes").alias("most")).first()
    assert s["r"] == 2000 and 3 <= s["n"] <= 12 and s["most"] <= 50_000
    assert m.select(F.explode("buckets.bucket")).distinct().count() == 400
    got = archive.lookup(m, key="line_00062000_v0").collect()
    assert len(got) == 1 and got[0]["bucket"] == "00006" and m.where(F.array_contains("buckets.bucket", "00006")).count() <= 2
