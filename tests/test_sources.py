import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions.png import decode_gray, encode_gray
from glyphmill.operators import imaging, shards
from glyphmill.sources import columns, detection, labels, tarshard


def png(w=20):
    return encode_gray(np.full((40, w), 200, np.uint8))


def sample(doc, text, font="F"):
    return json.dumps({"kind": "line", "text": text, "src_doc": doc, "bucket": "00000", "font": font, "font_px": 40}, ensure_ascii=False)


def two_shards(spark, path):
    rows = [(f"line_{i:08d}_v0", png(), sample(d, t), s, i) for i, (d, t, s) in enumerate([(0, "ᠠ", 0), (1, "ᠡ", 0), (8, "ᠢ", 3), (9, "ᠣ", 3)])]
    tarshard.write(spark.createDataFrame(rows, "key string, png binary, json string, shard bigint, pos bigint"), str(path))


def test_round_trip_tail_and_damage(spark, tmp_path):
    two_shards(spark, tmp_path)
    files = tarshard.list_shards(f"{tmp_path}/*.tar")
    assert [f.rsplit("/", 1)[1] for f in files] == ["shard-00000.tar", "shard-00003.tar"]
    assert len(tarshard.list_shards(f"{tmp_path}/*.tar", f"{tmp_path}/shard-00000.tar")) == 3
    got = tarshard.labelled(tarshard.read(spark, f"{tmp_path}/*.tar")).orderBy("key").collect()
    assert [r["src_doc"] for r in got] == [0, 1, 8, 9] and {r["font"] for r in got} == {"F"} and bytes(got[0]["png"]) == png()
    keys = tarshard.read(spark, f"{tmp_path}/*.tar", parts="json", tail=1).select("key", F.length("png").alias("n")).collect()
    assert len(keys) == 2 and all(r["n"] == 0 for r in keys)
    kept = tarshard.labelled(tarshard.read(spark, f"{tmp_path}/*.tar"), F.col("src_doc") >= 8)
    assert kept.count() == 2
    whole = open(files[0], "rb").read()
    (tmp_path / "shard-00001.tar").write_bytes(whole[: len(whole) // 3])
    (tmp_path / "shard-00002.tar").write_bytes(b"no tar at all" * 100)
    again = tarshard.read(spark, f"{tmp_path}/*.tar")
    assert tarshard.labelled(again).where("shard in ('shard-00000.tar', 'shard-00003.tar')").count() == 4
    assert again.where("_error is not null").count() >= 1
    with pytest.raises(Exception, match="."):
        tarshard.read(spark, f"{tmp_path}/*.tar", mode="strict").count()
    with pytest.raises(Exception, match="no shards"):
        tarshard.read(spark, f"{tmp_path}/none*.tar").count()


def test_writer_leaves_out_samples_without_parts(spark, tmp_path):
    rows = [("a", png(), "{}", 0), ("b", None, "{}", 0), ("c", png(), None, 1)]
    tarshard.write(spark.createDataFrame(rows, "key string, png binary, json string, shard bigint"), str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in tarshard.list_shards(f"{tmp_path}/*")] == ["shard-00000.tar"]
    two_shards(spark, tmp_path)  # overwrites
    assert len(tarshard.list_shards(f"{tmp_path}/*.tar")) == 2


def test_labels(spark, tmp_path):
    f = tmp_path / "l.jsonl"
    good = [json.dumps({"kind": "line", "text": t}) for t in ("Hovd", "Zag river", "Bor")]
    wrong = ["[1, 2]", json.dumps({"label": "Hovd"}), json.dumps({"text": 12.5}), json.dumps({"text": None}), "{'text': 'Bor'}"]
    f.write_text("\n".join([wrong[0], good[0], "", *wrong[1:3], good[1], "   ", *wrong[3:], good[2]]))
    assert sorted(r["text"] for r in labels.scan_labels(spark, [str(f)]).collect()) == ["Bor", "Hovd", "Zag river"]
    counted = labels.scan_labels(spark, [str(f)], "count").groupBy(F.col("_error").isNull().alias("fine")).count().collect()
    assert {r["fine"]: r["count"] for r in counted} == {True: 3, False: len(wrong)}
    with pytest.raises(Exception, match="bad row"):
        labels.scan_labels(spark, [str(f)], "strict").collect()
    assert labels.scan_corpus(spark, [str(f)], 4).count() == 2 and labels.scan_corpus(spark, [str(f)], 10).count() == 0
    with pytest.raises(ValueError):
        labels.scan_labels(spark, [])
    g = tmp_path / "meta.jsonl"
    g.write_text('{"doc_id":"line_1_v0","text":"x"}\n{"doc_id":"line_2_v0"\n')
    assert [r["doc_id"] for r in labels.done_ids(spark, [str(g)]).collect()] == ["line_1_v0"]
    with pytest.raises(Exception, match="."):
        labels.scan_meta(spark, [str(g)]).collect()
    df = spark.createDataFrame([("line_1_v0", "ᠠ", None)], "doc_id string, text string, src_doc bigint")
    assert json.loads(df.select(labels.to_line(df, ("doc_id",))).first()[0]) == {"text": "ᠠ", "src_doc": None}


def test_column_directory(spark, tmp_path):
    img = imaging.pack(np.full((30, 12), 9, np.uint8))
    rows = [(i, img, f"t{i}", 1, 5, [f"t{i}"]) for i in (2, 10, 1)]
    columns.write_columns(spark.createDataFrame(rows, f"idx bigint, image {imaging.IMAGE}, text string, n_lines int, src_doc bigint, line_texts array<string>"), str(tmp_path))
    (tmp_path / "77.json").write_text('{"text": "no image"}')
    got = columns.read_columns(spark, str(tmp_path)).collect()
    assert [r["idx"] for r in got] == [1, 2, 10] and got[0]["image"]["h"] == 30 and got[2]["line_texts"] == ["t10"]
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError):
        columns.read_columns(spark, str(tmp_path / "empty"))


def test_columns_are_read_in_batches_of_bounded_bytes(spark, tmp_path, monkeypatch):
    """Pixels of 10,000 columns at once, many times their PNGs, filled the executors."""
    import pyarrow as pa

    shapes = {i: (30 + i, 12) for i in range(6)}
    rows = [(i, encode_gray(np.full(s, i, np.uint8)), f"t{i}", 1, 5, [f"t{i}"]) for i, s in shapes.items()]
    columns.write_columns(spark.createDataFrame(rows, "idx bigint, png binary, text string, n_lines int, src_doc bigint, line_texts array<string>"), str(tmp_path / "dir"))
    (tmp_path / "dir" / "4.png").write_bytes(b"no PNG")
    for at in ("dir", "d*"):  # a folder, and a pattern, which goes through the file index
        got = columns.read_columns(spark, str(tmp_path / at)).collect()
        assert [(r["idx"], r["image"]["h"], r["text"]) for r in got] == [(i, None if i == 4 else h, f"t{i}") for i, (h, _) in shapes.items()]
    monkeypatch.setattr(columns, "BATCH_BYTES", 2 * 12 * 30)
    names = pa.RecordBatch.from_pylist([{"idx": i, "json": {"name": f"{i}.json"}, "png": {"name": f"{i}.png"}} for i in shapes])
    batches = list(columns._reader(str(tmp_path / "dir"))(iter([names])))
    assert [b["idx"].to_pylist() for b in batches] == [[0, 1], [2, 3], [4, 5]]


def test_column_dir_roundtrip_keeps_pixels_out_of_rows(spark, tmp_path, monkeypatch):
    from glyphmill.plans import evaluation

    rows = [(i, "t", 5, ["ab" * i, None, "abc"][: 1 + i % 3]) for i in range(12)]
    spark.createDataFrame(rows, "idx bigint, text string, src_doc bigint, line_texts array<string>").write.parquet(f"{tmp_path}/column_labels.parquet")
    written, write = [], columns.write_columns
    monkeypatch.setattr(columns, "write_columns", lambda df, path: written.append(df) or write(df, path))
    got = [tuple(r) for r in evaluation.column_dir_roundtrip(spark, str(tmp_path)).collect()]
    assert got == [(i, "t", 5, 60 + 80 * (i % 3)) for i in range(12)]
    assert "image#" not in written[0]._jdf.queryExecution().optimizedPlan().toString()


def test_count_roll_into_tars(spark, tmp_path):
    df = shards.roll_count(spark.createDataFrame([(f"k{i}", png(), sample(i, "x")) for i in range(5)], "key string, png binary, json string"), [F.col("key")], 2)
    tarshard.write(df, str(tmp_path), "val-", 4)
    assert [f.rsplit("/", 1)[1] for f in tarshard.list_shards(f"{tmp_path}/*.tar")] == ["val-0000.tar", "val-0001.tar", "val-0002.tar"]


def test_overwriting_shards_never_leaves_too_few(spark, tmp_path):
    """New shards replace those of their name, others go; rows come in Arrow batches."""
    schema = "key string, png binary, json string, shard bigint"
    tarshard.write(spark.createDataFrame([(f"a{i}", png(), sample(i, "x"), i) for i in range(4)], schema), str(tmp_path))
    tarshard.write(spark.createDataFrame([(f"b{i}", png(), sample(i, "y"), i % 2) for i in range(5000)], schema), str(tmp_path))
    got = tarshard.labelled(tarshard.read(spark, f"{tmp_path}/*.tar"))
    assert got.count() == 5000 and {r["text"] for r in got.select("text").distinct().collect()} == {"y"}
    assert len(list(tmp_path.iterdir())) == 2 and tarshard.labelled(tarshard.read(spark, f"{tmp_path}/*.tar"), limit=7).count() == 7


def test_detection_pages(spark, tmp_path):
    strips = [np.full((h, w), (100 + h) % 256, np.uint8) for h, w in ((40, 30), (900, 60), (20, 5000))]
    rows = [(p, i, imaging.pack(s), f"t{i}") for p in (1, 2) for i, s in enumerate(strips)] + [(3, 0, imaging.pack(strips[2]), "wide"), (4, 0, None, "none"), (5, 0, imaging.pack(strips[0][:5]), "flat")]
    df = spark.createDataFrame(rows, f"page int, o int, image {imaging.IMAGE}, text string")
    p = imaging.detection_pages(df, "page", "o", "image", "text", F.col("page"), 400, 300)
    boxes = imaging.labelled_boxes(F.col("boxes"), F.col("texts"), F.transform("texts", lambda t: F.upper(t)))
    got = detection.write_pages(p, str(tmp_path), F.format_string("p%d", "page"), F.lit("F"), F.col("page_image"), boxes).orderBy("page_id").collect()
    assert [r["page_id"] for r in got] == ["p1", "p2"] and got[0]["image_size"] == [300, 400]
    for r in got:
        page = decode_gray((tmp_path / r["image"]).read_bytes())
        assert [b["render_text"] for b in r["bboxes"]] == ["T0", "T1"] and r["bboxes"][1]["h"] == 240
        for b, value in zip(r["bboxes"], (140, (100 + 900) % 256)):
            assert (page[b["y"] : b["y"] + b["h"], b["x"] : b["x"] + b["w"]] == value).all()
    assert got[0]["bboxes"][0]["y"] != got[1]["bboxes"][0]["y"]
