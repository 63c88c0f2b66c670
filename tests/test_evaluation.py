import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.functions.png import decode_gray, encode_gray
from glyphmill.operators import alignment, control, ctc, imaging, metrics, model
from glyphmill.operators.alphabet import Alphabet


def report(spark, pairs):
    return metrics.report(metrics.scored(spark.createDataFrame(pairs, "ref string, pred string"))).first()


def test_metrics(spark):
    r = report(spark, [("ᠠᠡ", "ᠠ᠋ᠡ")])
    assert r["norm_cer"] == 0 and r["raw_cer"] > 0
    assert report(spark, [("abce", "abcd")])["norm_cer"] == 0.25
    assert math.isclose(report(spark, [("a b d", "a b c")])["wer"], 1 / 3)
    r = report(spark, [("abc", "abc"), ("xz", "xy"), (None, None), ("", "q")])
    assert r["n"] == 4 and r["line_exact"] == 0.5
    assert report(spark, [])["n"] == 0 and report(spark, [])["norm_cer"] == 0.0
    d = metrics.distribution(spark.createDataFrame([(float(i),) for i in range(6)], "v double"), "v", 90.0).first()
    assert d["p"] == 4.0  # 4.5 rounds to the even rank
    assert (d["median"], d["n"], d["mean"]) == (2.5, 6, 2.5)
    assert metrics.distribution(spark.createDataFrame([], "v double"), "v").first()["p"] == 0.0
    hot = spark.createDataFrame([(0.0,)] * 90 + [(None,)] + [(i / 10,) for i in range(1, 11)], "v double")
    d = metrics.distribution(hot, "v", 95.0).first()
    assert (d["n"], d["median"], d["p"], d["max"]) == (100, 0.0, 0.5, 1.0) and math.isclose(d["mean"], 0.055)


def test_align():
    assert alignment.align("ᠲ", "ᠳ") == [("sub", "ᠲ", "ᠳ")]
    assert [o[0] for o in alignment.align("ab", "ba")] == ["sub", "sub"]
    assert [o[0] for o in alignment.align("", "abc")] == ["ins"] * 3 and [o[0] for o in alignment.align("abc", "")] == ["del"] * 3
    rng = random.Random(6)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in "xy")
        ops = alignment.align(a, b)
        assert "".join(o[1] for o in ops) == a and "".join(o[2] for o in ops) == b
        # brute force distance
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert sum(o[0] != "match" for o in ops) == row[-1]


def test_confusion(spark):
    df = spark.createDataFrame([("t", "d"), ("t", "t"), ("d", "t"), (None, "x")], "ref string, pred string")
    p = alignment.pair_rows(df, alignment.pair_table(spark, [("q", "z")], [("t", "d")]))
    rows = {r["cls"]: r for r in p.collect()}
    assert (rows["B"]["ab"], rows["B"]["ba"], rows["B"]["undirected"], rows["B"]["occ"]) == (1, 1, 2, 3)
    assert rows["A"]["rate"] == 0.0
    pooled = {r["cls"]: r["rate"] for r in alignment.pooled(p).collect()}
    assert math.isclose(pooled["B"], 2 / 3)
    assert alignment.PAIRS_A == (("ᠣ", "ᠤ"), ("ᠥ", "ᠦ"))


def test_ctc(spark):
    df = spark.createDataFrame([([0, 2, 0],), ([0, 0, 2, 1, 1],), ([2, 2],), ([],), ([1],)], "ids array<int>")
    assert [r[0] for r in df.select(ctc.collapse(F.col("ids"), 2)).collect()] == [[0, 0], [0, 1], [], [], [1]]
    tie = spark.createDataFrame([([[0.5, 0.5, 0.1]],)], "f array<array<double>>")
    assert tie.select(ctc.frame_ids(F.col("f"))).first()[0] == [0]
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4, 3))
    lp = x - np.log(np.exp(x).sum(axis=1, keepdims=True))
    for target in ([], [0], [0, 1], [0, 0], [1, 0, 1]):
        total = 0.0
        for path in itertools.product(range(3), repeat=4):
            out = [p for i, p in enumerate(path) if p != 2 and (i == 0 or p != path[i - 1])]
            if out == target:
                total += math.exp(sum(lp[i, p] for i, p in enumerate(path)))
        assert math.isclose(ctc.nll(lp, target, 2), -math.log(total), rel_tol=1e-9)
    assert ctc.nll(lp, [0, 0, 0, 0], 2) == 0.0
    soft = spark.createDataFrame([([1.0, 1000.0],)], "f array<double>").select(ctc.log_softmax(F.col("f"))).first()[0]
    assert np.allclose(soft, [-999.0, 0.0])


def test_tiler():
    bars = np.full((990, 100), 250, np.uint8)
    for i in range(5):
        bars[i * 210 : i * 210 + 150] = 20
    p = imaging.row_profile(bars)
    for target, window, least in ((300, 150, 100), (300, 150, 50), (300, 150, 200)):
        t = imaging.tile_cuts(p, target, window, least)
        assert t[0][0] == 0 and t[-1][1] == 990 and all(a[1] == b[0] for a, b in zip(t, t[1:])) and all(b - a >= least for a, b in t)
    gaps = [(150, 210), (360, 420), (570, 630), (780, 840)]
    assert all(any(a <= cut <= b for a, b in gaps) for cut, _ in imaging.tile_cuts(p, 300, 150, 50)[1:])
    assert imaging.tile_cuts(np.full(500, 240.0)) == [(0, 500)]
    dark = imaging.tile_cuts(np.full(2000, 20.0), 500, 100, 200)
    assert dark[-1][1] == 2000 and sum(b - a for a, b in dark) == 2000
    for bad in ({"target": 0}, {"target": 100, "least": 200}):
        with pytest.raises(ValueError):
            imaging.tile_cuts(p, **bad)
    with pytest.raises(ValueError):
        imaging.row_profile(np.zeros((2, 2, 2)))


def test_image_kernels():
    s = imaging.stack([np.zeros((50, 20), np.uint8), np.zeros((80, 40), np.uint8), np.zeros((30, 10), np.uint8)], 15)
    assert s.shape == (190, 40) and (s[50:65] == 255).all() and (s[:50, :10] == 255).all() and (s[:50, 10:30] == 0).all()
    with pytest.raises(ValueError):
        imaging.stack([], 1)
    strip = np.full((120, 40), 240, np.uint8)
    strip[30:90, 10:30] = 30
    assert imaging.ink_crop(strip).shape == (76, 36) and imaging.tight_crop(strip).shape == (72, 32)
    assert imaging.tight_crop(np.full((20, 20), 240, np.uint8)) is None
    flat = np.full((20, 20), 7, np.uint8)
    assert imaging.ink_crop(flat).shape == flat.shape and imaging.ink_crop(np.zeros((3, 9), np.uint8)).shape == (3, 9)
    x = imaging.model_input(strip, 64, 32)
    assert x.shape == (1, 64, 32) and 0 <= x.min() and x.max() <= 1
    assert (imaging.resize(flat, 7, 5) == 7).all()
    for k in (1, 4, 5, 6):
        v = np.arange(20.0)
        assert np.allclose(imaging.moving_average(v, k), np.convolve(v, np.ones(k) / k, "same"))
    _, padded, n = imaging.collate([x, x], [[1, 2, 3], [1]])
    assert padded.tolist() == [[1, 2, 3], [1, 0, 0]] and n.tolist() == [3, 1]
    boxes = imaging.compose([(100, 50), (900, 100), (10, 5000)], 1, 400, 500)
    assert len(boxes) == 2 and boxes[1][3] == 440 and all(30 <= y and y + h <= 470 for _, y, _, h in boxes)
    assert imaging.compose([], 1, 400, 500) == [] and imaging.compose([(10, 5000)], 1, 400, 500) == []
    assert imaging.best_cut(np.array([1.0, 5, 5, 9]), 1, 1, 0) == 1 and imaging.best_cut(np.array([1.0, 5, 5, 9]), 1, 1, 2) == 2 and imaging.best_cut(np.zeros(4), 9, 1, 0) == 3
    assert imaging.geometry(40, 1.5, 10, 28) == (round(40 * 1.5 * 1.15) + 20, round(28 * 40 * 0.62 * 1.6) + 20)


def test_png():
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (13, 7), dtype=np.uint8)
    data = encode_gray(img)
    assert (decode_gray(data) == img).all()
    for bad in (b"", b"x" * 40, data[:-20], data[:50] + bytes([data[50] ^ 1]) + data[51:]):
        with pytest.raises(ValueError):
            decode_gray(bad)


def test_model():
    assert model.matched_hidden(614, 64) == 462
    assert model.params(614, 384, "concat") == 8_737_574 and model.params(614, 462, "mean_big") == 8_747_918
    with pytest.raises(ValueError):
        model.check_hidden("mean_big", 384, 614)
    assert model.resolve_arch({}) == (384, "mean", 64) and model.resolve_arch({"width_collapse": "concat"}, mode="mean")[1] == "concat" and model.resolve_arch({}, mode="concat")[1] == "concat"
    assert model.resolve_arch({"lstm_hidden": None}, hidden=5)[0] is None
    for mode in ("mean", "concat", "concat_proj"):
        w = model.init(5, 6, mode)
        y = model.forward(w, np.zeros((2, 1, 32, 64)), mode)
        assert y.shape == (2, model.n_frames(32), 5)
        # batch normalization also holds two running statistics, which aren't parameters
        assert sum(v.size for k, v in w.items() if not k.startswith("bn")) + sum(2 * c for c in model.STEM[1:]) == model.params(5, 6, mode)
    x = np.arange(2 * 3 * 4 * 2.0).reshape(2, 3, 4, 2)
    f = model.collapse_width(x, "concat")
    assert f[1, 2, 1 * 2 + 1] == x[1, 1, 2, 1]
    with pytest.raises(RuntimeError):
        model.forward(model.init(5, 6, "concat"), np.zeros((1, 1, 32, 96)), "concat")


def test_control(spark):
    s = control.State(1.0, 1 / 64)
    assert s.feed(0.5) and not s.feed(0.49995) and s.no_improve == 1 and not s.feed(0.1, is_full=True) and s.no_improve == 1
    n = 0
    while not s.stopped:
        s.feed(0.6)
        n += 1
        assert n < 100
    assert s.lr == 1 / 64 and n == 29
    df = spark.createDataFrame([("r", i, 0.5) for i in range(40)] + [("q", 1, 0.2), ("q", 0, 0.3), ("q", 2, None)], "run string, step bigint, cer double")
    got = {(r["run"], r["step"]): r for r in control.run_machine(df, "run", "step", "cer", 1.0).collect()}
    assert got["r", 39]["stopped"] and got["q", 1]["is_best"] and ("q", 2) not in got
    lr = spark.range(4).select(control.warmup(1.0, F.col("id"), 2).alias("x")).collect()
    assert [r["x"] for r in lr] == [0.5, 1.0, 1.0, 1.0]


def test_predict(spark):
    img = imaging.pack(np.full((40, 30), 200, np.uint8))
    a = Alphabet(("a", "b"))
    df = spark.createDataFrame([(1, img), (2, img)], f"idx int, image {imaging.IMAGE}")
    got = model.predict(df, "image", model.init(3, 4), a, 32, 64).collect()
    assert len(got) == 2 and got[0]["pred"] == got[1]["pred"] and set(got[0]["pred"]) <= {"a", "b"}


def test_read_columns_model_reads_every_line_at_production_size(spark, tmp_path, monkeypatch):
    from glyphmill.plans import evaluation

    spark.createDataFrame([(1, ["ab", None, "abcabc"]), (2, ["b"]), (3, [])], "idx int, line_texts array<string>").write.parquet(f"{tmp_path}/column_labels.parquet")
    spark.createDataFrame([("abc" * 10,), ("z",)], "text string").write.parquet(f"{tmp_path}/meta.parquet")
    seen, predict = [], model.predict
    monkeypatch.setattr(model, "predict", lambda df, image, w, a, *size: seen.append((w, a, size)) or predict(df, image, w, a, *size))
    got = {(r["idx"], r["ord"]): r["n_chars"] for r in evaluation.read_columns_model(spark, str(tmp_path)).collect()}
    (w, a, (height, width, mode)), = seen
    assert (a.chars, height, width, mode, w["wh0f"].shape[1]) == (("a", "b", "c"), 1024, 64, "mean", 384)
    want = {}
    for at, k in {(1, 0): 2, (1, 1): 0, (1, 2): 6, (2, 0): 1}.items():
        strip = np.full((60, 40 + 2 * k), 240, np.uint8)
        strip[15:45, 10 : 30 + k] = 30
        ids = model.forward(w, imaging.model_input(strip, 1024, 64)[None]).argmax(axis=2)[0]
        want[at] = sum(x != a.blank and (i == 0 or x != ids[i - 1]) for i, x in enumerate(ids))
    assert got == want


def test_read_columns_model_reads_equal_images_once(spark, tmp_path, monkeypatch):
    from glyphmill.plans import evaluation

    spark.createDataFrame([(i, ["ab", None, "ba"]) for i in range(50)], "idx int, line_texts array<string>").write.parquet(f"{tmp_path}/column_labels.parquet")
    spark.createDataFrame([("abc" * 10,)], "text string").write.parquet(f"{tmp_path}/meta.parquet")
    read, predict = [], model.predict
    monkeypatch.setattr(model, "predict", lambda df, *x: read.append(df) or predict(df, *x))
    got = {(r["idx"], r["ord"]): r["n_chars"] for r in evaluation.read_columns_model(spark, str(tmp_path)).collect()}
    assert sorted(got) == [(i, o) for i in range(50) for o in range(3)] and read[0].count() == 2
    assert all(got[i, o] == got[0, o % 2] for i in range(50) for o in range(3))


def test_tar_roundtrip_packs_columns_without_moving_their_pixels(spark, tmp_path, monkeypatch):
    """Pixels of a column, many times its PNG, filled the executors when strips and columns were rows."""
    from glyphmill.functions.png import decode_gray
    from glyphmill.plans import evaluation

    rows = [(i, "t", 5, ["ab" * i, None, "abc"][: 1 + i % 3]) for i in range(7)] + [(3, "u", None, ["abcd"]), (9, None, 1, ["a"])]
    spark.createDataFrame(rows, "idx bigint, text string, src_doc bigint, line_texts array<string>").write.parquet(f"{tmp_path}/column_labels.parquet")
    packed, write = [], evaluation.tarshard.write
    monkeypatch.setattr(evaluation.tarshard, "write", lambda df, path: packed.append(df) or write(df, path))
    got = {r["key"]: (r["text"], r["src_doc"], r["h"]) for r in evaluation.tar_roundtrip(spark, str(tmp_path)).collect()}
    assert "image#" not in packed[0]._jdf.queryExecution().optimizedPlan().toString()
    want = {r["idx"]: imaging.unpack(r["image"]) for r in evaluation._columns(spark, str(tmp_path)).collect()}
    assert got == {f"col_{i:08d}": ("u" if i == 3 else "t", 0 if i == 3 else 5, len(want[i])) for i in range(7)}
    assert all((decode_gray(bytes(r["png"])) == want[r["idx"]]).all() for r in evaluation._column_pngs(spark, str(tmp_path)).collect())


def test_ctc_loss_takes_the_whole_target(spark, tmp_path):
    from glyphmill.plans import evaluation

    x = np.random.default_rng(7).normal(size=(8, 8)) * 0.1
    best = [0, 1, 2, 7, 2, 3, 4, 4]
    x[range(8), best] += 2
    spark.createDataFrame([(1, x.ravel().tolist())], "vec_id bigint, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    lp = x - np.log(np.exp(x).sum(axis=1, keepdims=True))
    want = ctc.nll(lp, [0, 1, 2, 2, 3, 4], 7) / 6
    assert math.isclose(evaluation.ctc_loss(spark, str(tmp_path)).first()["loss"], want, rel_tol=1e-9)


def test_collated_batches(spark):
    rows = [(f"k{i:02d}", [1] * (i % 4), imaging.pack(np.full((20, 10), i, np.uint8))) for i in range(10)] + [("z", None, None)]
    df = spark.createDataFrame(rows, f"key string, ids array<int>, image {imaging.IMAGE}").repartition(3)
    got = imaging.collated(df, [F.col("key")], "image", "ids", 4, 8, 6).orderBy("batch").collect()
    assert [r["n"] for r in got] == [4, 4, 2] and got[0]["lengths"] == [0, 1, 2, 3] and got[0]["targets"][1] == [1, 0, 0]
    x = np.frombuffer(got[1]["images"], np.float32).reshape(4, 1, 8, 6)
    assert np.allclose(x[:, 0, 0, 0], [1 - i / 255 for i in range(4, 8)])
    assert imaging.collated(df, [F.col("key")], "image", "ids", 4, 8, 6, partial=False).count() == 2
