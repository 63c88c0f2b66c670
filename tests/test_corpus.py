import random

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import attempts, bands, lines, order, quality, runs, shards


def test_bands(spark):
    df = spark.createDataFrame([(d,) for d in (50, 150, 250, 95, 195, None)], "d bigint")
    got = {r["d"]: r["s"] for r in df.select("d", bands.three_way(F.col("d"), 100, 200, 10).alias("s")).collect()}
    assert got == {50: "train", 150: "val", 250: "test", 95: None, 195: None, None: None}
    with pytest.raises(ValueError):
        bands.three_way(F.col("d"), 200, 200)
    two = {r["d"]: r["s"] for r in spark.createDataFrame([(d,) for d in (0, 1, 8, 9, 7)], "d bigint").select("d", bands.two_way(F.col("d"), 8, 2).alias("s")).collect()}
    assert two == {0: "train", 1: "train", 8: "eval", 9: "eval", 7: None}
    assert bands.disjoint(df, "d", bands.three_way(F.col("d"), 100, 200, 10)).first()["n_shared"] == 0
    assert bands.coverage_guard(df, "d", 100, 200, 10).first()["ok"]
    assert not bands.coverage_guard(df.where("d > 120"), "d", 100, 200, 10).first()["ok"]


def test_cut_words():
    assert lines.cut_words("aaaa bbbb cccc", 8, 10) == ["aaaa bbbb"]  # the short rest is lost
    assert lines.cut_words("aaaa bbbb " + "x" * 11 + " cccc dddd", 8, 10) == ["aaaa bbbb", "cccc dddd"]
    assert lines.cut_words("", 8, 10) == [] and lines.cut_words(None, 8, 10) == []
    rng = random.Random(4)
    for _ in range(300):
        t = " ".join("w" * rng.randint(1, 12) for _ in range(rng.randint(0, 40)))
        assert all(8 <= len(x) <= 10 for x in lines.cut_words(t, 8, 10))


def test_segment_keeps_other_columns_and_drops_short_documents(spark):
    df = spark.createDataFrame([(1, "word " * 8, "x"), (2, "short", "x"), (3, None, None)], "doc_id bigint, text string, line_source string")
    got = lines.segment(df).collect()
    assert {r["doc_id"] for r in got} == {1} and got[0]["line_source"] == "x" and all(8 <= len(r["line"]) <= 28 for r in got)
    assert lines.segment(df.where("false")).count() == 0


def test_numbering_batches_strides(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    n = order.numbered(df, [F.col("v")])
    assert n.where("pos <> v").count() == 0
    ties = order.numbered(df.select((F.col("v") % 3).alias("v"), F.lit(1).alias("pos")), [F.col("v")], "at")
    assert sorted(r["at"] for r in ties.collect()) == list(range(1000)) and "pos" in ties.columns
    assert order.numbered(df.where("false"), [F.col("v")]).count() == 0
    assert {r["batch"] for r in order.batches(df, [F.col("v")], 300, False).select("batch").distinct().collect()} == {0, 1, 2}
    assert order.batches(df, [F.col("v")], 300, True).where("batch = 3").count() == 100
    assert sorted(r["v"] for r in order.strided(df, [F.col("v")], 4).collect()) == [0, 250, 500, 750]
    a, b = ([r["v"] for r in order.seeded(df, F.col("v"), s).collect()] for s in (1, 2))
    assert a == [r["v"] for r in order.seeded(df.repartition(7), F.col("v"), 1).collect()] and a != b and sorted(a) == sorted(b)


def test_seeded_order_has_every_key_in_the_order_of_the_shuffle(spark, tmp_path):
    from glyphmill.plans import corpus

    spark.range(500).selectExpr("concat('d', id % 250) as doc_id").unionAll(spark.createDataFrame([(None,)], "doc_id string")).write.parquet(f"{tmp_path}/meta.parquet")
    got = corpus.seeded_order(spark, str(tmp_path)).collect()
    keys = spark.read.parquet(f"{tmp_path}/meta.parquet").distinct()
    want = [r["doc_id"] for r in order.seeded(keys, F.col("doc_id"), 3).collect()]
    assert len(want) == 251 and [r["doc_id"] for r in sorted(got, key=lambda r: r["pos"])] == want
    assert sorted(r["pos"] for r in got) == list(range(251))
    other = order.seeded_positions(keys, F.col("doc_id"), 4).collect()
    assert {r["doc_id"] for r in other} == set(want) and [r["doc_id"] for r in sorted(other, key=lambda r: r["pos"])] != want


def test_byte_rolls(spark):
    rng = random.Random(5)
    sizes = [rng.randint(0, 60) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i bigint, size bigint")
    got = {r["i"]: r["shard"] for r in shards.roll_bytes(df, [F.col("i")], F.col("size"), 100, 3).collect()}
    for c in range(3):
        part = sizes[c * 100 : c * 100 + 100]
        assert [got[c * 100 + k] for k in range(100)] == [s + c * 100 for s in shards.roll_sizes(part, 100)]
    assert shards.roll_sizes([100, 1, 99, 5], 100) == [0, 1, 1, 2]
    # ranges of a fixed number of rows, so that tasks grow with the input
    wide = df.withColumn("payload", F.lit(b"x"))
    got = shards.roll_bytes(wide, [F.col("i")], F.col("size"), 100, rows=40)
    assert got.select("chunk").distinct().count() == 8 and got.where("payload = X'78'").count() == 300
    got = {r["i"]: r["shard"] for r in got.collect()}
    assert all([got[c * 40 + k] for k in range(len(p))] == [s + c * 100 for s in shards.roll_sizes(p, 100)] for c in range(8) for p in [sizes[c * 40 : c * 40 + 40]])
    with pytest.raises(Exception, match="more than 100 shards"):
        shards.roll_bytes(df, [F.col("i")], F.col("size"), 1, rows=200).collect()
    assert [r["shard"] for r in shards.roll_count(df, [F.col("i")], 150).orderBy("i").collect()] == [0] * 150 + [1] * 150


def test_lookups_take_null_and_repeated_keys(spark):
    meta = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("a", 4)], "key string, n int")
    img = spark.createDataFrame([("a",), ("a",), (None,)], "key string")
    assert {(r["n"], r["missing"]) for r in shards.with_images(meta, img, "key").collect()} == {(1, False), (4, False), (2, True), (3, True)}
    assert {r["n"] for r in shards.resume(meta, img, "key").collect()} == {2, 3}


def test_runs(spark):
    for keys, want in (([0, 0, 5, 5, 5, 9], [2, 3, 1]), ([0, 1, 0], [1, 1, 1]), ([None, None, 1], [2, 1])):
        df = spark.createDataFrame(list(enumerate(keys)), "i bigint, k bigint")
        for block in (2, 1000):
            r = runs.runs(df, [F.col("i")], "k", block)
            assert [x["n"] for x in runs.run_lengths(r, "k").orderBy("run").collect()] == want
            ords = [x["ord"] for x in r.orderBy("i").collect()]
            assert ords == [j for n in want for j in range(n)]
    empty = spark.createDataFrame([], "i bigint, k bigint")
    assert runs.runs(empty, [F.col("i")], "k").count() == 0
    s = runs.length_stats(spark.createDataFrame([(i, n) for i, n in enumerate([1, 5, 2, 9])], "run bigint, n bigint")).first()
    assert (s["n_runs"], s["min_n"], s["max_n"], s["median_n"]) == (4, 1, 9, 5)


def test_column_plan_and_build(spark):
    one = spark.createDataFrame([(0, 3), (1, 10)], "run bigint, n bigint")
    plan = runs.column_plan(one, 5, 5, 8, 1).collect()
    assert [r["idx"] for r in sorted(plan)] == list(range(5)) and all(r["run"] == 1 and 5 <= r["k"] <= 8 and 0 <= r["start"] <= 10 - r["k"] for r in plan)
    df = spark.createDataFrame([(i, 7, f"L{i}") for i in range(10)], "i bigint, k bigint, text string")
    r = runs.runs(df, [F.col("i")], "k")
    c = runs.columns(r, spark.createDataFrame([(0, 0, 2, 5)], "idx int, run bigint, start bigint, k int")).first()
    assert c["text"] == "L2 L3 L4 L5 L6" and c["n_lines"] == 5
    assert runs.column_plan(one.where("n < 5"), 5, 5, 8, 1).count() == 0
    lengths = spark.createDataFrame([(i, i % 9) for i in range(50)], "run bigint, n bigint")
    a, b, other = (runs.column_plan(x, 40, 5, 8, s).orderBy("idx").collect() for x, s in ((lengths, 1), (lengths.repartition(3), 1), (lengths, 2)))
    able = {i for i in range(50) if i % 9 >= 5}
    # every eligible run has its turn before one has a second
    assert a == b and a != other and {r["run"] for r in a} == able and len({r["run"] for r in a[: len(able)]}) == len(able)


def test_pages(spark, monkeypatch):
    monkeypatch.setattr(lines, "PAGE_BLOCK", 4)
    n, size = 50, lambda p: 3 + ((2 * 1000003 + p * 2654435761 + 12345) & 0x3FFFFFFF) % 5
    want, at, page = {}, 0, 0
    while at + size(page) <= n:
        want |= {(page, at + i): i for i in range(size(page))}
        at, page = at + size(page), page + 1
    df = spark.range(n).select(F.col("id").alias("pos"), F.lit("x").alias("page_"))
    got = {(r["page"], r["pos"]): r["slot"] for r in lines.pages(df, "pos", 3, 7, 2).collect()}
    assert got == want
    assert {r["page"] for r in lines.pages(df, "pos", 3, 7, 2, max_pages=2).collect()} == {0, 1}
    assert max(r["pos"] for r in lines.pages(df, "pos", 3, 7, 2, max_lines=20).collect()) < 20
    assert lines.pages(df.where("false"), "pos", 3, 7).count() == 0
    with pytest.raises(ValueError):
        lines.pages(df, "pos", 0, 7)


def test_batches_and_cumulative_sums(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 7).alias("w"))
    assert order.batches(df, [F.desc("k")], 30, True, max_batches=2).agg(F.min("k")).first()[0] == 40
    got = {r["k"]: r["upto"] for r in order.cumulative(df, [F.col("k")], "w").collect()}
    assert got == {k: sum(i % 7 for i in range(k + 1)) for k in range(100)}


def test_gates(spark):
    df = spark.createDataFrame([("a", "xy", 1), ("a", "xyz", 150), (None, "q", 3), ("b", None, 250)], "k string, t string, d bigint")
    g = quality.gate_report(df, "k", "t", bands.three_way(F.col("d"), 100, 200, 10), 3, F.coalesce(F.col("t") != "xyz", F.lit(False))).first()
    assert (g["max_len"], g["n_duplicates"], g["n_val"], g["n_test"], g["ok"]) == (3, 1, 1, 1, False)
    assert quality.duplicate_keys(df.where("false"), "k").first()["n_duplicates"] == 0
    with pytest.raises(ValueError):
        quality.require_rows(df.where("false"), "samples")


def test_attempts(spark):
    def kernel(v, attempt):
        if v is None or attempt < v:
            raise ValueError(f"{v} at {attempt}")
        return None if v == 2 else [float(v)]

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (None, "e")], "v int, other string")
    got = {r["other"]: (r["result"], r["status"], r["tries"], r["error"]) for r in attempts.attempted(df, "v", kernel, "array<double>", 3).collect()}
    assert got == {"a": ([1.0], "ok", 1, None), "b": (None, "empty", 2, None), "c": ([3.0], "ok", 3, None), "d": (None, "dropped", 3, "ValueError: 4 at 3"), "e": (None, "dropped", 3, "ValueError: None at 3")}
    assert attempts.attempted(df.where("false"), "v", kernel, "array<double>").count() == 0


def test_shared_tables_go(spark):
    import os

    from glyphmill import tables

    t = tables.SharedTable(spark.range(3).toDF("i"))
    at = tables.local_path(t.path)
    assert t.df.count() == 3 and os.path.isdir(at)
    tables.drop_tables(spark)
    assert not os.path.exists(at) and not tables._kept
    with pytest.raises(ValueError):
        tables.local_path("hdfs://host/folder")
