import json

from pyspark.sql import functions as F

from glyphmill.operators import control
from glyphmill.operators.alphabet import histogram
from glyphmill.streaming import ingest


def run(df, name, mode, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).trigger(availableNow=True).start()
    q.awaitTermination()


def test_histogram_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    texts = ["ab", "bc", "ᠠb", ""]
    for i, t in enumerate(texts):
        (src / f"{i}.jsonl").write_text(json.dumps({"text": t}) + "\n{torn\n")
    run(ingest.running_histogram(ingest.label_stream(spark, str(src), 1)), "hist", "complete", tmp_path)
    want = {tuple(r) for r in histogram(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert {tuple(r) for r in spark.table("hist").collect()} == want


def test_first_keys(spark, tmp_path):
    df = spark.createDataFrame([("a", "2031-01-01 00:00:00"), ("a", "2031-01-01 00:00:01"), ("b", "2031-01-01 00:00:02")], "k string, t string").withColumn("t", F.to_timestamp_ntz("t"))
    df.write.parquet(str(tmp_path / "keys"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "keys"))
    run(ingest.first_keys(s, "k", "t"), "keys", "append", tmp_path)
    assert sorted(r["k"] for r in spark.table("keys").collect()) == ["a", "b"]


def test_control_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(r, i, 0.5 - (i % 7) / 100) for r in ("x", "y") for i in range(30)], "run string, step bigint, cer double")
    at = str(tmp_path / "evals")
    df.where("step < 15").coalesce(1).write.parquet(at)
    df.where("step >= 15").coalesce(1).write.mode("append").parquet(at)
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(at)
    run(ingest.control_stream(s, 1.0), "control", "append", tmp_path)
    key = lambda r: (r["run"], r["step"], r["is_best"], r["no_improve"], r["lr"], r["stopped"])
    assert {key(r) for r in spark.table("control").collect()} == {key(r) for r in control.run_machine(df, "run", "step", "cer", 1.0).collect()}


def test_append_resumes(spark, tmp_path):
    df = spark.createDataFrame([("00000", "a"), ("00001", "b")], "bucket string, t string")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        ingest.append_lines(s, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
