"""Incremental ingestion with Structured Streaming: results equal the batch operators'."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.text import chars
from glyphmill.operators.control import State

RUN = "run string, step bigint, cer double, is_best boolean, no_improve int, lr double, stopped boolean"


def label_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """(text) of JSON-lines files as they arrive; bad rows are skipped."""
    from glyphmill.sources.labels import parsed

    raw = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return parsed(raw.select(F.trim("value").alias("raw")).where("raw <> ''")).where("_error is null").select("text")


def running_histogram(labels: DataFrame) -> DataFrame:
    """(ch, n) so far; state is one row a distinct character."""
    return labels.select(F.explode(chars(F.col("text"))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))


def first_keys(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; repeats within ``late`` are dropped, and so is state older than that.
    A timestamp without zone is read as UTC."""
    kind = dict(stream.dtypes)[at]
    d = stream if kind == "timestamp" else stream.withColumn(at, F.col(at).cast("timestamp"))
    return d.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def control_stream(evals: DataFrame, base_lr: float) -> DataFrame:
    """The training control as a stateful stream of (run, step, cer): one state a run, evaluations of a
    trigger taken in the order of steps."""
    def fold(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        s = State(base_lr, base_lr / 64)
        if state.exists:
            s.lr, s.best, s.no_improve, s.low, s.bad, s.stopped = state.get
        p = pd.concat(list(batches)).sort_values(["step", "cer"])
        out = []
        for step, cer in zip(p["step"], p["cer"]):
            best = s.feed(float(cer))
            out.append((key[0], step, cer, best, s.no_improve, s.lr, s.stopped))
        state.update((s.lr, s.best, s.no_improve, s.low, s.bad, s.stopped))
        yield pd.DataFrame(out, columns=["run", "step", "cer", "is_best", "no_improve", "lr", "stopped"])

    d = evals.select(F.col("run").cast("string"), F.col("step").cast("bigint"), F.col("cer").cast("double")).where("cer is not null")
    return d.groupBy("run").applyInPandasWithState(fold, RUN, "lr double, best double, no_improve int, low double, bad int, stopped boolean", "append", "NoTimeout")


def observed(df: DataFrame, name: str) -> DataFrame:
    """``df`` that reports its rows (and bad ones, if it has ``_error``) as it runs, to listeners."""
    bad = [F.count_if(F.col("_error").isNotNull()).alias("n_errors")] if "_error" in df.columns else []
    return df.observe(name, F.count(F.lit(1)).alias("n_rows"), *bad)


def append_lines(stream: DataFrame, path: str, checkpoint: str):
    """Writes a stream by bucket as Parquet, once for each row: resumes from its checkpoint."""
    return stream.writeStream.partitionBy("bucket").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
