"""Gates that a data set must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """(n_rows, n_keys, n_duplicates)."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).count()
    return g.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys")).withColumn("n_duplicates", F.col("n_rows") - F.col("n_keys"))


def gate_report(df: DataFrame, key: str, text: str, split: Column, frames: int, covered: Column) -> DataFrame:
    """One row: max_len, frames_ok, n_duplicates, oov_rate, n_val, n_test, ok. Frames must cover the
    longest text; keys must not repeat; val and test must be populated. The rate of texts out of
    vocabulary is for information."""
    d = df.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.char_length(text).alias("len"), F.when(covered, 0).otherwise(1).alias("oov"), split.alias("s"))
    per_key = d.groupBy("k").agg(F.count("*").alias("c"), F.max("len").alias("len"), F.sum("oov").alias("oov"), F.count_if(F.col("s") == "val").alias("v"), F.count_if(F.col("s") == "test").alias("t"))
    g = per_key.agg(
        F.coalesce(F.max("len"), F.lit(0)).cast("bigint").alias("max_len"),
        F.coalesce(F.sum("c") - F.count("*"), F.lit(0)).alias("n_duplicates"),
        F.coalesce(F.sum("oov") / F.sum("c"), F.lit(0.0)).alias("oov_rate"),
        F.coalesce(F.sum("v"), F.lit(0)).alias("n_val"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("n_test"),
    )
    ok = (F.col("max_len") <= frames) & (F.col("n_duplicates") == 0) & (F.col("n_val") > 0) & (F.col("n_test") > 0)
    return g.withColumn("frames_ok", F.col("max_len") <= frames).withColumn("ok", ok)


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if it is empty."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df
