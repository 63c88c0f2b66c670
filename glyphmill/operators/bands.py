"""Splits of works by number: thresholds with a gap, as Columns, so that they are pushed to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP = 200


def two_way(doc: Column, threshold: int, gap: int = GAP) -> Column:
    """``eval`` from the threshold on, ``train`` below threshold - gap, null between and for null."""
    return F.when(doc >= threshold, "eval").when(doc < threshold - gap, "train")


def three_way(doc: Column, val: int, test: int, gap: int = GAP) -> Column:
    """``test`` from ``test`` on, ``val`` in [val, test - gap), ``train`` below val - gap, else null. With
    test - gap <= val the val band is empty."""
    if not val < test:
        raise ValueError("val must be below test")
    return F.when(doc >= test, "test").when((doc >= val) & (doc < test - gap), "val").when(doc < val - gap, "train")


def stats(df: DataFrame, doc: str, split: Column) -> DataFrame:
    """(split, n_rows, n_docs, min_doc, max_doc); rows in no band have split ``gap``."""
    return df.groupBy(F.coalesce(split, F.lit("gap")).alias("split")).agg(F.count("*").alias("n_rows"), F.count_distinct(doc).alias("n_docs"), F.min(doc).alias("min_doc"), F.max(doc).alias("max_doc"))


def disjoint(df: DataFrame, doc: str, split: Column) -> DataFrame:
    """(n_shared): works in more than one split."""
    d = df.select(F.col(doc).alias("d"), split.alias("s")).where("d is not null and s is not null")
    return d.groupBy("d").agg(F.min("s").alias("a"), F.max("s").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).alias("n_shared"))


def coverage_guard(df: DataFrame, doc: str, val: int, test: int, gap: int = GAP) -> DataFrame:
    """(n_val, n_test, min_doc, ok): both populated, and the scan began below val."""
    s = three_way(F.col(doc), val, test, gap)
    g = df.agg(F.count_if(s == "val").alias("n_val"), F.count_if(s == "test").alias("n_test"), F.min(doc).alias("min_doc"))
    return g.withColumn("ok", (F.col("n_val") > 0) & (F.col("n_test") > 0) & F.coalesce(F.col("min_doc") < val, F.lit(False)))
