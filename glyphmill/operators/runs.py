"""Consecutive runs of a work, and columns of neighbouring lines.

Runs need the line before. Rows are numbered by partition (order.py); a row is a start if its work
differs from the one before; the run number is the count of starts so far, again by partition offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import derive_seed
from glyphmill.operators.order import numbered


def runs(df: DataFrame, order: list[Column], key: str, block: int = 1_000_000) -> DataFrame:
    """``df`` with pos, run (from 0, in order) and ord (position in the run, from 0). A key that comes
    back later is a new run; null is a key like any other.

    Positions are cut into blocks of ``block`` rows; windows run within a block, and one row a block
    carries what came before, so no task sees more than a block."""
    d = numbered(df, order, "pos").withColumn("_b", F.floor(F.col("pos") / block))
    w = Window.partitionBy("_b").orderBy("pos")
    last = d.groupBy("_b").agg(F.max_by(F.struct(F.col(key).alias("k")), "pos").alias("_last")).select((F.col("_b") + 1).alias("_b"), "_last")
    d = d.join(last, "_b", "left")
    here = F.struct(F.col(key).alias("k"))
    prev = F.coalesce(F.lag(here).over(w), F.col("_last"))
    d = d.withColumn("_start", F.when(prev.isNull() | ~prev["k"].eqNullSafe(F.col(key)), 1).otherwise(0)).drop("_last")
    starts = d.groupBy("_b").agg(F.sum("_start").alias("_n"), F.max(F.when(F.col("_start") == 1, F.col("pos"))).alias("_p"))
    up_to = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = starts.select("_b", F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_before"), F.max("_p").over(up_to).alias("_open"))
    d = d.join(before, "_b")
    run = F.col("_before") + F.sum("_start").over(w) - 1
    first = F.coalesce(F.max(F.when(F.col("_start") == 1, F.col("pos"))).over(w), F.col("_open"))
    return d.withColumn("run", run).withColumn("ord", F.col("pos") - first).drop("_b", "_start", "_before", "_open")


def run_lengths(numbered_runs: DataFrame, key: str) -> DataFrame:
    """(run, key, n)."""
    return numbered_runs.groupBy("run").agg(F.first(key).alias(key), F.count("*").alias("n"))


def length_stats(lengths: DataFrame) -> DataFrame:
    """(n_runs, min_n, max_n, median_n): the upper median. Lengths are counted first, so the sorted array
    is replaced by a window over the distinct lengths."""
    by = lengths.groupBy("n").agg(F.count("*").alias("c"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    cum = by.select("n", "c", F.sum("c").over(w).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("total"))
    return cum.agg(F.coalesce(F.max("total"), F.lit(0)).alias("n_runs"), F.min("n").alias("min_n"), F.max("n").alias("max_n"), F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("n"))).alias("median_n"))


def eligible(lengths: DataFrame, least: int) -> DataFrame:
    """Runs of at least ``least`` lines."""
    return lengths.where(F.col("n") >= least)


def column_plan(lengths: DataFrame, n_columns: int, lo: int, hi: int, seed: int) -> DataFrame:
    """(idx, run, start, k): ``n_columns`` windows of lo to hi lines. Runs of at least ``lo`` lines are visited in turn
    in a seeded order; a window's size and start are drawn from the seed and the column's number. No columns if no run
    is long enough."""
    spark = lengths.sparkSession
    order = [derive_seed(seed, F.col("run")), F.col("run")]
    # runs are visited in turn, so no more than n_columns can be used
    able = eligible(lengths, lo).orderBy(*order).limit(n_columns).withColumn("_rank", F.row_number().over(Window.orderBy(*order)) - 1)
    n = able.count()
    if not n:
        return spark.createDataFrame([], "idx bigint, run bigint, start bigint, k bigint")
    c = spark.range(n_columns).select(F.col("id").alias("idx"), (F.col("id") % n).alias("_rank")).join(able, "_rank")
    k = F.lit(lo) + derive_seed(seed + 1, F.col("idx") * 2) % (F.least(F.lit(hi), F.col("n")) - lo + 1)
    c = c.withColumn("k", k.cast("bigint"))
    return c.select("idx", "run", (derive_seed(seed + 1, F.col("idx") * 2 + 1) % (F.col("n") - F.col("k") + 1)).alias("start"), "k")


def columns(numbered_runs: DataFrame, plan: DataFrame, text: str = "text") -> DataFrame:
    """(idx, run, n_lines, text, line_texts) of planned windows: lines with ord in [start, start + k) of
    the run, in order, joined with single spaces. The plan's row is replicated to the k ordinals of its
    window, so the range join is an equi-join; windows are short, so no group is large."""
    want = plan.select("idx", "run", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("k") - 1)).alias("ord"))
    got = numbered_runs.select("run", "ord", F.col(text).alias("_t")).join(want, ["run", "ord"])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "_t"))), lambda x: x["_t"])
    return got.groupBy("idx", "run").agg(F.count("*").alias("n_lines"), lines.alias("line_texts")).withColumn("text", F.array_join("line_texts", " "))

