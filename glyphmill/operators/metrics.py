"""Recognition metrics: character and word error rates, exact lines, distributions.

Distances are expressions of each row; a report is one aggregate with partial sums, so nothing but
the sums is shuffled. Micro average: summed distance over summed reference length (1 at least a row).
Rows with a null reference or prediction: null counts as the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.distance import char_distance, error_rate, nearest_rank, token_distance
from glyphmill.functions.text import nominal_fold, tokens


def scored(df: DataFrame, ref: str = "ref", pred: str = "pred") -> DataFrame:
    """``df`` with raw_dist, raw_len, norm_dist, norm_len, word_dist, word_len and exact (on folded text)."""
    r, p = F.coalesce(F.col(ref), F.lit("")), F.coalesce(F.col(pred), F.lit(""))
    fr, fp = nominal_fold(r), nominal_fold(p)
    d = df.withColumns({"_r": r, "_p": p, "_fr": fr, "_fp": fp}).withColumns({"_wr": tokens(F.col("_fr")), "_wp": tokens(F.col("_fp"))})
    return d.withColumns(
        {
            "raw_dist": char_distance(F.col("_p"), F.col("_r")),
            "raw_len": F.char_length("_r").cast("bigint"),
            "norm_dist": char_distance(F.col("_fp"), F.col("_fr")),
            "norm_len": F.char_length("_fr").cast("bigint"),
            "word_dist": token_distance(F.col("_wp"), F.col("_wr")),
            "word_len": F.size("_wr").cast("bigint"),
            "exact": F.col("_fr") == F.col("_fp"),
        }
    ).drop("_r", "_p", "_fr", "_fp", "_wr", "_wp")


def cer(df: DataFrame, normalized: bool = True) -> Column:
    """Aggregate Column over scored rows."""
    return error_rate(F.col("norm_dist"), F.col("norm_len")) if normalized else error_rate(F.col("raw_dist"), F.col("raw_len"))


def report(s: DataFrame, *by: str) -> DataFrame:
    """(by..., n, norm_cer, raw_cer, wer, line_exact) of scored rows; with no rows and no key: zeros."""
    return s.groupBy(*by).agg(
        F.count("*").alias("n"),
        error_rate(F.col("norm_dist"), F.col("norm_len")).alias("norm_cer"),
        error_rate(F.col("raw_dist"), F.col("raw_len")).alias("raw_cer"),
        error_rate(F.col("word_dist"), F.col("word_len")).alias("wer"),
        F.coalesce(F.avg(F.col("exact").cast("double")), F.lit(0.0)).alias("line_exact"),
    )


def key_alignment(refs: DataFrame, preds: DataFrame, key: str) -> DataFrame:
    """(only_ref, only_pred, both): keys of either side, instead of a check of equal lengths."""
    a, b = refs.select(key).where(F.col(key).isNotNull()).distinct().withColumn("r", F.lit(1)), preds.select(key).where(F.col(key).isNotNull()).distinct().withColumn("p", F.lit(1))
    j = a.join(b, key, "full")
    return j.agg(F.count_if(F.col("p").isNull()).alias("only_ref"), F.count_if(F.col("r").isNull()).alias("only_pred"), F.count_if(F.col("p").isNotNull() & F.col("r").isNotNull()).alias("both"))


def distribution(values: DataFrame, value: str, percent: float = 90.0) -> DataFrame:
    """(n, mean, median, p, min, max): ``p`` is the nearest rank, round half even of percent / 100 * (n - 1); the
    median of an even number is the mean of the middle two; zeros if there are none. Equal values are counted
    first, so one that most rows have is one row in the distributed sort."""
    from glyphmill.operators.order import cumulative

    by = values.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).groupBy("v").agg(F.count("*").alias("c"))
    got = cumulative(by, [F.col("v")], "c")
    n = got.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    at = max(0, min(n - 1, round(percent / 100.0 * (n - 1)))) if n else 0

    def rank(i: int) -> Column:
        return F.min(F.when(F.col("upto") > i, F.col("v")))

    out = got.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"), ((rank(max(0, n - 1) // 2) + rank(n // 2 if n else 0)) / 2).alias("median"), rank(at).alias("p"), F.min("v").alias("min"), F.max("v").alias("max"))
    return out.select("n", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "median", "p", "min", "max")])


__all__ = ["cer", "distribution", "key_alignment", "nearest_rank", "report", "scored"]
