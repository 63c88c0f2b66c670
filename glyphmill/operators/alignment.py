"""Character alignment and confusion statistics of letter pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import chars, nominal_fold, u_plus

# Letter pairs that share a glyph (A, the control) and pairs that look alike (B).
PAIRS_A = (("ᠣ", "ᠤ"), ("ᠥ", "ᠦ"))
PAIRS_B = (("ᠲ", "ᠳ"), ("ᠬ", "ᠭ"), ("ᠠ", "ᠡ"), ("ᠢ", "ᠶ"))
OPS = "array<struct<kind:string,r:string,h:string>>"


def distance_table(ref: str, hyp: str) -> np.ndarray:
    """Edit distances of all prefixes, row by row; within a row, insertions are a running minimum."""
    n, m = len(ref), len(hyp)
    a, b = np.array([ord(c) for c in ref], np.int64), np.array([ord(c) for c in hyp], np.int64)
    t = np.empty((n + 1, m + 1), np.int32)
    t[0] = np.arange(m + 1)
    ramp = np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.empty(m + 1, np.int64)
        row[0] = i
        row[1:] = np.minimum(t[i - 1, :-1] + (b != a[i - 1]), t[i - 1, 1:] + 1)
        t[i] = np.minimum.accumulate(row - ramp) + ramp
    return t


def align(ref: str, hyp: str) -> list[tuple[str, str, str]]:
    """(kind, reference character, other character) from start to end; kinds match, sub, del, ins. Traced
    from the end; a diagonal step is preferred, then a deletion, then an insertion."""
    i, j, ops = len(ref), len(hyp), []
    while i and j and ref[i - 1] == hyp[j - 1]:  # an equal end is always matched
        i, j = i - 1, j - 1
        ops.append(("match", ref[i], ref[i]))
    t = distance_table(ref[:i], hyp[:j]) if i or j else None
    while i or j:
        here = t[i, j]
        if i and j and t[i - 1, j - 1] + (ref[i - 1] != hyp[j - 1]) == here:
            i, j = i - 1, j - 1
            ops.append(("match" if ref[i] == hyp[j] else "sub", ref[i], hyp[j]))
        elif i and t[i - 1, j] + 1 == here:
            i -= 1
            ops.append(("del", ref[i], ""))
        else:
            j -= 1
            ops.append(("ins", "", hyp[j]))
    return ops[::-1]


def aligned(df: DataFrame, ref: str = "ref", pred: str = "pred") -> DataFrame:
    """``df`` with ops, the alignment of folded texts; null counts as the empty text."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(OPS)
    def ops(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "r": a, "h": b} for k, a, b in align(x, y)] for x, y in zip(r, h)], dtype=object)

    return df.withColumn("ops", ops(nominal_fold(F.coalesce(ref, F.lit(""))), nominal_fold(F.coalesce(pred, F.lit("")))))


def op_counts(a: DataFrame) -> DataFrame:
    """(kind, n)."""
    return a.select(F.explode("ops").alias("o")).groupBy("o.kind").agg(F.count("*").alias("n"))


def substitutions(a: DataFrame) -> DataFrame:
    """(r, h, n) of directed substitutions."""
    return a.select(F.explode("ops").alias("o")).where("o.kind = 'sub'").groupBy("o.r", "o.h").agg(F.count("*").alias("n"))


def occurrences(df: DataFrame, ref: str = "ref") -> DataFrame:
    """(ch, n) of characters of folded references."""
    return df.where(F.col(ref).isNotNull()).select(F.explode(chars(nominal_fold(F.col(ref)))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))


def pair_table(spark, pairs_a=PAIRS_A, pairs_b=PAIRS_B) -> DataFrame:
    return spark.createDataFrame([("A", a, b) for a, b in pairs_a] + [("B", a, b) for a, b in pairs_b], "cls string, a string, b string")


def pair_rows(df: DataFrame, pairs: DataFrame, ref: str = "ref", pred: str = "pred") -> DataFrame:
    """(cls, pair, ab, ba, undirected, occ, rate): rate is undirected / (occ(a) + occ(b)), 0 without any."""
    letters = pairs.select(F.explode(F.array("a", "b")).alias("ch")).distinct()
    # texts that are equal when folded have no substitutions and needn't be aligned
    fold = lambda c: nominal_fold(F.coalesce(c, F.lit("")))
    sub = substitutions(aligned(df.where(fold(ref) != fold(pred)), ref, pred))
    occ = occurrences(df, ref).join(F.broadcast(letters), "ch", "left_semi")
    way = F.array(F.struct(F.lit("ab").alias("way"), F.col("a").alias("r"), F.col("b").alias("h")), F.struct(F.lit("ba").alias("way"), F.col("b").alias("r"), F.col("a").alias("h")))
    ways = pairs.select("cls", "a", "b", F.inline(way))
    x = ways.join(sub, ["r", "h"], "left").groupBy("cls", "a", "b").agg(*[F.sum(F.when(F.col("way") == w, F.col("n"))).alias(w) for w in ("ab", "ba")])
    for p in ("a", "b"):
        x = x.join(occ.select(F.col("ch").alias(p), F.col("n").alias(f"o{p}")), p, "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("ab", "ba", "oa", "ob")}
    x = x.withColumns(zero).withColumn("undirected", F.col("ab") + F.col("ba")).withColumn("occ", F.col("oa") + F.col("ob"))
    return x.select("cls", F.concat(u_plus(F.col("a")), F.lit("/"), u_plus(F.col("b"))).alias("pair"), "ab", "ba", "undirected", "occ", F.when(F.col("occ") == 0, 0.0).otherwise(F.col("undirected") / F.col("occ")).alias("rate"))


def pooled(rows: DataFrame) -> DataFrame:
    """(cls, undirected, occ, rate) of each class."""
    g = rows.groupBy("cls").agg(F.sum("undirected").alias("undirected"), F.sum("occ").alias("occ"))
    return g.withColumn("rate", F.when(F.col("occ") == 0, 0.0).otherwise(F.col("undirected") / F.col("occ")))
