"""JSON-lines sources with an explicit policy for bad rows.

``skip`` leaves bad rows out, ``count`` keeps them with ``_error``, ``strict`` fails on the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of a line's metadata.
META = "doc_id string, kind string, text string, src_doc bigint, bucket string, font string, font_px int"
POLICIES = ("skip", "count", "strict")


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        raise ValueError("no label files")
    return spark.read.text(paths).select(F.trim("value").alias("raw")).where("raw <> ''")


def parsed(df: DataFrame, raw: str = "raw") -> DataFrame:
    """``df`` with v (variant), text (only if it is a string) and _error (null, ``json`` or ``text``)."""
    v = F.try_parse_json(raw)
    d = df.withColumn("v", v)
    is_text = F.schema_of_variant(F.try_variant_get("v", "$.text", "variant")) == "STRING"
    d = d.withColumn("text", F.when(is_text, F.try_variant_get("v", "$.text", "string")))
    return d.withColumn("_error", F.when(F.col("v").isNull(), "json").when(F.col("text").isNull(), "text"))


def _policy(d: DataFrame, policy: str) -> DataFrame:
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    if policy == "count":
        return d
    if policy == "strict":
        return d.withColumn("text", F.when(F.col("_error").isNotNull(), F.raise_error(F.concat(F.lit("bad row: "), "_error"))).otherwise(F.col("text"))).drop("_error")
    return d.where("_error is null").drop("_error")


def scan_labels(spark: SparkSession, paths: list[str], policy: str = "skip") -> DataFrame:
    """(text[, _error]) of every line that isn't blank; the union of all files, never a sample."""
    return _policy(parsed(_lines(spark, paths)), policy).drop("raw", "v")


def scan_corpus(spark: SparkSession, paths: list[str], min_chars: int = 20) -> DataFrame:
    """(text) of documents of at least ``min_chars`` characters, before any normalization."""
    return scan_labels(spark, paths).where(F.char_length("text") >= min_chars)


def scan_meta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Strict metadata rows: a bad or blank line fails the read."""
    return spark.read.schema(META).option("mode", "FAILFAST").json(paths)


def done_ids(spark: SparkSession, paths: list[str], key: str = "doc_id") -> DataFrame:
    """(key) already written; torn lines are skipped."""
    return spark.read.schema(f"{key} string").option("mode", "DROPMALFORMED").json(paths).where(F.col(key).isNotNull()).distinct()


def to_line(df: DataFrame, drop: tuple[str, ...] = ()) -> Column:
    """A row as one JSON line (nulls kept, text not escaped)."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in drop]), {"ignoreNullFields": "false"})
