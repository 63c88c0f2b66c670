"""The pN queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bpe, frequency, harm, leaks, looks_alike, packing, splits
from glyphmill.llm.look import corrected_column, look_column
from glyphmill.tables import SharedTable, table

SHARES = {"train": 0.8, "val": 0.1, "test": 0.1}
CAPACITY = 8192


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its counts and marks."""
    meta, docs = table(spark, d, "meta"), table(spark, d, "documents")
    chars = frequency.mark_terms(frequency.frequencies(meta, "text", "character"), meta.count(), 10, 0.5)
    words = frequency.mark_terms(frequency.frequencies(docs, "text", "word"), docs.count(), 3, 0.1)
    cols = ["field", "term", "occurrences", "records", "mark"]
    return chars.withColumn("field", F.lit("meta.text")).select(cols).unionByName(words.withColumn("field", F.lit("documents.text")).select(cols))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_frequencies(spark, d).where("mark is not null").select("field", "term", "mark")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    edges = splits.shared_text_edges(table(spark, d, "meta"), table(spark, d, "stock_lines"))
    return splits.components(edges).where("node <> component").select(F.col("component").alias("group_src_doc"), F.col("node").alias("src_doc"))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    m = splits.assign_splits(table(spark, d, "meta"), table(spark, d, "stock_lines"), SHARES)
    return m.select("doc_id", "src_doc", "unit", "split")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the splits beside those asked for."""
    return splits.shares_of(p2_splits(spark, d), SHARES)


def p2_units(spark: SparkSession, d: str) -> DataFrame:
    """Units by kind, none of them in several splits."""
    return splits.unit_report(p2_splits(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.Overlaps(table(spark, d, "documents")).found().select("doc_id_a", "doc_id_b")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return leaks.report(docs, leaks.Overlaps(docs))


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Words of evaluation documents that stand in spans shared with train, by split and source."""
    docs = table(spark, d, "documents")
    return leaks.coverage_report(docs, leaks.Overlaps(docs))


def _look_values(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    texts = looks_alike.text_values(table(spark, d, "meta"), table(spark, d, "stock_lines"), "doc_id", "text")
    return {"meta.text": texts, "column_labels.line_texts": looks_alike.list_looks(table(spark, d, "column_labels"), "column_key", "line_texts")}


def _of_fields(spark: SparkSession, d: str, what) -> DataFrame:
    texts, lists = (what(v).select(F.lit(n).alias("field"), "*") for n, v in _look_values(spark, d).items())
    return texts.unionByName(lists)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _of_fields(spark, d, looks_alike.pairs)


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """Keys of equal looks in several spellings, by class."""
    return _of_fields(spark, d, looks_alike.classes)


def p4_documents(spark: SparkSession, d: str) -> DataFrame:
    """Every document in its form for comparing, and corrected for use in a corpus."""
    docs = look_column(table(spark, d, "documents").select("doc_id", "text"), "text", "form")
    return corrected_column(docs, "text", "corrected").select("doc_id", "form", "corrected")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(table(spark, d, "documents"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return SharedTable(bpe.token_counts(table(spark, d, "documents"))).df


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sized(spark, d), CAPACITY, empty=True)


def p7_check(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the packing, counted against the documents."""
    sized = _sized(spark, d)
    return packing.check(sized, packing.pack(sized, CAPACITY, empty=True), CAPACITY)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p7_packed(spark, d), CAPACITY)


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return harm.scores(docs, harm.fit(docs, table(spark, d, "review_labels"), table(spark, d, "harm_terms")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where("harmful").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return harm.rates(p8_scores(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_frequencies, p2_found, p2_splits, p2_shares, p2_units, p3_found, p3_report, p3_coverage, p4_found, p4_classes, p4_documents, p6_ids, p7_packed, p7_report, p7_check, p8_found, p8_scores, p8_rates)}
