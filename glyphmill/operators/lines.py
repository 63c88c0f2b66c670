"""Cutting documents into lines, render plans and pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.text import derive_seed, line_key, normalize
from glyphmill.operators.order import numbered

MIN_CHARS, MAX_CHARS, MIN_DOC = 8, 28, 20
PAGE_BLOCK = 100_000


def cut_words(text: str | None, lo: int, hi: int) -> list[str]:
    """Lines of lo to hi characters, filled word by word. A word longer than ``hi`` is left out and ends
    its line; a line shorter than ``lo`` is lost."""
    lines, at, size = [], [], 0

    def close() -> None:
        nonlocal at, size
        if size >= lo and at:
            lines.append(" ".join(at))
        at, size = [], 0

    for w in (text or "").split(" "):
        if len(w) > hi:
            close()
            continue
        more = len(w) + (1 if at else 0)
        if at and size + more > hi:
            close()
            more = len(w)
        at.append(w)
        size += more
    close()
    return lines


def segment(df: DataFrame, text: str = "text", lo: int = MIN_CHARS, hi: int = MAX_CHARS, min_doc: int = MIN_DOC) -> DataFrame:
    """One row a line of each document of at least ``min_doc`` characters (before normalization):
    ``df``'s other columns with line_no (from 0) and line. Arrow batches; lines never span documents."""

    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: cut_words(t, lo, hi))

    kept = df.where(F.char_length(text) >= min_doc)
    return kept.select(*[F.col(f"`{c}`") for c in df.columns if c != text], F.posexplode(cut(normalize(F.col(text)))).alias("line_no", "line"))


def document_numbers(df: DataFrame, order: list[Column], text: str = "text", min_doc: int = MIN_DOC) -> DataFrame:
    """Documents that survive the length filter, numbered from 0 in ``order``."""
    return numbered(df.where(F.char_length(text) >= min_doc), order, "src_no")


def render_plan(lines: DataFrame, number: Column, variants: int, n_fonts: int, base_seed: int = 0) -> DataFrame:
    """Each line ``variants`` times: (doc_id, variant, font_idx, seed) added; the seed depends on the
    line's number and the variant only, so a resumed run repeats it."""
    d = lines.withColumn("_n", number).withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(variants - 1))))
    return d.withColumn("doc_id", line_key(F.col("_n"), F.col("variant"))).withColumn("font_idx", F.col("variant") % n_fonts).withColumn("seed", derive_seed(base_seed, F.col("_n") * variants + F.col("variant"))).drop("_n")


def page_sizes(pages: Column, lo: int, hi: int, base_seed: int = 0) -> Column:
    """Lines of each page: lo + seed(page) % (hi - lo + 1)."""
    return F.lit(lo) + derive_seed(base_seed, pages) % (hi - lo + 1)


def page_table(spark, n_lines: int, lo: int, hi: int, base_seed: int = 0, max_pages: int | None = None) -> DataFrame:
    """(page, start, n) of pages that fit into ``n_lines`` lines, ``max_pages`` at most; a ragged last page is left out.
    Sizes depend on the page's number only; their running sum is taken in blocks of pages, and over
    one row a block."""
    if not 0 < lo <= hi:
        raise ValueError("pages need a line at least")
    most = n_lines // lo if max_pages is None else min(n_lines // lo, max_pages)
    p = spark.range(most).select(F.col("id").alias("page"), page_sizes(F.col("id"), lo, hi, base_seed).alias("n"), F.floor(F.col("id") / PAGE_BLOCK).alias("_b"))
    blocks = p.groupBy("_b").agg(F.sum("n").alias("_n"))
    before = blocks.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    here = F.sum("n").over(Window.partitionBy("_b").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    at = p.join(F.broadcast(before), "_b").withColumn("start", F.col("_before") + here - F.col("n"))
    return at.where(F.col("start") + F.col("n") <= n_lines).select("page", "start", "n")


def pages(lines: DataFrame, pos: str, lo: int, hi: int, base_seed: int = 0, max_pages: int | None = None, max_lines: int | None = None) -> DataFrame:
    """``lines`` (with a dense 0-based position) with page and slot, of ``max_lines`` lines and ``max_pages``
    pages at most. The table of pages is spread to its positions and joined by position."""
    total = lines.count() if max_lines is None else min(lines.count(), max_lines)
    table = page_table(lines.sparkSession, total, lo, hi, base_seed, max_pages)
    at = table.select("page", F.posexplode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("_slot", "_pos"))
    return lines.join(at, lines[pos] == at["_pos"]).withColumn("slot", F.col("_slot").cast("bigint")).drop("_slot", "_pos")
