"""Character vocabularies: histogram, curation, identity, coverage, encoding.

The histogram is a partial and a final hash aggregation over exploded code points, so one row for each
distinct character and task is shuffled. A vocabulary is bounded by Unicode (1.1 million), in practice
by some thousands; ``MAX_CHARS`` is checked before it is collected or broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.text import chars

# The keys of a vocabulary file.
FILE_KEYS = ("chars", "sha256", "n_chars", "blank", "min_count", "source", "n_labels_scanned", "n_code_points")
#: private characters from U+F0000 on stand for ids, so there can't be more
MAX_CHARS = 131_072


def histogram(df: DataFrame, text: str = "text") -> DataFrame:
    """(ch, n) of every character; null and empty texts have none."""
    return df.where(F.col(text).isNotNull()).select(F.explode(chars(F.col(text))).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Alphabet:
    """Characters in ascending code point order; the blank of CTC is the id after the last."""

    chars: tuple[str, ...]

    @classmethod
    def from_counts(cls, counts: DataFrame, min_count: int = 1) -> Alphabet:
        got = [r[0] for r in counts.where(F.col("n") >= min_count).select("ch").limit(MAX_CHARS + 1).collect()]
        if len(got) > MAX_CHARS:
            raise ValueError("too many characters for a vocabulary")
        return cls(tuple(sorted(got)))

    @property
    def blank(self) -> int:
        return len(self.chars)

    @property
    def n_classes(self) -> int:
        return len(self.chars) + 1

    @property
    def sha256(self) -> str:
        return hashlib.sha256("".join(self.chars).encode()).hexdigest()

    def _class(self) -> str:
        """The characters as the inside of a regular expression's class."""
        return "".join(f"\\x{{{ord(c):X}}}" for c in self.chars)

    def covers(self, text: Column) -> Column:
        """Every character is in the vocabulary; true for the empty text, null for null."""
        return text.rlike(f"\\A[{self._class()}]*\\z") if self.chars else text == ""

    def encode(self, text: Column) -> Column:
        """Ids of the characters; those out of vocabulary are left out. Characters are swapped for
        private ones in the order of the ids (one hash lookup each), whose code points give the ids."""
        if not self.chars:
            return F.when(text.isNotNull(), F.array().cast("array<int>"))
        base = 0xF0000
        private = "".join(chr(base + i) for i in range(len(self.chars)))
        swapped = F.translate(F.regexp_replace(text, f"[^{self._class()}]", ""), "".join(self.chars), private)
        return F.transform(chars(swapped), lambda c: F.ascii(c) - base)

    def decode(self, ids: Column) -> Column:
        """The text of ids."""
        names = F.array(*[F.lit(c) for c in self.chars]).cast("array<string>")
        return F.array_join(F.transform(ids, lambda i: F.element_at(names, i + 1)), "")

    def save(self, path: str, source: str = "", n_labels: int = 0, n_code_points: int = 0, min_count: int = 1) -> None:
        """Writes the vocabulary file; it never holds counts of characters."""
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            json.dump(dict(zip(FILE_KEYS, (list(self.chars), self.sha256, len(self.chars), self.blank, min_count, source, n_labels, n_code_points), strict=True)), f, ensure_ascii=False, indent=1)

    @classmethod
    def load(cls, path: str) -> Alphabet:
        """Reads a vocabulary file; a sha256 that doesn't fit the characters is an error, none is not."""
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        a = cls(tuple(d["chars"]))
        if d.get("sha256") not in (None, "", a.sha256):
            raise ValueError("vocabulary file is damaged: sha256 differs")
        return a

    def require_same(self, other: Alphabet) -> None:
        """Fails unless the other vocabulary (say a checkpoint's) is this one."""
        if self.chars != other.chars:
            raise ValueError("vocabularies differ")


def ids(counts: DataFrame, min_count: int = 1) -> DataFrame:
    """(ch, id): characters that occur often enough, numbered in ascending code point order. The window
    runs over one row a distinct character, a set bounded by Unicode."""
    from pyspark.sql import Window

    return counts.where(F.col("n") >= min_count).select("ch", (F.row_number().over(Window.orderBy("ch")) - 1).alias("id"))


def sha(counts: DataFrame, min_count: int = 1) -> DataFrame:
    """(n_chars, sha256) of the vocabulary."""
    c = counts.where(F.col("n") >= min_count).agg(F.array_sort(F.collect_list("ch")).alias("c"))
    return c.select(F.size("c").cast("bigint").alias("n_chars"), F.sha2(F.encode(F.array_join("c", ""), "UTF-8"), 256).alias("sha256"))


def curation(counts: DataFrame, min_count: int) -> DataFrame:
    """(kept, dropped, dropped_occurrences, code_points) in one pass."""
    rare = F.col("n") < min_count
    return counts.agg(F.count_if(~rare).alias("kept"), F.count_if(rare).alias("dropped"), F.coalesce(F.sum(F.when(rare, F.col("n"))), F.lit(0)).alias("dropped_occurrences"), F.coalesce(F.sum("n"), F.lit(0)).alias("code_points"))


def dropped_top(counts: DataFrame, min_count: int, k: int = 20) -> DataFrame:
    """The k most frequent dropped characters (ties by code point)."""
    return counts.where(F.col("n") < min_count).orderBy(F.desc("n"), "ch").limit(k)


def save_counts(counts: DataFrame, path: str) -> None:
    """``{"U+XXXX": [char, n]}`` in descending count, ties by code point."""
    rows = counts.orderBy(F.desc("n"), "ch").collect()  # a row a character: bounded by Unicode
    with open(path, "w", encoding="utf-8") as f:
        json.dump({f"U+{ord(r['ch']):04X}": [r["ch"], r["n"]] for r in rows}, f, ensure_ascii=False, indent=0)


def load_counts(spark, path: str) -> DataFrame:
    """(ch, n) of a counts file, instead of scanning again."""
    with open(path, encoding="utf-8") as f:
        return spark.createDataFrame([tuple(v) for v in json.load(f).values()], "ch string, n bigint")
